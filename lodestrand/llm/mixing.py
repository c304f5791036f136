"""Mixing sources to target weights by hierarchical budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.llm.common import cut

LEVELS = ("domain", "lang", "source")
#: Weights by node path; nodes that are not named weigh 1.
WEIGHTS: dict[tuple[str, ...], int] = {("d0",): 4, ("d1",): 3, ("d2",): 2, ("d0", "en"): 3, ("d1", "en"): 3, ("d2", "en"): 3, ("d3", "en"): 3}
NUMBER = "decimal(19,0)"


def domain_of(source: Column, domains: int = 4) -> Column:
    """A domain for tables that have none: sources dealt into ``domains`` groups."""
    digit = F.conv(F.substring(F.md5(F.coalesce(source, F.lit(""))), 1, 4), 16, 10).cast("int")
    return F.concat(F.lit("d"), (digit % domains).cast("string"))


def leaf_columns(docs: DataFrame) -> list[Column]:
    """domain, lang and source of each row; null is the empty name."""
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    domain = F.coalesce(F.col("domain").cast("string"), F.lit("")) if "domain" in docs.columns else domain_of(source)
    return [domain.alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), source.alias("source")]


def weight_of(path: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of the node that the path columns name."""
    named = {k: v for k, v in weights.items() if len(k) == len(path)}
    if not named:
        return F.lit(1).cast("long")
    table = F.create_map(*(F.lit(x) for k, v in named.items() for x in ("\x1f".join(k), v)))
    return F.coalesce(F.element_at(table, F.concat_ws("\x1f", *path)), F.lit(1)).cast("long")


def share_out(nodes: DataFrame, parent: Sequence[str], name: str) -> DataFrame:
    """Budgets of siblings: in proportion to ``weight``, none above its ``capacity``.

    ``nodes`` has the parent's ``available`` budget. What a full node cannot take goes to its
    siblings in proportion: with siblings in the order of capacity over weight, a node is full if
    its capacity is at most its part of what the fuller ones before it leave. Whole tokens only;
    remainders of the division are not given out.
    """
    own = W.partitionBy(*parent).orderBy(F.col("capacity") / F.col("weight"), name)
    before = own.rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast(NUMBER)
    number = lambda c: F.col(c).cast(NUMBER)
    ranked = nodes.select(
        "*",
        F.coalesce(F.sum("capacity").over(before), F.lit(0)).cast("long").alias("_taken"),
        (F.sum("weight").over(W.partitionBy(*parent)) - F.coalesce(F.sum("weight").over(before), F.lit(0))).cast("long").alias("_weights"),
    )
    full = number("capacity") * number("_weights") <= number("weight") * (F.col("available") - F.col("_taken")).cast(NUMBER)
    marked = ranked.withColumn("_full", full)
    whole = W.partitionBy(*parent)
    left = F.col("available").cast(NUMBER) - F.coalesce(F.sum(F.when(F.col("_full"), number("capacity"))).over(whole), zero)
    rest = F.sum(F.when(~F.col("_full"), F.col("weight"))).over(whole)
    part = marked.select("*", left.cast("long").alias("_left"), rest.alias("_rest"))
    share = F.call_function("div", number("weight") * number("_left"), number("_rest"))
    return part.withColumn("budget", F.when(F.col("_full"), F.col("capacity")).otherwise(share)).drop(
        "_taken", "_weights", "_full", "_left", "_rest", "available"
    )


def leaf_budgets(leaves: DataFrame, budget: Column, max_epochs: int, weights: Mapping[tuple[str, ...], int]) -> DataFrame:
    """Budgets of leaves ``(domain, lang, source, tokens)`` from the root's, level by level.

    A node's capacity is what its leaves hold times ``max_epochs``. As each level is shared out
    under these bounds, a shortage is taken up by siblings first; only when a whole subtree is full
    does the rest go to its parent's siblings.
    """
    capacity = leaves.select(*LEVELS, (F.col("tokens") * max_epochs).alias("capacity"))
    given = capacity.agg(F.least(budget, F.sum("capacity")).alias("available"))
    for depth, name in enumerate(LEVELS, 1):
        path, parent = LEVELS[:depth], LEVELS[: depth - 1]
        nodes = capacity.groupBy(*path).agg(F.sum("capacity").alias("capacity")).withColumn("weight", weight_of(path, weights))
        nodes = nodes.join(given, list(parent)) if parent else nodes.crossJoin(F.broadcast(given))  # one row
        given = share_out(nodes, parent, name).select(*path, F.col("budget").alias("available"))
    return given.withColumnRenamed("available", "budget")


def order_key(seed: str, epoch: Column) -> Column:
    """Place of a document in a seeded epoch."""
    return F.md5(F.concat(F.lit(f"{seed}-"), epoch.cast("string"), F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))


def plan_mix(
    docs: DataFrame,
    percent: int = 60,
    max_epochs: int = 4,
    weights: Mapping[tuple[str, ...], int] = WEIGHTS,
    seed: str = "mix",
    docs_in_bucket: int = 1000,
) -> tuple[DataFrame, DataFrame]:
    """The documents' tokens, and per leaf how many whole epochs it gives and where the next one ends.

    Running sums never gather a leaf: its documents are dealt into buckets by the first digits of
    their order key, of some ``docs_in_bucket`` documents each; sums of buckets are accumulated per
    leaf, and only the bucket in which the budget ends is summed document by document.
    """
    tokens = cut(
        docs.select("doc_id", *leaf_columns(docs), F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("n_tokens")),
        "tokens",
    )
    leaves = cut(tokens.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n")).where("tokens > 0"), "leaves")
    total = F.call_function("div", F.sum(F.col("capacity") / max_epochs).cast("long") * percent, F.lit(100))
    budgets = leaf_budgets(leaves, total, max_epochs, weights)
    digits = F.least(F.lit(8), F.ceil(F.log(16.0, F.greatest(F.lit(1.0), F.col("n") / docs_in_bucket)))).cast("int")
    whole = F.call_function("div", F.col("budget"), F.col("tokens"))
    plan = cut(
        leaves.join(budgets, list(LEVELS)).select(
            *LEVELS, "tokens", "budget", whole.alias("epochs"), (F.col("budget") - whole * F.col("tokens")).alias("rest"), digits.alias("digits")
        ),
        "plan",
    )
    key = order_key(seed, F.col("epochs"))
    keyed = tokens.where("n_tokens > 0").join(plan.where("rest > 0"), list(LEVELS)).select("*", key.alias("key"))
    keyed = keyed.withColumn("bucket", F.left("key", F.col("digits")))
    sums = keyed.groupBy(*LEVELS, "bucket", "rest").agg(F.sum("n_tokens").alias("n"))
    upto = F.sum("n").over(W.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(W.unboundedPreceding, 0))
    last = (
        sums.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        .groupBy(*LEVELS).agg(F.min_by(F.struct("bucket", (F.col("rest") - F.col("upto") + F.col("n")).alias("room")), "bucket").alias("last"))
        .select(*LEVELS, F.col("last.bucket").alias("bucket"), F.col("last.room").alias("room"))
    )
    inside = keyed.join(last, [*LEVELS, "bucket"]).withColumn("upto", F.sum("n_tokens").over(W.partitionBy(*LEVELS, "bucket").orderBy("key")))
    ends = inside.where("upto <= room").groupBy(*LEVELS).agg(F.max("key").alias("last_key"))
    plan = plan.join(last.select(*LEVELS, "bucket"), list(LEVELS), "left").join(ends, list(LEVELS), "left")
    return tokens, cut(plan.select(*LEVELS, "epochs", "rest", "bucket", "last_key", "budget"), "ends")


def taken_epochs(seed: str) -> Column:
    """Epochs for which a row joined with its leaf's plan is taken."""
    key = order_key(seed, F.col("epochs"))
    more = (F.col("rest") > 0) & (
        (key < F.col("bucket")) | F.coalesce(key <= F.col("last_key"), F.lit(False))
    )
    return F.concat(
        F.when(F.col("epochs") > 0, F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)).otherwise(F.array().cast("array<bigint>")),
        F.when(F.coalesce(more, F.lit(False)), F.array("epochs")).otherwise(F.array().cast("array<bigint>")),
    )


def mix(docs: DataFrame, percent: int = 60, max_epochs: int = 4, weights: Mapping[tuple[str, ...], int] = WEIGHTS, seed: str = "mix") -> DataFrame:
    """Documents selected to target weights: ``(doc_id, domain, lang, source, n_tokens, epoch)``, a row for each epoch.

    The budget is ``percent`` of all tokens (words between ASCII blanks). It flows down the tree of
    domains, languages and sources in proportion to ``weights`` (see :func:`leaf_budgets`); no leaf
    gives more than ``max_epochs`` times what it has. A leaf with budget for e whole epochs and a
    rest gives all documents for epochs 0 to e-1 and, of epoch e, the documents of its seeded order
    up to the last whose running sum of tokens stays within the rest.

    Native expressions, joins and windows only. Defined cases: null lang or source is the empty
    name, a null doc_id is ordered as an empty one; texts without words are never taken; repeated rows
    have one place and are taken together; an empty table gives no rows; a column ``domain`` is used
    if there is one, other columns are ignored.
    """
    tokens, plan = plan_mix(docs, percent, max_epochs, weights, seed)
    joined = tokens.where("n_tokens > 0").join(plan, list(LEVELS))
    return joined.select("doc_id", *LEVELS, "n_tokens", F.explode(taken_epochs(seed)).alias("epoch"))


def mixed_rows(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` that :func:`mix` selects, with all their columns, once for each epoch.

    The texts meet only the plan of the leaves, which is small and joins without moving them where
    it fits Spark's broadcast limit.
    """
    seed = settings.get("seed", "mix")
    _, plan = plan_mix(docs, **settings)
    row = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", *leaf_columns(docs), F.col("text").cast("string").rlike(r"[^\x20\x09-\x0D]").alias("some"))
    joined = row.where("some").join(plan, list(LEVELS))
    return joined.select("row", F.explode(taken_epochs(seed)).alias("epoch")).select("row.*")
