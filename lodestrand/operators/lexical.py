"""Postings in blocks of like chunks, and BM25 over the blocks that can reach the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import informative_terms, is_informative, tokenize
from lodestrand.operators.filters import META, asked_fields, filter_masks, meet
from lodestrand.session import cut, setting

#: A block has at most 2**BLOCK_BITS chunks.
BLOCK_BITS = 5


def _runs(tokens: Column) -> Column:
    """``(term, tf, length)`` of each distinct token: sorted once, a run of equal ones is a count."""

    def of_sorted(t: Column) -> Column:
        at = F.slice(F.sequence(F.lit(0), F.size(t)), F.lit(1), F.size(t))
        starts = F.filter(at, lambda i: (i == 0) | (F.get(t, i) != F.get(t, i - 1)))
        row = lambda p, j, own: F.struct(F.get(t, p).alias("term"), (F.coalesce(F.get(own, j + 1), F.size(t)) - p).cast("long").alias("tf"), F.size(t).alias("length"))
        return F.flatten(F.transform(F.array(starts), lambda own: F.transform(own, lambda p, j: row(p, j, own))))

    # a lambda's variable is evaluated once, a repeated expression is not
    return F.flatten(F.transform(F.array(F.sort_array(tokens)), of_sorted))


def build_postings(chunks: DataFrame) -> DataFrame:
    """``(chunk_id, block, term, tf, length)`` and the filter columns, from three times the title and the content.

    Counts are taken inside the row, and blocks are cut from each partition ordered by visibility, domain
    and size, so that like chunks are together: nothing is shuffled. Which chunks share a block depends on
    the partitions; no result does.
    """
    text = F.concat_ws(" ", "title", "title", "title", "content")
    laid = chunks.sortWithinPartitions("visibility", "domain", F.length("content"))
    # numbered before the rows are opened
    numbered = laid.select("chunk_id", F.shiftright(F.monotonically_increasing_id(), BLOCK_BITS).alias("block"), *META, text.alias("text"))
    return numbered.select("chunk_id", "block", *META, F.inline(_runs(tokenize(F.col("text")))))


def query_terms(queries: DataFrame) -> DataFrame:
    """Distinct terms of each query ``(query_id, query, filter_id)`` with their frequency and the least matches asked for."""
    tokens = queries.select("query_id", "filter_id", tokenize(F.col("query")).alias("tokens"))
    need = tokens.select("*", F.size(informative_terms(F.col("tokens"))).alias("informative"))
    return (
        need.where("informative > 0")
        .select("query_id", "filter_id", "informative", F.explode("tokens").alias("term"))
        .groupBy("query_id", "filter_id", "informative", "term").agg(F.count("*").alias("qtf"))
        .withColumn("counts", is_informative(F.col("term")))
    )


def corpus_size(chunks: DataFrame, filters: DataFrame, postings: DataFrame, masks: list[int] | None = None) -> DataFrame:
    """Per filter the number and average length of its chunks; lengths are the postings' counts, so no text is read again."""
    masks = filter_masks(filters) if masks is None else masks
    fields = asked_fields(masks)
    met = chunks.groupBy(*fields).agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("tokens")).unionByName(
        postings.groupBy(*fields).agg(F.lit(0).cast("long").alias("n"), F.sum("tf").alias("tokens"))
    )
    sums = meet(met, filters, masks).groupBy("filter_id").agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
    return sums.select("filter_id", "n", F.try_divide(F.col("tokens").cast("double"), F.col("n")).alias("average"))


def wanted_terms(filters: DataFrame, terms: DataFrame) -> DataFrame:
    """Each term of each filter once, however many queries have it, under a number ``t``."""
    once = terms.select("filter_id", "term").distinct().join(filters, "filter_id")
    return cut(once.withColumn("t", F.monotonically_increasing_id()), "wanted")


def open_postings(postings: DataFrame, wanted: DataFrame, masks: list[int]) -> DataFrame:
    """Postings of the wanted terms in chunks that the filter lets through."""
    own = postings.join(wanted.select("term").distinct(), "term", "left_semi").select(*asked_fields(masks), "term", "block", "chunk_id", "tf", "length")
    return meet(own, wanted, masks, ("term",))


def corpus_term_stats(postings: DataFrame, filters: DataFrame, terms: DataFrame) -> DataFrame:
    """Document frequency of the terms ``(filter_id, term)`` among the chunks that the filter lets through."""
    return open_postings(postings, wanted_terms(filters, terms), filter_masks(filters)).groupBy("filter_id", "term").agg(F.count("*").alias("df"))


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """Ranks 1 to ``k`` per query by score, then chunk_id; Spark cuts each task's rows to k first."""
    own = W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)


def bounded_blocks(weighed: DataFrame, blocks: DataFrame, least: int) -> DataFrame:
    """``(query_id, block, bound)``: what no chunk of the block can score more than.

    ``weighed (query_id, t, weight, counts, informative)`` are the queries' terms, ``blocks (t, block, top)`` has
    the largest part of the term in the block. A block with fewer informative terms of a query than a
    chunk needs is left out.
    """
    own = weighed.join(blocks, "t").groupBy("query_id", "block")
    sums = own.agg(F.sum(F.col("weight") * F.col("top")).alias("bound"), F.count_if("counts").alias("met"), F.max("informative").alias("informative"))
    return sums.where(F.col("met") >= F.least(F.lit(least), F.col("informative"))).select("query_id", "block", "bound")


def _scores(some: DataFrame, weighed: DataFrame, opened: DataFrame, least: int) -> DataFrame:
    """``(query_id, chunk_id, score)`` of the chunks in ``some (query_id, block)`` that pass the match gate.

    Both sides are dealt by block alone, and stay where they are for the sums: only the queries'
    terms of reached blocks and these blocks' postings are shuffled, no row for each query, chunk and term.
    """
    asked = some.select("query_id", "block").join(weighed, "query_id").repartition("block")
    reached = opened.join(some.select("block").distinct(), "block", "left_semi")
    rows = asked.join(reached.repartition("block").hint("merge"), ["block", "t"])
    return (
        rows.groupBy("block", "query_id", "chunk_id")
        .agg(F.round(F.sum(F.col("weight") * F.col("part")), 9).alias("score"), F.count_if("counts").alias("met"), F.max("informative").alias("informative"))
        .where((F.col("met") >= F.least(F.lit(least), F.col("informative"))) & (F.col("score") > 0))
        .select("query_id", "chunk_id", "score")
    )


def bm25_search(
    queries: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, k: int = 3, k1: float = 1.5, b: float = 0.75, least: int = 2
) -> DataFrame:
    """BM25 top ``k`` per query: ``(query_id, chunk_id, score, rank)``.

    Statistics come from the chunks that the query's filter lets through. A chunk needs as many
    distinct informative terms as the query has, at most ``least``. Equal scores are ordered by
    chunk_id; scores are compared at nine digits, so the order of summation cannot break ties between copies.

    Postings of the queries' terms are opened once, each term of a filter once. From them come the
    frequencies and, a row for each term and block, the largest part that a chunk of the block can have;
    a hot term is so spread over blocks. Each query scores the few blocks of the highest bounds, whose
    k-th score is a floor, and then just the blocks whose bound reaches the floor: postings of all others
    meet no query.
    """
    masks = filter_masks(filters)
    terms = cut(query_terms(queries), "terms")
    sizes = cut(corpus_size(chunks, filters, postings, masks), "sizes")
    wanted = wanted_terms(filters.join(sizes, "filter_id"), terms)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("length") / F.col("average")))
    opened = cut(open_postings(postings, wanted, masks).select("t", "block", "chunk_id", part.alias("part")), "opened")
    blocks = cut(opened.groupBy("t", "block").agg(F.count("*").alias("df"), F.max("part").alias("top")), "blocks")
    known = wanted.join(blocks.groupBy("t").agg(F.sum("df").alias("df")), "t").select("filter_id", "term", "t", "n", "df")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighed = cut(terms.join(known, ["filter_id", "term"]).select("query_id", "t", "counts", "informative", (F.col("qtf") * idf).alias("weight")), "weights")
    reach = cut(bounded_blocks(weighed, blocks, least), "bounds")
    by_bound = W.partitionBy("query_id").orderBy(F.desc("bound"), "block")
    first = cut(reach.withColumn("at", F.row_number().over(by_bound)).where(F.col("at") <= 4 + k // 8), "first-blocks")
    # a join on block and term may use rows that are dealt by block
    with setting(queries.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        best = cut(top_k(_scores(first, weighed, opened, least), k), "first")
    floor = best.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") == k)
    rest = cut(reach.join(floor.select("query_id", "floor"), "query_id", "left").where(F.col("bound") + 1e-6 >= F.coalesce("floor", F.lit(0.0))), "blocks")
    with setting(queries.sparkSession, "spark.sql.requireAllClusterKeysForCoPartition", "false"):
        return cut(top_k(_scores(rest, weighed, opened, least), k), "ranked")
