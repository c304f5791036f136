"""Evaluation of retrieval over labelled cases: parsing, validation, scores, metrics and calibration."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import casefold, is_safe_abstention, rewrite_query, strip
from lodestrand.operators.filters import FILTER_KEYS, matches_filter, normalize_filters
from lodestrand.operators.lexical import bm25_search, build_postings
from lodestrand.operators.nearest import vector_search
from lodestrand.operators.qa import KNOWLEDGE, grade, outcome, trace_events, verify
from lodestrand.operators.retrieval import NO_ANSWER, answer, as_hits, channels, open_vectors, pins_of, rrf_fuse, unusable_vector
from lodestrand.session import cut

TASKS = ("retrieval", "metadata", "agentic")
SPLITS = ("dev", "test")
DIFFICULTIES = ("easy", "medium", "hard")
CASE = """id string, schema_version string, task string, split string, query string,
request struct<top_k:int, filters:map<string,string>>,
expected struct<answerable:boolean, relevant_document_ids:array<string>, relevant_chunk_ids:array<string>, domain:string, category:string,
  required_facts:array<string>, forbidden_facts:array<string>>,
tags array<string>, difficulty string, review_status string, retrieval_expectation string,
agentic struct<rewrite_expected:string, rewritten_query_contains:array<string>, grade_expected:string, verification_expected:string,
  max_retrieval_attempts:int, required_events:array<string>, forbidden_tools:array<string>>"""
KEYS = ("id", "schema_version", "task", "split", "query", "request", "expected", "tags", "difficulty", "review_status", "retrieval_expectation", "agentic")


def expectation(answerable: Column, tags: Column) -> Column:
    """hit, no_hit or topic_hit_allowed, from the label and the tags."""
    return F.when(answerable, "hit").when(F.array_contains(tags, "retrieval_no_hit"), "no_hit").otherwise("topic_hit_allowed")


def parse_cases(lines: DataFrame) -> DataFrame:
    """Cases of JSON ``(source_file, source_line, json)`` with ``error``: the first strict rule that a line breaks."""
    raw = F.from_json("json", CASE)
    keys = F.json_object_keys("json")
    rows = lines.select("source_file", "source_line", "json", raw.alias("case"), keys.alias("keys")).select("*", "case.*").drop("case")
    derived = expectation(F.col("expected.answerable"), F.coalesce("tags", F.array().cast("array<string>")))
    uneven = lambda a: F.coalesce((F.size(a) != F.size(F.array_distinct(a))) | F.exists(a, lambda x: strip(x) == ""), F.lit(False))
    lists = reduce(lambda a, b: a | b, (uneven(F.col(c)) for c in ("tags", "expected.relevant_document_ids", "expected.relevant_chunk_ids", "expected.required_facts", "expected.forbidden_facts")))
    blank = reduce(lambda a, b: a | b, (strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in ("id", "query")))
    inside = lambda c, values: F.coalesce(F.col(c).isin(*values), F.lit(False))
    error = (
        F.when(F.col("keys").isNull(), "not_an_object")
        .when(F.size(F.array_except("keys", F.array(*map(F.lit, KEYS)))) > 0, "unknown_key")
        .when(blank, "blank_field")
        .when(~inside("task", TASKS) | ~inside("split", SPLITS) | ~inside("difficulty", DIFFICULTIES), "bad_choice")
        .when(~F.coalesce(F.col("request.top_k").between(1, 20), F.lit(False)), "bad_top_k")
        .when(F.col("expected.answerable").isNull(), "bad_expected")
        .when(lists, "bad_list")
        .when((F.col("task") == "agentic") != F.col("agentic").isNotNull(), "agentic_mismatch")
        .when(F.col("retrieval_expectation").isNotNull() & (F.col("retrieval_expectation") != derived), "expectation_mismatch")
    )
    return rows.select(*(c for c in rows.columns if c not in ("json", "keys", "retrieval_expectation")), derived.alias("retrieval_expectation"), error.alias("error"))


#: What validation needs to know of a labelled chunk.
_TRUTH = ("chunk_id", "title", "content", *FILTER_KEYS)


def _labelled(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(id, source_file, source_line, labels)``: the chunk and document labels of each case with what the corpus has of them.

    Chunks are read once; each gives its own key and its document's, and only keys that some label names go on.
    """
    place = ["id", "source_file", "source_line"]
    keys = F.concat(F.transform("chunks", lambda x: F.concat(F.lit("c:"), x)), F.transform("docs", lambda x: F.concat(F.lit("d:"), x)))
    labels = cases.select(*place, F.posexplode(keys).alias("at", "key"))
    truth = F.struct(*_TRUTH)
    own = F.array(F.struct(F.concat(F.lit("c:"), "chunk_id").alias("key"), truth.alias("truth")), F.struct(F.concat(F.lit("d:"), "document_id").alias("key"), F.lit(None).alias("truth")))
    named = chunks.select(*_TRUTH).select(F.inline(own)).join(labels.select("key").distinct(), "key", "left_semi")
    known = named.groupBy("key").agg(F.first("truth", ignorenulls=True).alias("truth"), F.lit(True).alias("found"))
    row = F.struct("at", F.substring("key", 1, 1).alias("kind"), F.expr("substring(key, 3)").alias("name"), F.coalesce("found", F.lit(False)).alias("found"), "truth")
    return labels.join(known, "key", "left").groupBy(*place).agg(F.array_sort(F.collect_list(row), lambda x, y: x["at"] - y["at"]).alias("labels"))


def validate_cases(cases: DataFrame, chunks: DataFrame) -> DataFrame:
    """Issues ``(case_id, message, source_file, source_line)`` of parsed cases against the corpus.

    Labels meet the corpus in one join; then every rule is an expression over the case's own row and gives an
    array of messages. Cases and chunks are read once each.
    """
    none = F.array().cast("array<string>")
    no_filters = F.create_map().cast("map<string,string>")
    e = cases.select(
        "id", "task", "query", "agentic", F.coalesce("tags", none).alias("tags"), "source_file", "source_line",
        F.coalesce("request.filters", no_filters).alias("filters"), "expected.answerable", "expected.domain", "expected.category",
        F.coalesce("expected.relevant_chunk_ids", none).alias("chunks"), F.coalesce("expected.relevant_document_ids", none).alias("docs"),
        F.coalesce("expected.required_facts", none).alias("required"), F.coalesce("expected.forbidden_facts", none).alias("forbidden"),
    ).withColumn("nf", normalize_filters(F.col("filters")))
    e = cut(e, "cases")
    again = lambda *keys: F.row_number().over(W.partitionBy(*keys).orderBy("source_file", "source_line")) > 1
    numbered = e.withColumn("fkey", F.to_json(F.array_sort(F.map_entries("filters")))).withColumn("qkey", casefold(F.col("query")))
    marked = numbered.withColumns({"same_id": again("id"), "same_query": again("qkey", "fkey")})
    place = ["id", "source_file", "source_line"]
    rows = marked.join(_labelled(e, chunks), place, "left")
    labels = F.coalesce("labels", F.filter("labels", lambda x: F.lit(False)))
    known = F.filter(labels, lambda x: (x["kind"] == "c") & x["found"])
    rows = rows.withColumns({"known": known, "evidence": casefold(F.array_join(F.transform(known, lambda x: F.concat_ws("\n", x["truth"]["title"], x["truth"]["content"])), "\n"))})
    asked = F.coalesce("nf.filters", no_filters)

    def passes(x: Column) -> Column:
        own = lambda k: F.element_at(asked, k)
        return reduce(lambda a, b: a & b, (own(k).isNull() | (own(k) == x["truth"][k]) for k in FILTER_KEYS[:-1]), F.coalesce(own("visibility"), F.lit("public")) == x["truth"]["visibility"])

    def each(items: Column, name: str, value=lambda x: x) -> Column:
        return F.coalesce(F.transform(items, lambda x: F.concat(F.lit(name), value(x))), none)

    one = lambda cond, message: F.when(F.coalesce(cond, F.lit(False)), F.array(F.lit(message) if isinstance(message, str) else message)).otherwise(none)
    name = lambda x: x["name"]
    lost = lambda kind: F.filter(labels, lambda x: (x["kind"] == kind) & ~x["found"])
    differs = lambda key: F.filter("known", lambda x: (F.col(key) != "") & (F.col(key) != x["truth"][key]))
    modes = F.size(F.array_intersect("tags", F.array(F.lit("retrieval_no_hit"), F.lit("missing_fact"))))
    both = F.array_intersect(F.transform("required", casefold), F.transform("forbidden", casefold))
    answerable, agentic = F.col("answerable"), F.col("task") == "agentic"
    rules = [
        one(F.col("same_id"), "duplicate_id"),
        one(F.col("same_query"), "duplicate_query"),
        one(answerable & (F.size("chunks") == 0), "no_relevant_chunks"),
        one(answerable & (F.size("docs") == 0), "no_relevant_documents"),
        one(~answerable & ((F.size("chunks") > 0) | (F.size("docs") > 0)), "labels_on_unanswerable"),
        one(~answerable & (modes != 1), "negative_mode"),
        each(lost("c"), "unknown_chunk:", name),
        each(lost("d"), "unknown_document:", name),
        one(F.exists("known", lambda x: ~F.array_contains("docs", x["truth"]["document_id"])), "chunk_document_mismatch"),
        one(F.col("nf.error").isNotNull(), F.concat(F.lit("bad_filter:"), "nf.error")),
        each(F.filter("known", lambda x: ~passes(x)), "filtered_out:", name),
        each(differs("domain"), "domain_mismatch:", name),
        each(differs("category"), "category_mismatch:", name),
        each(F.filter("required", lambda f: (F.size("known") == 0) | ~F.col("evidence").contains(casefold(f))), "fact_not_in_truth:"),
        one(F.size(both) > 0, F.concat(F.lit("fact_conflict:"), F.array_join(F.array_sort(both), ","))),
        one(F.size("tags") == 0, "no_tags"),
        one(agentic & (F.col("agentic.rewrite_expected") == "false") & (F.size("agentic.rewritten_query_contains") > 0), "rewrite_terms_unexpected"),
        one(agentic & (F.col("agentic.max_retrieval_attempts") > 2), "too_many_attempts"),
    ]
    return rows.select(F.col("id").alias("case_id"), F.explode(F.flatten(F.array(*rules))).alias("message"), "source_file", "source_line")


def score_cases(cases: DataFrame, hits: DataFrame, chunks: DataFrame, answers: DataFrame, filters: DataFrame, k: int = 3) -> DataFrame:
    """Case results per strategy: retrieved ids cut at top_k, facts found, leakage, abstention and failures.

    ``cases (case_id, task, split, query, tags, difficulty, top_k, filter_id, answerable, expected_domain,
    expected_chunk_ids, expected_document_ids, required_facts, forbidden_facts)``; ``hits (strategy, case_id,
    chunk_id, rank, duration_ms)``; ``answers (strategy, case_id, answer)``.
    """
    flt = filters.select("filter_id", *(F.col(c).alias(f"f_{c}") for c in FILTER_KEYS))
    cut = (
        hits.join(cases.select("case_id", "top_k", "filter_id"), "case_id").where("rank <= top_k")
        .join(chunks.select("chunk_id", "title", "content", "source", *FILTER_KEYS), "chunk_id").join(flt, "filter_id", "left")
    )
    row = F.struct("rank", "chunk_id", "document_id", "source", F.concat_ws("\n", "title", "content").alias("text"), (~matches_filter()).alias("leak"))
    found = cut.groupBy("strategy", "case_id").agg(F.array_sort(F.collect_list(row)).alias("r"))
    grid = answers.select("strategy", "case_id", "answer", "duration_ms").join(cases, "case_id").join(found, ["strategy", "case_id"], "left")
    col = lambda name: F.transform(F.col("r"), lambda x: x[name])
    none = F.array().cast("array<string>")
    kind = expectation(F.col("answerable"), F.col("tags"))
    base = grid.select(
        "strategy", "case_id", "task", "split", "query", "tags", "difficulty", "expected_domain", "answerable", kind.alias("retrieval_expectation"),
        "expected_chunk_ids", "expected_document_ids", "required_facts", "forbidden_facts", "duration_ms",
        F.when(~F.col("answerable"), F.col("answer")).otherwise("").alias("generated_answer"),
        F.coalesce(col("chunk_id"), none).alias("retrieved_chunk_ids"), F.coalesce(col("document_id"), none).alias("retrieved_document_ids"),
        F.coalesce(col("source"), none).alias("retrieved_sources"), casefold(F.coalesce(F.array_join(col("text"), "\n"), F.lit(""))).alias("evidence"),
        F.coalesce(F.size(F.filter(F.col("r"), lambda x: x["leak"])), F.lit(0)).alias("filter_leakage_count"),
    )
    searched = F.when(F.col("answerable"), F.col("evidence")).otherwise(casefold(F.col("generated_answer")))
    facts = base.select(
        "*", F.size("required_facts").alias("required_fact_total"),
        F.size(F.filter("required_facts", lambda f: F.col("evidence").contains(casefold(f)))).alias("required_fact_matches"),
        F.filter("forbidden_facts", lambda f: searched.contains(casefold(f))).alias("forbidden_fact_violations"),
        F.when(kind_is("hit"), F.lit(None)).otherwise(is_safe_abstention(F.col("generated_answer"), F.col("forbidden_facts"))).alias("safe_abstained"),
    )
    fail = lambda cond, name: F.when(F.coalesce(cond, F.lit(False)), F.lit(name))
    failures = F.array_compact(
        F.array(
            fail(kind_is("hit") & ~F.arrays_overlap("expected_chunk_ids", F.slice("retrieved_chunk_ids", 1, k)), f"not_in_top_{k}"),
            fail(kind_is("hit") & (F.col("required_fact_matches") < F.col("required_fact_total")), "facts_missing"),
            fail(kind_is("no_hit") & (F.size("retrieved_chunk_ids") > 0), "unexpected_hit"),
            fail(kind_is("topic_hit_allowed") & ~F.col("safe_abstained"), "no_safe_abstention"),
            fail(F.col("filter_leakage_count") > 0, "leakage"),
            fail(F.size("forbidden_fact_violations") > 0, "forbidden_fact"),
        )
    )
    return facts.withColumn("failures", failures).drop("evidence", "required_facts", "forbidden_facts")


def kind_is(name: str) -> Column:
    return F.col("retrieval_expectation") == name


def score_agentic(results: DataFrame, expected: DataFrame, passes: DataFrame) -> DataFrame:
    """Adds the agentic checks to case results and their failures; cases without expectations keep nulls.

    ``expected (case_id, rewrite_expected, rewritten_query_contains, grade_expected, verification_expected,
    max_retrieval_attempts, required_events)`` with rewrite_expected true, false, null or
    if_initial_insufficient; ``passes (strategy, case_id, final_query, rewritten, initial_status, status,
    verification, attempts, events)``.
    """
    joined = results.join(expected, "case_id", "left").join(passes, ["strategy", "case_id"], "left")
    own = F.col("max_retrieval_attempts").isNotNull()
    policy = F.when(F.col("rewrite_expected") == "true", "always").when(F.col("rewrite_expected") == "false", "never").otherwise(F.col("rewrite_expected"))
    resolved = (
        F.when(F.col("rewrite_expected") == "if_initial_insufficient", F.col("initial_status") == "insufficient")
        .when(F.col("rewrite_expected").isin("true", "false"), F.col("rewrite_expected") == "true")
    )
    marked = joined.withColumns({"rewrite_policy": policy, "_resolved": F.when(own, resolved)})
    gone = F.filter("rewritten_query_contains", lambda t: ~casefold(F.col("final_query")).contains(casefold(t)))
    lost = F.array_except("required_events", "events")
    fail = lambda cond, name: F.when(F.coalesce(own & cond, F.lit(False)), F.lit(name))
    more = F.array_compact(
        F.array(
            fail(F.col("_resolved").isNotNull() & (F.col("rewritten") != F.col("_resolved")), "rewrite"),
            fail(F.col("_resolved") & (F.size(gone) > 0), "rewrite_terms"),
            fail((F.col("grade_expected") != "") & (F.col("status") != F.col("grade_expected")), "grade"),
            fail((F.col("verification_expected") != "") & (F.col("verification") != F.col("verification_expected")), "verification"),
            fail(F.col("attempts") > F.col("max_retrieval_attempts"), "attempts"),
            fail(F.size(lost) > 0, "trace"),
        )
    )
    keep = [c for c in results.columns if c != "failures"]
    return marked.select(
        *keep, "rewrite_policy", F.col("_resolved").alias("rewrite_expected"), F.when(own, F.col("rewritten")).alias("rewrite_actual"),
        "grade_expected", F.when(own, F.col("status")).alias("grade_actual"), "verification_expected", F.when(own, F.col("verification")).alias("verification_actual"),
        F.when(own, F.size(lost) == 0).alias("trace_conformant"), F.concat("failures", more).alias("failures"),
    )


def metric_columns(k: int = 3) -> list[Column]:
    """Aggregates of case results; a ratio without cases is null."""
    c, hit = F.col, kind_is("hit")
    at_k = F.slice("retrieved_chunk_ids", 1, k)
    ranks = F.transform(at_k, lambda x, i: F.when(F.array_contains("expected_chunk_ids", x), i + 1))
    first = F.array_min(ranks)
    total = lambda cond, value=None: F.sum(F.when(cond, F.lit(1) if value is None else value))
    ratio = lambda a, b: F.try_divide(F.coalesce(a, F.lit(0)).cast("double"), b.cast("double"))
    agree = lambda a, b: ratio(total(c(a) == c(b)), total(c(b).isNotNull()))
    return [
        F.count("*").alias("cases"),
        F.count_if(hit).alias("positive_cases"),
        F.count_if(~hit).alias("negative_cases"),
        F.count_if(kind_is("no_hit")).alias("retrieval_no_hit_cases"),
        F.count_if(kind_is("topic_hit_allowed")).alias("hard_negative_cases"),
        F.count_if(F.size("failures") == 0).alias("passed_cases"),
        F.count_if(F.size("failures") > 0).alias("failed_cases"),
        ratio(total(hit & (first == 1)), total(hit)).alias("hit_at_1"),
        ratio(total(hit & first.isNotNull()), total(hit)).alias(f"hit_at_{k}"),
        ratio(total(hit & F.arrays_overlap("expected_document_ids", F.slice("retrieved_document_ids", 1, k))), total(hit)).alias(f"document_hit_at_{k}"),
        ratio(total(hit, F.size(F.array_intersect("expected_chunk_ids", at_k))), total(hit, F.size(F.array_distinct("expected_chunk_ids")))).alias(f"recall_at_{k}"),
        ratio(F.sum(F.when(hit & first.isNotNull(), 1 / first)), total(hit)).alias(f"mrr_at_{k}"),
        ratio(total(kind_is("no_hit") & (F.size("retrieved_chunk_ids") == 0)), total(kind_is("no_hit"))).alias("no_hit_accuracy"),
        ratio(total(kind_is("no_hit") & (F.size("retrieved_chunk_ids") > 0)), total(kind_is("no_hit"))).alias("false_positive_rate"),
        ratio(total(kind_is("topic_hit_allowed") & c("safe_abstained")), total(kind_is("topic_hit_allowed"))).alias("hard_negative_safe_abstention_rate"),
        ratio(F.sum("required_fact_matches"), F.nullif(F.sum("required_fact_total"), F.lit(0))).alias("required_fact_coverage"),
        F.sum(F.size("forbidden_fact_violations")).alias("forbidden_fact_violations"),
        ratio(F.sum("filter_leakage_count"), F.nullif(F.sum(F.size("retrieved_chunk_ids")), F.lit(0))).alias("filter_leakage_rate"),
        agree("rewrite_actual", "rewrite_expected").alias("rewrite_accuracy"),
        agree("grade_actual", "grade_expected").alias("grade_accuracy"),
        agree("verification_actual", "verification_expected").alias("verification_accuracy"),
        ratio(total(c("trace_conformant")), total(c("trace_conformant").isNotNull())).alias("trace_conformance"),
        *latency_quantiles("duration_ms"),
    ]


OPTIONAL = {"rewrite_actual": "boolean", "rewrite_expected": "boolean", "grade_actual": "string", "grade_expected": "string", "verification_actual": "string", "verification_expected": "string", "trace_conformant": "boolean"}


def _complete(results: DataFrame) -> DataFrame:
    return results.withColumns({n: F.lit(None).cast(t) for n, t in OPTIONAL.items() if n not in results.columns})


def aggregate_metrics(results: DataFrame, k: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    return _complete(results).groupBy(*by).agg(*metric_columns(k))


def latency_quantiles(column: str) -> list[Column]:
    """Exact median and interpolated 95th percentile, at three digits."""
    return [F.round(F.percentile(column, F.lit(p)), 3).alias(f"latency_ms_{n}") for n, p in (("p50", 0.5), ("p95", 0.95))]


def summarize(results: DataFrame, k: int = 3) -> DataFrame:
    """Metrics per strategy: overall, by split, task, domain and difficulty in one pass of grouping sets, and by tag."""
    rows = _complete(results).select("*", F.col("expected_domain").alias("domain"))
    scopes = ["split", "task", "domain", "difficulty"]
    own = [F.col("strategy"), *map(F.col, scopes)]
    sets = [["strategy"], *(["strategy", s] for s in scopes)]
    grouped = rows.groupingSets([[F.col(c) for c in s] for s in sets], *own).agg(*metric_columns(k), F.grouping_id().alias("gid"))
    bits = {s: 1 << (len(scopes) - 1 - i) for i, s in enumerate(scopes)}
    everything = sum(bits.values())
    scope, value = F.lit("overall"), F.lit("")
    for s in scopes:
        at = F.col("gid") == everything - bits[s]
        scope, value = F.when(at, f"by_{s}").otherwise(scope), F.when(at, F.col(s)).otherwise(value)
    first = grouped.withColumns({"scope": scope, "value": value}).where("value is not null").drop("gid", *scopes)
    tags = rows.withColumn("value", F.explode(F.array_distinct("tags"))).groupBy("strategy", "value").agg(*metric_columns(k)).withColumn("scope", F.lit("by_tag"))
    return first.unionByName(tags)


def dataset_profile(cases: DataFrame, columns: tuple[str, ...] = ("task", "split", "difficulty", "answerable", "retrieval_expectation")) -> DataFrame:
    """``(column, value, n)`` counts over several columns in one pass."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns)))
    return cases.select(pairs.alias("p")).groupBy("p.column", "p.value").agg(F.count("*").alias("n"))


def fingerprint(df: DataFrame, key: str) -> DataFrame:
    """One row ``(n, fingerprint)`` that depends on the rows' content and not on their order.

    The fingerprint is the hash of the number of rows and of four sums over 60 bits each of the rows'
    hashes. Sums are taken before the shuffle, so a task sends one row however the keys are spread.
    """
    row = F.sha2(F.to_json(F.struct(key, *sorted(c for c in df.columns if c != key))), 256)
    parts = [F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)").alias(f"s{i}") for i in range(4)]
    sums = df.select(row.alias("h")).select(*parts).agg(F.count("*").alias("n"), *(F.coalesce(F.sum(f"s{i}"), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)))
    return sums.select("n", F.sha2(F.concat_ws(",", F.col("n").cast("string"), *(f"s{i}" for i in range(4))), 256).alias("fingerprint"))


def threshold_sweep(cases: DataFrame, queries: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, vectors: DataFrame, thresholds: list[float], k: int = 3, split: str = "dev") -> DataFrame:
    """Metrics ``(threshold, strategy, ...)`` of vector and hybrid search at every least similarity, over one split.

    One BM25 search and one vector search at the lowest threshold serve all: a higher threshold only cuts
    the end of a ranked vector list, and fusion is done anew on what is left. The threshold travels inside
    the query id and the strategy, so all of them are one plan, whatever their number.
    """
    chosen = cases.where(F.col("split") == split)
    asked = cut(queries.join(chosen.select(F.col("case_id").alias("query_id")), "query_id", "left_semi"), "asked")
    lexical, near, pins = channels(asked, chunks, postings, filters, vectors, max(20, 4 * k), min(thresholds))
    grid = F.explode(F.array(*map(F.lit, thresholds))).alias("threshold")
    spread = lambda df: df.select("*", grid).withColumn("query_id", F.struct("threshold", "query_id")).drop("threshold")
    kept = cut(spread(near).where(F.col("score") >= F.col("query_id.threshold")), "near")
    ranked = {"vector": kept, "hybrid": cut(rrf_fuse(spread(lexical), kept, k, pins=spread(pins)), "fused")}
    at, case = F.col("query_id.threshold").alias("threshold"), F.col("query_id.query_id").alias("case_id")
    own = lambda name: F.struct(at, F.lit(name).alias("strategy")).alias("strategy")
    hits = reduce(DataFrame.unionByName, (r.select(own(n), case, "chunk_id", "rank") for n, r in ranked.items()))
    answers = reduce(DataFrame.unionByName, (answer(spread(asked), r, chunks).select(own(n), case, "answer", F.lit(None).cast("double").alias("duration_ms")) for n, r in ranked.items()))
    return aggregate_metrics(score_cases(chosen, hits, chunks, answers, filters, k), k, ("strategy",)).withColumnRenamed("strategy", "own").select("own.*", "*").drop("own")


def recommend_threshold(rows: DataFrame, gate: float = 0.9) -> DataFrame:
    """``(recommended_threshold, production_gate_passed, mode)``: the best threshold of hybrid rows.

    Rows that reach the gate are ranked by hit@3, hit@1, no-hit accuracy, low false positives and the higher
    threshold; if none does, all are ranked with no-hit accuracy and false positives first.
    """
    value = lambda name, default=-1.0: F.coalesce(F.col(name), F.lit(default))
    passed = value("no_hit_accuracy") >= gate
    low = -value("false_positive_rate", 1.0)
    safe = F.struct(value("hit_at_3"), value("hit_at_1"), value("no_hit_accuracy"), low, "threshold")
    rest = F.struct(value("no_hit_accuracy"), low, value("hit_at_3"), value("hit_at_1"), "threshold")
    best = rows.where("strategy = 'hybrid'").agg(
        F.max_by("threshold", F.when(passed, safe)).alias("a"), F.max_by("threshold", rest).alias("b"), F.coalesce(F.bool_or(passed), F.lit(False)).alias("production_gate_passed")
    )
    return best.select(
        F.when(F.col("production_gate_passed"), F.col("a")).otherwise(F.col("b")).alias("recommended_threshold"), "production_gate_passed",
        F.when(F.col("production_gate_passed"), "meets_safety_gate").otherwise("best_observed_gate_not_met").alias("mode"),
    )


def strategy_table(summary: DataFrame, metric: str = "hit_at_1") -> DataFrame:
    """``(scope, value, bm25, vector, hybrid)`` of one metric, strategies side by side."""
    return summary.groupBy("scope", "value").pivot("strategy", ["bm25", "vector", "hybrid"]).agg(F.first(metric))


def usage_rollup(calls: DataFrame) -> DataFrame:
    """Per planner: calls, attempts (calls and retries), successes, failures, tokens and latency; bad token counts are 0."""
    tokens = lambda c: F.sum(F.greatest(F.coalesce(F.expr(f"try_cast({c} as bigint)"), F.lit(0)), F.lit(0)))
    return calls.groupBy("planner").agg(
        F.count("*").alias("calls"), (F.count("*") + F.sum(F.coalesce("retries", F.lit(0)))).alias("attempts"), F.count_if("ok").alias("successes"),
        F.count_if(~F.col("ok")).alias("failures"), tokens("prompt_tokens").alias("prompt_tokens"), tokens("completion_tokens").alias("completion_tokens"),
        tokens("total_tokens").alias("total_tokens"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"),
    )


STRATEGIES = ("bm25", "vector", "hybrid")


def _timed(df: DataFrame, name: str) -> tuple[DataFrame, float]:
    """``df`` written to the shared folder, and the milliseconds that took."""
    start = time.perf_counter()
    return cut(df, name), 1000 * (time.perf_counter() - start)


def _asked(cases: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Queries of cases with ``fetch``, how many hits the case needs, and ``own``, how deep its ranked lists go."""
    depth = cases.select(F.col("case_id").alias("query_id"), F.greatest("top_k", F.lit(k)).alias("fetch"))
    return queries.join(depth, "query_id").withColumn("own", F.greatest(F.lit(20), 4 * F.col("fetch")))


def search_strategies(asked: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, vectors: DataFrame | None, strategies: tuple[str, ...], least: float, dim: int) -> tuple[DataFrame, dict[str, float], DataFrame]:
    """Hits ``(strategy, query_id, chunk_id, rank, lexical_score, vector_score)``, the milliseconds each strategy's searches took, and the chunks that were found.

    Each channel is searched once, as deep as the deepest query needs, and serves all strategies; every query then takes
    its own depth of the lists. Queries without a usable vector fall back to BM25.
    """
    deep = asked.agg(F.max("own")).first()[0] or 20
    usable = ~unusable_vector(F.col("vector"), dim) if vectors is not None and "vector" in asked.columns else F.lit(False)
    good, bad = asked.where(usable), asked.where(~usable).select("query_id")
    within = lambda ranked, name: ranked.join(asked.select("query_id", name), "query_id").where(F.col("rank") <= F.col(name)).drop(name)
    lexical, lexical_ms = _timed(bm25_search(asked, chunks, postings, filters, deep), "lexical")
    plain = as_hits(within(lexical, "fetch"), "bm25")
    fallback = plain.join(bad, "query_id", "left_semi")
    found, near = [lexical.select("chunk_id")], None
    if vectors is not None and {"vector", "hybrid"} & set(strategies):
        near, near_ms = _timed(vector_search(good, open_vectors(vectors, chunks, filters), deep, least), "near")
        found.append(near.select("chunk_id"))
    # texts are looked up once; whatever reads them later reads few
    texts = cut(chunks.join(reduce(DataFrame.union, found).distinct(), "chunk_id", "left_semi"), "found")
    ranked, spent = {"bm25": plain, "vector": fallback, "hybrid": fallback}, dict.fromkeys(STRATEGIES, lexical_ms)
    if near is not None:
        ranked["vector"], spent["vector"] = as_hits(within(near, "fetch"), "vector").unionByName(fallback), near_ms
        if "hybrid" in strategies:
            words, alike = within(lexical, "own").join(good.select("query_id"), "query_id", "left_semi"), within(near, "own")
            fused, fused_ms = _timed(rrf_fuse(words, alike, deep, pins=pins_of(good, texts, words, alike)), "fused")
            ranked["hybrid"], spent["hybrid"] = within(fused, "fetch").unionByName(fallback), lexical_ms + near_ms + fused_ms
    columns = ("query_id", "chunk_id", "rank", "lexical_score", "vector_score")
    return cut(reduce(DataFrame.unionByName, (ranked[s].select(F.lit(s).alias("strategy"), *columns) for s in strategies)), "hits"), spent, texts


def _scored(cases: DataFrame, asked: DataFrame, hits: DataFrame, final: DataFrame, spent: dict[str, float], chunks: DataFrame, filters: DataFrame, k: int) -> DataFrame:
    """Case results of ``final`` hits; answers are those of the first search."""
    n = max(cases.count(), 1)
    told = lambda s: answer(asked, hits.where(F.col("strategy") == s), chunks).select(F.lit(s).alias("strategy"), F.col("query_id").alias("case_id"), "answer", F.lit(spent[s] / n).alias("duration_ms"))
    answers = reduce(DataFrame.unionByName, map(told, spent))
    return score_cases(cases, final.select("strategy", F.col("query_id").alias("case_id"), "chunk_id", "rank"), chunks, answers, filters, k)


def run_evaluation(cases: DataFrame, queries: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, vectors: DataFrame | None, strategies: tuple[str, ...] = STRATEGIES, k: int = 3, split: str | None = None, least: float = 0.22, dim: int = 512) -> DataFrame:
    """Case results of every strategy and case.

    ``duration_ms`` is the measured time of the searches that a strategy rests on, in equal shares of the cases.
    """
    chosen = cut(cases.where(F.col("split") == split) if split else cases, "cases")
    asked = cut(_asked(chosen, queries, k), "asked")
    hits, spent, texts = search_strategies(asked, chunks, postings, filters, vectors, strategies, least, dim)
    return _scored(chosen, asked, hits, hits, {s: spent[s] for s in strategies}, texts, filters, k)


def agentic_passes(asked: DataFrame, hits: DataFrame, chunks: DataFrame, strategies: tuple[str, ...], again: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Final hits of agentic cases after at most two passes of each strategy, and how they went.

    Queries whose hits a strategy grades insufficient are rewritten; those that this changes are searched once more,
    by ``again``, all at once. The passes are ``(strategy, case_id, final_query, rewritten, initial_status, status,
    verification, attempts, events)``; the answer that is verified is the best hit's text.
    """
    by = lambda df: df.withColumn("query_id", F.struct("strategy", "query_id"))
    apart = lambda df: df.withColumn("strategy", F.col("query_id.strategy")).withColumn("query_id", F.col("query_id.query_id"))
    keyed = cut(by(asked.select("query_id", "query", F.explode(F.array(*map(F.lit, strategies))).alias("strategy"))), "agentic")
    first = by(hits.join(asked.select("query_id"), "query_id", "left_semi"))
    graded = cut(keyed.join(grade(keyed, first, chunks), "query_id").withColumnRenamed("status", "initial_status"), "graded")
    tried = cut(graded.where("initial_status = 'insufficient'").withColumn("new", rewrite_query(F.col("query"))), "rewritten")
    changed = tried.where("new.changed").select("query_id", F.col("new.query").alias("query"))
    once = apart(changed).select("query_id", "query").distinct().join(asked.drop("query", "vector"), "query_id")
    second = cut(by(again(once)).join(changed.select("query_id"), "query_id", "left_semi"), "second-pass")
    final = cut(first.join(changed.select("query_id"), "query_id", "left_anti").unionByName(second), "final")
    late = grade(changed, second, chunks).select("query_id", F.col("status").alias("second"))
    went = graded.join(changed.withColumnRenamed("query", "final_query"), "query_id", "left").join(late, "query_id", "left").select(
        "query_id", F.coalesce("final_query", "query").alias("final_query"), F.col("final_query").isNotNull().alias("rewritten"), "initial_status",
        F.coalesce("second", "initial_status").alias("status"), F.when(F.col("final_query").isNotNull(), 2).otherwise(1).alias("attempts"),
    )
    texts = final.join(chunks.select("chunk_id", "title", "content"), "chunk_id")
    best = texts.where("rank = 1").select("query_id", "chunk_id", F.concat("title", F.lit("："), "content").alias("answer"))
    answers = went.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("answer", F.lit(NO_ANSWER.split("，")[0] + "。")).alias("answer"))
    found = texts.groupBy("query_id").agg(F.collect_list(F.struct("chunk_id", "content")).alias("hits"))
    results = answers.join(found, "query_id", "left").select("query_id", F.lit(KNOWLEDGE).alias("tool_name"), F.lit(True).alias("ok"), F.col("answer").alias("output"), "hits")
    verdict = verify(answers, results, best.select("query_id", "chunk_id")).select("query_id", outcome(F.col("status")).alias("verification"))
    whole = cut(went.join(verdict, "query_id").join(trace_events(went).select("query_id", "events"), "query_id"), "passes")
    return apart(final), apart(whole).withColumnRenamed("query_id", "case_id")


def case_rows(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases in the flat shape that scoring takes, and the distinct filters ``(filter_id, ...)`` that they ask for."""
    none = F.array().cast("array<string>")
    no_filters = F.create_map().cast("map<string,string>")
    asked = F.coalesce(normalize_filters(F.coalesce("request.filters", no_filters))["filters"], no_filters)
    rows = parsed.withColumn("_f", F.struct(*(F.element_at(asked, k).alias(k) for k in FILTER_KEYS))).withColumn("filter_id", F.sha2(F.to_json("_f"), 256))
    flat = rows.select(
        F.col("id").alias("case_id"), "task", "split", "query", F.coalesce("tags", none).alias("tags"), "difficulty", "request.top_k", "filter_id", "expected.answerable",
        F.col("expected.domain").alias("expected_domain"), F.coalesce("expected.relevant_chunk_ids", none).alias("expected_chunk_ids"),
        F.coalesce("expected.relevant_document_ids", none).alias("expected_document_ids"), F.coalesce("expected.required_facts", none).alias("required_facts"),
        F.coalesce("expected.forbidden_facts", none).alias("forbidden_facts"),
    )
    return flat, rows.select("filter_id", "_f.*").distinct()


class EvaluationRun(NamedTuple):
    """What a run gives: case results, their summary, and the configuration with the fingerprints of what went in."""

    results: DataFrame
    summary: DataFrame
    configuration: dict


def evaluate(parsed: DataFrame, chunks: DataFrame, embed: Callable[[Column], Column] | None, dim: int, model: str, strategies: tuple[str, ...] = STRATEGIES, split: str | None = None, k: int = 3, validate: bool = True, least: float = 0.22) -> EvaluationRun:
    """Validate parsed cases, run every strategy over them and sum up; agentic cases go in two passes.

    Unknown strategies, no cases, cases that break a parsing rule and, unless ``validate`` is false, cases that do not fit
    the corpus are errors that name the first few.
    """
    wanted = tuple(dict.fromkeys(strategies))
    if not wanted or set(wanted) - set(STRATEGIES):
        raise ValueError(f"strategies are {STRATEGIES}, not {strategies}")
    if k < 1:
        raise ValueError("k is 1 at least")
    chosen = cut(parsed.where(F.col("split") == split) if split else parsed, "parsed")
    if chosen.isEmpty():
        raise ValueError("no case is left to run")
    broken = chosen.where("error is not null").select(F.col("id").alias("case_id"), F.col("error").alias("message"), "source_file", "source_line")
    issues = broken.unionByName(validate_cases(chosen, chunks)) if validate else broken
    first = issues.orderBy("source_file", "source_line", "message").limit(5).collect()
    if first:
        raise ValueError("; ".join(f"{r.source_file}:{r.source_line}: {r.case_id}: {r.message}" for r in first))
    cases, filters = case_rows(chosen)
    cases, chunks = cut(cases, "cases"), cut(chunks, "chunks")
    with_vector = lambda df: df if embed is None else df.withColumn("vector", embed(F.col("query")))
    vectors = None if embed is None else cut(chunks.select("chunk_id", embed(F.concat_ws("\n", "title", "title", "content")).alias("vector")), "vectors")
    postings, filters = cut(build_postings(chunks), "postings"), cut(filters, "filters")
    search = lambda df: search_strategies(df, chunks, postings, filters, vectors, wanted, least, dim)
    asked = cut(with_vector(_asked(cases, cases.select(F.col("case_id").alias("query_id"), "query", "filter_id"), k)), "asked")
    hits, spent, _ = search(asked)
    spent = {s: spent[s] for s in wanted}
    own = chosen.where("task = 'agentic'").select(F.col("id").alias("case_id"), "agentic.*")
    if own.isEmpty():
        results = _scored(cases, asked, hits, hits, spent, chunks, filters, k)
    else:
        agents = own.select(F.col("case_id").alias("query_id"))
        final, passes = agentic_passes(asked.join(agents, "query_id", "left_semi"), hits, chunks, wanted, lambda df: search(cut(with_vector(df), "again"))[0])
        final = hits.join(agents, "query_id", "left_anti").unionByName(final)
        results = score_agentic(_scored(cases, asked, hits, final, spent, chunks, filters, k), own, passes)
    results = cut(results, "results")
    mark = lambda df, key: fingerprint(df, key).first()["fingerprint"]
    settings = {
        "evaluation": {"metric_k": k, "strategies": list(wanted), "selected_split": split or "all", "case_top_k_values": sorted(r[0] for r in cases.select("top_k").distinct().collect()), "dataset_validation": validate},
        "retrieval": {"vector": {"model": model if embed else None, "dim": dim, "minimum_similarity": least}},
    }
    configuration = {
        "configuration": settings, "configuration_fingerprint": hashlib.sha256(json.dumps(settings, sort_keys=True).encode()).hexdigest(), "case_count": cases.count(),
        "corpus_fingerprint": mark(chunks, "chunk_id"), "dataset_fingerprint": mark(chosen.drop("source_file", "source_line", "error"), "id"),
    }
    return EvaluationRun(results, summarize(results, k), configuration)
