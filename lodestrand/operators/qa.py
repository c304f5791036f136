"""Question answering in two bounded passes: grade, rewrite, retry, verify, compose."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import extract_claims, informative_terms, rewrite_query, tokenize
from lodestrand.operators.retrieval import NO_ANSWER
from lodestrand.session import cut

#: Reasons of a grade, in the order of its rules.
GRADES = ("词法命中覆盖至少两个问题信息词", "语义相似度达到强相关阈值", "语义候选同时具备信息词覆盖")
NO_CANDIDATE = "没有检索到候选片段"
TOO_LITTLE = "候选片段与问题缺少足够相关证据"
KNOWLEDGE = "search_campus_knowledge"


def grade(queries: DataFrame, hits: DataFrame, chunks: DataFrame, strong: float = 0.55, weak: float = 0.30, overlap: int = 2) -> DataFrame:
    """``(query_id, status, reason)``: relevant by the first hit, in the order of ranks, that meets a rule."""
    joined = (
        hits.select("query_id", "chunk_id", "rank", "lexical_score", "vector_score")
        .join(chunks.select("chunk_id", "title", "content"), "chunk_id").join(queries.select("query_id", "query"), "query_id")
    )
    shared = F.size(F.array_intersect(informative_terms(tokenize(F.col("query"))), tokenize(F.concat_ws(" ", "title", "content"))))
    vector, lexical = F.coalesce("vector_score", F.lit(0.0)), F.coalesce("lexical_score", F.lit(0.0))
    rule = (
        F.when((lexical > 0) & (F.col("shared") >= overlap), 0)
        .when(vector >= strong, 1)
        .when((vector >= weak) & (F.col("shared") >= overlap), 2)
    )
    best = joined.withColumn("shared", shared).withColumn("rule", F.when(F.col("content") != "", rule))
    graded = best.groupBy("query_id").agg(F.min_by("rule", F.when(F.col("rule").isNotNull(), F.col("rank"))).alias("rule"), F.count("*").alias("n"))
    reasons = F.array(*map(F.lit, GRADES))
    return queries.select("query_id").join(graded, "query_id", "left").select(
        "query_id",
        F.when(F.col("rule").isNotNull(), "relevant").otherwise("insufficient").alias("status"),
        F.when(F.col("n").isNull(), NO_CANDIDATE).when(F.col("rule").isNull(), TOO_LITTLE).otherwise(F.get(reasons, F.col("rule"))).alias("reason"),
    )


def retrieve_with_retry(queries: DataFrame, chunks: DataFrame, search: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Hits after at most two passes, and ``(query_id, query, final_query, rewritten, initial_status, status, attempts)``.

    ``search`` maps queries to hits. Only queries graded insufficient are rewritten, and only those that
    the rewriting changes are searched again; their second hits replace the first.
    """
    first = cut(search(queries), "first-pass")
    graded = cut(queries.join(grade(queries, first, chunks), "query_id"), "graded")
    new = rewrite_query(F.col("query"))
    # written first: a filter on a field of the rewriting would compute it once more for each field
    again = cut(graded.where("status = 'insufficient'").withColumn("new", new), "rewritten").where("new.changed").withColumn("query", F.col("new.query")).drop("new", "status", "reason")
    again = cut(again, "again")
    second = cut(search(again), "second-pass")
    status = grade(again, second, chunks).select("query_id", F.col("status").alias("second"))
    hits = first.join(again.select("query_id"), "query_id", "left_anti").unionByName(second)
    passes = graded.join(again.select("query_id", F.col("query").alias("final_query")), "query_id", "left").join(status, "query_id", "left")
    rewritten = F.col("final_query").isNotNull()
    return hits, passes.select(
        "query_id", "query", F.coalesce("final_query", "query").alias("final_query"), rewritten.alias("rewritten"),
        F.col("status").alias("initial_status"), F.coalesce("second", "status").alias("status"), F.when(rewritten, 2).otherwise(1).alias("attempts"),
    )


def verify(answers: DataFrame, results: DataFrame, citations: DataFrame) -> DataFrame:
    """``(query_id, status, claims)``: whether an answer rests on its tool results; the first of five outcomes.

    ``answers (query_id, answer)``; ``results (query_id, tool_name, ok, output, hits)`` with hits of
    (chunk_id, content); ``citations (query_id, chunk_id)``. ``claims`` are the unsupported ones.
    """
    fine = results.where("ok")
    per = fine.groupBy("query_id").agg(
        F.max((F.col("tool_name") == KNOWLEDGE) & (F.coalesce(F.size("hits"), F.lit(0)) <= 0)).alias("bare"),
        F.flatten(F.collect_list(F.coalesce(F.transform("hits", lambda h: h["chunk_id"]), F.array().cast("array<string>")))).alias("known"),
        F.concat_ws("\n", F.collect_list(F.concat_ws("\n", "output", F.transform("hits", lambda h: h["content"])))).alias("evidence"),
    )
    cited = citations.groupBy("query_id").agg(F.collect_set("chunk_id").alias("cited"))
    joined = answers.join(per, "query_id", "left").join(cited, "query_id", "left")
    claims = F.filter(extract_claims(F.col("answer")), lambda c: ~F.col("evidence").contains(c))
    foreign = (F.size("known") > 0) & (F.col("cited").isNull() | (F.size(F.array_except("cited", "known")) > 0))
    status = (
        F.when(F.col("evidence").isNull(), "no_result").when(F.col("bare"), "no_hits").when(foreign, "foreign_citation")
        .when(F.size("claims") > 0, "unsupported_claim").otherwise("grounded")
    )
    return joined.withColumn("claims", F.coalesce(claims, F.array().cast("array<string>"))).select("query_id", status.alias("status"), "claims")


def outcome(status: Column) -> Column:
    """The three-valued verdict of a verification status."""
    return (
        F.when(status.isin("no_result", "no_hits"), "insufficient_evidence")
        .when(status.isin("foreign_citation", "unsupported_claim"), "unsupported").otherwise("grounded")
    )


def compose(results: DataFrame) -> DataFrame:
    """``(query_id, text)``: outputs in the order of calls; failures named; among several, a search without hits left out."""
    own = W.partitionBy("query_id")
    empty = (F.col("tool_name") == KNOWLEDGE) & F.col("output").startswith(NO_ANSWER.split("，")[0])
    counted = results.withColumn("n", F.count("*").over(own))
    part = F.when(F.col("ok"), F.col("output")).otherwise(F.concat("tool_name", F.lit(" 未能完成："), F.coalesce("error", F.lit(""))))
    kept = counted.where(~(F.col("ok") & empty & (F.col("n") > 1)))
    text = kept.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("call_seq", part.alias("part")))).alias("parts"))
    texts = text.select("query_id", F.array_join(F.transform("parts", lambda p: p["part"]), "\n\n").alias("text"))
    return results.select("query_id").distinct().join(texts, "query_id", "left").select("query_id", F.coalesce("text", F.lit("")).alias("text"))


def normalize_citations(citations: DataFrame) -> DataFrame:
    """First citation of each chunk in the order ``seq``, blanks dropped, numbered C1, C2, ... per query."""
    named = citations.where(F.trim(F.coalesce("chunk_id", F.lit(""))) != "")
    first = named.withColumn("n", F.row_number().over(W.partitionBy("query_id", "chunk_id").orderBy("seq"))).where("n = 1").drop("n")
    number = F.row_number().over(W.partitionBy("query_id").orderBy("seq"))
    return first.withColumn("citation_id", F.concat(F.lit("C"), number.cast("string")))


def verified_answer(answers: DataFrame, verdicts: DataFrame, composed: DataFrame) -> DataFrame:
    """``(query_id, answer, replaced)``: an answer that is not grounded gives way to the composed evidence."""
    joined = answers.join(verdicts, "query_id").join(composed, "query_id", "left")
    replaced = (outcome(F.col("status")) != "grounded") & F.col("text").isNotNull()
    return joined.select("query_id", F.when(replaced, F.col("text")).otherwise(F.col("answer")).alias("answer"), replaced.alias("replaced"))


def trace_events(passes: DataFrame) -> DataFrame:
    """``(query_id, events, retrievals)``: retrieve, grade, then for an insufficient grade rewrite and, if the query changed, both again, and verify."""
    again = F.when(F.col("rewritten"), F.array(*map(F.lit, ("rewrite", "retrieve", "grade")))).otherwise(
        F.when(F.col("initial_status") == "insufficient", F.array(F.lit("rewrite"))).otherwise(F.array().cast("array<string>"))
    )
    events = F.concat(F.array(*map(F.lit, ("retrieve", "grade"))), again, F.array(F.lit("verify")))
    return passes.select("query_id", events.alias("events")).withColumn("retrievals", F.size(F.filter("events", lambda e: e == "retrieve")))
