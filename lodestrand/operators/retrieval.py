"""Batch retrieval: hash vectors, rank fusion, answers, citations and the vector cache."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.functions.text import exact_facts, missing_precise_fact, python_tokens
from lodestrand.operators.filters import FILTER_KEYS, META, apply_filters, matches_filter, normalize_filters, with_filter_prefix  # noqa: F401
from lodestrand.operators.lexical import bm25_search, build_postings, corpus_size, corpus_term_stats, query_terms, top_k  # noqa: F401
from lodestrand.operators.nearest import vector_search
from lodestrand.session import cut
from lodestrand.sources.files import latest_version, write_index

NO_ANSWER = "知识库中暂未找到相关信息，请联系对应业务部门确认。我目前可以查询课程和已经收录的校园办事资料。"
MISSING = ("检索到了相关主题资料，但资料中没有提供你询问的具体", "。为避免编造，请联系对应业务部门或查看当期官方通知确认。")
NO_CONTEXT = "没有检索到可用资料。"


def token_slots(token: str, dim: int) -> tuple[int, int]:
    """Slot and sign of a token: BLAKE2b of eight bytes, modulo ``dim``; plus if its first byte is odd."""
    digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") % dim, 1 if digest[0] & 1 else -1


def hash_embed(dim: int = 512) -> Callable[[Column], Column]:
    """Signed feature hashing of a text's tokens: 1 + ln(tf) per token, unit length (BLAKE2b is no Spark function)."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        slots: dict[str, tuple[int, int]] = {}

        def one(text: str | None) -> np.ndarray:
            v = np.zeros(dim)
            for name, n in Counter(python_tokens(text or "")).items():
                if name not in slots:
                    slots[name] = token_slots(name, dim)
                at, sign = slots[name]
                v[at] += sign * (1 + np.log(n))
            size = np.sqrt((v * v).sum())
            return (v / size if size else v).astype(np.float32)

        return texts.map(one)

    return embed


def embed_with(encoder: Callable[[], Callable[[list[str]], np.ndarray]], dim: int) -> Callable[[Column], Column]:
    """A vectorised column function of a pluggable encoder, made once for each worker; rows and length are checked."""

    @F.pandas_udf("array<float>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            out = np.asarray(encode(texts.fillna("").tolist()), np.float32)
            if out.shape != (len(texts), dim) or not np.isfinite(out).all():
                raise ValueError(f"the encoder returned {out.shape}, not {(len(texts), dim)} finite numbers")
            yield pd.Series(list(out))

    return embed


def vector_error(vector: Column, dim: int) -> Column:
    """Why a vector cannot be indexed; null if it can."""
    return (
        F.when(vector.isNull() | (F.size(vector) != dim), "wrong_length")
        .when(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), "not_finite")
        .when(F.forall(vector, lambda x: x == 0), "zero")
    )


def l2_normalize(vector: Column) -> Column:
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(vector, lambda x: (x / size).cast("float"))).otherwise(vector)


def pin_exact_facts(candidates: DataFrame) -> DataFrame:
    """``pinned`` for candidates ``(query, title, content)`` that share an exact fact."""
    facts = exact_facts(F.concat_ws("\n", "title", "content"))
    return candidates.withColumn("pinned", F.arrays_overlap(exact_facts(F.col("query")), facts))


def rrf_fuse(lexical: DataFrame, vector: DataFrame, k: int = 3, weights: tuple[float, float] = (0.55, 0.45), rrf_k: int = 60, pins: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of two ranked lists, cut at max(20, 4k) each, scaled to at most 1.

    ``pins (query_id, chunk_id)`` get one more. Rows have both ranks and scores and the method.
    """
    deep = max(20, 4 * k)
    side = lambda df, name: df.where(F.col("rank") <= deep).select("query_id", "chunk_id", F.col("score").alias(f"{name}_score"), F.col("rank").alias(f"{name}_rank"))
    total = sum(weights)
    part = lambda name, w: F.coalesce(F.lit(w / total) / (rrf_k + F.col(f"{name}_rank")), F.lit(0.0))
    both = side(lexical, "lexical").join(side(vector, "vector"), ["query_id", "chunk_id"], "full")
    score = (part("lexical", weights[0]) + part("vector", weights[1])) / F.lit(1 / (rrf_k + 1))
    if pins is not None:
        both = both.join(pins.select("query_id", "chunk_id", F.lit(1.0).alias("pin")).distinct(), ["query_id", "chunk_id"], "left")
        score = score + F.coalesce("pin", F.lit(0.0))
    method = F.when(F.col("lexical_rank").isNull(), "vector").when(F.col("vector_rank").isNull(), "bm25").otherwise("hybrid")
    fused = both.withColumns({"score": F.round(score, 9), "retrieval_method": method})
    return top_k(fused, k).select("query_id", "chunk_id", "score", "rank", "lexical_score", "vector_score", "lexical_rank", "vector_rank", "retrieval_method")


def as_hits(ranked: DataFrame, method: str) -> DataFrame:
    """One channel's ranks in the shape of fused hits."""
    own = lambda name: {f"{name}_score": F.col("score"), f"{name}_rank": F.col("rank")} if {"bm25": "lexical"}.get(method, method) == name else {f"{name}_score": F.lit(None).cast("double"), f"{name}_rank": F.lit(None).cast("int")}
    return ranked.withColumns(own("lexical") | own("vector") | {"retrieval_method": F.lit(method)}).select(
        "query_id", "chunk_id", "score", "rank", "lexical_score", "vector_score", "lexical_rank", "vector_rank", "retrieval_method"
    )


def open_vectors(vectors: DataFrame, chunks: DataFrame, filters: DataFrame) -> DataFrame:
    """``vectors`` with ``open_to``: the filter_ids that let their chunk through."""
    return vectors.join(apply_filters(chunks, filters).groupBy("chunk_id").agg(F.collect_set("filter_id").alias("open_to")), "chunk_id")


def pins_of(queries: DataFrame, chunks: DataFrame, *ranked: DataFrame) -> DataFrame:
    """``(query_id, chunk_id)`` among ranked lists whose texts share an exact fact."""
    pairs = reduce(DataFrame.union, (r.select("query_id", "chunk_id") for r in ranked)).distinct()
    texts = pairs.join(queries.select("query_id", "query"), "query_id").join(chunks.select("chunk_id", "title", "content"), "chunk_id")
    return pin_exact_facts(texts).where("pinned").select("query_id", "chunk_id")


def channels(queries: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, vectors: DataFrame, deep: int, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """BM25 and vector hits down to ``deep`` and the pins ``(query_id, chunk_id)`` among both, of queries with usable vectors.

    Both lists are written once, as fusion and pins read them.
    """
    near = cut(vector_search(queries, open_vectors(vectors, chunks, filters), deep, least), "near")
    lexical = cut(bm25_search(queries, chunks, postings, filters, deep), "lexical")
    return lexical, near, pins_of(queries, chunks, lexical, near)


def unusable_vector(vector: Column, dim: int) -> Column:
    """True for a vector that cannot be searched with: missing, of the wrong length or not finite."""
    return F.coalesce(vector_error(vector, dim).isin("wrong_length", "not_finite"), F.lit(False))


def retrieve(queries: DataFrame, chunks: DataFrame, postings: DataFrame, filters: DataFrame, vectors: DataFrame | None = None, strategy: str = "hybrid", k: int = 3, least: float = 0.22, dim: int = 512) -> DataFrame:
    """Hits by strategy ``bm25``, ``vector`` or ``hybrid``; without usable vectors a query falls back to BM25.

    ``queries`` may hold a ``vector``. One of the wrong length or with a number that is not finite
    counts as unavailable; a zero vector only finds nothing. Both channels see only chunks that the
    query's filter lets through.
    """
    deep = max(20, 4 * k) if strategy == "hybrid" else k
    if strategy == "bm25" or vectors is None or "vector" not in queries.columns:
        return as_hits(bm25_search(queries, chunks, postings, filters, k), "bm25")
    queries = cut(queries, "queries")
    bad = unusable_vector(F.col("vector"), dim)
    good, fallback = queries.where(~bad), queries.where(bad)
    plain = as_hits(bm25_search(fallback, chunks, postings, filters, k), "bm25")
    lexical, near, pins = channels(good, chunks, postings, filters, vectors, deep, least)
    if strategy == "vector":
        return as_hits(near, "vector").unionByName(plain)
    return rrf_fuse(lexical, near, k, pins=pins).unionByName(plain)


def build_context(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, context)``: numbered blocks of title, content and source in the order of ranks."""
    block = F.concat(F.lit("[资料"), F.col("rank").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("content"), F.lit("\n来源："), F.col("source"))
    blocks = (
        hits.join(chunks.select("chunk_id", "title", "content", "source"), "chunk_id")
        .groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    )
    text = F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")
    return queries.select("query_id").join(blocks, "query_id", "left").select("query_id", F.coalesce(text, F.lit(NO_CONTEXT)).alias("context"))


def answer(queries: DataFrame, hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``(query_id, answer, missing_fact)``: the best chunk and its source, or an abstention."""
    best = hits.where("rank = 1").join(chunks.select("chunk_id", "title", "content", "source"), "chunk_id").drop("rank")
    joined = queries.select("query_id", "query").join(best, "query_id", "left")
    missing = missing_precise_fact(F.col("query"), F.concat_ws("\n", "title", "content"))
    text = (
        F.when(F.col("chunk_id").isNull(), NO_ANSWER)
        .when(F.col("missing_fact").isNotNull(), F.concat(F.lit(MISSING[0]), F.col("missing_fact"), F.lit(MISSING[1])))
        .otherwise(F.concat(F.col("title"), F.lit("："), F.col("content"), F.lit("\n来源："), F.col("source")))
    )
    marked = joined.withColumn("missing_fact", F.when(F.col("chunk_id").isNotNull(), missing))
    return marked.select("query_id", text.alias("answer"), "missing_fact")


def citations(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """One citation per query, of its first hit."""
    best = hits.where("rank = 1").join(chunks.select("chunk_id", "document_id", "source_name", "source", "title"), "chunk_id")
    name = F.when(F.coalesce("source_name", F.lit("")) != "", F.col("source_name")).otherwise(F.split_part("source", F.lit("#"), F.lit(1)))
    return best.select(
        "query_id", F.concat(F.lit("C"), F.col("rank").cast("string")).alias("citation_id"), "document_id", "chunk_id", name.alias("source"), "title",
        F.round("score", 6).alias("score"), "retrieval_method", F.lit("").alias("snippet"),
    )


def checked_cache(cache: DataFrame, fingerprint: str, dim: int) -> DataFrame:
    """``(sha256, vector, fine)`` of one model's entries; ``fine`` unless an entry cannot be trusted.

    That is one with a bad hash or vector, a checksum that is not its own, or a hash that has several entries.
    """
    own = cache.where(F.col("fingerprint") == fingerprint)
    once = own.groupBy("sha256").agg(F.count("*").alias("n"), F.min_by(F.struct("vector", "checksum"), "checksum").alias("e")).select("sha256", "n", "e.*")
    fine = (F.col("n") == 1) & F.col("sha256").rlike("^[0-9a-f]{64}$") & vector_error(F.col("vector"), dim).isNull() & (F.col("checksum") == cache_checksum(fingerprint))
    return once.select("sha256", "vector", F.coalesce(fine, F.lit(False)).alias("fine"))


def cache_checksum(fingerprint: str) -> Column:
    """Checksum of an entry ``(sha256, vector)``."""
    return F.xxhash64(F.lit(fingerprint), F.col("sha256"), F.col("vector"))


def embed_incremental(texts: DataFrame, cache: DataFrame, fingerprint: str, embed: Callable[[Column], Column], dim: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Vectors of ``texts (key, text)`` with each new distinct text encoded once.

    Returns the rows ``(key, vector, hit)``, the pruned cache ``(fingerprint, sha256, vector, checksum)`` that holds just
    these texts, and the counts ``(total, hits, misses)`` per occurrence. With ``dim`` the cache's entries
    have checksums, and those that cannot be trusted are encoded again. Distinct texts and what the cache has of
    them are written once, and the encoder sees each missing text in one task only.
    """
    keyed = texts.select("key", F.coalesce("text", F.lit("")).alias("text")).withColumn("sha256", F.sha2("text", 256))
    known = cache.where(F.col("fingerprint") == fingerprint).select("sha256", "vector") if dim is None else checked_cache(cache, fingerprint, dim).where("fine").select("sha256", "vector")
    distinct = keyed.groupBy("sha256").agg(F.first("text").alias("text"))
    held = known.join(distinct.select("sha256"), "sha256", "left_semi").withColumn("hit", F.lit(True))
    new = distinct.join(known, "sha256", "left_anti").select("sha256", embed(F.col("text")).alias("vector"), F.lit(False).alias("hit"))
    vectors = cut(held.union(new), "vectors")
    stats = cache_stats(keyed, known)
    rows = keyed.select("key", "sha256").join(vectors, "sha256").select("key", "vector", "hit")
    return rows, vectors.select(F.lit(fingerprint).alias("fingerprint"), "sha256", "vector", cache_checksum(fingerprint).alias("checksum")), stats


def embed_cached(texts: DataFrame, root: str, fingerprint: str, embed: Callable[[Column], Column], dim: int) -> tuple[DataFrame, DataFrame]:
    """``(key, vector, hit)`` of ``texts`` through the cache below ``root``, and the counts ``(total, hits, misses, rebuilt)``.

    A model has a folder of its own, by the hash of its fingerprint, with whole versions of the pruned
    cache: a reader sees the old one until the new one is published. ``rebuilt`` is true if entries of the version read
    are missing or cannot be trusted, be it a file that cannot be read or a value that was changed; these are encoded again.
    """
    spark = texts.sparkSession
    if not fingerprint or dim < 1:
        raise ValueError("a model needs a fingerprint and a dimension")
    home = f"{root}/{hashlib.sha256(fingerprint.encode()).hexdigest()}"
    schema = "fingerprint string, sha256 string, vector array<float>, checksum long"
    found, entries = latest_version(spark, home), 0
    cache = spark.createDataFrame([], schema)
    if found:
        entries = spark.read.schema("entries long").json(f"{home}/{found[1]}/size").first()["entries"]
        cache = cut(spark.read.schema(schema).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).parquet(f"{home}/{found[1]}/vectors"), "cache")
    trusted = checked_cache(cache, fingerprint, dim).where("fine").count()
    rows, pruned, stats = embed_incremental(texts, cache, fingerprint, embed, dim)
    whole = cut(pruned.where(vector_error(F.col("vector"), dim).isNull()), "pruned")
    counts = cut(stats.withColumn("rebuilt", F.lit(trusted < entries)), "counts")
    if not found or trusted < entries or whole.count() != entries or counts.first()["misses"]:
        write_index({"vectors": whole, "size": whole.agg(F.count("*").alias("entries"))}, home, {"size": "json"})
    return rows, counts


def cache_stats(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """``(total, hits, misses)`` of occurrences ``(sha256)`` against known hashes; each occurrence of a new text misses."""
    own = keyed.groupBy("sha256").agg(F.count("*").alias("n")).join(known.select("sha256", F.lit(True).alias("hit")).distinct(), "sha256", "left")
    part = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return own.agg(part(F.lit(True)).alias("total"), part(F.col("hit").isNotNull()).alias("hits"), part(F.col("hit").isNull()).alias("misses"))
