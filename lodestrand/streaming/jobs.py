"""Structured Streaming jobs: incremental ingest and per-session memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from lodestrand.operators.ingest import admit, ingested, judge_uploads
from lodestrand.session import cut
from lodestrand.sources.files import latest_version, write_index


STORES = "store string, docs long, bytes long"


def mark_known(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State function of one content of one store: its rows of a batch, ``known`` if a batch before offered the content."""
    known = state.exists
    for frame in frames:
        if not known and not state.exists and frame["reason"].isna().any():
            state.update((int(frame["arrival_seq"].min()),))
        yield frame.assign(known=known)


def stream_ingest(uploads: DataFrame, out: str, checkpoint: str, registry: DataFrame | None = None) -> StreamingQuery:
    """Validate, deduplicate and chunk each micro-batch of ``uploads`` against all batches before it.

    Rows are judged by themselves first. Contents seen before are in the stream's state store, keyed by store and
    hash, so a batch reads no earlier document; ``out/stores`` has each store's documents and bytes after every batch
    that touched it. A content that was refused for quota stays refused, as stores only grow, so it may count as seen.
    Documents, rejects and chunks of batch n go to ``batch=n`` folders, which a repeated batch replaces; it starts from
    the state and the totals of the batches before it. ``registry`` holds what stores have before the first batch.
    """
    spark = uploads.sparkSession
    if registry is None:
        registry = spark.createDataFrame([], "store string, size_bytes long, sha256 string")
    registry.groupBy("store").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("bytes")).write.mode("ignore").parquet(f"{out}/stores/batch=-1")
    held = registry.select("store", "sha256", F.lit(True).alias("_held")).distinct()
    judged = judge_uploads(uploads).join(held, ["store", "sha256"], "left").withColumn("_held", F.coalesce("_held", F.lit(False)))
    # a row that is refused by itself is no content: it has a key of its own
    content = F.when(F.col("reason").isNull(), F.col("sha256")).otherwise(F.concat(F.lit("row "), F.col("arrival_seq")))
    keyed = judged.withColumn("content", content)
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in keyed.schema) + ", known boolean"
    marked = keyed.groupBy("store", "content").applyInPandasWithState(mark_known, shape, "first long", "update", "NoTimeout")

    def batch(rows: DataFrame, batch_id: int) -> None:
        own = cut(rows.withColumn("known", F.col("known") | F.col("_held")).drop("_held", "content"), "batch")  # the state is asked once
        stores = own.sparkSession.read.schema(f"{STORES}, batch long").parquet(f"{out}/stores").where(F.col("batch") < batch_id)
        used = stores.groupBy("store").agg(F.max_by(F.struct("docs", "bytes"), "batch").alias("s")).select("store", "s.docs", "s.bytes")
        quota = admit(own.where("reason is null").select("store", "arrival_seq", "size_bytes", "sha256", "known"), used)
        late = quota.select("store", "arrival_seq", F.col("reason").alias("late"))
        final = cut(own.join(late, ["store", "arrival_seq"], "left").withColumn("reason", F.coalesce("reason", "late")).drop("late", "known"), "batch")
        documents, rejects, chunks = ingested(final)
        new = documents.groupBy("store").agg(F.count("*").alias("n"), F.sum("size_bytes").alias("more"))
        zero = F.lit(0).cast("long")
        totals = new.join(used, "store", "left").select("store", (F.coalesce("docs", zero) + F.col("n")).alias("docs"), (F.coalesce("bytes", zero) + F.col("more")).alias("bytes"))
        for name, df in (("rejects", rejects), ("chunks", chunks), ("documents", documents), ("stores", totals)):
            df.write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

    return marked.writeStream.foreachBatch(batch).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


INGESTED = ("documents", "rejects", "chunks")


def compact_ingested(spark: SparkSession, out: str, upto: int) -> int:
    """Publish the batches up to ``upto`` as one version of large files below ``out/compacted``.

    Batch folders stay until their owner removes them; :func:`read_ingested` does not look at those that a version covers.
    """
    tables = {n: spark.read.option("basePath", f"{out}/{n}").parquet(f"{out}/{n}").where(F.col("batch") <= upto).drop("batch") for n in INGESTED}
    return write_index({**{n: df.repartition(max(1, df.rdd.getNumPartitions() // 8)) for n, df in tables.items()}, "upto": spark.range(1).select(F.lit(upto).alias("upto"))}, f"{out}/compacted")


def read_ingested(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """Documents, rejects and chunks of all batches: the latest compacted version and what came after it."""
    found = latest_version(spark, f"{out}/compacted")
    if found is None:
        return {n: spark.read.parquet(f"{out}/{n}").drop("batch") for n in INGESTED}
    old = {n: spark.read.parquet(f"{out}/compacted/{found[1]}/{n}") for n in (*INGESTED, "upto")}
    upto = old["upto"].first()["upto"]
    return {n: old[n].unionByName(spark.read.parquet(f"{out}/{n}").where(F.col("batch") > upto).drop("batch")) for n in INGESTED}


STATE = "turns array<bigint>, roles array<string>, texts array<string>"
MEMORY = "session_id string, turns array<bigint>, roles array<string>, texts array<string>"


def keep_last(n: int, idle_ms: int) -> Callable:
    """State function: the last ``n`` messages of a session, dropped when the watermark is ``idle_ms`` past its latest."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = list(zip(*state.get, strict=True)) if state.exists else []
        rows, latest = {r[0]: tuple(r) for r in old}, 0
        for frame in frames:
            latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
            rows |= {t: (int(t), r, x) for t, r, x in zip(frame["turn"], frame["role"], frame["content"], strict=True)}
        last = [rows[t] for t in sorted(rows)[-n:]]
        columns = [list(c) for c in zip(*last, strict=True)]
        state.update(tuple(columns))
        state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + idle_ms)
        yield pd.DataFrame({"session_id": [key[0]], "turns": [columns[0]], "roles": [columns[1]], "texts": [columns[2]]})

    return update


def stream_session_memory(messages: DataFrame, n: int = 20, idle_ms: int = 3_600_000) -> DataFrame:
    """Per micro-batch the last ``n`` messages of every session it touched; at most n are kept for each key.

    ``messages (session_id, turn, ts, role, content)``; idle sessions leave the state by the watermark on ``ts``.
    """
    return messages.withWatermark("ts", "1 hour").groupBy("session_id").applyInPandasWithState(keep_last(n, idle_ms), MEMORY, STATE, "update", "EventTimeTimeout")
