"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import MULT, as_bytes, cut, mix, text_bytes, word_hashes

FOLDS = 5


@dataclass(frozen=True)
class Ftrl:
    """Settings of the learner; ``sample`` bounds the labelled rows that it sees."""

    bits: int = 20
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 10.0
    l2: float = 1.0
    epochs: int = 4
    sample: int = 12_000


def features(h: np.ndarray, bits: int) -> np.ndarray:
    """Distinct slots of single words, neighbours, and pairs with one or two words skipped; slot 0 is the bias."""
    parts = [h] + [h[:-d] * MULT + h[d:] + np.uint64(d) for d in (1, 2, 3) if len(h) > d]
    slots = mix(np.concatenate(parts)) >> np.uint64(64 - bits) if len(h) else h
    return np.unique(np.concatenate((slots.astype(np.int64), np.zeros(1, np.int64))))


def fit_ftrl(texts: list[bytes | None], labels: np.ndarray, p: Ftrl) -> tuple[np.ndarray, np.ndarray]:
    """Slots and weights that differ from zero after some passes over the rows in the given order."""
    rows = [features(h, p.bits) for h in word_hashes(texts, alnum=True)]
    z, n = np.zeros(1 << p.bits), np.zeros(1 << p.bits)

    def weights(at: np.ndarray) -> np.ndarray:
        lasso = np.where(at == 0, 0.0, p.l1)  # the bias is not shrunk to zero
        over = np.maximum(np.abs(z[at]) - lasso, 0)
        return -np.sign(z[at]) * over / ((p.beta + np.sqrt(n[at])) / p.alpha + p.l2)

    for _ in range(p.epochs):
        for at, y in zip(rows, labels, strict=True):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / p.alpha * w
            n[at] += g * g
    used = np.flatnonzero(n)
    w = weights(used)
    return used[w != 0], w[w != 0]


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl(), target: str = "toxic") -> DataFrame:
    """Weights ``(slot, weight)`` learnt from at most ``p.sample`` labelled rows outside the held-out fold.

    The rows are those with the least hash of doc_id, in that order, so the sample does not depend
    on how the tables are partitioned; of several texts of a doc_id the least counts. Rows without a
    label of 0 or 1 teach nothing.
    """
    chosen = (
        labels.where(F.col(target).isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max(target).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(p.sample)
    )
    rows = (
        docs.select("doc_id", as_bytes().alias("text")).join(cut(chosen, "labelled"), "doc_id")
        .groupBy("doc_id", "label").agg(F.min(F.coalesce("text", F.lit(b""))).alias("text"))
    )

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "doc_id"], kind="stable")
        slots, weights = fit_ftrl(frame["text"].tolist(), frame["label"].to_numpy(float), p)
        return pd.DataFrame({"slot": slots, "weight": weights})

    return rows.withColumn("rank", F.xxhash64("doc_id")).groupBy(F.lit(1).alias("one")).applyInPandas(fit, "slot long, weight double")


def _score(weights, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.zeros(1 << bits)
        w[weights.value[0]] = weights.value[1]
        for batch in batches:
            sums = [w[features(h, bits)].sum() for h in word_hashes(text_bytes(batch.column(1)), alnum=True)]
            scores = 1 / (1 + np.exp(-np.clip(np.array(sums, float), -35, 35)))
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame, p: Ftrl = Ftrl()) -> DataFrame:
    """Toxicity of every whole text: ``(doc_id, held_out, score, predicted)``, one row per input row.

    Features are words, neighbouring pairs and pairs with one or two words between, hashed into
    ``2 ** p.bits`` slots; each counts once a text. FTRL-proximal gives every slot its own rate and
    L1 leaves few weights, so the broadcast model is bounded by the slots (16 MB) and is small in fact.
    Learning sees a bounded sample in one task; scoring is one pass over all rows without a shuffle.

    Defined cases: empty and null texts score the bias alone; a null doc_id is not held out and
    teaches nothing; a doc_id with several labels counts as toxic if one says so; without labels all
    scores are 0.5; an empty table gives no rows; no other column is read.
    """
    model = train(docs, labels, p).toArrow()
    pair = (model.column(0).to_numpy(), model.column(1).to_numpy())
    weights = docs.sparkSession.sparkContext.broadcast(pair)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", as_bytes().alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        _score(weights, p.bits), f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
