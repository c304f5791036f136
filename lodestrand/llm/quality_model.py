"""Quality scores: attention-based multiple-instance learning over the passages of each document."""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.llm.common import OUTSIDE_WORD, WORD_BYTE, _hash_words, as_bytes, cut, text_bytes

FOLDS, HELD = 4, 2
THRESHOLD = 0.7
#: Words of a passage, and slots of word hashes and of word shapes.
PASSAGE, WORD_SLOTS, SHAPES = 64, 2048, 1024
SLOTS = WORD_SLOTS + SHAPES
STATS = 14
#: A longer text is encoded in parts that end at the first blank after so many bytes, or at twice as many.
PART = 1 << 19
#: Classes of bytes: blank, line end, lower case, upper case, digit, sentence mark, other sign, beyond ASCII.
CLASS = np.array(
    [1 if c in (10, 13) else 0 if not WORD_BYTE[c] else 7 if c >= 128 else 2 if chr(c).islower() else 3 if chr(c).isupper() else 4 if chr(c).isdigit() else 5 if chr(c) in ".,;:?'\"()-" else 6 for c in range(256)]
)


@dataclass(frozen=True)
class Mil:
    """Settings of the learner. It sees at most ``sample`` labelled texts of at most ``longest`` bytes each and ``sample_bytes`` together."""

    width: int = 16
    gates: int = 8
    epochs: int = 6
    rate: float = 0.01
    decay: float = 1e-4
    batch: int = 32
    sample: int = 8_000
    sample_bytes: int = 8 << 20
    longest: int = 1 << 18


def _parts(text: bytes) -> Iterator[bytes]:
    at = 0
    while at < len(text):
        gap = OUTSIDE_WORD.search(text, at + PART, at + 2 * PART)
        end = gap.start() if gap else min(len(text), at + 2 * PART) if len(text) > at + PART else len(text)
        yield text[at:end]
        at = end


def _encode_part(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage and slot of each feature, and the passages' statistics."""
    h, start = _hash_words(raw.lower() + b" ", WORD_BYTE)
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, STATS))
    kind = CLASS[np.frombuffer(raw + b" ", np.uint8)]
    inside = kind > 1
    end = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
    of_word = np.arange(len(h)) // PASSAGE
    n = int(of_word[-1]) + 1
    words = np.bincount(of_word, minlength=n).astype(float)
    first, last, size = kind[start], kind[end - 1], end - start
    before = np.concatenate(([0], last[:-1]))
    shape = ((first * 8 + last) * 2 + (before == last)) * 8 + np.minimum(size, 15) // 2
    edges = np.append(start[::PASSAGE], len(raw))
    of_byte = np.repeat(np.arange(n), np.diff(edges))
    share = np.bincount(of_byte * 8 + kind[edges[0] : len(raw)], minlength=8 * n).reshape(n, 8) / np.maximum(np.diff(edges), 1)[:, None]
    seen = np.ones(len(h), bool)
    seen[np.unique(h, return_index=True)[1]] = False
    again = np.concatenate(([False], h[1:] == h[:-1]))
    per_word = lambda x: np.bincount(of_word, weights=x, minlength=n) / words
    stats = np.column_stack((share, per_word(np.minimum(size, 40)) / 10, per_word(seen), per_word(again), per_word(last == 6), per_word(first == 3), words / PASSAGE))
    return np.concatenate((of_word, of_word)), np.concatenate(((h >> np.uint64(53)).astype(np.int64), WORD_SLOTS + shape)), stats


def encode(text: bytes | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a whole text by passages of 64 words; a text without words is one empty passage."""
    rows, slots, stats, n = [], [], [], 0
    for part in _parts(text or b""):
        r, s, x = _encode_part(part)
        rows.append(r + n)
        slots.append(s)
        stats.append(x)
        n += len(x)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((1, STATS))
    return np.concatenate(rows), np.concatenate(slots), np.concatenate(stats)


def _inputs(coded: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Matrix of term frequencies, statistics, and where each document's passages start."""
    counts = np.array([len(x[2]) for x in coded])
    starts = np.cumsum(counts) - counts
    at = np.concatenate([(r + s) * SLOTS + c for (r, c, _), s in zip(coded, starts, strict=True)])
    x = np.bincount(at, minlength=int(counts.sum()) * SLOTS).reshape(-1, SLOTS).astype(np.float32)
    return np.sqrt(x / PASSAGE), np.concatenate([s for *_, s in coded]), starts


class Model:
    """Passage encoder, gated attention and the logistic layer on the weighted passage."""

    NAMES = ("word", "stat", "bias", "v", "u", "gate", "out", "out_bias")

    def __init__(self, p: Mil, weights: dict[str, np.ndarray] | None = None):
        rng = np.random.default_rng(0)
        own = lambda *shape: rng.normal(0, shape[0] ** -0.5 if len(shape) > 1 else 0.1, shape)
        self.w = weights or {
            "word": own(SLOTS, p.width) * 4, "stat": own(STATS, p.width), "bias": np.zeros(p.width), "v": own(p.width, p.gates), "u": own(p.width, p.gates),
            "gate": own(p.gates), "out": np.zeros(p.width), "out_bias": np.zeros(1),
        }

    def passages(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.w["word"].astype(np.float32) + s @ self.w["stat"] + self.w["bias"])

    def attend(self, h: np.ndarray, starts: np.ndarray) -> tuple:
        """Attention of each passage within its document, the weighted passages, and what backpropagation needs."""
        a, g = np.tanh(h @ self.w["v"]), 1 / (1 + np.exp(-(h @ self.w["u"])))
        doc = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(h))))
        e = (a * g) @ self.w["gate"]
        e = np.exp(e - np.maximum.reduceat(e, starts)[doc])
        share = e / np.add.reduceat(e, starts)[doc]
        return share, np.add.reduceat(share[:, None] * h, starts), a, g, doc

    def score(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(z @ self.w["out"] + self.w["out_bias"][0], -35, 35)))

    def gradients(self, x: np.ndarray, s: np.ndarray, starts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss of some documents."""
        w, h = self.w, self.passages(x, s)
        share, z, a, g, doc = self.attend(h, starts)
        d = (self.score(z) - y) / len(y)
        dz = d[:, None] * w["out"]
        da = (h * dz[doc]).sum(1)
        de = share * (da - np.add.reduceat(share * da, starts)[doc])
        both = de[:, None] * w["gate"]
        d_v, d_u = both * g * (1 - a * a), both * a * g * (1 - g)
        dh = share[:, None] * dz[doc] + d_v @ w["v"].T + d_u @ w["u"].T
        pre = dh * (1 - h * h)
        return {
            "word": x.T @ pre.astype(np.float32), "stat": s.T @ pre, "bias": pre.sum(0), "v": h.T @ d_v, "u": h.T @ d_u, "gate": (a * g).T @ de,
            "out": z.T @ d, "out_bias": d.sum(keepdims=True),
        }

    def scores(self, texts: Iterable[bytes | None], at_once: int = 256) -> Iterator[float]:
        """Score of each whole text; passages of many texts, or some of a long one, meet the encoder at a time."""
        held: list[tuple] = []
        n = 0

        def flush() -> Iterator[float]:
            x, s, starts = _inputs(held)
            yield from self.score(self.attend(self.passages(x, s), starts)[1]).tolist()

        for text in texts:
            coded = encode(text)
            size = len(coded[2])
            if n and n + size > at_once:
                yield from flush()
                held, n = [], 0
            if size > at_once:
                rows, slots, stats = coded
                order = np.argsort(rows, kind="stable")
                rows, slots = rows[order], slots[order]
                edges = np.arange(0, size, at_once)
                h = []
                for lo in edges:
                    a, b = np.searchsorted(rows, [lo, lo + at_once])
                    x, s, _ = _inputs([(rows[a:b] - lo, slots[a:b], stats[lo : lo + at_once])])
                    h.append(self.passages(x, s))
                yield from self.score(self.attend(np.concatenate(h), np.zeros(1, np.int64))[1]).tolist()
                continue
            held.append(coded)
            n += size
        if held:
            yield from flush()

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **{k: v.astype(np.float32) for k, v in self.w.items()})
        return out.getvalue()

    @classmethod
    def unpacked(cls, p: Mil, data: bytes) -> Model:
        with np.load(io.BytesIO(data)) as held:
            return cls(p, {k: held[k].astype(np.float64) for k in cls.NAMES})


def fit(texts: list[bytes | None], labels: np.ndarray, p: Mil) -> Model:
    """A model from some passes of Adam over the documents, in a fixed random order each."""
    model, rng = Model(p), np.random.default_rng(1)
    coded = [encode(t) for t in texts]
    first = {k: np.zeros_like(v) for k, v in model.w.items()}
    second = {k: np.zeros_like(v) for k, v in model.w.items()}
    step = 0
    for _ in range(p.epochs):
        order = rng.permutation(len(coded))
        for at in range(0, len(order), p.batch):
            own = order[at : at + p.batch]
            step += 1
            rate = p.rate * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in model.gradients(*_inputs([coded[i] for i in own]), labels[own]).items():
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model.w[k] = model.w[k] * (1 - p.rate * p.decay) - rate * first[k] / (np.sqrt(second[k]) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % FOLDS == HELD, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, p: Mil = Mil()) -> DataFrame:
    """One row ``(model binary)``, learnt from a bounded sample of labelled rows outside the held-out fold.

    The rows are those with the least hash of doc_id as far as ``p.sample`` rows and ``p.sample_bytes`` bytes
    go, so the sample does not depend on how tables are partitioned; texts over ``p.longest`` bytes are not in
    it. Of several texts of a doc_id the least counts, of several labels the lower.
    """
    rank = F.xxhash64("doc_id")
    chosen = (
        labels.where(F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
        .orderBy(rank, "doc_id").limit(p.sample)
    )
    rows = (
        docs.select("doc_id", F.coalesce(as_bytes(), F.lit(b"")).alias("text")).where(F.octet_length("text") <= p.longest)
        .join(cut(chosen, "labelled"), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    )
    rows = cut(rows.withColumn("size", F.octet_length("text")), "labelled")
    so_far = F.sum("size").over(W.orderBy(rank, "doc_id").rowsBetween(W.unboundedPreceding, 0))  # over at most p.sample rows of ids and sizes
    within = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= p.sample_bytes).select("doc_id")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["rank", "doc_id"], kind="stable")
        return pd.DataFrame({"model": [fit(frame["text"].tolist(), frame["label"].to_numpy(float), p).packed()]})

    few = rows.join(within, "doc_id").select("doc_id", "label", "text", rank.alias("rank"))
    return few.groupBy(F.lit(1).alias("one")).applyInPandas(learn, "model binary")


def _score(model, p: Mil):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(p, model.value) if model.value is not None else Model(p)
        for batch in batches:
            scores = pa.array(list(own.scores(text_bytes(batch.column(1)))), pa.float64())
            yield pa.record_batch([batch.column(0), batch.column(2), scores], ["doc_id", "held_out", "score"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, p: Mil = Mil()) -> DataFrame:
    """Quality of every whole text: ``(doc_id, held_out, score, predicted)``, one row per input row.

    A text is a bag of passages of 64 words. Each passage is encoded from hashed words, word shapes and
    shares of kinds of characters; gated attention, learnt from document labels alone, weighs the passages,
    and a logistic layer scores the weighted passage. The model is some 200 KB whatever the input; learning
    sees a bounded sample in one task, scoring is one pass over all rows without a shuffle.

    Defined cases: empty and null texts are one passage of nothing; a very long text is encoded in parts and
    scored over all its passages; a null doc_id is not held out and teaches nothing; a doc_id with several
    labels counts as poor if one says so; without labels all scores are 0.5; an empty table gives no rows; no
    other column is read.
    """
    found = train(docs, labels, p).first()
    model = docs.sparkSession.sparkContext.broadcast(bytes(found[0]) if found else None)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", as_bytes().alias("text"), held_out(F.col("doc_id")).alias("held_out")).mapInArrow(
        _score(model, p), f"doc_id {kind}, held_out boolean, score double"
    )
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
