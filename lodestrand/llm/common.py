"""What several corpus operators share: word splitting, word hashes and connected components."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.session import cut, fresh_path, shared_dir  # noqa: F401

#: Blanks between words, as a character class for Spark's regular expressions.
BLANK = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that are no letter, digit or part of a longer character become blanks.
ALNUM = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256))

WORD_BYTE = np.array([not (c == 0x20 or 0x09 <= c <= 0x0D) for c in range(256)])
ALNUM_BYTE = np.array([c >= 0x80 or chr(c).isalnum() for c in range(256)])
OUTSIDE_WORD, OUTSIDE_ALNUM = re.compile(rb"[\x20\x09-\x0D]"), re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

MULT = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: Odd multiplier of rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BACK = pow(BASE, -1, 1 << 64)
#: Bytes hashed at once; a longer text is cut between words.
AT_ONCE = 1 << 19


@lru_cache(maxsize=4)
def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def _hash_words(data: bytes, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and first bytes of the words of ``data``, which ends outside a word.

    A word's hash is a polynomial of its bytes: prefix sums of byte * BASE**place, shifted back.
    """
    raw = np.frombuffer(data, np.uint8)
    word = inside[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if word[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    size = 1 << max(20, len(raw).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * powers(BACK, size)[start]), start


def word_hashes(texts: Iterable[bytes | None], alnum: bool = False) -> Iterator[np.ndarray]:
    """64-bit hashes of each text's words, A-Z in lower case: many short texts, or a part of a long one, at a time.

    Words lie between ASCII blanks, or are runs of ASCII letters, digits and characters beyond ASCII.
    """
    inside, outside = (ALNUM_BYTE, OUTSIDE_ALNUM) if alnum else (WORD_BYTE, OUTSIDE_WORD)
    held: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        ends = np.cumsum([len(x) + 1 for x in held])
        h, start = _hash_words(b" ".join(held) + b" ", inside)
        yield from np.split(h, np.searchsorted(start, ends[:-1]))

    for text in texts:
        text = (text or b"").lower()
        if size and size + len(text) > AT_ONCE:
            yield from flush()
            held, size = [], 0
        if len(text) > AT_ONCE:
            parts, at = [], 0
            while at < len(text):
                gap = outside.search(text, at + AT_ONCE)
                end = gap.start() if gap else len(text)
                parts.append(_hash_words(text[at:end] + b" ", inside)[0])
                at = end
            yield np.concatenate(parts)
            continue
        held.append(text)
        size += len(text) + 1
    if held:
        yield from flush()


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each ``k`` consecutive words; of the whole sequence if it has fewer."""
    if 0 < len(h) < k:
        return shingles(h, len(h)) + np.uint64(len(h))
    if not len(h):
        return h
    out = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        out *= MULT
        out += h[j : len(h) - k + 1 + j]
    return mix(out)


def tokenizer_path(name: str) -> str:
    """Place of a vocabulary file of a public tokenizer."""
    import public_tokenizers

    return public_tokenizers.path(name)


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme: one without is in the cluster's default file system, as in Spark's own readers."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


@contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send at most ``rows`` rows at a time to Python: whole texts in large batches take much memory outside the heap."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches of at most ``rows`` rows, where what is made of a row is much larger than the row."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first ``keys`` integer columns, in tables that hold each group whole."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        at = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]).astype(np.int64)
        last = at[:, -1]
        other = np.flatnonzero((at != last[:, None]).any(axis=0))
        if held and (len(other) or (key != last).any()):
            head = int(other[-1]) + 1 if len(other) else 0
            yield pa.Table.from_batches([*held, batch.slice(0, head)])
            held = []
            batch = batch.slice(head)
        elif len(other):
            head = int(other[-1]) + 1
            yield pa.Table.from_batches([batch.slice(0, head)])
            batch = batch.slice(head)
        held.append(batch)
        key = last
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: int) -> np.ndarray:
    """Where the groups of equal first ``keys`` columns start, and the end."""
    at = np.stack([table.column(i).to_numpy() for i in range(keys)]).astype(np.int64)
    return np.concatenate(([0], np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1, [table.num_rows]))


def words_of(text: bytes | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case."""
    return text.lower().split() if text else []


def alnum_words_of(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII, A-Z in lower case."""
    return text.lower().translate(ALNUM).split() if text else []


def text_bytes(column: pa.Array) -> Iterator[bytes | None]:
    """The values of a binary column, one after another."""
    return (x.as_py() for x in column)


def as_bytes(column: str = "text") -> Column:
    """A string column as its UTF-8 bytes, null as null."""
    return F.col(column).cast("string").cast("binary")


def components(edges: DataFrame) -> DataFrame:
    """Connected components of undirected edges ``(a, b)``: rows ``(node, comp)``.

    ``comp`` is the smallest node that can be reached. Labels are exchanged along edges and then
    shortened (the label of the label), so the number of rounds grows with the logarithm of the
    longest path; it ends when no edge joins two labels. Each round is written to the shared folder
    and nothing passes through the driver.
    """
    one_way = cut(edges.select("a", "b"), "edges")
    both = one_way.union(one_way.select("b", "a"))
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("comp")), "labels")
    while True:
        ends = [labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"]
        if one_way.join(ends[0], "a").join(ends[1], "b").where("ca != cb").isEmpty():
            return labels
        near = both.join(ends[1], "b").groupBy(F.col("a").alias("node")).agg(F.min("cb").alias("near"))
        step = labels.join(near, "node").select("node", F.least("comp", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("comp").alias("far"))
        labels = cut(step.join(jump, "next", "left").select("node", F.least("next", F.coalesce("far", "next")).alias("comp")), "labels")


#: A bitmap of ids has at most this many bits (16 MB).
MOST_BITS = 1 << 27


def bitmap(values: DataFrame, column: str, most_bits: int = MOST_BITS) -> tuple[int, np.ndarray]:
    """A bitmap of the low bits of hashes, about 16 bits a value and at most ``most_bits``.

    Only its words come to the driver, a bounded number. A set that outgrows the bound lets more
    through; whoever uses it decides exactly afterwards.
    """
    n = values.count()
    bits = 1 << min(max(16, int(16 * n).bit_length()), most_bits.bit_length() - 1)
    slot = F.col(column).bitwiseAND(F.lit(bits - 1))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))
    rows = values.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(one).alias("bits")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64)
    return bits, out.view(np.uint64)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, text)`` of the given documents and of few others: a bitmap of bounded size spares the rest the shuffle."""
    bits, words = bitmap(ids.select(F.xxhash64("id").alias("h")), "h")
    held = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = in_bitmap(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), bits, held.value)
            if on.any():
                yield batch.select([0, 1]).filter(pa.array(on))

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("id"), as_bytes().alias("text"))
    return rows.withColumn("h", F.xxhash64("id")).mapInArrow(run, "id long, text binary")


def in_bitmap(hashes: np.ndarray, bits: int, words: np.ndarray) -> np.ndarray:
    slot = hashes.view(np.uint64) & np.uint64(bits - 1)
    return (words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1
