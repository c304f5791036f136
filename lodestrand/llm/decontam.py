"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import alnum_words_of, as_bytes, bitmap, cut, in_bitmap, shingles, small_batches, text_bytes, word_hashes


def _windows(width: int, k: int):
    """Windows of items with the shingles that they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = alnum_words_of(text.as_py())
                size = min(width, len(words))
                own = min(k, size)
                tokens = shingles(next(word_hashes([text.as_py()], alnum=True)), own).view(np.int64).tolist() if words else []
                for i in range(len(words) - size + 1 if words else 0):
                    out.append((item_id, b" ".join(words[i : i + size]), size, own, tokens[i : i + size - own + 1]))
            yield pa.record_batch(
                [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, (pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.list_(pa.int64())), strict=True)],
                ["item_id", "window", "size", "k", "tokens"],
            )

    return run


def _hits(width: int, sizes: list[int], bits: int, words_of_filter: np.ndarray):
    """Per document its words' count and the places of shingles that the filter lets through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 500):
            ids, keys, counts, found = [], [], [], []
            for doc_id, text, h in zip(batch.column(0), batch.column(1), word_hashes(text_bytes(batch.column(1)), alnum=True), strict=True):
                words: list[bytes] = []
                hits = []
                for k in sizes:
                    if len(h) < k:
                        continue
                    s = shingles(h, k)
                    for p in np.flatnonzero(in_bitmap(s, bits, words_of_filter)).tolist():
                        start = max(0, p - width + 1)
                        words = words or alnum_words_of(text.as_py())
                        hits.append({"k": k, "token": int(s[p : p + 1].view(np.int64)[0]), "place": p, "start": start, "around": b" ".join(words[start : p + width])})
                ids.append(doc_id.as_py()), keys.append(xxhash.xxh3_128_digest(h.tobytes())), counts.append(len(h)), found.append(hits)
            yield pa.record_batch(
                [pa.array(ids, batch.schema.field(0).type), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(found, HIT)],
                ["doc_id", "tkey", "n_words", "hits"],
            )

    return run


HIT = pa.list_(pa.struct([("k", pa.int32()), ("token", pa.int64()), ("place", pa.int32()), ("start", pa.int32()), ("around", pa.binary())]))


def _covered(spans: Column) -> Column:
    """Length of the union of ``(start, end)`` spans."""
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).alias("end"))
    return F.aggregate(
        F.array_sort(spans),
        zero,
        lambda a, s: F.struct(
            (a["total"] + F.greatest(F.lit(0), s["end"] - F.greatest(a["end"], s["start"]))).cast("long").alias("total"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )["total"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, k: int = 5) -> DataFrame:
    """Which documents hold benchmark passages: ``(doc_id, n_words, n_hit, n_items, items_sha256, contaminated)``.

    Words are runs of ASCII letters and digits and of characters beyond ASCII, A-Z in lower case.
    A window is ``width`` consecutive words of an item, or a shorter item as a whole. A document
    word inside any occurrence of a window is hit. One row per input row.

    A window counts as the set of its ``k``-word shingles (of a shorter item its own length).
    A document contains it only if it holds all of them, so one prefix token is enough: the
    window's rarest shingle in the corpus. A bitmap of bounded size keeps shingles that no item
    has out of the shuffle; counts over all documents order the rest by rarity; the join on
    prefix tokens gives places, which the token's position in the window turns into a start that
    has to leave room for the whole window (position and length bounds); the words around it are
    then compared one by one, so hash collisions decide nothing.

    Defined cases: null or blank text has no words and no hits; a null item_id or an item without
    words is left out; repeated item_ids count once; a null doc_id stays null; without hits
    ``items_sha256`` is the hash of the empty string; an empty benchmark hits nothing, empty
    documents give no rows; other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), as_bytes().alias("text"))
    windows = cut(
        items.mapInArrow(_windows(width, k), "item_id string, window binary, size int, k int, tokens array<long>"), "windows"
    )
    distinct = windows.dropDuplicates(["window"]).select("window", "size", "k", F.posexplode("tokens").alias("offset", "token"))
    bits, held = bitmap(distinct.select("token").distinct(), "token")
    sizes = [r[0] for r in distinct.select("k").distinct().collect()]  # at most the numbers up to k

    kind = docs.schema["doc_id"].dataType.simpleString()
    base = cut(
        docs.select("doc_id", as_bytes().alias("text")).mapInArrow(
            _hits(width, sorted(sizes), bits, held),
            f"doc_id {kind}, tkey binary, n_words long, hits array<struct<k:int,token:long,place:int,start:int,around:binary>>",
        ),
        "hits",
    )
    hits = base.where("size(hits) > 0").select("doc_id", "tkey", "n_words", F.explode("hits").alias("h"))
    rarity = hits.groupBy(F.col("h.k").alias("k"), F.col("h.token").alias("token")).agg(F.count("*").alias("n"))
    prefix = cut(
        distinct.join(rarity, ["k", "token"])
        .groupBy("window", "size", "k")
        .agg(F.min(F.struct("n", "offset", "token")).alias("t"), F.count("*").alias("held"))
        # a window some of whose shingles occur nowhere cannot be contained
        .where(F.col("held") == F.col("size") - F.col("k") + 1)
        .select("window", "size", "k", F.col("t.offset").alias("offset"), F.col("t.token").alias("token")),
        "prefix",
    )
    at = F.col("h.place") - F.col("offset")
    found = (
        hits.withColumns({"k": F.col("h.k"), "token": F.col("h.token")})
        .join(prefix, ["k", "token"])
        .where((at >= 0) & (at + F.col("size") <= F.col("n_words")))
        .where(F.array_join(F.slice(F.split(F.col("h.around").cast("string"), " "), at - F.col("h.start") + 1, F.col("size")), " ") == F.col("window").cast("string"))
        .select("doc_id", "tkey", "window", at.alias("start"), (at + F.col("size")).alias("end"))
        .distinct()
    )
    found = cut(found, "found")
    words_hit = found.groupBy("doc_id", "tkey").agg(
        _covered(F.collect_set(F.struct("start", "end"))).alias("n_hit")
    )
    named = (
        found.select("doc_id", "tkey", "window").distinct()
        .join(windows.select("window", "item_id").distinct(), "window")
        .groupBy("doc_id", "tkey").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    )
    hit = words_hit.join(named, ["doc_id", "tkey"]).withColumnsRenamed({"doc_id": "_doc", "tkey": "_key"})
    joined = base.drop("hits").join(hit, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tkey") == F.col("_key")), "left")
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )
