"""MinHash near-duplicate components with odd sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import as_bytes, components, cut, group_starts, mix, shingles, text_bytes, texts_of, whole_groups, word_hashes

SAMPLES, BANDS, ROWS, BITS = 128, 32, 4, 512
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SAMPLES, dtype=np.uint64)
_ODD = _rng.integers(1, 2**63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SKETCHED = "doc_id long, ckey binary, n_shingles long, bands array<long>, odd array<long>"


def _sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketches of non-empty shingle sets."""
    flat = np.concatenate(sets)
    starts = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1])).astype(np.int64)
    least = np.empty((len(sets), SAMPLES), np.uint64)
    for j in range(SAMPLES):
        least[:, j] = np.minimum.reduceat(flat * _A[j] + _B[j], starts)
    bands = np.zeros((len(sets), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + least[:, r : BANDS * ROWS : ROWS])
    bands = mix(bands + np.arange(1, BANDS + 1, dtype=np.uint64))
    at = (mix(least ^ _ODD) >> np.uint64(55)).astype(np.int64) + np.arange(len(sets))[:, None] * BITS
    odd = np.bincount(at.ravel(), minlength=len(sets) * BITS) & 1
    return bands.view(np.int64), np.packbits(odd.astype(np.uint8).reshape(-1, BITS), axis=1).view(np.int64)


def _sketch_batches(k: int, chunk: int = 60_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        keys: list = []
        sets: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            full = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [None] * len(sets)
            odd: list = [None] * len(sets)
            if full:
                b, o = _sketches([sets[i] for i in full])
                for n, i in enumerate(full):
                    bands[i], odd[i] = b[n], o[n]
            out = pa.record_batch(
                [
                    pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(bands, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64())),
                ],
                ["doc_id", "ckey", "n_shingles", "bands", "odd"],
            )
            ids.clear(), keys.clear(), sets.clear()
            return out

        held = 0
        for batch in batches:
            for doc_id, h in zip(batch.column(0).to_pylist(), word_hashes(text_bytes(batch.column(1))), strict=True):
                s = np.unique(shingles(h, k))
                ids.append(doc_id), keys.append(xxhash.xxh3_128_digest(h.tobytes())), sets.append(s)
                held += len(s) + 1
                if held >= chunk:
                    yield flush()
                    held = 0
        if ids:
            yield flush()

    return run


def odd_estimate(differ: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the number of differing bits of two odd sketches."""
    x = np.clip(1 - 2 * np.asarray(differ, float) / BITS, 1e-9, 1)
    return 1 + BITS / 2 * np.log(x) / (2 * SAMPLES)


def most_differing(estimate: float) -> int:
    """Bits in which two sketches may differ for an estimate of at least ``estimate``."""
    return int(BITS / 2 * (1 - np.exp((estimate - 1) * 2 * SAMPLES * 2 / BITS)))


def near_pairs(group: np.ndarray, comp: np.ndarray, minor: np.ndarray, n: np.ndarray, odd: np.ndarray, most: int, threshold: int):
    """Pairs of one group and of different components, one of them minor, that sizes and sketches let pass.

    ``group`` ascends. Rows are compared at distance 1, 2, ... for all groups at once.
    """
    out, at, step = [], np.arange(len(group)), 1
    while True:
        at = at[at + step < len(group)]
        at = at[group[at + step] == group[at]]
        if not len(at):
            break
        to = at + step
        on = (comp[at] != comp[to]) & (minor[at] | minor[to]) & (100 * np.minimum(n[at], n[to]) >= threshold * np.maximum(n[at], n[to]))
        i, j = at[on], to[on]
        differ = np.bitwise_count(odd[i] ^ odd[j]).sum(axis=1, dtype=np.int64)
        on = differ <= most
        out.append((i[on], j[on], differ[on]))
        step += 1
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _columns(table: pa.Table, names: list[str]) -> list[np.ndarray]:
    return [table.column(x).to_numpy() for x in names]


def _odd(table: pa.Table) -> np.ndarray:
    return table.column("odd").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1).view(np.uint64)


TILE = "k1 long, k2 int, k3 int, node long, comp long, minor boolean, n long, odd array<long>"
ACTIVE = "k1 long, k2 int, k3 int, node long, root long"


def _alike(most: int, threshold: int):
    """The rows of each tile that form a passing pair, with the least row that passing pairs lead to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            starts = group_starts(table, 3)
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            comp, minor, n, node = _columns(table, ["comp", "minor", "n", "node"])
            i, j, _ = near_pairs(group, comp, minor, n, _odd(table), most, threshold)
            least = np.arange(len(group))
            while True:
                both = np.minimum(least[i], least[j])
                new = least.copy()
                np.minimum.at(new, i, both)
                np.minimum.at(new, j, both)
                new = new[new]
                if (new == least).all():
                    break
                least = new
            on = np.unique(np.concatenate((i, j)))
            keys = [table.column(x).combine_chunks().take(pa.array(on)) for x in ("k1", "k2", "k3")]
            yield pa.record_batch([*keys, pa.array(node[on]), pa.array(node[least[on]])], ["k1", "k2", "k3", "node", "root"])

    return run


def _linked(k: int, threshold: int, most: int):
    """Links inside each block that span the same components as all its links.

    Sketches rule out pairs; the rest is compared on whole sets, likeliest first, unless both are
    connected already. Each linked node comes with the first of its component in the block.
    """

    def block(table: pa.Table) -> Iterator[tuple[int, int]]:
        comp, minor, n, node = _columns(table, ["comp", "minor", "n", "node"])
        left, right, differ = near_pairs(np.zeros(len(n), np.int64), comp, minor, n, _odd(table), most, threshold)
        first: dict[int, int] = {}
        parent = [first.setdefault(c, i) for i, c in enumerate(comp.tolist())]
        sets: dict[int, np.ndarray] = {}
        text = table.column("text")

        def shingled(i: int) -> np.ndarray:
            if i not in sets:
                sets[i] = np.unique(shingles(next(word_hashes([text[i].as_py()])), k))
            return sets[i]

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        tied = False
        for p in np.argsort(differ, kind="stable"):
            i, j = int(left[p]), int(right[p])
            a, b = root(i), root(j)
            if a == b:
                continue
            s, t = shingled(i), shingled(j)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if both and 100 * both >= threshold * (len(s) + len(t) - both):
                parent[max(a, b)] = min(a, b)
                tied = True
        if tied:
            for i in range(len(n)):
                if (r := root(i)) != i and node[r] != node[i]:
                    yield int(node[r]), int(node[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, 3):
            starts = group_starts(table, 3)
            out = [x for a, b in zip(starts, starts[1:], strict=False) if b - a > 1 for x in block(table.slice(a, b - a))]
            yield pa.record_batch([pa.array([x[s] for x in out], pa.int64()) for s in (0, 1)], ["a", "b"])

    return run


def _links(blocks: DataFrame, docs: DataFrame, classes: DataFrame, k: int, threshold: int, most: int) -> DataFrame:
    """Links inside blocks ``(k1, k2, k3, node, comp, minor)``, confirmed on whole sets."""
    sides = classes.select("node", "n", "odd")
    texts = texts_of(docs, blocks.select(F.col("node").alias("id"))).withColumnRenamed("id", "node")
    return (
        blocks.join(sides.hint("merge"), "node").join(texts.hint("merge"), "node")
        .select(*(x.split()[0] for x in TILE.split(", ")), "text")
        .repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "node")
        .mapInArrow(_linked(k, threshold, most), "a long, b long").distinct()
    )


def _stars(classes: DataFrame, bands: int, star: int, threshold: int, most: int) -> DataFrame:
    """Blocks of a hub and the classes that share one of the first ``bands`` with it and pass by size and sketch."""
    slots = classes.select("node", F.explode(F.slice("bands", 1, bands)).alias("band"))
    hubs = (
        slots.groupBy("band").agg(F.count("*").alias("m"), F.min(F.struct(F.xxhash64("node"), "node")).alias("hub"))
        .where("m > 1").select("band", F.col("hub.node").alias("a"))
    )
    met = slots.withColumnRenamed("node", "b").join(hubs.hint("merge"), "band").where("a != b").select("a", "b").distinct()
    side = lambda s: classes.select(F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"o{s}")).hint("merge")
    differ = sum((F.bit_count(F.col("oa")[i].bitwiseXOR(F.col("ob")[i])) for i in range(BITS // 64)), F.lit(0))
    pairs = cut(
        met.join(side("a"), "a").join(side("b"), "b")
        .where((differ <= most) & (100 * F.least("na", "nb") >= threshold * F.greatest("na", "nb")))
        .select("a", "b"),
        "hub-pairs",
    )
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / star).cast("int").alias("parts"))
    spoke = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("k2"), F.col("b").alias("node"))
    hub = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("k2"), F.col("a").alias("node"))
    return spoke.union(hub).select(
        F.col("a").alias("k1"), "k2", F.lit(0).alias("k3"), "node", F.col("node").alias("comp"), (F.col("node") == F.col("a")).alias("minor")
    )


def _tiles(known: DataFrame, rows: int, total: int) -> DataFrame:
    """Tiles ``(k1 = band key, k2, k3)`` of the buckets whose classes are not one component yet.

    The bucket's largest component is its main one. Tiles hold a part of the other classes against
    a part of all, so each pair of different components meets in one, and a tile holds at most two
    parts of ``rows`` rows or ``total`` shingles.
    """
    slots = known.select("node", "comp", "n", F.explode("bands").alias("band"))
    mixed = slots.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("band")
    inside = cut(slots.join(mixed.hint("merge"), "band"), "mixed")
    each = inside.groupBy("band", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("t"))
    sizes = each.groupBy("band").agg(
        F.max(F.struct("m", "t", "comp")).alias("main"), F.sum("m").alias("m"), F.sum("t").alias("t")
    )
    parts = lambda m, t: F.greatest(F.ceil(m / rows), F.ceil(t / total), F.lit(1)).cast("int")
    dealt = sizes.select(
        "band", F.col("main.comp").alias("main"), parts(F.col("m"), F.col("t")).alias("all"),
        parts(F.col("m") - F.col("main.m"), F.col("t") - F.col("main.t")).alias("few"),
    )
    at = lambda i, j: F.struct(i.cast("int").alias("k2"), j.cast("int").alias("k3"))
    own_all, own_few = F.pmod(F.xxhash64("node"), F.col("all")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("few"))
    every = F.transform(F.sequence(F.lit(0), F.col("few") - 1), lambda i: at(i, own_all))
    other = F.transform(F.sequence(F.lit(0), F.col("all") - 1), lambda j: at(own_few, j))
    joined = inside.join(dealt.hint("merge"), "band").withColumn("minor", F.col("comp") != F.col("main"))
    return joined.select(
        F.col("band").alias("k1"), F.explode(F.when(F.col("minor"), F.array_union(every, other)).otherwise(every)).alias("at"), "node", "comp", "minor"
    ).select("k1", "at.k2", "at.k3", "node", "comp", "minor")


def near_duplicates(
    docs: DataFrame,
    k: int = 5,
    threshold: int = 75,
    least_estimate: float = 0.55,
    block_docs: int = 512,
    block_shingles: int = 1_000_000,
    hub_bands: int = 8,
) -> DataFrame:
    """Components of documents whose word-shingle sets are similar: ``(doc_id, n_shingles, component_id, kept)``.

    Two documents are linked if ``100 * |A & B| >= threshold * |A | B|`` over their distinct
    ``k``-word shingles (words between ASCII blanks, A-Z in lower case; a shorter text is one
    shingle). One row per input row.

    1. Each text gets 128 MinHash samples. 32 keys of four samples each are its bands (a pair at
       0.75 shares none with a chance of 5e-6); all samples fold into a 512-bit odd sketch, whose
       XOR counts drop pairs estimated below ``least_estimate``, over 4 deviations under 0.75.
       Equal texts become one class, named by its smallest doc_id.
    2. Contraction: in each bucket of the first ``hub_bands`` bands every class meets the bucket's
       hub (least by a hash); what passes the sketch is compared on whole sets. This joins most of
       a group of near copies by as many comparisons as it has rows.
    3. The rest, in all bands: in each bucket whose classes are not one component yet, all pairs
       of different components are weighed by sketch, in tiles of bounded size. Classes of passing
       pairs that hang together, up to ``block_docs``, are one block of whole texts; where more
       hang together, the tiles themselves are the blocks. In a block every passing pair is
       compared on whole sets, likeliest first, unless it is connected already. No pair that
       shares a band and passes the sketch is left out, and no pair is sent anywhere.
    4. The confirmed links' components are joined back to all rows.

    Defined cases: null or blank text has no shingles, is linked with nothing and is kept; a null
    doc_id is linked with nothing, has a null component and is kept; repeated rows share one
    component; a doc_id is taken to name one text; an empty table gives no rows; other columns
    are ignored.
    """
    most = most_differing(least_estimate)
    sketched = cut(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text")).mapInArrow(_sketch_batches(k), SKETCHED),
        "sketches",
    )
    classes = cut(
        sketched.where("n_shingles > 0 and doc_id is not null")
        .groupBy("ckey")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("odd").alias("odd")),
        "classes",
    )
    sure = cut(_links(_stars(classes, hub_bands, block_docs, threshold, most), docs, classes, k, threshold, most), "hub-links")
    known = classes.join(components(sure), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tiles = cut(_tiles(known, block_docs, block_shingles), "tiles")
    alike = cut(
        tiles.join(classes.select("node", "n", "odd").hint("merge"), "node").select(*(x.split()[0] for x in TILE.split(", ")))
        .repartition("k1", "k2", "k3").sortWithinPartitions("k1", "k2", "k3", "node")
        .mapInArrow(_alike(most, threshold), ACTIVE),
        "alike",
    )
    clusters = components(alike.where("node != root").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())
    sizes = clusters.join(classes.select("node", "n"), "node").groupBy("comp").agg((
        (F.count("*") <= block_docs) & (F.sum("n") <= block_shingles)
    ).alias("small"))
    placed = cut(clusters.join(sizes, "comp").select("node", F.col("comp").alias("cluster"), "small"), "clusters")
    keys = ["k1", "k2", "k3", "node"]
    rest = tiles.join(alike.select(*keys), keys).join(placed, "node")
    one = rest.where("small").select(F.col("cluster").alias("k1"), F.lit(-1).alias("k2"), F.lit(-1).alias("k3"), "node", "comp", F.lit(True).alias("minor")).distinct()
    blocks = cut(one.union(rest.where("not small").select(*keys, "comp", "minor")), "blocks")
    found = components(sure.union(_links(blocks, docs, classes, k, threshold, most)))
    named = classes.select("ckey", "node").join(found, "node", "left").select("ckey", F.coalesce("comp", "node").alias("comp"))
    shared = sketched.where("n_shingles > 0 and doc_id is not null").select("doc_id", "ckey", "n_shingles").join(named, "ckey")
    alone = sketched.where("n_shingles = 0 or doc_id is null").select(
        "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept")
    )
    return shared.select("doc_id", "n_shingles", F.col("comp").alias("component_id")).withColumn(
        "kept", F.col("doc_id") == F.col("component_id")
    ).unionByName(alone)
