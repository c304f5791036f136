"""Conversation prefix trie: nodes of shared first turns, with subtree totals rolled up in bands of depths."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import cut, powers

#: Two odd multipliers of prefix hashes modulo 2**64, with their inverses.
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
BACK = tuple(pow(m, -1, 1 << 64) for m in LANES)
#: Conversations of a block of this many get their first turns from the block's first conversation.
BLOCK, MOST_SHARED = 20, 4
#: Depths of a band; ids joined to one string on the way to a node's hash of members.
BAND, IDS = 4, 4096
NOTHING = hashlib.sha256(b"").hexdigest()
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["d", "p1", "p2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """``(conv_id, turn, t1, t2, words)``: two halves of a digest of role and text in place of them; null is empty."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.md5(F.concat(F.md5(role), F.md5(text)))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, -10).cast("long")
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), half(1).alias("t1"), half(17).alias("t2"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))


def _prefixes(t: np.ndarray, start: np.ndarray, lane: int, carry: np.uint64) -> np.ndarray:
    """Hash of the rows so far of each group: ``p = p * M + t``; the first group goes on from ``carry``."""
    n = len(t)
    size = 1 << max(12, n.bit_length())
    forth, back = powers(LANES[lane], size)[:n], powers(BACK[lane], size)[:n]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(t.view(np.uint64) * back, dtype=np.uint64)))
    out = (sums[1:] - sums[start]) * forth
    first = start == 0
    out[first] += carry * forth[first] * np.uint64(LANES[lane])
    return out


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix hashes of a sorted task's rows in their conversation, as far as this task has it; ``tail`` marks its last row here."""
    task = TaskContext.get().partitionId()
    held, conv, place, carry = None, None, 0, [np.uint64(0)] * 2

    def rows(batch: pa.RecordBatch, after: int | None) -> pa.RecordBatch:
        nonlocal conv, place, carry
        ids = batch.column(0).to_numpy()
        edge = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        start = np.zeros(len(ids), np.int64)
        start[edge] = edge
        start = np.maximum.accumulate(start)
        goes_on = conv is not None and ids[0] == conv
        at = np.arange(len(ids)) - start + (place * (start == 0) if goes_on else 0)
        p = [_prefixes(batch.column(i + 1).to_numpy(), start, i, carry[i] if goes_on else np.uint64(0)) for i in range(2)]
        conv, place, carry = ids[-1], int(at[-1]) + 1, [x[-1] for x in p]
        tail = np.append(ids[1:] != ids[:-1], after is None or ids[-1] != after)
        return pa.record_batch([pa.array(np.full(len(ids), task, np.int32)), batch.column(0), pa.array(at), *(pa.array(x.view(np.int64)) for x in p), pa.array(tail), *batch.columns[1:]], ["task", "conv_id", "place", "p1", "p2", "tail", *batch.schema.names[1:]])

    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield rows(held, batch.column(0)[0].as_py())
            held = batch
    if held is not None:
        yield rows(held, None)


def _carries(ends: list) -> dict[int, tuple]:
    """What each task adds: the conversation it begins inside, its place and hashes before; and the conversation the next task goes on with.

    ``ends`` has the first and last conversation of each task, in order, with the rows and hashes of the last.
    """
    out, conv, place, p = {}, None, 0, (0, 0)
    for i, e in enumerate(ends):
        goes_on = e.first == conv
        more = i + 1 < len(ends) and ends[i + 1].first == e.last
        out[e.task] = (e.first if goes_on else None, place, p, e.last if more else None)
        own = (e.p1 % (1 << 64), e.p2 % (1 << 64))
        if goes_on and e.first == e.last:
            p = tuple((q * pow(m, e.place + 1, 1 << 64) + x) % (1 << 64) for q, m, x in zip(p, LANES, own, strict=True))
            place += e.place + 1
        else:
            place, p = e.place + 1, own
        conv = e.last
    return out


def _completed(carries):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            task, ids, place = (batch.column(i).to_numpy().copy() for i in range(3))
            p = [batch.column(i).to_numpy().view(np.uint64).copy() for i in (3, 4)]
            tail = batch.column(5).to_numpy(zero_copy_only=False).copy()
            for own in np.unique(task):
                first, before, carry, open_ = carries.value[int(own)]
                at = np.flatnonzero((task == own) & (ids == first)) if first is not None else np.zeros(0, np.int64)
                if len(at):
                    size = 1 << max(12, int(place[at].max() + 1).bit_length())
                    for x, c, m in zip(p, carry, LANES, strict=True):
                        x[at] += np.uint64(c) * powers(m, size)[place[at]] * np.uint64(m)
                    place[at] += before
                if open_ is not None:  # its last row here is not its last
                    tail[(task == own) & (ids == open_)] = False
            yield pa.record_batch([batch.column(1), pa.array(place), *(pa.array(x.view(np.int64)) for x in p), pa.array(tail), *batch.columns[6:]], batch.schema.names[1:])

    return run


def ordered(rows: DataFrame, by: list[Column]) -> DataFrame:
    """``(conv_id, place, p1, p2, tail, t1, t2, words)`` of ``rows (conv_id, t1, t2, words, ...)`` in the order of conv_id and ``by``.

    Rows are dealt by ranges of the whole order, so one conversation may take many tasks. Each task counts
    by itself; what it has to add is composed from one row for each task at the driver, as many as
    ``spark.sql.shuffle.partitions``.
    """
    spark = rows.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("conv_id"), *by]
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select("conv_id", "t1", "t2", "words")
    shape = "conv_id long, place long, p1 long, p2 long, tail boolean, t1 long, t2 long, words long"
    local = cut(dealt.mapInArrow(_local, f"task int, {shape}"), "ordered")
    end = F.max(F.struct("conv_id", "place", "p1", "p2")).alias("end")
    ends = local.groupBy("task").agg(F.min("conv_id").alias("first"), end).orderBy("task")
    found = ends.select("task", "first", F.col("end.conv_id").alias("last"), "end.place", "end.p1", "end.p2").collect()
    return local.mapInArrow(_completed(spark.sparkContext.broadcast(_carries(found))), shape)


def rebuilt(turns: DataFrame) -> DataFrame:
    """``turns`` with each conversation's first h turns taken from the first one of its block; ``(conv_id, part, turn, t1, t2, words)``.

    h is the CRC-32 of the decimal conv_id modulo 4. Every conversation also has a root row, of part -1.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST_SHARED
    placed = cut(ordered(turns, [F.asc_nulls_first("turn"), *(F.col(c).bitwiseXOR(F.lit(-(1 << 63))) for c in ("t1", "t2"))]), "turns")
    convs = placed.select("conv_id").distinct()
    heads = placed.where((F.col("place") < MOST_SHARED - 1) & (F.col("conv_id") % BLOCK == 0)).withColumnRenamed("conv_id", "base")
    first = convs.withColumns({"base": F.col("conv_id") - F.col("conv_id") % BLOCK, "h": h}).join(heads, "base").where("place < h")
    shape = lambda df, part: df.select("conv_id", F.lit(part).alias("part"), F.col("place").alias("turn"), "t1", "t2", "words")
    root = convs.select("conv_id", F.lit(-1).alias("part"), *(F.lit(0).cast("long").alias(c) for c in ("turn", "t1", "t2", "words")))
    return root.unionByName(shape(first, 0)).unionByName(shape(placed.where(F.col("place") >= h), 1))


def path_rows(rows: DataFrame, band: int = BAND) -> DataFrame:
    """``rows (conv_id, d, p1, p2, ...)`` with the parent's key ``q1, q2`` and the keys of the ancestors in the row's band.

    ``a1_j, a2_j`` are the key of the ancestor j depths above, null beyond the band's top. A conversation's
    rows of one band, at most ``band`` + 1 with the one before it, are gathered for this and no more.
    """
    above = rows.where(F.col("d") % band == band - 1).withColumn("b", F.floor(F.col("d") / band) + 1)
    own = rows.withColumn("b", F.floor(F.col("d") / band))
    kept = [c for c in rows.columns if c != "conv_id"]
    lists = own.unionByName(above).groupBy("conv_id", "b").agg(F.array_sort(F.collect_list(F.struct(*kept))).alias("own"))
    at = lambda j: F.get("own", F.col("i") - j)
    opened = lists.select("conv_id", "b", "own", F.explode(F.sequence(F.lit(0), F.size("own") - 1)).alias("i")).where(at(0)["d"] >= F.col("b") * band)
    inside = lambda j: at(0)["d"] - j >= F.col("b") * band
    ancestors = {f"a{x}_{j}": F.when(inside(j), at(j)[f"p{x}"]) for j in range(1, band) for x in (1, 2)}
    return opened.select("conv_id", *(at(0)[c].alias(c) for c in kept), at(1)["p1"].alias("q1"), at(1)["p2"].alias("q2"), *(c.alias(n) for n, c in ancestors.items()))


def _named(df: DataFrame, key: list, **values) -> DataFrame:
    """``df`` as rows of the key columns and ``values``."""
    return df.select(*(c.alias(n) for n, c in zip(KEY, key, strict=True)), *(c.alias(n) for n, c in values.items()))


def _in_band(nodes: DataFrame, names: list[str], band: int) -> DataFrame:
    """Sums of ``names`` over the part of each node's subtree that is in its band: a node goes to itself and its ancestors there."""
    own = [F.struct("d", "p1", "p2")] + [F.when(F.col(f"a1_{j}").isNotNull(), F.struct((F.col("d") - j).alias("d"), F.col(f"a1_{j}").alias("p1"), F.col(f"a2_{j}").alias("p2"))) for j in range(1, band)]
    opened = nodes.select(F.explode(F.filter(F.array(*own), lambda x: x.isNotNull())).alias("to"), *names)
    return opened.groupBy(*(F.col(f"to.{c}").alias(c) for c in KEY)).agg(*(F.sum(n).alias(n) for n in names))


def subtree_sums(nodes: DataFrame, rows: DataFrame, names: list[str], deepest: int, band: int = BAND) -> DataFrame:
    """Sums of ``names`` over each node's whole subtree: key columns and ``names``.

    Inside a band every node goes to its ancestors of that band, at most ``band`` rows. The tops of bands
    are a tree of their own, ``band`` times lower, whose subtree sums come from the same rule; a top's
    completed total then counts for the node above it, and one more pass inside the bands ends it. So
    rounds grow with the logarithm of the depth and no node ever goes to all its ancestors.

    ``nodes`` has the keys, parents, ancestors of :func:`path_rows` and ``names``; ``rows`` the paths ``(conv_id, d, p1, p2)``.
    """
    if deepest < band:
        return _in_band(nodes, names, band)
    higher = F.floor(F.col("d") / band)
    tops = _in_band(nodes, names, band).where(F.col("d") % band == 0).withColumn("d", higher)
    top_rows = cut(rows.where(F.col("d") % band == 0).select("conv_id", higher.alias("d"), "p1", "p2"), "tops")
    paths = path_rows(top_rows, band)
    shape = paths.groupBy(*KEY).agg(*(F.min(c).alias(c) for c in paths.columns if c not in ("conv_id", *KEY)))
    totals = subtree_sums(cut(shape.join(tops, KEY), "tops"), top_rows, names, deepest // band, band)
    above = nodes.where((F.col("d") % band == 0) & (F.col("d") > 0)).select(*KEY, "q1", "q2").join(totals.withColumn("d", F.col("d") * band), KEY)
    more = _named(above, [F.col("d") - 1, F.col("q1"), F.col("q2")], **{n: F.col(n) for n in names}).groupBy(*KEY).agg(*(F.sum(n).alias(f"more_{n}") for n in names))
    grown = nodes.join(more, KEY, "left").withColumns({n: F.col(n) + F.coalesce(f"more_{n}", F.lit(0)) for n in names})
    return _in_band(grown, names, band)


def _runs(batch: pa.RecordBatch) -> np.ndarray:
    """Where the runs of equal keys start, and the end."""
    k = np.stack([batch.column(i).to_numpy() for i in range(3)]).astype(np.int64)
    return np.concatenate(([0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [batch.num_rows]))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted ids of each node as strings of at most IDS ids."""
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, edges = batch.column(3).to_numpy(), _runs(batch)
        cuts = sorted({*edges[:-1].tolist(), *range(0, batch.num_rows, IDS)})
        texts = [",".join(map(str, ids[a:b].tolist())) for a, b in zip(cuts, [*cuts[1:], batch.num_rows], strict=True)]
        yield pa.record_batch([*batch.take(pa.array(cuts)).columns[:4], pa.array(texts)], [*KEY, "at", "ids"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's strings in order, fed one after another; nothing of a node is gathered."""
    key, digest = None, None
    for batch in batches:
        out = []
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
        for own, text in zip(keys, batch.column(4), strict=True):
            if own != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(text.as_py().encode())
        if out:
            yield _hash_rows(out)
    if key is not None:
        yield _hash_rows([(*key, digest.hexdigest())])


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.string() if i == 3 else pa.int64()) for i in range(4)], [*KEY, "sha"])


def member_hashes(ends: DataFrame) -> DataFrame:
    """``(d, p1, p2, sha)``: hash of the ascending ids of ``ends (d, p1, p2, conv_id)``, comma-joined, of each node.

    Ids are joined in tasks dealt by node and id, so a node with very many is many tasks' work; only their
    strings, one for thousands of ids, meet in order in one task, which feeds them to the hash.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    whole = [*KEY, "conv_id"]
    texts = ends.repartitionByRange(n, *whole).sortWithinPartitions(*whole).mapInArrow(_joined, "d long, p1 long, p2 long, at long, ids string")
    return texts.repartition(n, *KEY).sortWithinPartitions(*KEY, "at").mapInArrow(_hashed, "d long, p1 long, p2 long, sha string")


def conversation_trie(conversations: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each distinct sequence of first turns of rebuilt conversations: ``(conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256)``.

    Turns are two halves of a digest; a node is a depth and a 128-bit hash of the turns so far, found by prefix
    sums over ranges of the ordered rows, so that a conversation of any length takes many tasks. Counts of
    members come from one grouping that combines before the shuffle; sums over subtrees from :func:`subtree_sums`.

    Defined cases: a null conv_id names no conversation; null turns come first, turns of one place in the order
    of a digest of role and text, and repeated rows are turns of their own; null and empty roles and texts are
    equal; a negative conv_id takes its block by SQL's remainder, toward zero; a conversation left without turns
    ends at the root; a table without conversations gives no rows; no other column is read.
    """
    path = cut(ordered(rebuilt(turns_of(conversations)), [F.col("part"), F.col("turn")]), "paths").withColumnRenamed("place", "d")
    deepest = path.agg(F.max("d")).first()[0] or 0
    rows = path_rows(path.select("conv_id", "d", "p1", "p2", "words", "tail"), band)
    links = [c for c in rows.columns if c[0] in "qa"]
    nodes = cut(
        rows.groupBy(*KEY).agg(
            F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words"), F.count_if("tail").alias("n_ends"),
            F.min(F.when(F.col("tail"), F.col("conv_id"))).alias("first_end"), *(F.min(c).alias(c) for c in links),
        ),
        "nodes",
    )
    children = _named(nodes.where("d > 0"), [F.col("d") - 1, F.col("q1"), F.col("q2")]).groupBy(*KEY).agg(F.count("*").alias("n_children"))
    wide = nodes.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "n_leaves": F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")})
    names = ["n_leaves", "saved_tokens"]
    wide = cut(wide, "nodes")
    sums = subtree_sums(wide, path.select("conv_id", *KEY), names, deepest, band)
    many = wide.where("n_ends > 1").select(*KEY)
    shas = member_hashes(path.where("tail").select(*KEY, "conv_id").join(many, KEY, "left_semi"))
    parents = _named(wide, [F.col("d") + 1, F.col("p1"), F.col("p2")], parent_conv_id=F.col("conv_id")).toDF("d", "q1", "q2", "parent_conv_id")
    sha = F.when(F.col("n_ends") == 0, NOTHING).when(F.col("n_ends") == 1, F.sha2(F.col("first_end").cast("string").cast("binary"), 256)).otherwise(F.col("sha"))
    joined = reduce(lambda a, b: a.join(b[0], b[1], "left"), [(sums, KEY), (shas, KEY), (parents, ["d", "q1", "q2"])], wide.drop(*names))
    return joined.select("conv_id", F.col("d").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
