"""Exact vector search: cells of vectors with a radius, and query blocks that meet tiles of cells they can reach."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.operators.lexical import top_k
from lodestrand.session import cut

#: Slack of bounds against rounding.
SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column of equal lengths."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def in_cells(vectors: DataFrame, cells: int) -> tuple[DataFrame, np.ndarray, list]:
    """Vectors with their cell, the cells' pivots, and ``(cell, n, radius)`` of each.

    Pivots are the vectors of the least hashes of chunk_id, at most ``cells``: they and the cells' extents
    are all that comes to the driver. A cell holds the vectors whose pivot is nearest.
    """
    spark = vectors.sparkSession
    pivots = _matrix(vectors.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(cells).select("vector").toArrow().column(0).combine_chunks())
    held = spark.sparkContext.broadcast(pivots)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1))
            near = (2 * x @ held.value.T - (held.value**2).sum(1)).argmax(1)
            away = np.sqrt(((x - held.value[near]) ** 2).sum(1))
            yield pa.record_batch([*batch.columns, pa.array(near, pa.int32()), pa.array(away)], [*batch.schema.names, "cell", "away"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in vectors.schema)
    placed = cut(vectors.mapInArrow(assign, f"{kinds}, cell int, away double"), "cells")
    return placed, pivots, placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("radius")).collect()


def reachable(queries: DataFrame, pivots: np.ndarray, extents: list, least: float, tile: int) -> DataFrame:
    """``queries`` with each ``(cell, tile)`` that may hold a vector of a similarity of at least ``least``.

    By Cauchy and Schwarz q.x = q.p + q.(x - p) <= q.p + |q| r for all x within r of the pivot p.
    """
    held = queries.sparkSession.sparkContext.broadcast((pivots, [(r.cell, -(-r.n // tile), r.radius) for r in extents]))
    names = queries.columns
    at = names.index("vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, cells = held.value
        ids, tiles, radius = (np.array(x) for x in zip(*cells, strict=True))
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(at))
            rows, cols = np.nonzero(q @ pivots[ids].T + np.sqrt((q * q).sum(1))[:, None] * radius >= least - SLACK)
            n = tiles[cols]
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            for start in range(0, len(which), 4096):
                own = slice(start, start + 4096)
                picked = batch.take(pa.array(np.repeat(rows, n)[own]))
                yield pa.record_batch([*picked.columns, pa.array(ids[np.repeat(cols, n)[own]], pa.int32()), pa.array(which[own], pa.int32())], [*names, "cell", "tile"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in queries.schema)
    return queries.mapInArrow(run, f"{kinds}, cell int, tile int")


def best_of_tiles(k: int, least: float, masked: bool):
    """For rows sorted by tile, vectors before queries: the ``k`` best vectors of a tile for each of its queries.

    A tile's vectors are a bounded number and are held; queries pass by in batches.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, names, open_to, matrix = None, [], [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]) if batch.num_rows else np.zeros((3, 0))
            edges = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            for a, b in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                if a == b:
                    continue
                rows = batch.slice(a, b - a)
                own = tuple(keys[:2, a])
                if own != key:
                    key, parts, names, open_to, matrix = own, [], [], [], None
                if keys[2, a] == 0:
                    parts.append(_matrix(rows.column(5)))
                    names += rows.column(3).to_pylist()
                    open_to += rows.column(6).to_pylist() if masked else []
                    continue
                if not parts:
                    continue
                if matrix is None:
                    matrix = np.concatenate(parts)
                scores = np.round(_matrix(rows.column(5)) @ matrix.T, 9)
                if masked:
                    asked = rows.column(7).to_pylist()
                    for f in set(asked):
                        shut = [f not in (x or ()) for x in open_to]
                        scores[np.ix_([x == f for x in asked], shut)] = -np.inf
                found: tuple[list, list, list] = ([], [], [])
                cut_at = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
                for q, line, low in zip(rows.column(4).to_pylist(), scores, cut_at, strict=True):
                    best = sorted((-line[i], names[i]) for i in np.flatnonzero((line >= low) & (line >= least)))[:k]
                    for s, name in best:
                        for column, value in zip(found, (q, name, -s), strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(found[0], batch.schema.field(4).type), pa.array(found[1], batch.schema.field(3).type), pa.array(found[2], pa.float64())], ["query_id", "chunk_id", "score"])

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 3, least: float = 0.22, cells: int = 64, tile: int = 4096) -> DataFrame:
    """Cosine top ``k`` per query with a similarity of at least ``least``: ``(query_id, chunk_id, score, rank)``.

    ``queries (query_id, vector)`` and ``vectors (chunk_id, vector)`` hold unit vectors; a zero query
    has no hits. If ``vectors`` has ``open_to``, the filter_ids that let the chunk through, only chunks
    open to a query's ``filter_id`` count for it, before the cut at ``k``.

    Vectors are read once into cells and dealt in tiles of about ``tile``, so a crowded cell is many tasks'
    work; a query goes to the tiles of just those cells that its bound reaches. A task multiplies a tile with the queries
    that came to it and keeps the best ``k`` of each; no pair of all queries and vectors is stored, and
    neither queries nor vectors come to the driver. Scores are compared at nine digits, ties by chunk_id.
    """
    masked = "open_to" in vectors.columns
    asked = queries.where(F.exists("vector", lambda x: x != 0)).select("query_id", "vector", *(["filter_id"] if masked else []))
    chunk, query = vectors.schema["chunk_id"].dataType, queries.schema["query_id"].dataType
    placed, pivots, extents = in_cells(vectors.where("vector is not null").select("chunk_id", "vector", *(["open_to"] if masked else [])), cells)
    shape = f"query_id {query.simpleString()}, chunk_id {chunk.simpleString()}, score double"
    if not extents:
        return top_k(queries.sparkSession.createDataFrame([], shape), k)
    counts = {r.cell: -(-r.n // tile) for r in extents}
    tiles = F.array(*(F.lit(counts.get(i, 1)) for i in range(len(pivots))))
    empty = lambda name, kind: F.lit(None).cast(kind).alias(name)
    own = placed.select(
        "cell", F.pmod(F.xxhash64("chunk_id"), F.get(tiles, F.col("cell"))).cast("int").alias("tile"), F.lit(0).alias("side"), "chunk_id", empty("query_id", query), "vector",
        *(["open_to", empty("filter_id", queries.schema["filter_id"].dataType)] if masked else []),
    )
    theirs = reachable(asked, pivots, extents, least, tile).select(
        "cell", "tile", F.lit(1).alias("side"), empty("chunk_id", chunk), "query_id", F.col("vector").cast(vectors.schema["vector"].dataType).alias("vector"),
        *([empty("open_to", vectors.schema["open_to"].dataType), "filter_id"] if masked else []),
    )
    dealt = own.unionByName(theirs).repartition("cell", "tile").sortWithinPartitions("cell", "tile", "side")
    return top_k(dealt.mapInArrow(best_of_tiles(k, least, masked), shape), k)
