"""Vector code compression: a codebook for each part of a vector, assigned under Drake-Hamerly adaptive bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import cut

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Components are integers of ``floor(SCALE * x)``; beyond +-LIMIT they count as LIMIT, so that 64 squared differences fit in a long.
SCALE, LIMIT = 256, 1 << 27
#: Slack of bounds that were rounded to half precision or added up.
UP, DOWN = 1 + 2.0**-9, 1 - 2.0**-9
STATE = "vec_id {id}, label {label}, v array<int>, near binary, upper binary, lower binary"


def whole(vector: Column) -> Column:
    """Integer components, null for a vector with a component that is null or not finite."""
    usable = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = lambda x: F.floor(F.greatest(F.least(x.cast("double") * SCALE, F.lit(float(LIMIT))), F.lit(float(-LIMIT)))).cast("int")
    return F.when(vector.isNotNull() & usable, F.transform(vector, scaled))


def squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances ``(parts, n, entries)`` of ``x (parts, n, d)`` to ``c (parts, entries, d)``.

    Where all sums stay below 2**53 a matrix product in doubles is exact; else integers are subtracted.
    """
    top = max(np.abs(x).max(initial=0), np.abs(c).max(initial=0))
    if int(top) ** 2 * 4 * max(x.shape[2], 1) < 1 << 53:
        a, b = x.astype(np.float64), c.astype(np.float64)
        return ((a * a).sum(2)[:, :, None] + (b * b).sum(2)[:, None, :] - 2 * (a @ b.transpose(0, 2, 1))).astype(np.int64)
    out = np.zeros((x.shape[0], x.shape[1], c.shape[1]), np.int64)
    for j in range(x.shape[2]):
        out += (x[:, :, None, j] - c[:, None, :, j]) ** 2
    return out


def halves_up(x: np.ndarray) -> np.ndarray:
    """Half precision, not below ``x``; infinity beyond its range."""
    return np.where(x > 60000, np.inf, x * UP + 2.0**-14).astype(np.float16)


def halves_down(x: np.ndarray) -> np.ndarray:
    """Half precision, not above ``x`` and not negative."""
    return np.where(np.isinf(x), np.inf, np.clip(x * DOWN - 2.0**-14, 0, 60000)).astype(np.float16)


def ranked(d2: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries and squared distances by distance, ties to the lower index; ``ids`` ascend or are given a row."""
    by_id = np.argsort(ids, axis=1, kind="stable")
    d2, ids = np.take_along_axis(d2, by_id, 1), np.take_along_axis(ids, by_id, 1)
    order = np.argsort(d2, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(d2, order, 1)


def opened(d2: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``near``, ``upper`` and ``lower`` of parts whose squared distances to all entries are known.

    ``near`` holds the b closest entries, ``lower`` the bounds of all of them but the first and, last, one
    bound for every other entry (infinite if there is none).
    """
    ids, sorted_d2 = ranked(d2, np.broadcast_to(np.arange(d2.shape[1]), d2.shape))
    roots = np.sqrt(sorted_d2[:, : b + 1].astype(np.float64))
    if d2.shape[1] == b:
        roots = np.concatenate((roots, np.full((len(d2), 1), np.inf)), 1)
    return ids[:, :b].astype(np.uint8), halves_up(roots[:, 0]), halves_down(roots[:, 1:])


def advance(x: np.ndarray, near: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Closest entries after the entries of one part position moved by ``drift``; also how many bounds each row had to pass.

    Bounds decide wherever the upper bound is under the least lower bound; else the own distance is taken
    exactly, and after it those of just the entries whose bounds it does not pass. Only a row that does
    not pass the outer bound (depth b) meets all entries.
    """
    n, b = near.shape
    upper = upper.astype(np.float64) + drift[near[:, 0]] * UP
    lower = lower.astype(np.float64)
    lower[:, :-1] -= drift[near[:, 1:]] * UP
    lower[:, -1] -= drift.max(initial=0) * UP
    lower = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1].copy()  # ascending: a bound is also one for those before it
    near, depth = near.copy(), np.zeros(n, np.int64)
    open_ = np.flatnonzero(upper >= lower[:, 0])
    if len(open_):
        own = ((x[open_] - book[near[open_, 0]]) ** 2).sum(1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + 1e-12)
        depth[open_] = (lower[open_] <= upper[open_, None]).sum(1)
    for j in np.unique(depth[depth > 0]):
        at = np.flatnonzero(depth == j)
        if j == b:
            near[at], up, low = opened(squares(x[None, at], book[None])[0], b)
            upper[at], lower[at] = up.astype(np.float64), low.astype(np.float64)
            continue
        ids = near[at, : j + 1].astype(np.int64)
        ids, d2 = ranked(((x[at, None, :] - book[ids]) ** 2).sum(2), ids)
        near[at, : j + 1] = ids
        roots = np.sqrt(d2.astype(np.float64))
        upper[at], lower[at, :j] = roots[:, 0] * (1 + 1e-12), roots[:, 1:] * (1 - 1e-12)
    lower = np.minimum.accumulate(lower[:, ::-1], 1)[:, ::-1]
    return near, halves_up(upper), halves_down(lower), depth


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Integer vectors ``(PARTS, n, width / PARTS)``; shorter ones end in zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(column), width), np.int64)
    out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out.reshape(len(column), PARTS, width // PARTS).transpose(1, 0, 2)


def _binary(rows: np.ndarray) -> pa.Array:
    """One binary value a row of an array ``(n, ...)``."""
    rows = np.ascontiguousarray(rows)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 2048) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _first(book: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = max(1, book.shape[1] // 4)
        for batch in _slices(batches):
            d2 = squares(_matrix(batch.column(2), width), book)
            near, upper, lower = (np.stack(x, 1) for x in zip(*(opened(own, b) for own in d2), strict=True))
            yield pa.record_batch([*batch.columns[:3], _binary(near), _binary(upper), _binary(lower)], ["vec_id", "label", "v", "near", "upper", "lower"])

    return run


def next_b(b: int, depth: np.ndarray, k: int) -> np.ndarray:
    """How many entries each vector keeps from now on, by the bounds ``depth (n, PARTS)`` its parts had to pass.

    Twice as many, at most half of all, if a quarter of the parts met all entries; half as many, at
    least an eighth of all, if no part needed half of its bounds.
    """
    more = ((depth == b).mean(1) >= 0.25) & (2 * b <= max(k // 2, 1))
    fewer = (depth.max(1) * 2 < b) & (b // 2 >= max(k // 8, 1))
    return np.where(more, 2 * b, np.where(fewer, b // 2, b))


def _again(old: np.ndarray, new: np.ndarray, width: int, last: bool):
    """The next assignment from bounds; the last one gives codes and errors instead of bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drift = np.sqrt(((old - new) ** 2).sum(2).astype(np.float64)) * (1 + 1e-12)
        k = new.shape[1]
        for whole_batch in _slices(batches):
            sizes = np.array([len(x) for x in whole_batch.column(3).to_pylist()])
            for size in np.unique(sizes):  # vectors that keep the same number of entries
                batch = whole_batch.filter(pa.array(sizes == size))
                n, b = batch.num_rows, int(size) // PARTS
                x = _matrix(batch.column(2), width)
                near = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint8).reshape(n, PARTS, b)
                upper = np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float16).reshape(n, PARTS)
                lower = np.frombuffer(b"".join(batch.column(5).to_pylist()), np.float16).reshape(n, PARTS, b)
                found = [advance(x[p], near[:, p], upper[:, p], lower[:, p], new[p], drift[p]) for p in range(PARTS)]
                near, upper, lower, depth = (np.stack(f, 1) for f in zip(*found, strict=True))
                if last:
                    codes = near[:, :, 0]
                    error = sum(((x[p] - new[p][codes[:, p]]) ** 2).sum(1) for p in range(PARTS))
                    yield pa.record_batch([*batch.columns[:2], pa.array([c.tobytes().hex() for c in np.ascontiguousarray(codes)]), pa.array(error)], ["vec_id", "label", "code", "error"])
                    continue
                keep = next_b(b, depth, k)
                for c in np.unique(keep):
                    at = np.flatnonzero(keep == c)
                    if c <= b:  # the first entry left out bounds all that are
                        own = (near[at][:, :, :c], upper[at], lower[at][:, :, :c])
                    else:
                        own = tuple(np.stack(f, 1) for f in zip(*(opened(d2, c) for d2 in squares(x[:, at], new)), strict=True))
                    yield pa.record_batch([*batch.take(pa.array(at)).columns[:3], *map(_binary, own)], ["vec_id", "label", "v", "near", "upper", "lower"])

    return run


def _sums(k: int, width: int):
    """Sums and counts by part position and entry of a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = width // PARTS
        sums, counts = np.zeros((PARTS, k, d), np.int64), np.zeros((PARTS, k), np.int64)
        for batch in _slices(batches):
            x = _matrix(batch.column(0), width)
            codes = np.array([np.frombuffer(r, np.uint8)[:: len(r) // PARTS] for r in batch.column(1).to_pylist()], np.int64)
            for p in range(PARTS):
                np.add.at(sums[p], codes[:, p], x[p])
                counts[p] += np.bincount(codes[:, p], minlength=k)
        p, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _mean_book(state: DataFrame, book: np.ndarray, width: int) -> np.ndarray:
    """The codebook of the parts' floored means; what no part uses stays. At most PARTS * ENTRIES rows come back."""
    rows = state.select("v", "near").mapInArrow(_sums(book.shape[1], width), "part int, entry int, n long, sums array<long>")
    exact = lambda c: F.sum(c.cast("decimal(19,0)"))  # noqa: E731  sums of all tasks may not fit in a long
    means = (
        rows.select("part", "entry", "n", F.posexplode("sums").alias("at", "x"))
        .groupBy("part", "entry", "at").agg(exact(F.col("x")).alias("x"), F.sum("n").alias("n"))
        .toPandas()
    )
    out = book.copy()
    for p, e, at, x, n in means.itertuples(index=False):
        out[p, e, at] = int(x) // int(n)
    return out


def codebook_hash(book: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """Codes of every usable row of ``vectors (vec_id, embedding, label)``: ``(vec_id, code, error, label_error, codebooks_sha256)``.

    Each of 16 part positions has a codebook of at most 64 entries, which starts as the parts of the least
    vec_ids. A round assigns every part to the nearest entry and moves entries to the floored mean of
    their parts; one more assignment ends it. Assignments keep, in the shared folder, each part's b closest
    entries with ordered lower bounds and one outer bound for all others: after a move, parts whose bounds
    decide meet no entry at all, others are verified in integers against as few as their bounds leave open.
    b starts at a quarter of the entries and follows each vector's need between an eighth and a half. Only
    codebooks pass the driver: 64 rows at the start, the entries' means after each round.

    Defined cases: rows whose vector is null or holds null or non-finite components are dropped; vectors
    shorter than the longest, or no multiple of 16, end in zeros; components beyond +-2**27 / 256 count as
    that; a null vec_id is coded, and starts a codebook only after all others; rows with one vec_id are coded
    each, and start a codebook in the order of their components; with fewer than 64 rows the codebook has as
    many entries; sums beyond a long give a null label_error; no usable rows give no rows; no other column is read.
    """
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    kept = vectors.select("vec_id", "label", whole(F.col("embedding")).alias("v")).where("v is not null")
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    width = -(-max(longest or 0, 1) // PARTS) * PARTS
    least = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(ENTRIES).select("v").toArrow().column(0).combine_chunks()
    final = "vec_id {id}, label {label}, code string, error long".format(id=kinds["vec_id"], label=kinds["label"])
    state = STATE.format(id=kinds["vec_id"], label=kinds["label"])
    if len(least) == 0:
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).where("false")
        book = np.zeros((PARTS, 0, 1), np.int64)
    else:
        book = _matrix(least, width)
        own = cut(kept.mapInArrow(_first(book, width), state), "codes")
        for r in range(rounds):
            moved = _mean_book(own, book, width)
            last = r == rounds - 1
            own = cut(own.mapInArrow(_again(book, moved, width, last), final if last else state), "codes")
            book = moved
        coded = own
    totals = coded.groupBy(F.col("label").alias("own_label")).agg(F.try_sum("error").alias("label_error"))
    joined = coded.join(totals, coded["label"].eqNullSafe(totals["own_label"]))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(codebook_hash(book)).alias("codebooks_sha256"))
