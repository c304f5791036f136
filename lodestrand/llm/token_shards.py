"""Training-order token shards: a keyed permutation deals packed sequences to fixed-stride files."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrand.llm.common import as_bytes, fresh_path, mix, qualified, tokenizer_path
from lodestrand.llm.warc import open_folder

TOKENIZER = "byte_bpe_50k.tiktoken"
END = 50256  # free in the vocabulary; ends each document and fills the last sequence
UNIT = "<u2"


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(text: str, path: str) -> list[int]:
    """Ids of a whole text; strings of special tokens are ordinary text."""
    return _encoding(path).encode_ordinary(text)


class Feistel:
    """A keyed permutation of ``range(n)``: Feistel rounds on a power of four, walked until inside."""

    def __init__(self, n: int, key: int, rounds: int = 6):
        self.n = n
        self.half = max(1, ((max(n - 1, 1)).bit_length() + 1) // 2)
        keys = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(key & (2**64 - 1))
        self.keys = mix(keys)

    def _round(self, right: np.ndarray, key: np.uint64) -> np.ndarray:
        return mix(right + key) >> np.uint64(64 - self.half)

    def _once(self, x: np.ndarray) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64((1 << self.half) - 1)
        for key in self.keys:
            left, right = right, left ^ self._round(right, key)
        return (left << half) | right

    def _back(self, x: np.ndarray) -> np.ndarray:
        half = np.uint64(self.half)
        left, right = x >> half, x & np.uint64((1 << self.half) - 1)
        for key in self.keys[::-1]:
            left, right = right ^ self._round(left, key), left
        return (left << half) | right

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        out = step(np.asarray(x).astype(np.uint64))
        while (outside := out >= self.n).any():
            out[outside] = step(out[outside])
        return out.astype(np.int64)

    def slot(self, sequence: np.ndarray) -> np.ndarray:
        return self._walk(sequence, self._once)

    def sequence(self, slot: np.ndarray) -> np.ndarray:
        return self._walk(slot, self._back)


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, docs, seen = 0, 0, xxhash.xxh3_64()
        for batch in batches:
            for text in batch.column(0):
                b = text.as_py() or b""
                seen.update(b + b"\0")
                total += len(encoded(b.decode("utf-8", "replace"), path)) + 1
                docs += 1
        yield pa.record_batch(
            [pa.array([v], t) for v, t in ((TaskContext.get().partitionId(), pa.int32()), (total, pa.int64()), (docs, pa.int64()), (seen.hexdigest(), pa.string()))],
            ["part", "tokens", "docs", "seen"],
        )

    return run


def _deal(path: str, starts, length: int, feistel: Feistel, per_shard: int):
    """Pieces of sequences: the whole ones of a partition's tokens and what it shares with its neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = xxhash.xxh3_64()
        start, tokens, expected = starts.value.get(TaskContext.get().partitionId(), (0, 0, None))
        at, end = start, np.array([END], UNIT).tobytes()
        held = bytearray()
        pack = zstandard.ZstdCompressor(level=1).compress

        def take(last: bool) -> pa.RecordBatch:
            nonlocal at, held
            ids = np.frombuffer(bytes(held), UNIT)
            cuts = [0]
            while (size := length - (at + cuts[-1]) % length) and cuts[-1] + size <= len(ids):
                cuts.append(cuts[-1] + size)
            if last and cuts[-1] < len(ids):
                cuts.append(len(ids))
            first = (at + np.array(cuts[:-1], np.int64)) if len(cuts) > 1 else np.zeros(0, np.int64)
            # low and high bytes apart compress better
            data = [pack(ids[a:b].view(np.uint8).reshape(-1, 2).T.tobytes()) for a, b in zip(cuts, cuts[1:])]
            slots = feistel.slot(first // length) if len(first) else first
            held = bytearray(ids[cuts[-1] :].tobytes())
            at += cuts[-1]
            return pa.record_batch(
                [pa.array((slots // per_shard).astype(np.int32)), pa.array(slots), pa.array((first % length).astype(np.int32)), pa.array(data, pa.binary())],
                ["shard", "slot", "place", "ids"],
            )

        for batch in batches:
            for text in batch.column(0):
                b = text.as_py() or b""
                seen.update(b + b"\0")
                held += np.array(encoded(b.decode("utf-8", "replace"), path), UNIT).tobytes() + end
                if len(held) >= 1 << 21:
                    yield take(False)
        yield take(True)
        if at - start != tokens or (expected is not None and seen.hexdigest() != expected):
            raise RuntimeError("the documents changed between two reads; write them to a table first")

    return run


def _write(folder: str, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        mark = f"{TaskContext.get().partitionId():06d}-{TaskContext.get().attemptNumber()}-{TaskContext.get().taskAttemptId()}"
        unpack = zstandard.ZstdDecompressor().decompress
        out, shard, slot, row, count = None, None, None, None, 0
        done: list[tuple] = []

        def end_row() -> None:
            nonlocal count
            if row is not None:
                out.write(row.tobytes())
                count += 1

        def end_shard() -> None:
            nonlocal out, row, count
            if out is not None:
                end_row()
                out.close()
                done.append((shard, name, count))
            out, row, count = None, None, 0

        name = ""
        for batch in batches:
            for s, t, place, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if s != shard:
                    end_shard()
                    shard, slot, name = s, None, f"shard-{s:06d}-{mark}.bin"
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                if t != slot:
                    end_row()
                    slot, row = t, np.full(length, END, UNIT)
                part = np.frombuffer(unpack(ids), np.uint8).reshape(2, -1).T.copy().view(UNIT).ravel()
                row[place : place + len(part)] = part
        end_shard()
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.int32(), pa.string(), pa.int64()))], ["shard", "file", "n_sequences"])

    return run


def _read(folder: str, length: int, per_shard: int, feistel: Feistel, tokens: bool):
    names = ["slot", "sequence", "shard", "byte_offset", "n_tokens", "crc32", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        stride = length * 2
        for batch in batches:
            for shard, name, count in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_input_stream(f"{path}/{name}", compression=None) as data:
                    for first in range(0, count, 1024):
                        n = min(1024, count - first)
                        block = data.read(n * stride)
                        if len(block) != n * stride:
                            raise ValueError(f"{name} is too short")
                        rows = [block[i * stride : (i + 1) * stride] for i in range(n)]
                        slots = np.arange(first, first + n) + shard * per_shard
                        yield pa.record_batch(
                            [
                                pa.array(slots), pa.array(feistel.sequence(slots)), pa.array(np.full(n, shard, np.int32)),
                                pa.array((np.arange(first, first + n) * stride).astype(np.int64)), pa.array(np.full(n, length, np.int32)),
                                pa.array([zlib.crc32(r) for r in rows], pa.int64()), pa.array(rows if tokens else [None] * n, pa.binary()),
                            ],
                            names,
                        )

    return run


ROWS = "slot long, sequence long, shard int, byte_offset long, n_tokens int, crc32 long, ids binary"


class Shards:
    """Written shards: a folder that tells all that is needed to read it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        system, path = open_folder(folder)
        with system.open_input_stream(f"{path}/index.json") as data:
            index = json.loads(data.read())
        self.n_sequences, self.length, self.per_shard, self.key, self.n_tokens, self.n_shards = (
            index[x] for x in ("sequences", "length", "per_shard", "key", "tokens", "shards")
        )

    @property
    def files(self) -> DataFrame:
        """``(shard, file, n_sequences)`` of the tasks that ended."""
        return self.spark.read.schema("shard int, file string, n_sequences long").parquet(f"{self.folder}/manifest")

    def read(self, tokens: bool = True) -> DataFrame:
        """All sequences in rows ``(slot, sequence, shard, byte_offset, n_tokens, crc32, ids)``, a task for each shard."""
        rows = self.files.select("shard", "file", "n_sequences").repartitionById(max(1, self.n_shards), "shard")
        return rows.mapInArrow(_read(self.folder, self.length, self.per_shard, Feistel(max(self.n_sequences, 1), self.key), tokens), ROWS)


def write_shards(
    docs: DataFrame,
    folder: str | None = None,
    length: int = 2048,
    shard_bytes: int = 64 << 20,
    key: int = 20240501,
    tokenizer: str | None = None,
) -> Shards:
    """Write the documents' token ids as fixed-stride shards in training order.

    Documents, each ended by END, form one stream in the order of the partitions; every ``length``
    ids are a sequence, the last one is filled with END. A first pass counts the tokens of each
    partition, which gives every partition its place in the stream and the number of sequences. A
    keyed Feistel permutation of exactly that many (cycle-walking) gives each sequence its slot.
    The second pass encodes again and sends each sequence once, compressed, to the task of its
    range of slots; that task writes the range as one file, so slot s is found at
    ``s % per_shard * length * 2`` of shard ``s // per_shard`` and a reader can resume anywhere.

    ``docs`` must give the same partitions when read again (tables and files do); a partition whose
    hash differs from the first pass is an error. A repeated task writes a file of its own; the table
    ``manifest`` names those of the tasks that ended, and ``index.json`` is moved into place last, so
    a folder that has one is whole and is read by itself (:class:`Shards`) whatever else lies in it.

    Defined cases: null and empty texts are an END alone; repeated rows are written again; an empty
    table writes no shard; columns other than text are ignored.
    """
    spark = docs.sparkSession
    path = tokenizer or tokenizer_path(TOKENIZER)
    folder = qualified(spark, folder or fresh_path(spark, "shards"))
    system, where = open_folder(folder)
    system.create_dir(where, recursive=True)
    texts = docs.select(as_bytes().alias("text"))
    counts = texts.mapInArrow(_count(path), "part int, tokens long, docs long, seen string").toPandas().sort_values("part")  # a row for each partition
    starts = dict(zip(counts["part"], zip(counts["tokens"].cumsum() - counts["tokens"], counts["tokens"], counts["seen"], strict=True), strict=True))
    total = int(counts["tokens"].sum())
    n = -(-total // length)
    per_shard = max(1, shard_bytes // (2 * length))
    n_shards = -(-n // per_shard)
    feistel = Feistel(max(n, 1), key)
    pieces = texts.mapInArrow(
        _deal(path, spark.sparkContext.broadcast(starts), length, feistel, per_shard), "shard int, slot long, place int, ids binary"
    )
    dealt = pieces.repartitionById(max(1, n_shards), "shard").sortWithinPartitions("shard", "slot", "place")
    dealt.mapInArrow(_write(folder, length), "shard int, file string, n_sequences long").write.mode("overwrite").parquet(f"{folder}/manifest")
    index = {"sequences": n, "length": length, "per_shard": per_shard, "shards": n_shards, "tokens": total, "key": key, "unit": UNIT, "end": END}
    with system.open_output_stream(f"{where}/index.json.part") as out:
        out.write(json.dumps(index).encode())
    system.move(f"{where}/index.json.part", f"{where}/index.json")
    return Shards(spark, folder)


def token_shards(docs: DataFrame, **settings) -> DataFrame:
    """Write shards and read them back: a row for each sequence, without its ids."""
    return write_shards(docs, **settings).read(tokens=False).drop("ids")
