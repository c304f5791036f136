"""WARC archives with dictionary-compressed records."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrand.llm.common import cut, fresh_path, qualified

#: Skippable frame that holds the dictionary, as the WARC/Zstandard format has it.
DICT_MAGIC = 0x184D2A5D
MANIFEST = "archive string, n_records long, n_bytes long"
RECORD = "page_key string, url string, record_type string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI (:func:`lodestrand.llm.common.qualified`)."""
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri.removeprefix('file:')}")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(value: str) -> str:
    return " ".join((value or "").split())


def render(row: dict, payload: bytes, digest: str, serial: str = "") -> bytes:
    """One WARC/1.1 record; a revisit has headers only.

    A response is named by its page and payload, which no other response has; a revisit by ``serial`` too.
    """
    revisit = row["refers_to"] is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{row['page_key']}:{digest}{f':{serial}' if revisit else ''}>",
        f"WARC-Target-URI: {_line(row['url'])}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{row['refers_to']}:{digest}>"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(record: bytes) -> dict:
    """A record's fields; a response whose payload does not match its digest is an error."""
    head, _, body = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    payload = body[: int(fields["Content-Length"])]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and sha1_base32(payload) != digest:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    key = lambda v: v.removeprefix("<urn:page:").rpartition(f":{digest}")[0] if v else None
    return {
        "page_key": key(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "refers_to": key(fields.get("WARC-Refers-To")), "payload_digest": digest,
        "payload_bytes": int(fields["X-Payload-Length"]), "payload": None if revisit else payload,
    }


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; where there is too little to train on, the samples' own bytes."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:size]


def _write(folder: str, archive_bytes: int, sample_bytes: int, dict_bytes: int, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        part = TaskContext.get().partitionId()
        # another attempt writes files of its own; only those of the attempt that ended are listed
        attempt = f"{part:06d}-{TaskContext.get().attemptNumber()}-{uuid.uuid4().hex[:12]}"
        held: list[bytes] = []
        held_bytes = written = serial = count = 0
        out = compressor = None
        done: list[tuple[str, int, int]] = []

        def start() -> None:
            nonlocal out, compressor, written, serial, name
            dictionary = build_dictionary(held, dict_bytes)
            compressor = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
            packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
            name = f"pages-{attempt}-{serial:04d}.warc.zst"
            serial += 1
            out = system.open_output_stream(f"{path}/{name}", compression=None)
            out.write(struct.pack("<II", DICT_MAGIC, len(packed)) + packed)
            written = 8 + len(packed)
            for record in held:
                put(record)
            held.clear()

        def put(record: bytes) -> None:
            nonlocal written, count
            frame = compressor.compress(record)
            out.write(frame)
            written += len(frame)
            count += 1

        def finish() -> None:
            nonlocal out, count, held_bytes
            out.close()
            done.append((name, count, written))
            out, count, held_bytes = None, 0, 0

        name, n = "", 0
        for batch in batches:
            for row in batch.to_pylist():
                payload = row.pop("payload") or b""
                record = render(row, payload, sha1_base32(payload), f"{attempt}-{n}")
                n += 1
                if out is None:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= sample_bytes:
                        start()
                else:
                    put(record)
                    if written >= archive_bytes:
                        finish()
        if held:
            start()
        if out is not None:
            finish()
        yield pa.record_batch([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    return run


#: Bytes read at once; what follows a frame is copied, so not many of them.
STEP = 1 << 15


def frames(data) -> Iterator[bytes]:
    """Records of an open archive, one frame at a time."""
    magic, size = struct.unpack("<II", data.read(8))
    if magic != DICT_MAGIC:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(data.read(size))
    opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    rest = b""
    while True:
        if not rest and not (rest := data.read(STEP)):
            return
        one = opener.decompressobj()
        parts = []
        while not one.eof:
            parts.append(one.decompress(rest))
            rest = one.unused_data if one.eof else data.read(STEP)
            if not one.eof and not rest:
                raise ValueError("archive ends inside a record")
        yield b"".join(parts)


def _read(folder: str, payloads: bool):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [pa.string()] * 5 + [pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[dict] = []
                with system.open_input_stream(f"{path}/{name}", compression=None) as data:
                    for record in frames(data):
                        rows.append(parse(record) if payloads else parse(record) | {"payload": None})
                        if len(rows) >= 500:
                            yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)
                            rows = []
                if rows:
                    yield pa.record_batch([pa.array([r[n] for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    return run


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What each page becomes: ``(page_key, url, refers_to, payload)``; ``refers_to`` is null in responses.

    Of pages with equal payloads of ``least_bytes`` or more the smallest page_id is the response
    (nulls last; of rows that share it, one of the smallest url), the others revisit it. Payload
    hashes are grouped with partial sums and only the shared ones are kept, so a payload of a third
    of all pages is one row to join, and its pages can be split.
    """
    rows = pages.select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).select("*", F.sha2("payload", 256).alias("hash"), F.octet_length("payload").alias("size"))
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.coalesce("url", F.lit("")).alias("url"))
    shared = cut(
        rows.where(F.col("size") >= least_bytes)
        .groupBy("hash", rank.alias("rank")).agg(F.count("*").alias("n"))
        .groupBy("hash").agg(F.min(F.struct("rank", "n")).alias("first"), F.sum("n").alias("copies"))
        .where("copies > 1").select("hash", "first"),
        "shared",
    )
    key = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    joined = rows.join(shared, "hash", "left")
    leads = F.coalesce(F.col("first.rank").eqNullSafe(rank), F.lit(False))
    revisits = F.col("first").isNotNull() & ~leads
    if shared.where("first.n > 1").isEmpty():
        return joined.select(
            key(F.col("page_id")).alias("page_key"), "url", F.when(revisits, key(F.col("first.rank.page_id"))).alias("refers_to"), "payload"
        )
    # rows that repeat the first page: the first of n is the response
    repeated = leads & (F.col("first.n") > 1)
    plain = joined.where(~repeated).select(
        key(F.col("page_id")).alias("page_key"), "url", F.when(revisits, key(F.col("first.rank.page_id"))).alias("refers_to"), "payload"
    )
    again = (
        joined.where(repeated).groupBy("hash").agg(*(F.first(c).alias(c) for c in ("page_id", "url", "payload", "first")))
        .select("*", F.explode(F.sequence(F.lit(1), F.col("first.n"))).alias("i"))
    )
    return plain.unionByName(
        again.select(key(F.col("page_id")).alias("page_key"), "url", F.when(F.col("i") > 1, key(F.col("page_id"))).alias("refers_to"), "payload")
    )


def write_archives(
    pages: DataFrame,
    folder: str,
    least_bytes: int = 0,
    archive_bytes: int = 256 << 20,
    sample_bytes: int = 2 << 20,
    dict_bytes: int = 64 << 10,
    level: int = 3,
) -> DataFrame:
    """Write one WARC record per page below ``folder`` and return the list of archives.

    Each task writes archives of its own, of about ``archive_bytes``. The first ``sample_bytes`` of
    an archive's records train its dictionary, which leads it in a skippable frame (it serves all
    records; those beyond the sample only compress less well if they differ); each record is
    a frame, so a reader needs nothing but the file. The list names files of finished tasks only,
    so a repeated task leaves no records twice.
    """
    folder = qualified(pages.sparkSession, folder)
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    rows = plan_records(pages, least_bytes)
    return cut(rows.mapInArrow(_write(folder, archive_bytes, sample_bytes, dict_bytes, level), MANIFEST), "manifest")


def read_archives(manifest: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """Records of the listed archives, about one archive a task."""
    folder = qualified(manifest.sparkSession, folder)
    return manifest.select("archive").repartition(max(1, manifest.count()), "archive").mapInArrow(_read(folder, payloads), RECORD)


def archive_pages(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write every page to WARC archives and read them back: ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``.

    One row per input row. Defined cases: null html is an empty payload; a null page_id is written
    as ``null``, sorts last and comes back null; of repeated rows one is the response; a line
    break in a url becomes a blank; an empty table writes no archive; other columns are ignored.
    """
    kind = pages.schema["page_id"].dataType
    folder = folder or fresh_path(pages.sparkSession, "warc")
    manifest = write_archives(pages, folder, least_bytes)
    known = lambda c: F.when(F.col(c) != "null", F.col(c)).cast(kind)
    return read_archives(manifest, folder, payloads=False).select(
        known("page_key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", known("refers_to").alias("refers_to")
    )
