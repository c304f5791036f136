"""Readers and writers: Markdown corpora, uploads, registries, cases, reports and versioned indexes."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import strip

#: Domain and category of the built-in corpus by file stem (fixed values).
CLASSIFICATION = {
    "campus_card": ("campus_service", "campus_card"),
    "laboratory": ("facility", "laboratory"),
    "library": ("campus_service", "library"),
    "scholarship": ("academic", "scholarship"),
    "transcript": ("academic", "transcript"),
}
REGISTRY = (
    "document_id string, display_name string, extension string, content_type string, size_bytes long, sha256 string, created_at string, "
    "chunk_count int, domain string, category string, visibility string, version string"
)
REGISTRY_DEFAULTS = {"domain": "uploaded", "category": "general", "visibility": "public", "version": "1"}


def read_markdown_corpus(spark: SparkSession, folder: str, classification: Mapping[str, tuple[str, str]] = CLASSIFICATION, default: tuple[str, str] = ("campus_service", "general")) -> DataFrame:
    """Built-in documents of all ``*.md`` files; an empty folder is an error."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_name").alias("source_name"))
    if files.isEmpty():
        raise FileNotFoundError(f"no Markdown file in {folder}")
    stem = F.regexp_replace("source_name", r"\.md$", "")
    named = spark.createDataFrame([(k, *v) for k, v in classification.items()] or [("", "", "")], "title string, domain string, category string")
    rows = files.select(F.concat(F.lit("builtin-"), stem).alias("document_id"), "source_name", stem.alias("title"), "text")
    known = rows.join(F.broadcast(named), "title", "left")  # a table of the caller's literals
    return known.select("document_id", "source_name", "title", "text", F.coalesce("domain", F.lit(default[0])).alias("domain"), F.coalesce("category", F.lit(default[1])).alias("category"), F.lit("public").alias("visibility"), F.lit("1").alias("version"), F.lit("built_in").alias("origin"))


def read_upload_files(spark: SparkSession, folder: str) -> DataFrame:
    """``(filename, data, size_bytes, modified_at)`` of uploaded files."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.col("content").alias("data"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def registry_rows(rows: DataFrame) -> DataFrame:
    """Valid registry rows with the defaults of late fields, newest first; invalid rows are left out."""
    filled = rows.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in REGISTRY_DEFAULTS.items()})
    created = F.try_to_timestamp("created_at")
    valid = (
        F.col("document_id").rlike(r"\A[0-9a-f]{32}\z") & F.col("sha256").rlike(r"\A[0-9a-f]{64}\z") & F.col("display_name").isNotNull()
        & F.col("extension").isin(".md", ".txt", ".pdf") & (F.col("size_bytes") >= 0) & (F.col("chunk_count") >= 0) & created.isNotNull()
    )
    return filled.where(F.coalesce(valid, F.lit(False))).withColumn("created_at", created).orderBy(F.desc("created_at"), "document_id")


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    return registry_rows(spark.read.schema(REGISTRY).option("multiLine", True).json(path))


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """``(source_file, source_line, json)`` of JSONL files without blank lines and comments.

    Files are split by byte ranges like any text, and lines keep their numbers: rows of a range are numbered in
    their task, and a range starts after the lines of the ranges before it, one row each.
    """
    place = {"file": F.col("_metadata.file_path"), "source_file": F.col("_metadata.file_name"), "start": F.col("_metadata.file_block_start"), "n": F.monotonically_increasing_id()}
    rows = spark.read.text(path).select(F.col("value").alias("json"), *(c.alias(n) for n, c in place.items()))
    ranges = rows.groupBy("file", "start").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = F.sum("lines").over(W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    placed = ranges.select("file", "start", "first", F.coalesce(before, F.lit(0)).alias("before"))
    text = strip(F.col("json"))
    some = rows.where((text != "") & ~text.startswith("#"))
    return some.join(placed, ["file", "start"]).select("source_file", (F.col("before") + F.col("n") - F.col("first") + 1).alias("source_line"), "json")


def write_eval_report(results: DataFrame, summary: DataFrame | Callable[[DataFrame], DataFrame], out: str) -> DataFrame:
    """All results, the failed ones and the summary as compressed JSON below ``out``; gives the results as written.

    ``results`` are computed once, however they were made: failures, and ``summary`` where it is a function of
    results, come from what was written.
    """
    results.write.mode("overwrite").option("compression", "gzip").json(f"{out}/results")
    written = results.sparkSession.read.schema(results.schema).json(f"{out}/results")
    written.where(F.size("failures") > 0).write.mode("overwrite").option("compression", "gzip").json(f"{out}/failures")
    (summary(written) if callable(summary) else summary).write.mode("overwrite").option("compression", "gzip").json(f"{out}/summary")
    return written


def write_baseline(summary: DataFrame, configuration: Mapping, out: str) -> None:
    """A run's summary and its configuration, without its cases, as what later runs are compared with."""
    summary.write.mode("overwrite").json(f"{out}/summary")
    text = json.dumps(configuration, ensure_ascii=False, sort_keys=True)
    summary.sparkSession.range(1).select(F.lit(text).alias("value")).coalesce(1).write.mode("overwrite").text(f"{out}/configuration")


def read_baseline(spark: SparkSession, out: str) -> tuple[DataFrame, dict]:
    return spark.read.json(f"{out}/summary"), json.loads(spark.read.text(f"{out}/configuration").first()["value"])


def _markers(spark: SparkSession, root: str) -> tuple:
    """The file system of ``root`` and the folder of its version markers."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/published")
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), folder


def _claim(spark: SparkSession, root: str, version: int, text: str) -> bool:
    """Create the marker of ``version`` with ``text``; False if another writer has it.

    Creation is exclusive: by the name node or the object store, or by the operating system for local folders.
    """
    fs, folder = _markers(spark, root)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, f"v{version:09d}")
    fs.mkdirs(folder)
    if fs.getScheme() == "file":
        try:
            with open(path.toUri().getPath(), "x") as marker:
                marker.write(text)
        except FileExistsError:
            return False
        return True
    try:
        stream = fs.create(path, False)
    except Py4JJavaError as error:
        if "AlreadyExists" not in error.java_exception.getClass().getName():
            raise
        return False
    stream.write(bytearray(text.encode()))
    stream.close()
    return True


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers that writers have claimed, published or not."""
    fs, folder = _markers(spark, root)
    names = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
    return sorted(int(n[1:]) for n in names if re.fullmatch(r"v\d+", n))


def latest_version(spark: SparkSession, root: str) -> tuple[int, str] | None:
    """The newest published version and its folder. A marker that its writer has not ended says nothing yet."""
    fs, folder = _markers(spark, root)
    jvm = spark.sparkContext._jvm
    for version in reversed(versions(spark, root)):
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(folder, f"v{version:09d}"))
        text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if text.endswith("\n"):
            return version, text.strip()
    return None


def write_index(tables: Mapping[str, DataFrame], root: str, formats: Mapping[str, str] | None = None) -> int:
    """Write all tables of a new version, then publish it; readers see the old one until then.

    Tables go to a folder of their own name first. Publishing is one exclusive creation of the next number's
    marker, which names the folder: of two writers at once one takes the number and the other the next one, and
    a version is never read before its tables are whole.
    """
    spark = next(iter(tables.values())).sparkSession
    folder = f"tables-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.format((formats or {}).get(name, "parquet")).save(f"{root}/{folder}/{name}")
    version = max(versions(spark, root), default=0) + 1
    while not _claim(spark, root, version, f"{folder}\n"):
        version += 1
    return version


def read_latest_index(spark: SparkSession, root: str, names: tuple[str, ...]) -> dict[str, DataFrame]:
    found = latest_version(spark, root)
    if found is None:
        raise FileNotFoundError(f"no index is published in {root}")
    return {n: spark.read.parquet(f"{root}/{found[1]}/{n}") for n in names}
