"""Ingest of uploads: validation, duplicates, quotas and corpus maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrand.functions.text import content_type_error, decode_text, display_name_error, extension, metadata_value_error, nfc, strip
from lodestrand.operators.chunking import build_chunks
from lodestrand.session import cut

MOST_BYTES, MOST_STORE_BYTES, MOST_DOCUMENTS = 10 << 20, 100 << 20, 100
METADATA = ("domain", "category", "version")


def dedupe_by_content(new: DataFrame, registry: DataFrame) -> DataFrame:
    """``new (arrival_seq, sha256)`` with ``duplicate``: the content is registered or arrived before. Only hashes move."""
    first = F.row_number().over(W.partitionBy("sha256").orderBy("arrival_seq")) > 1
    known = registry.select("sha256", F.lit(True).alias("_known")).distinct()
    return new.join(known, "sha256", "left").withColumn("duplicate", first | F.coalesce("_known", F.lit(False))).drop("_known")


def _taken(units: DataFrame, used: DataFrame, most_documents: int, most_bytes: int) -> DataFrame:
    """``(store, docs, bytes, taken)``: what each store held before, and what it takes of ``units (store, at, sha256, size)``, in order.

    Each round looks, for every store, at the next units that fit into what is left of its bytes, at most
    ``most_documents`` of them, and folds just these; a unit that does not fit never will, as less is left later. The
    first one always fits, so there are at most ``most_documents`` rounds, and usually one or two.
    """
    kind = F.array().cast(f"array<struct<at:{units.schema['at'].dataType.simpleString()},sha256:string,size:bigint>>")
    state = cut(used.withColumns({"taken": kind, "left_docs": most_documents - F.col("docs"), "left": most_bytes - F.col("bytes"), "pos": F.lit(None).cast(units.schema["at"].dataType)}), "quota")
    in_order = W.partitionBy("store").orderBy("at", "sha256")
    while True:
        fits = units.join(state.where("left_docs > 0").select("store", "left", "pos"), "store").where((F.col("pos").isNull() | (F.col("at") > F.col("pos"))) & (F.col("size") <= F.col("left")))
        near = fits.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= most_documents)
        line = cut(near.groupBy("store").agg(F.array_sort(F.collect_list(F.struct("at", "sha256", "size"))).alias("line")), "quota")
        if line.isEmpty():
            return state.select("store", "docs", "bytes", "taken")

        def step(s: Column, x: Column) -> Column:
            new = ~F.exists(s["taken"], lambda t: t["sha256"].eqNullSafe(x["sha256"]))
            fine = (s["left_docs"] > 0) & (x["size"] <= s["left"]) & new
            return F.struct(
                F.when(fine, F.concat(s["taken"], F.array(x))).otherwise(s["taken"]).alias("taken"),
                (s["left_docs"] - F.when(fine, 1).otherwise(0)).alias("left_docs"), (s["left"] - F.when(fine, x["size"]).otherwise(0)).alias("left"),
            )

        folded = F.aggregate(F.coalesce("line", F.array().cast(line.schema["line"].dataType)), F.struct("taken", "left_docs", "left"), step)
        moved = state.join(line, "store", "left").select("store", "docs", "bytes", F.coalesce(F.element_at("line", -1)["at"], "pos").alias("pos"), folded.alias("s"))
        state = cut(moved.select("store", "docs", "bytes", "s.*", "pos"), "quota")


def admit(new: DataFrame, used: DataFrame, most_documents: int = MOST_DOCUMENTS, most_bytes: int = MOST_STORE_BYTES) -> DataFrame:
    """``new (store, arrival_seq, size_bytes, sha256, known)`` with ``reason``; ``used (store, docs, bytes)`` is what stores hold already.

    In order of arrival per store: too_many_documents, then store_full, then duplicate, else null. Refused
    rows use no quota. Which contents a store takes is found first, from one row for each content and store;
    every row is then judged by itself against what its store held when it arrived.
    """
    size = F.coalesce(F.col("size_bytes"), F.lit(0)).cast("long")
    stores = new.select("store").distinct().join(used, "store", "left").select("store", F.coalesce("docs", F.lit(0)).cast("long").alias("docs"), F.coalesce("bytes", F.lit(0)).cast("long").alias("bytes"))
    units = cut(new.where("not known").groupBy("store", "sha256", size.alias("size")).agg(F.min("arrival_seq").alias("at")), "units")
    taken = _taken(units, stores, most_documents, most_bytes)
    first = taken.select("store", F.explode("taken").alias("t")).select("store", F.col("t.sha256").alias("sha256"), F.col("t.at").alias("_first"))
    sizes = F.transform("taken", lambda t: t["size"])
    sums = F.transform("taken", lambda t, i: F.struct(t["at"].alias("at"), F.aggregate(F.slice(sizes, 1, i + 1), F.lit(0).cast("long"), lambda a, x: a + x).alias("bytes")))
    steps = taken.select("store", F.col("docs").alias("_docs"), F.col("bytes").alias("_bytes"), sums.alias("_steps"))
    judged = new.join(first, ["store", "sha256"], "left").join(steps, "store").withColumn("_n", F.size(F.filter("_steps", lambda x: x["at"] < F.col("arrival_seq"))))
    held = F.col("_bytes") + F.coalesce(F.get("_steps", F.col("_n") - 1)["bytes"], F.lit(0))
    reason = (
        F.when(F.col("_docs") + F.col("_n") >= most_documents, "too_many_documents").when(held + size > most_bytes, "store_full")
        .when(F.col("known") | F.coalesce(F.col("_first") < F.col("arrival_seq"), F.lit(False)), "duplicate")
    )
    return judged.select(*new.columns, reason.alias("reason"))


def admit_with_quota(new: DataFrame, registry: DataFrame, most_documents: int = MOST_DOCUMENTS, most_bytes: int = MOST_STORE_BYTES) -> DataFrame:
    """``new (store, arrival_seq, size_bytes, sha256)`` with ``reason``, by :func:`admit`, against what ``registry`` holds.

    ``arrival_seq`` names a row of a store. No store is gathered: contents, sizes and hashes are grouped before the
    shuffle, and what of a store comes together is at most ``most_documents`` rows.
    """
    used = registry.groupBy("store").agg(F.count("*").alias("docs"), F.sum("size_bytes").alias("bytes"))
    held = registry.select("store", "sha256", F.lit(True).alias("_known")).distinct()
    marked = new.join(held, ["store", "sha256"], "left").withColumn("known", F.coalesce("_known", F.lit(False))).drop("_known")
    return admit(marked, used, most_documents, most_bytes).drop("known")


def judge_uploads(uploads: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """``uploads`` without ``data``, with name, text, hash, size, id and the ``reason`` of the first rule that a row breaks by itself.

    Rules: name, content type, metadata, empty, size, decoding, no chunk. Ids are the first 32 digits of the
    hash of content and name, so a second run gives the same ones.
    """
    named = uploads.withColumn("name", strip(nfc(F.coalesce("filename", F.lit("")))))
    ext = extension(F.col("name"))
    title = F.regexp_replace("name", r"(?s)(.)\.[^.]*$", "$1")
    size = F.octet_length("data")
    meta = F.coalesce(*(metadata_value_error(F.coalesce(c, F.lit(""))) for c in METADATA))
    checked = named.select(
        "*", ext.alias("extension"), title.alias("title"), size.alias("size_bytes"), F.sha2("data", 256).alias("sha256"), decode_text(F.col("data"), ext, title).alias("decoded")
    )
    # a document whose every line is a heading has nothing to index
    empty = strip(F.regexp_replace("decoded.text", r"(?Um)^#{1,3}\s+\S.*$", "")) == ""
    reason = F.coalesce(
        display_name_error(F.col("name")), content_type_error(F.col("extension"), F.col("content_type")), meta,
        F.when(F.coalesce("size_bytes", F.lit(0)) == 0, "empty_file"), F.when(F.col("size_bytes") > most_bytes, "file_too_large"), F.col("decoded.error"),
        F.when(empty, "no_chunks"),
    )
    document = F.substring(F.sha2(F.concat_ws("\x1f", "sha256", "name"), 256), 1, 32)
    return checked.withColumns({"reason": reason, "text": F.col("decoded.text"), "document_id": document}).drop("decoded", "data")


def ingested(judged: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted documents, rejects ``(arrival_seq, filename, reason)`` and the accepted documents' chunks, of rows with their last ``reason``."""
    accepted = judged.where("reason is null").select(
        "document_id", "store", "arrival_seq", F.col("name").alias("display_name"), "extension", "size_bytes", "sha256", "domain", "category", "version",
        F.lit("public").alias("visibility"), "title", "text",
    )
    rejects = judged.where("reason is not null").select("arrival_seq", "filename", "reason")
    chunks = build_chunks(accepted.select("document_id", F.col("display_name").alias("source_name"), "title", "text", "domain", "category", "version", "visibility"))
    return accepted.drop("text", "title"), rejects, chunks.withColumn("origin", F.lit("uploaded"))


def ingest_uploads(uploads: DataFrame, registry: DataFrame, most_bytes: int = MOST_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Accepted documents, rejects ``(arrival_seq, filename, reason)`` and the accepted documents' chunks.

    ``uploads (arrival_seq, store, filename, data, content_type, domain, category, version)``. The first rule
    that a row breaks by itself names its reason, then quota and duplicates.
    """
    judged = cut(judge_uploads(uploads, most_bytes), "judged")
    quota = admit_with_quota(judged.where("reason is null").select("store", "arrival_seq", "size_bytes", "sha256"), registry)
    late = quota.select("store", "arrival_seq", F.col("reason").alias("late"))
    return ingested(cut(judged.join(late, ["store", "arrival_seq"], "left").withColumn("reason", F.coalesce("reason", "late")).drop("late"), "ingested"))


def corpus_union(builtin: DataFrame, uploaded: DataFrame) -> DataFrame:
    """Built-in and uploaded chunks with their ``origin``."""
    return builtin.withColumn("origin", F.lit("built_in")).unionByName(uploaded.withColumn("origin", F.lit("uploaded")), allowMissingColumns=True)


def delete_documents(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    return chunks.join(ids.select("document_id").distinct(), "document_id", "left_anti")


def corpus_stats(chunks: DataFrame, registry: DataFrame) -> DataFrame:
    """Per origin: documents, chunks and bytes."""
    sizes = registry.select("document_id", "size_bytes")
    per_doc = chunks.groupBy("origin", "document_id").agg(F.count("*").alias("chunks"))
    return per_doc.join(sizes, "document_id", "left").groupBy("origin").agg(
        F.count("*").alias("documents"), F.sum("chunks").alias("chunks"), F.coalesce(F.sum("size_bytes"), F.lit(0)).cast("long").alias("size_bytes")
    )
