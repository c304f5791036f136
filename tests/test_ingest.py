"""Quota, stream ingest over several batches, versioned indexes and sections, against plain folds."""

import random
import shutil
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestrand.operators import chunking, ingest, lookup
from lodestrand.sources import files
from lodestrand.streaming.jobs import compact_ingested, read_ingested, stream_ingest

NEW = "store string, arrival_seq long, size_bytes long, sha256 string"


def brute_quota(rows, registry, most_documents, most_bytes):
    out, state = {}, {}
    for store, _, size, sha in registry:
        s = state.setdefault(store, [0, 0, set()])
        s[0] += 1
        s[1] += size
        s[2].add(sha)
    for store, at, size, sha in sorted(rows, key=lambda r: r[1]):
        s = state.setdefault(store, [0, 0, set()])
        reason = "too_many_documents" if s[0] >= most_documents else "store_full" if s[1] + size > most_bytes else "duplicate" if sha in s[2] else None
        if reason is None:
            s[0] += 1
            s[1] += size
            s[2].add(sha)
        out[store, at] = reason
    return out


@pytest.mark.parametrize("seed, most_documents, most_bytes", [(1, 5, 300), (2, 40, 900), (3, 7, 10_000), (4, 1, 50), (5, 9, 400)])
def test_quota_against_a_fold(spark, seed, most_documents, most_bytes):
    """Many refusals between acceptances, duplicates of accepted and of refused rows, a hot store, stores that hold something."""
    rng = random.Random(seed)
    sizes = {f"h{i}": rng.choice([1, 10, 60, 90, 150, 299, 400]) for i in range(60)}
    rows = [("hot" if rng.random() < 0.7 else rng.choice("abc"), i, sizes[h := rng.choice(list(sizes))], h) for i in range(400)]
    registry = [("a", 0, sizes["h1"], "h1"), ("a", 1, sizes["h2"], "h2"), ("full", 2, 10**6, "h3"), ("unused", 3, 1, "h4")]
    rows += [("full", 1000 + i, 1, f"h{i}") for i in range(3)]
    got = ingest.admit_with_quota(spark.createDataFrame(rows, NEW).repartition(3), spark.createDataFrame(registry, NEW), most_documents, most_bytes).collect()
    assert {(r.store, r.arrival_seq): r.reason for r in got} == brute_quota(rows, registry, most_documents, most_bytes) and len(got) == len(rows)


def test_quota_of_nothing(spark):
    none = spark.createDataFrame([], NEW)
    assert ingest.admit_with_quota(none, none).count() == 0


UPLOAD = "arrival_seq long, store string, filename string, data binary, content_type string, domain string, category string, version string"


def upload(i, store, name, text):
    return (i, store, name, text.encode(), "text/markdown" if name.endswith(".md") else "text/plain", "web", "page", "1")


BATCHES = [
    [upload(1, "s", "a.md", "# A\nfirst text"), upload(2, "s", "b.md", "# B\nsecond text"), upload(3, "s", "bad/name.md", "third text"), upload(4, "t", "a.md", "# A\nfirst text")],
    [upload(5, "s", "again.md", "# A\nfirst text"), upload(6, "s", "c.md", "third text"), upload(7, "s", "twice.md", "same"), upload(8, "s", "twice2.md", "same")],
    [upload(9, "t", "again.md", "# A\nfirst text"), upload(10, "s", "d.md", "fourth"), upload(11, "s", "b2.md", "# B\nsecond text")],
]
FATES = {1: None, 2: None, 3: "name_illegal", 4: None, 5: "duplicate", 6: None, 7: None, 8: "duplicate", 9: "duplicate", 10: None, 11: "duplicate"}


def fates(tables):
    return {r.arrival_seq: None for r in tables["documents"].collect()} | {r.arrival_seq: r.reason for r in tables["rejects"].collect()}


def test_stream_of_three_batches_one_of_them_again(spark, tmp_path):
    """Duplicates across batches, a batch that is run again from its checkpoint, and compaction in between."""
    source, out, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))

    def run():
        stream = spark.readStream.schema(UPLOAD).option("maxFilesPerTrigger", 1).parquet(source)
        stream_ingest(stream, out, checkpoint).awaitTermination()
        return read_ingested(spark, out)

    for rows in BATCHES:
        spark.createDataFrame(rows, UPLOAD).coalesce(1).write.mode("append").parquet(source)
        tables = run()
    assert fates(tables) == FATES
    chunks = {tuple(r) for r in tables["chunks"].select("source_name", "content").collect()}
    totals = spark.read.parquet(f"{out}/stores").where("store = 's'").groupBy("store").agg(F.max("docs").alias("docs"), F.max("bytes").alias("bytes")).first()
    accepted = [r for rows in BATCHES for r in rows if FATES[r[0]] is None and r[1] == "s"]
    assert (totals.docs, totals.bytes) == (len(accepted), sum(len(r[3]) for r in accepted))
    # the last batch was not committed: it runs once more and replaces its own folders
    last = max((p for p in Path(checkpoint, "commits").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    last.unlink()
    Path(last.parent, f".{last.name}.crc").unlink(missing_ok=True)
    again = run()
    assert fates(again) == FATES and again["documents"].count() == 6
    assert {tuple(r) for r in again["chunks"].select("source_name", "content").collect()} == chunks
    assert compact_ingested(spark, out, 1) == 1
    shutil.rmtree(f"{out}/documents/batch=0")  # a version covers it
    assert fates(read_ingested(spark, out)) == FATES
    spark.createDataFrame([upload(12, "t", "new.md", "# A\nfirst text"), upload(13, "t", "new2.md", "fifth")], UPLOAD).coalesce(1).write.mode("append").parquet(source)
    assert fates(run()) == FATES | {12: "duplicate", 13: None}


def test_stream_against_a_registry(spark, tmp_path):
    source, out = f"{tmp_path}/in", f"{tmp_path}/out"
    spark.createDataFrame(BATCHES[0], UPLOAD).write.parquet(source)
    held = spark.createDataFrame([(upload(0, "s", "x", "# B\nsecond text")[3],)], "data binary").select(F.lit("s").alias("store"), F.lit(100 * 2**20 - 20).cast("long").alias("size_bytes"), F.sha2("data", 256).alias("sha256"))
    stream_ingest(spark.readStream.schema(UPLOAD).parquet(source), out, f"{tmp_path}/c", held).awaitTermination()
    assert fates(read_ingested(spark, out)) == {1: None, 2: "store_full", 3: "name_illegal", 4: None}


def test_index_versions(spark, tmp_path):
    root = f"{tmp_path}/index"
    with pytest.raises(FileNotFoundError):
        files.read_latest_index(spark, root, ("t",))
    assert files.write_index({"t": spark.range(3)}, root) == 1
    # a writer that took a number and has not ended its marker: not read, and the number stays its own
    Path(root, "published", "v000000002").write_text("tables-half")
    assert files.read_latest_index(spark, root, ("t",))["t"].count() == 3
    assert files.write_index({"t": spark.range(4)}, root) == 3
    assert files.read_latest_index(spark, root, ("t",))["t"].count() == 4


def test_two_writers_take_two_versions(spark, tmp_path):
    root, got = f"{tmp_path}/index", []
    threads = [threading.Thread(target=lambda n=n: got.append((files.write_index({"t": spark.range(n)}, root), n))) for n in (1, 2, 3, 4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in got) == [1, 2, 3, 4]
    assert files.read_latest_index(spark, root, ("t",))["t"].count() == dict(got)[4]


def test_sections_stay_in_the_row(spark):
    texts = [
        "# T\n## A\nfirst\n#### deep\n # indented\n# Second\nmore\n# Third\n", "no heading\nat all", "", "\n\n", None, "# only\n## headings\n### here", "pre\n# A\ntext\n# B\n\n# C\nlast",
        "## x\r\nones\r## y two\x0b### z  \nthree", "#no\n# yes\n###### six\nbody", "# Ä  \n" + "line\n" * 5000,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "document_id long, text string").withColumn("title", F.lit("doc"))
    out = chunking.split_sections(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
    got = {i: sorted((r.section, r.title, r.content) for r in out.where(f"document_id = {i}").collect()) for i in range(len(texts))}
    assert got[0] == [(1, "T - A", "first\n#### deep\n # indented"), (2, "Second", "more")]
    assert got[1] == [(0, "doc", "no heading\nat all")] and got[2] == got[3] == got[4] == got[5] == []
    assert got[6] == [(0, "doc", "pre"), (1, "A", "text"), (2, "C", "last")]
    assert got[7] == [(1, "doc - x", "ones"), (2, "doc - y", "two"), (3, "doc - z", "three")]
    assert got[8] == [(0, "doc", "#no"), (1, "yes", "###### six\nbody")]
    assert got[9] == [(0, "Ä", ("line\n" * 5000).strip())]


def test_asof_over_buckets(spark):
    """A hot key with rows in many buckets, equal times, null times and keys, against a scan."""
    rng = random.Random(7)
    feed = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.randrange(40_000), f"v{rng.randrange(99):02}") for _ in range(300)]
    asked = [(i, rng.choice(["hot", "hot", "b", "none", None]), rng.randrange(41_000)) for i in range(300)]
    f = spark.createDataFrame(feed, "key string, sec long, status string").select("key", F.timestamp_seconds("sec").alias("ts"), "status")
    a = spark.createDataFrame(asked, "request_id long, key string, sec long").select("request_id", "key", F.timestamp_seconds("sec").alias("ts"))
    for width in (60, 3600, 10**6):
        got = {r.request_id: (r.status, r.freshness) for r in lookup.status_asof(a, f, ["key"], bucket=width).collect()}
        for i, key, sec in asked:
            best = max(((t, v) for k, t, v in feed if k == key and t <= sec), default=None)
            age = None if best is None else sec - best[0]
            assert got[i] == ((None, "missing") if best is None else (best[1], "fresh" if age <= 30 else "stale" if age <= 300 else "expired"))
