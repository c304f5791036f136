"""Evaluation runs, the vector cache and readers: small cases with known results."""

import hashlib
import json
import os
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions.text import python_tokens
from lodestrand.operators import evaluation as ev
from lodestrand.operators import retrieval
from lodestrand.operators.chunking import build_chunks
from lodestrand.sources import files

CORPUS = {
    "card.md": "# 校园卡\n## 挂失\n校园卡遗失后应立即挂失，补办工本费20元。\n## 充值\n在食堂自助机充值。",
    "library.md": "# 图书馆\n## 开放时间\n图书馆每天 08:00 开放，22:00 关闭。\n## 借阅\n本科生最多借10本图书。",
    "hall.md": "# Sports hall\n## Booking\nThe sports hall is booked online two days ahead.\n## Fees\nStudents play free of charge.",
}


def case(i, query, chunk=None, **more):
    doc = chunk and "builtin-" + chunk.split("-")[0]
    own = {
        "id": i, "schema_version": "1", "task": "retrieval", "split": "dev", "query": query, "request": {"top_k": 3, "filters": {}},
        "expected": {"answerable": chunk is not None, "relevant_document_ids": [doc] if chunk else [], "relevant_chunk_ids": [chunk] if chunk else [], "domain": "", "category": "", "required_facts": [], "forbidden_facts": []},
        "tags": ["t"] if chunk else ["retrieval_no_hit"], "difficulty": "easy", "review_status": "ok",
    }
    return own | more


AGENT = {"rewrite_expected": "if_initial_insufficient", "rewritten_query_contains": ["校园卡"], "grade_expected": "relevant", "verification_expected": "grounded", "max_retrieval_attempts": 2, "required_events": ["retrieve", "grade", "rewrite", "verify"], "forbidden_tools": []}
CASES = [
    case("hall", "When is the sports hall booked online?", "hall-1-0"),
    case("library", "图书馆几点开放", "library-1-0", split="test"),
    case("nothing", "quantum entanglement homework"),
    case("other-origin", "sports hall booked", request={"top_k": 2, "filters": {"origin": "uploaded"}}),
    case("agent", "麻烦问一下饭卡弄丢了重办", "card-1-0", task="agentic", agentic=AGENT),
]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("corpus")
    for name, text in CORPUS.items():
        (folder / name).write_text(text)
    return build_chunks(files.read_markdown_corpus(spark, str(folder)), prefix="title")


def parsed(spark, cases):
    lines = spark.createDataFrame([("cases.jsonl", i + 1, json.dumps(c, ensure_ascii=False)) for i, c in enumerate(cases)], "source_file string, source_line int, json string")
    return ev.parse_cases(lines)


def test_run_of_all_strategies(spark, corpus, tmp_path):
    run = ev.evaluate(parsed(spark, CASES), corpus, retrieval.hash_embed(128), 128, "hash:128")
    got = {(r.strategy, r.case_id): r for r in run.results.collect()}
    assert len(got) == 15
    for strategy in ("bm25", "hybrid"):
        assert [got[strategy, i].retrieved_chunk_ids[0] for i in ("hall", "library", "agent")] == ["hall-1-0", "library-1-0", "card-1-0"]
        assert got[strategy, "nothing"].retrieved_chunk_ids == [] and got[strategy, "nothing"].safe_abstained
        agent = got[strategy, "agent"]
        assert (agent.rewrite_expected, agent.rewrite_actual, agent.grade_actual, agent.verification_actual, agent.trace_conformant) == (True, True, "relevant", "grounded", True)
    assert all(got[s, "other-origin"].retrieved_chunk_ids == [] for s in ("bm25", "vector", "hybrid"))
    assert got["bm25", "hall"].rewrite_actual is None and got["bm25", "hall"].failures == []
    spent = {s: {r.duration_ms for (t, _), r in got.items() if t == s} for s in ("bm25", "vector", "hybrid")}
    assert all(len(v) == 1 and min(v) > 0 for v in spent.values())
    assert min(spent["hybrid"]) > max(min(spent["bm25"]), min(spent["vector"]))  # it rests on both channels
    assert run.configuration["case_count"] == 5 and run.configuration["configuration"]["evaluation"]["case_top_k_values"] == [2, 3]
    files.write_baseline(run.summary, run.configuration, f"{tmp_path}/base")
    summary, configuration = files.read_baseline(spark, f"{tmp_path}/base")
    assert configuration == run.configuration and summary.count() == run.summary.count()
    again = ev.evaluate(parsed(spark, CASES[::-1]), corpus.repartition(3), None, 1, "none", strategies=("bm25", "bm25"))
    assert again.configuration["corpus_fingerprint"] == run.configuration["corpus_fingerprint"] and again.configuration["dataset_fingerprint"] == run.configuration["dataset_fingerprint"]
    assert {r.case_id: r.retrieved_chunk_ids for r in again.results.collect()} == {i: got["bm25", i].retrieved_chunk_ids for _, i in got if _ == "bm25"}


def test_run_refuses(spark, corpus):
    go = lambda cases, **how: ev.evaluate(parsed(spark, cases), corpus, None, 1, "none", **how)
    for cases, how, message in (
        (CASES, {"strategies": ("bm25", "other")}, "strategies"), (CASES, {"strategies": ()}, "strategies"), (CASES, {"k": 0}, "1 at least"), (CASES, {"split": "final"}, "no case"),
        ([case("x", "q", "hall-9-0")], {}, "cases.jsonl:1: x: unknown_chunk:hall-9-0"), ([CASES[0], CASES[0]], {}, "duplicate_id"), ([case("x", " ", "hall-1-0")], {"validate": False}, "blank_field"),
    ):
        with pytest.raises(ValueError, match=message):
            go(cases, **how)
    assert go([case("x", "sports hall", "hall-9-0")], validate=False, strategies=("bm25",)).results.count() == 1


def test_every_validation_rule(spark, corpus):
    expected = lambda **more: CASES[0]["expected"] | more
    base = lambda i, **more: case(i, f"question {i}", "hall-1-0", **more)
    agentic = lambda **more: {"task": "agentic", "agentic": AGENT | more}
    cases = [
        base("fine"), base("fine"), base("q2") | {"query": "QUESTION fine"},
        base("none", expected=expected(relevant_chunk_ids=[], relevant_document_ids=[])),
        base("neg", expected=expected(answerable=False), tags=["missing_fact"]), base("mode", expected=expected(answerable=False, relevant_chunk_ids=[], relevant_document_ids=[])),
        base("lost", expected=expected(relevant_chunk_ids=["hall-7-0"], relevant_document_ids=["builtin-moon"])), base("far", expected=expected(relevant_document_ids=["builtin-card"])),
        base("filter", request={"top_k": 1, "filters": {"visibility": "private"}}), base("shut", request={"top_k": 1, "filters": {"origin": "uploaded"}}),
        base("place", expected=expected(domain="x", category="y")), base("facts", expected=expected(required_facts=["Booked Online", "moon"], forbidden_facts=["MOON"])),
        base("tags", tags=[]), base("terms", **agentic(rewrite_expected="false")), base("often", **agentic(max_retrieval_attempts=3)),
    ]
    issues = ev.validate_cases(parsed(spark, cases), corpus)
    got = {}
    for r in issues.collect():
        got.setdefault((r.source_line, r.case_id), set()).add(r.message)
    assert got == {
        (2, "fine"): {"duplicate_id", "duplicate_query"}, (3, "q2"): {"duplicate_query"}, (4, "none"): {"no_relevant_chunks", "no_relevant_documents"}, (5, "neg"): {"labels_on_unanswerable"},
        (6, "mode"): {"negative_mode"}, (7, "lost"): {"unknown_chunk:hall-7-0", "unknown_document:builtin-moon"}, (8, "far"): {"chunk_document_mismatch"}, (9, "filter"): {"bad_filter:unknown:visibility"},
        (10, "shut"): {"filtered_out:hall-1-0"}, (11, "place"): {"domain_mismatch:hall-1-0", "category_mismatch:hall-1-0"}, (12, "facts"): {"fact_not_in_truth:moon", "fact_conflict:moon"},
        (13, "tags"): {"no_tags"}, (14, "terms"): {"rewrite_terms_unexpected"}, (15, "often"): {"too_many_attempts"},
    }
    plan = issues._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("text") > 0


def test_lines_keep_their_numbers_in_byte_ranges(spark, tmp_path):
    lines = ["# head", "", '{"id": 1}'] + [f'{{"id": {i}, "x": "{"y" * (i % 70)} "}}' if i % 9 else "  # no" for i in range(2, 400)]
    (tmp_path / "a.jsonl").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.jsonl").write_bytes("\r\n".join(lines[:50]).encode() + b"\r\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        df = files.read_eval_cases(spark, str(tmp_path))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
        got = {(r.source_file, r.source_line): r.json for r in df.collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    want = {(n, i): x for n, own in (("a.jsonl", lines), ("b.jsonl", lines[:50])) for i, x in enumerate(own, 1) if x.strip() and not x.strip().startswith("#")}
    assert got == want


def entry(text, dim=16):
    v = np.zeros(dim)
    for token in sorted(set(python_tokens(text))):
        digest = hashlib.blake2b(token.encode(), digest_size=8).digest()
        v[int.from_bytes(digest, "big") % dim] += (1 if digest[0] & 1 else -1) * (1 + np.log(python_tokens(text).count(token)))
    return v / np.sqrt((v * v).sum())


def test_hash_vectors_are_what_they_were(spark):
    """Vectors of a stored digest: another hash, slot, sign or weight would give other numbers."""
    texts = ["sports hall sports", "校园卡 补办 20元", "a b c"]
    got = [r.v for r in spark.createDataFrame([(t,) for t in texts], "t string").select(retrieval.hash_embed(16)("t").alias("v")).collect()]
    assert np.allclose(got, [entry(t) for t in texts], atol=1e-6)
    assert hashlib.sha256(json.dumps([[round(float(x), 4) + 0.0 for x in v] for v in got]).encode()).hexdigest()[:16] == "c5a99c1fdda0ed44"


def test_cache_encodes_again_what_cannot_be_trusted(spark, tmp_path):
    root, calls = f"{tmp_path}/cache", spark.sparkContext.accumulator(0)

    @F.udf("array<float>")
    def embed(text):
        calls.add(1)
        return [float(len(text)), 1.0]

    texts = spark.createDataFrame([(i, t) for i, t in enumerate(["a", "bb", "ccc", "bb", None])], "key int, text string")
    go = lambda df, model="m": retrieval.embed_cached(df, root, model, embed, 2)
    tell = lambda counts: tuple(counts.first()[c] for c in ("total", "hits", "misses", "rebuilt"))
    rows, counts = go(texts.where("key < 3"))
    assert tell(counts) == (3, 0, 3, False) and calls.value == 3
    rows, counts = go(texts)
    assert tell(counts) == (5, 4, 1, False) and calls.value == 4
    assert {r.key: (r.vector, r.hit) for r in rows.collect()}[4] == ([0.0, 1.0], False)
    assert tell(go(texts)[1]) == (5, 5, 0, False) and calls.value == 4
    assert tell(go(texts, "other")[1])[1:3] == (0, 5)  # another model has a cache of its own
    before = calls.value
    # one value changed without its checksum
    home = f"{root}/{hashlib.sha256(b'm').hexdigest()}"
    held = files.read_latest_index(spark, home, ("vectors",))["vectors"]
    spoilt = held.withColumn("vector", F.when(F.col("sha256") == hashlib.sha256(b"bb").hexdigest(), F.array(F.lit(9.0), F.lit(1.0)).cast("array<float>")).otherwise(F.col("vector")))
    files.write_index({"vectors": spoilt, "size": spark.range(1).select(F.lit(4).alias("entries"))}, home, {"size": "json"})
    rows, counts = go(texts)
    assert tell(counts) == (5, 3, 2, True) and calls.value == before + 1
    assert {r.key: r.vector for r in rows.collect()}[1] == [2.0, 1.0]
    assert tell(go(texts)[1]) == (5, 5, 0, False)
    # all files of the newest version are garbage
    newest = Path(home, files.latest_version(spark, home)[1], "vectors")
    for part in newest.glob("part-*"):
        part.write_bytes(b"no parquet")
        Path(newest, f".{part.name}.crc").unlink(missing_ok=True)
    rows, counts = go(texts)
    assert tell(counts) == (5, 0, 5, True) and {r.key: r.vector for r in rows.collect()} == {0: [1.0, 1.0], 1: [2.0, 1.0], 2: [3.0, 1.0], 3: [2.0, 1.0], 4: [0.0, 1.0]}
    # fewer texts: the cache is cut to them
    assert tell(go(texts.where("key = 0"))[1]) == (1, 1, 0, False)
    assert files.read_latest_index(spark, home, ("vectors",))["vectors"].count() == 1


GOLDEN = {"bm25": (0.8933, 0.92, 0.9067, 0.8, 7), "vector": (0.7467, 0.8, 0.7733, 1.0, 16), "hybrid": (0.9067, 0.9467, 0.9267, 0.8, 5)}
#: Hit@1, hit@3, MRR@3 and failures of the test split.
GOLDEN_TEST = {"bm25": (1.0, 1.0, 1.0, 0), "vector": (0.72, 0.76, 0.74, 6), "hybrid": (0.96, 1.0, 0.98, 0)}


@pytest.mark.skipif(not {"GOLDEN_CORPUS", "GOLDEN_CASES"} <= set(os.environ), reason="folders of the labelled cases are not named")
def test_labelled_cases(spark):
    chunks = build_chunks(files.read_markdown_corpus(spark, os.environ["GOLDEN_CORPUS"]), prefix="title")
    run = ev.evaluate(ev.parse_cases(files.read_eval_cases(spark, os.environ["GOLDEN_CASES"])), chunks, retrieval.hash_embed(512), 512, "hash:512")
    summary = run.summary.collect()
    rows = [r for r in summary if r.scope == "overall"]
    got = {r.strategy: (*(round(r[c], 4) for c in ("hit_at_1", "hit_at_3", "mrr_at_3", "no_hit_accuracy")), r.failed_cases) for r in rows}
    assert got == GOLDEN
    test = {r.strategy: (*(round(r[c], 4) for c in ("hit_at_1", "hit_at_3", "mrr_at_3")), r.failed_cases) for r in summary if (r.scope, r.value) == ("by_split", "test")}
    assert test == GOLDEN_TEST


def test_report_computes_results_once_and_compresses_them(spark, tmp_path):
    import uuid

    made = F.udf(lambda: uuid.uuid4().hex).asNondeterministic()  # other rows each time they are computed
    results = spark.range(60, numPartitions=2).select(made().alias("case_id"), F.expr("case when id % 3 = 0 then array('leakage') else cast(array() as array<string>) end").alias("failures"))
    written = files.write_eval_report(results, lambda rows: rows.agg(F.max("case_id").alias("last"), F.count("*").alias("cases")), str(tmp_path))
    read = {kind: spark.read.json(f"{tmp_path}/{kind}") for kind in ("results", "failures", "summary")}
    ids = {kind: {r.case_id for r in read[kind].collect()} for kind in ("results", "failures")}
    assert len(ids["results"]) == 60 and len(ids["failures"]) == 20 and ids["failures"] <= ids["results"]
    assert written.dtypes == results.dtypes and {r.case_id for r in written.collect()} == ids["results"]
    assert tuple(read["summary"].first()) == (60, max(ids["results"]))
    parts = [p.name for p in tmp_path.glob("*/part-*")]
    assert parts and all(p.endswith(".json.gz") for p in parts)


def test_report_takes_a_summary_as_it_is(spark, tmp_path):
    results = spark.createDataFrame([("a", []), ("b", ["x"])], "case_id string, failures array<string>")
    files.write_eval_report(results, results.agg(F.count("*").alias("cases")), str(tmp_path))
    assert [spark.read.json(f"{tmp_path}/{kind}").count() for kind in ("results", "failures")] == [2, 1] and spark.read.json(f"{tmp_path}/summary").first().cases == 2
