import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestrand.functions import text as tx
from lodestrand.operators import chunking, evaluation, ingest, lookup, qa, retrieval, sessions
from lodestrand.sources import files

META = {"document_id": "d", "source_name": "s.md", "domain": "en", "category": "c", "version": "1", "origin": "built_in", "visibility": "public"}


def chunks(spark, rows):
    schema = "chunk_id string, title string, content string, source string, " + ", ".join(f"{k} string" for k in META)
    return spark.createDataFrame([(i, t, c, f"{t}#x", *({**META, **(m or {})}).values()) for i, t, c, m in rows], schema)


def no_filter(spark):
    return spark.createDataFrame([("f", None, None, None, None, None, None)], "filter_id string, " + ", ".join(f"{k} string" for k in retrieval.FILTER_KEYS))


def test_sections_and_chunks(spark):
    text = "# T\n## A\nfirst\n#### deep\n # indented\n# Second\nmore\n# Third\n"
    df = spark.createDataFrame([("x", "n.md", "n", text)], "document_id string, source_name string, title string, text string")
    got = {r.chunk_id: (r.title, r.content, r.chunk_index) for r in chunking.build_chunks(df).collect()}
    assert got == {"x-1-0": ("T - A", "first\n#### deep\n# indented", 1000), "x-2-0": ("Second", "more", 2000)}


def test_long_split():
    text = "a" * 700 + "。" + "b" * 1900
    parts = chunking.split_text(text)
    assert parts[0] == "a" * 700 + "。" and all(len(p) <= 1200 for p in parts)
    assert chunking.split_text("x" * 1201) == ["x" * 1200, "x" * 121]
    assert chunking.split_text("  ") == [] and chunking.split_text("ab") == ["ab"]


def test_bm25_counts_only_eligible_chunks(spark):
    both = chunks(spark, [("a", "t", "alpha beta gamma", None), ("b", "t", "alpha beta gamma", {"visibility": "private"}), ("c", "t", "delta", None)])
    alone = both.where("chunk_id != 'b'")
    queries = spark.createDataFrame([("q", "alpha beta", "f")], "query_id string, query string, filter_id string")
    run = lambda c: [tuple(r) for r in retrieval.bm25_search(queries, c, retrieval.build_postings(c), no_filter(spark)).collect()]
    assert run(both) == run(alone) and run(both)[0][1] == "a"


def test_ties_take_the_smaller_id_and_gate(spark):
    c = chunks(spark, [("b", "t", "alpha beta", None), ("a", "t", "alpha beta", None), ("z", "t", "alpha only", None)])
    queries = spark.createDataFrame([("q", "alpha beta", "f")], "query_id string, query string, filter_id string")
    got = retrieval.bm25_search(queries, c, retrieval.build_postings(c), no_filter(spark)).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "b"]


def test_vectors_and_fusion(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])], "chunk_id string, vector array<float>")
    q = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "query_id string, vector array<float>")
    near = retrieval.vector_search(q, v, 2, 0.5)
    assert [(r.query_id, r.chunk_id) for r in near.orderBy("rank").collect()] == [("q", "a"), ("q", "b")]
    lexical = spark.createDataFrame([("q", "b", 3.0, 1)], "query_id string, chunk_id string, score double, rank int")
    fused = retrieval.rrf_fuse(lexical, near, 2).orderBy("rank").collect()
    assert fused[0].chunk_id == "b" and fused[0].retrieval_method == "hybrid" and fused[0].score <= 1
    pins = spark.createDataFrame([("q", "a")], "query_id string, chunk_id string")
    pinned = retrieval.rrf_fuse(lexical, near, 2, pins=pins).orderBy("rank").first()
    assert pinned.chunk_id == "a" and 1 < pinned.score <= 2


def test_vector_checks(spark):
    df = spark.createDataFrame([([1.0],), ([0.0, 0.0],), ([float("nan"), 1.0],), ([1.0, 2.0],), (None,)], "v array<float>")
    assert [r[0] for r in df.select(retrieval.vector_error(F.col("v"), 2)).collect()] == ["wrong_length", "zero", "not_finite", None, "wrong_length"]


def test_embedding_is_unit_and_cached(spark):
    embed = retrieval.hash_embed(64)
    texts = spark.createDataFrame([("1", "a b"), ("2", "a b"), ("3", "c")], "key string, text string")
    empty = spark.createDataFrame([], "fingerprint string, sha256 string, vector array<float>")
    rows, cache, stats = retrieval.embed_incremental(texts, empty, "v", embed)
    assert rows.count() == 3 and cache.count() == 2 and tuple(stats.first()) == (3, 0, 3)
    cache = spark.createDataFrame(cache.drop("checksum").collect(), empty.schema)
    _, pruned, stats = retrieval.embed_incremental(texts.where("key = '3'"), cache, "v", embed)
    assert pruned.count() == 1 and tuple(stats.first()) == (1, 1, 0)
    assert retrieval.embed_incremental(texts, cache, "other", embed)[2].first().misses == 3


def test_verify_order(spark):
    results = spark.createDataFrame(
        [("a", qa.KNOWLEDGE, True, "x", []), ("b", qa.KNOWLEDGE, True, "费用 20 元", [("c1", "20 元")]), ("c", "t", False, "", None), ("d", qa.KNOWLEDGE, True, "费用 20 元", [("c1", "20 元")]), ("e", "t", True, "20 元", None)],
        "query_id string, tool_name string, ok boolean, output string, hits array<struct<chunk_id:string,content:string>>",
    )
    answers = spark.createDataFrame([("a", "20 元"), ("b", "20 元"), ("c", ""), ("d", "20 元"), ("e", "30 元")], "query_id string, answer string")
    cites = spark.createDataFrame([("b", "c1"), ("d", "zz")], "query_id string, chunk_id string")
    got = {r.query_id: r.status for r in qa.verify(answers, results, cites).collect()}
    assert got == {"a": "no_hits", "b": "grounded", "c": "no_result", "d": "foreign_citation", "e": "unsupported_claim"}


def test_quota_ignores_refused_rows(spark):
    new = spark.createDataFrame([("s", 1, 60, "a"), ("s", 2, 50, "b"), ("s", 3, 30, "c"), ("s", 4, 5, "a")], "store string, arrival_seq long, size_bytes long, sha256 string")
    none = new.limit(0)
    got = {r.arrival_seq: r.reason for r in ingest.admit_with_quota(new, none, 100, 100).collect()}
    assert got == {1: None, 2: "store_full", 3: None, 4: "duplicate"}


def test_registry_defaults_and_invalid_rows(spark):
    rows = spark.createDataFrame(
        [("a" * 32, "n.md", ".md", "t", 1, "b" * 64, "2024-01-01T00:00:00+00:00", 1, None, None, None, None), ("bad", "n.md", ".md", "t", 1, "b" * 64, "2024-01-01T00:00:00+00:00", 1, None, None, None, None)], files.REGISTRY
    )
    got = files.registry_rows(rows).collect()
    assert [(r.domain, r.category, r.visibility, r.version) for r in got] == [("uploaded", "general", "public", "1")]


def test_index_versions(spark, tmp_path):
    root = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        files.read_latest_index(spark, root, ("t",))
    assert files.write_index({"t": spark.range(1)}, root) == 1
    assert files.write_index({"t": spark.range(5)}, root) == 2
    assert files.read_latest_index(spark, root, ("t",))["t"].count() == 5


def test_markdown_corpus_and_cases(spark, tmp_path):
    with pytest.raises(Exception):
        files.read_markdown_corpus(spark, str(tmp_path / "none"))
    (tmp_path / "library.md").write_text("# L\nx\n")
    (tmp_path / "other.md").write_text("# O\ny\n")
    got = {r.document_id: (r.domain, r.category) for r in files.read_markdown_corpus(spark, str(tmp_path)).collect()}
    assert got == {"builtin-library": ("campus_service", "library"), "builtin-other": ("campus_service", "general")}
    (tmp_path / "c.jsonl").write_text('# note\n\n{"id": "1"}\n')
    assert [(r.source_line, r.json) for r in files.read_eval_cases(spark, str(tmp_path / "c.jsonl")).collect()] == [(3, '{"id": "1"}')]


def test_rollback(spark):
    snaps = spark.createDataFrame([("t", "", f"c{i}", f"c{i - 1}" if i > 1 else None) for i in range(1, 6)], "thread_id string, checkpoint_ns string, checkpoint_id string, parent_checkpoint_id string")
    run = lambda keep: {(r.checkpoint_id, r.error) for r in sessions.rollback_after(snaps, spark.createDataFrame([("t", "", keep)], "thread_id string, checkpoint_ns string, keep_id string")).collect()}
    assert run("c2") == {("c1", None), ("c2", None)}
    assert run(None) == set()
    assert run("zz") == {(f"c{i}", "broken_chain") for i in range(1, 6)}


def test_routing_carries_context(spark):
    rows = [("s", 0, "user", "周三有什么课"), ("s", 1, "assistant", "x"), ("s", 2, "user", "在哪里，几点"), ("t", 0, "user", "图书馆现在开门吗"), ("u", 0, "user", "有什么课"), ("v", 0, "user", "校园卡补办流程，现在排队吗")]
    got = {(r.session_id, r.turn): (r.tools, r.weekday) for r in sessions.route_queries(spark.createDataFrame(rows, "session_id string, turn long, role string, content string")).collect()}
    assert got[("s", 0)] == ("course", "周三") and got[("s", 2)] == ("course", "周三")
    assert got[("t", 0)][0] == "status" and got[("u", 0)][0] == "" and got[("v", 0)][0] == "status,knowledge"


def test_status_asof(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    feed = spark.createDataFrame([("k", at(0), "open"), ("k", at(100), "busy")], "key string, ts timestamp, status string")
    asked = spark.createDataFrame([(1, "k", at(100)), (2, "k", at(99)), (3, "k", at(1000)), (4, "z", at(5))], "request_id long, key string, ts timestamp")
    got = {r.request_id: (r.status, r.freshness) for r in lookup.status_asof(asked, feed, ["key"]).collect()}
    assert got == {1: ("busy", "fresh"), 2: ("open", "stale"), 3: ("busy", "expired"), 4: (None, "missing")}


def test_recommend_published_sweep(spark):
    rows = [(0.44, 0.92, 1.0, 0.5), (0.46, 0.92, 1.0, 0.5), (0.48, 0.92, 0.98, 0.75), (0.50, 0.90, 0.96, 0.75), (0.52, 0.88, 0.94, 0.75), (0.55, 0.88, 0.94, 0.75), (0.60, 0.88, 0.92, 0.75)]
    df = spark.createDataFrame([(t, "hybrid", a, b, n, 1 - n) for t, a, b, n in rows], "threshold double, strategy string, hit_at_1 double, hit_at_3 double, no_hit_accuracy double, false_positive_rate double")
    assert tuple(evaluation.recommend_threshold(df).first()) == (0.48, False, "best_observed_gate_not_met")
    assert evaluation.recommend_threshold(df, 0.7).first().recommended_threshold == 0.48


def test_fingerprint_ignores_order(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    one = evaluation.fingerprint(df, "id").first()
    assert one == evaluation.fingerprint(df.repartition(5).orderBy(F.desc("id")), "id").first()
    assert one.fingerprint != evaluation.fingerprint(df.withColumn("x", F.lit(1)), "id").first().fingerprint


@pytest.mark.parametrize("strategy", ["vector", "hybrid"])
def test_vectors_of_other_chunks_are_filtered(spark, strategy):
    import numpy as np

    rng = np.random.default_rng(5)
    metas = [None, {"visibility": "private"}, {"domain": "de"}]
    rows = [(f"c{i:02}", "t", f"word{i}", metas[0 if i >= 50 else 1 + i % 2]) for i in range(60)]
    c = chunks(spark, rows)
    unit = lambda x: [float(y) for y in x / np.linalg.norm(x)]
    # the 50 nearest are private or in another language
    vectors = {r[0]: unit(np.array([1.0, 0.01 * i if i < 50 else 1.0]) + [0, 0.001 * rng.random()]) for i, r in enumerate(rows)}
    v = spark.createDataFrame(list(vectors.items()), "chunk_id string, vector array<float>")
    keys = ", ".join(f"{k} string" for k in retrieval.FILTER_KEYS)
    filters = spark.createDataFrame([("f_en", None, "en", None, None, None, None), ("f_all", None, None, None, None, None, None)], f"filter_id string, {keys}")
    q = spark.createDataFrame([("q1", "nothing", "f_en", [1.0, 0.0]), ("q2", "nothing", "f_all", [1.0, 0.0])], "query_id string, query string, filter_id string, vector array<float>")
    hits = retrieval.retrieve(q, c, retrieval.build_postings(c), filters, v, strategy, 3, dim=2).collect()
    meta = {r[0]: {**META, **(r[3] or {})} for r in rows}
    for name, domains in (("q1", {"en"}), ("q2", {"en", "de"})):
        eligible = [x for x in vectors if meta[x]["visibility"] == "public" and meta[x]["domain"] in domains]
        best = sorted(eligible, key=lambda x: (-np.float32(vectors[x][0]), x))[:3]
        assert [r.chunk_id for r in sorted(hits, key=lambda r: r.rank) if r.query_id == name] == best


def test_digits_of_any_script_are_facts(spark):
    df = spark.createDataFrame([("多少钱", "工本费２０元"), ("几点开门", "早上８:３０开门"), ("多少钱", "不清楚")], "q string, e string")
    assert [r.x for r in df.select(tx.missing_precise_fact(F.col("q"), F.col("e")).alias("x")).collect()] == [None, "开放或服务时间", "费用或金额"]
    assert [r.x for r in df.select(tx.extract_claims(F.col("e")).alias("x")).collect()][0] == []
    one = spark.createDataFrame([("费用 ２０ 元",)], "e string")
    assert one.select(tx.extract_claims(F.col("e")).alias("x")).first().x == ["２０ 元"]


def test_postings_count_inside_the_row(spark):
    rows = [("a", "t", "x y x"), ("b", "t", ""), ("c", None, None)]
    meta = [F.lit("m").alias(k) for k in retrieval.META]
    got = retrieval.build_postings(spark.createDataFrame(rows, "chunk_id string, title string, content string").select("*", *meta)).select("chunk_id", "term", "tf", "length").collect()
    assert sorted(map(tuple, got)) == [("a", "t", 3, 6), ("a", "x", 2, 6), ("a", "y", 1, 6), ("b", "t", 3, 3)]


def test_lookups_meet_each_key_once(spark):
    courses = spark.createDataFrame([(1, "Green", "周一", "08:00", "A"), (2, "Red", "周一", "09:00", "B")], "seq int, name string, weekday string, start_time string, location string")
    asked = spark.createDataFrame([(1, "monday", "green"), (2, "Monday", "green"), (3, "x", None), (4, "周一", None)], "request_id int, weekday string, keyword string")
    got = {r.request_id: r for r in lookup.course_lookup(asked, courses).collect()}
    assert got[1].n == got[2].n == 1 and got[1].text == got[2].text and got[3].text == "invalid_weekday" and got[4].n == 2
    fields = "service_code string, campus string, service_name string, status string, location string, today_hours string, queue_count int, estimated_wait_minutes int, updated_at string, provider string"
    status = spark.createDataFrame([("library", "main", "old", "open", "A", "8", 1, None, "t1", "mock"), ("library", "main", "new", "open", "A", "8", 2, None, "t2", "mock")], fields)
    told = lookup.status_lookup(spark.createDataFrame([(1, "library", None), (2, "gym", "main")], "request_id int, service_code string, campus string"), status).orderBy("request_id").collect()
    assert "new" in told[0].text and told[1].error == "invalid_argument" and len(told) == 2


def test_retry_and_its_events(spark):
    chunks = spark.createDataFrame([("a", "校园卡", "校园卡遗失后请补办"), ("b", "图书馆", "借阅规则")], "chunk_id string, title string, content string")
    asked = spark.createDataFrame([(1, "请问一卡通丢了"), (2, "图书馆借阅规则"), (3, "天气")], "query_id int, query string")
    answers = spark.createDataFrame([("校园卡遗失", "a"), ("图书馆借阅规则", "b")], "query string, chunk_id string")

    def search(q):
        found = q.join(answers, q["query"] == answers["query"]).drop(answers["query"])
        return found.select("query_id", "chunk_id", F.lit(1).alias("rank"), F.lit(1.0).alias("lexical_score"), F.lit(None).cast("double").alias("vector_score"))

    hits, passes = qa.retrieve_with_retry(asked, chunks, search)
    got = {r.query_id: r for r in passes.collect()}
    assert got[1].rewritten and got[1].initial_status == "insufficient" and got[1].final_query.startswith("校园卡") and got[1].attempts == 2
    assert got[2].status == "relevant" and got[2].attempts == 1 and not got[3].rewritten
    events = {r.query_id: list(r.events) for r in qa.trace_events(passes).collect()}
    assert events[1] == ["retrieve", "grade", "rewrite", "retrieve", "grade", "verify"]
    assert events[2] == ["retrieve", "grade", "verify"] and events[3] == ["retrieve", "grade", "rewrite", "verify"]


def test_issues_name_file_and_line(spark):
    line = '{"id":"%s","task":"retrieval","split":"dev","query":"q%d","request":{"top_k":3,"filters":{}},"expected":{"answerable":true,"relevant_document_ids":["nope"],"relevant_chunk_ids":["c"],"domain":"","category":""},"tags":["t"],"difficulty":"easy"}'
    cases = evaluation.parse_cases(spark.createDataFrame([("f.jsonl", 1, line % ("x", 1)), ("f.jsonl", 2, line % ("x", 2))], "source_file string, source_line int, json string"))
    meta = [F.lit("public" if k == "visibility" else "m").alias(k) for k in retrieval.META]
    chunks = spark.createDataFrame([("c", "t", "text")], "chunk_id string, title string, content string").select("*", *meta)
    got = {tuple(r) for r in evaluation.validate_cases(cases, chunks).collect()}
    assert ("x", "duplicate_id", "f.jsonl", 2) in got and ("x", "unknown_document:nope", "f.jsonl", 1) in got and ("x", "chunk_document_mismatch", "f.jsonl", 2) in got
