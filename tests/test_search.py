"""BM25 by bounded blocks, vector search by cells, and filters met by equal keys, against brute force."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrand.functions.text import python_tokens
from lodestrand.operators import filters as flt
from lodestrand.operators import lexical, nearest

KEYS = [*flt.BITS, "visibility"]
CHUNK = "chunk_id string, title string, content string, " + ", ".join(f"{k} string" for k in KEYS)
FILTER = "filter_id string, " + ", ".join(f"{k} string" for k in KEYS)


def corpus(rng, n):
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(4000)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 20, 150])))
        rows.append((f"c{i:03}", rng.choice(["", "w1", "w7 w9"]), text, f"d{i % 50}", f"n{i % 9}", rng.choice(["en", "de", None]), rng.choice("xy"), "1", rng.choice(["public", "public", "private", None])))
    return rows + [(f"k{i}", "same", "w3 w4 w3 w250", "d", "n", "en", "x", "1", "public") for i in range(6)]


def random_filters(rng, rows, n):
    out = [("all", None, None, None, None, None, None), ("private", None, None, "en", None, None, "private")]
    for i in range(n):
        like = rng.choice(rows)[3:8]
        out.append((f"f{i}", *(v if rng.random() < 0.4 else None for v in like), rng.choice([None, "public"])))
    return out


def lets(f, chunk):
    return (f[6] or "public") == chunk[8] and all(want is None or want == has for want, has in zip(f[1:6], chunk[3:8], strict=True))


def test_filters_against_the_theta_join(spark):
    rng = random.Random(3)
    rows = corpus(rng, 120)
    asked = random_filters(rng, rows, 25)
    c, f = spark.createDataFrame(rows, CHUNK), spark.createDataFrame(asked, FILTER)
    got = sorted(map(tuple, flt.apply_filters(c, f).collect()))
    assert got == sorted((x[0], r[0]) for x in asked for r in rows if lets(x, r))
    join = flt.meet(c, f, flt.filter_masks(f))
    assert "Nested" not in join._jdf.queryExecution().executedPlan().toString()
    assert flt.apply_filters(c, f.where("false")).count() == 0


def brute_bm25(queries, chunks, filters, k, least=2):
    out = {}
    own = {f[0]: [c for c in chunks if lets(f, c)] for f in filters}
    for name, text, fid in queries:
        terms = collections.Counter(python_tokens(text))
        informative = {t for t in terms if len(t) >= 2}
        docs = {c[0]: python_tokens(" ".join(x for x in (c[1], c[1], c[1], c[2]))) for c in own[fid]}
        if not informative or not docs:
            continue
        average = sum(map(len, docs.values())) / len(docs)
        df = {t: sum(t in d for d in docs.values()) for t in terms}
        scored = []
        for cid, d in docs.items():
            tf = collections.Counter(d)
            met = len({t for t in informative if tf[t]})
            s = sum(q * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(d) / average)) for t, q in terms.items() if tf[t])
            if met >= min(least, len(informative)) and s > 0:
                scored.append((-round(s, 9), cid))
        for rank, (s, cid) in enumerate(sorted(scored)[:k], 1):
            out[name, rank] = (cid, -s)
    return out


@pytest.mark.parametrize("seed, k", [(1, 3), (2, 1), (3, 20)])
def test_bm25_against_all_scores(spark, seed, k, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_BITS", 2)
    rng = random.Random(seed)
    rows = corpus(rng, 300)
    asked = random_filters(rng, rows, 4)
    queries = [(i, " ".join(f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(rng.choice([1, 2, 5, 30]))), rng.choice(asked)[0]) for i in range(40)]
    queries += [(90, "w3 w4 w250", "all"), (91, "", "all"), (92, "? !", "all"), (93, "nothing here", "all"), (94, "w3 w3 w3 w4", "private")]
    q, f = spark.createDataFrame(queries, "query_id long, query string, filter_id string"), spark.createDataFrame(asked, FILTER)
    c = spark.createDataFrame(rows, CHUNK).repartition(3)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in lexical.bm25_search(q, c, lexical.build_postings(c), f, k).collect()}
    want = brute_bm25(queries, rows, asked, k)
    assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
    assert all(got[key][1] == pytest.approx(want[key][1], abs=1e-8) for key in want)


def test_blocks_under_the_floor_meet_no_query(spark, monkeypatch):
    """Few chunks have the rare words: the blocks of all the others are not scored."""
    monkeypatch.setattr(lexical, "BLOCK_BITS", 3)
    rows = [(f"c{i:04}", "t", "common words here " + ("rare gem " * 3 if i % 300 == 5 else "filler " * (i % 7)), "d", "n", "en", "x", "1", "public") for i in range(1500)]
    c, f = spark.createDataFrame(rows, CHUNK).coalesce(1), spark.createDataFrame([("all", *[None] * 6)], FILTER)
    q = spark.createDataFrame([(1, "common words rare gem", "all")], "query_id long, query string, filter_id string")
    seen = []
    scores = lexical._scores
    monkeypatch.setattr(lexical, "_scores", lambda some, *rest: seen.append(some.count()) or scores(some, *rest))
    found = [r.chunk_id for r in lexical.bm25_search(q, c, lexical.build_postings(c), f).orderBy("rank").collect()]
    assert found == ["c0005", "c0305", "c0605"] and seen[0] <= 4 and seen[1] <= 10 < 1500 / 8


def unit(x):
    return (x / np.maximum(np.sqrt((x * x).sum(-1, keepdims=True)), 1e-12)).astype(np.float32)


@pytest.mark.parametrize("cells, tile, k, least", [(1, 50, 3, 0.22), (8, 7, 5, 0.3), (64, 4096, 2, -1.0), (5, 1000, 4, 0.999999)])
def test_vectors_against_all_pairs(spark, cells, tile, k, least):
    """Clusters, many equal vectors, zero vectors and queries; cells and tiles change nothing."""
    rng = np.random.default_rng(cells)
    middle = rng.normal(size=(6, 16))
    x = unit(np.concatenate([middle[rng.integers(0, 6, 200)] + 0.3 * rng.normal(size=(200, 16)), np.repeat(middle[:1], 40, 0)]))
    x[7] = 0
    q = unit(np.concatenate([middle + 0.1 * rng.normal(size=middle.shape), rng.normal(size=(20, 16)), middle[:1]]))
    q[3] = 0
    vectors = spark.createDataFrame([(f"c{i:03}", row.tolist()) for i, row in enumerate(x)] + [("null", None)], "chunk_id string, vector array<float>").repartition(3)
    queries = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(q)], "query_id long, vector array<float>").repartition(2)
    got = {(r.query_id, r["rank"]): (r.chunk_id, r.score) for r in nearest.vector_search(queries, vectors, k, least, cells, tile).collect()}
    scores = np.round(q.astype(float) @ x.astype(float).T, 9)
    want = {}
    for i, line in enumerate(scores):
        if q[i].any():
            for rank, (s, name) in enumerate(sorted((-s, f"c{j:03}") for j, s in enumerate(line) if s >= least)[:k], 1):
                want[i, rank] = (name, -s)
    assert {key: v[0] for key, v in got.items()} == {key: v[0] for key, v in want.items()}
    assert all(got[key][1] == pytest.approx(want[key][1], abs=1e-8) for key in want)


def test_far_cells_are_left_out(spark):
    rng = np.random.default_rng(1)
    x = unit(np.eye(8)[np.arange(400) % 8] + 0.01 * rng.normal(size=(400, 8)))
    v = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "chunk_id long, vector array<float>")
    placed, pivots, extents = nearest.in_cells(v, 64)
    asked = spark.createDataFrame([(0, np.eye(8)[2].tolist())], "query_id long, vector array<double>")
    reached = {r.cell for r in nearest.reachable(asked, pivots, extents, 0.5, 4096).collect()}
    assert reached == {r.cell for r in extents if pivots[r.cell] @ np.eye(8)[2] > 0.5}
    assert placed.count() == 400 and sum(r.n for r in extents) == 400


def test_no_vectors_no_hits(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id long, vector array<float>")
    v = spark.createDataFrame([], "chunk_id string, vector array<float>")
    assert nearest.vector_search(q, v).count() == 0
    some = spark.createDataFrame([("a", [1.0, 0.0], ["f"]), ("b", [1.0, 0.0], None)], "chunk_id string, vector array<float>, open_to array<string>")
    asked = q.withColumn("filter_id", F.lit("f"))
    assert [r.chunk_id for r in nearest.vector_search(asked, some).collect()] == ["a"]
    assert nearest.vector_search(asked.where("false"), some).count() == 0
