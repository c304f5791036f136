"""Vector codes, conversation tries and the quality classifier against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lodestrand.llm import prefix_trie as trie
from lodestrand.llm import quality_model as qm
from lodestrand.llm import vector_codes as vc

# --- vector codes -------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v int, own_label int"


def brute_codes(rows, entries=64, rounds=2):
    whole = [(i, [min(max(int(np.floor(256 * float(x))), -vc.LIMIT), vc.LIMIT) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not whole:
        return []
    width = -(-max([1, *(len(v) for _, v, _ in whole)]) // 16) * 16
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in whole], np.int64).reshape(len(whole), 16, -1)
    order = sorted(range(len(whole)), key=lambda i: (whole[i][0] is None, whole[i][0] or 0, whole[i][1]))[:entries]
    book = x[order].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([((x[:, p, None, :] - book[p][None]) ** 2).sum(2).argmin(1) for p in range(16)], 1)
    for _ in range(rounds):
        codes = nearest()
        for p in range(16):
            for e in range(book.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(0) // len(own)
    codes = nearest()
    errors = sum(((x[:, p] - book[p][codes[:, p]]) ** 2).sum(1) for p in range(16))
    totals = collections.Counter()
    for (_, _, label), e in zip(whole, errors, strict=True):
        totals[label] += int(e)
    sha = hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()
    return [(i, bytes(c.astype(np.uint8)).hex(), int(e), totals[label], sha) for (i, _, label), c, e in zip(whole, codes, errors, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 1, 1) for r in rows], VECTORS)


def coded(df):
    return sorted(map(str, (tuple(r) for r in vc.compress(df).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect())))


def cases():
    rng = np.random.default_rng(4)
    normal = lambda n, d=64: [(i, rng.normal(0, 0.3, d).astype(np.float32).tolist(), [0, 1, None][i % 3]) for i in range(n)]
    odd = [(900, None, 1), (901, [float("nan")] + [0.0] * 63, 1), (902, [None] * 64, 1), (903, [float("inf")] * 64, 1)]
    yield "many", normal(700) + odd
    yield "clusters and ties", [(i, (np.repeat(i % 7, 64) + rng.integers(0, 3, 64) / 256).tolist(), 1) for i in range(300)] + [(5, [0.5] * 64, None)] * 80
    yield "few", normal(9) + odd
    yield "lengths", normal(40, 20) + normal(40, 3) + [(3, [], 0), (None, [0.25] * 5, None)]
    yield "large", normal(90) + [(1000, [3e38] * 64, 5), (1001, [-3e38] + [1e5] * 63, 5)]
    yield "none", odd


@pytest.mark.parametrize("name, rows", [pytest.param(n, r, id=n) for n, r in cases()])
def test_vector_codes(spark, name, rows):
    assert coded(vectors(spark, rows).repartition(3)) == sorted(map(str, brute_codes(rows)))


def test_bounds_spare_distances_and_stay_exact():
    """Small moves of the entries: few rows look at entries beyond their own, and every answer is that of all distances."""
    rng = np.random.default_rng(2)
    book = rng.integers(-90, 90, (64, 4)).astype(np.int64)
    x = book[rng.integers(0, 64, 4000)] + rng.integers(-9, 10, (4000, 4))
    near, upper, lower = vc.opened(vc.squares(x[None], book[None])[0], 16)
    for step in (0, 1, 4, 60):
        moved = book + rng.integers(-step, step + 1, book.shape)
        drift = np.sqrt(((moved - book) ** 2).sum(1).astype(float))
        near, upper, lower, depth = vc.advance(x, near, upper, lower, moved, drift)
        d2 = ((x[:, None] - moved) ** 2).sum(2)
        assert (near[:, 0] == d2.argmin(1)).all()
        assert (upper.astype(float) ** 2 >= d2.min(1) - 1e-9).all()
        roots = np.sqrt(np.take_along_axis(d2, near[:, 1:].astype(int), 1))
        assert (lower[:, :-1] <= roots + 1e-9).all()
        if step <= 1:
            assert (depth == 0).mean() > 0.5 and (depth == 16).mean() < 0.05
        book = moved


def test_kept_entries_follow_need():
    b = vc.next_b(16, np.array([[16] * 8 + [0] * 8, [3] * 16, [9] * 16]), 64)
    assert b.tolist() == [32, 8, 16]


# --- conversation trie --------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, d int, p1 string, place int"


def brute_trie(rows):
    turns = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own = hashlib.md5((hashlib.md5((role or "").encode()).hexdigest() + hashlib.md5((text or "").encode()).hexdigest()).encode()).hexdigest()
            turns[c].append((t is not None, t or 0, own, (role or "", text or "")))
    turns = {c: [x[-1] for x in sorted(v)] for c, v in turns.items()}
    rebuilt = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(np.fmod(c, 20))
        rebuilt[c] = tuple(turns.get(base, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c in sorted(rebuilt):
        for d in range(len(rebuilt[c]) + 1):
            members[rebuilt[c][:d]].append(c)
    children = collections.defaultdict(list)
    for k in members:
        if k:
            children[k[:-1]].append(k)
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        own = (len(members[k]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        leaves[k] = sum(leaves[x] for x in children[k]) or 1
        saved[k] = own + sum(saved[x] for x in children[k])
    sha = lambda k: hashlib.sha256(",".join(str(c) for c in members[k] if len(rebuilt[c]) == len(k)).encode()).hexdigest()
    return sorted((m[0], len(k), members[k[:-1]][0] if k else -1, len(m), len(children[k]), leaves[k], saved[k], sha(k)) for k, m in members.items())


def trie_rows(df, **how):
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(-1 if v is None else v for v in r) for r in trie.conversation_trie(df, **how).select(*names).collect())


def talks():
    rng = random.Random(5)
    say = lambda: " ".join(rng.choice(["yes", "no", "why", "so\tthen", "ünd"]) for _ in range(rng.randrange(3)))
    out = []
    for c in [*range(0, 130), -7, -40, 2**40]:
        if c % 31 == 11:
            continue
        for t in range(rng.randrange(1, 7)):
            out.append((c, t, rng.choice(["user", "assistant", None]), rng.choice([say(), None, "", "hello there"])))
    out += [(None, 0, "user", "lost"), (21, 1, "user", "again"), (21, 1, "user", "again"), (21, None, None, None), (45, None, "user", "first")]
    out += [(200 + c, t, "user", f"same {t}") for c in range(60) for t in range(3)]
    return out


@pytest.mark.parametrize("band", [2, 4])
def test_trie(spark, band):
    rows = talks()
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)
    assert trie_rows(df.repartition(3), band=band) == brute_trie(rows)


def test_trie_of_one_long_conversation_in_many_tasks(spark):
    """One conversation has most rows: its places, hashes and subtree sums run through many tasks and bands."""
    rows = [(40, t, "user", f"turn {t % 50} of {t}") for t in range(700)] + [(41 + c, t, "user", f"turn {t % 50} of {t}") for c in range(8) for t in range(20 * c)]
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        assert trie_rows(spark.createDataFrame([(*r, 1, "x", 2) for r in rows], TURNS)) == brute_trie(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "2")


def test_hash_of_very_many_members(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS", 7)
    ends = spark.createDataFrame([(1, 5, 6, i) for i in range(1000)] + [(2, 5, 6, 3)], "d long, p1 long, p2 long, conv_id long")
    got = {(r.d, r.sha) for r in trie.member_hashes(ends.repartition(4)).collect()}
    assert got == {(1, hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()), (2, hashlib.sha256(b"3").hexdigest())}


def test_trie_of_nothing(spark):
    assert trie_rows(spark.createDataFrame([], TURNS)) == []
    assert trie_rows(spark.createDataFrame([(None, 1, "user", "x", 1, "x", 2)], TURNS)) == []


# --- quality classifier -------------------------------------------------------------------------

DOCS = "doc_id long, text string, lang string, score double, held_out string, model string, one int"


def prose(rng, n=150):
    return " ".join(rng.choice(["the", "river", "of", "stone", "and", "light", "runs", "a", "day", "to"]) for _ in range(n)) + "."


def junk(rng, n=150):
    return " ".join(rng.choice(["BUY", "NOW!!", "###", "$$$", "click", "A1%%"]) for _ in range(n))


def test_gradients_against_differences():
    rng = random.Random(1)
    model = qm.Model(qm.Mil(width=5, gates=3))
    model.w["out"] = np.linspace(-1, 1, 5)
    parts = qm._inputs([qm.encode(t.encode()) for t in (prose(rng, 200), junk(rng, 90), "", prose(rng, 3))])
    y = np.array([1.0, 0, 1, 0])

    def loss():
        p = model.score(model.attend(model.passages(*parts[:2]), parts[2])[1])
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in model.gradients(*parts, y).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = model.w[name][at]
        model.w[name][at] = old + 1e-3
        up = loss()
        model.w[name][at] = old - 1e-3
        down = loss()
        model.w[name][at] = old
        assert g[at] == pytest.approx((up - down) / 2e-3, rel=0.02, abs=1e-5), name


def test_attention_finds_the_poor_passage():
    """One of many passages is junk: attention, learnt from document labels alone, leads to it."""
    rng = random.Random(3)
    texts, labels = [], []
    for i in range(300):
        words = [prose(rng, 64)[:-1] for _ in range(6)]
        if i % 2:
            words[rng.randrange(6)] = junk(rng, 64)
        texts.append(" ".join(words).encode())
        labels.append(1 - i % 2)
    model = qm.fit(texts[:240], np.array(labels[:240], float), qm.Mil(epochs=10))
    scores = np.array(list(model.scores(texts[240:])))
    assert ((scores >= 0.5) == np.array(labels[240:])).mean() > 0.95
    x, s, starts = qm._inputs([qm.encode(texts[241])])
    share = model.attend(model.passages(x, s), starts)[0]
    assert "#" in texts[241].decode() and share.max() > 2 / 6


def test_encoding_in_parts(monkeypatch):
    rng = random.Random(8)
    text = (prose(rng, 5000) + " " + "x" * 3000).encode()
    whole = qm.encode(text)
    assert len(whole[2]) == -(-5001 // 64)
    monkeypatch.setattr(qm, "PART", 1000)
    assert b"".join(qm._parts(text)) == text and len(qm.encode(text)[2]) > 30
    model = qm.Model(qm.Mil())
    model.w["out"] = np.ones(16)
    assert next(model.scores([text], at_once=10**6)) == pytest.approx(next(model.scores([text], at_once=5)), abs=1e-5)


def test_quality_scores(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, rng.randrange(20, 300)) if i % 3 else junk(rng, rng.randrange(20, 300))) for i in range(400)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "x" * 200_000), (404, prose(rng, 100_000)), (5, prose(rng)), (5, prose(rng)), (None, prose(rng))]
    docs = spark.createDataFrame([(*r, "en", 0.5, "x", "m", 1) for r in rows], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(None, 1, 0), (3, None, 0), (9, 7, 0), (400, 1, 0)], "doc_id long, quality int, toxic int")
    got = qm.quality_scores(docs, labels).toPandas()
    assert got.columns.tolist() == ["doc_id", "held_out", "score", "predicted"] and len(got) == len(rows)
    assert got["score"].between(0, 1).all() and ((got["score"] >= 0.7) == (got["predicted"] == 1)).all()
    named = got.dropna(subset="doc_id")
    assert all(h == (zlib.crc32(str(int(i)).encode()) % 4 == 2) for i, h in zip(named["doc_id"], named["held_out"], strict=True))
    held = named[named["held_out"] & (named["doc_id"] < 400)]
    assert len(held) > 60 and (held["predicted"] == (held["doc_id"] % 3 > 0)).mean() > 0.97
    again = qm.quality_scores(docs.repartition(5), labels.repartition(3)).toPandas()
    assert np.allclose(sorted(got["score"]), sorted(again["score"]), atol=1e-6)
    assert set(qm.quality_scores(docs, labels.where("false")).toPandas()["score"]) == {0.5}
    assert qm.quality_scores(docs.where("false"), labels).count() == 0
