"""Corpus operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import collections
import hashlib
import random
import re
import time
from importlib.resources import files

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrand.llm import licenses
from lodestrand.llm import passages as ps
from lodestrand.llm import token_shards as ts
from lodestrand.llm import warc as wz
from lodestrand.llm.common import components, word_hashes
from lodestrand.llm.decontam import decontaminate
from lodestrand.llm.licenses import TEMPLATES, license_matches, license_scan
from lodestrand.llm.mixing import WEIGHTS, domain_of, mix, mixed_rows
from lodestrand.llm.near_dup import near_duplicates, odd_estimate
from lodestrand.llm.quality import quality_filter, quality_rules
from lodestrand.llm.token_counts import TOKENIZER, token_counts, tokenizer_path
from lodestrand.llm.toxicity import Ftrl, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, node long, word string, rank int, row int, tkey string, epochs long, n int"
RNG = random.Random(11)
VOCAB = [f"w{i}" for i in range(400)] + ["the", "and", "of", "naïve", "Über,"]


def text(n, rng=RNG):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def near(base, edits, rng=RNG):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
    return " ".join(words)


BASE = text(120)
TEXTS = [
    BASE, BASE, near(BASE, 1), near(BASE, 2), near(BASE, 3), near(BASE, 6), near(BASE, 12), text(80), None, "", " \n\t ", "one two", "One two", "a b c d e", "the end",
    text(6000), "line\n" * 40, "<|endoftext|> it's <|STARTOFTEXT|> ÀÉ ß ΑΣ 'll 42", "Released under the MIT License.\n" + text(30), text(60) + " " + " ".join(BASE.split()[20:75]),
]


def make(spark, texts=TEXTS, repeat=True):
    rows = [(i, t, ["en", "de", None][i % 3], ["hot", "hot", "s1", None][i % 4], None if t is None else len(t), "k", 1, "w", 1, 1, "t", 1, 1) for i, t in enumerate(texts)]
    if repeat and rows:
        rows += [rows[0], rows[7], (None, "lost " + text(30, random.Random(3)), "en", "hot", 1, "k", 1, "w", 1, 1, "t", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(df, *columns):
    return collections.Counter(tuple(r[c] for c in columns) for r in df.collect())


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def test_token_counts(docs, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    expected = collections.Counter()
    for r in docs.collect():
        n = len(t.encode(r.text or "", add_special_tokens=False).ids)
        expected[(r.doc_id, len((r.text or "").encode()), n, n > 2048)] += 1
    for frequent in (1 << 18, 20, 1):
        assert pairs(token_counts(docs, frequent=frequent), "doc_id", "n_bytes", "n_tokens", "over_limit") == expected
    assert token_counts(empty).count() == 0


def test_token_counts_of_long_words(spark):
    """Many distinct long words: none of them is broadcast, and counts are those of the tokenizer."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdefg") for _ in range(rng.choice([3, 40, 300]))) for _ in range(30)) for _ in range(40)] + ["z" * 50_000, text(50)]
    t = Tokenizer.from_file(tokenizer_path(TOKENIZER))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for size in (0, 20, 64):
        got = {r.doc_id: r.n_tokens for r in token_counts(df, word_bytes=size).collect()}
        assert got == {i: len(t.encode(x, add_special_tokens=False)) for i, x in enumerate(texts)}


def test_quality(docs, empty):
    expected = collections.Counter()
    for r in docs.collect():
        w = words(r.text)
        at = collections.defaultdict(list)
        for i in range(len(w) - 7):
            at[tuple(w[i : i + 8])].append(i)
        hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        expected[(r.doc_id, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text or ""), len(lines) - len(set(lines)), len(hit), failed)] += 1
    got = quality_rules(docs)
    assert pairs(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == expected
    kept = quality_filter(docs)
    assert kept.columns == docs.columns and pairs(kept, "doc_id") == pairs(got.where("kept"), "doc_id")
    assert quality_rules(empty).count() == 0 and quality_filter(empty).count() == 0


def shingle_set(t):
    w = lower(t).encode().split()
    return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(rows):
    sets = {r.doc_id: shingle_set(r.text) for r in rows if r.doc_id is not None}
    group = {i: i for i in sets}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    return collections.Counter((r.doc_id, len(shingle_set(r.text)), None if r.doc_id is None else root(r.doc_id)) for r in rows)


def test_near_duplicates(spark, docs, empty):
    assert pairs(near_duplicates(docs), "doc_id", "n_shingles", "component_id") == brute_components(docs.collect())
    assert near_duplicates(empty).count() == 0
    assert near_duplicates(make(spark, ["a b c d e f", "z y"], False)).where("kept").count() == 2


def test_near_duplicates_of_a_large_group_in_blocks(spark):
    rng = random.Random(5)
    base = text(100, rng)
    many = make(spark, [base] * 5 + [near(base, rng.randrange(0, 7), rng) for _ in range(120)] + [text(50, rng) for _ in range(10)], False)
    expected = brute_components(many.collect())
    for size in (1000, 16):  # one block, and hub links with minor blocks
        assert pairs(near_duplicates(many, block_docs=size), "doc_id", "n_shingles", "component_id") == expected


def test_odd_sketch_estimates():
    assert odd_estimate(0) == 1 and odd_estimate(np.array([40])) > odd_estimate(np.array([80]))


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101)], "a long, b long")
    got = {r.node: r.comp for r in components(edges).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 103: 100}


def test_decontamination(spark, docs, empty):
    items = [(1, " ".join(BASE.split()[30:55])), (10, " ".join(BASE.split()[30:42]).upper()), (2, "One TWO"), (3, "the"), (4, None), (5, "!!"), (None, BASE), (2, "one two"), (7, text(40, random.Random(8)))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit("x"))
    item_words = [(i, re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))) for i, t in items if i is not None]
    expected = collections.Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text))
        hit, ids = set(), set()
        for i, iw in item_words:
            n = min(10, len(iw))
            for p in range(len(iw) - n + 1 if n else 0):
                for q in range(len(w) - n + 1):
                    if w[q : q + n] == iw[p : p + n]:
                        hit.update(range(q, q + n)), ids.add(str(i))
        expected[(r.doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    columns = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert pairs(decontaminate(docs, bench), *columns) == expected
    assert decontaminate(empty, bench).count() == 0
    assert decontaminate(docs, bench.limit(0)).where("contaminated or n_hit > 0").count() == 0


def brute_mix(rows, percent=60, epochs=4):
    leaves = collections.defaultdict(int)
    for r in rows:
        leaves[r.path] += len(words(r.text))
    leaves = {k: v for k, v in leaves.items() if v}
    cap = lambda p: sum(v * epochs for k, v in leaves.items() if k[: len(p)] == p)
    budget = {(): min(sum(leaves.values()) * percent // 100, cap(()))}
    for depth in (1, 2, 3):
        nodes = {k[:depth] for k in leaves}
        for parent in {n[:-1] for n in nodes}:
            left, kids = budget[parent], [n for n in nodes if n[:-1] == parent]
            while kids:
                total = sum(WEIGHTS.get(n, 1) for n in kids)
                full = [n for n in kids if cap(n) * total <= WEIGHTS.get(n, 1) * left]
                if not full:
                    budget |= {n: WEIGHTS.get(n, 1) * left // total for n in kids}
                    break
                budget |= {n: cap(n) for n in full}
                left, kids = left - sum(cap(n) for n in full), [n for n in kids if n not in full]
    out = collections.Counter()
    for leaf, n in leaves.items():
        whole, rest = divmod(budget[leaf], n)
        own = [(hashlib.md5(f"mix-{whole}-{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id, len(words(r.text))) for r in rows if r.path == leaf and words(r.text)]
        for key, i, _ in own:
            for e in range(whole):
                out[(i, e)] += 1
            if sum(m for k, _, m in own if k <= key) <= rest:
                out[(i, whole)] += 1
    return out


@pytest.mark.parametrize("percent", [20, 60, 150, 900])
def test_mixing(docs, percent):
    rows = docs.withColumn("path", F.array(domain_of(F.col("source")), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit("")))).collect()
    for i, r in enumerate(rows):
        rows[i] = collections.namedtuple("R", "doc_id text path")(r.doc_id, r.text, tuple(r.path))
    got = pairs(mix(docs, percent), "doc_id", "epoch")
    assert got == brute_mix(rows, percent)
    whole = mixed_rows(docs, percent=percent)
    assert whole.columns == docs.columns and whole.count() == sum(got.values())


def test_mixing_of_nothing(empty):
    assert mix(empty).count() == 0 and mixed_rows(empty).count() == 0


def test_warc_round_trip(spark, tmp_path):
    html = "<p>" + text(400) + "</p>"
    rows = [(5, "http://a", html), (3, "http://b\nc", html), (3, "http://b\nc", html), (9, None, None), (8, "u", ""), (None, "n", html), (None, None, "x"), (7, "é", "é" * 1000)] + [(100 + i, f"u{i}", text(60)) for i in range(60)]
    pages = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, hash string, size int")
    folder = f"file://{tmp_path}/warc"
    manifest = wz.write_archives(pages, folder)
    back = wz.read_archives(manifest, folder).collect()
    assert collections.Counter(r.payload.decode() for r in back if r.record_type == "response") == collections.Counter({h or "" for _, _, h in rows})
    for name in [r.archive for r in manifest.collect()]:
        with open(f"{tmp_path}/warc/{name}", "rb") as f:
            assert int.from_bytes(f.read(4), "little") == wz.DICT_MAGIC
    groups, expected = collections.defaultdict(list), collections.Counter()
    for i, _, h in rows:
        groups[h or ""].append(i)
    for h, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i))
        for n, i in enumerate(ids):
            expected[(i, len(h.encode()), wz.sha1_base32(h.encode()), "revisit" if n else "response", ids[0] if n else None)] += 1
    assert pairs(wz.archive_pages(pages), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == expected
    assert wz.archive_pages(pages.limit(0)).count() == 0
    assert wz.archive_pages(pages, least_bytes=10**6).where("record_type = 'revisit'").count() == 0


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 7, 64, 1000):
        f = ts.Feistel(n, 9)
        slots = f.slot(np.arange(n))
        assert sorted(slots) == list(range(n)) and (f.sequence(slots) == np.arange(n)).all()


def test_token_shards(docs, empty, tmp_path):
    more = docs.union(docs.limit(1).withColumn("text", F.lit("a  b \n\n \n c\t d e \n")))
    shards = ts.write_shards(more, f"file://{tmp_path}/s", length=64, shard_bytes=1 << 11)
    rows = sorted(shards.read().collect(), key=lambda r: r.sequence)
    assert [r.sequence for r in rows] == list(range(shards.n_sequences)) and len({r.slot for r in rows}) == len(rows)
    ids = np.frombuffer(b"".join(r.ids for r in rows), ts.UNIT)
    assert (ids[shards.n_tokens :] == ts.END).all()
    encoding, out, start = ts._encoding(ts.tokenizer_path(ts.TOKENIZER)), [], 0
    for end in np.flatnonzero(ids[: shards.n_tokens] == ts.END):
        out.append(encoding.decode(ids[start:end].tolist()))
        start = end + 1
    texts = [r.text or "" for r in more.collect()]
    assert collections.Counter(out) == collections.Counter(texts)
    own = ts.tokenizer_path(ts.TOKENIZER)
    assert all(ts.encoded(t, own) == encoding.encode_ordinary(t) for t in texts)
    odd = random.Random(5)
    for _ in range(400):
        t = "".join(odd.choice(["a", "Bc", "'s", "9", "é", ".", "中文", " ", "  ", "\n", "\t", "\r\n", "\x1c", "\x85", "\u3000", "\u200b", "\xa0"]) for _ in range(odd.randrange(14)))
        assert ts.encoded(t, own) == encoding.encode_ordinary(t), ascii(t)
    # what a dead attempt has left is not read, and the folder alone is enough
    (tmp_path / "s" / "shard-000000-000000-9-9.bin").write_bytes(b"x" * 999)
    again = ts.Shards(docs.sparkSession, f"file://{tmp_path}/s")
    assert again.read().select("slot", "crc32").exceptAll(shards.read().select("slot", "crc32")).isEmpty() and again.read().count() == len(rows)
    assert again.read().rdd.getNumPartitions() == again.n_shards
    one = rows[len(rows) // 2]
    name = next(r.file for r in shards.files.collect() if r.shard == one.shard)
    with open(f"{tmp_path}/s/{name}", "rb") as f:
        f.seek(one.byte_offset)
        assert f.read(128) == bytes(one.ids)
    assert ts.token_shards(empty).count() == 0


def test_toxicity_learns_and_holds_out(spark):
    rng, bad = random.Random(2), ("idiot", "moron", "clown")
    rows = []
    for i in range(900):
        w = text(40, rng).split()
        if i % 6 == 0:
            for b in rng.sample(bad, 2):
                w.insert(rng.randrange(len(w)), b)
        rows.append((i, " ".join(w), int(i % 6 == 0)))
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = labelled.select("doc_id", "toxic", F.lit("x").alias("text"), F.lit(1).alias("label"), F.lit(2).alias("rank"))
    docs = labelled.select("doc_id", "text", F.lit(1).alias("score")).union(spark.createDataFrame([(None, None, 1), (5000, "", 1)], "doc_id long, text string, score int"))
    got = toxicity(docs, labels, Ftrl(bits=16)).join(labelled.select("doc_id", F.col("toxic").alias("y")), "doc_id", "left").collect()
    assert len(got) == 902 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.y is not None]
    assert len(held) > 100 and sum(r.predicted == r.y for r in held) / len(held) > 0.95
    assert {r.score for r in toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity(docs.limit(0), labels).count() == 0


def test_license_scan(spark, docs, empty):
    from lodestrand.llm.licenses import TEMPLATES

    mit = TEMPLATES["MIT"][2]
    changed = mit.replace("hereby granted", "granted hereby").lower()
    rows = make(spark, ["Licensed under the Apache License, Version 2.0.", text(50) + "\n\n" + changed + "\n\n" + text(50), text(100), None, "Copyright"], False)
    got = {r.doc_id: r.license for r in license_scan(rows).collect()}
    assert got == {0: "Apache-2.0", 1: "MIT", 2: None, 3: None, 4: None}
    assert license_scan(docs).where("license = 'MIT'").count() == 1 and license_scan(empty).count() == 0

    def grams(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return set(zip(w, w[1:]))

    for r in license_matches(rows).collect():  # every match against brute force
        raw = {i: t for i, t in rows.select("doc_id", "text").collect()}[r.doc_id]
        for m in r.matches:
            a = grams((raw or "").encode()[m.start : m.end].decode())
            assert m.dice == pytest.approx(max(2 * len(a & grams(t)) / (len(a) + len(grams(t))) for t in TEMPLATES[m.license]))


def test_rolling_hash():
    h = np.random.default_rng(3).integers(0, 2**32, 300, dtype=np.uint32)
    h[200:240] = h[20:60]
    got = ps.rolling(h, 7)
    assert len(got) == 294 and (got[200:234] == got[20:54]).all() and len(set(got.tolist())) == 294 - 34
    assert len(ps.rolling(h, 301)) == 0


def test_chain_and_alignment():
    a, b = np.arange(100, dtype=np.uint32), np.concatenate([np.arange(50), [999], np.arange(51, 100)]).astype(np.uint32)
    at = np.array([0, 10, 30, 60, 80])
    found = ps.chains(at, at, np.full(5, 8), 16, 0.3, 5)
    assert ps.passages(a, b, found, 50, 75) == [(0, 100, 0, 100, 99)]
    assert len(ps.chains(np.array([0, 50]), np.array([50, 0]), np.full(2, 8), 16, 0.3, 5)) == 2
    # words put in, and words left out
    c = np.concatenate([a[:40], [7777, 7778], a[40:70], a[73:]]).astype(np.uint32)
    found = ps.chains(np.array([0, 42, 72]), np.array([0, 40, 73]), np.array([40, 30, 27]), 12, 0.3, 5)
    assert len(found) == 1 and ps.passages(c, a, found, 50, 75) == [(0, 99, 0, 100, 97)]


def test_stretches_against_brute_force():
    """Each stretch found is long and good enough, and each exact run of 50 is in one."""
    rng = np.random.default_rng(8)
    for _ in range(300):
        equal = rng.random(int(rng.integers(0, 400))) < rng.choice([0.3, 0.6, 0.75, 0.85])
        run = None
        if len(equal) > 60 and rng.random() < 0.5:
            run = int(rng.integers(0, len(equal) - 50))
            equal[run : run + 50] = True
        got = ps.stretches(equal, 50, 75)
        sums = [0, *np.cumsum(equal).tolist()]
        some = any(4 * (sums[j] - sums[i]) >= 3 * (j - i) for i in range(len(equal)) for j in range(i + 50, len(equal) + 1))
        assert ps.any_stretch(equal, 50, 75) == some and bool(got) <= some
        assert all(j - i >= 50 and equal[i:j].mean() >= 0.75 for i, j in got)
        assert run is None or any(i < run + 25 < j for i, j in got)


def test_shared_passages(spark, empty):
    rng = random.Random(4)
    passage = text(64, rng)
    texts = [text(rng.randrange(10, 80), rng) + " " + near(passage, e % 4, rng) + " " + text(rng.randrange(10, 80), rng) for e in range(12)]
    clean = [text(150, rng) for _ in range(12)]
    df = make(spark, texts + clean + [None, "", "short one"])
    got = ps.shared_passages(df).collect()
    assert {r.doc_id for r in got} | {r.source_id for r in got} == set(range(12))
    assert {r.doc_id for r in got} == set(range(1, 12))
    for r in got:
        assert r.end - r.start >= 50 and r.identity >= 0.75
    assert ps.shared_passages(empty).count() == 0


def test_passages_of_exact_copies(spark):
    t = text(90, random.Random(9))
    got = ps.shared_passages(make(spark, [t, t, t], False)).collect()
    assert sorted((r.doc_id, r.start, r.end, r.source_id, r.identity) for r in got) == [(1, 0, 90, 0, 1.0), (2, 0, 90, 0, 1.0)]


def test_passages_at_low_identity(spark):
    rng = random.Random(21)
    texts, least = [], {95: 1.0, 90: 1.0, 85: 0.95, 80: 0.85, 78: 0.75}
    for identity in least:
        for _ in range(40):
            words = text(60, rng).split()
            other = list(words)
            for i in rng.sample(range(2, 58), round(60 * (100 - identity) / 100)):
                other[i] = f"x{rng.randrange(10**6)}"
            texts += [text(30, rng) + " " + " ".join(x) + " " + text(30, rng) for x in (words, other)]
    got = {(r.source_id, r.doc_id) for r in ps.shared_passages(make(spark, texts, False)).collect()}
    for n, (identity, share) in enumerate(least.items()):
        pairs = {(i, i + 1) for i in range(80 * n, 80 * n + 80, 2)}
        assert len(got & pairs) >= share * 40, (identity, len(got & pairs))


@pytest.mark.parametrize("identity, share", [(95, 1.0), (87, 1.0), (80, 0.8)])
def test_changed_passages_among_many_parts_of_them(spark, identity, share):
    """Texts with 20 to 35 words of a passage stand on both sides of the one that holds it whole; a changed one still finds that."""
    rng, rows, pairs = random.Random(identity), [], []
    some = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    for _ in range(15):
        words = some(60).split()
        changed = list(words)
        for i in rng.sample(range(60), round(60 * (100 - identity) / 100)):
            changed[i] = f"x{rng.randrange(10**6)}"
        parts = []
        for _ in range(40):
            lo = rng.randrange(40)
            parts.append(words[lo : lo + rng.randrange(20, 36)])
        for part in [*parts[:20], words, *parts[20:], changed]:
            rows.append(" ".join([some(15), *part, some(15)]))
        pairs.append((len(rows) - 1, len(rows) - 22))
    got = [(r.doc_id, r.source_id) for r in ps.shared_passages(make(spark, rows, False)).collect()]
    assert len(set(got) & set(pairs)) >= share * len(pairs)


def test_copies_have_one_row_each(spark):
    """Three copies of many texts, some of which pass the bitmap of class representatives by chance."""
    rng = random.Random(2)
    rows = [t for t in (text(rng.randrange(60, 80), rng) for _ in range(200)) for _ in range(3)]
    got = [(r.doc_id, r.source_id) for r in ps.shared_passages(make(spark, rows, False)).collect()]
    assert len([x for x in got if x[0] // 3 == x[1] // 3]) == 400 and len(got) == len(set(got))


def test_passages_of_reused_parts(spark):
    rng = random.Random(31)
    words = text(70, rng).split()
    parts = [words[:40], words[29:], words, words[:45], words[25:], words]
    around = [text(20, rng) + " " + " ".join(p) + " " + text(20, rng) for p in parts]
    near_in = lambda rows: {(r.doc_id, r.source_id) for r in ps.shared_passages(make(spark, rows, False)).collect()}
    assert near_in([*around[:3], around[5]]) == {(3, 2)}  # none of the parts has 50 words
    assert near_in(around) >= {(5, 2)}  # parts stand between both holders as well


def test_passages_of_the_five_texts(spark):
    """Two texts share 90 words; three earlier ones hold parts of them that overlap."""
    rng = random.Random(33)
    words = text(90, rng).split()
    held = [words[:42], words[30:70], words[62:], words, words]
    rows = [text(15, rng) + " " + " ".join(p) + " " + text(15, rng) for p in held]
    got = [(r.doc_id, r.source_id, r.end - r.start) for r in ps.shared_passages(make(spark, rows, False)).collect()]
    assert [(d, s) for d, s, _ in got] == [(4, 3)] and 90 <= got[0][2] <= 92


def test_families_of_a_frequent_seed_do_not_meet_pair_by_pair():
    """Sixty texts around one seed give a match for each further text, and not all 1,770; a text that alignment left out meets each one."""
    rng, n = np.random.default_rng(3), 60
    own = [rng.integers(0, 1 << 16, 230).astype(np.uint16)] * n + [rng.integers(0, 1 << 16, 230).astype(np.uint16) for _ in range(n)]
    ids = np.arange(1, 2 * n + 1)
    label = ps.mix(ids.astype(np.uint64)) ^ np.uint64(ps.BASE)
    zero = np.zeros(2 * n, np.int32)
    cols = (zero.astype(np.int64), zero, zero, zero, ids, zero + 2 * 300, zero, zero, label.view(np.int64), ids, ids == 7)
    batch = pa.record_batch([*map(pa.array, cols), pa.array([x.tobytes() for x in own], pa.binary())], ["seed", "i", "j", "side", "doc_id", "place", "nth", "last", "label", "tag", "again", "own"])
    for link, count in ((True, n - 1), (False, n - 1)):
        got = pa.Table.from_batches(ps._tiles(5, 40, 50, 75, link)(iter([batch])))
        assert got.num_rows == count and all(got["sure"].to_pylist())
        # a text that has the seed only meets none; without linking the text told meets all others
        assert {x for x in got["doc_id"].to_pylist() + got["source_id"].to_pylist()} == set(range(1, n + 1))
        assert link or all(7 in x for x in zip(got["doc_id"].to_pylist(), got["source_id"].to_pylist(), strict=True))


def test_places_behind_others():
    rng = np.random.default_rng(5)
    for _ in range(50):
        place = np.cumsum(rng.integers(0, 6, 80))
        gap = np.concatenate(([True], np.diff(place) > ps.END)) | (rng.random(80) < 0.05)
        far = np.zeros(80, np.int64)
        for j in range(1, 80):
            step = place[j] - place[j - 1]
            if not gap[j] and far[j - 1] + step <= ps.BEHIND:
                far[j] = far[j - 1] + step
        assert (ps.behind(place, gap) == far).all()


def test_holders_between_the_first_and_the_previous_one(spark):
    """Texts with 45 words of a passage are the first and the previous holders of all its seeds, but no sources of a changed one."""
    rng, rows, pairs = random.Random(41), [], []
    some = lambda n: " ".join(f"v{rng.randrange(30000)}" for _ in range(n))
    for _ in range(8):
        words = some(70).split()
        changed = list(words)
        for i in range(0, 70, 5):
            changed[i + rng.randrange(5)] = f"x{rng.randrange(10**6)}"
        parts = [words[lo : lo + 45] for lo in range(26)]
        rows += [" ".join([some(30), *part, some(30)]) for part in [*parts, words, *parts, changed]]
        pairs.append((len(rows) - 1, len(rows) - 2 - len(parts)))
    got = {(r.doc_id, r.source_id) for r in ps.shared_passages(make(spark, rows, False)).collect()}
    assert got >= set(pairs)


def test_jobs_of_frequent_seeds_follow_each_other_and_leave_no_shuffle(spark, monkeypatch):
    """Places and matches in several parts give the rows of one, and no job's shuffle files stay."""
    rng, rows = random.Random(43), []
    some = lambda n: " ".join(f"v{rng.randrange(30000)}" for _ in range(n))
    for _ in range(2):
        words = some(70).split()
        parts = [words[lo : lo + 45] for lo in range(26)]
        rows += [" ".join([some(30), *part, some(30)]) for part in [*parts, words, *parts, near(" ".join(words), 10, rng).split()]]
    df, made, in_parts, halves = make(spark, rows, False), [], ps.in_parts, False

    def counted(rows, most, key, one):
        made.append(0)
        most = rows // 2 + 1 if halves else most

        def counting(at):
            made[-1] += 1
            return one(at)

        return in_parts(rows, most, key, counting)

    shuffles = lambda: sum(f.getName().startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    monkeypatch.setattr(ps, "in_parts", counted)
    before = shuffles()
    whole = sorted(map(tuple, ps.shared_passages(df).collect()))
    for _ in range(20):  # files are removed behind the job's back
        if shuffles() <= before:
            break
        time.sleep(0.5)
    assert shuffles() <= before
    assert whole and set(made) == {1}
    made.clear()
    monkeypatch.setattr(ps, "LEAST_A_JOB", 1)
    halves = True
    assert sorted(map(tuple, ps.shared_passages(df).collect())) == whole
    assert made[0] == made[1] == 2


def test_common_pairs_of_neighbouring_words():
    """Texts with a passage share as many pairs of words as any has to, and the sets count no fewer."""
    rng = np.random.default_rng(5)
    assert ps.least_pairs(50, 75) == 25
    for bits in (12, 14):
        for _ in range(200):
            n = int(rng.integers(50, 100))
            a = rng.integers(0, int(rng.choice([3, 300, 65536])), n).astype(np.uint16)
            b = a.copy()
            b[rng.choice(n, n // 4, replace=False)] += 1
            sets, lack = ps.pair_bits(np.concatenate((a, b)), np.array([0, n]), np.array([n, n]), bits)
            assert np.bitwise_count(sets[0] & sets[1]).sum() + lack.min() >= 25


def test_every_exact_passage_is_found(spark):
    """Against brute force: each document with 50 words in a row that a smaller doc_id holds has a row over them."""
    rng = random.Random(35)
    pool = [text(rng.randrange(50, 90), rng).split() for _ in range(25)]
    rows = []
    for _ in range(160):
        part = rng.choice(pool)
        lo = rng.randrange(0, max(1, len(part) - 50)) if rng.random() < 0.5 else 0
        hi = rng.randrange(lo + 20, len(part) + 1)
        rows.append(" ".join([text(rng.randrange(1, 40), rng), *part[lo:hi], text(rng.randrange(1, 40), rng)]))
    seen, expected = {}, {}
    for i, row in enumerate(rows):
        w = row.lower().split()
        grams = [tuple(w[j : j + 50]) for j in range(len(w) - 49)]
        expected[i] = [j for j, g in enumerate(grams) if g in seen]
        for g in grams:
            seen.setdefault(g, i)
    got = {}
    for r in ps.shared_passages(make(spark, rows, False), batch_words=3000).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end))
        assert r.source_id < r.doc_id
    lost = [(i, j) for i, at in expected.items() for j in at if not any(a <= j and j + 50 <= b for a, b in got.get(i, []))]
    total = sum(map(len, expected.values()))
    assert total > 300 and len(lost) <= 0.01 * total


def test_license_inside_longer_lines(spark):
    from lodestrand.llm.licenses import TEMPLATES

    header = TEMPLATES["Apache-2.0"][1].split()
    wrapped = "\n".join("# " + " ".join(header[i : i + 9]) for i in range(0, len(header), 9))
    texts = [
        "This project is released under the MIT License.",
        "Copyright 2021 Example Corp. Licensed under the Apache License, Version 2.0. See the NOTICE file.",
        wrapped + "\nimport os\n" + text(80),
        text(40) + " Released under the MIT License. " + text(40) + " Licensed under the Apache License, Version 2.0. " + text(9),
        "licensed under the terms of a contract, released under the sun",
    ]
    got = {r.doc_id: r.licenses for r in license_scan(make(spark, texts, False)).collect()}
    assert got == {0: "MIT", 1: "Apache-2.0", 2: "Apache-2.0", 3: "Apache-2.0,MIT", 4: ""}
    for r in license_matches(make(spark, texts, False)).collect():
        for m in r.matches:
            assert m.dice >= 0.8 and len(texts[r.doc_id][m.start : m.end].split()) < 50


def test_license_windows_against_all_windows():
    """Every window of small texts: the best of each start that reaches the threshold, and no match is missed."""
    rng = random.Random(14)
    for _ in range(300):
        size = rng.randrange(2, 14)
        grams = [(rng.choice("abcdefgh"), "x") for _ in range(rng.randrange(1, 40))]
        template = {(c, "x") for c in "abcdefgh"[: rng.randrange(1, 8)]}
        held = np.array([g in template for g in grams])
        got = {i: (round(d, 9), j) for d, i, j in licenses.best_windows(held, *licenses._neighbours(grams), size, 0.8, 0.8 / 1.2)}
        want = {}
        for i in np.flatnonzero(held).tolist():
            end = next((j for j in range(i + 1, len(grams)) if grams[j] == grams[i]), len(grams))
            scored = [(round(2 * len(set(grams[i : j + 1]) & template) / (len(set(grams[i : j + 1])) + size), 9), j) for j in range(i, end) if grams[j] in template and grams[j] not in grams[i:j]]
            # what a window has of the template is no more than the template is large
            scored = [x for x in scored if len(set(grams[i : x[1] + 1])) <= size * 1.5 + 1e-9]
            if scored and max(scored)[0] >= 0.8:
                want[i] = max(scored)
        assert got == want


def test_license_dump_of_many_texts():
    """Of joined licence texts each one is found."""
    folder = files("lodestrand.llm") / "license_texts"
    texts = [(folder / f"{n}.txt").read_bytes() for n in ("GPL-3.0", "GPL-2.0", "MPL-2.0")]
    found = licenses.matches_of(licenses.Matcher(TEMPLATES, 0.8), b"\n\n".join(texts))
    assert {"GPL-3.0", "GPL-2.0", "MPL-2.0"} <= {m["license"] for m in found}


def test_license_full_texts(spark):
    from lodestrand.llm.licenses import TEMPLATES

    names = ["Apache-2.0", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0"]
    texts = [text(30) + "\n" + max(TEMPLATES[n], key=len).replace("\n\n", "\n") + "\n" + text(400) for n in names]
    got = {r.doc_id: r.licenses.split(",") for r in license_scan(make(spark, texts, False)).collect()}
    assert all(n in got[i] for i, n in enumerate(names)) and got[0] == ["Apache-2.0"]


def test_word_hashes_of_short_and_long_texts():
    odd = random.Random(12)
    texts = ["".join(odd.choice(["a", "Bc", "9", "é", ".", "中", " ", "  ", "\n", "\t", "-", "\x1f"]) for _ in range(odd.randrange(40))) for _ in range(300)]
    texts += [" ".join(odd.choice(["one", "Two", "drei,"]) for _ in range(300_000)), "x" * (1 << 20), "", None]
    for alnum, pattern in ((False, r"[^\x20\x09-\x0D]+"), (True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        seen = {}
        got = list(word_hashes([None if t is None else t.encode() for t in texts], alnum))
        assert len(got) == len(texts)
        for t, h in zip(texts, got, strict=True):
            w = re.findall(pattern, lower(t))
            assert len(w) == len(h)
            for x, y in zip(w, h.tolist(), strict=True):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen) > 100
