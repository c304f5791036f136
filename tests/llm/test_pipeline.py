"""The pipeline's stages against brute force, with null and repeated ids, empty texts and clashing columns."""

import collections
import random
import re

import pytest

import corpus_pipeline as cp
from lodestrand.llm.mixing import mix
from lodestrand.llm.quality import quality_rules
from lodestrand.llm.token_shards import END, UNIT

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, node long, comp long, kept boolean, n_hit long, row long"
RNG = random.Random(17)
VOCAB = [f"word{i}" for i in range(300)] + ["the", "and", "of", "to", "in", "is"] * 25


def text(n):
    return " ".join(RNG.choice(VOCAB) for _ in range(n))


ITEM = text(14)
BASE = text(90)
ROWS = [
    (1, BASE), (2, BASE), (3, BASE + " more"), (4, text(60)), (5, "too short"), (6, None), (7, ""), (8, text(40) + " " + ITEM + " " + text(9)),
    (9, text(50)), (9, BASE), (9, text(55) + " " + ITEM), (10, text(45)), (10, text(45) + " x"), (None, text(70)), (None, BASE + " else"), (None, None), (11, text(4000)),
    (12, "same line here\n" * 40), (13, text(65)), (13, None),
]
ROWS += [ROWS[3], ROWS[3]]


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (t or "").lower())


def near_classes(rows):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := words(t)) else set() for _, t in rows]
    left, out = set(range(len(rows))), []
    while left:
        group, todo = set(), [left.pop()]
        while todo:
            i = todo.pop()
            group.add(i)
            near = [j for j in left if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
            left -= set(near)
            todo += near
        out.append(sorted(group))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, 1, 1, True, 5, 1) for i, t in rows], COLUMNS)


def pairs(df):
    return collections.Counter((r.doc_id, r.text) for r in df.collect())


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    frame(spark, ROWS).write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def test_quality_keeps_what_the_rules_keep(spark, docs, sf_dir):
    got = cp.quality(spark, docs, sf_dir)
    assert got.columns == docs.columns
    verdict = {t: quality_rules(frame(spark, [(1, t)])).first().kept for t in {t for _, t in ROWS}}
    assert pairs(got) == collections.Counter((i, t) for i, t in ROWS if verdict[t])
    assert any(i is None for i, _ in pairs(got))


def test_near_dedup_keeps_one_row_of_each_class(spark, docs, sf_dir):
    got = cp.near_dedup(spark, docs, sf_dir)
    assert got.columns == docs.columns
    kept = pairs(got)
    for group in near_classes(ROWS):
        rows = [ROWS[i] for i in group]
        assert sum(n for r, n in kept.items() if r in rows) == (1 if words(rows[0][1]) else sum(kept[r] for r in set(rows)))
    assert kept[(1, BASE)] == 1 and kept[ROWS[8]] == 1 and kept[(9, BASE)] == 0 and kept[(6, None)] == 1 and kept[(13, None)] == 1
    assert sum(kept.values()) == sum(1 for g in near_classes(ROWS))


def test_decontamination_removes_rows_and_not_ids(spark, docs, sf_dir):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    item = words(ITEM, pattern)
    windows = {tuple(item[i : i + 10]) for i in range(len(item) - 9)}
    clean = [r for r in ROWS if not windows & {tuple(w[i : i + 10]) for w in [words(r[1], pattern)] for i in range(len(w))}]
    got = cp.decontamination(spark, docs, sf_dir)
    assert got.columns == docs.columns and pairs(got) == collections.Counter(clean) and len(clean) == len(ROWS) - 2


def test_mixing_and_shards(spark, docs, sf_dir):
    got = cp.mixing(spark, docs, sf_dir)
    assert got.columns == docs.columns
    taken = collections.Counter(r.doc_id for r in mix(docs).collect())
    assert collections.Counter(r.doc_id for r in got.collect()) == taken
    sequences = cp.shards(spark, docs, sf_dir).collect()
    assert sorted(r.slot for r in sequences) == list(range(len(sequences))) and UNIT and END


def test_stages_of_an_empty_table(spark, sf_dir):
    empty = frame(spark, [])
    for _, stage in cp.STAGES:
        assert stage(spark, empty, sf_dir).isEmpty()


def test_run_is_its_stages(spark, docs, sf_dir):
    got = cp.run(spark, sf_dir).collect()
    for _, stage in cp.STAGES:
        docs = cp.cut(stage(spark, docs, sf_dir), "stage")
    assert [len(got), sum(r.n_tokens for r in got)] == [docs.count(), sum(r.n_tokens for r in docs.collect())] and got
