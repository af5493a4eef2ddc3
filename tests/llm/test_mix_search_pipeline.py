import random

import brute
import duckdb
import numpy as np
import pytest
from test_text_ops import check_packing

import corpus_pipeline
from stay_analytics.llm import mixing, topk

SMALL = "/root/testdata/sf0.001"


# --- mixing ----------------------------------------------------------------------------------------------------------

def mix_rows(table, rows):
    return sorted(map(tuple, mixing.mix_copies(table([(d, t, None, s) for d, t, s in rows])).select("doc_id", "size", "source_size", "target", "taken").collect()), key=str)


def oracle_rows(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    return sorted(con.sql(mixing.ORACLE).fetchall(), key=str)


def test_mix_equals_its_sql(table):
    r = random.Random(6)
    rows = [(k, " ".join(["w"] * r.choice([0, 1, 5, 5, 40, 300])), r.choice(["a"] * 8 + ["b", "B", "\xe9", "\U0001f600", "￮", "", None])) for k in range(400)]
    rows += [(400, None, "a"), (401, None, None), (402, "x", "tiny"), (403, None, "empty"), (404, " \t\n", "blank"), (402, "x", "tiny"), (None, "y z", "b")]
    got = mix_rows(table, rows)
    assert got == oracle_rows(rows) and got == mix_rows(table, list(reversed(rows)))
    assert all(taken <= 3 * size for _, size, _, _, taken in got)


def test_targets_share_all_words_up_to_the_limit(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, "d": 0, "e": 300, None: 7}
    got = {r.source: r for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()}
    weights = dict(zip(["a", "b", "c", "d", "e", None], [1, 2, 3, 1, 2, 3], strict=True))
    target, stopped = {}, set()
    while True:  # share, stop what is above, share again
        left = sum(sizes.values()) - sum(3 * sizes[s] for s in stopped)
        w = sum(weights[s] for s in sizes if s not in stopped)
        target = {s: 3.0 * sizes[s] if s in stopped else left * weights[s] / w for s in sizes}
        above = {s for s in sizes if s not in stopped and target[s] > 3 * sizes[s]}
        if not above:
            break
        stopped |= above
    assert {s: r.weight for s, r in got.items()} == weights
    assert all(abs(got[s].target - target[s]) < 1e-6 for s in sizes)


def test_taken_words_come_near_the_target(table):
    r = random.Random(8)
    rows = [(k, " ".join(["w"] * r.randint(1, 60)), r.choice("aaaaabcd")) for k in range(2000)]
    got = mix_rows(table, rows)
    for size, target in {(x[2], x[3]) for x in got}:
        assert abs(sum(x[4] for x in got if x[2] == size) - target) <= 60


def test_mixed_documents_repeat_rows(table):
    rows = [(k, " ".join(["w"] * (k % 5)), None, "ab"[k % 7 == 0]) for k in range(60)]
    docs = table(rows)
    copies = {r.doc_id: r.copies for r in mixing.mix_copies(docs).collect()}
    got = mixing.mixed_documents(docs)
    assert got.columns == docs.columns
    seen = {}
    for r in got.collect():
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen == {d: c for d, c in copies.items() if c}
    assert mixing.mix_copies(table([])).count() == mixing.mixed_documents(table([])).count() == 0


# --- search ----------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("block", [8192, 7])
def test_search_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", max(block // 4, 1))
    r = random.Random(3)
    rows = [(k, [r.choice([-1.0, -0.3, 0.0, 0.1, 0.5]) for _ in range(4)]) for k in range(180)]  # few values, so many ties
    rows += [(200, [0.0] * 4), (250, [1.0, 2.0]), (251, [3.0, -1.0]), (300, None), (301, [1.0, None, 0.0, 0.0]), (302, [float("nan")] * 4),
             (350, [float("inf"), 0.0, 0.0, 0.0]), (400, []), (None, [1.0] * 4), (450, [9.0] * 3)]
    got = topk.top_k(spark.createDataFrame([(*x, "extra") for x in rows], "vec_id bigint, embedding array<float>, id string")).collect()
    good = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    assert sorted(map(tuple, got)) == brute.best(good)


def test_search_with_large_components_and_empty_tables(spark):
    rows = [(0, [2.0 ** 22, 1.0]), (1, [2.0 ** 21 + 1, 5.0]), (2, [2.0 ** 21 + 1, 4.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert [(r.vec_id, r.score) for r in sorted(got)] == [(1, 2 ** 30 * (2 ** 29 + 256) + 256 * 1280), (2, 2 ** 30 * (2 ** 29 + 256) + 256 * 1024)]
    assert topk.top_k(spark.createDataFrame([], "vec_id bigint, embedding array<double>")).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], "vec_id bigint, embedding array<double>")).count() == 0


def test_walk_stops_early_when_the_bound_allows():
    r = np.random.default_rng(5)
    x = np.floor(r.normal(0, 1, (5000, 3)) * 50)
    x[7] = [5000, 5000, 5000]
    lists = topk.Lists(np.arange(5000), x)
    for q in (np.array([1.0, 2.0, 3.0]), np.array([-1.0, 0.0, 2.0]), np.zeros(3)):
        scores = x @ q
        want = sorted((-s, k) for k, s in enumerate(scores) if k != 9)[:5]
        assert [(-s, i) for i, s in lists.search(q, 9)] == want


# --- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages_against_brute_force(spark, table, corpus):
    plain = spark.read.parquet(f"{SMALL}/documents.parquet").limit(80).collect()
    extra = [(1000 + i, t, "en", "corpus") for i, (d, t) in enumerate(corpus) if d != 99]
    docs = table([(r.doc_id, r.text, r.lang, r.source) for r in plain] + extra)
    (_, first), (_, second), (_, third), (_, fourth), (_, last) = corpus_pipeline.STAGES
    one = first(spark, docs, SMALL).cache()
    rejected = {r.doc_id for r in docs.collect()} - {r.doc_id for r in one.collect()}
    without = {r.doc_id for r in docs.collect() if r.text is None or not any(c.isalpha() for c in r.text)}
    assert without <= rejected and len(rejected - without) <= 2
    two = second(spark, one, SMALL).cache()
    rows = [(r.doc_id, r.text) for r in one.collect()]
    assert {r.doc_id for r in two.collect()} == set(brute.groups(rows)[0])
    three = third(spark, two, SMALL).cache()
    want = {d: (n, gone) for d, n, gone, *_ in brute.without_repeats([(r.doc_id, r.text) for r in two.collect()])}
    assert three.count() == two.count()
    for r in three.collect():
        assert r.n_chars == len(r.text) and 0 <= len(r.text.encode()) - (want[r.doc_id][0] - want[r.doc_id][1]) <= 12
    four = fourth(spark, three, SMALL).cache()
    assert one.columns == two.columns == three.columns == four.columns == docs.columns
    taken = sum(len((r.text or "").split()) for r in four.collect())
    assert 0.5 < taken / sum(len((r.text or "").split()) for r in three.collect()) < 1.5
    check_packing(last(spark, four, SMALL).collect(), [(r.doc_id, r.text) for r in four.collect()])


def test_pipeline_of_an_empty_table_and_of_nulls(spark, table):
    for rows in ([], [(1, None, None, None), (None, "", "en", "a")]):
        docs = table(rows)
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SMALL)
        assert docs.count() == 0


def test_run_applies_all_stages(spark):
    assert corpus_pipeline.run(spark, SMALL).agg({"length": "sum"}).first()[0] > 10000
