"""Merkle manifest: logs and positions against a plain tree, documents against a single-process version."""

import hashlib
import random
import zlib

import pytest

from stay_analytics.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_of(leaves, fan=16):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k:k + fan]) for k in range(0, len(out[-1]), fan)])
    return out


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 255, 256, 257, 272, 273, 4096, 4097, 5000])
def test_log_positions_and_siblings(n):
    leaves = [h(str(k)) for k in range(n)]
    levels = levels_of(leaves)
    height = merkle.height_of(n)
    assert height == len(levels) - 1
    log = merkle.write_log(leaves, height)
    places = {merkle.position(level, k, n, height): x for level, row in enumerate(levels) for k, x in enumerate(row)}
    assert [places[k] for k in range(len(places))] == log and log[-1] == levels[-1][0]
    for k in random.Random(n).sample(range(n), min(n, 40)):
        assert merkle.fold(leaves[k], merkle.siblings(log, k, n, height)) == log[-1]


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def expected(rows):
    """Rows (doc_id, source, lang, n_chars, text)."""
    order = lambda x: (x is not None, x)
    leaf = {i: h(*[field(x) for x in r]) for i, r in enumerate(rows)}
    paths, subroots = {}, {}
    for source in {r[1] for r in rows}:
        own = sorted((i for i, r in enumerate(rows) if r[1] == source), key=lambda i: (order(rows[i][0]), leaf[i]))
        levels = levels_of([leaf[i] for i in own])
        subroots[source] = levels[-1][0]
        for k, i in enumerate(own):
            paths[i] = path_of(levels, k)
    named = sorted(subroots, key=lambda s: (s is not None, (s or "").encode()))
    levels = levels_of([subroots[s] for s in named])
    out = []
    for i, r in enumerate(rows):
        path = paths[i] + path_of(levels, named.index(r[1]))
        x = leaf[i]
        if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
            x = h(*[field(v) for v in (*r[:4], r[4].translate({c: c + 32 for c in range(65, 91)}))])
        for before, after in path:
            x = h(*before, x, *after)
        out.append((r[0], leaf[i], subroots[r[1]], levels[-1][0], h(*[y for b, a in path for y in b + a]), x, x == levels[-1][0]))
    return out


def path_of(levels, k):
    out = []
    for row in levels[:-1]:
        first = k // 16 * 16
        out.append((row[first:k], row[k + 1:first + 16]))
        k //= 16
    return out


def rows_of(corpus, more=True):
    r = random.Random(9)
    rows = [(d, r.choice(["web", "web", "books", None, "\xe9", ""]), r.choice(["en", None]), None if t is None else len(t), t) for d, t in corpus]
    rows += [(5000 + k, "hot", "en", k, f"Text {k}") for k in range(700)] + [(9000, f"s{k}", None, 1, "X") for k in range(40)]
    return rows + rows[:3] if more else rows


def sort_key(row):
    return tuple((x is not None, x) for x in row)


SCHEMA = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree bigint, at string, block int, hash string, size int, path int, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3, 4, "z") for r in rows], SCHEMA).repartition(5)


def test_manifest_matches_plain_version(spark, corpus):
    rows = rows_of(corpus)
    got = list(map(tuple, merkle.verified_manifest(frame(spark, rows)).collect()))
    # Equal rows are leaves of their own; which of them has which place is open.
    assert sorted(got, key=sort_key) == sorted(expected(rows), key=sort_key)
    assert {g[6] for g in got} == {True, False}


def test_a_source_of_three_rounds(spark):
    n = merkle.BLOCK ** 2 + 300
    docs = spark.range(n + 40).selectExpr("id as doc_id", f"if(id < {n}, 'large', concat('s', id % 3)) as source", "'en' as lang", "id % 9 as n_chars",
                                          "concat('Text ', id) as text")
    rows = [(k, "large" if k < n else f"s{k % 3}", "en", k % 9, f"Text {k}") for k in range(n + 40)]
    assert sorted(map(tuple, merkle.verified_manifest(docs).collect())) == sorted(expected(rows))


def test_append_log_is_each_trees_log(spark):
    rows = [(k, "big" if k < 600 else f"s{k % 5}", "en", 1, f"T{k}") for k in range(650)]
    nodes, _ = merkle.manifest_nodes(frame(spark, rows))
    rounds, _ = merkle.rounds_of(nodes.select("tree", "at", "size", "hash"))
    assert len(rounds) == 2
    log = merkle.append_log(rounds).orderBy("tree", "position").collect()
    leaves = {}
    for r in nodes.orderBy("tree", "at").collect():
        leaves.setdefault(r.tree, []).append(r.hash)
    for tree, own in leaves.items():
        got = [(r.position, r.hash) for r in log if r.tree == tree]
        assert got == list(enumerate(merkle.write_log(own, merkle.height_of(len(own)))))


def test_empty_table(spark):
    assert merkle.verified_manifest(frame(spark, [])).collect() == []
