"""Line dedup: cuckoo filters against counters, documents against a single-process version, insertions and deletions."""

import random
import re
from collections import Counter

import brute
import numpy as np
import pytest

from stay_analytics.llm import linededup
from stay_analytics.llm.cuckoo import CuckooFilter, FilterChain

FOLD = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("n", [1, 40, 5000, 60000])
def test_filter_misses_nothing_and_deletes(n):
    rng = np.random.default_rng(n)
    members = rng.integers(-(1 << 63), 1 << 63, n, dtype=np.int64)
    f = CuckooFilter(2 * n)
    f.add(members)
    f.add(members[::3])
    f = CuckooFilter.from_bytes(f.to_bytes())
    want = np.ones(n) + (np.arange(n) % 3 == 0)
    assert (f.copies(members) >= want).all() and (f.copies(members) == want).mean() > 0.99
    others = rng.integers(-(1 << 63), 1 << 63, 20000, dtype=np.int64)
    assert (f.copies(others) > 0).mean() < 0.005
    assert not f.remove(members[::3]).any() and (f.copies(members) >= 1).all()
    assert not f.remove(members).any() and f.held == 0 and not f.slots.any() and not len(f.overflow)


def test_full_filters_use_their_overflow_and_chains_grow():
    members = np.arange(1, 400, dtype=np.int64)
    small = CuckooFilter(1)
    small.add(members)
    assert len(small.overflow) and (small.copies(members) >= 1).all()
    assert not small.remove(members).any() and not small.slots.any() and not len(small.overflow)
    chain = FilterChain()
    for k in range(0, 5000, 500):
        chain.add(np.arange(k, k + 500, dtype=np.int64))
    assert len(chain.filters) > 1 and (chain.copies(np.arange(5000)) >= 1).all()
    chain.remove(np.arange(0, 5000, 2, dtype=np.int64))
    assert (chain.copies(np.arange(1, 5000, 2)) >= 1).all() and (chain.copies(np.arange(0, 5000, 2)) == 0).mean() > 0.95


def key_of(line):
    return re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+\Z", "", line).translate(FOLD)


def expected(rows):
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= 10:
                holders.setdefault(key_of(line), set()).add(brute.rank(d))
    least = {k: min(v) for k, v in holders.items() if len(v) > 1}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if least.get(key_of(x), 1 << 62) >= brute.rank(d)]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return Counter(out)


def line_rows():
    r = random.Random(4)
    pool = [f"Line number {k} of the pool" for k in range(60)] + ["short", "nine char", "ten  chars", "\xe9" * 9, "\xe9" * 10, "\U0001f600" * 9, "\U0001f600" * 11, ""]
    rows = []
    for k in range(120):
        lines = [r.choice([str.upper, str.lower, str])(r.choice(["", " ", "\t", "\xa0"]) + r.choice(pool) + r.choice(["", " \r", "\x0b"])) if r.random() < 0.6
                 else f"own line {r.randrange(10 ** 9)}" for _ in range(r.randrange(0, 12))]
        rows.append((k, "\n".join([*lines, "the line that every document holds"] if k % 2 else lines)))
    return rows + [(500, "one two three four\n" * 30000), (501, "one two three four\nx"), (7, rows[3][1]), (8, rows[8][1]), (None, rows[5][1]), (None, None), (-3, rows[9][1])]


def result(docs, index):
    return Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in linededup.drop_repeated_lines(docs, index).select("row.*", "n_lines", "n_dropped", "kept_text")
                   .select("doc_id", "n_lines", "n_dropped", "kept_text").collect())


def test_documents_match_plain_version(table, corpus):
    rows = [*corpus, *[(None if d is None else d + 1000, t) for d, t in line_rows()]]
    docs = table(rows).withColumnRenamed("size", "lost").withColumnRenamed("at", "shard")
    assert result(docs, linededup.insert(linededup.empty_index(docs), docs)) == expected(rows)


def test_insertions_and_deletions_equal_a_fresh_index(table, spark):
    rows = line_rows()
    first, second = [x for x in rows if (x[0] or 0) % 3], [x for x in rows if not (x[0] or 0) % 3]
    index = linededup.insert(linededup.empty_index(table(first), shards=5), table(first))
    index = linededup.insert(index, table(second))
    assert result(table(rows), index) == expected(rows)
    gone = {1, 2, 9, 10, 11, 500, 9999}
    index = linededup.delete(index, spark.createDataFrame([(k,) for k in gone], "doc_id bigint"))
    rest = [x for x in rows if x[0] not in gone]
    assert result(table(rest), index) == expected(rest)
    fresh = linededup.insert(linededup.empty_index(table(rest), shards=5), table(rest))
    assert Counter(map(tuple, index.counts.collect())) == Counter(map(tuple, fresh.counts.collect()))
    steps = index.counts.select("h1", "h2", linededup.held().alias("want"))
    assert linededup.probe(steps, index.filters, 5).where("seen < want").count() == 0
    again = linededup.insert(index, table([x for x in rows if x[0] in gone]))
    assert result(table(rows), again) == expected(rows)


def test_empty_table(table):
    docs = table([])
    assert linededup.drop_repeated_lines(docs, linededup.insert(linededup.empty_index(docs), docs)).collect() == []
