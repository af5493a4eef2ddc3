"""What keeps near-duplicate and repeat searches small: few tasks a round, small arrays, memory given back."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
from conftest import words

from stay_analytics.llm import common, components, neardup, suffix


def test_rounds_of_few_edges_take_one_task(spark, monkeypatch):
    parts, write = [], components.written_once
    monkeypatch.setattr(components, "written_once", lambda df: parts.append(df.rdd.getNumPartitions()) or write(df))
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)], "a bigint, b bigint")
    assert {(r.node, r.root) for r in components.components(edges).collect()} == {(k, 0) for k in range(41)}
    assert len(parts) > 2 and set(parts[1:]) == {1}


def test_links_of_whole_components_are_final(table, monkeypatch):
    """Only links of parted components go through Spark's rounds; keys of equal ids join their groups as before."""
    counts, join = [], neardup.components
    monkeypatch.setattr(neardup, "components", lambda edges: counts.append(edges.distinct().count()) or join(edges))
    base = [words(60, k, 10 ** 6) for k in range(3)]
    rows = [(10 * k + j, " ".join([*w[:59 - j], f"end{j}"])) for k, w in enumerate(base) for j in range(3)] + [(12, " ".join(base[0])), (99, "alone")]
    got = {(r.doc_id, r.component_id) for r in neardup.near_duplicates(table(rows)).collect()}
    assert counts[0] > 0 and counts[1] == 0
    whole = {(10 * k + j, 20 if k == 2 else 0) for k in range(3) for j in range(3)} | {(99, 99)}  # 12 joins two groups
    assert got == whole
    monkeypatch.setattr(neardup, "UNIT_CLASSES", 2)
    assert {(r.doc_id, r.component_id) for r in neardup.near_duplicates(table(rows)).collect()} == whole and counts[3] > 0


def test_groups_of_links():
    assert sorted(neardup.least_of([(5, 3), (9, 5), (8, 7), (4, 4), (9, 11)])) == [(5, 3), (8, 7), (9, 3), (11, 3)]
    assert neardup.least_of([]) == []


def test_windows_of_many_texts_take_small_arrays():
    r = random.Random(4)
    texts = [bytes(r.choices(range(97, 123), k=2000)) for _ in range(1000)]
    tracemalloc.start()
    n = sum(len(h) for *_, h in suffix.byte_windows(texts, 100, True))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1000 * 1901 and peak < 12 << 20


def test_workers_give_back_what_they_freed(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "give_back", lambda: calls.append(1))
    batch = pa.RecordBatch.from_arrays([pa.array(["a", None])], names=["text"])
    assert [t for _, t in common.text_bytes([batch, batch])] == [[b"a", None]] * 2 and len(calls) == 2
    monkeypatch.undo()
    common.give_back()


def test_suffixes_sorted_by_ranks_of_runs():
    r = random.Random(5)
    for trial in range(60):
        stock = [bytes(r.choice(b"ab") for _ in range(70)) for _ in range(3)]
        segments = [b"".join(r.choice(stock)[r.randint(0, 20):r.randint(30, 70)] for _ in range(r.randint(1, 4))) for _ in range(6)]
        width = r.choice([7, 10, 14, 27, 28, 40, 100])
        seen, want = set(), []
        for s in segments:
            want.append([])
            for i in range(len(s) - width + 1):
                if s[i:i + width] in seen:
                    want[-1].append(i)
                seen.add(s[i:i + width])
        assert [x.tolist() for x in suffix.later_starts(segments, width)] == want
        symbols = np.array([x for s in segments for x in [*[b + 1 for b in s], 0]])
        order = suffix.suffix_array(symbols, 1000)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())  # noqa: B023
        runs, run = suffix.run_ranks(suffix.packed(symbols), 20)
        places = np.flatnonzero(suffix.smaller_than_next(symbols))
        # Ranks too large for one sort of plain numbers are sorted by place.
        large = suffix.sort_directly(places, runs << np.uint64(46), run, 300)
        assert run == 14 and suffix.sort_directly(places, runs, run, 300).tolist() == large.tolist()
