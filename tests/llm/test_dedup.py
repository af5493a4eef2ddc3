import random

import brute
import numpy as np
import pytest
from conftest import words
from pyspark.sql import functions as F

from stay_analytics.llm import components, hashing, neardup, passages, suffix


def test_window_hashes_match_their_definition():
    x = np.array([3, 1, 4, 1, 5, 9, 2, 6], dtype=np.uint64)
    for width in range(1, 9):
        got = hashing.window_hashes(x, width)
        want = [sum(int(v) * pow(hashing.BASE, width - 1 - k, 1 << 64) for k, v in enumerate(x[i:i + width])) % (1 << 64) for i in range(9 - width)]
        assert got.tolist() == want
        assert hashing.sliding_min(x, width).tolist() == [min(x[i:i + width]) for i in range(9 - width)]
    assert len(hashing.window_hashes(x, 9)) == 0


def test_equal_words_have_equal_hashes():
    texts = [b"ab abcdefghij ab", b"", b" \t", b"AB  abcdefghij", b"abcdefgh abcdefghi abcdefghijklmnopqrstuvw"]
    h, first, end, text = hashing.word_hashes(*hashing.splits_of(texts), lower=True)
    found = [t.lower() for x in texts for t in x.split()]
    assert len(h) == len(found) == len(set(zip(h.tolist(), range(len(h)), strict=True)))
    assert {a: b for a, b in zip(found, h.tolist(), strict=True)} and len(set(h.tolist())) == len(set(found))
    assert all((a == b) == (x == y) for a, x in zip(found, h.tolist(), strict=True) for b, y in zip(found, h.tolist(), strict=True))
    assert text.tolist() == [k for k, x in enumerate(texts) for _ in x.split()]


def test_components_of_a_long_path(spark):
    r = random.Random(2)
    nodes = list(range(300))
    r.shuffle(nodes)
    edges = [(a, b) for a, b in zip(nodes[:199], nodes[1:200], strict=True)] + [(nodes[k], nodes[200]) for k in range(201, 300)] + [(5, 5), nodes[:2]]
    got = {x.node: x.root for x in components.components(spark.createDataFrame([tuple(e) for e in edges], "a bigint, b bigint")).collect()}
    assert got == {n: min(nodes[:200]) for n in nodes[:200]} | {n: min(nodes[200:]) for n in nodes[200:]}
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


@pytest.mark.parametrize("most", [4096, 3])
def test_near_duplicates_match_brute_force(table, corpus, monkeypatch, most):
    """most=3 sends every larger component through its buckets, and large buckets through pairs of blocks."""
    monkeypatch.setattr(neardup, "UNIT_CLASSES", most)
    roots, sizes = brute.groups(corpus)
    want = sorted((brute.rank(d), s, c, brute.rank(d) == c) for (d, _), s, c in zip(corpus, sizes, roots, strict=True))
    got = neardup.near_duplicates(table(corpus)).collect()
    assert sorted((brute.rank(r.doc_id), r.n_shingles, brute.rank(r.component_id), r.kept) for r in got) == want
    assert len({c for *_, c, _ in want}) < len(corpus) - 20


def test_links_hold_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    at, below = np.concatenate((a[:85], [])).astype(np.uint64), a[:84]
    assert neardup.linked_pairs([a, at]) == [(0, 1)] and neardup.linked_pairs([a, below]) == []
    assert sorted(neardup.linked_pairs([a, at, a + np.uint64(1), at + np.uint64(500)])) == [(0, 1), (0, 2)]


def test_band_keys_find_pairs_at_the_threshold():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 1 << 63, 200, dtype=np.uint64)) for _ in range(200)]
    edited = [np.unique(np.concatenate((s[:184], r.integers(0, 1 << 63, 16, dtype=np.uint64)))) for s in sets]
    a, b = neardup.band_keys(sets), neardup.band_keys(edited)
    assert all((x == y).any() for x, y in zip(a, b, strict=True))
    assert not any((x == y).any() for x, y in zip(a, b[1:], strict=False))


def test_passages_match_brute_force(table, corpus):
    got = passages.remove_repeated_passages(table(corpus)).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256)).collect()
    want = brute.without_passages(corpus)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 1000


def test_passage_intervals_are_maximal():
    assert passages.covered(np.array([0, 1, 50, 101, 300]), 50) == [(0, 100), (101, 151), (300, 350)]
    assert passages.covered(np.array([], dtype=np.int64), 50) == []


def test_long_texts_are_read_in_parts(monkeypatch):
    text = " ".join(words(900, 4, 50)).encode()
    whole = [(r, n, h.tolist(), a.tolist()) for r, n, _, a, h in passages.text_windows([text], 7)]
    monkeypatch.setattr(passages, "PART_BYTES", 500)
    parts = list(passages.text_windows([b"x y", text], 7))
    assert len(parts) > 5 and {r for r, *_ in parts} == {1}
    seen = {}
    for _, n, _, a, h in parts:
        for k, (x, y) in enumerate(zip(h.tolist(), a.tolist(), strict=True)):
            assert seen.setdefault(n + k, (x, y)) == (x, y)
    assert [seen[k] for k in range(len(seen))] == list(zip(whole[0][2], whole[0][3], strict=True))
    data = bytes(random.Random(1).choice(b"ab") for _ in range(3000))
    one = [(f, h.tolist()) for _, f, _, _, h in suffix.byte_windows([data], 40, True)]
    monkeypatch.setattr(suffix, "PART_BYTES", 700)
    many = [(f, h.tolist()) for _, f, _, _, h in suffix.byte_windows([data], 40, True)]
    assert [x for _, h in many for x in h] == one[0][1] and [f for f, _ in many] == [0, 700, 1400, 2100, 2800]


def digests(df):
    return df.select("row.doc_id", "n_bytes", F.col("n_bytes") - F.length("kept"), F.size("spans"), F.sha2("kept", 256))


@pytest.mark.parametrize("most", [4096, 1])
def test_repeated_bytes_match_brute_force(table, corpus, monkeypatch, most):
    """most=1 sends every anchor with several segments through the window counts."""
    monkeypatch.setattr(suffix, "SEGMENTS_PER_ANCHOR", most)
    left = suffix.remove_repeated_bytes(table(corpus)).cache()
    want = brute.without_repeats(corpus)
    assert sorted(map(tuple, digests(left).collect()), key=str) == sorted(want, key=str) and sum(x[2] for x in want) > 10000
    texts = {d: t for d, t in corpus}
    for r in left.select("row", "kept", "kept_text").collect():
        assert r.row.n_chars == (None if texts[r.row.doc_id] is None else len(texts[r.row.doc_id])) and r.row.row == "x"
        assert len(r.kept_text.encode()) >= len(r.kept) and (not (texts[r.row.doc_id] or "").isascii() or r.kept_text.encode() == bytes(r.kept))


def test_two_stage_sorting_matches_plain_sorting():
    r = random.Random(3)
    for trial in range(120):
        letters = [97, 98, 99] if trial % 2 else [0, 255, 7]
        segments = [bytes(r.choice(letters) for _ in range(r.randint(1, 30))) for _ in range(r.randint(1, 5))]
        symbols = np.array([x for s in segments for x in [*[b + 1 for b in s], 0]])
        order = suffix.suffix_array(symbols, 1000)
        assert order.tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:].tolist())  # noqa: B023
        capped = suffix.suffix_array(symbols, 6)
        keys = [symbols[i:i + 6].tolist() for i in capped]
        assert keys == sorted(keys) and sorted(capped.tolist()) == list(range(len(symbols)))
        lcp = suffix.common_prefixes(symbols, order, 4)
        for k in range(1, len(order)):
            a, b = (symbols[i:].tolist() for i in (order[k - 1], order[k]))
            same = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert same >= min(len(a), len(b)) or lcp[k] == min(same, 4)
        seen, want, width = set(), [], r.randint(1, 6)
        for s in segments:
            want.append([])
            for i in range(len(s) - width + 1):
                if s[i:i + width] in seen:
                    want[-1].append(i)
                seen.add(s[i:i + width])
        assert [x.tolist() for x in suffix.later_starts(segments, width)] == want


@pytest.mark.parametrize("run", [neardup.near_duplicates, passages.remove_repeated_passages, suffix.remove_repeated_bytes])
def test_empty_tables_give_empty_results(table, run):
    assert run(table([])).count() == 0
    assert run(table([(1, None), (None, None)])).count() == 2
