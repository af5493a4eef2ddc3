"""Fill-in-middle: boundary sets against plain lists, cuts and round trips against a regular expression."""

import hashlib
import random
import re

import pytest

from stay_analytics.llm import boundaries, fim


@pytest.mark.parametrize("members", [
    [0], [0, 65535], list(range(70000)), list(range(0, 200000, 2)), [k for k in range(300000) if k % 7 < 3],
    sorted(random.Random(1).sample(range(1 << 20), 3000)), [5, 65536 * 3, 65536 * 3 + 1, 65536 * 900]])
def test_select_gives_every_member(members):
    s = boundaries.boundary_set(members)
    assert len(s) == len(members)
    picks = range(len(members)) if len(members) < 5000 else random.Random(2).sample(range(len(members)), 3000)
    assert all(s.select(k) == members[k] for k in picks)


def test_all_three_container_forms_are_used():
    forms = [boundaries.boundary_set(m).containers[0][0] for m in ([1, 9], range(60000), range(0, 60000, 2))]
    assert forms == [boundaries.ARRAY, boundaries.RUNS, boundaries.BITMAP]


def test_unit_boundaries_of_long_texts():
    r = random.Random(3)
    for n in (0, 1, 65535, 65536, 65537, 150001):
        text = "".join(r.choice("abZ \n\xe9\U0001f600@[`{") for _ in range(n))
        text = text[:n // 2] + "a" * (n - n // 2) if n == 150001 else text
        ends = [0] + [m.end() for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)]
        s = boundaries.unit_boundaries(text)
        assert len(s) == len(ends) and all(s.select(k) == ends[k] for k in r.sample(range(len(ends)), min(len(ends), 500)))


def expected(doc_id, text):
    text = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k:8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, len(units), "plain", None, None, text, text)
    out = f"<S>{suffix}<P>{prefix}<M>{middle}" if h4 % 100 < 20 else f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, len(units), "spm" if h4 % 100 < 20 else "psm", len(prefix), len(middle), out, text)


def test_documents_match_the_regular_expression_and_come_back_whole(table, corpus):
    rows = [*corpus, (200, "<P> in a text"), (201, "<" * 40 + "P" * 9 + ">" * 40), (202, "S><M"), (203, "\U0001f600" * 70000 + "ab " * 9000), (204, "<S" * 50)]
    docs = table(rows).withColumnRenamed("h", "fim").withColumnRenamed("n", "cuts")
    cut = fim.fill_in_middle(docs)
    assert cut.columns == [*docs.columns, "fim_"]
    got = cut.select("doc_id", "fim_.*", fim.restored(cut.fim_.output, cut.fim_.form).alias("back")).collect()
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got), key=key) == sorted((expected(*r) for r in rows), key=key)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty_table(table):
    assert fim.fill_in_middle(table([])).collect() == []
