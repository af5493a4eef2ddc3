import random

import pytest

#: Columns whose names operators use inside, so that a clash would show.
CLASHES = "key bigint, h bigint, t string, n bigint, part int, row string, text_ string, unit bigint, copies bigint, size string, at int"
SCHEMA = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHES}"


@pytest.fixture(scope="session")
def table(spark):
    """(id, text[, lang[, source]]) rows as a documents table with further columns."""
    def make(rows, parts=3):
        full = []
        for r in rows:
            doc_id, text, lang, source = (*r, None, None, None)[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), 7, 7, "x", 7, 7, "x", "x", 7, 7, "x", None))
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return make


def words(n, seed, vocabulary=4000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """Rows (id, text) with copies, near copies, shared passages, repeats inside a text, ties, nulls, and texts of all lengths."""
    r = random.Random(5)
    base = [words(r.randrange(60, 300), k) for k in range(25)]
    passage = words(70, 991)
    rows = [(k, " ".join(w)) for k, w in enumerate(base)]
    for k in range(25, 70):  # edits of some base texts, from none to many
        w = list(base[k % 7])
        for _ in range(r.randrange(0, 12)):
            w[r.randrange(len(w))] = f"e{r.randrange(999)}"
        rows.append((k, " ".join(w)))
    for k in range(70, 90):  # a passage with many surroundings
        rows.append((k, "\n".join([" ".join(words(r.randrange(1, 40), 100 + k)), " ".join(passage), " ".join(words(r.randrange(1, 40), 300 + k))])))
    rows += [(90, None), (91, ""), (92, " \t\n\x0b\x0c\r "), (93, "one"), (94, "ONE"), (95, "one two"), (96, "a" * 250), (97, "\xe9" * 130 + "\xfc" * 130),
             (98, " ".join(["again"] * 120)), (99, " ".join(words(20000, 77))), (100, rows[30][1]), (100, rows[30][1]), (None, rows[3][1]),
             (102, "x\x85y\xa0z 　 \U0001f600"), (103, rows[5][1].upper()), (-4, rows[8][1] + " " + rows[9][1])]
    r.shuffle(rows)
    return rows
