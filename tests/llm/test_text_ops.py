import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.models import Unigram as LibraryUnigram

from stay_analytics.llm import extract, fingerprint, langid, packing, tokencount

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# --- extraction ------------------------------------------------------------------------------------------------------

def page(body, head=""):
    return f"<!DOCTYPE html><html><head><title>Title words</title>{head}</head><body>{body}</body></html>"


ARTICLE = "<article><h1>The head</h1><p><b>First <i>pa</i>ra.<br><p>Second &amp; third&nbsp;para &lt;x&gt;</p></article>"
TEXT = "The head First para. Second & third para <x>"
PAGES = [
    (page("<nav><ul><li><a href='/a'>menu one</a></li></ul></nav>" + ARTICLE + "<footer>&copy; foot</footer>"), TEXT),
    (page("<header>site name</header><!-- <p>not this</p> --><div class='ad'>buy it now</div>" + ARTICLE), TEXT),
    (page(ARTICLE, "<script>var t='</p><article>no';</script><style>p{margin:0}</style>") + "<script>tail()", TEXT),
    (page("<div id=cookie-notice>We use cookies</div>" + ARTICLE.replace("</article>", "<aside>by the way</aside><form><p>mail me</p></form>"
          "<div class=comments><p>I disagree strongly with all of it</p></div></article>")), TEXT),
    (page("<main>" + ARTICLE.replace("article", "div") + "</main><div>more stories here</div>"), TEXT),
    (page("<div class='menu'>go home</div><p>No root here at all</p><p>but two paragraphs.</p><div class=sidebar>left or right</div>"),
     "No root here at all but two paragraphs."),
    (ARTICLE.replace("</article>", ""), TEXT),
    ("just words & more", "just words & more"), ("", ""), (None, ""), ("<p></p><br>", ""), ("<<<>>> a < b", "<<<>>> a < b"),
    (page("<article><p title=\"a > b\">quoted <img alt='<p>'>mark</p></article>"), "quoted mark"),
    (page("<article><p>one<span>two</span></p><ul><li>x</li><li>y</li></ul><table><tr><td>3</td><td>4</td></tr></table></article>"), "onetwo x y 3 4"),
]


def test_pages_give_their_article(spark):
    df = spark.createDataFrame([(k, f"u{k}", h, "old") for k, (h, _) in enumerate(PAGES)] + [(0, None, PAGES[0][0], None)], "page_id bigint, url string, html string, text string")
    weights = extract.learn_weights(df)
    got = extract.extract_text(df, weights).select("page_id", "text").collect()
    assert len(got) == len(PAGES) + 1
    assert {r.page_id: r.text for r in got} == {k: t for k, (_, t) in enumerate(PAGES)}
    assert all(w <= 0 for f, w in weights.items() if f[0] == "0")


def test_extraction_without_labels_or_rows(spark):
    schema = "page_id bigint, url string, html string"
    assert extract.learn_weights(spark.createDataFrame([], schema)) == extract.weights_of({})
    assert extract.extract_text(spark.createDataFrame([], schema), extract.weights_of({})).count() == 0
    for html, text in PAGES[:-1]:  # without labels, lists and tables count as less than paragraphs
        assert extract.main_text(html, extract.weights_of({})) == text


def test_articles_are_whole_around_boilerplate_inside_them():
    """Nothing of an article goes for what stands between its paragraphs, or for the lists and tables it ends with."""
    advert = "<div class='ad'>" + "<b>buy</b> this now " * 40 + "</div>"
    parts = ["<aside>" + "by the way " * 30 + "</aside>", "<form><p>" + "mail me " * 20 + "</p></form>", "<script>" + "x = 1; " * 99 + "</script>", advert]
    for weights in (extract.weights_of({}), extract.weights_of({("1+p", True): 9000, ("0+p", True): 90, ("1-div", False): 9000, ("1+li", False): 500})):
        for part in [*parts, "".join(parts)]:
            html = page("<nav>menu here</nav><article><p>First short one.</p>" + part + "<p>Last one.</p></article><footer>foot</footer>")
            assert extract.main_text(html, weights) == "First short one. Last one."
        edge = "<ul><li>x</li><li>y</li></ul><table><tr><th>3</th><td>4</td></tr></table>"
        assert extract.main_text(page(f"<main>{edge}<p>Between.</p>{edge}</main><p>more stories</p>"), weights) == "x y 3 4 Between. x y 3 4"


def test_wrappers_with_hint_words_keep_their_article():
    weights = extract.weights_of({})
    nav, side = "<nav>menu here</nav>", "<div class='sidebar'><article>a teaser of some other text</article></div>"
    for opening in ("<div class='layout has-sidebar'>", "<div id=with-sidebar>", "<div class='header-fixed'>", "<div class='side-by-side'>", "<div class='ads-top comments-open'>",
                    "<form method=post>", "<form id=aspnetForm><div class='content-widget'>"):
        for article in (ARTICLE, ARTICLE.replace("article>", "main>"), "<main><div class='row with-sidebar'>" + ARTICLE + side + "</div></main>"):
            html = page(opening + nav + article + side)
            assert extract.main_text(html, weights) == TEXT
            assert extract.label_counts(html)["1+p", True] > 0
    comments = "<ol class='comment-list'><li><article><p>I disagree strongly with all of it</p></article></li></ol>"
    related = "<div class='related-posts'><article>one more</article></div>"
    assert extract.main_text(page("<main>" + ARTICLE + comments + related + "<aside><article>or this</article></aside></main>"), weights) == TEXT
    assert extract.main_text(page("<p>No root of its own here.</p>" + comments + related), weights) == "No root of its own here."


LEARNED = extract.weights_of({("1+p", True): 9000, ("0+p", True): 90, ("1-div", False): 9000, ("1+a", False): 500, ("1-a", False): 500, ("0-div", False): 90})


def test_text_on_both_sides_of_an_interruption_stays():
    """Without a root too, and between several roots; long, short and at the edges."""
    words = "nine words of an advert that nobody will read "
    parts = ["<div class='ad'>" + words + "</div>", "<form><p>mail me</p></form>", "<aside>" + words * 5 + "</aside>",
             "<div class='ad'>" + words * 200 + "</div> <div class='share-buttons'>tell others</div>", "<nav><ul><li><a>menu</a></li></ul></nav>"]
    for weights in (extract.weights_of({}), LEARNED):
        for part in [*parts, "".join(parts), " ".join(parts)]:
            html = page(f"{part}<div id=content><p>First part here.</p>{part}<p>Last.</p></div>{part}")
            assert extract.main_text(html, weights) == "First part here. Last."
            html = page(f"{part}<article><p>one</p></article>{part}<article><p>and two</p></article>{part}")
            assert extract.main_text(html, weights) == "one and two"
        html = page("<ul><li><a href=/>Home</a></li><li><a href=/b><b>News</b></a></li></ul><p>Some text stands here.</p><ul><li>one point</li><li>another</li></ul>"
                    "<table><tr><td>3</td><td>4 m</td></tr></table><div class='footer-links'><a>legal</a></div>")
        assert extract.main_text(html, weights) == "Some text stands here. one point another 3 4 m"


def test_names_that_merely_hold_a_hint_word_are_text():
    weights = extract.weights_of({})
    for name in ("social-issues", "notice-of-intent", "alert-fatigue", "search-results-explained", "legal_history", "header-files"):
        assert extract.main_text(page(f"<article><div class='{name}'>whole text</div></article>"), weights) == "whole text"
        assert extract.main_text(page(f"<div class='{name}'><p>whole text</p></div>"), weights) == "whole text"
    assert extract.main_text(page("<main><div class='article-header'><h1>Head</h1></div><p>text</p></main>"), weights) == "Head text"
    for name in ("share-buttons", "cookie-notice", "newsletter-box", "social_links", "page-header", "ad", "breadcrumb-list", "ads-top", "legal"):
        assert extract.main_text(page(f"<article><p>text</p><div class='{name}'>not this</div></article>"), weights) == "text"


def test_weights_decide_how_far_a_region_reaches():
    """The same page, without a root, by two sets of weights."""
    html = page("<div>some words of a div</div><p>a p</p>")
    assert extract.main_text(html, extract.weights_of({})) == "some words of a div a p"
    assert extract.main_text(html, extract.weights_of({("1+div", False): 900, ("1+p", True): 900})) == "a p"


def brute_interruptions(scores, bad):
    """Best sum over all regions if each run of boilerplate inside one counts at least -INTERRUPTION."""
    best = 0.0
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            total = sum(s for s, x in zip(scores[a:b], bad[a:b], strict=True) if not x)
            runs = "".join("-" if x else "+" for x in bad[a:b])
            at = a
            for run in re.findall(r"-+|\++", runs):
                if run[0] == "-":
                    total += max(sum(scores[at:at + len(run)]), -extract.INTERRUPTION)
                at += len(run)
            best = max(best, total)
    return best


def test_interruptions_cost_a_bounded_amount():
    r = random.Random(2)
    for _ in range(300):
        bad = [r.random() < 0.5 for _ in range(r.randint(0, 12))]
        scores = [-r.choice([0.05, 0.1, 4.0]) if b else r.choice([0.7, 1.0, -0.05, -0.5]) for b in bad]
        flat = extract.with_interruptions(scores, bad, [1] * len(bad))
        i, j = extract.best_region(flat)
        assert abs(sum(flat[i:j]) - brute_interruptions(scores, bad)) < 1e-9


def test_best_region_is_the_best():
    r = random.Random(1)
    for _ in range(300):
        s = [r.randint(-4, 4) for _ in range(r.randint(0, 12))]
        i, j = extract.best_region(s)
        assert sum(s[i:j]) == max([0, *(sum(s[a:b]) for a in range(len(s)) for b in range(a, len(s) + 1))])


def test_hostile_markup_is_read_in_time():
    for html in ("<" * 200_000, "<a " * 60_000, "<a '" * 50_000, "<div>" * 30_000 + "x", "<!--" * 50_000, "&" * 100_000):
        extract.main_text(html, extract.weights_of({}))


# --- tokens ----------------------------------------------------------------------------------------------------------

def library(vocabulary):
    return LibraryUnigram([("<unk>", min(s for _, s in vocabulary)), *vocabulary], 0, False)


def test_counts_equal_the_library():
    r = random.Random(1)
    for _ in range(200):  # few scores, so many ties
        pieces = {"".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 8))}
        vocabulary = [(p, float(r.choice([-1, -2, -3, -1.5]))) for p in sorted(pieces)]
        model, ours = library(vocabulary), tokencount.Unigram(vocabulary)
        for _ in range(30):
            word = "".join(r.choice("abcdx") for _ in range(r.randint(1, 12)))
            assert ours.count(word)[0] == len(model.tokenize(word))


def test_token_counts_of_documents(table, corpus):
    rows = corpus + [(200, "中文 \U0001f600\U0001f601 naïve  über")]
    model = library(tokencount.unigram_vocabulary(PIECES))
    want = {d: sum(len(model.tokenize("▁" + w.decode())) for w in (t or "").encode().split()) for d, t in rows}
    got = tokencount.count_tokens(table(rows), PIECES).collect()
    assert len(got) == len(rows) and all(r.n_tokens == want[r.doc_id] and r.row == "x" for r in got)
    assert all((r.n_words, r.token_score) == (0, 0.0) for r in got if r.doc_id in (90, 91, 92))
    assert tokencount.count_tokens(table([]), PIECES).count() == 0


def test_chunks_give_the_library_ids():
    library_bpe = Tokenizer.from_file(BPE)
    library_bpe.encode_special_tokens = True
    chunks, r = packing.Chunks(BPE, 50), random.Random(0)
    parts = [" ", "  ", "\n", " \n", "\t", "a", "bc", "'s", "1", "!", "\xe9", "\xa0", "　", "<|endoftext|>", "中", "\x1c", "\x85", "\U0001f642", "'"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(chunks.ids(text), "<u4").tolist() == library_bpe.encode(text, add_special_tokens=False).ids


def test_added_tokens_have_their_ids(table):
    library_bpe = Tokenizer.from_file(BPE)
    chunks, r = packing.Chunks(BPE, 50), random.Random(2)
    assert np.frombuffer(chunks.library_ids("a <|endoftext|> b"), "<u4").tolist() == [64, 220, 50256, 275]
    parts = [" ", "  ", "\n", "a", "bc", "'s", "1", "<|endoftext|>", "<|endoftext|>", "<|endof", "|>", "<|EndOfText|>", "中", "\xa0"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert np.frombuffer(chunks.library_ids(text), "<u4").tolist() == library_bpe.encode(text, add_special_tokens=False).ids
    rows = [(0, "a <|endoftext|> b"), (1, "<|endoftext|>" * 3000), (2, "plain")]
    got = packing.pack_documents(table(rows), BPE).collect()
    for d, text in rows:
        ids = np.array([*library_bpe.encode(text, add_special_tokens=False).ids, 1], dtype="<u4")
        of_doc = [p for p in got if p.doc_id == d]
        assert sum(p.length for p in of_doc) == len(ids)
        assert all((p.doc_tokens, p.ids_crc32) == (len(ids), zlib.crc32(ids[p.start:p.start + p.length].tobytes())) for p in of_doc)


def check_packing(pieces, rows):
    library_bpe = Tokenizer.from_file(BPE)
    library_bpe.encode_special_tokens = True
    ids = {d: np.array([*library_bpe.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4") for d, t in rows}
    times = {d: sum(1 for x, _ in rows if x == d) for d, _ in rows}
    covered, sequences = {d: np.zeros(len(v), dtype=int) for d, v in ids.items()}, {}
    for p in pieces:
        assert p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.doc_id][p.start:p.start + p.length].tobytes())
        covered[p.doc_id][p.start:p.start + p.length] += 1
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert all((c == times[d]).all() for d, c in covered.items())
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding


def test_packing_is_whole_and_gapless(table, corpus):
    assert check_packing(packing.pack_documents(table(corpus), BPE).collect(), corpus) == 0
    assert check_packing(packing.pack_documents(table(corpus), BPE, most_open=2).collect(), corpus) == 0
    assert packing.pack_documents(table([]), BPE).count() == 0


def test_level_minimises_the_sum_of_squares():
    packer, r = packing.Packer(window=16), random.Random(4)
    for step in range(400):
        size = r.randint(1, 15)
        before = packer.levels.copy()

        def cost(level):
            after = before.copy()
            if level:
                after[level] -= 1
            after[level + size] += 1
            return int((after[1:16] ** 2).sum())

        options = [g for g in range(17 - size) if g == 0 or before[g]]
        best = min(map(cost, options))
        assert packer.level_for(size) == max(g for g in options if cost(g) == best)
        packer.add(step, b"\1\0\0\0" * size)
        assert packer.levels.sum() == packer.n_open == sum(map(len, packer.open.values()))


# --- fingerprints ----------------------------------------------------------------------------------------------------

def test_fingerprints_and_edits(table, corpus):
    rows = [x for x in corpus if x[0] != 100]  # one row for each id
    order = sorted(rows, key=lambda x: (x[0] is not None, x[0]))
    got = {r.doc_id: r for r in fingerprint.compare_with_edits(table(rows)).collect()}
    assert len(got) == len(rows)
    for k, (d, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[:len(t) - len(t) // 4] + following[:len(t) // 4]
        assert (got[d].n_chars, got[d].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        own, other, after = (fingerprint.sketches([x.encode()])[0] for x in (t, edited, following))
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (fingerprint.written(own), fingerprint.written(other))
        assert got[d].near_edited == fingerprint.likeness(own, other) and got[d].near_next == fingerprint.likeness(own, after)
    assert len({got[d].fingerprint for d in (90, 91)}) == 1
    assert fingerprint.compare_with_edits(table([])).count() == 0
    assert fingerprint.compare_with_edits(table([(1, "alone in the table")])).first().near_next == 1.0
    assert fingerprint.compare_with_edits(table([(100, "same"), (100, "same"), (7, None)])).count() == 3


def test_long_texts_of_few_distinct_shingles_keep_them_all():
    texts = [b"a" * 50_000, b"b" * 50_000, b"one line, again and again\n" * 4000, b"another row; 1; 2; 3\n" * 4000, b"x" * 300]
    made = fingerprint.sketches(texts)
    for text, (scale, kept) in zip(texts, made, strict=True):
        assert scale == 1 and len(kept) == len({text[k:k + 10] for k in range(len(text) - 9)})
    for i, a in enumerate(made):
        assert [fingerprint.likeness(a, b) for b in made] == [float(i == j) for j in range(len(made))]
    line, other = texts[2].decode(), texts[3].decode()
    edited = fingerprint.sketches([fingerprint.edited_text(line, other).encode()])[0]
    assert edited[0] == 1 and fingerprint.likeness(made[2], edited) == 1.0
    r = random.Random(3)
    for distinct in (200, 256, 257, 300):  # in a text of many kilobytes, whose last shingles are the new ones
        body = bytes(r.randrange(256) for _ in range(distinct - 1))
        (scale, kept), = fingerprint.sketches([b"\0" * 30_000 + body])
        n = len({(b"\0" * 30_000 + body)[k:k + 10] for k in range(30_000 + len(body) - 9)})
        assert (scale, len(kept)) == (1, n) if n <= 256 else scale == 16


def test_sketches_merge_and_estimate_containment():
    r = random.Random(9)
    a, b = (" ".join(str(r.random()) for _ in range(n)) for n in (300, 6000))
    one, two, both = fingerprint.sketches([a.encode(), b.encode(), (a + "|" + b).encode()])
    joined = set(fingerprint.merged(one, two)[1].tolist())
    assert len(joined ^ set(both[1].tolist())) <= 3
    assert fingerprint.likeness(one, both) == 1.0 and fingerprint.likeness(one, two) < 0.02
    assert fingerprint.read_sketch(fingerprint.written(one))[1].tolist() == one[1].tolist()
    half = fingerprint.sketches([a[:len(a) // 2].encode()])[0]
    assert abs(fingerprint.likeness(half, one) - 1) < 0.02


# --- language --------------------------------------------------------------------------------------------------------

def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = langid.learn(docs)
    assert net.languages == sorted(r.lang for r in docs.select("lang").distinct().collect())
    said = langid.identify(docs, net).where(langid.remainder(F.col("doc_id")) == 1)
    right = said.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert right > 0.97
    windows = np.random.default_rng(1).integers(0, 256, (20, langid.WINDOW_BYTES), dtype=np.uint8)
    assert np.allclose(net.probabilities(windows), net.paired().probabilities(windows), atol=1e-4)


def test_language_of_odd_texts(table):
    rows = [(k, t, g) for k, (t, g) in enumerate([("the cat sat on the mat", "en"), ("le chat est sur la table", "fr")] * 30)]
    rows += [(100, None, "en"), (101, "", "en"), (102, "12 34 !?", "fr"), (103, "²½", None), (104, "é", None), (None, "the cat", "en"), (106, "x" * 100_000, None),
             (107, "the cat", None), (107, "the cat", None)]
    said = langid.identify(table(rows), langid.learn(table(rows))).collect()
    got = {r.doc_id: (r.lang_pred, r.score) for r in said}
    assert len(said) == len(rows) and all(0 <= r.score <= 1 for r in said)
    assert [got[k] for k in (100, 101, 102, 103)] == [("und", 0.0)] * 4
    assert all(got[k][0] in ("en", "fr") for k in (104, 106)) and got[None][0] == got[107][0] == "en" and got[1][0] == "fr"
    unlabelled = langid.identify(table([(1, "words")]), langid.learn(table([(1, "words")]))).first()
    assert (unlabelled.lang_pred, unlabelled.score) == ("und", 0.0)
    single = table([(k, "only one", "en") for k in range(9)])
    assert {(r.lang_pred, r.score) for r in langid.identify(single, langid.learn(single)).collect()} == {("en", 1.0)}
    assert langid.identify(table([]), langid.learn(table([]))).count() == 0


@pytest.mark.parametrize("size", [1, 255, 256, 257, 1000])
def test_windows_hold_the_whole_text(size):
    text = bytes(97 + k % 26 for k in range(size))
    assert langid.windows_of(text).tobytes().rstrip(b"\0") == text
