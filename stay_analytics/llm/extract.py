"""Main text of web pages by the maximum-scoring subsequence of their tokens.

A page is a sequence of words and tags. Words score by where they stand and
tags cost a little; both weights are log-odds counted on labelled pages, that
is, on pages whose author marked the content with ``<article>`` or ``<main>``.
One scan finds the contiguous run of tokens with the largest sum; the words of
that run, without those inside menus, forms and the like, are the text.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_of

# Element names of HTML.
CONTENT_ROOTS = frozenset("article main".split())
RAW = "script style template noscript textarea iframe svg math object canvas audio video select title"
BOILERPLATE = frozenset("nav aside footer form fieldset button menu dialog head label datalist".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption "
                   "figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre "
                   "section summary table tbody td tfoot th thead tr ul".split())
INLINE = frozenset("a abbr b bdi bdo big cite code del dfn em font i img ins kbd mark q s samp small span strike strong sub "
                   "sup time tt u var wbr".split())
# Words of class, id and role values that name parts of a page other than its article.
HINTS = frozenset("ad ads advert adverts advertisement advertising banner promo promoted promotion sponsor sponsored "
                  "comment comments commentlist respond replies disqus cookie cookies consent gdpr notice notices alert "
                  "sidebar side rail widget widgets related recommended menu nav navbar navigation breadcrumb breadcrumbs "
                  "toolbar header masthead topbar footer foot copyright legal share sharing social newsletter subscribe "
                  "subscription signup login search popup modal overlay pagination pager complementary contentinfo".split())
#: Of these, words that name a list of other texts: an article inside one is not the page's article.
LISTS = frozenset("comment comments commentlist respond replies disqus related recommended promoted sponsored".split())
#: Names that say the same only if they stand alone, as in class="sidebar", not as in class="sidebar-layout".
ALONE = frozenset("ad ads advert adverts advertisement promo sidebar side rail widget widgets menu nav navbar navigation footer foot "
                  "popup modal".split())
#: Such a name tells how a part looks, not what it is: has-sidebar, side-by-side, comments-open.
STATES = re.compile(r"(?:has|with|without|no|is|side-by)(?:[-_]|(?=[A-Z]))|.*[-_](?:open|closed|enabled|disabled|on|off|layout)\Z")
#: Elements that are boilerplate by themselves, but around a whole page only its wrapper.
WRAPPERS = frozenset("form fieldset".split())
# Words of compound names that tell of shape or place, not of what a part is: share-buttons is a share, social-issues an issue.
NEUTRAL = frozenset("bar box block list links link button buttons container wrap wrapper area section item items inner outer unit slot row panel "
                    "group holder top bottom left right main primary secondary fixed sticky small large widget".split())
#: With one of these, a header is that of the article.
OF_ARTICLE = frozenset("article post entry story".split())
#: How boilerplate an element is: not; unless a content root opens inside it; with all it holds.
TEXT, UNLESS_ROOT, ALL = 0, 1, 2
# A "<" outside quotes ends an unfinished tag, which is then text; so no tag is sought farther than the next one.
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<({'|'.join(RAW.split())})\b(?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+>.*?(?:</\1\s*>|\Z)"
                   r"|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/<>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\"<>])*+)>",
                   re.DOTALL | re.IGNORECASE)
HINT_ATTRIBUTE = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.IGNORECASE)
HINT_WORD = re.compile(r"[A-Za-z]+")

WORD_LIMITS, TAG_LIMITS = (-4.0, 1.0), (-4.0, -0.05)
#: What a word of an article scores at least, whatever block it stands in.
LEAST_INSIDE = 0.05
#: What one interruption, a run of boilerplate however long, costs at most, so that text on both sides of it stays.
INTERRUPTION = 0.25
#: Blocks that hold menus as often as text; there, words in links are told apart.
LISTED = frozenset("li td th dt".split())
#: At most so many labelled pages are read to count weights.
LABELLED_PAGES = 2000


def hinted(attributes: str) -> int:
    """How far class, id or role name a part other than the article: TEXT, UNLESS_ROOT or ALL."""
    out = TEXT
    for value in HINT_ATTRIBUTE.findall(attributes) if "=" in attributes else ():
        for name in value.strip("\"'").split():
            words = [] if STATES.match(name) else [w.lower() for w in HINT_WORD.findall(name)]
            if any(w in LISTS for w in words) or name.lower() in ALONE:
                return ALL
            kinds = [w for w in words if w not in NEUTRAL] or words
            if kinds and kinds[-1] in HINTS and not (kinds[-1] in ("header", "head") and OF_ARTICLE.intersection(words)):
                out = UNLESS_ROOT
    return out


def tokens(html: str):
    """Tokens of a page in order: (kind, place, boilerplate, in_root, text).

    kind 0 is a tag (place: its name), 1 a run of text (place: the innermost
    block around it, or ``a`` in a link of a list or table). boilerplate: it stands in a menu, form, advert or the
    like. Scripts, styles, titles, comments and declarations give nothing.
    End tags close the innermost open element of their name; the rest that
    authors leave open is closed with it. A wrapper whose class merely holds
    such a word, or a form, does not make the <article> or <main> in it
    boilerplate; a menu, an aside or a list of comments does.
    """
    at, stack = 0, []  # (name, how boilerplate, in_root)

    def run(text):
        block = next((n for n, _, _ in reversed(stack) if n in BLOCKS), "body")
        if block in LISTED and any(n == "a" for n, _, _ in stack[-3:]):
            block = "a"
        _, bad, root = stack[-1] if stack else ("", TEXT, False)
        return 1, block, bad > TEXT, root, unescape(text)

    for m in TOKEN.finditer(html):
        if m.start() > at:
            yield run(html[at:m.start()])
        at, name = m.end(), (m[3] or "").lower()
        if m[0].startswith("<![CDATA["):
            yield run(m[0][9:-3])
        if not name:
            if m[1]:  # what a script leaves is a break in the text
                yield 0, m[1].lower(), True, bool(stack and stack[-1][2]), ""
            continue
        _, bad, root = stack[-1] if stack else ("", TEXT, False)
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    _, bad, root = stack[k]
                    del stack[k:]
                    break
            yield 0, name, bad > TEXT, root, ""
            continue
        root = root or name in CONTENT_ROOTS
        if name in CONTENT_ROOTS:
            bad = ALL if bad == ALL else TEXT
        elif name in WRAPPERS:
            bad = max(bad, UNLESS_ROOT)
        elif name in BOILERPLATE or (name == "header" and not root):
            bad = ALL
        elif name not in ("html", "body") and bad != ALL:
            bad = max(bad, hinted(m[4]))
        yield 0, name, bad > TEXT, root, ""
        if name == "p":  # a paragraph ends where the next one begins
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == "p":
                    del stack[k:]
                    break
                if stack[k][0] in BLOCKS:
                    break
        if name == "body":
            stack[:] = [x for x in stack if x[0] == "html"]
            bad = TEXT
        if name not in VOID and not m[4].endswith("/"):
            stack.append((name, bad, root))
    if at < len(html):
        yield run(html[at:])


def feature(kind: int, place: str, bad: bool) -> str:
    """The bounded set of names that weights are counted for."""
    return f"{kind}{'-' if bad else '+'}{place if place in BLOCKS or place in INLINE else 'other'}"


def label_counts(html: str) -> Counter | None:
    """(feature, inside) -> words or tags of a labelled page; None for a page without the label."""
    seen = list(tokens(html))
    if not any(k == 0 and p in CONTENT_ROOTS for k, p, *_ in seen):
        return None
    out = Counter()
    for kind, place, bad, root, text in seen:
        out[feature(kind, place, bad), bool(root and not bad)] += len(text.split()) if kind else 1
    return out


COUNTS = pa.schema([("feature", pa.string()), ("inside", pa.bool_()), ("n", pa.int64())])


def count_labels(batches):
    for batch in batches:
        total = Counter()
        for html in batch.column(0).to_pylist():
            if html:
                total.update(label_counts(html) or {})
        keys = list(total)
        yield batch_of({"feature": [f for f, _ in keys], "inside": [i for _, i in keys], "n": [total[k] for k in keys]}, COUNTS)


def clip(x: float, limits: tuple[float, float]) -> float:
    return min(max(x, limits[0]), limits[1])


def prior(place: str, bad: bool) -> tuple[float, float]:
    """Pseudo counts (inside, outside) where no label speaks."""
    return (0.05, 5.0) if bad else (0.5, 1.0) if place in ("a", "header", "other") else (1.5, 1.0) if place in LISTED else (2.0, 1.0)


def weights_of(counts: dict[tuple[str, bool], int]) -> dict[str, float]:
    """Log-odds weights: words within WORD_LIMITS, tags, which always cost, within TAG_LIMITS."""
    out = {}
    for kind in "01":
        for bad in (False, True):
            for place in BLOCKS | INLINE | {"other"}:
                f = feature(int(kind), place, bad)
                a, b = prior(place, bad)
                odds = math.log((counts.get((f, True), 0) + a) / (counts.get((f, False), 0) + b))
                out[f] = clip(odds, WORD_LIMITS if kind == "1" else TAG_LIMITS)
    return out


def learn_weights(pages: DataFrame, html: str = "html", key: str = "page_id", most: int = LABELLED_PAGES) -> dict[str, float]:
    """Weights from at most ``most`` labelled pages, those with the smallest key hashes.

    Counting runs on Spark; the driver gets one number per feature, and the
    features are a fixed set. Without labelled pages the priors decide.
    """
    labelled = pages.where(F.lower(F.col(html)).rlike("<(article|main)[\\s>]"))
    # Keys first: choosing among whole pages would carry ``most`` of them from every task.
    keys = [r[0] for r in labelled.where(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(key), key).limit(most).collect()]
    sample = labelled.where(F.col(key).isin(keys)).select(F.col(html).alias("html"))
    rows = sample.repartition(max(1, most // 250)).mapInArrow(count_labels, "feature string, inside boolean, n bigint") \
        .groupBy("feature", "inside").agg(F.sum("n").alias("n")).collect()
    return weights_of({(r.feature, r.inside): r.n for r in rows})


def best_region(scores: list[float]) -> tuple[int, int]:
    """[i, j) of the contiguous run with the largest positive sum, the first and shortest on a tie; (0, 0) if none is positive."""
    best, total, start, region = 0.0, 0.0, 0, (0, 0)
    for k, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, k
        total += s
        if total > best:
            best, region = total, (start, k + 1)
    return region


def score(kind: int, place: str, bad: bool, root: bool, n: int, weights: dict[str, float]) -> float:
    """What a token adds to a run. Inside a content root, tags and boilerplate cost nothing: they part no text and are left out of it anyway."""
    w = weights[feature(kind, place, bad)]
    if root:
        return 0.0 if bad or not kind else max(w, LEAST_INSIDE) * n
    return w * (n if kind else 1)


def with_interruptions(scores: list[float], bad: list[bool], words: list[int]) -> list[float]:
    """Scores in which no run of boilerplate tokens, with the empty text among them, costs more than INTERRUPTION."""
    out, start = list(scores), None
    for k in range(len(scores) + 1):
        if k < len(scores) and (bad[k] or (start is not None and not words[k] and scores[k] == 0.0)):
            start = k if start is None else start
        elif start is not None:
            out[start:k] = [max(sum(out[start:k]), -INTERRUPTION)] + [0.0] * (k - start - 1)
            start = None
    return out


def main_text(html: str | None, weights: dict[str, float]) -> str:
    """Main text of a page: "" for a null or empty page or one without content.

    White space becomes single spaces, blocks are joined by one space.
    Outside an ``<article>`` or ``<main>``, words count as boilerplate if the
    page has such an element and it holds words; of several such elements all
    may be text, whatever stands between them. Pages of any length are read
    whole; of equal regions the first and shortest is taken.
    """
    if not html:
        return ""
    seen = [(k, p, b, r, t, len(t.split()) if k else 0) for k, p, b, r, t in tokens(html)]
    rooted = any(r and not b and n for _, _, b, r, _, n in seen)
    seen = [(k, p, b or (rooted and not r), r, t, n) for k, p, b, r, t, n in seen]
    scores = [score(k, p, b, r, n, weights) for k, p, b, r, _, n in seen]
    i, j = best_region(with_interruptions(scores, [b for _, _, b, *_ in seen], [n if k else 1 for k, *_, n in seen]))
    parts = [" " if k == 0 and p not in INLINE else t for k, p, b, _, t, _ in seen[i:j] if k == 0 or not b]
    return " ".join("".join(parts).split())


def extract_text(pages: DataFrame, weights: dict[str, float], html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text in column ``out`` (one of that name is replaced); no shuffle.

    Null and empty pages give "". Rows are independent, so repeated rows give
    equal texts. ``weights`` holds one number per feature of a fixed set.
    """
    @F.pandas_udf("string")
    def texts(column):
        return column.map(lambda h: main_text(h, weights), na_action=None)

    return pages.withColumn(out, texts(F.col(html)))
