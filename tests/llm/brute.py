"""Plain single-process versions of the operators, to compare with."""

import hashlib
from collections import defaultdict

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def rank(doc_id):
    return -(1 << 63) if doc_id is None else doc_id


def shingles(text, width=3):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])


def groups(docs, width=3, threshold=85):
    """Row number -> smallest id of the group, over rows (id, text)."""
    sets = [shingles(t, width) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(docs)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * common >= threshold * (len(sets[i]) + len(sets[j]) - common):
                parent[find(i)] = find(j)
    least = defaultdict(lambda: 1 << 62)
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least[find(i)], rank(d))
    return [least[find(i)] for i in range(len(docs))], [len(s) for s in sets]


def without_passages(docs, window=50):
    """(id, n_words, n_removed, sha256) of rows (id, text)."""
    first = {}
    for d, t in docs:
        w = (t or "").encode().split()
        for k in range(len(w) - window + 1):
            x = tuple(w[k:k + window])
            first[x] = min(first.get(x, 1 << 62), rank(d))
    out = []
    for d, t in docs:
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k:k + window])] < rank(d):
                gone[k:k + window] = [True] * window
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out.append((d, len(w), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest()))
    return out


def without_repeats(docs, window=100):
    """(id, n_bytes, n_removed, n_spans, sha256) of rows (id, text); rows of equal id and text are one document."""
    seen, out, done = set(), [], {}
    for d, t in sorted(docs, key=lambda r: (rank(r[0]), r[1] or "")):
        b = (t or "").encode()
        if (d, b) not in done:
            gone = bytearray(len(b))
            for s in range(len(b) - window + 1):
                if b[s:s + window] in seen:
                    gone[s:s + window] = b"\1" * window
                seen.add(b[s:s + window])
            spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
            kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
            done[d, b] = (d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
        out.append(done[d, b])
    return out


def best(vectors, k=5, every=50):
    """(query, rank, id, score) over rows (id, integer vector)."""
    out = []
    for q, x in vectors:
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), i) for i, y in vectors if i != q and len(x) == len(y))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return sorted(out)
