"""Documents with every odd case, and brute-force versions of the operators."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

from pyspark.sql import types as T

LETTERS = "the of and stone river lamp water green seven window paper quiet north".split()

#: Other columns of the test documents: names that operators use for themselves.
CLASHES = ("sig", "kept", "fp", "words", "rest", "part", "lines", "length", "rank", "h", "spans", "score", "window", "d")


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(LETTERS) + str(rng.randrange(40)) for _ in range(n))


def rows(seed: int = 0) -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, ties, repeated rows and ids, copies, long texts."""
    rng = random.Random(seed)
    lines = [words(rng, 8) for _ in range(30)]
    base = "\n".join(lines[:8])
    out = [(i, "\n".join(words(rng, rng.randrange(1, 12)) for _ in range(rng.randrange(0, 9)))) for i in range(10, 40)]
    out += [(50, base), (51, base), (52, "new " + base), (53, base.replace("\n", " \n ").upper())]
    out += [(54, "\n".join([*lines[20:23], "x", *lines[2:5], "", *lines[2:5]])), (55, "\n".join(lines[3:6]))]
    out += [(60, ""), (61, None), (62, " \n\t "), (63, "a"), (64, "\n".join(["same line"] * 7)), (65, "é ß 日本 \x1c")]
    out += [(70, words(rng, 30_000)), (50, base), (50, base), (51, "other text with this id"), (None, base), (None, None)]
    out += [(None, "no id here"), (None, "no id here"), (-5, "no id here")]
    return out


DOCS = T.StructType(
    [
        T.StructField("lang", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHES],
    ]
)


def frame(spark, pairs):
    """Documents of (doc_id, text), with the clashing columns; `rest` tells the rows apart."""
    other = [f"{c}!" for c in CLASHES]
    return spark.createDataFrame(
        [("xx", i, t, None, None if t is None else len(t), *other) for i, t in pairs], DOCS
    ).repartition(3)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def least(i):
    """Sort key in which a null id comes first."""
    return (i is not None, i if i is not None else 0)


def line_dedup(pairs, order):
    """[(doc_id, text, n_lines, n_removed)] in the order of pairs; order: sort key of (id, text)."""
    first = {}

    def windows(text):
        lines = (text or "").split("\n")
        filled = [k for k, x in enumerate(lines) if x.strip(" \t\r")]
        return lines, filled, [tuple(lines[k].strip(" \t\r") for k in filled[s : s + 3]) for s in range(len(filled) - 2)]

    for i, t in sorted(set(pairs), key=order):
        for s, w in enumerate(windows(t)[2]):
            first.setdefault(w, (i, t or "", s))
    out = []
    for i, t in pairs:
        lines, filled, found = windows(t)
        gone = {filled[s + k] for s, w in enumerate(found) if first[w] != (i, t or "", s) for k in range(3)}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        out.append((i, left if gone else t, len(filled), len(gone)))
    return out


def exact_groups(pairs):
    groups = defaultdict(list)
    for i, t in pairs:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t or "")].append(i)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known) if known else None
        for i, many in Counter(ids).items():
            for copy in range(many):
                out[(i, keep, len(ids), i == keep and copy == 0, sha(text))] += 1
    return out


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hits(text, items):
    """(n_words, hit words, ids of items with occurring windows) by looking at every window."""
    w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
    for item, body in items:
        b = WORD.findall((body or "").translate(LOWER))
        n = min(len(b), 10)
        wanted = {tuple(b[s : s + n]) for s in range(len(b) - n + 1)} if n else set()
        for s in range(len(w) - n + 1) if n else ():
            if tuple(w[s : s + n]) in wanted:
                hit.update(range(s, s + n))
                found.add(item)
    return len(w), hit, found


def simhash(text, shingle=3):
    """The contract's fingerprint, bit by bit."""
    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return 0
    n = min(shingle, len(w))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + n]).encode(), seed=42) for i in range(len(w) - n + 1)]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def components(prints):
    """Smallest id reachable over links of at most two bits, from [(doc_id, fingerprint)]."""
    nodes = sorted({p for _, p in prints})
    root = {p: p for p in nodes}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in nodes:
        for b in nodes:
            if a < b and (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    low = {}
    for i, p in prints:
        if i is not None:
            r = find(p)
            low[r] = min(low.get(r, i), i)
    return [(i, p, low.get(find(p))) for i, p in prints]


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(" ".join(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def near_kept(pairs):
    """Smallest ids over links of a Jaccard similarity of 0.8 or more; texts without words are alike, null ids last."""
    sets, root = [shingles(t) for _, t in pairs], list(range(len(pairs)))

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a in range(len(pairs)):
        for b in range(a):
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    low = {}
    for k, (i, _) in enumerate(pairs):
        r = find(k)
        low[r] = i if low.get(r) is None else low[r] if i is None else min(low[r], i)
    return Counter(low.values())
