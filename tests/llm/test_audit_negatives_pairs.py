"""Filter audit, hard negatives and byte pairs against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter
from itertools import permutations

import cases
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm import byte_pairs, filter_audit, hard_negatives
from barloom.llm.common import ready

# Filter audit


def audited(docs, labels):
    """The counts by walking every document through every order. docs: (doc_id, lang, text)."""
    out = Counter()
    fails = []
    for i, lang, text in docs:
        t = text or ""
        w = t.encode().split()
        smaller = i is not None and any(j is not None and j < i and (u or "") == t for j, _, u in docs)
        f = [len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t)]
        f += [any(c in "#$%&*|" for c in t), smaller]
        good = i is not None and any(j == i and q == 1 for j, q, _ in labels)
        toxic = i is not None and any(j == i and x == 1 for j, _, x in labels)
        fails.append((lang or "", dict(zip("ABCDE", f, strict=True)), good, toxic))
    parts = {p for p, *_ in fails}
    for p in parts:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in fails if x[0] == p]
            for step, letter in enumerate(order):
                gone = [x for x in left if x[1][letter]]
                left = [x for x in left if not x[1][letter]]
                mine = [x for x in fails if x[0] == p and x[1][letter]]
                key = (p, order, step + 1)
                out[key] = (
                    len(left), len(gone), len(mine) - len(gone), sum(sum(x[1].values()) == 1 for x in mine),
                    sum(x[2] for x in gone), sum(x[3] for x in gone),
                )
    shapley = Counter()
    for (p, order, step), counts in out.items():
        shapley[p, order[step - 1]] += counts[1]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audit_docs():
    rng = random.Random(4)
    out = []
    for i, t in cases.rows():
        extra = rng.choice(["", "$", " A B C D", " #"])
        out.append((i, rng.choice(["en", None, "de", ""]), None if t is None else t + extra))
    return out + [(900, "en", "z"), (901, "de", "z"), (901, "de", "z"), (899, None, "z")]


@pytest.mark.parametrize("held", [1000, 1])
def test_audit_equals_walk(spark, monkeypatch, held):
    monkeypatch.setattr(filter_audit, "HELD", held)
    rows = audit_docs()
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("mask", "sha")] + [T.StructField("doc_id", T.LongType())]
                          + [T.StructField(n, T.StringType()) for n in ("lang", "text", "part", "first")])
    docs = ready(spark).createDataFrame([("m", "s", i, lang, t, "p", "f") for i, lang, t in rows], schema).repartition(5)
    labels = [(i, i % 2, i % 3 % 2) for i in range(10, 90)] + [(50, None, 1), (None, 1, 1), (51, 0, None), (51, 1, None)]
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    found = filter_audit.audit(docs, said).collect()
    got = {(r.part, r.filter_order, r.step): tuple(r[c] for c in filter_audit.COUNTS) for r in found}
    assert len(found) == len(got) and got == audited(rows, labels)
    assert filter_audit.audit(docs.limit(0), said.limit(0)).count() == 0


def test_fields_hold_many_documents():
    """Counts near 2^48 in neighbouring fields do not run into each other."""
    many = (1 << filter_audit.WIDTH) - 1
    total = many * filter_audit.outcome(0b00001, 3)
    fields = [total >> filter_audit.WIDTH * f & many for f in range(filter_audit.DOCS)]
    assert set(fields) == {0, many} and total >> filter_audit.WIDTH * filter_audit.DOCS == many


# Hard negatives


def mined(rows, positives=5, negatives=3):
    """[(anchor, positive, rank, negative, positive score, negative score)] by all pairs."""
    part = []
    for i, label, x in rows:
        if label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v = tuple(int(np.floor(256 * float(np.float32(c)))) for c in x)
            if (i, label, v) not in part:
                part.append((i, label, v))
    out = Counter()
    for a in part:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(sum(p * q for p, q in zip(a[2], b[2], strict=False)), b) for b in part if b != a]
        scored.sort(key=lambda s: (-s[0], s[1][0] is None, s[1][0] or 0))
        for ps, p in [s for s in scored if s[1][1] == a[1]][:positives]:
            inside = [s for s in scored if s[1][1] != a[1] and 50 * ps <= 100 * s[0] <= 95 * ps][:negatives]
            out.update((a[0], p[0], k + 1, n[0], ps, ns) for k, (ns, n) in enumerate(inside))
    return out


def vectors(seed, n=260, dims=20):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    out = [(i, rng.randrange(4), [0.1 * (c + rng.gauss(0, 0.8)) for c in rng.choice(centres)]) for i in range(n)]
    out += [(300, 1, list(out[7][2])), (301, 2, list(out[7][2])), out[0], out[0], out[50], (50, 3, out[50][2])]
    out += [(350, None, [1.0]), (400, 1, None), (450, 1, [1.0, None]), (451, 1, [float("nan")]), (452, 1, [float("inf")])]
    out += [(500, 1, []), (550, 2, [0.0] * dims), (600, 1, [-0.5] * 3), (None, 1, list(out[3][2])), (None, 2, list(out[4][2]))]
    return out


def mine(spark, rows):
    shape = "label int, block string, score string, vec_id long, embedding array<float>, a string"
    frame = ready(spark).createDataFrame([(label, "b", "s", i, x, "a") for i, label, x in rows], shape).repartition(3)
    found = hard_negatives.hard_negatives(hard_negatives.scaled(frame), F.col("vec_id") % 50 == 0)
    return Counter(tuple(r) for r in found.collect())


@pytest.mark.parametrize(("block", "chunk"), [(1024, 512), (16, 3)])
def test_negatives_equal_all_pairs(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    rows = vectors(1)
    want = mined(rows)
    assert mine(spark, rows) == want and len(want) > 40


def test_negatives_of_few_rows(spark):
    assert not mine(spark, [])
    assert not mine(spark, [(0, 1, [1.0])])
    ties = [(i, i % 2, [0.5, 0.25]) for i in range(9)] + [(20 + i, 1, [0.4, 0.2]) for i in range(6)]
    assert mine(spark, ties) == mined(ties)


@pytest.mark.parametrize("size", [300, 1 << 28])
@pytest.mark.parametrize("share", [None, 0.0, 0.3, 0.7, 0.95])
def test_reached_equals_product(size, share):
    rng = np.random.default_rng(5)
    y = (rng.normal(0, 1, (200, 19)) / 4 * size).astype(np.int32)
    x = y[:30, :17] + rng.integers(-3, 4, (30, 17), np.int32)
    least = np.full(30, -np.inf) if share is None else share * (x.astype(float) ** 2).sum(1)
    exact = x.astype(object) @ y[:, :17].T.astype(object)
    a, r, score = hard_negatives.reached(x, y, least)
    want = {(i, j): int(exact[i, j]) for i in range(30) for j in range(200) if exact[i, j] >= least[i]}
    assert dict(zip(zip(a.tolist(), r.tolist(), strict=True), score.tolist(), strict=True)) == want


# Byte pairs

PATTERN = public_tokenizers.PATTERN
SPEC = byte_pairs.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
PARTS = [
    "a", "b", " ", "  ", "\n", "'s", "'", "'ll", "é", "日本", "\t", "1", "23", "!", "...", "the", "ing", "\U0001f600",
    "́", "x" * 50, "　", "Ж", "ZZ", " the", " and", "\x1c", "l", "\xa0", "<|endoftext|>", "\x00",
]


@pytest.fixture(scope="module")
def pairs():
    return byte_pairs.BytePairs(SPEC, PATTERN)


@pytest.fixture(scope="module")
def library(pairs):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def ids(data):
    return np.frombuffer(data, "<i4").tolist()


def odd_text(rng, most=40):
    return "".join(rng.choice(PARTS) for _ in range(rng.randrange(most)))


def test_pairs_fit_as_merged(pairs):
    """The test on edges against merging the two tokens."""
    rng = random.Random(1)
    some = [i for i in range(2000)] + rng.sample(sorted(pairs.tokens), 2000)
    seen = Counter()
    cut = [(t[:k], t[k:]) for t in map(pairs.tokens.get, some) for k in range(1, len(t))]
    halves = [(pairs.ranks[a], pairs.ranks[b]) for a, b in cut if a in pairs.ranks and b in pairs.ranks]
    for a, b in halves + [(rng.choice(some), rng.choice(some)) for _ in range(20_000)]:
        merged = [pairs.ranks[p] for p in pairs.merged(pairs.tokens[a] + pairs.tokens[b])]
        assert pairs.fits(a, b) == (merged == [a, b])
        seen[merged == [a, b]] += 1
    assert min(seen.values()) > 1000


def test_ids_equal_the_library(pairs, library):
    rng = random.Random(2)
    texts = [odd_text(rng) for _ in range(3000)] + ["a" * 50_000, " " * 50_000, "日" * 20_000, "ab" * 20_000]
    for t in texts:
        assert ids(pairs.encode(t)) == library.encode_ordinary(t)


@pytest.mark.parametrize("ranks", ["byte_bpe_multi_50k.tiktoken"])
def test_ids_of_other_ranks(ranks):
    pairs = byte_pairs.BytePairs(byte_pairs.read_ranks(public_tokenizers.path(ranks)), PATTERN)
    library = tiktoken.Encoding("other", pat_str=PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})
    rng = random.Random(3)
    for t in [odd_text(rng) for _ in range(1000)]:
        assert ids(pairs.encode(t)) == library.encode_ordinary(t)


def test_tables_after_edits_equal_tables_from_scratch(pairs, library):
    rng = random.Random(4)
    for _ in range(3000):
        t, new = odd_text(rng), odd_text(rng, 5)
        first = rng.randrange(len(t) + 1)
        end = rng.randrange(first, len(t) + 1)
        whole, starts, lasts = pairs.edit(t, *pairs.state(t), first, end, new)
        assert whole == t[:first] + new + t[end:] and (starts, lasts) == pairs.state(whole)
        assert pairs.ids_of(whole, starts, lasts) == library.encode_ordinary(whole)


def test_an_edit_leaves_distant_pieces_alone(pairs, monkeypatch):
    t = " ".join(f"word{i}" for i in range(2000))
    state, seen = pairs.state(t), []
    extend = pairs.extend
    monkeypatch.setattr(pairs, "extend", lambda piece, lasts: seen.append(piece) or extend(piece, lasts))
    pairs.edit(t, *state, 6000, 6001, "x")
    pairs.edit(t, *state, len(t), len(t), "more")
    assert len(seen) < 20


def test_documents_of_every_kind(spark, library):
    rows = [*cases.rows(), (80, "<|endoftext|> it's"), (81, "x" * 20_000)]
    encoded = byte_pairs.encode(cases.frame(ready(spark), rows), SPEC, PATTERN)
    found = Counter(tuple(r) for r in byte_pairs.digest(byte_pairs.decode(encoded, SPEC, PATTERN)).collect())
    want = Counter()
    for i, t in rows:
        e = library.encode_ordinary(t or "")
        want[i, len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), cases.sha(t or "")] += 1
    assert found == want
    assert byte_pairs.encode(cases.frame(spark, []), SPEC, PATTERN).count() == 0


def test_edited_documents(spark, library):
    rows = [(i, t) for i, t in cases.rows() if i is not None and i not in (50, 51)] + [(None, "none")]
    frame = cases.frame(ready(spark), rows)
    state = byte_pairs.tables(frame, SPEC, PATTERN)
    edits = [(i, None, None, " and more") for i, _ in rows[:9]] + [(70, 5000, 5010, "X's"), (54, 0, 3, None), (999, 1, 2, "z"), (None, 0, 0, "q")]
    changes = spark.createDataFrame(edits, "doc_id long, first int, end int, new string")
    found = byte_pairs.ids_of(byte_pairs.edited(state, changes, SPEC, PATTERN), SPEC, PATTERN)
    by_id = {i: e for i, *e in edits if i is not None}
    want = {}
    for i, t in rows:
        t = t or ""
        if i in by_id:
            first, end, new = by_id[i]
            first, end = len(t) if first is None else first, len(t) if end is None else end
            t = t[:first] + (new or "") + t[end:]
        want[i] = library.encode_ordinary(t)
    assert {r.doc_id: list(r.ids) for r in found.collect()} == want
