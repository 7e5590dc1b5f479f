"""Near copies by five-word shingles against brute force."""

from __future__ import annotations

import random
from collections import Counter

import cases
import pytest

import corpus_pipeline
from barloom.llm import near_copies
from barloom.llm.common import ready


def near_pairs():
    """Copies with 1 to 16 of 300 words changed, chains of them, and texts of a few words."""
    rng, out = random.Random(11), []
    for n in range(10):
        w = cases.words(rng, 300).split()
        for k in range(12):
            v = list(w)
            for at in rng.sample(range(300), rng.randrange(1, 17)):
                v[at] = f"new{rng.randrange(9)}"
            out.append((100 * n + k, " ".join(v)))
    return [*out, (5000, ""), (5001, ""), (5002, "a b"), (5003, "A b"), (5004, "a c")]


def odd_rows():
    """Every odd case, near copies of odd rows, and short texts."""
    rng = random.Random(12)
    out = cases.rows()
    for i, t in cases.rows()[:20]:
        out += [(i + 500, (t or "") + " more"), (None, (t or "") + " again")]
    for n in range(8, 40):
        w = cases.words(rng, n).split()
        out += [(2000 + n, " ".join(w)), (3000 + n, " ".join([*w, "end"])), (3000 + n, " ".join(["start", *w])), (None, " ".join(w).upper())]
    return out


def passage_rows():
    """Many unlike texts around one passage, and many copies with few and with many changes."""
    rng, out = random.Random(13), []
    passage, base = cases.words(rng, 60), cases.words(rng, 150).split()
    for k in range(120):
        out.append((k, f"{cases.words(rng, 20)} {passage} {cases.words(rng, 20)}"))
        v = list(base)
        for at in rng.sample(range(150), rng.randrange(0, 7)):
            v[at] = f"other{k}"
        out.append((1000 + k, " ".join(v)))
    return out


@pytest.mark.parametrize("pair_cell", [64, 3])
@pytest.mark.parametrize("pairs", [near_pairs(), odd_rows(), passage_rows()], ids=["copies", "odd", "passage"])
def test_stage_reaches_near_copies(spark, monkeypatch, pairs, pair_cell):
    monkeypatch.setattr(near_copies, "PAIR_CELL", pair_cell)
    docs = cases.frame(ready(spark), pairs)
    left = corpus_pipeline.simhash_stage(spark, docs, "")
    assert left.columns == docs.columns
    rows = left.collect()
    assert Counter(r.doc_id for r in rows) == cases.near_kept(pairs)
    assert all((r.doc_id, r.text) in pairs and r.rest == "rest!" for r in rows)


def test_bounds_lose_no_pair(spark):
    """Fingerprints of pairs just above the threshold stay within the radius."""
    rng, far = random.Random(14), []
    for _ in range(400):
        w = cases.words(rng, rng.randrange(12, 400)).split()
        n = len(w) - 4
        v = w[: len(w) - n // 10] + [f"new{k}" for k in range(n // 10)]
        a, b = (near_copies.shingle_hashes(near_copies.words_of(" ".join(x))) for x in (w, v))
        both = len(set(a.tolist()) & set(b.tolist()))
        if both >= 0.8 * (len(a) + len(b) - both):
            far.append((near_copies.bits_of(a) ^ near_copies.bits_of(b) & (1 << 64) - 1) % (1 << 64))
    assert len(far) > 300 and sum(x.bit_count() > near_copies.RADIUS for x in far) == 0
