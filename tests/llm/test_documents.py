"""The operators on whole documents against brute force, over every odd case."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from barloom.llm import decontaminate, exact_dedup, line_dedup, near_copies, secrets, simhash
from barloom.llm.common import read, ready, unpacked
import cases


@pytest.fixture(scope="module")
def docs(spark):
    ready(spark)
    return cases.frame(spark, cases.rows()).persist()


def got(df, *names):
    return Counter(tuple(r) for r in df.select(*names or df.columns).collect())


def test_exact_dedup(docs):
    found = exact_dedup.exact_dedup(docs)
    assert got(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == cases.exact_groups(cases.rows())


def test_exact_dedup_with_colliding_hashes(docs):
    found = exact_dedup.exact_dedup(docs, lambda text: F.substring(F.md5(text), 1, 1))
    assert got(found, "doc_id", "keep_id", "group_size", "kept", "text_sha256") == cases.exact_groups(cases.rows())


def test_line_dedup(spark, docs):
    texts = [t or "" for _, t in cases.rows()]
    hashed = spark.createDataFrame([(t,) for t in set(texts)], "t string").select("t", F.xxhash64("t").alias("h"))
    sig = {r.t: r.h for r in hashed.collect()}
    want = cases.line_dedup(cases.rows(), lambda p: (cases.least(p[0]), sig[p[1] or ""]))
    found = line_dedup.line_dedup(docs).persist()
    assert got(found, "doc_id", "text", "n_lines", "n_removed") == Counter(want)

    back = unpacked(line_dedup.without_emptied(found), docs.columns)
    assert back.columns == docs.columns
    left = [(i, t) for i, t, n, gone in want if gone < n or not n]
    assert got(back, "doc_id", "text", "n_chars", "sig", "rest") == Counter(
        (i, t, None if t is None else len(t), "sig!", "rest!") for i, t in left
    )
    before = {x.strip(" \t\r") for t in texts for x in t.split("\n")}
    after = {x.strip(" \t\r") for _, t in left for x in (t or "").split("\n")}
    assert before - {""} == after - {""}  # no line is lost


ITEMS = [
    (1, "the of and stone river lamp water green seven window paper quiet north"),
    (2, "lamp, water; green"), (3, None), (4, "!!"), (5, "quiet QUIET quiet quiet quiet quiet quiet quiet quiet quiet quiet quiet"),
    (10, "the of and stone river lamp water green seven window paper quiet north"), (None, "north paper seven"),
    (2, "lamp, water; green"), (7, "Éa ß9 日本"),
]


def leaky():
    rng, out = random.Random(3), cases.rows()
    whole = cases.WORD.findall(ITEMS[0][1])
    for i in range(200, 260):
        cut, n = rng.randrange(4), rng.randrange(8, 14)
        out.append((i, f"{cases.words(rng, rng.randrange(9))}. {', '.join(whole[cut : cut + n]).title()} {cases.words(rng, 5)}"))
    out += [(300, "quiet " * 2000), (301, "Lamp water green " * 3), (302, "north paper seven"), (303, "éa ß9 日本"), (304, "Éa ß9 日本")]
    return out


@pytest.mark.parametrize("most_marks", [decontaminate.MOST_MARKS, -1])
def test_decontaminate(spark, most_marks):
    pairs = leaky()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("words", F.lit("clash"))
    found = decontaminate.contamination(cases.frame(spark, pairs), benchmark, most_marks)
    want = {}
    for i, t in pairs:
        _, hit, items = cases.hits(t, ITEMS)
        if hit:
            want[i] = (len(hit), sorted(str(x) for x in items if x is not None))
    assert {r.doc_id: (r.n_hit, r["items"]) for r in found.collect()} == want
    assert any(len(w[1]) > 1 for w in want.values()) and any(not w[1] for w in want.values())


def test_decontamination_report_and_stage(spark):
    pairs = leaky()
    benchmark = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = cases.frame(spark, pairs)
    want, clean = Counter(), Counter()
    for i, t in pairs:
        n, hit, items = cases.hits(t, ITEMS)
        ids = sorted(str(x) for x in items if x is not None)
        want[(i, n, len(hit), len(ids), cases.sha(",".join(ids)), bool(hit))] += 1
        if not hit:
            clean[(i, t)] += 1
    assert got(decontaminate.report(docs, benchmark)) == want
    left = decontaminate.decontaminate(docs, benchmark)
    assert left.columns == docs.columns and got(left, "doc_id", "text") == clean


def near_rows():
    rng = random.Random(5)
    out = cases.rows()
    long = [cases.words(rng, 400) for _ in range(4)]
    for n, t in enumerate(long):
        w = t.split()
        for k in range(12):
            v = list(w)
            v[rng.randrange(len(w))] = f"changed{k}"
            out.append((1000 + 20 * n + k, " ".join(v)))
    return out


def test_fingerprints_are_the_contracts():
    for _, t in near_rows():
        assert simhash.fingerprint(t or "") == cases.simhash(t)


def test_simhash_components(spark):
    pairs = near_rows()
    found = simhash.simhash_components(cases.frame(spark, pairs))
    prints = [(i, simhash.fingerprint(t or "")) for i, t in pairs]
    want = Counter((i, f"{p:016x}", c) for i, p, c in cases.components(prints))
    assert got(found) == want
    assert len({c for _, _, c in want}) < len({p for _, p in prints})  # some differ and are linked


@pytest.mark.parametrize("pair_cell", [64, 2])
def test_links_of_dense_fingerprints(spark, monkeypatch, pair_cell):
    """A group of many fingerprints within a few bits, in pairs and through midpoints."""
    monkeypatch.setattr(simhash, "PAIR_CELL", pair_cell)
    rng = random.Random(1)
    prints = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(150):
        p = rng.choice(prints)
        for _ in range(rng.randrange(1, 4)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    pairs = list(enumerate(prints))
    signed = [(i, p - (p >> 63 << 64)) for i, p in pairs]
    found = simhash.grouped(spark.createDataFrame(signed, "doc_id long, fp long"))
    by_print = {r.fp: r.component_id for r in found.collect()}
    assert [by_print[s] for _, s in signed] == [c for _, _, c in cases.components(pairs)]


def test_empty_tables(spark):
    none = cases.frame(spark, [])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert exact_dedup.exact_dedup(none).count() == 0
    assert line_dedup.line_dedup(none).count() == 0
    assert simhash.simhash_components(none).count() == 0
    assert near_copies.near_keep(none).count() == 0
    assert decontaminate.report(none, benchmark).count() == 0
    assert secrets.find_secrets(none).count() == 0
    some = cases.frame(spark, cases.rows())
    assert decontaminate.report(some, benchmark).where("contaminated").count() == 0


def test_read_takes_a_folder(spark):
    assert read(spark, "/root/testdata/sf0.001/", "benchmark").count() > 0
