"""Language identification of web pages by Bayesian fusion of text, markup, suffix and host."""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape
from urllib.parse import urlsplit

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import lean, whole_text
from barloom.llm.quality import map_texts
from barloom.session import store

#: Labelled documents of each language that the text model is fitted on, at most.
FIT_ROWS = 2000
#: Parts in which the rows of a language are ranked first.
PARTS = 64
#: Hash places of the byte trigrams, and trigrams that a text counts for at most (its mean
#: likelihood is scaled to them: trigrams of one text are not independent).
HASHED, HEAVIEST = 4096, 60
#: Pages that a level of the hierarchy weighs against the level above it.
WEIGHT = 5.0
#: The answer where no language is known.
UNKNOWN = "und"

_DROPPED = re.compile(r"<!--.*?-->|<(script|style|nav|footer)\b.*?</\1\s*>", re.S | re.I)
_TAG = re.compile(r"<[^>]*>")
_DECLARED = re.compile(r"<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", re.I)


def visible(html: str) -> str:
    return unescape(_TAG.sub(" ", _DROPPED.sub(" ", html)))


def declared_language(html: str) -> str:
    found = _DECLARED.search(html)
    return found[1].lower() if found else ""


def host_of(url: str) -> str:
    try:
        return (urlsplit(url.strip()).hostname or "").rstrip(".")
    except ValueError:
        return ""


def parent_of(host: str) -> str:
    """The host without its first label, if two or more are left."""
    return host.split(".", 1)[1] if host.count(".") >= 2 else host


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed byte trigrams of the lower-case text, each word between blanks."""
    data = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    codes = data[:-2] * np.uint32(65599**2 % 2**32) + data[1:-1] * np.uint32(65599) + data[2:] if len(data) > 2 else data[:0]
    return np.bincount((codes * np.uint32(2654435761) >> np.uint32(20)) % HASHED, minlength=HASHED)


@dataclass
class TextModel:
    languages: list[str]
    logs: np.ndarray  # log P(trigram | language): HASHED rows, a column per language

    def likelihoods(self, text: str) -> list[float]:
        """Log likelihood of the text in each language, relative to the best one."""
        counts = trigrams(text)
        n = int(counts.sum())
        if not n or not self.languages:
            return [0.0] * len(self.languages)
        logs = counts @ self.logs * (min(n, HEAVIEST) / n)
        return (logs - logs.max()).tolist()


def fit_text_model(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> TextModel:
    """Trigram model of each language, from (doc_id, text, lang) rows.

    Every language of the table is known to the model, however rare, unless none of its texts chosen
    holds a trigram. Of each at most `fit_rows` rows count, those with the smallest hash (Spark limits
    them per split before their shuffle); rows without a language are passed over. Counts are summed
    per language by Spark; languages times HASHED numbers come back.
    """
    texts = lean(labelled, "doc_id", "text", "lang").select(
        "doc_id", whole_text().alias("text"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang")
    )
    texts = texts.withColumn("sig", F.xxhash64("text")).where("lang is not null and lang != ''")
    order = [F.xxhash64("doc_id", "sig"), F.col("doc_id"), F.col("sig"), F.col("lang")]
    chosen = texts.select("doc_id", "sig", "lang", F.pmod(F.xxhash64("sig", "doc_id"), F.lit(PARTS)).alias("part"))
    for by in (["lang", "part"], ["lang"]):  # a language may hold most rows: first the least of its parts
        rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
        chosen = chosen.withColumn("rank", rank).where(F.col("rank") <= fit_rows).drop("rank")
    chosen = store(chosen.drop("part").distinct(), "language-sample")
    same = ["sig", "lang"]
    sample = texts.join(chosen.select(F.col("doc_id").alias("d"), *same), same).where(
        F.col("doc_id").eqNullSafe(F.col("d"))
    )

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            totals: dict[str, np.ndarray] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                totals[lang] = totals.get(lang, 0) + trigrams(text)
            for lang, total in totals.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_pydict(
                    {"lang": pa.array([lang] * len(at), pa.string()), "at": pa.array(at, pa.int32()), "n": pa.array(total[at], pa.int64())}
                )

    counted = sample.select("lang", "text").mapInArrow(count, "lang string, at int, n long")
    got = counted.groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    languages = sorted({r["lang"] for r in got})
    counts = np.zeros((HASHED, len(languages)))
    for r in got:
        counts[r["at"], languages.index(r["lang"])] = r["n"]
    return TextModel(languages, np.log((counts + 0.5) / (counts + 0.5).sum(0)))


def evidence(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, host, parent, suffix, declared, logs: what each page says, one pass over the pages.

    `declared` is a language of the model, `other` or empty; logs has a number per language.
    """
    fields = [T.StructField(n, T.StringType()) for n in ("host", "parent", "suffix", "declared")]
    fields.append(T.StructField("logs", T.ArrayType(T.DoubleType())))
    known = set(model.languages)

    def measure(joined: str) -> tuple:
        url, _, html = joined.partition("\n")
        host, said = host_of(url), declared_language(html)
        declared = said if said in known or not said else "other"
        return host, parent_of(host), host.rpartition(".")[2], declared, model.likelihoods(visible(html))

    url = F.regexp_replace(whole_text("url"), r"\s", "")
    rows = lean(pages, "page_id", "url", "html").select(
        "page_id", F.concat(url, F.lit("\n"), whole_text("html")).alias("text")
    )
    return map_texts(rows, ["page_id"], fields, measure)


def shares(logs: list[Column]) -> list[Column]:
    """Probabilities from log weights, one column per language."""
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    weights = [F.exp(x - top) for x in logs]
    return [w / sum(weights[1:], weights[0]) for w in weights]


def identify(pages: DataFrame, model: TextModel) -> DataFrame:
    """page_id, lang, confidence, text_lang, declared: a row per page.

    Fuses four kinds of evidence by Bayes' rule: the text's likelihood, P(declared | language),
    P(address suffix | language) and the host's prior. The tables are soft counts of the text's
    own verdicts, summed per group: a host's prior is smoothed by that of its parent domain, and
    that by the share over all pages. The page's own verdict is taken out of its host and parent.

    Groups are summed before the shuffle; host, parent and suffix meet in a table with one row
    per host, so that pages join once, in a join that Spark may split under a hot host. Null
    urls and pages count as empty; a page that says nothing gets its host's prior. Ties go to
    the first language by name. Without any language all pages are `und`, with confidence 0.
    """
    names = model.languages
    if not names:
        return lean(pages, "page_id").select(
            "page_id", F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"),
            F.lit(UNKNOWN).alias("text_lang"), F.lit("").alias("declared"),
        )
    k = range(len(names))
    rows = store(evidence(pages, model), "language-evidence")
    own = [f"own{i}" for i in k]
    rows = rows.select("*", *[p.alias(c) for p, c in zip(shares([F.col("logs")[i] for i in k]), own, strict=True)])

    def sums(*by: str, name: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(own[i]).alias(f"{name}{i}") for i in k], F.count("*").alias(f"{name}_n"))

    hosts = sums("host", "parent", "suffix", name="host")
    parents = hosts.groupBy("parent").agg(
        *[F.sum(f"host{i}").alias(f"parent{i}") for i in k], F.sum("host_n").alias("parent_n")
    )
    suffixes = hosts.groupBy("suffix").agg(
        *[F.sum(f"host{i}").alias(f"suffix{i}") for i in k], F.sum("host_n").alias("suffix_n")
    )
    by_word = sums("declared", name="said").collect()  # a row per language and two more
    total = [sum(r[f"said{i}"] for r in by_word) for i in k]
    n = sum(total) or 1.0
    overall = [(t + 1) / (n + len(names)) for t in total]

    words = sorted({*names, "", "other"})
    said = [dict.fromkeys(words, 0.0) | {r["declared"]: r[f"said{i}"] for r in by_word} for i in k]
    table = {w: sum(s[w] for s in said) / n for w in words}
    markup = sum(v for w, v in table.items() if w in names)

    def expected(word: str, i: int) -> float:
        """Of pages in language i: before counting, most markup is taken to be right."""
        return markup * (0.9 * (word == names[i]) + 0.1 / len(names)) if word in names else table[word]

    def log_share(word: str, i: int) -> float:
        return float(np.log((said[i][word] + WEIGHT * expected(word, i) + 1e-9) / (total[i] + WEIGHT)))

    declared = [F.create_map(*[F.lit(x) for w in words for x in (w, log_share(w, i))]) for i in k]
    all_hosts = hosts.join(store(parents, "language-parents"), "parent").join(store(suffixes, "language-suffixes"), "suffix")
    all_hosts = store(all_hosts, "language-hosts")

    met = rows.drop("parent", "suffix").join(all_hosts, "host")
    fused = []
    for i in k:
        mine = F.col(own[i])
        above = (F.col(f"parent{i}") - mine + WEIGHT * overall[i]) / (F.col("parent_n") - 1 + WEIGHT)
        prior = (F.col(f"host{i}") - mine + WEIGHT * above) / (F.col("host_n") - 1 + WEIGHT)
        suffix = (F.col(f"suffix{i}") + WEIGHT * F.col("suffix_n") / n) / (total[i] + WEIGHT)
        fused.append(F.col("logs")[i] + F.log(F.greatest(prior, F.lit(1e-9))) + declared[i][F.col("declared")] + F.log(suffix))
    best = [p.alias(f"p{i}") for i, p in enumerate(shares(fused))]
    met = met.select("page_id", "declared", "logs", *best)

    def winner(columns: list[Column]) -> Column:
        top = F.greatest(*columns) if len(columns) > 1 else columns[0]
        return F.coalesce(*[F.when(c == top, F.lit(x)) for c, x in zip(columns, names, strict=True)])

    chance = [F.col(f"p{i}") for i in k]
    return met.select(
        "page_id", winner(chance).alias("lang"), (F.greatest(*chance) if len(names) > 1 else chance[0]).alias("confidence"),
        winner([F.col("logs")[i] for i in k]).alias("text_lang"), "declared",
    )
