"""Quality classifier: weak labels, their accuracies by EM, and a hashed linear scorer."""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import lean, signed, whole_text
from barloom.session import store

#: Documents that the scorer is fitted on, at most; half of either weak label. EM sees them all.
FIT_ROWS = 4096
#: Width of the hashed features.
HASHED = 512
#: Documents that score less are rejected.
LEAST_SCORE = 0.5

LOWER, UPPER, DIGIT, BLANK, BREAK, STOP, BAR, MARK, HIGH = range(9)
KINDS = 9


def _byte_kinds() -> np.ndarray:
    kinds = np.full(256, MARK, np.int16)
    for first, last, kind in (("a", "z", LOWER), ("A", "Z", UPPER), ("0", "9", DIGIT)):
        kinds[ord(first) : ord(last) + 1] = kind
    kinds[[9, 13, 32]], kinds[10], kinds[[44, 46]], kinds[124], kinds[128:] = BLANK, BREAK, STOP, BAR, HIGH
    return kinds


BYTE_KINDS = _byte_kinds()


@dataclass
class Traits:
    """What the labellers and the scorer look at in one text."""

    words: int
    symbols: float  # marks and bars per byte
    doubled: float  # neighbouring marks per word
    capitals: float  # capitals per letter
    shouting: float  # neighbouring capitals per byte
    bars: float  # bars per word
    vocabulary: float  # distinct words per word
    stutter: float  # words equal to the one before
    favourite: float  # share of the most frequent word
    length: float  # characters per word
    stops: float  # full stops and commas per word
    shapes: np.ndarray  # counts of byte-kind trigrams


def traits(text: str) -> Traits:
    kinds = BYTE_KINDS[np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)]
    n = max(len(kinds), 1)
    count = np.bincount(kinds, minlength=KINDS)
    words = text.split()
    many = max(len(words), 1)
    distinct: dict[str, int] = {}
    for w in words:
        distinct[w] = distinct.get(w, 0) + 1
    marks, capitals = kinds == MARK, kinds == UPPER
    shapes = kinds[:-2] * 81 + kinds[1:-1] * 9 + kinds[2:] if len(kinds) > 2 else np.zeros(0, np.int16)
    return Traits(
        words=len(words),
        symbols=(count[MARK] + count[BAR]) / n,
        doubled=int((marks[1:] & marks[:-1]).sum()) / many,
        capitals=count[UPPER] / max(count[UPPER] + count[LOWER] + count[HIGH] / 2, 1),
        shouting=int((capitals[1:] & capitals[:-1]).sum()) / n,
        bars=count[BAR] / many,
        vocabulary=len(distinct) / many,
        stutter=sum(map(eq, words, words[1:])) / many,
        favourite=max(distinct.values(), default=0) / many,
        length=sum(map(len, words)) / many,
        stops=count[STOP] / many,
        shapes=np.bincount(shapes, minlength=KINDS**3),
    )


def _vote(value: float, good: bool, bad: bool, says: bool = True) -> int:
    return 0 if not says or value != value else 1 if good else -1 if bad else 0


#: The heuristic labellers: 1 good, -1 bad, 0 abstains. They overlap on purpose.
LABELLERS = {
    "symbols": lambda t: _vote(t.symbols, t.symbols < 0.01, t.symbols > 0.04),
    "doubled": lambda t: _vote(t.doubled, t.doubled < 0.02, t.doubled > 0.1),
    "capitals": lambda t: _vote(t.capitals, t.capitals < 0.1, t.capitals > 0.3, t.words >= 5),
    "shouting": lambda t: _vote(t.shouting, t.shouting < 0.05, t.shouting > 0.2, t.words >= 5),
    "bars": lambda t: _vote(t.bars, t.bars < 0.01, t.bars > 0.1),
    "vocabulary": lambda t: _vote(t.vocabulary, t.vocabulary > 0.5, t.vocabulary < 0.3, t.words >= 20),
    "stutter": lambda t: _vote(t.stutter, t.stutter < 0.05, t.stutter > 0.2, t.words >= 8),
    "favourite": lambda t: _vote(t.favourite, t.favourite < 0.12, t.favourite > 0.25, t.words >= 20),
    "length": lambda t: _vote(t.length, 3.5 < t.length < 7, t.length > 9 or t.length < 3, t.words >= 20),
    "stops": lambda t: _vote(t.stops, 0.02 < t.stops < 0.5, t.stops < 0.005 or t.stops > 0.9, t.words >= 20),
}


def pattern(t: Traits) -> int:
    """The votes as one number in base 3; there are 3 ** len(LABELLERS) of them."""
    code = 0
    for labeller in LABELLERS.values():
        code = code * 3 + labeller(t) + 1
    return code


def votes_of(codes: np.ndarray) -> np.ndarray:
    """Patterns to a matrix of votes plus one."""
    n = len(LABELLERS)
    return codes[:, None] // 3 ** np.arange(n - 1, -1, -1)[None, :] % 3


def hashed(t: Traits) -> np.ndarray:
    """Features of a text: shape trigrams and levels of its traits, hashed to HASHED places."""
    out = np.zeros(HASHED, np.float32)
    np.add.at(out, SHAPE_PLACES, np.sqrt(t.shapes / max(t.shapes.sum(), 1)).astype(np.float32))
    for name in LEVELS:
        value = getattr(t, name)
        level = int(np.clip(np.log2(value + 2**-10) + 10, 0, 15)) if value > 0 else -1
        out[place(f"{name}={level}")] += 1
    return out


def place(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode()) % HASHED


LEVELS = ("symbols", "doubled", "capitals", "shouting", "bars", "vocabulary", "stutter", "favourite", "length", "stops")
SHAPE_PLACES = np.array([place(f"shape {i}") for i in range(KINDS**3)])


def fit_accuracies(codes: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """EM over vote patterns: posterior of good per pattern, P(good vote | class), P(good).

    Labellers are taken to be independent given the class; each has its own accuracy on good
    and on bad texts. An abstention says nothing, so a text without votes keeps the prior. The
    start says that labellers rarely object to good texts and that each objects to some bad ones.
    """
    votes = votes_of(codes)
    n = votes.shape[1]
    cast, approve = votes != 1, votes == 2
    chance = np.stack([np.full(n, 0.65), np.full(n, 0.98)])  # of a good vote, for bad and good texts
    prior = 0.8
    for _ in range(rounds):
        logs = np.log(np.where(approve, chance[:, None, :], 1 - chance[:, None, :]))
        logs = (logs * cast).sum(2)
        odds = np.clip(np.log(prior / (1 - prior)) + logs[1] - logs[0], -500, 500)
        good = 1 / (1 + np.exp(-odds))
        weights = np.stack([counts * (1 - good), counts * good])
        prior = float(np.clip(weights[1].sum() / max(weights.sum(), 1), 0.01, 0.99))
        chance = (weights @ approve + 0.5) / (weights @ cast + 1)
    return good, chance, prior


def fit_scorer(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 8) -> np.ndarray:
    """Logistic regression on soft labels by Newton's method with a ridge; the last is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float64)
    w, weight = np.zeros(x.shape[1]), weight / weight.sum()
    ridge = np.full(x.shape[1], 1e-4)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + ridge * w
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class Model:
    codes: np.ndarray  # the vote patterns seen, sorted
    posterior: np.ndarray  # P(good) of each
    approve: np.ndarray  # P(good vote | class) by class (bad, good) and labeller
    weights: np.ndarray  # of the hashed features, bias last

    def score(self, t: Traits) -> float:
        odds = float(hashed(t) @ self.weights[:-1] + self.weights[-1])
        return float(1 / (1 + np.exp(-np.clip(odds, -30, 30))))


def map_texts(docs: DataFrame, keys: list[str], fields: list[T.StructField], measure) -> DataFrame:
    """The key columns and what `measure` returns for each text, a tuple by the fields."""

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        kinds = [to_arrow_type(f.dataType) for f in fields]
        for batch in batches:
            rows = [measure(text) for text in batch.column("text").to_pylist()]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in keys], *columns], [*keys, *[f.name for f in fields]]
            )

    schema = T.StructType([*[docs.schema[k] for k in keys], *fields])
    return docs.select(*keys, "text").mapInArrow(run, schema)


def fit(docs: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Fit the labellers' accuracies on all documents and the scorer on at most `fit_rows`.

    EM needs only how often each vote pattern occurs, which Spark counts over the whole corpus;
    there are at most 3 ** 10 patterns. The scorer learns from the posterior labels: of either
    side (good, bad) the fit_rows / 2 documents with the smallest hash, weighted by how many
    they stand for. Only their hashed features reach the driver, HASHED numbers each.
    An empty table gives a model that keeps everything.
    """
    rows = signed(docs)
    field = T.StructField("pattern", T.IntegerType())
    voted = store(map_texts(rows, ["doc_id", "sig"], [field], lambda text: (pattern(traits(text)),)), "quality-votes")
    seen = voted.groupBy("pattern").count().orderBy("pattern").collect()  # at most 3 ** 10 rows
    codes, counts = np.array([r["pattern"] for r in seen], int), np.array([r["count"] for r in seen], float)
    if not seen:
        return Model(codes, counts, np.ones((2, len(LABELLERS))), np.zeros(HASHED + 1))
    posterior, approve, _ = fit_accuracies(codes, counts)

    sides = docs.sparkSession.createDataFrame(
        [(int(c), float(p)) for c, p in zip(codes, posterior, strict=True)], "pattern int, label double"
    )
    labelled = voted.join(store(sides, "quality-sides"), "pattern")
    order = [F.xxhash64("doc_id", "sig"), F.col("doc_id"), F.col("sig")]
    some = None
    for good in (True, False):
        side = labelled.where((F.col("label") >= 0.5) == good).orderBy(*order).limit(fit_rows // 2)
        some = side if some is None else some.unionByName(side)
    some = store(some.select(F.col("doc_id").alias("d"), F.col("sig").alias("s"), "label"), "quality-sample")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("sig") == F.col("s"))
    sample = rows.join(some.dropDuplicates(["d", "s"]), same).select("doc_id", "sig", "label", "text")
    field = T.StructField("x", T.BinaryType())
    found = map_texts(sample, ["doc_id", "sig", "label"], [field], lambda text: (hashed(traits(text)).tobytes(),))
    got = found.dropDuplicates(["doc_id", "sig"]).orderBy(*order).collect()
    x = np.array([np.frombuffer(r["x"], np.float32) for r in got])
    y = np.array([r["label"] for r in got])
    good = y >= 0.5
    total = np.array([counts[posterior < 0.5].sum(), counts[posterior >= 0.5].sum()])
    share = total / np.maximum([(~good).sum(), good.sum()], 1)
    return Model(codes, posterior, approve, fit_scorer(x, y, share[good.astype(int)]))


def classify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, votes_good, votes_bad, posterior (of the weak labels), score, kept: a row per document.

    Null text counts as empty. A text without any vote has the posterior of its pattern, which
    is the prior. Rows are independent, so repeated or null ids get a row each.
    """
    fields = [
        T.StructField("votes_good", T.IntegerType()), T.StructField("votes_bad", T.IntegerType()),
        T.StructField("posterior", T.DoubleType()), T.StructField("score", T.DoubleType()),
        T.StructField("kept", T.BooleanType()),
    ]

    def measure(text: str) -> tuple:
        t = traits(text)
        code = pattern(t)
        votes = votes_of(np.array([code]))[0]
        at = int(np.searchsorted(model.codes, code))
        known = at < len(model.codes) and model.codes[at] == code
        score = model.score(t)
        posterior = float(model.posterior[at]) if known else None
        return int((votes == 2).sum()), int((votes == 0).sum()), posterior, score, score >= LEAST_SCORE

    return map_texts(lean(docs).select("doc_id", whole_text().alias("text")), ["doc_id"], fields, measure)


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the scorer keeps, all columns, in one pass without a shuffle."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([model.score(traits(t or "")) >= LEAST_SCORE for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
