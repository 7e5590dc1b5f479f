from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from frames import T0
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.sql import functions as F

from barloom.operators import newton, validation

COLS = ["a", "b", "c"]
HOUR = dt.timedelta(hours=1)


def table(spark, n=400, label=None):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(n, 3)) * [1.0, 50.0, 0.01] + [5.0, 1000.0, 0.0]
    y = rng.random(n) < 1 / (1 + np.exp(-((x[:, 0] - 5) + (x[:, 1] - 1000) / 100)))
    rows = [
        (T0 + i * HOUR, T0 + (i + 1) * HOUR, float(y[i]) if label is None else label, *map(float, x[i])) for i in range(n)
    ]
    return spark.createDataFrame(rows, "bar_ts timestamp_ntz, label_end timestamp_ntz, label double, a double, b double, c double")


def folds_of(n=400, k=3):
    return validation.equal_folds(T0, T0 + n * HOUR, k)


def test_weights_equal_mllib(spark):
    df, folds = table(spark), folds_of()
    got = newton.fit_folds(df, folds, 2 * HOUR, COLS, reg=0.05)
    assert sorted(got) == [1, 2, 3]
    scored = newton.score_folds(df, folds, got, COLS)
    assert scored.count() == 300
    for k, start, end in folds:
        train = VectorAssembler(inputCols=COLS, outputCol="raw").transform(
            df.filter(F.col("label_end") < F.lit(start - 2 * HOUR).cast("timestamp_ntz"))
        )
        scaler = StandardScaler(inputCol="raw", outputCol="x", withMean=True).fit(train)
        model = LogisticRegression(featuresCol="x", regParam=0.05, maxIter=500, tol=1e-13).fit(scaler.transform(train))
        raw = model.coefficients.toArray() / scaler.std.toArray()
        want = [model.intercept - raw @ scaler.mean.toArray(), *raw]
        assert got[k] == pytest.approx(want, rel=1e-6, abs=1e-6)
        row = scored.filter(F.col("fold") == k).first()
        odds = got[k][0] + sum(w * row[c] for w, c in zip(got[k][1:], COLS))
        assert row.p_bull == pytest.approx(1 / (1 + math.exp(-odds)))


def test_a_job_count_without_the_folds(spark, monkeypatch):
    """Twice the folds take about the steps of the slowest of them, not twice the passes."""
    passes = []
    sums = newton._sums
    monkeypatch.setattr(newton, "_sums", lambda *a: passes.append(len(a[1])) or sums(*a))
    newton.fit_folds(table(spark), folds_of(400, 6), HOUR, COLS)
    assert passes[0] == 6 and len(passes) <= 10


def test_odd_folds(spark):
    df = table(spark).unionByName(
        spark.createDataFrame(
            [(T0, T0 + HOUR, 1.0, None, 1.0, 1.0), (T0, T0 + HOUR, None, 1.0, 1.0, 1.0), (None, None, 1.0, 1.0, 1.0, 1.0),
             (T0, T0 + HOUR, 0.0, math.nan, 1.0, 1.0), (T0, T0 + HOUR, 0.0, 1.0, math.inf, 1.0)],
            table(spark, 1).schema,
        )
    )
    folds = folds_of()
    whole = newton.fit_folds(table(spark), folds, HOUR, COLS)
    odd = newton.fit_folds(df, folds, HOUR, COLS)
    assert all(odd[k] == pytest.approx(whole[k], rel=1e-8) for k in whole)  # unsound rows do not train
    early = [(9, T0 - 5 * HOUR, T0 + HOUR)]
    assert newton.fit_folds(df, early, HOUR, COLS) == {}
    assert all(r.p_bull is None for r in newton.score_folds(df, early, {}, COLS).collect())
    alike = newton.fit_folds(table(spark, label=1.0), folds, HOUR, COLS)
    assert all(w[0] == math.inf and w[1:] == [0, 0, 0] for w in alike.values())
    assert all(r.p_bull == 1 for r in newton.score_folds(table(spark), folds, alike, COLS).collect())
    fixed = newton.fit_folds(table(spark).withColumn("c", F.lit(7.0)), folds, HOUR, COLS)
    assert all(w[3] == 0 and math.isfinite(w[0]) for w in fixed.values())
    assert newton.fit_folds(df.limit(0), folds, HOUR, COLS) == {}
