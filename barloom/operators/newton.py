"""Direction models of all folds at once: Newton steps whose sums over the rows are one Spark job a step."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence
from datetime import timedelta

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators.validation import Fold
from barloom.session import store

#: Intercept and a weight per input, for inputs as they are.
Weights = Mapping[int, list[float]]


def _sound(cols: Sequence[str]) -> Column:
    """All columns are there and finite numbers."""
    ok = F.lit(True)
    for c in cols:
        ok = ok & F.col(c).isNotNull() & (F.abs(F.col(c).cast("double")) < math.inf)
    return F.coalesce(ok, F.lit(False))


def _trained(df: DataFrame, folds: Sequence[Fold], embargo: timedelta, cols: Sequence[str], label: str, label_end: str) -> DataFrame:
    """Inputs, label and a flag `_f<k>` per fold that the row trains; rows that train none are left out."""
    flags = {
        f"_f{k}": F.coalesce(F.col(label_end) < F.lit(start - embargo).cast("timestamp_ntz"), F.lit(False))
        for k, start, _ in folds
    }
    values = [F.col(c).cast("double").alias(c) for c in (*cols, label)]
    rows = df.filter(_sound([*cols, label])).select(*values, *[v.alias(n) for n, v in flags.items()])
    return rows.filter(F.greatest(F.lit(False), *flags))


def _scales(rows: DataFrame, names: Sequence[int], cols: Sequence[str], label: str) -> dict[int, dict]:
    """Rows, rising share, and mean and deviation of each input, per fold, in one aggregation."""
    of = {k: (lambda c, k=k: F.when(F.col(f"_f{k}"), F.col(c))) for k in names}
    found = rows.agg(
        *[F.count_if(F.col(f"_f{k}")).alias(f"n{k}") for k in names],
        *[F.avg(of[k](label)).alias(f"y{k}") for k in names],
        *[F.avg(of[k](c)).alias(f"m{k}_{i}") for k in names for i, c in enumerate(cols)],
        *[F.stddev_samp(of[k](c)).alias(f"s{k}_{i}") for k in names for i, c in enumerate(cols)],
    ).first()
    out = {}
    for k in names:
        if found[f"n{k}"]:
            mean, std = (np.array([found[f"{p}{k}_{i}"] or 0.0 for i in range(len(cols))]) for p in "ms")
            # An input that never changes weighs nothing.
            scale = np.divide(1.0, std, out=np.zeros(len(cols)), where=std > 0)
            out[k] = {"n": found[f"n{k}"], "rising": found[f"y{k}"], "mean": mean, "scale": scale}
    return out


def _sums(rows: DataFrame, at: dict[int, np.ndarray], scales: dict[int, dict], cols: Sequence[str], label: str) -> dict[int, tuple]:
    """Loss, gradient and Gram matrix of every fold at its weights, in one pass.

    A task adds up its rows by fold and emits a row per fold and pair of inputs; these meet by
    (fold, pair). Rows are not copied for the folds that they train.
    """
    width, wanted = len(cols) + 1, list(cols)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = {k: np.zeros((width, width + 2)) for k in at}
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in wanted])
            y = batch.column(label).to_numpy(zero_copy_only=False)
            for k, weights in at.items():
                mine = batch.column(f"_f{k}").to_numpy(zero_copy_only=False).astype(bool)
                z = np.column_stack([np.ones(int(mine.sum())), (x[mine] - scales[k]["mean"]) * scales[k]["scale"]])
                odds = z @ weights
                p = 0.5 * (1 + np.tanh(odds / 2))
                total[k][:, :width] += z.T @ (z * (p * (1 - p))[:, None])
                total[k][:, width] += z.T @ (p - y[mine])
                total[k][0, width + 1] += float((np.logaddexp(0, odds) - y[mine] * odds).sum())
        found = [(k, i, j, float(v)) for k, sums in total.items() for (i, j), v in np.ndenumerate(sums)]
        columns = list(zip(*found, strict=True)) or [()] * 4
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.float64())
        arrays = [pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["fold", "i", "j", "value"])

    parts = rows.mapInArrow(run, "fold int, i int, j int, value double")
    matrices = {k: np.zeros((width, width + 2)) for k in at}
    for r in parts.groupBy("fold", "i", "j").agg(F.sum("value").alias("value")).collect():
        matrices[r.fold][r.i, r.j] = r.value
    return {k: (m[0, width + 1], m[:, width], m[:, :width]) for k, m in matrices.items()}


def fit_folds(
    df: DataFrame,
    folds: Sequence[Fold],
    embargo: timedelta,
    cols: Sequence[str],
    reg: float = 0.01,
    rounds: int = 50,
    tolerance: float = 1e-10,
    label: str = "label",
    label_end: str = "label_end",
) -> dict[int, list[float]]:
    """Logistic regressions of all folds: fold -> intercept and a weight per input.

    A row trains a fold if its label ends before the test period less the embargo. Inputs are
    standardised within the fold and their weights, not the intercept, carry the penalty `reg`, as
    `fit_direction` does. A step costs one job, whatever the number of folds; the driver solves a
    system of len(cols) + 1 unknowns per fold. A step that raises a fold's loss is halved. Rows with an
    unknown or infinite input or label do not train. A fold without training rows has no entry; one
    whose labels are all alike has an infinite intercept.
    """
    names = [k for k, _, _ in folds]
    rows = store(_trained(df, folds, embargo, cols, label, label_end), "fold-rows")
    scales = _scales(rows, names, cols, label)
    width = len(cols) + 1
    penalty = np.r_[0.0, np.full(width - 1, float(reg))]
    at, done = {}, {}
    for k, scale in scales.items():
        if scale["rising"] in (0.0, 1.0):
            done[k] = np.r_[math.inf if scale["rising"] else -math.inf, np.zeros(width - 1)]
        else:
            at[k] = np.r_[math.log(scale["rising"] / (1 - scale["rising"])), np.zeros(width - 1)]
    best: dict[int, tuple[float, np.ndarray]] = {}
    for _ in range(rounds):
        if not at:
            break
        for k, (loss, gradient, gram) in _sums(rows, at, scales, cols, label).items():
            weights, n = at[k], scales[k]["n"]
            loss = loss / n + float(penalty @ weights**2) / 2
            if k in best and loss > best[k][0] + 1e-12:
                at[k] = (weights + best[k][1]) / 2
            else:
                best[k] = loss, weights
                step = np.linalg.lstsq(gram / n + np.diag(penalty), gradient / n + penalty * weights, rcond=None)[0]
                at[k] = weights - step
            if np.abs(at[k] - weights).max() <= tolerance * (1 + np.abs(weights).max()):
                done[k] = at.pop(k)
    done |= at
    out = {}
    for k, weights in sorted(done.items()):
        raw = weights[1:] * scales[k]["scale"]
        out[k] = [float(weights[0] - raw @ scales[k]["mean"]), *map(float, raw)]
    return out


def score_folds(df: DataFrame, folds: Sequence[Fold], weights: Weights, cols: Sequence[str]) -> DataFrame:
    """The rows of the test periods with `fold` and `p_bull`, in one pass.

    Test periods do not overlap. NULL where an input is unknown or the fold has no weights.
    """
    fold, p = F.lit(None).cast("int"), F.lit(None).cast("double")
    known = F.lit(True)
    for c in cols:
        known = known & F.col(c).isNotNull()
    for k, start, end in folds:
        lo, hi = (F.lit(t).cast("timestamp_ntz") for t in (start, end))
        inside = (F.col("bar_ts") >= lo) & (F.col("bar_ts") < hi)
        fold = F.when(inside, F.lit(k)).otherwise(fold)
        if k in weights:
            odds = sum((F.lit(w) * F.col(c) for w, c in zip(weights[k][1:], cols, strict=True)), F.lit(weights[k][0]))
            p = F.when(inside & known, 1 / (1 + F.exp(-odds))).otherwise(p)
    return df.withColumns({"fold": fold, "p_bull": p}).filter(F.col("fold").isNotNull())


def weights_table(df: DataFrame, weights: Weights, cols: Sequence[str]) -> DataFrame:
    """One row per fold: fold, intercept and a column per input."""
    schema = T.StructType(
        [T.StructField("fold", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("intercept", *cols)]]
    )
    return df.sparkSession.createDataFrame([(k, *w) for k, w in weights.items()], schema)
