"""Direction models trained and applied as Spark jobs."""

from __future__ import annotations

import hashlib
import json
import sys
import types
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.operators import features as ft
from barloom.operators.tiles import SERIES

INPUTS = (
    "body_ratio", "upper_wick", "lower_wick", "range_to_atr", "natr", "vol_expansion",
    "ema_z", "rsi", "macd", "bb_width",
)

#: A model file travels to every worker; larger ones are refused.
MODEL_BYTES = 256 << 20


def next_bar() -> ft.Feature:
    """The next bar's time and direction as `label_end` and `label`; NULL for the newest bar."""
    stage = ft.Stage(
        {
            "label_end": lambda w: F.lead("bar_ts").over(w),
            "label": lambda w: (F.lead("close").over(w) > F.col("close")).cast("double"),
        }
    )
    return ft.Feature(("label_end", "label"), 0, (stage,), after=1)


def _features(bars: DataFrame, *more: ft.Feature) -> DataFrame:
    return ft.compute(
        bars, ft.body_ratio(), ft.wick_ratios(), ft.range_to_atr(), ft.natr(), ft.vol_expansion(),
        ft.ema_z(), ft.rsi(), ft.macd_ratio(), ft.bb_width(), *more,
    )


def training_table(bars: DataFrame) -> DataFrame:
    """Features, next direction as `label` and the time at which it is known, per bar.

    Rows with an undefined feature are left out, and so is the newest bar of each series,
    whose label is not known yet. For scoring use `scoring_table`.
    """
    made = _features(bars, next_bar())
    return made.select(*SERIES, "bar_ts", "label_end", "label", *INPUTS).dropna()


def scoring_table(bars: DataFrame) -> DataFrame:
    """The features of every bar that has them all, the newest bar included."""
    return _features(bars).select(*SERIES, "bar_ts", *INPUTS).dropna()


def fit_direction(train: DataFrame, cols: Sequence[str] = INPUTS, reg: float = 0.01) -> PipelineModel:
    """Logistic regression for the chance of a rising bar."""
    steps = [
        VectorAssembler(inputCols=list(cols), outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
        LogisticRegression(featuresCol="_x", labelCol="label", regParam=reg, maxIter=50),
    ]
    return Pipeline(stages=steps).fit(train)


def fit_gbt(
    train: DataFrame, valid_from: Column, cols: Sequence[str] = INPUTS, rounds: int = 10
) -> PipelineModel:
    """Boosted trees that stop once the later rows, held out by time, gain no more."""
    marked = train.withColumn("_valid", F.col("bar_ts") >= valid_from)
    trees = GBTClassifier(
        featuresCol="_x",
        labelCol="label",
        maxIter=rounds,
        maxDepth=3,
        validationIndicatorCol="_valid",
        validationTol=0.001,
        checkpointInterval=5,
        cacheNodeIds=True,
        seed=1,
    )
    assembler = VectorAssembler(inputCols=list(cols), outputCol="_x")
    return Pipeline(stages=[assembler, trees]).fit(marked)


def apply_direction(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Add `p_bull` and the confidence in the likelier direction."""
    p = vector_to_array("probability").getItem(1)
    scored = model.transform(df).withColumn("p_bull", p)
    return scored.select(
        *df.columns, "p_bull", F.greatest("p_bull", 1 - F.col("p_bull")).alias("confidence")
    )


def save(model: PipelineModel, uri: str) -> str:
    """Write a fitted model to a folder that all executors share."""
    model.write().save(uri)
    return uri


def score(df: DataFrame, uri: str) -> DataFrame:
    """Add `p_bull` and `confidence` by a saved model."""
    return apply_direction(PipelineModel.load(uri), df)


def save_weights(spark: SparkSession, weights: Sequence[float], uri: str) -> str:
    """Write the weights of a linear scorer over samples of fixed length."""
    spark.createDataFrame(list(enumerate(map(float, weights))), "i int, weight double").write.parquet(uri)
    return uri


def score_samples(df: DataFrame, uri: str, sample: str, out: str = "score") -> DataFrame:
    """Add the logistic score of each sample, an array of prices of fixed length.

    The saved weights apply to the returns against the sample's last price. They are few, and
    become literals of an expression that Spark evaluates itself.
    """
    saved = df.sparkSession.read.parquet(uri).orderBy("i").collect()
    last = F.element_at(sample, -1)
    terms = [F.lit(r.weight) * (F.get(sample, F.lit(r.i)) / last - 1) for r in saved]
    return df.withColumn(out, 1 / (1 + F.exp(-sum(terms[1:], terms[0]))))


def loaded(name: str, load: Callable[[bytes], Any], content: Callable[[], bytes]) -> Any:
    """The model of that name, loaded by the first call in a worker process; one model is kept.

    This package travels by value, so what outlives a task lies in a module that workers make themselves.
    """
    held = sys.modules.setdefault("_barloom_models", types.ModuleType("_barloom_models")).__dict__
    if held.get("name") != name:
        held.update(name=name, model=load(content()))
    return held["model"]


def score_file(
    df: DataFrame,
    uri: str,
    load: Callable[[bytes], Any],
    predict: Callable[[Any, Any], Any],
    cols: Sequence[str],
    out: str = "score",
) -> DataFrame:
    """Add `out`, the prediction of any model kept in one file.

    `load` turns the file's bytes into a model, once per worker process; `predict` takes it and a matrix
    (a row per row, a column per name, doubles, NULL as NaN) and gives a number per row. Rows pass in Arrow
    batches and stay in their partitions. The bytes, MODEL_BYTES at most, are broadcast.
    """
    spark = df.sparkSession
    saved = spark.read.format("binaryFile").load(uri).where("length > 0")
    sizes = saved.select("path", "length").limit(2).collect()
    if len(sizes) != 1 or sizes[0].length > MODEL_BYTES:
        raise ValueError(f"not one model file of at most {MODEL_BYTES} bytes: {uri}")
    data = bytes(saved.select("content").first().content)
    name, shipped, wanted = hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data), list(cols)
    schema = T.StructType([*df.schema, T.StructField(out, T.DoubleType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            model = loaded(name, load, lambda: shipped.value)
            columns = [batch.column(c).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in wanted]
            found = predict(model, np.column_stack(columns)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], schema.names)

    return df.mapInArrow(run, schema)


def save_trees(spark: SparkSession, model: PipelineModel, uri: str) -> str:
    """Write the boosted trees of `fit_gbt` as one file of arrays, a place per node.

    `feature` is -1 at a leaf, whose `value` counts; else rows with at most `value` of the feature go to
    `left`, the others to `right`. `roots` and `weights` have a place per tree.
    """
    trees: dict[str, list] = {k: [] for k in ("feature", "value", "left", "right", "roots", "weights")}

    def add(node: Any) -> int:
        at, leaf = len(trees["feature"]), node.subtreeDepth() == 0
        split = None if leaf else node.split()
        trees["feature"].append(-1 if leaf else split.featureIndex())
        trees["value"].append(node.prediction() if leaf else split.threshold())
        trees["left"].append(-1)
        trees["right"].append(-1)
        if not leaf:
            trees["left"][at], trees["right"][at] = add(node.leftChild()), add(node.rightChild())
        return at

    fitted = model.stages[-1]
    for tree, weight in zip(fitted.trees, fitted.treeWeights, strict=True):
        trees["roots"].append(add(tree._call_java("rootNode")))
        trees["weights"].append(float(weight))
    spark.createDataFrame([(json.dumps(trees),)], "value string").coalesce(1).write.text(uri)
    return uri


def load_trees(data: bytes) -> dict[str, Any]:
    import numpy as np

    return {k: np.array(v) for k, v in json.loads(data).items()}


def predict_trees(trees: dict[str, Any], x: Any) -> Any:
    """The chance of the upper class: the logistic of twice the weighted sum of the trees."""
    import numpy as np

    total, rows = np.zeros(len(x)), np.arange(len(x))
    for root, weight in zip(trees["roots"], trees["weights"], strict=True):
        at = np.full(len(x), root)
        while (inner := trees["feature"][at] >= 0).any():
            low = x[rows, np.maximum(trees["feature"][at], 0)] <= trees["value"][at]
            at = np.where(inner, np.where(low, trees["left"][at], trees["right"][at]), at)
        total += weight * trees["value"][at]
    return 1 / (1 + np.exp(-2 * total))
