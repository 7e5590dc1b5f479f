"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.clock import col


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b in double, NULL when b is zero."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def r6(c: Column | str) -> Column:
    return F.round(col(c), 6)


def sorted_quantile(values: Column | str, q: float) -> Column:
    """Quantile of a sorted array, interpolated linearly; NULL for an empty one.

    Over sliding frames, sorting the collected frame is far cheaper than the exact
    percentile aggregate, which hashes every value again for each row.
    """
    a = col(values)
    at = (F.size(a) - 1) * F.lit(q)
    low, high = F.floor(at).cast("int"), F.ceil(at).cast("int")
    return F.get(a, low) + (F.get(a, high) - F.get(a, low)) * (at - low)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use(value)` with the value computed once, inside a lambda where Spark repeats it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def hash60(*parts: Column | str) -> Column:
    """60 uniform bits of the md5 of the parts, as BIGINT; the same in every engine."""
    text = F.concat_ws("|", *[col(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("bigint")


@F.pandas_udf(T.DoubleType())
def norm_cdf(x: pd.Series) -> pd.Series:
    return x.map(NormalDist().cdf, na_action="ignore")


@F.pandas_udf(T.DoubleType())
def norm_ppf(p: pd.Series) -> pd.Series:
    return p.map(lambda v: NormalDist().inv_cdf(v) if 0 < v < 1 else None, na_action="ignore")
