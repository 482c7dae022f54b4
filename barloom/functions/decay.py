"""Exponential means, exact for symbols of any length.

An exponential mean turns the value before a row into the value at it by a linear
step, and steps compose. So each chunk of a long symbol is scanned alone, which
gives every row as p times the chunk's first mean plus q; the means with which
chunks begin follow from one small row per chunk.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.session import cut_lineage
from .frames import Bars, number_rows
from .scalar import c


@dataclass(frozen=True)
class Decay:
    """The mean of a column with weight alpha for each new value, the first value
    as seed; missing until min_periods values are present."""

    name: str
    column: str
    alpha: float
    min_periods: int = 0


def ewm(series: pd.Series, alpha: float, min_periods: int = 0) -> pd.Series:
    """Gaps decay the weight of what is before them."""
    return series.astype("float64").ewm(alpha=alpha, adjust=False, min_periods=min_periods).mean()


def _steps(values: pd.Series, alpha: float) -> tuple[pd.Series, pd.Series, pd.Series]:
    """p, q and the number of values so far, from the first value on."""
    values = values.astype("float64")
    there = values.notna()
    zero, one = values.copy(), values.where(~there, 0.0)
    if there.any():
        first = there.idxmax()
        zero[first], one[first] = 0.0, 1.0
    return ewm(one, alpha), ewm(zero, alpha), there.cumsum()


def carried(bars: Bars, decays: list[Decay]) -> DataFrame:
    """The means of symbols that are too long for one task."""
    staged = number_rows(bars.df).withColumn("__chunk", F.floor(F.col("__idx") / F.lit(max(bars.limit, 1))))
    names = staged.columns
    safe = [f"c{i}" for i in range(len(names))]
    fields = [T.StructField(s, f.dataType) for s, f in zip(safe, staged.schema.fields, strict=True)]
    new = [f"{k}{i}" for i in range(len(decays)) for k in ("p", "q", "n")]
    fields += [T.StructField(n, T.LongType() if n[0] == "n" else T.DoubleType()) for n in new]

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.columns = names
        pdf = pdf.sort_values("__idx", ignore_index=True)
        parts = {n: s for i, d in enumerate(decays) for n, s in zip((f"p{i}", f"q{i}", f"n{i}"), _steps(pdf[d.column], d.alpha), strict=True)}
        pdf.columns = safe
        return pdf.assign(**parts)

    keys = [safe[names.index(k)] for k in ("symbol", "__chunk")]
    local = staged.toDF(*safe).groupBy(*keys).applyInPandas(scan, T.StructType(fields))
    own = [f"__{n}" for n in new]
    local = cut_lineage(local.toDF(*names, *own))  # read twice below
    ends = []
    for i, d in enumerate(decays):
        there = F.when(c(d.column).isNotNull(), F.col("__idx"))
        ends += [
            F.min(there).alias(f"first{i}"), F.max(there).alias(f"last{i}"), F.min_by(c(d.column).cast("double"), there).alias(f"x{i}"),
            *[F.max_by(f"__{k}{i}", "__idx").alias(f"{k}{i}") for k in "pqn"],
        ]
    chunks = local.groupBy("symbol", "__chunk").agg(*ends)

    def hand_on(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__chunk", ignore_index=True)
        out = {"symbol": pdf["symbol"], "__chunk": pdf["__chunk"]}
        for i, d in enumerate(decays):
            mean, last, seen, before, begin, count = None, 0, 0, [], [], []
            for first, to, x, p, q, n in pdf[[f"{k}{i}" for k in ("first", "last", "x", "p", "q", "n")]].itertuples(index=False):
                before.append(mean)
                count.append(seen)
                start = None
                if n:
                    weight = (1 - d.alpha) ** (first - last)
                    start = x if mean is None else (weight * mean + d.alpha * x) / (weight + d.alpha)
                    mean, last, seen = p * start + q, to, seen + int(n)
                begin.append(start)
            out |= {f"b{i}": np.array(before, float), f"s{i}": np.array(begin, float), f"k{i}": count}
        return pd.DataFrame(out)

    kinds = dict(chunks.dtypes)
    schema = f"symbol {kinds['symbol']}, __chunk {kinds['__chunk']}, " + ", ".join(f"b{i} double, s{i} double, k{i} long" for i in range(len(decays)))
    starts = chunks.groupBy("symbol").applyInPandas(hand_on, schema)
    joined = local.join(starts, ["symbol", "__chunk"])
    for i, d in enumerate(decays):
        mean = F.coalesce(F.col(f"__p{i}") * F.col(f"s{i}") + F.col(f"__q{i}"), F.col(f"b{i}"))
        joined = joined.withColumn(d.name, F.when(F.col(f"__n{i}") + F.col(f"k{i}") >= max(d.min_periods, 1), mean))
    helpers = [] if "__idx" in bars.df.columns else ["__idx"]
    return joined.drop("__chunk", *own, *[f"{k}{i}" for i in range(len(decays)) for k in "bsk"], *helpers)
