"""Quantiles, quantile bins, winsorising, trimming and histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clip
from .selection import group_quantiles


def quantiles(df: DataFrame, column: str, shares: list[float]) -> list[float]:
    """Exact quantiles with linear interpolation."""
    got = group_quantiles(df, [], column, shares).first()
    return list(got.q) if got else []


def qcut(df: DataFrame, column: str, q: int, out: str) -> DataFrame:
    """Adds the quantile bin from 0: edges are the distinct quantiles, bins are closed on the right and the lowest edge belongs to the first."""
    edges = sorted(set(quantiles(df, column, [i / q for i in range(q + 1)])))
    if not edges:
        return df.withColumn(out, F.lit(None).cast("int"))
    below = sum((F.when(F.col(column) > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    return df.withColumn(out, F.when(F.col(column).isNotNull(), F.greatest(below - 1, F.lit(0))).cast("int"))


def winsorise(df: DataFrame, column: str, out: str, lo: float = 0.01, hi: float = 0.99, train: DataFrame | None = None) -> DataFrame:
    """Clips to quantiles of train (or of df itself)."""
    limits = quantiles(train if train is not None else df, column, [lo, hi])
    x = F.col(column).cast("double")
    return df.withColumn(out, clip(x, *map(float, limits)) if limits else x)


def trim(df: DataFrame, column: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Rows between two quantiles, both included."""
    limits = quantiles(df, column, [lo, hi])
    return df.where(F.col(column).between(*limits) if limits else F.lit(False))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """(bin from 1, n) of equal widths between minimum and maximum; the maximum belongs to the last bin."""
    lo, hi = df.agg(F.min(column).cast("double"), F.max(column).cast("double")).first()
    x = F.col(column).cast("double")
    at = F.least(F.floor((x - lo) / ((hi - lo) / bins if hi > lo else 1.0)) + 1, F.lit(bins))
    return df.where(F.col(column).isNotNull()).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))
