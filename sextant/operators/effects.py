"""Least squares with absorbed fixed effects of any number of levels, with robust (HC3) errors.

No level becomes a column. One effect is taken out by subtracting the means of its levels. Of two, the one
with more levels (the wide one) is taken out so, and the other (the narrow one, at most NARROW levels) through its matrix of counts after
that, which is summed from a table of pairs of levels. Both give exactly the fit with a 0/1 column
for each level. A row's leverage is that of its levels, found by pairs of levels, and that of the remaining columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType

from .. import scratch
from ..functions import dist
from .stats import gram

#: Levels of the narrower of two effects; its matrix is 32 MB at most.
NARROW = 2000
#: Levels and cells of the wider one that are worked on at once.
BATCH, CELLS = 1024, 200_000


def _centred(rows: DataFrame, effect: str, columns: list[str]) -> DataFrame:
    means = rows.groupBy(effect).agg(*[F.avg(c).alias(f"__mean{i}") for i, c in enumerate(columns)])
    return rows.join(means, effect).withColumns({c: F.col(c) - F.col(f"__mean{i}") for i, c in enumerate(columns)}).drop(*[f"__mean{i}" for i in range(len(columns))])


def _one(rows: DataFrame, effect: str, columns: list[str]) -> tuple[DataFrame, int]:
    sizes = rows.groupBy(effect).agg((1 / F.count("*")).alias("__h"))
    return _centred(rows, effect, columns).join(sizes, effect), sizes.count()


def _two(rows: DataFrame, wide: str, narrow: str, columns: list[str]) -> tuple[DataFrame, int]:
    import numpy as np
    import pandas as pd

    spark = rows.sparkSession
    levels = rows.groupBy(narrow).agg(F.count("*").alias("n")).orderBy(narrow).limit(NARROW + 1).collect()
    if len(levels) > NARROW:
        raise ValueError(f"{narrow} has more than {NARROW} levels, and {wide} has no fewer")
    place = spark.createDataFrame([(r[0], i) for i, r in enumerate(levels)], rows.select(narrow).schema.add("__b", IntegerType()))
    rows = rows.join(F.broadcast(place), narrow)
    cells = scratch.write(rows.groupBy(F.col(wide).alias("a"), F.col("__b").alias("b")).agg(F.count("*").alias("n")))
    sizes = cells.groupBy("a").agg(F.sum("n").alias("all"))
    shares = cells.join(sizes, "a")
    pairs = shares.join(cells.select("a", F.col("b").alias("b2"), F.col("n").alias("n2")), "a").groupBy("b", "b2").agg(F.sum(F.col("n") * F.col("n2") / F.col("all")).alias("s"))
    matrix = np.diag([float(r.n) for r in levels])
    for b, b2, s in pairs.collect():  # NARROW squared at most
        matrix[b, b2] -= s
    inverse = np.linalg.pinv(matrix, hermitian=True)
    sums = _centred(rows.select(wide, "__b", *columns), wide, columns).groupBy("__b").agg(*[F.sum(c).alias(c) for c in columns])
    totals = np.zeros((len(levels), len(columns)))
    for r in sums.collect():  # a row a level
        totals[r[0]] = r[1:]
    taken = inverse @ totals
    effects = spark.createDataFrame([(i, *map(float, taken[i])) for i in range(len(levels))], "__b int, " + ", ".join(f"__e{i} double" for i in range(len(columns))))
    left = rows.join(F.broadcast(effects), "__b").withColumns({c: F.col(c) - F.col(f"__e{i}") for i, c in enumerate(columns)}).drop(*[f"__e{i}" for i in range(len(columns))])
    shared = spark.sparkContext.broadcast(inverse)

    def leverages(pdf):
        # many levels of the wide effect at once, BATCH of them as rows of a matrix of shares
        a, at = pdf["a"].factorize()[0], pdf["b"].to_numpy()
        order = np.argsort(a, kind="stable")
        a, at, n = a[order], at[order], pdf["n"].to_numpy(float)[order]
        all_ = np.bincount(a, n)
        out, diagonal = np.empty(len(a)), np.diag(shared.value)
        for first in range(0, len(all_), BATCH):
            lo, hi = np.searchsorted(a, [first, first + BATCH])
            i, j = a[lo:hi] - first, at[lo:hi]
            share = np.zeros((i[-1] + 1, len(diagonal)))
            share[i, j] = n[lo:hi] / all_[a[lo:hi]]
            inner = share @ shared.value
            out[lo:hi] = 1 / all_[a[lo:hi]] + diagonal[j] - 2 * inner[i, j] + np.einsum("ij,ij->i", share, inner)[i]
        return pd.DataFrame({"a": pdf["a"].to_numpy()[order], "b": at, "__h": out})

    # a level's cells stay together; a call takes about CELLS of them
    dealt = cells.groupBy(F.pmod(F.xxhash64("a"), F.lit(cells.count() // CELLS + 1)))
    held = scratch.write(dealt.applyInPandas(leverages, cells.select("a", "b").schema.add("__h", DoubleType())))
    out = _centred(left, wide, columns).join(held, (F.col(wide) == F.col("a")) & (F.col("__b") == F.col("b"))).drop("a", "b", "__b")
    return out, sizes.count() + int(np.linalg.matrix_rank(matrix, hermitian=True))


def absorbed_ols(df: DataFrame, y: str, xs: list[str], fixed: list[str]) -> dict:
    """As stats.ols for a fit with a 0/1 column for every level of one or two effects; the constant's numbers are None. Rows must be complete."""
    import numpy as np

    if not 1 <= len(fixed) <= 2:
        raise ValueError("one or two effects")
    columns = [*xs, y]
    rows = scratch.write(df.select(*columns, *fixed).na.drop().withColumns({c: F.col(c).cast("double") for c in columns}))
    total = rows.agg(F.count("*"), F.var_pop(y)).first()
    if len(fixed) == 1:
        within, taken = _one(rows, fixed[0], columns)
    else:
        wide, narrow = sorted(fixed, key=lambda c: -rows.select(c).distinct().count())
        within, taken = _two(rows, wide, narrow, columns)
    within = scratch.write(within.select(*columns, "__h"))
    g, n = gram(within, columns)
    g, k = g[1:, 1:], len(xs)
    # what an effect explains wholly is left with rounding errors alone
    scale = np.sqrt(np.maximum(np.diag(gram(rows, columns)[0])[1:], 1e-300))
    gone = np.sqrt(np.maximum(np.diag(g), 0)) < 1e-9 * scale
    g[gone, :] = g[:, gone] = 0
    inv = np.linalg.pinv(g[:k, :k])
    beta = inv @ g[:k, k]
    e = F.col(y) - sum((float(b) * F.col(c) for b, c in zip(beta, xs)), F.lit(0.0))
    leverage = F.col("__h") + sum((float(inv[i, j]) * F.col(xs[i]) * F.col(xs[j]) for i in range(k) for j in range(k)), F.lit(0.0))
    # a row that alone has a level is fitted exactly
    w = F.when(1 - leverage > 1e-9, F.pow(e / (1 - leverage), F.lit(2.0))).otherwise(0.0)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = within.agg(F.sum(e * e), *[F.sum(w * F.col(xs[i]) * F.col(xs[j])).alias(f"m{q}") for q, (i, j) in enumerate(pairs)]).first()
    meat = np.zeros((k, k))
    for v, (i, j) in zip(got[1:], pairs):
        meat[i, j] = meat[j, i] = v
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    ssr, sst, rank = got[0], total[1] * n, taken + int(np.linalg.matrix_rank(g[:k, :k]))
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    scratch.drop(rows, within)
    return {
        "names": ["const", *xs], "beta": [None, *beta.tolist()], "se": [None, *se.tolist()], "p": [None, *[dist.normal_two_sided(b / s) if s else None for b, s in zip(beta, se)]], "n": n, "rank": rank,
        "ssr": ssr, "r2": 1 - ssr / sst, "adj_r2": 1 - (ssr / (n - rank)) / (sst / (n - 1)) if n > rank else None, "llf": llf, "aic": 2 * rank - 2 * llf, "bic": math.log(n) * rank - 2 * llf,
    }
