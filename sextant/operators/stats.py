"""Summaries and tests whose data pass through the cluster once or twice; only statistics of fixed size come to the driver."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions import dist
from .selection import group_quantiles, per_group, select_ranks
from .windows import average_rank, average_ranks


def summary(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, mean, std, min, quartiles, max and share above zero."""
    c = F.col(x)
    out = df.where(c.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.avg((c > 0).cast("double")).alias("share_positive"))
    out = per_group(out, group_quantiles(df, by, x, [0.25, 0.5, 0.75]).drop("n"), by)
    return out.select(*by, "n", F.col("q")[1].alias("median"), "mean", "std", F.col("q")[0].alias("p25"), F.col("q")[2].alias("p75"), "min", "max", "share_positive")


def counts_with_share(df: DataFrame, by: str) -> DataFrame:
    """Counts by value, null included, with the share of all rows in percent."""
    out = df.groupBy(by).agg(F.count("*").alias("n"))
    return out.crossJoin(F.broadcast(df.agg(F.count("*").alias("__all")))).select(by, "n", (100 * F.col("n") / F.col("__all")).alias("pct"))


def funnel(df: DataFrame, steps: list[tuple[str, F.Column]], only_drops: bool = False) -> DataFrame:
    """(at, step, n, dropped, pct): rows left at each condition, in one pass; only_drops leaves out later steps that drop nothing."""
    one = df.agg(*[F.count_if(c).alias(f"s{i}") for i, (_, c) in enumerate(steps)])
    rows = F.array(*[F.struct(F.lit(i).alias("at"), F.lit(name).alias("step"), F.col(f"s{i}").alias("n"), F.col(f"s{max(i - 1, 0)}").alias("before"), F.col("s0").alias("first")) for i, (name, _) in enumerate(steps)])
    r = one.select(F.inline(rows))
    out = r.select("at", "step", "n", (F.col("before") - F.col("n")).alias("dropped"), F.when(F.col("first") > 0, 100 * F.col("n") / F.col("first")).alias("pct"))
    return out.where("at = 0 or dropped > 0") if only_drops else out


def spread(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """n, std, interquartile range and median absolute deviation."""
    c = F.col(x)
    first = df.where(c.isNotNull()).groupBy(*by).agg(F.stddev_samp(c).alias("std"))
    held = group_quantiles(df, by, x, [0.25, 0.5, 0.75])
    # a row a group: Spark broadcasts the medians where they are small
    away = per_group(df.where(c.isNotNull()), held.select(*by, F.col("q")[1].alias("__m")), by).withColumn("__away", F.abs(c - F.col("__m")))
    mid = group_quantiles(away, by, "__away", [0.5]).select(*by, F.col("q")[0].alias("mad"))
    return per_group(per_group(held, first, by), mid, by).select(*by, "n", "std", (F.col("q")[2] - F.col("q")[0]).alias("iqr"), "mad")


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, r, n) of all pairs, each over the rows where both are known; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[e for i, (a, b) in enumerate(pairs) for e in (F.corr(a, b).alias(f"r{i}"), F.count_if(both(a, b)).alias(f"n{i}"))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("r"), F.col(f"n{i}").alias("n")) for i, (a, b) in enumerate(pairs)])))


def spearman(df: DataFrame, x: str, y: str) -> tuple[float | None, float | None, int]:
    """(rho, p, n) over complete rows."""
    rows = df.select(x, y).na.drop()
    rows = average_ranks(rows, {x: "__rx", y: "__ry"})
    rho, n = rows.agg(F.corr("__rx", "__ry"), F.count("*")).first()
    rho = None if rho is None or math.isnan(rho) else rho
    return rho, dist.correlation_p(rho, n) if rho is not None else None, n


def pearson(df: DataFrame, x: str, y: str) -> tuple[float | None, float | None, int]:
    """(r, p, n) over complete rows."""
    r, n = df.select(x, y).na.drop().agg(F.corr(x, y), F.count("*")).first()
    r = None if r is None or math.isnan(r) else r
    return r, dist.correlation_p(r, n) if r is not None else None, n


def pivot_medians(df: DataFrame, row: str, column: str, x: str, least: int = 5) -> DataFrame:
    """(row, column, n, median, place): cells of a pivot in long form, the median null under least rows; place orders rows by their totals, largest first."""
    known = df.where(F.col(row).isNotNull() & F.col(column).isNotNull())
    mid = group_quantiles(known, [row, column], x, [0.5]).select(row, column, F.col("q")[0].alias("m"))
    cells = known.groupBy(row, column).agg(F.count("*").alias("n")).join(mid, [row, column], "left")
    totals = cells.groupBy(row).agg(F.sum("n").alias("__t")).withColumn("place", F.row_number().over(Window.orderBy(F.desc("__t"), row)).cast("long"))  # a row for each label
    return cells.join(totals.drop("__t"), row).select(row, column, "n", F.when(F.col("n") >= least, F.col("m")).alias("median"), "place")


def extremes(df: DataFrame, by: list[str], x: str, key: str) -> DataFrame:
    """The whole row with the largest x of each group; ties go to the largest key."""
    best = df.where(F.col(x).isNotNull()).groupBy(*by).agg(F.max_by(F.struct(*df.columns), F.struct(x, key)).alias("r"))
    return best.select("r.*")


def gram(df: DataFrame, columns: list[str]):
    """(matrix of sums of products, n) as numpy, with a leading constant; k * k numbers come to the driver."""
    import numpy as np

    names = ["__one", *columns]
    rows = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    got = rows.agg(*[F.sum(F.col(names[i]).cast("double") * F.col(names[j]).cast("double")).alias(f"s{k}") for k, (i, j) in enumerate(pairs)]).first()
    out = np.zeros((len(names), len(names)))
    for v, (i, j) in zip(got, pairs):
        out[i, j] = out[j, i] = v or 0.0
    return out, int(out[0, 0])


def partial_spearman(df: DataFrame, x: str, y: str, controls: list[str]) -> dict:
    """Correlation of ranks with the ranks of the controls regressed out, and its interval by Fisher's z."""
    import numpy as np

    rows = df.select(x, y, *controls).na.drop()
    spans = rows.agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(controls)]).first() if controls else []
    controls = [c for c, varies in zip(controls, spans) if varies]  # a constant explains nothing
    n = rows.count()
    # ranks about their mean, which is known, as shares of n: sums of products of raw ranks lose the digits of their differences as n grows
    ranked = average_ranks(rows, {c: f"__r_{c}" for c in dict.fromkeys((x, y, *controls))})
    ranked = ranked.withColumns({f"__r_{c}": (F.col(f"__r_{c}") - (n + 1) / 2) / n for c in (x, y, *controls)})
    g, n = gram(ranked, [f"__r_{c}" for c in (*controls, x, y)])
    k = len(controls) + 1
    a, b = g[:k, :k], g[:k, k:]
    left = g[k:, k:] - b.T @ np.linalg.pinv(a) @ b
    r = float(left[0, 1] / math.sqrt(left[0, 0] * left[1, 1]))
    z, se = math.atanh(max(-0.999999, min(0.999999, r))), 1 / math.sqrt(max(n - len(controls) - 3, 1))
    return {"r": r, "p": dist.correlation_p(r, n), "n": n, "ci_low": math.tanh(z - 1.96 * se), "ci_high": math.tanh(z + 1.96 * se)}


def ols(df: DataFrame, y: str, xs: list[str]) -> dict:
    """Least squares with robust (HC3) errors, normal p and intervals; collinear columns by the pseudo-inverse."""
    import numpy as np

    rows = df.select(y, *xs).na.drop().withColumns({c: F.col(c).cast("double") for c in (y, *xs)})
    g, n = gram(rows, [*xs, y])
    k = len(xs) + 1
    inv = np.linalg.pinv(g[:k, :k])
    beta = inv @ g[:k, k]
    terms = [F.lit(1.0), *[F.col(c) for c in xs]]
    fit = sum((float(b) * t for b, t in zip(beta, terms)), F.lit(0.0))
    leverage = sum((float(inv[i, j]) * terms[i] * terms[j] for i in range(k) for j in range(k)), F.lit(0.0))
    e = F.col(y) - fit
    w = F.pow(e / (1 - leverage), F.lit(2.0))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    got = rows.agg(F.sum(e * e), *[F.sum(w * terms[i] * terms[j]).alias(f"m{q}") for q, (i, j) in enumerate(pairs)]).first()
    meat = np.zeros((k, k))
    for v, (i, j) in zip(got[1:], pairs):
        meat[i, j] = meat[j, i] = v
    se = np.sqrt(np.maximum(np.diag(inv @ meat @ inv), 0))
    ssr, mean = got[0], g[0, k] / n
    sst = g[k, k] - n * mean * mean
    rank = int(np.linalg.matrix_rank(g[:k, :k]))
    llf = -n / 2 * (math.log(2 * math.pi) + math.log(ssr / n) + 1)
    return {
        "names": ["const", *xs], "beta": beta.tolist(), "se": se.tolist(), "p": [dist.normal_two_sided(b / s) if s else None for b, s in zip(beta, se)], "n": n, "rank": rank,
        "ssr": ssr, "r2": 1 - ssr / sst, "adj_r2": 1 - (ssr / (n - rank)) / (sst / (n - 1)), "llf": llf, "aic": 2 * rank - 2 * llf, "bic": math.log(n) * rank - 2 * llf,
    }


def likelihood_ratio(df: DataFrame, y: str, small: list[str], large: list[str], fit: Callable = ols, also: list[str] = ()) -> dict:
    """Whether the columns of large beyond small help, on rows complete in all of them and in the columns also, which fit reads beside them."""
    rows = df.select(y, *large, *also).na.drop()
    a, b = fit(rows, y, small), fit(rows, y, large)
    stat, dof = 2 * (b["llf"] - a["llf"]), b["rank"] - a["rank"]
    return {"statistic": stat, "dof": dof, "p": dist.chi2_upper(stat, dof) if dof > 0 else None, "n": b["n"], "delta_aic": b["aic"] - a["aic"], "delta_bic": b["bic"] - a["bic"], "r2_small": a["r2"], "r2_large": b["r2"]}


def kruskal(df: DataFrame, group: str, x: str) -> dict:
    """Kruskal-Wallis H with tie correction."""
    rows = average_rank(df.select(group, x).na.drop(), x, "__r")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum("__r").alias("s")).collect()  # one row a group
    n = sum(r.n for r in per)
    h = 12 / (n * (n + 1)) * sum(r.s**2 / r.n for r in per) - 3 * (n + 1)
    ties = rows.groupBy(x).agg(F.count("*").cast("double").alias("t")).agg(F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t"))).first()[0]
    h /= 1 - ties / (float(n) ** 3 - n)
    return {"statistic": h, "p": dist.chi2_upper(h, len(per) - 1), "groups": len(per), "n": n}


def _centred(df: DataFrame, group: str, x: str) -> DataFrame:
    rows = df.select(group, x).na.drop()
    mid = group_quantiles(rows, [group], x, [0.5]).select(group, F.col("q")[0].alias("__m"))
    return rows.join(mid, group).select(group, F.abs(F.col(x) - F.col("__m")).alias("z"))


def levene(df: DataFrame, group: str, x: str) -> dict:
    """Equality of variances by absolute deviations from group medians."""
    per = _centred(df, group, x).groupBy(group).agg(F.count("*").alias("n"), F.avg("z").alias("m"), F.var_pop("z").alias("v")).collect()
    n, k = sum(r.n for r in per), len(per)
    mean = sum(r.n * r.m for r in per) / n
    between, within = sum(r.n * (r.m - mean) ** 2 for r in per), sum(r.n * r.v for r in per)
    w = (n - k) / (k - 1) * between / within
    return {"statistic": w, "p": dist.f_upper(w, k - 1, n - k), "groups": k, "n": n}


def fligner(df: DataFrame, group: str, x: str) -> dict:
    """Equality of variances by normal scores of the ranked deviations. The inverse normal law is applied to distinct ranks, in Arrow batches."""
    from pyspark.sql.types import DoubleType

    rows = average_rank(_centred(df, group, x), "z", "__r")
    n = rows.count()

    @F.pandas_udf(DoubleType())
    def score(r):
        import pandas as pd

        return pd.Series([dist.normal_quantile(0.5 + v / (2 * (n + 1))) for v in r])

    distinct = rows.select("__r").distinct().withColumn("a", score("__r"))
    per = rows.join(distinct, "__r").groupBy(group).agg(F.count("*").alias("n"), F.avg("a").alias("m"), F.sum(F.col("a") * F.col("a")).alias("s")).collect()
    mean = sum(r.n * r.m for r in per) / n
    var = (sum(r.s for r in per) - n * mean**2) / (n - 1)
    x2 = sum(r.n * (r.m - mean) ** 2 for r in per) / var
    return {"statistic": x2, "p": dist.chi2_upper(x2, len(per) - 1), "groups": len(per), "n": n}


def welch(df: DataFrame, split: str, columns: list[str]) -> list[dict]:
    """Two-sample means by a 0/1 column; nulls where a side has fewer than two rows."""
    agg = [e for c in columns for s in (0, 1) for e in (F.count(F.when(F.col(split) == s, F.col(c))), F.avg(F.when(F.col(split) == s, F.col(c))), F.var_samp(F.when(F.col(split) == s, F.col(c))))]
    got = list(df.agg(*[e.alias(f"c{i}") for i, e in enumerate(agg)]).first())
    out = []
    for i, c in enumerate(columns):
        n0, m0, v0, n1, m1, v1 = got[6 * i : 6 * i + 6]
        row = {"observable": c, "in_sample": m1, "out_of_sample": m0, "n_in": n1, "n_out": n0, "difference": None, "statistic": None, "p": None}
        if min(n0, n1) >= 2 and v0 + v1 > 0:
            a, b = v1 / n1, v0 / n0
            t = (m1 - m0) / math.sqrt(a + b)
            dof = (a + b) ** 2 / (a * a / (n1 - 1) + b * b / (n0 - 1))
            row |= {"difference": m1 - m0, "statistic": t, "p": dist.t_two_sided(t, dof)}
        out.append(row)
    return out


def adjust(df: DataFrame, name: str, p: str) -> DataFrame:
    """Bonferroni and Benjamini-Hochberg within a family of tests; null p stays out of the count."""
    m = F.count(p).over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy(F.col(p).asc_nulls_last(), name))
    down = Window.orderBy(F.col("__r").desc()).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("__m", m).withColumn("__r", F.when(F.col(p).isNotNull(), rank))
    raw = F.col(p) * F.col("__m") / F.col("__r")
    out = out.withColumn("p_bonferroni", F.when(F.col(p).isNotNull(), F.least(F.col(p) * F.col("__m"), F.lit(1.0)))).withColumn("p_bh", F.when(F.col(p).isNotNull(), F.least(F.min(raw).over(down), F.lit(1.0))))
    return out.drop("__m", "__r")


def _median_ranks(n: int, draws: int, seed: list[int]):
    """Two arrays: between which ranks (from 0) of n ordered values the medians of resamples lie.

    A resample draws n uniform places; its middle ones are order statistics, whose law is beta: the m-th least
    place of n is beta(m, n + 1 - m), and the next one the least of n - m places beyond it.
    """
    import numpy as np

    rng = np.random.default_rng(seed)
    m = (n + 1) // 2
    first = rng.beta(m, n + 1 - m, draws)
    second = first + (1 - first) * rng.beta(1, n - m, draws) if n % 2 == 0 else first
    return [np.minimum((n * u).astype(np.int64), n - 1) for u in (first, second)]


def bootstrap(df: DataFrame, by: list[str], x: str, draws: int = 5000, seed: int = 20240517, most: int | None = None) -> DataFrame:
    """(by, n, value, ci_low, ci_high): the median of each group and its percentile interval over resamples; no interval under three rows.

    Resamples are drawn as the ranks their medians fall on, and no row is resampled. Ranks lie within a few times
    sqrt(n) of the middle, so of each group only the values between the least and the largest of them, found by
    selection, come to a task.
    """
    from zlib import crc32

    rows = scratch.write(df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("__v")))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0")
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*by).schema.fields)

    def ranks(key, n):
        return _median_ranks(int(n), draws, [seed, crc32(repr(tuple(map(str, key))).encode())])

    def spans(frames):
        for pdf in frames:
            out = []
            for *key, n in pdf[[*by, "n"]].itertuples(index=False):
                first, second = ranks(key, n)
                out.append((min(int(first.min()), (n - 1) // 2), max(int(second.max()), n // 2)))
            yield pdf.assign(first=[a for a, _ in out], last=[b for _, b in out])

    held = scratch.write(sizes.mapInPandas(spans, f"{kinds}n long, first long, last long"))
    targets = held.select(*by, F.explode(F.array_distinct(F.array("first", "last"))).alias("rank"))
    got = select_ranks(rows, by, "__v", targets, most)
    ends = got.groupBy(*by).agg(F.min("value").alias("__from"), F.max("value").alias("__to"), F.min("below").alias("__below"))
    near = per_group(rows, ends, by, (F.col("__v") >= F.col("__from")) & (F.col("__v") <= F.col("__to")))
    counted = per_group(near.groupBy(*by, "__v", "__below").agg(F.count("*").alias("__n")), held.select(*by, "n"), by)

    def run(key, pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("__v")
        v, n = pdf["__v"].to_numpy(), int(pdf["n"].iloc[0])
        upto = int(pdf["__below"].iloc[0]) + np.cumsum(pdf["__n"].to_numpy())
        at = lambda r: v[np.searchsorted(upto, r, "right")]
        lo = hi = None
        if n >= 3:
            first, second = ranks(key, n)
            lo, hi = np.percentile((at(first) + at(second)) / 2, [2.5, 97.5]).tolist()
        return pd.DataFrame([(*key, n, float(at((n - 1) // 2) + at(n // 2)) / 2, lo, hi)], columns=[*by, "n", "value", "ci_low", "ci_high"])

    out = scratch.write(counted.groupBy(*by).applyInPandas(run, f"{kinds}n long, value double, ci_low double, ci_high double"))
    scratch.drop(rows, held, got)
    return out


def evaluate(df: DataFrame, y: str, yhat: str) -> DataFrame:
    """One row: n, r2, rmse, mae; r2 is null where y is constant."""
    e = F.col(y) - F.col(yhat)
    one = df.where(F.col(y).isNotNull() & F.col(yhat).isNotNull()).agg(F.count("*").alias("n"), F.sum(e * e).alias("ssr"), F.var_pop(y).alias("v"), F.avg(F.abs(e)).alias("mae"))
    return one.select("n", F.when(F.col("v") > 0, 1 - F.col("ssr") / (F.col("v") * F.col("n"))).alias("r2"), F.sqrt(F.col("ssr") / F.col("n")).alias("rmse"), "mae")
