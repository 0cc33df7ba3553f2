"""Composed studies of one outcome: resampled rank correlations, binned medians, robustness tables and a family of six tests.

A study names its columns once (Study). Data pass through the cluster; what comes to the
driver are statistics, and replicates of them, whose number does not grow with the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import scratch
from ..functions import dist
from . import binning, stats
from .effects import absorbed_ols
from .selection import group_quantiles
from .windows import average_ranks

DRAWS, SEED, CELLS = 5000, 20240517, 1024
Z = 1.959963984540054


def _known(df: DataFrame, *columns: str) -> DataFrame:
    """Rows where all columns hold a finite number."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    return rows.where(" and ".join(f"`{c}` is not null and not isnan(`{c}`) and abs(`{c}`) < double('infinity')" for c in columns))


def _ranked(df: DataFrame, x: str, y: str) -> tuple[DataFrame, int, float | None]:
    """Average ranks __rx and __ry of the complete rows, their number, and rho."""
    rows = average_ranks(_known(df, x, y), {x: "__rx", y: "__ry"}).select("__rx", "__ry").persist()
    rho, n = rows.agg(F.corr("__rx", "__ry"), F.count("*")).first()
    return rows, n, None if rho is None or math.isnan(rho) else rho


def rank_replicates(ranked: DataFrame, n: int, draws: int = DRAWS, seed: int = SEED, blocks: int = 16):
    """Bootstrap replicates of Spearman's rho over n rows of average ranks (__rx, __ry), as a numpy array.

    Ranks are laid on a grid of CELLS by CELLS and counted, and a resample of the rows is
    a multinomial draw of those counts; so a task holds at most CELLS * CELLS numbers whatever
    the number of rows, and a rank is off by at most a CELLS-th of them. Blocks of draws run in parallel.
    """
    import numpy as np

    if n < 5:
        return np.empty(0)
    cell = lambda r: F.least(F.floor(F.col(r) * CELLS / (n + 1)), F.lit(CELLS - 1)).cast("int")
    # few rows keep their ranks: doubled ranks are whole numbers
    place = (lambda r: (2 * F.col(r)).cast("int")) if 2 * n <= CELLS else cell
    counted = ranked.groupBy(place("__rx").alias("i"), place("__ry").alias("j")).agg(F.count("*").alias("n"))

    def run(key, pdf):
        import pandas as pd

        pdf = pdf.sort_values(["i", "j"])
        ix, jy = (np.unique(pdf[c].to_numpy(), return_inverse=True)[1] for c in ("i", "j"))
        c = pdf.n.to_numpy()
        total = int(c.sum())
        rng = np.random.default_rng([seed, int(key[0])])
        # few rows a cell: places of rows are drawn and counted, which is the same law and faster
        owner = np.repeat(np.arange(len(c)), c) if total <= 8 * len(c) else None
        out = []
        for _ in range(len(range(int(key[0]), draws, blocks))):
            w = (rng.multinomial(total, c / total) if owner is None else np.bincount(owner[rng.integers(total, size=total)], minlength=len(c))).astype(float)
            centred = []
            for at in (ix, jy):
                per = np.bincount(at, w)
                rank = np.cumsum(per) - per / 2
                centred.append((rank - np.dot(rank, per) / total)[at])
            a, b = centred
            scale = math.sqrt(np.dot(w, a * a) * np.dot(w, b * b))
            out.append(float(np.dot(w, a * b) / scale) if scale else None)
        return pd.DataFrame({"block": [key[0]], "rho": [out]})

    dealt = counted.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # a row for each block, ordered here: an orderBy would sample its input first, which draws everything twice
    got = sorted(dealt.groupBy("block").applyInPandas(run, "block int, rho array<double>").collect(), key=lambda r: r.block)
    return np.array([v for r in got for v in r.rho], float)


def _interval(replicates) -> tuple[float | None, float | None]:
    import numpy as np

    held = replicates[~np.isnan(replicates)]
    return tuple(float(v) for v in np.percentile(held, [2.5, 97.5])) if len(held) else (None, None)


def spearman_interval(df: DataFrame, x: str, y: str, draws: int = DRAWS, seed: int = SEED) -> dict:
    """rho, p, n and the percentile interval over resampled pairs; no interval under five complete rows."""
    rows, n, rho = _ranked(df, x, y)
    lo, hi = _interval(rank_replicates(rows, n, draws, seed)) if rho is not None else (None, None)
    rows.unpersist()
    return {"rho": rho, "p": dist.correlation_p(rho, n) if rho is not None else None, "n": n, "ci_low": lo, "ci_high": hi}


def rho_difference(df: DataFrame, x: str, y: str, flag: str, draws: int = DRAWS, seed: int = SEED) -> dict:
    """Rho where a flag is 1 and where it is 0, their difference and its percentile interval over independent resamples of both."""
    held, out = {}, {}
    for k in (1, 0):
        rows, n, rho = _ranked(df.where(F.col(flag) == k), x, y)
        held[k] = rank_replicates(rows, n, draws, seed + k)
        rows.unpersist()
        out |= {f"rho_{k}": rho, f"n_{k}": n, f"ci_{k}": _interval(held[k])}
    both = min(map(len, held.values()))
    lo, hi = _interval(held[1][:both] - held[0][:both])
    diff = out["rho_1"] - out["rho_0"] if None not in (out["rho_1"], out["rho_0"]) else None
    return out | {"difference": diff, "ci_low": lo, "ci_high": hi}


def binned_medians(df: DataFrame, column: str, target: str, q: int = 10, least: int = 4, draws: int = DRAWS) -> DataFrame:
    """(bin from 1, n, median, ci_low, ci_high, p25, p75, x): the target's median by quantile bin of a column, whose own median is x.

    Empty with fewer than least rows a bin.
    """
    rows = scratch.write(_known(df, column, target))
    out = "bin int, n long, median double, ci_low double, ci_high double, p25 double, p75 double, x double"
    if rows.count() < q * least:
        return df.sparkSession.createDataFrame([], out)
    cut = binning.qcut(rows, column, q, "__bin").withColumn("bin", F.col("__bin") + 1)
    mid = group_quantiles(cut, ["bin"], column, [0.5]).select("bin", F.col("q")[0].alias("x"))
    held = group_quantiles(cut, ["bin"], target, [0.25, 0.75]).select("bin", "q").join(mid, "bin")
    resampled = stats.bootstrap(cut, ["bin"], target, draws=draws).withColumnRenamed("value", "median")  # a written table
    return resampled.join(held, "bin").select("bin", "n", "median", "ci_low", "ci_high", F.col("q")[0].alias("p25"), F.col("q")[1].alias("p75"), "x")


def varying(df: DataFrame, columns: list[str]) -> list[str]:
    """The columns that the table has and that hold two values or more."""
    found = [c for c in columns if c in df.columns]
    if not found:
        return []
    one = df.agg(*[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(found)]).first()
    return [c for c, v in zip(found, one) if v]


def slope(df: DataFrame, y: str, x: str, controls: list[str] = (), fixed: list[str] = (), winsorise: bool = False, least: int = 40) -> dict:
    """n, estimate, interval and p of x in a least-squares fit of y with controls and fixed effects, robust (HC3) errors, normal law.

    Controls that are missing or constant are left out, rows must be complete; all null under least rows.
    winsorise clips y at its 1st and 99th percentiles.
    """
    used = varying(df, list(controls))
    rows = df.select(*dict.fromkeys([y, x, *used, *fixed])).na.drop()
    names = [x, *used]
    n = rows.count()
    if n < least:
        return {"n": n, "estimate": None, "ci_low": None, "ci_high": None, "p_value": None}
    if winsorise:
        rows = binning.winsorise(rows, y, y)
    fit = absorbed_ols(rows, y, names, list(fixed)) if fixed else stats.ols(rows, y, names)
    b, se = fit["beta"][1], fit["se"][1]
    return {"n": fit["n"], "estimate": b, "ci_low": b - Z * se, "ci_high": b + Z * se, "p_value": fit["p"][1]}


def interaction(df: DataFrame, y: str, x: str, flag: str, controls: list[str] = (), fixed: list[str] = ()) -> dict:
    """The coefficient of x times a 0/1 flag beside both, controls and fixed effects; rows complete in all but constant controls."""
    used = varying(df, list(controls))
    rows = df.select(*dict.fromkeys([y, x, flag, *used, *fixed])).na.drop().withColumn("__both", F.col(x) * F.col(flag))
    names = [x, flag, "__both", *used]
    fit = absorbed_ols(rows, y, names, list(fixed)) if fixed else stats.ols(rows, y, names)
    return {"estimate": fit["beta"][3], "se": fit["se"][3], "p_value": fit["p"][3], "main": fit["beta"][1], "main_p": fit["p"][1], "n": fit["n"]}


def correlation_order(r) -> list[int]:
    """The leaves' order of a small correlation matrix (numpy, k x k) by average linkage on 1 - |r|; of equal distances the pair found first merges first."""
    import numpy as np

    d = 1 - np.abs(np.asarray(r, float))
    held = {i: [i] for i in range(len(d))}
    while len(held) > 1:
        keys = list(held)
        apart = {(a, b): float(np.mean(d[np.ix_(held[a], held[b])])) for i, a in enumerate(keys) for b in keys[i + 1 :]}
        a, b = min(apart, key=apart.get)
        name = max(held) + 1
        held[name] = held.pop(a) + held.pop(b)
    return next(iter(held.values()), [])


@dataclass
class Study:
    """The columns of a study. Flags are 0/1 or null; tier marks the certified group."""

    target: str
    tone: str
    concentration: str
    climate: str
    tier: str
    year: str
    sector: str
    length: str
    excluded: str | None = None
    corrected: str | None = None
    controls: list[str] = field(default_factory=list)
    ranks: list[str] = field(default_factory=list)
    base: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    categories: list[str] = field(default_factory=list)
    draws: int = DRAWS


ROW = "specification string, n long, estimate double, ci_low double, ci_high double, p_value double, kind string"


def robustness(df: DataFrame, s: Study) -> DataFrame:
    """One row for each specification that could break the association of tone and target.

    Rank correlations of subsamples and years, two partial ones, the plain one on the rows that the second of
    them uses, five linear fits with growing controls, and four of them on a winsorised target.
    """
    rows: list[dict] = []

    def ranked(label: str, part: DataFrame) -> None:
        got = spearman_interval(part, s.tone, s.target, s.draws)
        if got["n"] < 30:
            got |= {"rho": None, "ci_low": None, "ci_high": None, "p": None}
        rows.append({"specification": label, "n": got["n"], "estimate": got["rho"], "ci_low": got["ci_low"], "ci_high": got["ci_high"], "p_value": got["p"], "kind": "spearman"})

    ranked("all", df)
    if s.excluded in df.columns:
        ranked("without excluded kind", df.where(~F.col(s.excluded).eqNullSafe(1)))
        ranked("excluded kind only", df.where(F.col(s.excluded) == 1))
    if s.corrected in df.columns:
        ranked("without corrected targets", df.where(F.col(s.corrected) == 0))
    for r in df.where(F.col(s.year).isNotNull()).select(F.col(s.year).cast("int").alias("y")).distinct().orderBy("y").collect():
        ranked(f"year {r.y}", df.where(F.col(s.year) == r.y))
    wide = [s.length, *s.controls, *s.ranks]
    for label, controls in (("partial: length", [s.length]), ("partial: length, controls", wide)):
        used = varying(df, controls)
        n = df.select(s.tone, s.target, *used).na.drop().count()
        got = stats.partial_spearman(df, s.tone, s.target, used) if n >= 40 else {"r": None, "ci_low": None, "ci_high": None, "p": None}
        rows.append({"specification": label, "n": n, "estimate": got["r"], "ci_low": got["ci_low"], "ci_high": got["ci_high"], "p_value": got["p"], "kind": "partial_spearman"})
    ranked("all, rows of the partial one", df.na.drop(subset=[c for c in [s.target, s.tone, *wide] if c in df.columns]))
    base = [*s.controls, *([s.excluded] if s.excluded else [])]
    fits = [("ols", [], []), ("ols: controls", base, []), ("ols: + length", [*base, s.length], []), ("ols: + sector", [*base, s.length], [s.sector]), ("ols: + sector, year", [*base, s.length], [s.sector, s.year])]
    for label, controls, fixed in fits:
        rows.append({"specification": label, **slope(df, s.target, s.tone, controls, fixed), "kind": "ols_beta"})
    for label, controls, fixed in fits[1:]:
        rows.append({"specification": label + " [winsorised]", **slope(df, s.target, s.tone, controls, fixed, winsorise=True), "kind": "ols_beta_winsorised"})
    names = [f.split()[0] for f in ROW.split(", ")]
    return df.sparkSession.createDataFrame([tuple(None if r[n] is None else r[n] for n in names) for r in rows], ROW)


def association(df: DataFrame, column: str, target: str, bins: int, draws: int = DRAWS) -> dict:
    """Rank correlation with interval, the Kruskal-Wallis test across quantile bins, and the bins' medians."""
    rows = _known(df, column, target)
    n = rows.count()
    if n < 30:
        return {"method": "insufficient data", "n": n, "statistic": None, "p_value": None}
    rho = spearman_interval(rows, column, target, draws)
    cut = binning.qcut(rows, column, bins, "__bin")
    kw = stats.kruskal(cut, "__bin", target) if cut.select("__bin").distinct().count() > 1 else {"statistic": None, "p": None}
    return {
        "method": "rank correlation, Kruskal-Wallis across bins", "n": n, "statistic": rho["rho"], "p_value": rho["p"], "ci": (rho["ci_low"], rho["ci_high"]),
        "kw_statistic": kw["statistic"], "kw_p_value": kw["p"], "bins": binned_medians(rows, column, target, bins, 1, draws),
    }


def by_category(df: DataFrame, columns: list[str], target: str, draws: int = DRAWS) -> DataFrame:
    """(category, rho, ci_low, ci_high, p_value, n, p_bonferroni, p_bh) for each column with 30 complete rows, adjusted as one family."""
    found = []
    for c in columns:
        got = spearman_interval(df, c, target, draws) if c in df.columns else {"n": 0}
        if got["n"] >= 30:
            found.append((c, got["rho"], got["ci_low"], got["ci_high"], got["p"], got["n"]))
    rows = df.sparkSession.createDataFrame(found, "category string, rho double, ci_low double, ci_high double, p_value double, n long")
    return rows.join(stats.adjust(rows.select("category", "p_value"), "category", "p_value").drop("p_value"), "category", "left")


def variances(df: DataFrame, target: str, group: str, least: int = 60) -> dict:
    """Levene's and Fligner-Killeen's tests across groups, and each group's dispersion."""
    rows = df.select(F.col(group).alias("__g"), F.col(target).cast("double").alias(target)).na.drop()
    n = rows.count()
    if n < least:
        return {"method": "insufficient data", "n": n, "statistic": None, "p_value": None}
    lev, fk = stats.levene(rows, "__g", target), stats.fligner(rows, "__g", target)
    return {"method": "Levene, median-centred", "n": n, "statistic": lev["statistic"], "p_value": lev["p"], "robust_statistic": fk["statistic"], "robust_p_value": fk["p"], "groups": stats.spread(rows, ["__g"], target).withColumnRenamed("__g", "group")}


def variance_by_flag(df: DataFrame, s: Study) -> dict:
    """variances across the tier flag with at least 30 rows a side, and Levene's test again without corrected targets (10 a side)."""
    def sides(part):
        return {r[0]: r[1] for r in part.select(s.tier, s.target).na.drop().groupBy(s.tier).count().collect()}

    held = sides(df)
    if min(held.get(1, 0), held.get(0, 0)) < 30:
        return {"method": f"insufficient subsample ({held.get(1, 0)}, {held.get(0, 0)})", "n": sum(held.values()), "statistic": None, "p_value": None}
    out = variances(df.where(F.col(s.tier).isin(0, 1)), s.target, s.tier)
    if s.corrected in df.columns:
        clean = df.where(F.col(s.corrected) == 0)
        left = sides(clean)
        if min(left.get(1, 0), left.get(0, 0)) >= 10:
            out["without_corrected"] = stats.levene(clean.where(F.col(s.tier).isin(0, 1)), s.tier, s.target)
    return out


def incremental(df: DataFrame, target: str, base: list[str], more: list[str], sector: str) -> dict:
    """Likelihood-ratio test of columns beyond base and sector effects, on rows complete in all of them."""
    known = lambda cs: [c for c in cs if c in df.columns]
    base, more = known(base), known(more)
    rows = df.select(target, sector, *base, *more).na.drop()
    n = rows.count()
    if n < 60:
        return {"method": "insufficient data", "n": n, "statistic": None, "p_value": None}
    lr = stats.likelihood_ratio(rows, target, base, [*base, *more], lambda d, y, xs: absorbed_ols(d, y, xs, [sector]), [sector])
    # positive where the larger model is the better one
    return {"method": f"likelihood ratio, chi-square({lr['dof']})", "n": n, "statistic": lr["statistic"], "p_value": lr["p"], "delta_aic": -lr["delta_aic"], "delta_bic": -lr["delta_bic"]}


def moderated(df: DataFrame, s: Study) -> dict:
    """Whether the tier weakens tone: the interaction, and the rank correlations of both sides."""
    rows = df.na.drop(subset=[s.target, s.tone, s.tier])
    held = {r[0]: r[1] for r in rows.groupBy(s.tier).count().collect()}
    if min(held.get(1, 0), held.get(0, 0)) < 30:
        return {"method": f"insufficient subsample ({held.get(1, 0)}, {held.get(0, 0)})", "n": sum(held.values()), "statistic": None, "p_value": None}
    got = interaction(rows, s.target, s.tone, s.tier, [*s.controls, *([s.excluded] if s.excluded else [])], [s.sector])
    return {"method": "interaction, HC3", "n": got["n"], "statistic": got["estimate"], "p_value": got["p_value"], **rho_difference(rows, s.tone, s.target, s.tier, s.draws)}


def run_all(df: DataFrame, s: Study) -> dict:
    """The six tests, T1 to T6, and the family's adjusted p-values: with the plain ones and with the rank-based ones where a test has them."""
    terciles = binning.qcut(_known(df, s.climate, s.target), s.climate, 3, "__tercile")
    tests = {
        "T1": {"hypothesis": "tone and target", **association(df, s.tone, s.target, 5, s.draws)},
        "T2": {"hypothesis": "tone and tier", **moderated(df, s)},
        "T3": {"hypothesis": "concentration and target", **association(df, s.concentration, s.target, 3, s.draws)},
        "T4": {"hypothesis": "variance by climate", **variances(terciles, s.target, "__tercile")},
        "T5": {"hypothesis": "variance by tier", **variance_by_flag(df, s)},
        "T6": {"hypothesis": "texts beyond the deal", **incremental(df, s.target, s.base, s.texts, s.sector)},
    }

    def family(p) -> DataFrame:
        rows = df.sparkSession.createDataFrame([(k, p(v)) for k, v in tests.items()], "test string, p double")
        return stats.adjust(rows, "test", "p")

    return {"tests": tests, "adjusted": family(lambda v: v["p_value"]), "adjusted_robust": family(lambda v: v.get("robust_p_value", v["p_value"]))}


def summary(df: DataFrame, s: Study, alpha: float = 0.05) -> DataFrame:
    """One publishable row a test: method, n, statistic, interval, raw, robust and adjusted p-values, and what they reject."""
    out = run_all(df, s)
    rows = [(k, v["hypothesis"], v["method"], int(v["n"]), v["statistic"], *v.get("ci", (None, None)), v["p_value"], v.get("robust_p_value"), bool(v["p_value"] is not None and v["p_value"] < alpha)) for k, v in out["tests"].items()]
    flat = df.sparkSession.createDataFrame(rows, "test string, hypothesis string, method string, n long, statistic double, ci_low double, ci_high double, p_raw double, p_robust double, reject_raw boolean")
    family = out["adjusted"].select("test", "p_bonferroni", "p_bh", F.coalesce(F.col("p_bonferroni") < alpha, F.lit(False)).alias("reject_bonferroni"), F.coalesce(F.col("p_bh") < alpha, F.lit(False)).alias("reject_bh"))
    robust = out["adjusted_robust"].select("test", F.col("p_bh").alias("p_bh_robust"))
    return flat.join(family, "test", "left").join(robust, "test", "left")
