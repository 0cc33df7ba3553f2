"""Queries of the composed studies, over orders as events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..operators import binning, models, stats, studies
from ..operators.selection import group_quantiles
from .inference import _RANK, _deals, _row
from .texts import table

STUDY = studies.Study(
    target="y", tone="tone", concentration="concentration", climate="climate", tier="tier", year="year", sector="sector", length="length",
    excluded="excluded", corrected="corrected", controls=["lines"], ranks=["climate"], base=["lines", "climate"], texts=["tone", "concentration", "length"],
    categories=["tone", "concentration", "climate", "length"],
)


def events(spark, sf_dir):
    """One row an order, as a table of the shared folder, as studies read it many times. Ratios are of whole numbers, so that equal values are equal in every engine."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("d"), F.sum(F.round(F.col("l_quantity")).cast("long")).alias("q"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("p"), F.max(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("m"),
    )
    orders = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = orders.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    tier = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), 1.0).when(F.col("o_orderpriority").isin("4-NOT SPECIFIED", "5-LOW"), 0.0)
    return scratch.write(rows.select(
        "o_orderkey", F.col("o_custkey").alias("customer"), (F.col("o_totalprice") / 1000).alias("y"), (F.col("d") / F.col("n")).alias("tone"), (F.col("m") / F.col("p")).alias("concentration"), F.col("c_acctbal").alias("climate"), tier.alias("tier"),
        F.year("o_orderdate").alias("year"), F.col("c_mktsegment").alias("sector"), F.col("q").cast("double").alias("length"), F.col("n").cast("double").alias("lines"),
        (F.col("c_nationkey") == 7).cast("int").alias("excluded"), (F.col("o_orderstatus") == "F").cast("int").alias("corrected"),
    ))


_EVENTS = """li as (select l_orderkey, count(*) as n, sum(round(l_discount * 100)::bigint) as d, sum(round(l_quantity)::bigint) as q, sum(round(l_extendedprice * 100)::bigint) as p, max(round(l_extendedprice * 100)::bigint) as m from lineitem group by 1),
ev as (select o_orderkey, o_totalprice / 1000 as y, d::double / n as tone, m::double / p::double as concentration, c_acctbal as climate,
  case when o_orderpriority in ('1-URGENT', '2-HIGH') then 1.0::double when o_orderpriority in ('4-NOT SPECIFIED', '5-LOW') then 0.0::double end as tier,
  year(o_orderdate) as year, c_mktsegment as sector, q::double as length, n::double as lines, c_nationkey = 7 as excluded, o_orderstatus = 'F' as corrected
  from orders join li on o_orderkey = l_orderkey join customer on o_custkey = c_custkey)"""


def _rho(x: str, y: str, rows: str) -> str:
    return f"(select corr(a, b) from (select {_RANK.format(x)} as a, {_RANK.format(y)} as b from {rows} r))"


def _binned(x: str, q: int) -> str:
    cuts = ", ".join(str(i / q) for i in range(q + 1))
    return f"e as (select distinct unnest(quantile_cont({x}, [{cuts}])) as edge from ev), b as (select *, greatest((select count(*) from e where edge < {x}) - 1, 0)::int + 1 as bin from ev)"


def decile_medians(spark, sf_dir):
    out = studies.binned_medians(events(spark, sf_dir), "length", "y", 10)
    inside = (F.col("ci_low") <= F.col("median")) & (F.col("median") <= F.col("ci_high"))
    return out.select("bin", "n", *[F.round(c, 6).alias(c) for c in ("median", "p25", "p75", "x")], inside.alias("inside"))


DECILES = f"with {_EVENTS}, {_binned('length', 10)} select bin, count(*) as n, round(median(y), 6) as median, round(quantile_cont(y, 0.25), 6) as p25, round(quantile_cont(y, 0.75), 6) as p75, round(median(length), 6) as x, true as inside from b group by bin"


def spearman_interval(spark, sf_dir):
    got = studies.spearman_interval(events(spark, sf_dir), "length", "y")
    return _row(spark, {"rho": got["rho"], "n": got["n"], "inside": bool(got["ci_low"] <= got["rho"] <= got["ci_high"]), "narrow": bool(got["ci_high"] - got["ci_low"] < 8 / got["n"] ** 0.5)})


SPEARMAN = f"with {_EVENTS} select round({_rho('length', 'y', 'ev')}, 6) as rho, (select count(*) from ev) as n, true as inside, true as narrow"


def rho_difference(spark, sf_dir):
    got = studies.rho_difference(events(spark, sf_dir), "length", "y", "tier")
    return _row(spark, {k: got[k] for k in ("rho_1", "n_1", "rho_0", "n_0", "difference")} | {"inside": bool(got["ci_low"] <= got["difference"] <= got["ci_high"])})


DIFFERENCE = f"""with {_EVENTS}, r as (select {_rho('length', 'y', '(select * from ev where tier = 1)')} as a, {_rho('length', 'y', '(select * from ev where tier = 0)')} as b)
select round(a, 6) as rho_1, (select count(*) from ev where tier = 1) as n_1, round(b, 6) as rho_0, (select count(*) from ev where tier = 0) as n_0, round(a - b, 6) as difference, true as inside from r"""


def interaction_ols(spark, sf_dir):
    got = studies.interaction(events(spark, sf_dir), "y", "length", "tier")
    return _row(spark, {k: got[k] for k in ("estimate", "se", "main", "n")}, 5)


# the fit has a line of its own for each side of the flag, so errors add up
INTERACTION = f"""with {_EVENTS}, s as (select * from ev where tier is not null),
g as (select tier, regr_slope(y, length) as b, regr_intercept(y, length) as a, avg(length) as m, sum(length * length) - count(*) * avg(length) * avg(length) as sxx, count(*) as n from s group by tier),
e as (select tier, g.b, sxx, (y - a - g.b * length) / (1 - (1.0 / n + (length - m) * (length - m) / sxx)) as u, length - m as c from s join g using (tier)),
v as (select tier, any_value(b) as b, sum(u * u * c * c) / (any_value(sxx) * any_value(sxx)) as v from e group by tier)
select round(max(b) filter (where tier = 1) - max(b) filter (where tier = 0), 5) as estimate, round(sqrt(sum(v)), 5) as se, round(max(b) filter (where tier = 0), 5) as main, (select count(*) from s) as n from v"""


def fixed_effects_ols(spark, sf_dir):
    got = studies.slope(events(spark, sf_dir), "y", "length", fixed=["sector"])
    return _row(spark, {"estimate": got["estimate"], "ci_low": got["ci_low"], "ci_high": got["ci_high"], "n": got["n"]}, 5)


# within sectors: leverage is one over the sector's rows and the share of the centred square
FIXED = f"""with {_EVENTS}, c as (select y - avg(y) over w as y, length - avg(length) over w as x, count(*) over w as ng from ev window w as (partition by sector)),
b as (select sum(x * y) / sum(x * x) as b, sum(x * x) as sxx, count(*) as n from c),
v as (select sum(pow((y - b.b * x) / (1 - 1.0 / ng - x * x / sxx), 2) * x * x) / any_value(sxx * sxx) as v from c, b)
select round(b, 5) as estimate, round(b - 1.959963984540054 * sqrt(v), 5) as ci_low, round(b + 1.959963984540054 * sqrt(v), 5) as ci_high, n from b, v"""


def customer_effects_ols(spark, sf_dir):
    """An effect for each customer: thousands of levels."""
    got = studies.slope(events(spark, sf_dir), "y", "length", fixed=["customer"])
    return _row(spark, {"estimate": got["estimate"], "ci_low": got["ci_low"], "ci_high": got["ci_high"], "n": got["n"]}, 5)


CUSTOMER_EFFECTS = FIXED.replace("partition by sector", "partition by o_custkey").replace("from ev window", "from ev join (select o_orderkey, o_custkey from orders) using (o_orderkey) window").replace("sum(pow((", "sum(case when ng > 1 then pow((").replace(", 2) * x * x)", ", 2) * x * x else 0 end)")


def two_effects_ols(spark, sf_dir):
    """Effects of customers and of months side by side."""
    rows = events(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyyMM").alias("month")), "o_orderkey")
    got = studies.slope(rows, "y", "length", ["lines"], ["customer", "month"])
    return _row(spark, got, 5)


def hypothesis_statistics(spark, sf_dir):
    """Statistics of the tests whose laws SQL can say: rank correlations and Levene's test."""
    rows = events(spark, sf_dir)
    out = []
    for name, column in (("T1", "tone"), ("T3", "concentration")):
        rho, _, n = stats.spearman(rows, column, "y")
        out.append((name, n, round(rho, 6)))
    for name, group in (("T4", binning.qcut(rows, "climate", 3, "g")), ("T5", rows.where("tier is not null").withColumn("g", F.col("tier")))):
        got = stats.levene(group, "g", "y")
        out.append((name, got["n"], round(got["statistic"], 6)))
    return spark.createDataFrame(out, "test string, n long, statistic double")


def _levene(rows: str, g: str) -> str:
    return f"""(select (any_value(a.n) - count(*)) / (count(*) - 1) * sum(s.n * (s.a - a.m) * (s.a - a.m)) / sum(s.n * s.v) from
  (select {g} as g, count(*) as n, avg(z) as a, var_pop(z) as v from (select {g}, abs(y - median(y) over (partition by {g})) as z from {rows}) group by 1) s,
  (select avg(z) as m, count(*) as n from (select abs(y - median(y) over (partition by {g})) as z from {rows})) a)"""


STATISTICS = f"""with {_EVENTS}, {_binned('climate', 3)}, t as (select * from ev where tier is not null)
select 'T1' as test, (select count(*) from ev) as n, round({_rho('tone', 'y', 'ev')}, 6) as statistic
union all select 'T3', (select count(*) from ev), round({_rho('concentration', 'y', 'ev')}, 6)
union all select 'T4', (select count(*) from ev), round({_levene('b', 'bin')}, 6)
union all select 'T5', (select count(*) from t), round({_levene('t', 'tier')}, 6)"""


def hypothesis_summary(spark, sf_dir):
    return studies.summary(events(spark, sf_dir), STUDY)


def robustness_table(spark, sf_dir):
    return studies.robustness(events(spark, sf_dir), STUDY)


def category_ranks(spark, sf_dir):
    out = studies.by_category(events(spark, sf_dir), STUDY.categories, "y")
    return out.select("category", F.round("rho", 6).alias("rho"), "n", (F.col("p_bh") >= F.col("p_value")).alias("adjusted"))


CATEGORIES = f"with {_EVENTS} " + " union all ".join(f"select '{c}' as category, round({_rho(c, 'y', 'ev')}, 6) as rho, (select count(*) from ev) as n, true as adjusted" for c in STUDY.categories)


def pearson_corr(spark, sf_dir):
    got = stats.pearson(events(spark, sf_dir), "length", "y")
    return _row(spark, {"r": got[0], "n": got[2]})


PEARSON = f"with {_EVENTS} select round(corr(length, y), 6) as r, count(*) as n from ev"


def climate_terciles(spark, sf_dir):
    """Dispersion of the target by tercile of the climate."""
    cut = binning.qcut(events(spark, sf_dir), "climate", 3, "bin").withColumn("bin", F.col("bin") + 1)
    mid = group_quantiles(cut, ["bin"], "climate", [0.5]).select("bin", F.round(F.col("q")[0], 6).alias("x"))
    return stats.spread(cut, ["bin"], "y").join(mid, "bin").select("bin", "n", "x", *[F.round(c, 6).alias(c) for c in ("std", "iqr", "mad")])


TERCILES = f"with {_EVENTS}, {_binned('climate', 3)} select bin, count(*) as n, round(median(climate), 6) as x, round(stddev_samp(y), 6) as std, round(quantile_cont(y, 0.75) - quantile_cont(y, 0.25), 6) as iqr, round(mad(y), 6) as mad from b group by bin"


def sector_year(spark, sf_dir):
    return stats.pivot_medians(events(spark, sf_dir), "sector", "year", "y").withColumn("median", F.round("median", 6))


SECTOR_YEAR = f"""with {_EVENTS}, c as (select sector, year, count(*) as n, median(y) as m from ev group by 1, 2)
select sector, year, n, round(case when n >= 5 then m end, 6) as median, dense_rank() over (order by total desc, sector) as place from (select *, sum(n) over (partition by sector) as total from c)"""


def extreme_rows(spark, sf_dir):
    return stats.extremes(events(spark, sf_dir).select("sector", "o_orderkey", "y"), ["sector"], "y", "o_orderkey").withColumn("y", F.round("y", 6))


EXTREMES = f"with {_EVENTS} select sector, arg_max(o_orderkey, struct_pack(y := y, k := o_orderkey)) as o_orderkey, round(max(y), 6) as y from ev group by sector"


def fold_summary(spark, sf_dir):
    """The mean's and the median's errors over folds, summarised by model."""
    rows = models.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 1000).alias("y")), ["o_orderdate", "o_orderkey"])
    folds = models.baselines(rows, "y", 5).unpivot("fold", ["mean", "median"], "model", "mae")
    out = models.fold_summary(folds, ["mae"])
    return out.select("model", *[F.round(c, 6).alias(c) for c in out.columns if c != "model"])


FOLD_SUMMARY = """with o as (select o_totalprice / 1000 as y, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders), f as (select unnest([1, 2, 3, 4, 5]) as fold),
b as (select fold, avg(y) as m, median(y) as d from o, f where pos < n - (6 - fold) * (n // 6) group by 1),
e as (select fold, avg(abs(y - m)) as a, avg(abs(y - d)) as b from o join b on pos >= n - (6 - fold) * (n // 6) and pos < n - (5 - fold) * (n // 6) group by 1),
l as (select 'mean' as model, a as mae from e union all select 'median', b from e)
select model, round(avg(mae), 6) as mae_mean, round(stddev_samp(mae), 6) as mae_std, round(min(mae), 6) as mae_min, round(max(mae), 6) as mae_max from l group by 1"""


def model_ranges(spark, sf_dir):
    """Mean, deviation and range of the scores of every model over five folds."""
    per_fold = models.cross_validate(_deals(spark, sf_dir), "y", ["o_orderdate", "o_orderkey"], ["c_acctbal", "month"], ["o_orderpriority"], winsorise=True)
    return models.fold_summary(per_fold, ["r2", "rmse", "mae", "spearman"])


def holdout_residuals(spark, sf_dir):
    return models.residuals(_deals(spark, sf_dir), "o_orderkey", "y", "o_orderdate", "2000-01-01", ["c_acctbal", "month"], ["o_orderpriority"])


QUERIES = {
    "decile_medians": (decile_medians, DECILES), "spearman_interval": (spearman_interval, SPEARMAN), "rho_difference": (rho_difference, DIFFERENCE), "interaction_ols": (interaction_ols, INTERACTION),
    "fixed_effects_ols": (fixed_effects_ols, FIXED), "customer_effects_ols": (customer_effects_ols, CUSTOMER_EFFECTS), "two_effects_ols": (two_effects_ols, None), "hypothesis_statistics": (hypothesis_statistics, STATISTICS), "hypothesis_summary": (hypothesis_summary, None), "robustness_table": (robustness_table, None),
    "category_ranks": (category_ranks, CATEGORIES), "pearson_corr": (pearson_corr, PEARSON), "climate_terciles": (climate_terciles, TERCILES), "sector_year": (sector_year, SECTOR_YEAR), "extreme_rows": (extreme_rows, EXTREMES),
    "fold_summary": (fold_summary, FOLD_SUMMARY), "model_ranges": (model_ranges, None), "holdout_residuals": (holdout_residuals, None),
}
