"""Queries of the statistics and model operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..operators import attribution, binning, boosting, models, stats
from .texts import table


def _row(spark, values: dict, digits: int = 6):
    """One row of named statistics."""
    names = list(values)
    kinds = {int: "long", float: "double", str: "string", bool: "boolean"}
    cells = [None if values[n] is None else round(float(values[n]), digits) if isinstance(values[n], float) or hasattr(values[n], "dtype") else values[n] for n in names]
    return spark.createDataFrame([tuple(cells)], ", ".join(f"{n} {kinds.get(type(c), 'double')}" for n, c in zip(names, cells)))


def _line(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_discount", "l_tax")


_RANK = "rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0"


def avg_rank_corr(spark, sf_dir):
    rho, p, n = stats.spearman(_line(spark, sf_dir), "l_quantity", "l_extendedprice")
    return _row(spark, {"rho": rho, "n": n})


RANK_CORR = f"with r as (select {_RANK.format('l_quantity')} as a, {_RANK.format('l_extendedprice')} as b from lineitem) select round(corr(a, b), 6) as rho, count(*) as n from r"


def partial_rank_corr(spark, sf_dir):
    out = stats.partial_spearman(_line(spark, sf_dir), "l_extendedprice", "l_discount", ["l_quantity"])
    return _row(spark, {k: out[k] for k in ("r", "n", "ci_low", "ci_high")})


PARTIAL = f"""with r as (select {_RANK.format('l_extendedprice')} as x, {_RANK.format('l_discount')} as y, {_RANK.format('l_quantity')} as z from lineitem),
c as (select corr(x, y) as xy, corr(x, z) as xz, corr(y, z) as yz, count(*) as n from r), p as (select (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) as r, n from c),
f as (select r, n, 0.5 * ln((1 + r) / (1 - r)) as z, 1.96 / sqrt(n - 4) as h from p)
select round(r, 6) as r, n, round((exp(2 * (z - h)) - 1) / (exp(2 * (z - h)) + 1), 6) as ci_low, round((exp(2 * (z + h)) - 1) / (exp(2 * (z + h)) + 1), 6) as ci_high from f"""


def corr_matrix_long(spark, sf_dir):
    return stats.correlations(_line(spark, sf_dir), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]).select("a", "b", F.round("r", 6).alias("r"), "n")


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CORR = " union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r, count(*) as n from lineitem" for i, a in enumerate(_COLS) for b in _COLS[i:])


def selection_compare(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("in")), "doc_id", "left").withColumn("in", F.coalesce("in", F.lit(0)))
    d = d.withColumn("lines", F.size(F.split("text", "\n")).cast("double")).withColumn("stops", F.regexp_count("text", F.lit("[.]")).cast("double")).withColumn("n_chars", F.col("n_chars").cast("double"))
    rows = stats.welch(d, "in", ["n_chars", "lines", "stops"])
    return spark.createDataFrame([(r["observable"], round(r["in_sample"], 6), round(r["out_of_sample"], 6), round(r["statistic"], 6), r["n_in"], r["n_out"]) for r in rows], "observable string, in_sample double, out_of_sample double, statistic double, n_in long, n_out long")


SELECTION = """with d as (select n_chars::double as n_chars, len(string_split(text, chr(10)))::double as lines, len(regexp_extract_all(text, '[.]'))::double as stops, l.doc_id is not null as i from documents left join labels l using (doc_id)), v as (
  select unnest(['n_chars', 'lines', 'stops']) as observable, unnest([n_chars, lines, stops]) as x, i from d), s as (
  select observable, avg(x) filter (where i) as m1, avg(x) filter (where not i) as m0, var_samp(x) filter (where i) as v1, var_samp(x) filter (where not i) as v0, count(*) filter (where i) as n1, count(*) filter (where not i) as n0 from v group by 1)
select observable, round(m1, 6) as in_sample, round(m0, 6) as out_of_sample, round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) as statistic, n1 as n_in, n0 as n_out from s"""


def kruskal(spark, sf_dir):
    out = stats.kruskal(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), "l_returnflag", "l_quantity")
    return _row(spark, {k: out[k] for k in ("statistic", "p", "groups", "n")})


# three groups: the chi-square law with two degrees of freedom is exponential
KRUSKAL = f"""with r as (select l_returnflag as g, l_quantity as x, {_RANK.format('l_quantity')} as r from lineitem), s as (select g, count(*) as n, sum(r) as s from r group by 1), t as (select sum(t * t * t - t) as t from (select count(*)::double as t from r group by x)),
n as (select sum(n)::double as n from s),
h as (select (12 / (n.n * (n.n + 1)) * (select sum(s * s / n) from s) - 3 * (n.n + 1)) / (1 - t.t / (n.n * n.n * n.n - n.n)) as h, (select count(*) from s) as groups, n.n::bigint as n from n, t)
select round(h, 6) as statistic, round(exp(-h / 2), 6) as p, groups, n from h"""


def levene(spark, sf_dir):
    out = stats.levene(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice")
    return _row(spark, {k: out[k] for k in ("statistic", "groups", "n")})


LEVENE = """with m as (select o_orderpriority as g, median(o_totalprice) as m from orders group by 1), z as (select g, abs(o_totalprice - m) as z from orders join m on g = o_orderpriority),
s as (select g, count(*) as n, avg(z) as a, var_pop(z) as v from z group by 1), a as (select avg(z) as m, count(*) as n from z)
select round((any_value(a.n) - count(*)) / (count(*) - 1) * sum(s.n * (s.a - a.m) * (s.a - a.m)) / sum(s.n * s.v), 6) as statistic, count(*) as groups, any_value(a.n) as n from s, a"""


def fligner(spark, sf_dir):
    return _row(spark, stats.fligner(table(spark, sf_dir, "orders").select("o_orderpriority", "o_totalprice"), "o_orderpriority", "o_totalprice"), 5)


def _normal_quantile(p: str) -> str:
    """The inverse normal law for p of at least a half, by a rational approximation (relative error 1e-9)."""
    # fixed values: the approximation's published coefficients
    a = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
    b = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
    c = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
    d = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)

    def horner(coefficients, x):
        out = f"({coefficients[0]!r})"
        for k in coefficients[1:]:
            out = f"({out} * {x} + ({k!r}))"
        return out

    r, q = f"(({p} - 0.5) * ({p} - 0.5))", f"sqrt(-2 * ln(1 - {p}))"
    return f"case when {p} <= 0.97575 then {horner(a, r)} * ({p} - 0.5) / {horner(b, r)} else -{horner(c, q)} / {horner(d, q)} end"


# five groups: the chi-square law with four degrees of freedom has a closed upper tail
FLIGNER = f"""with m as (select o_orderpriority as g, median(o_totalprice) as m from orders group by 1), z as (select g, abs(o_totalprice - m) as z from orders join m on g = o_orderpriority),
r as (select g, ({_RANK.format('z')}) as r, count(*) over () as n from z), p as (select g, 0.5::double + r::double / (2 * (n + 1)) as p from r), a as (select g, {_normal_quantile('p')} as a from p),
t as (select avg(a) as m, var_samp(a) as v, count(*) as n from a), s as (select g, count(*) as n, avg(a) as a from a group by g),
x as (select sum(s.n * (s.a - t.m) * (s.a - t.m)) / any_value(t.v) as x, count(*) as k, any_value(t.n) as n from s, t)
select round(x, 5) as statistic, round(exp(-x / 2) * (1 + x / 2), 5) as p, k as groups, n from x"""


def dispersion(spark, sf_dir):
    out = stats.spread(table(spark, sf_dir, "events"), ["event_type"], "value")
    return out.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("std", "iqr", "mad")])


DISPERSION = "select event_type, count(*) as n, round(stddev_samp(value), 6) as std, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 6) as iqr, round(mad(value), 6) as mad from events group by 1"


def ols_beta(spark, sf_dir):
    d = _line(spark, sf_dir).select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_quantity").alias("x"))
    out = stats.ols(d, "y", ["x"])
    return _row(spark, {"const": out["beta"][0], "slope": out["beta"][1], "se": out["se"][1], "r2": out["r2"], "n": out["n"]})


OLS = """with d as (select l_extendedprice / 1000 as y, l_quantity as x from lineitem), b as (select regr_slope(y, x) as b, regr_intercept(y, x) as a, regr_r2(y, x) as r2, avg(x) as m, sum(x * x) - count(*) * avg(x) * avg(x) as sxx, count(*) as n from d),
e as (select (y - a - b.b * x) / (1 - (1.0 / n + (x - m) * (x - m) / sxx)) as u, x - m as c from d, b)
select round(a, 6) as const, round(b.b, 6) as slope, round(sqrt((select sum(u * u * c * c) from e)) / sxx, 6) as se, round(r2, 6) as r2, n from b"""


def lr_nested_ols(spark, sf_dir):
    d = _line(spark, sf_dir).select((F.col("l_extendedprice") / 1000).alias("y"), F.col("l_discount").alias("x"))
    out = stats.likelihood_ratio(d, "y", [], ["x"])
    return _row(spark, {"statistic": out["statistic"], "dof": out["dof"], "n": out["n"], "delta_aic": out["delta_aic"]}, 5)


LR = "with r as (select regr_r2(l_extendedprice / 1000, l_discount) as r2, count(*) as n from lineitem) select round(-n * ln(1 - r2), 5) as statistic, 1::bigint as dof, n, round(2 + n * ln(1 - r2), 5) as delta_aic from r"


def bh_adjust(spark, sf_dir):
    """A test for each nation whether its customers' and suppliers' balances differ from all others', adjusted as one family.

    The sum of two independent squared normal scores has an exponential upper tail. Nations without two of a kind have no test.
    """
    nations = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("test"))
    x = F.lit(0.0)
    for name, key, balance in (("customer", "c_nationkey", "c_acctbal"), ("supplier", "s_nationkey", "s_acctbal")):
        rows = table(spark, sf_dir, name)
        per = rows.groupBy(F.col(key).alias("n_nationkey")).agg(F.avg(balance).alias(f"{name}_mean"), F.stddev_samp(balance).alias(f"{name}_std"), F.count("*").alias(f"{name}_n"))
        mean = rows.agg(F.avg(balance)).first()[0]
        nations = nations.join(per, "n_nationkey", "left")
        x = x + F.pow((F.col(f"{name}_mean") - float(mean)) / F.nullif(F.col(f"{name}_std"), F.lit(0.0)) * F.sqrt(f"{name}_n"), F.lit(2.0))
    out = stats.adjust(nations.select("test", F.exp(-x / 2).alias("p")), "test", "p")
    return out.select("test", *[F.round(c, 6).alias(c) for c in ("p", "p_bonferroni", "p_bh")], F.coalesce(F.col("p_bh") < 0.05, F.lit(False)).alias("significant"))


def _score(t: str, key: str, x: str) -> str:
    return f"select {key} as n_nationkey, pow((avg({x}) - (select avg({x}) from {t})) / nullif(stddev_samp({x}), 0) * sqrt(count(*)), 2) as x from {t} group by 1"


BH = f"""with t as (select n_name as test, exp(-(c.x + s.x) / 2) as p from nation left join ({_score('customer', 'c_nationkey', 'c_acctbal')}) c using (n_nationkey) left join ({_score('supplier', 's_nationkey', 's_acctbal')}) s using (n_nationkey)),
r as (select *, count(p) over () as m, row_number() over (order by p nulls last, test) as k from t),
b as (select *, min(p * m / k) over (order by k desc rows between unbounded preceding and current row) as q from r where p is not null)
select t.test, round(t.p, 6) as p, round(case when b.p is not null then least(b.p * b.m, 1) end, 6) as p_bonferroni, round(case when q is not null then least(q, 1) end, 6) as p_bh, coalesce(q < 0.05, false) as significant from t left join b on b.test = t.test"""


def bootstrap_medians(spark, sf_dir):
    return stats.bootstrap(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


def _deals(spark, sf_dir):
    """An order a row, as a table of the shared folder: models read it many times."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return scratch.write(o.join(c, o.o_custkey == c.c_custkey).select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 1000).alias("y"), "c_acctbal", F.month("o_orderdate").cast("double").alias("month"), "o_orderpriority", "c_mktsegment"))


def ts_folds(spark, sf_dir):
    o = models.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"])
    folds = models.time_folds(o.count(), 5)
    parts = [o.agg(F.lit(i).alias("fold"), F.count_if(F.col("pos") < n).alias("n_train"), F.count_if((F.col("pos") >= n) & (F.col("pos") < n + t)).alias("n_test"), F.sum(F.when((F.col("pos") >= n) & (F.col("pos") < n + t), F.col("o_orderkey"))).alias("key_sum")) for i, n, t in folds]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


FOLDS = """with o as (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders), f as (select unnest([1, 2, 3, 4, 5]) as fold)
select fold, count(*) filter (where pos < n - (6 - fold) * (n // 6)) as n_train, count(*) filter (where pos >= n - (6 - fold) * (n // 6) and pos < n - (5 - fold) * (n // 6)) as n_test,
  (sum(o_orderkey) filter (where pos >= n - (6 - fold) * (n // 6) and pos < n - (5 - fold) * (n // 6)))::bigint as key_sum from o, f group by fold"""


def fold_baselines(spark, sf_dir):
    """Error of the training mean and median in each fold."""
    rows = models.with_position(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_totalprice") / 1000).alias("y")), ["o_orderdate", "o_orderkey"])
    return models.baselines(rows, "y", 5).select("fold", *[F.round(m, 6).alias(f"mae_{m}") for m in ("mean", "median")])


BASELINES = """with o as (select o_totalprice / 1000 as y, row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, count(*) over () as n from orders), f as (select unnest([1, 2, 3, 4, 5]) as fold),
b as (select fold, avg(y) as m, median(y) as d from o, f where pos < n - (6 - fold) * (n // 6) group by 1)
select fold, round(avg(abs(y - m)), 6) as mae_mean, round(avg(abs(y - d)), 6) as mae_median from o, b where pos >= n - (6 - fold) * (n // 6) and pos < n - (5 - fold) * (n // 6) group by 1"""


def ridge_cv(spark, sf_dir):
    return models.cross_validate(_deals(spark, sf_dir), "y", ["o_orderdate", "o_orderkey"], ["c_acctbal", "month"], ["o_orderpriority"])


def holdout(spark, sf_dir):
    return models.holdout(_deals(spark, sf_dir), "y", "o_orderdate", "2000-01-01", ["c_acctbal", "month"], ["o_orderpriority"])


def tree_importance(spark, sf_dir):
    return models.importances(_deals(spark, sf_dir), "y", ["c_acctbal", "month"], ["o_orderpriority", "c_mktsegment"])


def attributions(spark, sf_dir):
    """Mean absolute attribution of each feature over all deals, in the forest that tree_importance fits."""
    deals = _deals(spark, sf_dir)
    (rows,), xs = models.prepare(deals, [deals], ["c_acctbal", "month"], ["o_orderpriority", "c_mktsegment"])
    rows = scratch.write(rows.select("y", *xs))
    forest = models.fit_trees(rows, "y", xs, boosted=False)["forest"]
    return attribution.mean_attributions(rows, xs, attribution.paths(forest))


def boosted_leafwise(spark, sf_dir):
    """Trees grown leaf by leaf on the deals before a day, tested on those from it on. 200 trees of 31 leaves, the operator's default."""
    deals = _deals(spark, sf_dir).where("y is not null")
    train, test = (deals.where(c) for c in ("o_orderdate < '2000-01-01'", "o_orderdate >= '2000-01-01'"))
    (a, b), xs = models.prepare(train, [train, test], ["c_acctbal", "month"], ["o_orderpriority"])
    fitted = boosting.boost(a, "y", xs)
    return stats.evaluate(fitted.predict(b.select("y", *xs)), "y", "prediction")


QUERIES = {
    "avg_rank_corr": (avg_rank_corr, RANK_CORR), "partial_rank_corr": (partial_rank_corr, PARTIAL), "corr_matrix_long": (corr_matrix_long, CORR), "selection_compare": (selection_compare, SELECTION), "kruskal": (kruskal, KRUSKAL),
    "levene": (levene, LEVENE), "fligner": (fligner, FLIGNER), "dispersion": (dispersion, DISPERSION), "ols_beta": (ols_beta, OLS), "lr_nested_ols": (lr_nested_ols, LR), "bh_adjust": (bh_adjust, BH),
    "bootstrap_medians": (bootstrap_medians, None), "ts_folds": (ts_folds, FOLDS), "fold_baselines": (fold_baselines, BASELINES), "ridge_cv": (ridge_cv, None), "holdout": (holdout, None), "tree_importance": (tree_importance, None),
    "attributions": (attributions, None), "boosted_leafwise": (boosted_leafwise, None),
}
