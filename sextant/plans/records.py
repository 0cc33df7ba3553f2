"""Queries that assemble, describe and filter records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import binning, documents as D, joins, models, stats
from ..operators.selection import group_quantiles, per_group
from .texts import table

RANGES = [(1, 9, "small"), (10, 19, "medium"), (20, 34, "large"), (40, 50, "huge")]
_RANGES = ", ".join(str(r) for r in RANGES)


def _date(c):
    return F.to_date(c)


def assemble_wide(spark, sf_dir):
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    dims = c.join(n, c.c_nationkey == n.n_nationkey, "left").join(r, n.n_regionkey == r.r_regionkey, "left").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_acctbal", "n_name", "r_name")
    out = joins.assemble(o, (dims, ["o_custkey"], ["c_mktsegment", "c_acctbal", "n_name", "r_name"]))
    out = C.calendar_parts(out, "o_orderdate", "o_").withColumn("n_name", F.coalesce("n_name", F.lit("Unclassified")))
    return out.select(
        "o_orderkey", "o_year", "o_quarter", "o_month", "o_weekday", "c_mktsegment", "n_name", "r_name", C.presence(F.col("c_acctbal")).alias("has_balance"),
        C.flag(F.col("c_acctbal"), F.col("c_acctbal") > 0).alias("in_credit"), F.round(C.log_floor(F.col("c_acctbal")), 6).alias("log_balance"), F.round(C.ratio(F.col("c_acctbal"), F.col("o_totalprice")), 6).alias("balance_ratio"),
    )


ASSEMBLE = """select o_orderkey, year(o_orderdate)::int as o_year, quarter(o_orderdate)::int as o_quarter, month(o_orderdate)::int as o_month, (isodow(o_orderdate) - 1)::int as o_weekday, c_mktsegment, coalesce(n_name, 'Unclassified') as n_name, r_name,
  (c_acctbal is not null)::int as has_balance, (c_acctbal > 0)::int::double as in_credit, round(ln(case when c_acctbal is not null then greatest(c_acctbal, 0.01) end), 6) as log_balance, round(case when o_totalprice > 0 then c_acctbal / o_totalprice end, 6) as balance_ratio
from orders left join customer on o_custkey = c_custkey left join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey"""


def range_sector(spark, sf_dir):
    ranges = spark.createDataFrame(RANGES, "lo int, hi int, sector string")
    joins.assert_disjoint(ranges, "lo", "hi")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit(".0")).alias("code"))
    return joins.range_lookup(parts, ranges, "code", "lo", "hi", "sector").select("p_partkey", "sector")


RANGE = f"select p_partkey, coalesce(sector, 'Unclassified') as sector from part left join (values {_RANGES}) r(lo, hi, sector) on p_size between lo and hi"


def dedup_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts", "value")
    return joins.first_per_key(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", F.round("value", 6).alias("value"))


DEDUP = "select user_id, event_type, event_id, round(value, 6) as value from (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as k from events) where k = 1"


def anti_missing(spark, sf_dir):
    return joins.without_partner(table(spark, sf_dir, "documents").select("doc_id", "lang"), table(spark, sf_dir, "labels"), ["doc_id"])


ANTI = "select doc_id, lang from documents where doc_id not in (select doc_id from labels)"


def latest_before(spark, sf_dir):
    from ..operators.prices import latest_before as last

    o = table(spark, sf_dir, "orders")
    at = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.expr("timestamp_ntz'1998-06-01 00:00:00'").alias("at"))
    first, second = o.where("o_orderpriority in ('1-URGENT', '2-HIGH')"), o.where("o_orderpriority not in ('1-URGENT', '2-HIGH')")
    return last(at, first, "o_custkey", "at", "o_orderdate", ["o_orderkey"], second).select("o_custkey", F.coalesce("o_orderkey", F.lit(-1)).alias("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("filed"))


LATEST = """with b as (select o_custkey, o_orderpriority in ('1-URGENT', '2-HIGH') as p, max_by(struct_pack(k := o_orderkey, d := o_orderdate), struct_pack(d := o_orderdate, k := o_orderkey)) as f from orders where o_orderdate < timestamp '1998-06-01' group by all)
select c_custkey as o_custkey, coalesce(a.f.k, z.f.k, -1) as o_orderkey, strftime(coalesce(a.f.d, z.f.d), '%Y-%m-%d') as filed from customer left join b a on a.o_custkey = c_custkey and a.p left join b z on z.o_custkey = c_custkey and not z.p"""


def syndicate_summary(spark, sf_dir):
    l, s, n = (table(spark, sf_dir, t) for t in ("lineitem", "supplier", "nation"))
    rows = l.groupBy("l_orderkey", "l_suppkey").agg(F.min("l_linenumber").alias("at")).join(s, F.col("l_suppkey") == s.s_suppkey).join(n, s.s_nationkey == n.n_nationkey)
    ranked = rows.select("l_orderkey", (F.col("at") * F.lit(1_000_000) + F.col("l_suppkey")).cast("long").alias("at"), "s_name", F.when(F.col("n_regionkey") != 0, F.col("n_regionkey") + F.col("n_nationkey") % 5).cast("double").alias("rank"))
    out = D.syndicate(ranked, "l_orderkey", "at", "s_name", "rank")
    return out.withColumn("top_tier", C.flag(F.col("max_rank"), F.col("max_rank") >= 8))


SYNDICATE = """with m as (select l_orderkey, min(l_linenumber)::bigint * 1000000 + l_suppkey as pos, s_name, (case when n_regionkey <> 0 then n_regionkey + n_nationkey % 5 end)::double as rank
  from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey group by l_orderkey, l_suppkey, s_name, n_regionkey, n_nationkey)
select l_orderkey, first(s_name order by pos) as lead, string_agg(s_name, '; ' order by pos) as names, count(*) as n, max(rank) as max_rank, first(rank order by pos) as lead_rank, (max(rank) >= 8)::int::double as top_tier from m group by l_orderkey"""


def unpivot_ranks(spark, sf_dir):
    """Wide period columns to a row per year; sentinel -9 is missing, values are lowered by 0.001 and rounded."""
    n = table(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_regionkey") == 0, -9).otherwise(F.col("n_nationkey") % 9 + 0.001).alias("p1820"), F.when(F.col("n_nationkey") % 4 == 0, -9).otherwise(F.col("n_regionkey") + 0.501).alias("p2122"))
    years = F.map_from_arrays(F.array(F.lit("p1820"), F.lit("p2122")), F.array(F.array(F.lit(2018), F.lit(2019), F.lit(2020)), F.array(F.lit(2021), F.lit(2022))))
    long = n.unpivot(["n_name"], ["p1820", "p2122"], "source", "raw").withColumn("rank", F.round(F.nullif(F.col("raw"), F.lit(-9.0)) - 0.001, 2)).where("rank is not null")
    return long.select("n_name", "source", F.explode(F.element_at(years, F.col("source"))).alias("year"), "rank")


UNPIVOT = """with w as (select n_name, (case when n_regionkey = 0 then -9 else n_nationkey % 9 + 0.001 end)::double as p1820, (case when n_nationkey % 4 = 0 then -9 else n_regionkey + 0.501 end)::double as p2122 from nation),
l as (select n_name, 'p1820' as source, p1820 as raw, unnest([2018, 2019, 2020]) as year from w union all select n_name, 'p2122', p2122, unnest([2021, 2022]) from w)
select n_name, source, year, round(raw - 0.001, 2) as rank from l where raw <> -9"""


def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("sum_k"), F.count_if(F.nullif(F.trim(F.get_json_object("props", "$.missing")), F.lit("")).isNotNull()).alias("n_missing"))


JSON = "select event_type, count(*) as n, sum(json_extract_string(props, '$.k')::bigint)::bigint as sum_k, count(json_extract_string(props, '$.missing')) as n_missing from events group by event_type"


def sample_funnel(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    has, good = F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False))
    out = stats.funnel(d, [("all", F.lit(True)), ("text", F.col("text").isNotNull()), ("labelled", has), ("good", has & good), ("good and not toxic", has & good & (F.col("toxic") == 0)), ("long", has & good & (F.col("n_chars") > 1000))])
    return out.select(F.col("at").alias("pos"), "step", "n", "dropped", F.round("pct", 6).alias("pct"))


FUNNEL = """with d as (select * from documents left join labels using (doc_id)), s as (
  select 0 as pos, 'all' as step, count(*) as n from d union all select 1, 'text', count(text) from d union all select 2, 'labelled', count(quality) from d union all select 3, 'good', count(*) from d where quality = 1
  union all select 4, 'good and not toxic', count(*) from d where quality = 1 and toxic = 0 union all select 5, 'long', count(*) from d where quality = 1 and n_chars > 1000)
select pos, step, n, coalesce(lag(n) over (order by pos) - n, 0) as dropped, round(100 * n / first_value(n) over (order by pos), 6) as pct from s"""


def sector_coverage(spark, sf_dir):
    return stats.counts_with_share(table(spark, sf_dir, "documents"), "lang").select("lang", "n", F.round("pct", 6).alias("pct"))


COVERAGE = "select lang, count(*) as n, round(100 * count(*) / sum(count(*)) over (), 6) as pct from documents group by lang"


def descriptive_by_group(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    groups = o.select("o_totalprice", F.explode(F.array(F.lit("all"), F.year("o_orderdate").cast("string"), F.concat(F.lit("status "), "o_orderstatus"))).alias("grp"))
    out = stats.summary(groups.withColumn("x", F.col("o_totalprice") - 150_000), ["grp"], "x")
    return out.select("grp", "n", *[F.round(c, 4).alias(c) for c in ("median", "mean", "std", "p25", "p75", "min", "max", "share_positive")])


DESCRIPTIVE = """with g as (select o_totalprice - 150000 as x, unnest(['all', year(o_orderdate)::varchar, 'status ' || o_orderstatus]) as grp from orders)
select grp, count(*) as n, round(quantile_cont(x, 0.5), 4) as median, round(avg(x), 4) as mean, round(stddev_samp(x), 4) as std, round(quantile_cont(x, 0.25), 4) as p25, round(quantile_cont(x, 0.75), 4) as p75, round(min(x), 4) as min, round(max(x), 4) as max, round(avg((x > 0)::int), 4) as share_positive from g group by grp"""


def pivot_median_year(spark, sf_dir):
    """Medians by priority and year in long form, cells of fewer than five rows left out, groups ordered by their totals."""
    o = table(spark, sf_dir, "orders")
    cells = group_quantiles(o.withColumn("year", F.year("o_orderdate")), ["o_orderpriority", "year"], "o_totalprice", [0.5]).withColumn("median", F.col("q")[0])
    totals = o.groupBy("o_orderpriority").agg(F.count("*").alias("total"))
    return cells.join(totals, "o_orderpriority").where("n >= 5").select("o_orderpriority", "year", F.round("median", 4).alias("median"), "n", "total")


PIVOT = "select o_orderpriority, year(o_orderdate)::int as year, round(quantile_cont(o_totalprice, 0.5), 4) as median, count(*) as n, any_value(t) as total from orders join (select o_orderpriority as p, count(*) as t from orders group by 1) on p = o_orderpriority group by o_orderpriority, year(o_orderdate) having count(*) >= 5"


def quantile_bins(spark, sf_dir):
    out = binning.qcut(table(spark, sf_dir, "lineitem"), "l_quantity", 5, "bin")
    mid = group_quantiles(out, ["bin"], "l_extendedprice", [0.5]).select("bin", F.round(F.col("q")[0], 4).alias("median_price"))
    return per_group(out.groupBy("bin").agg(F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi")), mid, ["bin"], how="left")


BINS = """with e as (select distinct unnest(quantile_cont(l_quantity, [0, 0.2, 0.4, 0.6, 0.8, 1.0])) as edge from lineitem),
b as (select *, greatest((select count(*) from e where edge < l_quantity) - 1, 0)::int as bin from lineitem)
select bin, count(*) as n, min(l_quantity) as lo, max(l_quantity) as hi, round(quantile_cont(l_extendedprice, 0.5), 4) as median_price from b group by bin"""


def winsorise_clip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    train = o.where("o_orderdate < timestamp_ntz'1998-01-01 00:00:00'")
    return binning.winsorise(o, "o_totalprice", "clipped", train=train).select("o_orderkey", F.round("clipped", 4).alias("clipped"))


WINSOR = "with q as (select quantile_cont(o_totalprice, 0.01) as a, quantile_cont(o_totalprice, 0.99) as b from orders where o_orderdate < timestamp '1998-01-01') select o_orderkey, round(least(greatest(o_totalprice, a), b), 4) as clipped from orders, q"


def trim_central(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return binning.trim(o, "o_totalprice").select("o_orderkey", "o_totalprice")


TRIM = "with q as (select quantile_cont(o_totalprice, 0.05) as a, quantile_cont(o_totalprice, 0.95) as b from orders) select o_orderkey, o_totalprice from orders, q where o_totalprice between a and b"


def histogram(spark, sf_dir):
    return binning.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 60)


HISTOGRAM = "with q as (select min(o_totalprice) as a, max(o_totalprice) as b from orders) select least(floor((o_totalprice - a) / ((b - a) / 60)) + 1, 60)::int as bin, count(*) as n from orders, q group by 1"


def feature_coverage(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("constant", F.lit(1))
    out = models.coverage(d, ["lang", "source", "n_chars", "quality", "toxic", "constant"])
    return out.select("feature", F.round("coverage", 6).alias("coverage"), "n_distinct", ((F.col("coverage") >= 0.3) & (F.col("n_distinct") >= 2)).alias("used"))


FEATURES = "with d as (select *, 1 as constant from documents left join labels using (doc_id)), f as (" + " union all ".join(f"select '{c}' as feature, count({c}) / count(*) as coverage, count(distinct {c}) as n_distinct from d" for c in ("lang", "source", "n_chars", "quality", "toxic", "constant")) + ") select feature, round(coverage, 6) as coverage, n_distinct, coverage >= 0.3 and n_distinct >= 2 as used from f"


def typed_columns(spark, sf_dir):
    """Numbers and dates read back from text, synonyms renamed, a product where it is absent, flags to rows."""
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("Symbol"), F.concat(F.lit("$"), F.format_number("o_totalprice", 2)).alias("IPO Price"), F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("IPO Date"), (F.col("o_custkey") % 100).alias("Shares"),
    )
    t = C.rename_synonyms(raw, {"Symbol": "ticker", "Ticker": "ticker", "IPO Price": "offer_price", "Price": "offer_price", "IPO Date": "ipo_date", "Shares": "shares"})
    t = t.withColumn("offer_price", C.number(F.col("offer_price"))).withColumn("ipo_date", C.date(F.col("ipo_date")))
    return t.select("ticker", "offer_price", F.date_format("ipo_date", "yyyy-MM-dd").alias("ipo_date"), F.round(F.col("offer_price") * F.col("shares") / 1e6, 9).alias("size_m"))


TYPED = "select o_orderkey::varchar as ticker, round(o_totalprice, 2) as offer_price, case when o_orderkey % 7 <> 0 then strftime(o_orderdate, '%Y-%m-%d') end as ipo_date, round(round(o_totalprice, 2) * (o_custkey % 100) / 1e6, 9) as size_m from orders"

QUERIES = {
    "assemble_wide": (assemble_wide, ASSEMBLE), "range_sector": (range_sector, RANGE), "dedup_first": (dedup_first, DEDUP), "anti_missing": (anti_missing, ANTI), "latest_before": (latest_before, LATEST),
    "syndicate_summary": (syndicate_summary, SYNDICATE), "unpivot_ranks": (unpivot_ranks, UNPIVOT), "json_props": (json_props, JSON), "sample_funnel": (sample_funnel, FUNNEL), "sector_coverage": (sector_coverage, COVERAGE),
    "descriptive_by_group": (descriptive_by_group, DESCRIPTIVE), "pivot_median_year": (pivot_median_year, PIVOT), "quantile_bins": (quantile_bins, BINS), "winsorise_clip": (winsorise_clip, WINSOR), "trim_central": (trim_central, TRIM),
    "histogram": (histogram, HISTOGRAM), "feature_coverage": (feature_coverage, FEATURES), "typed_columns": (typed_columns, TYPED),
}
