"""Queries of gates, provenance, flags and scores, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import columns as C
from ..operators import documents as D, joins, models, stats
from ..sources import sinks
from .texts import table


def provenance(spark, sf_dir):
    """Nations written as CSV, and what the sidecar beside the table says of them."""
    path = scratch.new_folder(spark) + "/nations"
    sinks.write_table(table(spark, sf_dir, "nation"), path, "nations of the benchmark", "provenance", [f"{sf_dir}/nation.parquet"])
    meta = spark.read.option("multiLine", True).json(path + ".meta.json")
    return meta.select("description", "command", F.col("rows").cast("long").alias("rows"), F.length("input_sha256").cast("long").alias("hash_length"), F.size("inputs").cast("long").alias("n_inputs"))


PROVENANCE = "select 'nations of the benchmark' as description, 'provenance' as command, count(*) as rows, 64::bigint as hash_length, 1::bigint as n_inputs from nation"


def claims_checked(spark, sf_dir):
    """What a text says of each region's nations, held against the table; some claims are wrong by one, and one is not in the text."""
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    per = nations.groupBy("r_name", "r_regionkey").agg(F.count("*").cast("double").alias("nations"))
    tables = per.select(F.col("r_name").alias("key"), F.lit("nations").alias("column"), F.col("nations").alias("value"))
    claims = per.select(
        F.concat("r_name", F.lit(" has nations")).alias("claim"), F.concat((F.col("nations") + F.when(F.col("r_regionkey") % 3 == 2, 1).otherwise(0)).cast("long").cast("string"), F.lit(" nations of "), "r_name").alias("literal"),
        F.col("r_name").alias("key"), F.lit("nations").alias("column"), F.lit(0.5).alias("tolerance"), F.lit(0).alias("percent"),
    )
    prose = ". ".join(r.literal for r in claims.where("key <> 'ASIA'").orderBy("key").collect())  # a sentence a region
    return sinks.check_claims(claims, tables, prose)


CLAIMS = """with p as (select r_name, r_regionkey, count(*) as n from nation join region on n_regionkey = r_regionkey group by all)
select r_name || ' has nations' as claim, r_name <> 'ASIA' as literal_found, n::double as actual, r_name <> 'ASIA' and r_regionkey % 3 <> 2 as ok from p"""


def value_at_year(spark, sf_dir):
    """Each order with its customer's number of orders in the year before."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), (F.year("o_orderdate") - 1).alias("year"))
    before = o.groupBy("customer", (F.col("year") + 1).alias("year")).agg(F.count("*").alias("n"))
    return joins.value_at(o, before, "customer", "year", "n").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


VALUE_AT = "with c as (select o_custkey, year(o_orderdate) as y, count(*) as n from orders group by all) select o_orderkey, coalesce(n, 0) as n from orders o left join c on c.o_custkey = o.o_custkey and c.y = year(o_orderdate) - 1"


def flags(spark, sf_dir):
    """Codes as flags, whether any is set, a key without blanks and case, and a product for a table that lacks it."""
    c = table(spark, sf_dir, "customer").withColumn("code", F.nullif(F.col("c_nationkey"), F.lit(3)))
    c = C.product_if_absent(c.withColumns(C.code_flags(F.col("code"), {0: "is_zero", 7: "is_seven"})), "weight", "c_acctbal", "c_nationkey", 1e3)
    return c.select("c_custkey", "is_zero", "is_seven", C.any_flag(["is_zero", "is_seven"]).alias("any"), C.key(F.concat(F.lit("  "), F.lower("c_name"), F.lit(" "))).alias("key"), F.round("weight", 5).alias("weight"))


FLAGS = "select c_custkey, (c_nationkey = 0)::int as is_zero, (c_nationkey = 7)::int as is_seven, c_nationkey in (0, 7) as any, upper(c_name) as key, round(c_acctbal * c_nationkey / 1000, 5) + 0 as weight from customer"


def naive_scores(spark, sf_dir):
    """How well an order's value is told by the line items' mean value, times their number; by priority a mean would be told exactly."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    mean = table(spark, sf_dir, "lineitem").agg(F.avg("l_extendedprice")).first()[0]
    rows = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_totalprice") / 1000).alias("y"), (F.col("n") * float(mean) / 1000).alias("yhat"))
    return stats.evaluate(rows, "y", "yhat").select("n", *[F.round(c, 6).alias(c) for c in ("r2", "rmse", "mae")])


SCORES = """with l as (select l_orderkey, count(*) as n from lineitem group by 1), r as (select o_totalprice / 1000 as y, n * (select avg(l_extendedprice) from lineitem) / 1000 as h from orders join l on l_orderkey = o_orderkey)
select count(*) as n, round(1 - sum((y - h) * (y - h)) / (var_pop(y) * count(*)), 6) as r2, round(sqrt(avg((y - h) * (y - h))), 6) as rmse, round(avg(abs(y - h)), 6) as mae from r"""


def feature_decisions(spark, sf_dir):
    """What becomes of each candidate column: known too seldom, constant, or used as number or category."""
    o = table(spark, sf_dir, "orders").withColumns({"seldom": F.when(F.col("o_orderkey") % 10 == 0, F.col("o_totalprice")), "same": F.lit(1.0), "gone": F.lit(None).cast("string")})
    found = models.select_features(o, ["o_totalprice", "o_orderpriority", "seldom", "same", "gone", "absent"])
    return spark.createDataFrame(sorted(found.decision.items()), "feature string, decision string")


DECISIONS = """select * from (values ('o_totalprice', 'numeric'), ('o_orderpriority', 'categorical'), ('gone', 'missing')) t(feature, decision)
union all select 'seldom', case when avg((o_orderkey % 10 = 0)::int) < 0.3 then 'missing' else 'numeric' end from orders union all select 'same', case when count(distinct 1) < 2 then 'constant' end from orders"""


def coverage_of_sections(spark, sf_dir):
    """How many filings made of documents have each section; short sections do not count."""
    page = lambda heading, body: [F.lit(f"\nTable of Contents\n{heading}\n"), body]
    filing = F.concat(*page("PROSPECTUS SUMMARY", F.lit("With us.")), *page("RISK FACTORS", F.col("text")), *[x for h in ("USE OF PROCEEDS", "DIVIDEND POLICY", "LEGAL MATTERS") for x in page(h, F.lit("And none."))])
    out = D.section_coverage(table(spark, sf_dir, "documents").select(filing.alias("filing")), "filing", ["risk_factors", "use_of_proceeds"])
    return out.select(*[F.col(c).cast("long").alias(c) for c in out.columns])


COVERAGE = r"""with t as (select length(regexp_replace('RISK FACTORS' || chr(10) || text || chr(10) || 'Table of Contents', '\s+$', '')) as n from documents where text is not null)
select count(*) as documents, count(*) filter (where n >= 500) as risk_factors, 0::bigint as use_of_proceeds, count(*) filter (where n < 500) as no_sections from t"""


def missing_names(spark, sf_dir):
    """Nations that a list of those with suppliers lacks, and names on the list that are no nation."""
    names = [r[0] for r in table(spark, sf_dir, "nation").select("n_name").orderBy("n_name").collect()]  # a fixed dimension
    present = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("n_nationkey % 4 <> 1").select(F.when(F.col("n_nationkey") == 2, "Atlantis").otherwise(F.col("n_name")).alias("name"))
    missing, extra = sinks.missing_and_extra(spark, names, present, "name")
    return spark.createDataFrame([("missing", n) for n in missing] + [("extra", n) for n in extra], "kind string, name string")


MISSING = """with p as (select distinct case when n_nationkey = 2 then 'Atlantis' else n_name end as name from supplier join nation on s_nationkey = n_nationkey where n_nationkey % 4 <> 1)
select 'missing' as kind, n_name as name from nation where n_name not in (select name from p) union all select 'extra', name from p where name not in (select n_name from nation)"""

QUERIES = {
    "provenance": (provenance, PROVENANCE), "claims_checked": (claims_checked, CLAIMS), "value_at_year": (value_at_year, VALUE_AT), "flags": (flags, FLAGS), "naive_scores": (naive_scores, SCORES),
    "feature_decisions": (feature_decisions, DECISIONS), "coverage_of_sections": (coverage_of_sections, COVERAGE), "missing_names": (missing_names, MISSING),
}
