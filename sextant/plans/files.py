"""Queries of the readers and writers, with their SQL. Files go to the folder that all executors share."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import scratch
from ..functions import columns as C
from ..sources import readers, sinks
from .texts import table


def csv_typed(spark, sf_dir):
    """Customers written as CSV with provenance and read back by name and type."""
    path = scratch.new_folder(spark) + "/customers"
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_nationkey")
    sinks.write_table(rows, path, "customers", "csv_typed")
    return readers.csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_nationkey int")


CSV = "select c_custkey, c_name, c_acctbal, c_nationkey::int as c_nationkey from customer"


def text_files(spark, sf_dir):
    """A text file for each nation, one more of a kind for some, joined back to the table; a missing file is ''."""
    folder = scratch.new_folder(spark)
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_regionkey").cast("string").alias("tag"), "n_name")
    name = F.concat("key", F.lit("_"), "tag")
    extra = nations.where("tag = '1'").select(F.concat(name, F.lit("_mda")).alias("name"), F.lower("n_name").alias("text"))
    sinks.write_texts(nations.select(name.alias("name"), F.col("n_name").alias("text")).union(extra), folder, "name", "text")
    files = readers.text_files(spark, folder, ("_mda",))
    out = readers.with_texts(nations, files, "key", "tag", {"full": "full_text", "mda": "mda_text"})
    return readers.read_status(out.withColumn("mda_text", F.nullif("mda_text", F.lit(""))), "mda_text")


TEXTS = """select 'N' || n_nationkey as key, n_regionkey::varchar as tag, n_name, n_name as full_text, case when n_regionkey = 1 then lower(n_name) end as mda_text,
  case when n_regionkey = 1 then 'ok' else 'missing' end as status from nation"""


def html_rows(spark, sf_dir):
    """A page for each region with a table of its nations, read back as rows."""
    cell = lambda x: F.concat(F.lit("<td> "), x, F.lit(" </td>"))
    line = F.concat(F.lit("<tr>"), cell(F.col("n_nationkey").cast("string")), cell(F.col("n_name")), F.lit("</tr>"))
    pages = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", line.alias("l")))), lambda x: x["l"]), "").alias("b"))
    html = F.concat(F.lit("<table><tr><td>no</td></tr></table><table id='main-table'><thead><tr><th>id</th><th>name</th></tr></thead>"), "b", F.lit("</table>"))
    rows = readers.html_tables(pages.withColumn("html", html), ["n_regionkey"], "html")
    return rows.select("n_regionkey", "row", F.element_at("cells", "id").alias("id"), F.element_at("cells", "name").alias("name"))


HTML = "select n_regionkey, row_number() over (partition by n_regionkey order by n_nationkey) - 1 as row, n_nationkey::varchar as id, n_name as name from nation"


def ticker_ids(spark, sf_dir):
    """Numbered JSON records of suppliers, an object for each nation, to (ticker, cik)."""
    record = F.struct(F.col("s_suppkey").cast("string").alias("k"), F.struct(F.col("s_suppkey").alias("cik_str"), F.concat(F.lit(" t"), F.col("s_suppkey").cast("string")).alias("ticker")).alias("v"))
    raw = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(record))).alias("body"))
    return readers.ticker_ids(raw, "body")


TICKERS = "select 'T' || s_suppkey as ticker, lpad(s_suppkey::varchar, 10, '0') as cik from supplier"


def parallel_arrays(spark, sf_dir):
    """JSON with arrays side by side, a row a position, up to the shortest."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("k"))
    body = F.to_json(F.struct(F.struct(F.col("k").alias("ids"), F.slice(F.transform("k", lambda x: x * 10), 1, 3).alias("tens")).alias("recent")))
    return readers.parallel_arrays(rows.select("n_regionkey", body.alias("body")), ["n_regionkey"], "body", ["ids", "tens"], "$.recent")


ARRAYS = "select n_regionkey, n_nationkey::varchar as ids, (n_nationkey * 10)::varchar as tens from (select *, row_number() over (partition by n_regionkey order by n_nationkey) as k from nation) where k <= 3"


def two_series(spark, sf_dir):
    """Daily order values of two statuses side by side."""
    daily = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderstatus").agg(F.count("*").alias("n"))
    one = lambda s, name: daily.where(F.col("o_orderstatus") == s).select("day", F.col("n").alias(name))
    return readers.two_series(one("F", "finished"), one("O", "open"), "day")


SERIES = """select strftime(o_orderdate, '%Y-%m-%d') as day, nullif(count(*) filter (where o_orderstatus = 'F'), 0) as finished, nullif(count(*) filter (where o_orderstatus = 'O'), 0) as open from orders
where o_orderstatus in ('F', 'O') group by 1"""


def full_and_sample(spark, sf_dir):
    """Orders written whole and as a sample by a condition that keeps nulls; the rows of both tables."""
    folder = scratch.new_folder(spark)
    rows = table(spark, sf_dir, "orders").withColumn("kind", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey") % 3))
    n, m = sinks.write_pair(rows, folder + "/all", folder + "/sample", C.not_equal(F.col("kind"), 1))
    return spark.createDataFrame([("all", n), ("sample", m)], "kind string, n long")


PAIR = "select 'all' as kind, count(*) as n from orders union all select 'sample', count(*) from orders where o_orderkey % 3 <> 1"

QUERIES = {
    "csv_typed": (csv_typed, CSV), "text_files": (text_files, TEXTS), "html_rows": (html_rows, HTML), "ticker_ids": (ticker_ids, TICKERS),
    "parallel_arrays": (parallel_arrays, ARRAYS), "two_series": (two_series, SERIES), "full_and_sample": (full_and_sample, PAIR),
}
