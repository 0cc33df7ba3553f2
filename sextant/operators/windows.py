"""Look-ahead-free window features that do not need one task for all rows.

A total order over all rows is cut into ranges at literal edges; ranks and running sums
are taken inside ranges and shifted by the totals of the ranges before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch


def edges_below(x: F.Column, edges: list[float]) -> F.Column:
    """How many of some ascending edges lie below x (null: none), as nested conditions: compiled, and a row takes only the steps of a binary search."""
    def half(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x > F.lit(float(edges[mid])), half(mid + 1, hi)).otherwise(half(lo, mid))

    return half(0, len(edges))


def range_bucket(df: DataFrame, column: str, buckets: int = 64) -> F.Column:
    """The range of a numeric value, by edges that split df about evenly. An expression of literals: the same for equal values."""
    shares = [i / buckets for i in range(1, buckets)]
    edges = sorted(set(df.where(F.col(column).isNotNull()).select(F.percentile_approx(F.col(column).cast("double"), shares, 10_000).alias("e")).first()[0] or []))
    return edges_below(F.col(column).cast("double"), edges)


def average_ranks(df: DataFrame, columns: dict[str, str], buckets: int = 64) -> DataFrame:
    """Ranks of columns, given as {column: name of its rank}: from 1, with ties averaged. Only distinct values and their counts are ordered.

    Each column's counts and ranks are tables of the shared folder: computed once, and of a size
    that Spark knows, so that the ranks of few values are broadcast and their rows do not meet in one task.
    """
    out = df
    for column, name in columns.items():
        counts = scratch.write(df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n")))
        placed = counts.withColumn("__b", range_bucket(counts, "__v", buckets))
        totals = placed.groupBy("__b").agg(F.sum("__n").alias("__t")).withColumn("__before", F.coalesce(F.sum("__t").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        w = Window.partitionBy("__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
        ranked = placed.withColumn("__upto", F.sum("__n").over(w)).join(F.broadcast(totals.select("__b", "__before")), "__b")
        ranked = scratch.write(ranked.select("__v", (F.col("__before") + F.col("__upto") - F.col("__n") + (F.col("__n") + 1) / F.lit(2.0)).alias(name)))
        scratch.drop(counts)
        out = out.join(ranked, F.col(column) == F.col("__v"), "left").drop("__v")
    return out


def average_rank(df: DataFrame, column: str, out: str, buckets: int = 64) -> DataFrame:
    return average_ranks(df, {column: out}, buckets)


def rolling_full(df: DataFrame, value: str, rows: int, order: list[str], by: list[str] = ()) -> tuple[F.Column, F.Column]:
    """(sum, sample deviation) over the last rows rows, null until the frame is full."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
    full = F.count(value).over(w) == rows
    return F.when(full, F.sum(value).over(w)), F.when(full, F.stddev_samp(value).over(w))


def trailing_count(df: DataFrame, day: str, order: str, days: int, out: str) -> DataFrame:
    """How many rows lie in the days days up to this one as seen when it came: itself and earlier rows, later ones of the same day not.

    Days are counted first, so the only ungrouped window has one row a day.
    """
    d = F.to_date(day)
    per_day = df.groupBy(d.alias("__day")).agg(F.count("*").alias("__n"))
    w = Window.orderBy(F.datediff("__day", F.lit("1970-01-01"))).rangeBetween(-days, -1)
    before = per_day.withColumn("__before", F.coalesce(F.sum("__n").over(w), F.lit(0))).select("__day", "__before")
    same = F.row_number().over(Window.partitionBy(d).orderBy(order))
    return df.withColumn("__day", d).withColumn("__same", same).join(before, "__day", "left").withColumn(out, F.col("__before") + F.col("__same")).drop("__day", "__same", "__before")


def numbered(df: DataFrame, order: list[str], out: str = "pos") -> DataFrame:
    """df with each row's position from 0 in a total order, written to the shared folder.

    Rows are dealt in ranges of the order and sorted there, so equal leading values may lie in several tasks; what
    is added to a task's own numbers is a row for each task.
    """
    held = df.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("__p"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("__k"))
    held = scratch.write(held)
    sizes = held.groupBy("__p").agg(F.count("*").alias("__n"))
    before = sizes.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return held.join(F.broadcast(before), "__p").withColumn(out, F.col("__before") + F.col("__k")).drop("__p", "__k", "__before")


#: Positions of a range that one task sums up. Three counts of 21 bits share a number, so a range has fewer than 2 ** 21 rows.
LEAST_WIDTH, MOST_WIDTH = 1 << 13, 1 << 20


def earlier_ranks(rows: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """(pos, which, found) of wanted (pos, which, rank): the code of that rank (from 0) among the rows (pos, code) at earlier positions.

    Codes are whole numbers from 0 to top. They are settled two bits at a time, for all of wanted at once: among
    the rows that begin with the bits found so far, those with each next digit are counted up to each
    position, and the digit that holds the rank is taken. Counts are running sums inside ranges of positions,
    to which the totals of the ranges before are added. A step's result is written to the shared folder.
    """
    width = min(max(LEAST_WIDTH, rows.count() // 256), MOST_WIDTH)
    one = F.when(F.col("digit") == 0, 1).when(F.col("digit") == 1, 1 << 21).when(F.col("digit") == 2, 1 << 42).otherwise(0).cast("long")
    part = lambda name, d: F.shiftright(name, 21 * d).bitwiseAND((1 << 21) - 1)
    held = wanted.select("pos", "which", "rank", F.lit(0).cast("long").alias("found"))
    for bits in reversed(range(0, max(int(top).bit_length(), 1), 2)):
        entries = rows.select(F.shiftright("code", bits + 2).alias("group"), "pos", F.lit(1).alias("kind"), F.lit(None).cast("int").alias("which"), F.lit(None).cast("long").alias("rank"), F.shiftright("code", bits).bitwiseAND(3).alias("digit"))
        both = entries.union(held.select(F.col("found").alias("group"), "pos", F.lit(0).alias("kind"), "which", "rank", F.lit(3).alias("digit")))
        both = both.select("group", F.floor(F.col("pos") / width).alias("range"), "pos", "kind", "which", "rank", one.alias("one"))
        w = Window.partitionBy("group", "range").orderBy("pos", "kind").rowsBetween(Window.unboundedPreceding, 0)
        inside = both.withColumn("inside", F.sum("one").over(w)).where("kind = 0")
        earlier = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
        totals = both.groupBy("group", "range").agg(F.sum("one").alias("all"))
        before = totals.select("group", "range", *[F.coalesce(F.sum(part("all", d)).over(earlier), F.lit(0)).alias(f"before{d}") for d in range(3)])
        counted = inside.join(before, ["group", "range"]).withColumns({f"n{d}": F.col(f"before{d}") + part("inside", d) for d in range(3)})
        counted = counted.select("pos", "which", "group", F.col("rank").alias("r"), F.col("n0").alias("u0"), (F.col("n0") + F.col("n1")).alias("u1"), (F.col("n0") + F.col("n1") + F.col("n2")).alias("u2"))
        digit = F.when(F.col("r") < F.col("u0"), 0).when(F.col("r") < F.col("u1"), 1).when(F.col("r") < F.col("u2"), 2).otherwise(3)
        passed = F.when(F.col("r") < F.col("u0"), F.lit(0).cast("long")).when(F.col("r") < F.col("u1"), F.col("u0")).when(F.col("r") < F.col("u2"), F.col("u1")).otherwise(F.col("u2"))
        last, held = held, scratch.write(counted.select("pos", "which", (F.col("r") - passed).alias("rank"), (4 * F.col("group") + digit).alias("found")))
        scratch.drop(last)
    return held.select("pos", "which", "found")


def expanding_quantile_flag(df: DataFrame, day: str, order: str, value: str, q: float, min_history: int, out: str, threshold: str) -> DataFrame:
    """Whether an integer value reaches the q-quantile (interpolated) of all earlier rows' values; null for the first min_history rows."""
    rows = numbered(df, [day, order], "__pos")
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return df.withColumn(threshold, F.lit(None).cast("double")).withColumn(out, F.lit(None).cast("double"))
    coded = scratch.write(rows.select(F.col("__pos").alias("pos"), (F.col(value) - low).cast("long").alias("code")))
    spot = lambda pos: q * (F.col(pos) - 1)
    rank = F.floor(spot("pos"))
    asked = coded.where(F.col("pos") >= max(min_history, 1)).select("pos", F.posexplode(F.array(rank, F.least(rank + 1, F.col("pos") - 1))).alias("which", "rank"))
    found = earlier_ranks(coded.where("code is not null"), asked, high - low)
    scratch.drop(coded)
    ends = found.groupBy(F.col("pos").alias("__pos")).agg(*[(F.max(F.when(F.col("which") == i, F.col("found"))) + low).cast("double").alias(f"__{i}") for i in (0, 1)])
    limit = F.col("__0") + (F.col("__1") - F.col("__0")) * (spot("__pos") - F.floor(spot("__pos")))
    both = rows.join(ends, "__pos", "left").withColumn(threshold, limit)
    return both.withColumn(out, (F.col(value) >= F.col(threshold)).cast("double")).select(*df.columns, threshold, out)
