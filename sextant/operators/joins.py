"""Joins: strict as-of, range lookup, first row per key, keys without partner."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch
from ..functions.columns import present
from .selection import per_group

#: Rows of a dimension up to which it is broadcast; larger ones take the as-of route.
BROADCAST_ROWS = 100_000
#: Rows from which on a group of an as-of join is cut, and into how many parts.
HOT_ROWS, CUTS = 1_000_000, 128


def asof_before(left: DataFrame, right: DataFrame, at: str, of: str, values: list[str], by: list[str] = (), matched: str = "matched_at") -> DataFrame:
    """Each left row with the values of the last right row strictly before it, and that row's time.

    Both sides are merged into one ordered stream per group, so the cost is one sort and no pair is made. Of right
    rows with equal times the largest values win. Without a group the stream is cut by calendar
    day: each day is a group of its own that starts with the last right row of earlier days. Groups and days of more than
    HOT_ROWS rows are cut further, at times that split them evenly, and each cut starts with the last right row of the cuts before.
    """
    v = F.struct(F.col(of).alias("t"), *[F.col(c) for c in values])
    carried = [c for c in left.columns]
    l = left.select(F.struct(*carried).alias("row"), F.col(at).alias("t"), *by, F.lit(0).alias("side"), F.lit(None).cast(_kind(right, of, values)).alias("v"))
    r = right.where(F.col(of).isNotNull()).select(F.lit(None).cast(l.schema["row"].dataType).alias("row"), F.col(of).alias("t"), *by, F.lit(1).alias("side"), v.alias("v"))
    if by:
        keys, ends = list(by), None
    else:
        day = F.to_date("t")
        daily = right.where(F.col(of).isNotNull()).groupBy(F.to_date(of).alias("day")).agg(F.max(v).alias("v"))
        # one row a day: the only ungrouped window, over as many rows as the calendar has days
        days = l.select(day.alias("day")).distinct().join(daily, "day", "full")
        ends = days.withColumn("before", F.last("v", True).over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))).select("day", "before")
        l, r, keys = l.withColumn("day", day), r.withColumn("day", day), ["day"]
    stream = l.unionByName(r)
    hot = _hot_groups(stream, keys)
    if hot is not None:
        cut = F.coalesce(F.size(F.filter("edges", lambda e: e < _number(stream))), F.lit(0))
        stream = per_group(stream, hot, keys, how="left").withColumn("cut", cut).drop("edges")
        before = Window.partitionBy(*keys).orderBy("cut").rowsBetween(Window.unboundedPreceding, -1)  # CUTS rows a group at most
        tails = stream.groupBy(*keys, "cut").agg(F.max("v").alias("tail")).withColumn("tail", F.last("tail", True).over(before))
        keys = [*keys, "cut"]
        stream = per_group(stream, tails, keys)
    w = Window.partitionBy(*keys).orderBy(F.col("t"), F.col("side"), F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    out = stream.withColumn("found", F.last("v", True).over(w)).where("side = 0")
    if hot is not None:
        out = out.withColumn("found", F.coalesce("found", "tail"))
    if ends is not None:
        out = out.join(ends, "day", "left").withColumn("found", F.coalesce("found", "before"))
    return out.select("row.*", F.col("found.t").alias(matched), *[F.col(f"found.{c}").alias(c) for c in values])


def _number(df: DataFrame) -> F.Column:
    """The time t as a number."""
    return F.col("t").cast("timestamp").cast("double") if dict(df.dtypes)["t"] in ("date", "timestamp", "timestamp_ntz") else F.col("t").cast("double")


def _hot_groups(stream: DataFrame, keys: list[str]) -> DataFrame | None:
    """(keys, edges) of groups with more than HOT_ROWS rows; None if there are none. They are no more than a HOT_ROWS-th of the rows, so they may be broadcast."""
    sizes = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    if (sizes.agg(F.max("n")).first()[0] or 0) <= HOT_ROWS:
        return None
    shares = [i / CUTS for i in range(1, CUTS)]
    sized = stream.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx(_number(stream), shares, 4 * CUTS).alias("edges"))
    return F.broadcast(scratch.write(sized.where(F.col("n") > HOT_ROWS).select(*keys, "edges")))


def _kind(df: DataFrame, of: str, values: list[str]):
    return df.select(F.struct(F.col(of).alias("t"), *values).alias("v")).schema["v"].dataType


def assert_disjoint(ranges: DataFrame, lo: str, hi: str) -> None:
    """Raise if two ranges overlap."""
    w = Window.orderBy(lo)
    bad = ranges.withColumn("before", F.lag(hi).over(w)).where((F.col("before") >= F.col(lo)) | (F.col(hi) < F.col(lo))).count()
    if bad:
        raise ValueError(f"{bad} overlapping ranges")


def code(column: str) -> F.Column:
    """An integer code written as a number or as text such as '2834.0'."""
    return F.expr(f"cast(try_cast(trim(cast({column} as string)) as double) as int)")


def range_lookup(left: DataFrame, ranges: DataFrame, value: str, lo: str, hi: str, label: str, default: str = "Unclassified") -> DataFrame:
    """Adds the label of the range that holds value, else the default. Ranges are disjoint.

    A dimension of a checked size is broadcast; a larger one is matched as of its lower bound.
    """
    if ranges.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        r = ranges.select(F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(label).alias("__label"))
        out = left.withColumn("__code", code(value)).join(F.broadcast(r), F.col("__code").between(F.col("__lo"), F.col("__hi")), "left")
        return out.withColumn(label, F.coalesce("__label", F.lit(default))).drop("__code", "__lo", "__hi", "__label")
    cells = 4096
    l = left.withColumn("__code", code(value)).withColumn("__cell", F.floor(F.col("__code") / cells))
    r = ranges.withColumn("__cell", F.explode(F.sequence(F.floor(F.col(lo) / cells), F.floor(F.col(hi) / cells)))).select("__cell", F.col(lo).alias("__lo"), F.col(hi).alias("__hi"), F.col(label).alias("__label"))
    out = l.join(r, (l["__cell"] == r["__cell"]) & F.col("__code").between(F.col("__lo"), F.col("__hi")), "left").drop("__cell", "__code", "__lo", "__hi")
    return out.withColumn(label, F.coalesce("__label", F.lit(default))).drop("__label")


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; aggregated, so a key's rows are combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*[c if c in keys else F.col(f"__row.{c}").alias(c) for c in df.columns])


def without_partner(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def assemble(base: DataFrame, *dimensions: tuple[DataFrame, list[str], list[str]]) -> DataFrame:
    """Left joins of base to dimensions (table, keys, kept columns), each unique by its keys; missing columns are left out."""
    out = base
    for table, keys, kept in dimensions:
        out = out.join(first_per_key(table.select(*keys, *present(table, kept)), keys, keys + present(table, kept)), keys, "left")
    return out


def value_at(left: DataFrame, ranks: DataFrame, name: str, year: str, value: str) -> DataFrame:
    """left with the value that a dimension (name, year, value) holds for both its name and its year; null where there is none."""
    return left.join(first_per_key(ranks.select(name, year, value), [name, year], [value]), [name, year], "left")
