"""Exact order statistics by group, of groups of any size.

The wanted ranks are looked for in brackets, at first whole groups. A group of more rows than
MOST is first cut into CELLS cells of equal width, in which rows are counted. A bracket that still has more
is cut by its rows: edges from a quantile sketch split it, rows are counted by edge and by the space between
edges, and each rank goes on in the space that holds it, or is found where it falls on an edge (so a
value that repeats without end is found at once). Rows are counted where they stand and none moves until brackets are
small; then the rows of each bracket, MOST at most, are put in order. A round cuts a bracket to about
a 64th, so the number of rounds grows with the logarithm of the rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import scratch

#: Rows of a bracket that one task puts in order, edges of a cut, and the accuracy of their sketch.
MOST, EDGES, ACCURACY = 1_000_000, 63, 4096
#: Cells of equal width that a large group is cut into first.
CELLS = 4096


def _same(left: DataFrame, right: DataFrame, by: list[str], suffix: str) -> F.Column:
    """left and right (whose columns carry the suffix) in the same group, null groups included."""
    return reduce(lambda a, b: a & b, [left[c].eqNullSafe(right[c + suffix]) for c in by], F.lit(True))


def per_group(rows: DataFrame, found: DataFrame, by: list[str], extra: F.Column | None = None, how: str = "inner") -> DataFrame:
    """Each of rows with the columns of its group in found; null groups are groups like others. Without by, found has few rows."""
    right = found.select(*[F.col(c).alias(c + "__g") if c in by else F.col(c) for c in found.columns])
    right = right if by else F.broadcast(right)  # without groups: a row for each wanted rank at most
    condition = _same(rows, right, by, "__g")
    return rows.join(right, condition if extra is None else condition & extra, how).drop(*[c + "__g" for c in by])


def _cell(x: F.Column, low: F.Column, high: F.Column) -> F.Column:
    """The cell from 0 of a value between low and high; it never falls where the value rises."""
    width = high - low
    return F.when(width > 0, F.least(F.floor((x - low) / width * CELLS), F.lit(CELLS - 1))).otherwise(0).cast("int")


def _by_cells(held: DataFrame, wide: DataFrame, by: list[str]) -> DataFrame:
    """Wanted ranks of whole groups (*by, rank, __min, __max, both finite) with the cell that holds each: __lo, __hi (exclusive, the neighbouring cells' ends), __m rows from rank __from on, and __on where they are one value, __value."""
    placed = per_group(held, wide.select(*by, "__min", "__max").distinct(), by)
    cells = placed.groupBy(*by, _cell(F.col("__x"), F.col("__min"), F.col("__max")).alias("__cell")).agg(F.count("*").alias("__m"), F.min("__x").alias("__value"), F.max("__x").alias("__end"))
    w = Window.partitionBy(*by).orderBy("__cell")  # CELLS at most
    upto = F.sum("__m").over(w.rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.select(*by, "__m", "__value", (F.col("__value") == F.col("__end")).alias("__on"), (upto - F.col("__m")).alias("__from"), F.lag("__end").over(w).alias("__lo"), F.lead("__value").over(w).alias("__hi"))
    return per_group(wide.select(*by, "rank"), cells, by, (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__from") + F.col("__m")))


def select_ranks(rows: DataFrame, by: list[str], column: str, targets: DataFrame, most: int | None = None) -> DataFrame:
    """(*by, rank, value, below): for each target (*by, rank from 0) the value of that rank in its group and how many rows are less.

    rows should be a table or something as cheap to scan: it is read once a round. Nulls count for nothing; targets of
    ranks that a group doesn't have are left out. The result is written to the shared folder.
    """
    most = most or MOST
    held = rows.select(*by, F.col(column).cast("double").alias("__x")).where("__x is not null")
    brackets = held.groupBy(*by).agg(F.count("*").alias("__m"), F.min("__x").alias("__min"), F.max("__x").alias("__max")).withColumns({"__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double"), "__below": F.lit(0).cast("long")})
    open_ = per_group(targets.select(*by, "rank"), brackets, by).where(F.col("rank").between(0, F.col("__m") - 1))
    found, spent, cut = None, [], False
    names = [*by, "__lo", "__hi"]
    inside = (F.col("__lo").isNull() | (F.col("__x") > F.col("__lo"))) & (F.col("__hi").isNull() | (F.col("__x") < F.col("__hi")))
    open_ = scratch.write(open_)
    # NaN and infinite ends leave no width
    by_cell = (F.col("__m") > most) & (F.abs(F.col("__max") - F.col("__min")) < float("inf"))
    if open_.where(by_cell).limit(1).count():
        spent.append(open_)
        moved, cut = scratch.write(_by_cells(held, open_.where(by_cell), by)), True
        spent.append(moved)
        found = moved.where("__on").select(*by, "rank", F.col("__value").alias("value"), F.col("__from").alias("below"))
        narrowed = moved.where("not __on").select(*by, "rank", "__m", "__lo", "__hi", F.col("__from").alias("__below"))
        open_ = scratch.write(open_.where(~by_cell).select(*by, "rank", "__m", "__lo", "__hi", "__below").union(narrowed))
    while (open_.agg(F.max("__m")).first()[0] or 0) > most:
        spent.append(open_)
        wide, cut = open_.where(F.col("__m") > most), True
        ranges = wide.select(*names, "__below").distinct()
        members = per_group(held, ranges, by, inside)
        edges = members.groupBy(*names, "__below").agg(F.array_distinct(F.percentile_approx("__x", [(i + 1) / (EDGES + 1) for i in range(EDGES)], ACCURACY)).alias("__edges"))
        edges = scratch.write(edges)
        placed = per_group(held, edges, by, inside)
        # an even place is the space before an edge, the next odd one the edge itself
        less = F.size(F.filter("__edges", lambda e: e < F.col("__x")))
        place = 2 * less + F.when(F.array_contains("__edges", F.col("__x")), 1).otherwise(0)
        # edges are joined again to the counts: carried through the aggregate they would make it sort all rows
        counts = placed.groupBy(*names, "__below", place.alias("__place")).agg(F.count("*").alias("__n"))
        again = edges.select(*by, F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), "__edges")
        counts = per_group(counts, again, by, F.col("__lo").eqNullSafe(F.col("__l")) & F.col("__hi").eqNullSafe(F.col("__h"))).drop("__l", "__h")
        w = Window.partitionBy(*names).orderBy("__place").rowsBetween(Window.unboundedPreceding, 0)  # 2 * EDGES + 1 places at most
        counts = counts.withColumn("__from", F.col("__below") + F.sum("__n").over(w) - F.col("__n"))
        at = (F.col("__place") / 2).cast("int")
        edge = lambda i: F.try_element_at("__edges", i)
        spaces = counts.select(
            *by, F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), "__from", "__n", (F.col("__place") % 2 == 1).alias("__on"),
            edge(at + 1).alias("__next"), F.when(at > 0, edge(F.greatest(at, F.lit(1)))).alias("__last"),
        )
        moved = per_group(wide.select(*names, "rank"), spaces, by, F.col("__lo").eqNullSafe(F.col("__l")) & F.col("__hi").eqNullSafe(F.col("__h")) & (F.col("rank") >= F.col("__from")) & (F.col("rank") < F.col("__from") + F.col("__n")))
        moved = scratch.write(moved)
        spent += [edges, moved]
        done = moved.where("__on").select(*by, "rank", F.col("__next").alias("value"), F.col("__from").alias("below"))
        found = done if found is None else found.union(done)
        narrowed = moved.where("not __on").select(*by, "rank", F.col("__n").alias("__m"), F.coalesce("__last", "__lo").alias("__lo"), F.coalesce("__next", "__hi").alias("__hi"), F.col("__from").alias("__below"))
        open_ = scratch.write(open_.where(F.col("__m") <= most).select(*by, "rank", "__m", "__lo", "__hi", "__below").union(narrowed))
    spent.append(open_)
    if cut:
        held = per_group(held, open_.select(*names, "__below").distinct(), by, inside)
    else:
        held = held.withColumns({"__lo": F.lit(None).cast("double"), "__hi": F.lit(None).cast("double"), "__below": F.lit(0).cast("long")})
    values = held.groupBy(*names, "__below", "__x").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*names).orderBy("__x").rowsBetween(Window.unboundedPreceding, 0)  # MOST at most
    values = values.withColumn("__upto", F.col("__below") + F.sum("__n").over(w))
    wanted = open_.select(*by, F.col("__lo").alias("__l"), F.col("__hi").alias("__h"), "rank")
    last = per_group(values, wanted, by, F.col("__lo").eqNullSafe(F.col("__l")) & F.col("__hi").eqNullSafe(F.col("__h")) & (F.col("rank") < F.col("__upto")) & (F.col("rank") >= F.col("__upto") - F.col("__n")))
    last = last.select(*by, "rank", F.col("__x").alias("value"), (F.col("__upto") - F.col("__n")).alias("below"))
    out = scratch.write(last if found is None else found.union(last))
    scratch.drop(*spent)
    return out


def group_quantiles(df: DataFrame, by: list[str], column: str, shares: list[float], most: int | None = None) -> DataFrame:
    """(*by, n, q): the number of known values of each group and their quantiles, an array in the order of shares.

    Linear interpolation between neighbours, number for number that of Spark's ``percentile``, which does the work
    where no group has more than ``most`` rows (MOST; they are counted first). Groups without a known value have no row.
    """
    most = most or MOST
    rows = df.select(*by, F.col(column).cast("double").alias("__v")).where("__v is not null")
    if (rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= most:
        return rows.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("__v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).where("n > 0")
    rows = scratch.write(rows)
    sizes = scratch.write(rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 0"))
    spot = [(F.lit(float(s)) * (F.col("n") - 1)) for s in shares]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(h), F.ceil(h)) for h in spot])))
    got = select_ranks(rows, by, "__v", sizes.select(*by, F.explode(ranks).alias("rank")), most)
    held = got.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("__v"))
    both = per_group(sizes, held, by)

    def at(h):
        lo, hi = F.element_at("__v", F.floor(h)), F.element_at("__v", F.ceil(h))
        return F.when((F.floor(h) == F.ceil(h)) | (lo == hi), lo).otherwise((F.ceil(h) - h) * lo + (h - F.floor(h)) * hi)

    out = scratch.write(both.select(*by, "n", F.array(*[at(h) for h in spot]).alias("q")))
    scratch.drop(rows, sizes, got)
    return out


def prefix_quantiles(rows: DataFrame, position: str, sizes: list[int], columns: list[str], shares: list[float], most: int | None = None) -> dict[tuple[int, str], list[float] | None]:
    """{(size, column): quantiles of the known values among the rows at positions below size}, as group_quantiles gives them; None without values.

    All sizes and columns share three passes over rows: ends, counts by cell and stretch between sizes, and the values of the cells that
    hold wanted ranks. len(columns) * len(sizes) * CELLS counts come to the driver at most. A column without finite ends, or
    with more than most rows of several values in a wanted cell, goes through group_quantiles.
    """
    import numpy as np

    most, sizes, spark = most or MOST, sorted(set(sizes)), rows.sparkSession
    stretch = sum(((F.col(position) >= s).cast("int") for s in sizes[:-1]), F.lit(0))
    held = rows.where(F.col(position) < sizes[-1]).select(stretch.alias("__s"), *[F.col(f"`{c}`").cast("double").alias(f"__{i}") for i, c in enumerate(columns)])
    ends = held.agg(*[e for i in range(len(columns)) for e in (F.min(f"__{i}"), F.max(f"__{i}"))]).first()
    ends = {i: ends[2 * i : 2 * i + 2] for i in range(len(columns))}
    out: dict = {(s, c): None for s in sizes for c in columns}
    plain = [i for i, (lo, hi) in ends.items() if lo is not None and np.isfinite(hi - lo)]
    hard = [i for i, (lo, _) in ends.items() if lo is not None and i not in plain]
    spots, wanted, known = {}, set(), {}
    if plain:
        cells = [F.struct(F.lit(i).alias("c"), F.col(f"__{i}").alias("x"), _cell(F.col(f"__{i}"), *map(F.lit, ends[i])).alias("cell")) for i in plain]
        long = held.select("__s", F.inline(F.array(*cells))).where("x is not null")
        got = long.groupBy("c", "__s", "cell").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).toArrow()
        c, s, cell, n, lo, hi = (got.column(j).to_numpy() for j in range(6))
        for i in plain:
            mine = c == i
            counts, least, greatest = np.zeros((len(sizes), CELLS), np.int64), np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
            counts[s[mine], cell[mine]] = n[mine]
            np.minimum.at(least, cell[mine], lo[mine])
            np.maximum.at(greatest, cell[mine], hi[mine])
            for j, upto in enumerate(np.cumsum(counts, axis=0)):
                ranked = np.cumsum(upto)
                if not ranked[-1]:
                    continue
                spots[i, j] = [q * (int(ranked[-1]) - 1) for q in shares]
                for rank in {int(f(h)) for h in spots[i, j] for f in (np.floor, np.ceil)}:
                    at = int(np.searchsorted(ranked, rank, "right"))
                    if least[at] == greatest[at]:
                        known[i, j, rank] = float(least[at])
                    elif upto[at] > most:
                        hard.append(i)
                    else:
                        wanted.add((i, j, at, rank, int(rank - ranked[at] + upto[at])))
    hard = sorted(set(hard))
    if asked := [w for w in sorted(wanted) if w[0] not in hard]:
        ranks = spark.createDataFrame(asked, "c int, j int, cell int, rank long, inside long")
        values = long.join(F.broadcast(ranks.select("c", "cell").distinct()), ["c", "cell"]).groupBy("c", "cell", "__s", "x").agg(F.count("*").alias("n"))
        values = values.join(F.broadcast(ranks.select("c", "j", "cell").distinct()), ["c", "cell"]).where("__s <= j").groupBy("c", "j", "cell", "x").agg(F.sum("n").alias("n"))
        w = Window.partitionBy("c", "j", "cell").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)  # most at most
        values = values.withColumn("upto", F.sum("n").over(w)).join(F.broadcast(ranks), ["c", "j", "cell"]).where("inside < upto and inside >= upto - n")
        known |= {(r.c, r.j, r.rank): r.x for r in values.select("c", "j", "rank", "x").collect()}
    for (i, j), each in spots.items():
        if i not in hard:
            ends_of = [(h, known[i, j, int(np.floor(h))], known[i, j, int(np.ceil(h))]) for h in each]
            out[sizes[j], columns[i]] = [a if a == b else (np.ceil(h) - h) * a + (h - np.floor(h)) * b for h, a, b in ends_of]
    for i in hard:
        for s in sizes:
            got = group_quantiles(rows.where(F.col(position) < s), [], columns[i], shares, most).first()
            out[s, columns[i]] = list(got.q) if got else None
    return out
