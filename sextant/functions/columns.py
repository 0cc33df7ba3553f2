"""Column expressions with the null rules of the engine: NaN is null, a ratio without a denominator is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    x = x.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def ratio(n: Column, d: Column) -> Column:
    """n / d where d is positive, else null."""
    return F.when(d > 0, n / d)


def flag(known: Column, condition: Column) -> Column:
    """1.0 or 0.0, or null where known is null."""
    return F.when(known.isNotNull(), condition.cast("double"))


def presence(x: Column) -> Column:
    return x.isNotNull().cast("int")


def clip(x: Column, lo, hi) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo) if not isinstance(lo, Column) else lo), F.lit(hi) if not isinstance(hi, Column) else hi))


def log_floor(x: Column, floor: float = 0.01) -> Column:
    """Natural logarithm of max(x, floor), null where x is."""
    return F.when(x.isNotNull(), F.ln(F.greatest(x, F.lit(floor))))


def number(text: Column) -> Column:
    """A number written with currency signs, commas, percent signs or blanks; null if there is none."""
    return F.expr("try_cast(nullif(regexp_replace({0}, '[$,%\\\\s]', ''), '') as double)".format(_name(text)))


def date(text: Column) -> Column:
    return F.expr(f"try_cast({_name(text)} as date)")


def _name(c: Column) -> str:
    return c._jc.toString() if hasattr(c, "_jc") else str(c)


def key(x: Column) -> Column:
    return F.upper(F.trim(x))


def calendar_parts(df: DataFrame, day: str, prefix: str = "") -> DataFrame:
    """year, quarter, month and weekday (Monday is 0) of a date."""
    d = F.col(day)
    return df.withColumns({f"{prefix}year": F.year(d), f"{prefix}quarter": F.quarter(d), f"{prefix}month": F.month(d), f"{prefix}weekday": F.weekday(d)})


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    return [c for c in wanted if c in df.columns]


def rename_synonyms(df: DataFrame, synonyms: dict[str, str]) -> DataFrame:
    """Canonical names for the columns' synonyms; of several synonyms of one name the first non-null value counts."""
    by: dict[str, list[str]] = {}
    for c in df.columns:
        by.setdefault(synonyms.get(c, c), []).append(c)
    return df.select(*[F.coalesce(*[F.col(f"`{c}`") for c in cs]).alias(name) for name, cs in by.items()])


def long_flags(df: DataFrame, id_cols: list[str], flags: list[str], name: str = "category") -> DataFrame:
    """A row for each flag that is set."""
    return df.unpivot(id_cols, flags, name, "set").where("set > 0").drop("set")


def log1p(x: Column) -> Column:
    """ln(1 + x) where x is above -1, else null."""
    return F.when(x > -1, F.log1p(x))


def half_even(x: Column, digits: int = 0) -> Column:
    """Rounded to digits, halves to the even neighbour."""
    return F.bround(x, digits)


def rank_value(raw: Column, missing: float = -9.0, less: float = 0.001, digits: int = 2) -> Column:
    """A published rank: the sentinel is null, the rest is lowered by less and rounded."""
    return F.round(F.nullif(raw, F.lit(missing)) - less, digits)


def not_equal(x: Column, value) -> Column:
    """Whether x differs from value; null does."""
    return ~x.eqNullSafe(F.lit(value))


def code_flags(x: Column, names: dict) -> dict[str, Column]:
    """A 0/1 column for each code of a column of codes; null and other codes are 0 in all."""
    return {name: x.eqNullSafe(F.lit(code)).cast("int") for code, name in names.items()}


def any_flag(flags: list[str]) -> Column:
    """Whether any of the flags is above zero; null is not."""
    return sum((F.when(F.col(c) > 0, 1).otherwise(0) for c in flags), F.lit(0)) > 0


def product_if_absent(df: DataFrame, out: str, a: str, b: str, scale: float = 1e6) -> DataFrame:
    """Adds out = a * b / scale where the table lacks it and has both."""
    if out in df.columns or a not in df.columns or b not in df.columns:
        return df
    return df.withColumn(out, F.col(a) * F.col(b) / scale)


def by_years(df: DataFrame, id_cols: list[str], periods: dict[str, list[int]], value: str = "rank", source: str = "source") -> DataFrame:
    """Wide columns of periods to a row for each of a period's years; columns the table lacks are left out, null values too."""
    found = present(df, list(periods))
    long = df.unpivot(id_cols, found, source, value).where(F.col(value).isNotNull())
    years = F.map_from_arrays(F.array(*[F.lit(c) for c in found]), F.array(*[F.array(*[F.lit(y) for y in periods[c]]) for c in found]))
    return long.select(*id_cols, source, F.explode(F.element_at(years, F.col(source))).alias("year"), value)


def union_all(*tables: DataFrame) -> DataFrame:
    """All rows under the union of the columns; a column that a table lacks is null there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
