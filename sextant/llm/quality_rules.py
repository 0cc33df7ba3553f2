"""Quality rules whose thresholds adapt to each language and source.

Signals of every whole text are counted in one pass (Arrow batches). Rates of them, in
thousandths, go into sketches: counts by cell, cells being whole numbers cut to six leading
bits, so a quantile is at most a 32nd below the true one. Sketches merge by adding counts: the
same counts give a source's, a language's and the whole corpus's sketch, and no order of
tasks or retry changes them. From its quartiles each group of language and source gets limits,
which are joined back to the documents.

A document is rejected by a rate v if v strays beyond its group's quartile by more than ``fence``
times the distance of the quartiles (at least the rate's slack), times 1 + short / size, as rates of short
texts stray further; the size is what the rate is a share of: words, lines or characters. Groups of fewer than ``least`` documents with words use the limits
of their language, languages of fewer those of all documents.

Defined results: null texts have no words; documents without words fail the base rules and
take no part in sketches; null languages and null sources are groups of their own; repeated rows and
ids each count and get equal results; a text of any length is read whole; empty tables give
empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, materialise

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
WINDOW = 5
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals"]
#: rate: (counted, per, slack, short, whether low values are outliers too). Rates are thousandths.
RATES = {
    "symbols": ("n_symbols", "n_words", 10, 50, False),
    "length": ("word_chars", "n_words", 250, 50, True),
    "copies": ("n_dup_lines", "n_lines", 40, 20, False),
    "repeats": ("n_repeat_words", "n_words", 40, 50, False),
    "capitals": ("n_capitals", "word_chars", 20, 250, False),
}
FENCE, LEAST = 4, 100
#: Groups of language and source up to which their limits (a few hundred bytes each) are broadcast.
BROADCAST_GROUPS = 50_000
BLOCK = 1 << 20


def _again(owner, ids):
    """For each text, by the numbers of its words: how many words stand in a window of WINDOW words found twice or more in it."""
    import numpy as np

    covered = np.zeros(len(ids), bool)
    if len(ids) >= WINDOW:
        key = ids
        for width in range(2, WINDOW + 1):  # numbers of windows that grow by a word; equal windows have equal numbers
            _, key = np.unique(key[:-1] * (len(ids) + 1) + ids[width - 1 :], return_inverse=True)
        inside = owner[: len(key)] == owner[WINDOW - 1 :]
        _, at, n = np.unique((owner[: len(key)] * len(ids) + key)[inside], return_inverse=True, return_counts=True)
        starts = np.flatnonzero(inside)[n[at] > 1]
        for j in range(WINDOW):
            covered[starts + j] = True
    return covered


def signals(texts: list[str]) -> list[list[int]]:
    """The COUNTS of each text, a list each."""
    from collections import defaultdict
    from itertools import count

    import numpy as np

    numbers = defaultdict(count().__next__)
    out, ids = [[] for _ in COUNTS], []
    for text in texts:
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        ids.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        joined = "".join(words)
        found = len(words), len(joined), sum(map(joined.count, SYMBOLS)), len(lines) - len(set(lines)), 0, len(lines), sum(map(joined.count, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
        for column, x in zip(out, found):
            column.append(x)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in ids])
    out[4] = np.bincount(owner[_again(owner, np.concatenate(ids))], minlength=len(texts)).tolist() if ids else []
    return out


def counted(docs: DataFrame, id_col: str, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    """(id, lang, source, *COUNTS, base_failed) of each document."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            first, held, size = 0, [], 0
            for i, text in enumerate(batch.column(3)):
                held.append(text.as_py() or "")
                size += len(held[-1])
                if size >= BLOCK or i + 1 == batch.num_rows:
                    found = signals(held)
                    yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(first, len(held)) for c in range(3)], *[pa.array(x, pa.int64()) for x in found]], names=["id", "lang", "source", *COUNTS])
                    first, held, size = i + 1, [], 0

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{source_col}`").cast("string").alias("source"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = narrow.mapInArrow(run, f"id {narrow.schema['id'].dataType.simpleString()}, lang string, source string, {', '.join(f'{c} long' for c in COUNTS)}")
    return out.withColumn("base_failed", F.expr(f"n_words < 10 or 100 * n_repeat_words > 20 * n_words"))


def cell(v: F.Column) -> F.Column:
    """The sketch's cell of a whole number of 0 or more; cells are ordered as the numbers are."""
    shift = F.greatest(F.length(F.bin(v)) - 6, F.lit(0))
    return (32 * shift + F.call_function("shiftright", v, shift)).cast("int")


def lowest(c: F.Column) -> F.Column:
    """The least number of a cell."""
    shift = F.greatest(F.floor(c / 32) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", (c - 32 * shift).cast("long"), shift)


def rate(name: str) -> F.Column:
    counted_, per, *_ = RATES[name]
    return F.expr(f"1000 * {counted_} div {per}")


def sketches(rows: DataFrame) -> DataFrame:
    """(lang, source, rate, cell, n): the sketches of all groups; they merge by adding n."""
    each = F.array(*[F.struct(F.lit(r).alias("rate"), cell(rate(r)).alias("cell")) for r in RATES])
    return rows.where("n_words > 0").select("lang", "source", F.inline(each)).groupBy("lang", "source", "rate", "cell").agg(F.count("*").alias("n"))


def quartiles(sketch: DataFrame, by: list[str]) -> DataFrame:
    """(*by, n, low, high): documents of each merged sketch and its lower and upper quartile. by ends with rate."""
    merged = sketch.groupBy(*by, "cell").agg(F.sum("n").alias("n"))
    # as many rows as a sketch has cells, whatever the documents
    w = Window.partitionBy(*by)
    run = merged.withColumn("upto", F.sum("n").over(w.orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))).withColumn("total", F.sum("n").over(w))
    at = lambda q: lowest(F.min(F.when(4 * F.col("upto") >= q * F.col("total"), F.col("cell"))))
    return run.groupBy(*by).agg(F.first("total").alias("n"), at(1).alias("low"), at(3).alias("high"))


def limits(sketch: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, source, documents, quarts): for each group the quartiles {low, high} of every rate, by the order of RATES, of the finest sketch with enough documents."""
    own = quartiles(sketch, ["lang", "source", "rate"])
    lang = quartiles(sketch, ["lang", "rate"]).select(F.col("lang").alias("l"), F.col("rate").alias("r"), F.struct("low", "high").alias("of_lang"), F.col("n").alias("in_lang"))
    every = quartiles(sketch, ["rate"]).select(F.col("rate").alias("e"), F.struct("low", "high").alias("of_all"))
    # a row for each rate, and a row for each rate and language
    all_ = own.join(lang, F.col("lang").eqNullSafe(F.col("l")) & (F.col("rate") == F.col("r"))).join(F.broadcast(every), F.col("rate") == F.col("e"))
    picked = F.when(F.col("n") >= least, F.struct("low", "high")).when(F.col("in_lang") >= least, F.col("of_lang")).otherwise(F.col("of_all"))
    each = all_.select("lang", "source", "rate", "n", picked.alias("q"))
    return each.groupBy("lang", "source").agg(F.max("n").alias("documents"), *[F.max(F.when(F.col("rate") == r, F.col("q"))).alias(f"q_{r}") for r in RATES])


def _strays(name: str, fence: int) -> F.Column:
    _, per, slack, short, both = RATES[name]
    q = F.col(f"q_{name}")
    beyond = rate(name) - q["high"]
    if both:
        beyond = F.greatest(beyond, q["low"] - rate(name))
    return beyond * F.col(per) > fence * F.greatest(q["high"] - q["low"], F.lit(slack)) * (F.col(per) + short)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", fence: int = FENCE, least: int = LEAST) -> DataFrame:
    """(id, lang, source, *COUNTS, base_failed, strayed, kept): strayed lists the rates beyond their limits."""
    rows = materialise(counted(docs, id_col, text_col, lang_col, source_col))  # a few numbers a document
    table = materialise(limits(sketches(rows), least))
    # a null of either column is a group like any other
    key = lambda: F.struct(F.coalesce("lang", F.lit("")), F.col("lang").isNull(), F.coalesce("source", F.lit("")), F.col("source").isNull())
    found = table.select(key().alias("group"), "documents", *[f"q_{r}" for r in RATES])
    rows = rows.withColumn("group", key())
    if table.count() <= BROADCAST_GROUPS:
        joined = rows.join(F.broadcast(found.drop("documents")), "group", "left")
    else:
        joined = by_key(rows.withColumn("spread", F.monotonically_increasing_id()), found, "group", "documents", "spread")
    strayed = F.filter(F.array(*[F.when((F.col("n_words") > 0) & _strays(r, fence), r) for r in RATES]), lambda x: x.isNotNull())
    out = joined.withColumn("strayed", strayed)
    return out.select("id", "lang", "source", *COUNTS, "base_failed", "strayed", (~F.col("base_failed") & (F.size("strayed") == 0)).alias("kept"))


def op13_quality_rules(spark, sf_dir: str) -> DataFrame:
    out = apply_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), *COUNTS[:5], "base_failed", "kept", *COUNTS[5:], F.array_join("strayed", ",").alias("strayed"))


def _sql() -> str:
    """The same in SQL."""
    code = lambda v: f"(32 * greatest(length(bin({v})) - 6, 0) + ({v} >> greatest(length(bin({v})) - 6, 0)::integer))"
    back = "((c - 32 * greatest(c // 32 - 1, 0)) << greatest(c // 32 - 1, 0)::integer)"
    rates = " union all ".join(f"select lang, source, '{r}' as rate, {code(f'(1000 * {c} // {per})')} as c from s where n_words > 0" for r, (c, per, *_) in RATES.items())
    quarts = lambda by: f"""select {by}, sum(n) as n, min(case when 4 * upto >= tot then {back} end) as low, min(case when 4 * upto >= 3 * tot then {back} end) as high
      from (select *, sum(n) over (partition by {by} order by c) as upto, sum(n) over (partition by {by}) as tot from (select {by}, c, sum(n) as n from cells group by {by}, c)) group by {by}"""  # noqa: E731
    strays = ", ".join(
        f"case when n_words > 0 and {f'greatest(v - q.high, q.low - v)' if both else '(v - q.high)'} * {per} > {FENCE} * greatest(q.high - q.low, {slack}) * ({per} + {short}) then '{r}' end".replace("v ", f"(1000 * {c} // {per}) ").replace(" v)", f" (1000 * {c} // {per}))").replace("q.", f"q_{r}.")
        for r, (c, per, slack, short, both) in RATES.items()
    )
    joins = " ".join(f"left join picked q_{r} on q_{r}.rate = '{r}' and q_{r}.lang is not distinct from s.lang and q_{r}.source is not distinct from s.source" for r in RATES)
    return rf"""
with d as (
  select row_number() over () as i, doc_id, lang, source, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    [x for x in string_split(coalesce(text, ''), chr(10)) if regexp_matches(x, '[^\x20\x09-\x0D]')] as lines from documents
), positions as (
  select i, generate_subscripts(w, 1) as p, w from d
), windows as (
  select i, p, count(*) over (partition by i, w[p : p + 4]) as n from positions where p + 4 <= len(w)
), again as (
  select i, count(distinct p + j) as n from windows, range(5) r(j) where n > 1 group by i
), s as (
  select d.i, doc_id, lang, source, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(again.n, 0) as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_capitals
  from d left join again on again.i = d.i
), cells as (
  select lang, source, rate, c, count(*) as n from ({rates}) group by all
), own as ({quarts('lang, source, rate')}), tongue as ({quarts('lang, rate')}), every as ({quarts('rate')}),
picked as (
  select own.lang, own.source, own.rate, case when own.n >= {LEAST} then own.low when tongue.n >= {LEAST} then tongue.low else every.low end as low,
    case when own.n >= {LEAST} then own.high when tongue.n >= {LEAST} then tongue.high else every.high end as high
  from own join tongue on tongue.lang is not distinct from own.lang and tongue.rate = own.rate join every on every.rate = own.rate
), judged as (
  select s.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, concat_ws(',', {strays}) as strayed from s {joins}
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and strayed = '' as kept, n_lines, n_capitals, strayed from judged
"""


OP13_SQL = _sql()
