"""Typed readers. All go through Spark's readers, so any store that Spark opens will do."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import first_per_key


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, its columns by name and typed; what does not parse is null, NaN too."""
    head = spark.read.csv(path, header=True)
    fields = spark.createDataFrame([], schema).schema.fields
    missing = [f.name for f in fields if f.name not in head.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    cols = []
    for f in fields:
        c = F.expr(f"try_cast(nullif(trim(`{f.name}`), '') as {f.dataType.simpleString()})")
        cols.append((F.when(~F.isnan(c), c) if f.dataType.simpleString() in ("double", "float") else c).alias(f.name))
    return head.select(*cols)


def text_files(spark: SparkSession, path: str, skip: tuple[str, ...] = ()) -> DataFrame:
    """(key, tag, kind, text, path) of files named key_tag.txt or key_tag_suffix.txt for the suffixes of skip; undecodable bytes are replaced.

    Texts that sinks.write_texts wrote have their names in their folders and a line's end that is not theirs.
    """
    files = spark.read.format("binaryFile").load(path)
    text, stem = F.make_valid_utf8(F.col("content").cast("string")), F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    if "name" in files.columns:
        text, stem = F.regexp_replace(text, "\n\\z", ""), F.col("name").cast("string")
    files = files.select("path", text.alias("text"), stem.alias("stem"))
    stem = F.col("stem")
    kind, base = F.lit("full"), stem
    for s in skip:
        kind = F.when(stem.endswith(s), s.strip("_")).otherwise(kind)
        base = F.when(stem.endswith(s), F.substring(stem, F.lit(1), F.char_length(stem) - len(s))).otherwise(base)
    named = files.select("path", "text", kind.alias("kind"), base.alias("base"))
    return named.select(F.regexp_extract("base", "^(.+)_([^_]+)$", 1).alias("key"), F.regexp_extract("base", "^(.+)_([^_]+)$", 2).alias("tag"), "kind", "text", "path").where("key <> ''")


def with_texts(rows: DataFrame, files: DataFrame, key: str, tag: str, kinds: dict[str, str]) -> DataFrame:
    """rows with a text column for each kind of file ({kind: column}) of their key and tag; a missing file is ''."""
    out = rows
    for kind, column in kinds.items():
        one = first_per_key(files.where(F.col("kind") == kind).select(F.col("key").alias(key), F.col("tag").alias(tag), F.col("text").alias(column)), [key, tag], [column])
        out = out.join(one, [key, tag], "left").withColumn(column, F.coalesce(column, F.lit("")))
    return out


def read_status(rows: DataFrame, text: str, problem: str | None = None) -> DataFrame:
    """rows with status: the problem noted while fetching ('error: ..'), 'missing' without text, 'empty', or 'ok'."""
    noted = F.col(problem).isNotNull() if problem else F.lit(False)
    note = F.concat(F.lit("error: "), F.col(problem)) if problem else F.lit(None)
    return rows.withColumn("status", F.when(noted, note).when(F.col(text).isNull(), "missing").when(F.trim(F.col(text)) == "", "empty").otherwise("ok"))


class _Table(HTMLParser):
    """The cells of #main-table, else of the first table."""

    def __init__(self):
        super().__init__()
        self.tables, self.open, self.cell, self.row = [], [], None, None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.open.append({"id": dict(attrs).get("id"), "head": [], "rows": [], "in_head": False})
            self.tables.append(self.open[-1])
        elif self.open:
            if tag == "thead":
                self.open[-1]["in_head"] = True
            elif tag == "tr":
                self.row = []
            elif tag in ("td", "th"):
                self.cell = []

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)

    def handle_endtag(self, tag):
        if not self.open:
            return
        if tag in ("td", "th") and self.cell is not None:
            if self.row is not None:
                self.row.append(" ".join("".join(self.cell).split()))
            self.cell = None
        elif tag == "tr" and self.row is not None:
            (self.open[-1]["head"] if self.open[-1]["in_head"] else self.open[-1]["rows"]).append(self.row)
            self.row = None
        elif tag == "thead":
            self.open[-1]["in_head"] = False
        elif tag == "table":
            self.open.pop()


def table_rows(html: str | None) -> list[dict[str, str]]:
    """Rows of a page's table by column name; rows with another number of cells get col_0, col_1 and so on."""
    p = _Table()
    p.feed(html or "")
    t = next((t for t in p.tables if t["id"] == "main-table"), p.tables[0] if p.tables else None)
    if t is None:
        return []
    head = t["head"][0] if t["head"] else []
    return [dict(zip(head, r)) if len(r) == len(head) else {f"col_{i}": v for i, v in enumerate(r)} for r in t["rows"] if r]


def html_tables(pages: DataFrame, keys: list[str], html: str) -> DataFrame:
    """(keys, row, cells as a map) of each page's table, in Arrow batches."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.select(*keys).schema.fields)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(*k, i, r) for *k, h in pdf.itertuples(index=False) for i, r in enumerate(table_rows(h))]
            yield pd.DataFrame(rows, columns=[*keys, "row", "cells"])

    return pages.select(*keys, html).mapInPandas(run, f"{fields}, row long, cells map<string,string>")


def ticker_ids(raw: DataFrame, body: str) -> DataFrame:
    """(ticker, cik) from JSON objects of numbered records; ids are padded to ten digits."""
    m = F.from_json(body, "map<string,struct<cik_str:long,ticker:string>>")
    each = raw.select(F.explode(F.map_values(m)).alias("r")).select(F.upper(F.trim("r.ticker")).alias("ticker"), F.lpad(F.col("r.cik_str").cast("string"), 10, "0").alias("cik"))
    return first_per_key(each.where("ticker is not null"), ["ticker"], ["cik"])


def parallel_arrays(raw: DataFrame, keys: list[str], body: str, fields: list[str], path: str = "$") -> DataFrame:
    """A row per position of the JSON arrays at path.field, up to the shortest."""
    arrays = [F.from_json(F.get_json_object(body, f"{path}.{f}"), "array<string>").alias(f) for f in fields]
    held = raw.select(*keys, *arrays)
    size = F.least(*[F.size(f) for f in fields]) if len(fields) > 1 else F.size(fields[0])
    cut = held.select(*keys, F.arrays_zip(*[F.slice(f, 1, F.greatest(size, F.lit(0))).alias(f) for f in fields]).alias("z"))
    return cut.select(*keys, F.explode("z").alias("z")).select(*keys, *[F.col(f"z.{f}").alias(f) for f in fields])


def json_fields(raw: DataFrame, keys: list[str], body: str, fields: dict[str, str]) -> DataFrame:
    """Scalar JSON fields by path; blanks are null."""
    return raw.select(*keys, *[F.nullif(F.trim(F.get_json_object(body, p)), F.lit("")).alias(n) for n, p in fields.items()])


def assert_sha256(spark: SparkSession, path: str, expected: str) -> str:
    """The file's SHA-256; raises if it is not the expected one."""
    found = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()
    if found is None or found[0] != expected.lower():
        raise ValueError(f"{path}: SHA-256 {found and found[0]}, expected {expected}")
    return found[0]


def two_series(a: DataFrame, b: DataFrame, day: str) -> DataFrame:
    """Two daily series side by side by date; days without any value go."""
    out = a.join(b, day, "full")
    return out.na.drop("all", subset=[c for c in out.columns if c != day])


def excel(spark: SparkSession, path: str, sheet: str | int = 0, header: int = 0) -> DataFrame:
    """A small spreadsheet, read on the driver; needs a reader library for its format."""
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet, header=header))
