"""Writers with provenance, and gates on what was written."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_texts(df: DataFrame, path: str, name: str, text: str) -> None:
    """A text file for each row, in a folder name=..; executors write, a row each a file. Names are unique."""
    rows = df.select(F.col(name).cast("string").alias("name"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows.repartition("name").write.mode("overwrite").partitionBy("name").text(path)


def git_commit() -> str:
    """The working tree's commit, with +dirty if it has changes, else 'unknown'."""
    try:
        run = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True, timeout=10, check=True).stdout.strip()
        return run("rev-parse", "HEAD") + ("+dirty" if run("status", "--porcelain") else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def file_sha256(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file, '' where there is none."""
    if not exists(spark, path):
        return ""
    return spark.read.format("binaryFile").load(path).select(F.sha2("content", 256)).first()[0]


def write_table(df: DataFrame, path: str, description: str, command: str, inputs: list[str] = (), fmt: str = "csv") -> dict:
    """Write a table and, beside it, what it was made from, by what and when."""
    spark = df.sparkSession
    if fmt == "csv":
        df.coalesce(1).write.mode("overwrite").csv(path, header=True)
    else:
        df.write.mode("overwrite").format(fmt).save(path)
    rows = spark.read.format(fmt).option("header", True).load(path).count()
    hashes = [{"path": p, "sha256": file_sha256(spark, p)} for p in inputs]
    meta = {"description": description, "command": command, "git_commit": git_commit(), "generated_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "inputs": hashes, "input_sha256": hashes[0]["sha256"] if hashes else "", "rows": rows}
    write_text(spark, path.rstrip("/") + ".meta.json", json.dumps(meta, indent=2))
    return meta


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> bool:
    """Write unless a finished table stands there already."""
    if exists(df.sparkSession, path.rstrip("/") + "/_SUCCESS"):
        return False
    df.write.mode("overwrite").format(fmt).save(path)
    return True


def write_extracts(df: DataFrame, path: str, kind: str) -> None:
    """Text extracts as a table with a folder for each kind."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)


def write_pair(df: DataFrame, path: str, sample_path: str, condition: F.Column) -> tuple[int, int]:
    """Write the whole table and the rows that meet a condition as Parquet; the numbers of rows of both."""
    df.write.mode("overwrite").parquet(path)
    whole = df.sparkSession.read.parquet(path)
    whole.where(condition).write.mode("overwrite").parquet(sample_path)
    return whole.count(), df.sparkSession.read.parquet(sample_path).count()


def report(df: DataFrame, template: str, *cols: str) -> Iterator[str]:
    """One formatted line a row, for a console; partitions come to the driver one after the other."""
    return (r[0] for r in df.select(F.format_string(template, *[F.col(c) for c in cols])).toLocalIterator())


def size_budget(spark: SparkSession, folder: str, limits: dict[str, tuple[int, int]], suffixes: tuple[str, ...] = ()) -> list[str]:
    """What is wrong with a folder's files: missing ones, ones below or above their limits in bytes, and unexpected ones of the suffixes."""
    fs, p = _fs(spark, folder)
    found = {f.getPath().getName(): f.getLen() for f in fs.listStatus(p) if f.isFile()} if fs.exists(p) else {}
    wrong = []
    for name, (low, high) in sorted(limits.items()):
        size = found.get(name)
        if size is None:
            wrong.append(f"missing: {name}")
        elif not low <= size <= high:
            wrong.append(f"{'too small' if size < low else 'over budget'} ({size} bytes): {name}")
    return wrong + [f"unexpected: {n}" for n in sorted(found) if n not in limits and n.endswith(tuple(suffixes) or "\0")]


def missing_and_extra(spark: SparkSession, expected: list[str], present: DataFrame, column: str) -> tuple[list[str], list[str]]:
    """Names expected but absent, and names present but not expected."""
    want = spark.createDataFrame([(x,) for x in expected], f"{column} string")
    have = present.select(column).distinct()
    names = lambda d: sorted(r[0] for r in d.collect())
    return names(want.join(have, column, "left_anti")), names(have.join(want, column, "left_anti"))


def check_claims(claims: DataFrame, tables: DataFrame, prose: str) -> DataFrame:
    """(claim, literal_found, actual, ok): whether each literal stands in the prose and its number agrees with the table.

    claims: claim, literal, key, column, tolerance, percent (0/1). tables: key, column, value in long form.
    """
    stated = F.regexp_extract(F.replace(F.replace("literal", F.lit("−"), F.lit("-")), F.lit(","), F.lit("")), "([+-]?\\d+(?:\\.\\d+)?)", 1).cast("double")
    actual = F.when(F.col("percent") == 1, 100 * F.col("value")).otherwise(F.col("value"))
    out = claims.join(tables, ["key", "column"], "left").withColumn("actual", actual).withColumn("literal_found", F.contains(F.lit(prose), F.col("literal")))
    return out.select("claim", "literal_found", "actual", (F.col("literal_found") & F.coalesce(F.abs(stated - F.col("actual")) <= F.col("tolerance"), F.lit(False))).alias("ok"))
