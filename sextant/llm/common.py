"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A job's shuffle files go when it ends: Spark's own setting, switched on for the jobs of materialise.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Rows of a task in the steps whose number of rows is known beforehand.
TASK_ROWS = 100_000

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or a temporary one on a single machine where it is unset (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sextant-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return "file://" + _own_dirs[app]


def _on_file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialise(df: DataFrame) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not a recomputation. The job's
    shuffle files go with the job; the table itself goes with release, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sextant-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    target, files = _on_file_system(spark, path)
    files.deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote. Nothing that is still to be run may read them."""
    for t in tables:
        path = getattr(t, "_written_to", None)
        if path:
            target, files = _on_file_system(t.sparkSession, path)
            files.delete(target, True)


def parts(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_tasks(df: DataFrame, rows: int) -> DataFrame:
    """df in no more tasks than its (known or greatest) number of rows calls for, 8 at least; large tables stay as they are.

    After a shuffle this joins neighbouring partitions into one task, as adaptive execution does where it may.
    """
    n = max(8, -(-rows // TASK_ROWS))
    return df.coalesce(n) if n < parts(df.sparkSession) else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_text(column: str) -> F.Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Components of an undirected graph, without collecting it anywhere.

    edges has columns a, b (same orderable type). Returns one row (node, component)
    per node that has an edge, component being the smallest node it can reach.
    Large-star and small-star rounds alternate, with each round's edges written to the
    shared folder, where they replace the round's before; the number of rounds grows with the
    logarithm of the diameter. Minima are aggregated before they are shuffled, and a hub's
    minimum reaches its neighbours by broadcast (see by_key), so no task gets them all.
    Nulls and self loops are dropped; an empty input gives an empty result.
    """
    kind = edges.schema["a"].dataType

    def written(rows: DataFrame):
        seen = Observation()
        out = materialise(rows.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")))
        return out, (seen.get["n"], seen.get["s"])

    edges, before = written(
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a is not null and b is not null and a <> b").distinct()
    )
    for _ in range(max_rounds):
        n = before[0]
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = in_tasks(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("degree")), n)
        # large star: every larger neighbour is tied to the smallest node around
        up = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        large = by_key(up, lows, "a", "degree", "b", total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        # small star: the node and its smaller neighbours are tied to the smallest of them
        floor = in_tasks(large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("degree")), n)
        small = by_key(large, floor, "a", "degree", "b", total=n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        next_, now = written(in_tasks(small.union(floor.select("a", F.col("m").alias("b"))).distinct(), 2 * n))
        release(edges)
        edges = next_
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("the components did not settle")
    n = before[0]
    pairs = in_tasks(edges.groupBy("a").agg(F.min("b").alias("component")), n)
    roots = in_tasks(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct(), n)
    out = materialise(pairs.select(F.col("a").cast(kind).alias("node"), F.col("component").cast(kind)).union(roots.select(F.col("node").cast(kind), F.col("component").cast(kind))))
    release(edges)
    return out


def by_key(rows: DataFrame, lookup: DataFrame, key: str, weight: str, spread: str, total: int | None = None) -> DataFrame:
    """Left join of rows to lookup on key when a few keys may hold most rows.

    lookup is unique on key and has a column weight, the rows that its key stands for.
    Keys with at least 1/2000 of the total weight (2,000 at most, by arithmetic) are joined by
    broadcast; rows of such keys take part in the shuffled join under keys of their own, from
    column spread, so no task gets them all. weight is dropped. total, where it is known, is
    at least the sum of the weights and the number of rows.
    """
    values = [c for c in lookup.columns if c not in (key, weight)]
    size = total
    if total is None:
        total = lookup.agg(F.sum(weight)).first()[0] or 0
    heavy = F.col(weight) >= max(1000, total / 2000)
    hot = lookup.where(heavy).select(F.col(key).alias("__hot"), F.struct(F.lit(1).alias("__one"), *values).alias("__h"))
    cold = lookup.where(~heavy).select(F.xxhash64(key).alias("__to"), F.col(key).alias("__cold"), F.struct(*values).alias("__c"))
    out = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    out = out.withColumn("__from", F.when(F.col("__h").isNull() & F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(F.lit("hot"), spread)))
    out = out.join(cold, (F.col("__from") == F.col("__to")) & (F.col(key) == F.col("__cold")), "left")
    out = out if size is None else in_tasks(out, size)
    picked = [F.when(F.col("__h").isNull(), F.col("__c")[v]).otherwise(F.col("__h")[v]).alias(v) for v in values]
    return out.select(*rows.columns, *picked)
