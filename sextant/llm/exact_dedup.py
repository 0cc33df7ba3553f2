"""Exact deduplication by skew-safe combining (DataFrame functions only).

Texts are first merged inside each map task (Spark's partial aggregation), then per
(digest, salt, text), and the salt winners are combined per (digest, text). The text is
part of the grouping key at each stage, so contents are compared and not digests alone.
A group of any size reaches the last stage as at most ``salts`` rows.

Defined results: null text counts as empty, and empty texts are equal to each other. Of
equal texts the smallest id stays; a null id stays only if its whole group has null ids;
among rows that repeat both id and text, the first in scan order stays. An empty table
gives an empty result. Other columns, whatever their names, are carried or dropped, never
read. The input must be a table (a deterministic scan), since it is scanned twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

SPACES = "[\\x20\\x09-\\x0D]+"
#: Groups of at least this share of all rows are joined by broadcast: there can be no more than 1 / HOT_SHARE of them.
HOT_SHARE = 1 / 2000


def normalised(text: F.Column) -> F.Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Row id, id, normalised text and digest, beside the rows themselves in column row."""
    return docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), normalised(F.col(f"`{text_col}`")).alias("norm"),
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
    ).withColumn("digest", F.unhex(F.sha2("norm", 256)))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """One row per group of two or more equal texts: digest, part, keep_id, keep_rid, group_size.

    part, a hash of the text, tells apart different texts of one digest.
    """
    rows = _keyed(docs, id_col, text_col)
    # null ids sort last
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "rid"))
    local = rows.groupBy("digest", F.pmod("rid", F.lit(salts)).alias("salt"), "norm").agg(first.alias("keep"), F.count("*").alias("n"))
    best = local.groupBy("digest", "norm").agg(F.min("keep").alias("keep"), F.sum("n").alias("n"))
    return materialise(best.where("n > 1").select("digest", F.col("keep.id").alias("keep_id"), F.col("keep.rid").alias("keep_rid"), F.col("n").alias("group_size"), F.xxhash64("norm").alias("part")))


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """Every input row as struct column ``row`` with keep_id, group_size, kept and text_sha256.

    Groups that hold a large share of the rows are joined by broadcast; their number is
    bounded by 1 / HOT_SHARE. All others are joined by shuffle on the digest.
    """
    groups = exact_groups(docs, id_col, text_col, salts)
    total = groups.agg(F.sum("group_size")).first()[0] or 0
    hot = groups.where(F.col("group_size") >= max(1000, total * HOT_SHARE))
    cold = groups.where(F.col("group_size") < max(1000, total * HOT_SHARE))
    rows = _keyed(docs, id_col, text_col).withColumn("part", F.xxhash64("norm")).drop("norm")
    joined = rows.join(F.broadcast(hot.select("digest", "part", F.struct("keep_id", "keep_rid", "group_size").alias("hot"))), ["digest", "part"], "left")
    cold = cold.select("digest", "part", F.struct("keep_id", "keep_rid", "group_size").alias("cold"))
    # rows of hot groups need no partner here; a key of their own spreads them
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.encode(F.col("rid").cast("string"), "utf-8"))
    joined = joined.withColumn("join_key", key).join(cold.withColumnRenamed("digest", "join_key"), ["join_key", "part"], "left")
    found = F.coalesce("hot", "cold")
    return joined.select(
        "row", "id",
        F.when(found.isNull(), F.col("id")).otherwise(found["keep_id"]).alias("keep_id"),
        F.coalesce(found["group_size"], F.lit(1)).cast("long").alias("group_size"),
        (found.isNull() | (found["keep_rid"] == F.col("rid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """The input's rows and columns without the copies."""
    return mark_copies(docs, id_col, text_col, salts).where("kept").select("row.*")


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    marked = mark_copies(docs.select("doc_id", "text"))
    return marked.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents
)
select doc_id,
       min(doc_id) over (partition by norm) as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over (partition by norm order by doc_id) = 1 as kept,
       sha256(norm) as text_sha256
from t
"""
