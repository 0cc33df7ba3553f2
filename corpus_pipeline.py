"""The corpus pipeline: from raw documents to training sequences.

Five stages, each of which works on all that its predecessor kept: documents of low quality go,
exact copies go, one document of each group of near-duplicates stays, passages that an
earlier document has are cut out, and the rest is packed into sequences. All stages but
the last return the columns of documents. A run writes every stage to the shared folder
and reads it again, so a lost executor costs no earlier stage; a stage's table goes when the
next one is written.

Defined results: a null text is an empty one (kept by the first stage, then one of equal texts,
linked with nothing, packed as the closing id); a null doc_id stays null; rows that repeat a
doc_id and text are copies; empty tables give empty results; other columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sextant.llm.common import materialise, release, table
from sextant.llm.exact_dedup import exact_dedup
from sextant.llm.near_dedup import near_dedup
from sextant.llm.packing import pack
from sextant.llm.quality import keep_good
from sextant.llm.suffix_dedup import remove_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents whose perplexity lies above their language's threshold."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the smallest doc_id."""
    return exact_dedup(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 on five-word shingles, the one with the smallest doc_id."""
    return near_dedup(docs, words=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what repeats an earlier document or an earlier part of their own."""
    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, with lengths that are powers of two."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality),
    ("exact_dedup", copies),
    ("near_dedup", near_copies),
    ("suffix_dedup", repeats),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir))
        release(before)
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the perplexity model, the tokenizer's merges or the near-duplicate components.
ORACLE_SQL = None
