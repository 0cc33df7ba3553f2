"""Packing by power-of-two decomposition.

Each document's ids (and a closing id) are cut into pieces whose lengths are powers of
two: as many of the greatest length as fit, then the binary digits of what is left. A
piece is a training sequence of its own, so no sequence crosses documents, none is
padded, and pieces of equal length share a bucket (``write_buckets``). The work is one narrow pass without a
shuffle; a task holds one Arrow batch of texts and at most FLUSH bytes of pieces.

Defined results: null and empty texts are the closing id alone; repeated rows are packed
each; an empty table gives an empty result; only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

FLUSH = 8 << 20
PIECES = "start long, length long, ids binary, doc_tokens long"


def cuts(n: int, longest: int):
    """(start, length) of the pieces of n ids; longest is a power of two."""
    at = 0
    while n - at >= longest:
        yield at, longest
        at += longest
    size = longest >> 1
    while size:
        if (n - at) & size:
            yield at, size
            at += size
        size >>= 1


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", longest: int = 1024, close_id: int = 0) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, bucket, sequence_id, offset."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pieces(batches):
        import pyarrow as pa

        encode, close = encoder(tokenizer).encode_text, close_id.to_bytes(4, "little")
        for batch in batches:
            keys, kind = batch.column(0), batch.schema.field(0).type
            schema = pa.schema([("id", kind), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())])
            rows, held = ([], [], [], [], []), 0

            def flush(rows=rows, keys=keys, schema=schema):
                made = pa.RecordBatch.from_arrays([keys.take(pa.array(rows[0], pa.int64())), *(pa.array(r, f.type) for r, f in zip(rows[1:], list(schema)[1:]))], schema=schema)
                for r in rows:
                    r.clear()
                return made

            for k, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + close
                n = len(ids) >> 2
                for at, size in cuts(n, longest):
                    for r, v in zip(rows, (k, at, size, ids[4 * at : 4 * (at + size)], n)):
                        r.append(v)
                held += len(ids)
                if held > FLUSH:
                    yield flush()
                    held = 0
            if rows[0]:
                yield flush()

    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    made = narrow.mapInArrow(pieces, f"id {narrow.schema['id'].dataType.simpleString()}, {PIECES}")
    return made.select(
        F.col("id").alias(id_col), "start", "length", "ids", "doc_tokens",
        F.log2("length").cast("int").alias("bucket"), F.monotonically_increasing_id().alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def write_buckets(packed: DataFrame, path: str) -> None:
    """Write packed sequences with a folder for each length, so that batches of one length are read without padding."""
    packed.write.mode("overwrite").partitionBy("bucket").parquet(path)


def op1_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
