"""Quality by perplexity under an interpolated modified Kneser-Ney model.

A character 4-gram model is trained on all trusted texts. Counts are gathered per block of
texts and then by n-gram; continuation counts, follower counts and discounts come from
joins of the count tables, sharded by n-gram and by context. The finished table of
probabilities and back-off weights is applied in one narrow pass while it has at most
MODEL_ROWS rows (checked), and beyond that by joins sharded by n-gram.

A document is rejected if its perplexity lies above its language's threshold, which is
set from quantiles of all documents of that language: on logarithms, the upper quartile plus
``fence`` times the distance between the quartiles, and more for short texts. (Trusted documents are no measure, since the model
knows them: their own perplexities lie too low.) So a language loses its outliers alone, however
few trusted texts it has; where more than a quarter of it is bad, the bad sets the scale.

Defined results: null and empty texts have no perplexity (null) and are kept, since
nothing speaks against them; a null language is a language of its own; repeated rows get
equal scores; a document is trusted if any label row of its id says so; without trusted text
all perplexities and thresholds are null and all is kept; empty tables give empty results;
other columns are carried or dropped, never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

ORDER, BITS = 4, 16
#: Stands before a text; no character, so no text holds it.
START = 0xFFFF
#: Rows of the model that a worker may hold (about 100 MB), and ids that may be broadcast (16 MB).
MODEL_ROWS, BROADCAST_IDS = 4_000_000, 2_000_000
BLOCK = 1 << 20


def grams(texts: list[str]):
    """(document, code) of every symbol's 4-gram. Symbols are UTF-16 code units; a code holds four of them, the last one lowest."""
    import numpy as np

    start = START.to_bytes(2, "little") * (ORDER - 1)
    coded = [t.encode("utf-16-le", "surrogatepass") for t in texts]
    symbols = np.frombuffer(b"".join(x for t in coded for x in (start, t)), "<u2").astype(np.uint64)
    sizes = np.array([len(t) >> 1 for t in coded], np.int64)
    n = max(len(symbols) - ORDER + 1, 0)
    codes = np.zeros(n, np.uint64)
    for j in range(ORDER):
        codes = codes << np.uint64(BITS) | symbols[j : j + n]
    owner = np.repeat(np.arange(len(texts)), sizes)
    begin = np.cumsum(sizes + ORDER - 1) - sizes - (ORDER - 1)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    codes = codes.view(np.int64)
    return owner, codes[begin[owner] + inside] if len(owner) else codes[:0]


def _blocks(column):
    """(first row, texts) of stretches with about BLOCK characters."""
    first, held, size = 0, [], 0
    for i, text in enumerate(column):
        held.append(text.as_py() or "")
        size += len(held[-1])
        if size >= BLOCK:
            yield first, held
            first, held, size = i + 1, [], 0
    if held:
        yield first, held


def train(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """The model: (kind, gram, value). kind k is a probability of order k, kind -k a back-off weight of a context before order k."""

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for _, some in _blocks(batch.column(0)):
                code, n = np.unique(grams(some)[1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["gram", "n"])

    top = texts.select(F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(count, "gram long, n long")
    counts = {ORDER: materialise(top.groupBy("gram").agg(F.sum("n").alias("n")))}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: in how many longer n-grams it ends
        counts[k] = materialise(counts[k + 1].groupBy(F.col("gram").bitwiseAND((1 << BITS * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    lower, made, held = None, [], []
    for k in range(1, ORDER + 1):
        seen = counts[k].agg(*[F.count_if(F.col("n") == i).alias(f"n{i}") for i in range(1, 5)]).first()
        n1, n2, n3, n4 = (max(x, 1) for x in seen)
        y = n1 / (n1 + 2 * n2)
        # the usual closed form of the three discounts, held within [0, count]
        d = [min(max(i - (i + 1) * y * b / a, 0.0), i) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        rows = counts[k].withColumn("context", F.shiftrightunsigned("gram", BITS))
        contexts = rows.groupBy("context").agg(F.sum("n").alias("total"), (F.sum(off)).alias("taken"))
        weights = materialise(contexts.select("context", "total", (F.col("taken") / F.col("total")).alias("weight")))
        rows = rows.join(weights, "context")
        if k == 1:
            base = rows.withColumn("below", F.lit(1.0 / (1 << BITS)))
        else:
            base = rows.withColumn("short", F.col("gram").bitwiseAND((1 << BITS * (k - 1)) - 1)).join(lower.select(F.col("gram").alias("short"), F.col("p").alias("below")), "short")
        lower = materialise(base.select("gram", ((F.col("n") - off) / F.col("total") + F.col("weight") * F.col("below")).alias("p")))
        held += [lower, weights]
        made += [lower.select(F.lit(k).alias("kind"), "gram", F.col("p").alias("value")), weights.select(F.lit(-k).alias("kind"), F.col("context").alias("gram"), F.col("weight").alias("value"))]
    out = made[0]
    for m in made[1:]:
        out = out.union(m)
    out = materialise(out)
    release(*counts.values(), *held)
    return out


class Table:
    """The model in a worker's memory."""

    def __init__(self, kind, gram, value):
        import numpy as np

        self.parts = {}
        for k in sorted({*kind.tolist()}):
            at = np.flatnonzero(kind == k)
            by = at[np.argsort(gram[at])]
            self.parts[k] = gram[by], value[by]

    def _find(self, kind: int, gram):
        import numpy as np

        known, value = self.parts.get(kind, (np.empty(0, np.int64), np.empty(0)))
        if not len(known):
            return np.zeros(len(gram), bool), np.zeros(len(gram))
        at = np.minimum(np.searchsorted(known, gram), len(known) - 1)
        return known[at] == gram, value[at]

    def logs(self, codes):
        """Natural logarithms of the probabilities of 4-gram codes."""
        import numpy as np

        p = np.full(len(codes), 1.0 / (1 << BITS))
        for k in range(1, ORDER + 1):
            gram = codes & ((1 << BITS * k) - 1) if k < ORDER else codes
            seen, own = self._find(k, gram)
            known, weight = self._find(-k, (gram.view(np.uint64) >> np.uint64(BITS)).view(np.int64))
            p = np.where(seen, own, np.where(known, weight * p, p))
        return np.log(p)


def _score_pass(rows: DataFrame, model: DataFrame) -> DataFrame:
    import numpy as np

    got = model.toPandas()  # MODEL_ROWS at most
    shared = rows.sparkSession.sparkContext.broadcast((got.kind.to_numpy(np.int8), got.gram.to_numpy(), got.value.to_numpy()))

    def run(batches):
        import pyarrow as pa

        table = Table(*shared.value)
        for batch in batches:
            nll, size = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for first, some in _blocks(batch.column(1)):
                owner, code = grams(some)
                unique, at = np.unique(code, return_inverse=True)
                nll[first : first + len(some)] = -np.bincount(owner, table.logs(unique)[at], len(some))
                size[first : first + len(some)] = np.bincount(owner, minlength=len(some))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nll), pa.array(size)], names=["rid", "nll", "size"])

    return rows.select("rid", "text").mapInArrow(run, "rid long, nll double, size long")


def _score_joined(rows: DataFrame, model: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            rid = batch.column(0).to_numpy()
            for first, some in _blocks(batch.column(1)):
                owner, code = grams(some)
                both, n = np.unique(np.stack([owner, code]), axis=1, return_counts=True) if len(code) else (np.empty((2, 0), np.int64), np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(rid[first + both[0]]), pa.array(both[1]), pa.array(n)], names=["rid", "gram", "n"])

    each = rows.select("rid", "text").mapInArrow(run, "rid long, gram long, n long").withColumn("p", F.lit(1.0 / (1 << BITS)))
    for k in range(1, ORDER + 1):
        lowest = F.col("gram").bitwiseAND((1 << BITS * k) - 1) if k < ORDER else F.col("gram")
        each = each.withColumn("g", lowest).withColumn("h", F.shiftrightunsigned("g", BITS))
        each = each.join(model.where(F.col("kind") == k).select(F.col("gram").alias("g"), F.col("value").alias("own")), "g", "left")
        each = each.join(model.where(F.col("kind") == -k).select(F.col("gram").alias("h"), F.col("value").alias("weight")), "h", "left")
        each = each.select("rid", "gram", "n", F.coalesce("own", F.col("weight") * F.col("p"), "p").alias("p"))
    return each.groupBy("rid").agg((-F.sum(F.col("n") * F.log("p"))).alias("nll"), F.sum("n").alias("size"))


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = 2.0, short: int = 1000, model_rows: int = MODEL_ROWS) -> DataFrame:
    """(rid, id, lang, perplexity, threshold, kept) for each document; rid is the row's monotonically_increasing_id().

    labels has doc_id and quality; quality 1 marks trusted documents. The distance between a language's quartiles counts
    sqrt(1 + short / size) times for a text of size symbols, as the mean of a few symbols strays further.
    """
    ids = labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("id")).distinct()
    ids = materialise(ids)
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{lang_col}`").alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    model = train(rows.join(few, "id", "left_semi"))
    n = model.count()
    scored = _score_pass(rows, model) if n <= model_rows else _score_joined(rows, model)
    bits = F.when((F.col("size") > 0) & F.lit(n > 0), F.col("nll") / F.col("size"))
    scored = materialise(rows.select("rid", "id", "lang").join(scored, "rid", "left").select("rid", "id", "lang", F.round(bits, 4).alias("bits"), F.exp(bits).alias("perplexity"), "size"))
    release(ids, model)
    # quantiles from histograms on a grid of 1e-4, whose size does not grow with the corpus
    seen = scored.where("bits is not null").groupBy("lang", "bits").agg(F.count("*").alias("f"))
    quartiles = seen.groupBy(F.col("lang").alias("of")).agg(F.percentile("bits", F.array(F.lit(0.25), F.lit(0.75)), F.col("f")).alias("q"))
    # a row a language
    out = scored.join(F.broadcast(quartiles), F.col("lang").eqNullSafe(F.col("of")), "left")
    limit = F.round(F.col("q")[1] + fence * F.sqrt(1 + short / F.col("size")) * (F.col("q")[1] - F.col("q")[0]), 4)
    out = out.withColumn("limit", F.when(F.col("bits").isNotNull(), limit))
    return out.select("rid", "id", "lang", "perplexity", F.exp("limit").alias("threshold"), F.coalesce(F.col("bits") <= F.col("limit"), F.lit(True)).alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = 2.0) -> DataFrame:
    """The input's rows and columns without the rejected documents. The input must be a table (a deterministic scan)."""
    gone = materialise(score(docs, labels, id_col, text_col, lang_col, fence=fence).where("not kept").select(F.col("rid").alias("__rid")))
    rid = F.monotonically_increasing_id()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.withColumn("__row", rid).join(gone, F.col("__row") == F.col("__rid"), "left_anti").drop("__row")


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, labels).select(F.col("id").alias("doc_id"), "lang", F.round("perplexity", 6).alias("perplexity"), F.round("threshold", 6).alias("threshold"), "kept")
