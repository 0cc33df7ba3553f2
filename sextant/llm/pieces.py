"""SentencePiece encoding and decoding over a lattice of pieces.

Texts are cut into words where no piece crosses. Each distinct word is exploded to its
substrings of bounded length; those that equal an entry of the piece table are the edges of the
word's lattice, grouped by the position where they end. A fold over the positions then keeps
for each prefix the one edge that the model's encoding of the prefix ends with.

For a piece table with additive scores (unigram) that fold is Viterbi, and ``encode_unigram``
runs it relationally: explode, equi-join, group by word, and a higher-order aggregate.
A merge (BPE) table is not additive: the best-scoring path is not what merging gives. There
the fold (``MergeTable``) asks instead whether two neighbouring pieces can stand side by side, which holds
if no merge across their border would come before the merges that made them. Exactly one
path is made of such neighbours, and it is the merged encoding. That test needs the history of
both pieces, so this fold runs in Arrow batches, with each worker's words in a bounded dictionary.

Defined results: null text counts as empty and has no ids; characters outside the table
become their bytes' pieces; repeated rows are encoded each; an empty table gives an empty
result; other columns are not read. Decoding gives the text back exactly, but that the
sign for a blank (U+2581) itself comes back as a blank.
"""

from __future__ import annotations

import re
from array import array

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLANK = "▁"
CACHE_WORDS, CACHE_PAIRS = 600_000, 500_000
_loaded: dict[str, MergeTable] = {}


class MergeTable:
    """A merge model's pieces, and the fold that encodes words with them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {model.id_to_piece(i): i for i in plain}
        self.names = [model.id_to_piece(i) for i in range(n)]
        self.byte_ids = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.bytes = {i: b for b, i in enumerate(self.byte_ids) if model.is_byte(i)}
        self.longest = max(map(len, self.ids))
        # merges come in the order of scores; single characters are there from the start
        self.rank = {p: (-1.0 if len(p) == 1 else -model.get_score(i)) for p, i in self.ids.items()}
        self.parts = {p: self._made_of(p) for p in self.ids}
        self.reach = {p for p, parts in self.parts.items() if len(p) == 1 or parts}
        self._words: dict[str, bytes] = {}
        self._pairs: dict[tuple[str, str], bool] = {}

    def _made_of(self, piece: str) -> tuple[str, str] | None:
        """The two pieces whose merge makes a piece, None for single characters and pieces that merging never makes."""
        held, last = list(piece), None
        while len(held) > 1:
            best = min(((self.rank[a + b], i) for i, (a, b) in enumerate(zip(held, held[1:])) if a + b in self.rank), default=None)
            if best is None:
                return None
            i = best[1]
            last = held[i], held[i + 1]
            held[i : i + 2] = [held[i] + held[i + 1]]
        return last

    def neighbours(self, a: str, b: str) -> bool:
        """Whether merging leaves a and b side by side."""
        if (a, b) in self._pairs:
            return self._pairs[a, b]
        rank, parts, x, y, before = self.rank, self.parts, a, b, (float("inf"), 1)
        found = None
        while found is None:
            # the merge over the border: it stands right of what made x and left of what made y
            over = rank.get(x + y)
            if over is not None and (over, 0.5) < before:
                found = False
            elif not parts[x] and not parts[y]:
                found = True
            elif parts[x] and (not parts[y] or rank[x] > rank[y]):
                before, x = (rank[x], 0), parts[x][1]
            else:
                before, y = (rank[y], 1), parts[y][0]
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        self._pairs[a, b] = found
        return found

    def word(self, word: str) -> bytes:
        """The word's ids as little-endian unsigned 32-bit integers."""
        n, known, reach, longest = len(word), self.ids, self.reach, self.longest
        ends: list[str | None] = [None] * (n + 1)  # the piece that ends the encoding of each prefix; '' for a foreign character
        for end in range(1, n + 1):
            for start in range(max(0, end - longest), end):
                piece = word[start:end]
                if piece in reach and (start == 0 or ends[start] is not None and (ends[start] == "" or self.neighbours(ends[start], piece))):
                    ends[end] = piece
                    break
            else:
                if word[end - 1] not in known:
                    ends[end] = ""
        out, at = [], n
        while at:
            piece = ends[at]
            if piece:
                out.append(known[piece])
                at -= len(piece)
            else:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode("utf-8", "surrogatepass"))]
                at -= 1
        return array("I", out[::-1]).tobytes()

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        out, held = [], self._words
        for word in _WORDS.findall(BLANK + text.replace(" ", BLANK)):
            ids = held.get(word)
            if ids is None:
                ids = self.word(word)
                if len(word) <= 40 and len(held) < CACHE_WORDS:
                    held[word] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        out, names, single = [], self.names, self.bytes
        for i in memoryview(ids).cast("I"):
            b = single.get(i)
            out.append(names[i].encode() if b is None else bytes((b,)))
        text = b"".join(out).decode("utf-8", "surrogatepass").replace(BLANK, " ")
        return text[1:] if text else text


# A piece holds the sign for a blank only at its start, and no line end.
_WORDS = re.compile(f"{BLANK}*[^{BLANK}\n]+|{BLANK}+|\n")


def table_of(path: str) -> MergeTable:
    if path not in _loaded:
        _loaded[path] = MergeTable(path)
    return _loaded[path]


def _mapped(rows: DataFrame, value: str, work, kind: str, out: str) -> DataFrame:
    """rows (id, value) to (id, out)."""
    id_kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        to = pa.binary() if kind == "binary" else pa.string()
        for batch in batches:
            at, held, size = 0, [], 0
            for i, x in enumerate(batch.column(1)):
                held.append(work(x.as_py()))
                size += len(held[-1])
                if size > 8 << 20 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, i + 1 - at), pa.array(held, to)], names=["id", out])
                    at, held, size = i + 1, [], 0

    return rows.select("id", value).mapInArrow(run, f"id {id_kind}, {out} {kind}")


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return _mapped(rows, "text", lambda t: table_of(model).encode(t or ""), "binary", "ids").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of encoded rows."""
    rows = encoded.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{ids_col}`").alias("ids"))
    return _mapped(rows, "ids", lambda x: table_of(model).decode(x or b""), "string", "text").withColumnRenamed("id", id_col)


def encode_unigram(words: DataFrame, pieces: DataFrame, word: str = "word", longest: int = 16) -> DataFrame:
    """(word, pieces): the best-scoring split of each distinct word into entries of pieces (piece, score); null if there is none.

    Equal scores go to the path whose last piece starts first.
    """
    distinct = words.select(F.col(word).alias("word")).where("word is not null").distinct()
    n = F.char_length("word")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda e: F.transform(F.sequence(F.greatest(F.lit(0), e - longest), e - 1), lambda s: F.struct(e.alias("e"), s.alias("s")))))
    exploded = distinct.where(n > 0).select("word", F.explode(spans).alias("x")).select("word", F.col("x.e").alias("e"), F.col("x.s").alias("s"), F.substring("word", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("piece"))
    edges = exploded.join(pieces.select("piece", F.col("score").cast("double")), "piece").groupBy("word").agg(F.array_sort(F.collect_list(F.struct("e", "s", "piece", "score"))).alias("edges"))
    state = "map<int,struct<score:double,path:array<string>>>"
    start = F.map_from_arrays(F.array(F.lit(0)), F.array(F.struct(F.lit(0.0).alias("score"), F.array().cast("array<string>").alias("path")))).cast(state)

    def step(acc, x):
        before, here = F.element_at(acc, x["s"]), F.element_at(acc, x["e"])
        total = before["score"] + x["score"]
        better = before.isNotNull() & (here.isNull() | (total > here["score"]))
        new = F.struct(total.alias("score"), F.concat(before["path"], F.array(x["piece"])).alias("path"))
        return F.when(better, F.map_concat(F.map_filter(acc, lambda k, v: k != x["e"]), F.map_from_arrays(F.array(x["e"]), F.array(new))).cast(state)).otherwise(acc)

    best = F.element_at(F.aggregate("edges", start, step), n)["path"]
    return distinct.join(edges.select("word", best.alias("pieces")), "word", "left")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), model)

    def run(batches):
        import pyarrow as pa
        from hashlib import sha256

        back = table_of(model).decode
        for batch in batches:
            digest = [sha256(back(x.as_py()).encode("utf-8", "surrogatepass")).hexdigest() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digest)], names=["doc_id", "ids", "text_sha256"])

    read = encoded.mapInArrow(run, "doc_id long, ids binary, text_sha256 string")
    return read.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "text_sha256")
