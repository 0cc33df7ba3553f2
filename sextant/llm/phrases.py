"""Phrases whose words occur together more often than their parts let expect, from position bitmaps.

A shard of documents is a line of positions, one a word and one a break (the end of a piece
or document). Each word has a compressed bitmap of its positions: the 64-bit words of it that
are not zero, with their places. A phrase's bitmap, shifted by one and ANDed with those of the
words that stand there, gives the bitmaps of its extensions, and their popcounts the shard's
counts; breaks belong to no word, so no phrase crosses one. Phrases are extended depth-first by ranges of
first words, which bounds the memory of a shard. Counts of all shards are summed by phrase.

Phrases of three or more words are counted in a further pass for each length, in which a shard
extends only what can still be frequent: a bit map of fixed size (BITS) of the frequent phrases one
word shorter is broadcast, and the phrase's beginning and end must both be in it. The map lets some others pass, more
of them as the corpus grows, which costs work and changes no result.

Defined results: a null text is empty; null languages are ``und``; repeated rows and ids count each; a
piece without words gives nothing; a text of any length is read whole, as a shard of its own where it
is longer than one; empty tables give empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, release

#: Ends of pieces, which become full stops, blanks, and letters that are lower-cased.
ENDS, BLANKS = b".,;:!?\x0a\x0b\x0c\x0d", b"\t"
FOLD = bytes.maketrans(ENDS + BLANKS + bytes(range(65, 91)), b"." * len(ENDS) + b" " * len(BLANKS) + bytes(range(97, 123)))
#: Characters of a shard, bitmap words that are extended at once, and bits of the map of frequent phrases (16 MB).
SHARD, AT_ONCE, BITS = 1 << 22, 1 << 18, 1 << 27
LEAST, LONGEST, TOP = 10, 3, 2000
#: Parts in which a language's candidates are cut to the best before they meet.
PARTS = 64


class Shard:
    """Texts as positions, and the bitmaps of their words."""

    def __init__(self, texts: list[tuple[str, bytes]]):
        """texts: (language, text in UTF-8)."""
        from collections import defaultdict
        from itertools import count

        import numpy as np

        fresh, numbers, lines = count(1).__next__, {}, []
        for lang, text in texts:
            if lang not in numbers:
                numbers[lang] = defaultdict(fresh, {b".": 0})
            tokens = (text.translate(FOLD) + b".").replace(b".", b" . ").split()
            lines.append(np.fromiter(map(numbers[lang].__getitem__, tokens), np.int64, len(tokens)))
        self.ids = np.concatenate(lines) if lines else np.empty(0, np.int64)
        self.words, self.langs = [b""], [""]
        named = sorted((i, lang, w) for lang, own in numbers.items() for w, i in own.items() if i)
        self.words += [w for _, _, w in named]
        self.langs += [lang for _, lang, _ in named]
        blocks = (len(self.ids) >> 6) + 1
        at = np.arange(len(self.ids))
        key = self.ids * blocks + (at >> 6)
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        masks = np.bitwise_or.reduceat(np.uint64(1) << (order & 63).astype(np.uint64), first) if len(key) else np.empty(0, np.uint64)
        #: the bitmap word in which each position's word has it
        self.around = np.empty(len(at), np.uint64)
        self.around[order] = np.repeat(masks, np.diff(np.r_[first, len(key)]))
        word, block = key[first] // blocks, key[first] % blocks
        real = int(np.searchsorted(word, 1))  # breaks have bitmaps too, but begin no phrase
        self.word, self.block, self.mask = word[real:], block[real:], masks[real:]

    def ranges(self):
        """(numbers of first words, bitmaps as (row, block, mask)) for ranges of about AT_ONCE bitmap words."""
        import numpy as np

        start = 0
        while start < len(self.word):
            stop = min(start + AT_ONCE, len(self.word))
            stop = int(np.searchsorted(self.word, self.word[stop - 1], "right"))
            words, row = np.unique(self.word[start:stop], return_inverse=True)
            yield words, (row, self.block[start:stop], self.mask[start:stop])
            start = stop

    def extend(self, bitmaps):
        """(row, next word, count, bitmaps) of all extensions of phrases by a word, those of a phrase after another."""
        import numpy as np

        row, block, mask = bitmaps
        over = np.flatnonzero(mask >> np.uint64(63))
        row, block, mask = np.r_[row, row[over]], np.r_[block, block[over] + 1], np.r_[mask << np.uint64(1), np.ones(len(over), np.uint64)]
        found = []
        while True:
            left = np.flatnonzero(mask)
            if not len(left):
                break
            row, block, mask = row[left], block[left], mask[left]
            at = (block << 6) + np.bitwise_count((mask & (~mask + np.uint64(1))) - np.uint64(1))
            word, hit = self.ids[at], mask & self.around[at]
            found.append((row, word, block, hit))
            mask = mask & ~hit
        if not found:
            return *[np.empty(0, np.int64)] * 3, bitmaps
        row, word, block, hit = (np.concatenate(x) for x in zip(*found))
        real = np.flatnonzero(word)
        row, word, block, hit = row[real], word[real], block[real], hit[real]
        key = row * len(self.words) + word
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        n = np.add.reduceat(np.bitwise_count(hit[order]).astype(np.int64), first) if len(key) else np.empty(0, np.int64)
        group = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(key)]))
        return key[first] // len(self.words), key[first] % len(self.words), n, (group, block[order], hit[order])


def _kept(keep, bitmaps):
    """The bitmaps of some phrases (keep: a truth value a phrase), which are numbered anew."""
    import numpy as np

    row, block, mask = bitmaps
    at = keep[row]
    return (np.cumsum(keep) - 1)[row[at]], block[at], mask[at]


def _hashed(hashes, columns):
    """A 64-bit hash of each phrase, given the hash of every word and the words of the phrases, a column each."""
    import numpy as np

    out = hashes[columns[0]]
    for c in columns[1:]:
        out = (out ^ hashes[c]) * np.uint64(0x9E3779B97F4A7C15)
        out = out ^ (out >> np.uint64(29))
    return out


def _word_hashes(langs, words):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    seeds = {x: xxh3_64_intdigest(x.encode()) >> 1 for x in set(langs)}
    return np.fromiter((xxh3_64_intdigest(w, seeds[x]) for x, w in zip(langs, words)), np.uint64, len(words))


def phrases(shard: Shard, length: int, maps: dict):
    """(columns, counts) of the phrases of a length that can be frequent by the maps of shorter ones (length: bytes), by ranges of first words."""
    import numpy as np

    hashes = _word_hashes(shard.langs, shard.words) if maps else None

    def known(columns):
        held = np.frombuffer(maps[len(columns)], np.uint8)
        place = _hashed(hashes, columns) % np.uint64(8 * len(held))
        return (held[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 == 1

    for words, bitmaps in shard.ranges():
        columns = [words]
        while len(columns) < length and len(columns[0]):
            row, word, n, bitmaps = shard.extend(bitmaps)
            columns = [*(c[row] for c in columns), word]
            keep = None
            if len(columns) in maps:
                keep = known(columns)
            elif len(columns) - 1 in maps:
                keep = known(columns[1:])
            if keep is not None:
                columns, n, bitmaps = [c[keep] for c in columns], n[keep], _kept(keep, bitmaps)
        if len(columns) == length:
            yield columns, n


def _counts(docs: DataFrame, length: int, shared, text_col: str, lang_col: str) -> DataFrame:
    """(key, n): occurrences of phrases by shard. A key is the language and the phrase, with a newline between; with length 2 also of single words, and of all words as an empty phrase."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        def rows(held):
            shard = Shard(held)
            names, langs = pa.array(shard.words, pa.binary()).cast(pa.string()), pa.array(shard.langs, pa.string())
            if length == 2:
                n = np.bincount(shard.ids, minlength=len(shard.words))[1:]
                yield pc.binary_join_element_wise(langs[1:], names[1:], "\n"), pa.array(n)
                all_ = {}
                for lang, x in zip(shard.langs[1:], n.tolist()):
                    all_[lang] = all_.get(lang, 0) + x
                yield pa.array([f"{x}\n" for x in all_], pa.string()), pa.array(all_.values(), pa.int64())
            for columns, n in phrases(shard, length, shared.value if shared else {}):
                words = pc.binary_join_element_wise(*[names.take(pa.array(c)) for c in columns], " ")
                yield pc.binary_join_element_wise(langs.take(pa.array(columns[0])), words, "\n"), pa.array(n)

        held, size = [], 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                held.append((lang, text.as_py() or b""))
                size += len(held[-1][1])
                if size >= SHARD:
                    for key, n in rows(held):
                        yield pa.RecordBatch.from_arrays([key, n], names=["key", "n"])
                    held, size = [], 0
        for key, n in rows(held):
            yield pa.RecordBatch.from_arrays([key, n], names=["key", "n"])

    narrow = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.encode(F.col(f"`{text_col}`").cast("string"), "utf-8").alias("text"))
    return narrow.mapInArrow(run, "key string, n long")


def _map(frequent: DataFrame, length: int, bits: int) -> bytes:
    """The bit map of frequent phrases: bits / 8 bytes, whatever their number."""

    def places(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            langs = batch.column(0).to_pylist()
            split = [p.encode().split(b" ") for p in batch.column(1).to_pylist()]
            if split:
                flat = [w for p in split for w in p]
                hashes = _word_hashes([x for x in langs for _ in range(length)], flat)
                columns = [np.arange(i, len(flat), length) for i in range(length)]
                yield pa.RecordBatch.from_arrays([pa.array((_hashed(hashes, columns) % np.uint64(bits)).astype(np.int64))], names=["place"])

    at = frequent.where(F.col("k") == length).select("lang", "phrase").mapInArrow(places, "place long")
    # a piece of the map holds 32,768 bits; Spark counts positions from 1
    piece = at.groupBy(F.expr("place div 32768").alias("piece")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(place % 32768 + 1))").alias("bits"))
    out = bytearray(bits // 8)
    for r in piece.collect():  # bits / 32768 rows at most, 16 MB with BITS
        out[4096 * r.piece : 4096 * r.piece + 4096] = r.bits
    return bytes(out)


def frequent_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, text_col: str = "text", lang_col: str = "lang", bits: int = BITS) -> DataFrame:
    """(lang, phrase, k, n): all phrases of up to ``longest`` words with n of at least ``least`` occurrences; k words each, and k = 0 for the number of all words. Written to the shared folder."""
    phrase = F.substring_index("key", "\n", -1)
    k = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    maps, found, shared = {}, [], None
    for length in range(2, longest + 1):
        if length > 2:
            maps[length - 1] = _map(found[-1], length - 1, bits)
            shared = docs.sparkSession.sparkContext.broadcast(maps)
        summed = _counts(docs, length, shared, text_col, lang_col).groupBy("key").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | F.col("key").endswith("\n"))
        split = summed.select(F.expr("left(key, char_length(key) - char_length(substring_index(key, '\n', -1)) - 1)").alias("lang"), phrase.alias("phrase"), "n")
        found.append(materialise(split.select("lang", "phrase", k.alias("k"), "n")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    out = materialise(out)
    release(*found)
    return out


def collocations(frequent: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score, dropped) of all phrases of two and more words, by their lowest-scoring cut.

    dropped: half of its occurrences or more stand inside a longer frequent phrase.
    """
    own = frequent.where("k >= 2").select("lang", "phrase", "k", F.col("n").alias("a"))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut")
    cuts = own.select("lang", "phrase", "k", "a", cut).withColumns({"head": F.expr("substring_index(phrase, ' ', cut)"), "tail": F.expr("substring_index(phrase, ' ', cut - k)")})
    # common words head many phrases; Spark splits what it finds skewed here
    parts = frequent.where("k >= 1")
    both = cuts.join(parts.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"]).join(parts.select("lang", F.col("phrase").alias("tail"), F.col("n").alias("r")), ["lang", "tail"])
    exact = "cast(cast({} as decimal(19, 0)) * cast({} as decimal(19, 0)) as decimal(38, 0))"
    score = F.expr(f"cast(1000000 as decimal(7, 0)) * {exact.format('a', 'a')} div {exact.format('l', 'r')}")
    best = both.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), w -> transform(sequence(1, k - w + 1), i -> array_join(slice(split(phrase, ' '), i, w), ' '))))")
    longer = own.where("k > 2").select("lang", F.explode(inner).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    out = best.join(longer, ["lang", "phrase"], "left")
    return out.select("lang", "phrase", "k", "a", "best.l", "best.r", "best.score", F.coalesce(100 * F.col("most") >= 50 * F.col("a"), F.lit(False)).alias("dropped"))


def top_phrases(found: DataFrame, top: int = TOP) -> DataFrame:
    """The best phrases of each language, ranked from 1."""
    order = [F.desc("score"), F.desc("a"), "phrase"]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PARTS))
    few = found.where(~F.col("dropped")).withColumn("place", F.row_number().over(Window.partitionBy("lang", part).orderBy(*order))).where(F.col("place") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))  # over PARTS * top rows
    return few.drop("place").withColumn("rank", rank).where(F.col("rank") <= top)


def op11_phrases(spark, sf_dir: str) -> DataFrame:
    frequent = frequent_phrases(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    best = top_phrases(collocations(frequent))
    words = frequent.where("k = 0").select("lang", "n")
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
with pieces as (
  select lang, row_number() over () as piece, regexp_extract_all(p, '[^\x20\x09]+') as w from (
    select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as p from documents)
), words as (
  select lang, piece, unnest(w) as w, generate_subscripts(w, 1) as i from pieces
), runs as (
  select lang, w, lead(w) over s as w2, lead(w, 2) over s as w3 from words window s as (partition by piece order by i)
), f as (
  select lang, w as phrase, 1 as k, count(*) as f from runs group by all
  union all select lang, w || ' ' || w2, 2, count(*) from runs where w2 is not null group by lang, w, w2
  union all select lang, w || ' ' || w2 || ' ' || w3, 3, count(*) from runs where w3 is not null group by lang, w, w2, w3
), candidates as (
  select lang, phrase, k, f as a from f where k >= 2 and f >= 10
), cuts as (
  select lang, phrase, k, a, c.cut, array_to_string(string_split(phrase, ' ')[1 : c.cut], ' ') as head, array_to_string(string_split(phrase, ' ')[c.cut + 1 :], ' ') as tail
  from candidates, range(1, 3) c(cut) where c.cut < k
), scored as (
  select c.*, x.f as l, y.f as r, ((1000000::hugeint * a * a) // (x.f::hugeint * y.f))::bigint as score
  from cuts c join f x on x.lang = c.lang and x.phrase = c.head join f y on y.lang = c.lang and y.phrase = c.tail
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, cut) = 1
), longer as (
  select lang, array_to_string(string_split(phrase, ' ')[i : i + 1], ' ') as phrase, max(a) as most from candidates, range(1, 3) t(i) where k = 3 group by all
), n as (
  select lang, count(*) as n from words group by lang
)
select b.lang, row_number() over (partition by b.lang order by score desc, a desc, b.phrase) as rank, b.phrase, a, l, r, n.n, score
from best b join n on n.lang = b.lang left join longer g on g.lang = b.lang and g.phrase = b.phrase
where most is null or 100 * most < 50 * a
qualify rank <= 2000
"""
