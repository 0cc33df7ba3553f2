"""Removal of repeated byte strings by multi-document suffix sorting.

Every byte covered by a string of LENGTH bytes that also starts earlier is removed.

1. Each window of LENGTH bytes is named by the least hash of its 32-byte grams, so equal
   windows have equal names wherever they stand. Runs of windows with one name are cut out
   as short strings. Names are counted over all texts; a bit map of fixed size with the names that occur
   twice or more drops the rest (false positives cost time only).
2. A map task keeps one copy of equal strings; all other copies are repeats for certain.
3. Strings are dealt by name and arrive in its order. Names left with two different strings or more (or one
   whose named gram stands there twice) are sorted column-wise: each round inserts one symbol of each
   string and updates the collection's Burrows-Wheeler transform and common prefixes.
   Columns that outgrow memory stand in sequential scratch files of the task, which go
   with it. Neighbours with a common prefix of LENGTH or more are equal windows.
4. The removed stretches are gathered by document.

Names that stand for very many strings are split: their strings are dealt window by
window, by the window's own hash, so no task gets them all.

Defined results: null text counts as empty; texts shorter than LENGTH lose nothing; rows
that repeat an id are ordered as the scan delivers them; a null id comes last; an empty
table gives an empty result; other columns are carried or dropped, never read. Ids are integers.
The input must be a table (a deterministic scan), as it is scanned more than once.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, release

LENGTH, GRAM = 100, 32
#: Bytes hashed at once; positions take POS_BITS of a packed value.
BLOCK, POS_BITS = 1 << 21, 22
FILTER_BITS = 27
#: A name with at least so many strings (and a 2000th of all) is split into single windows.
MANY = 20_000
#: Strings sorted together, and entries of a collection above which its columns stand in files.
COLLECTION, IN_MEMORY = 1024, 1 << 22
LOCAL_STRINGS = 100_000
NO_ID = (1 << 63) - 1


def _blocks(texts, length: int):
    """(row, offset, bytes) parts of at most BLOCK bytes together; parts of one text overlap by length - 1."""
    held, size = [], 0
    for row, text in enumerate(texts):
        data, at = text if isinstance(text, bytes) else (text.as_py() or "").encode("utf-8", "surrogatepass"), 0
        while len(data) - at >= length:
            part = data[at : at + BLOCK]
            if size + len(part) > BLOCK and held:
                yield held
                held, size = [], 0
            held.append((row, at, part))
            size += len(part)
            at += BLOCK - length + 1
    if held:
        yield held


def runs(parts, length: int):
    """Runs of windows with one name in the parts of a block: arrays part, start, windows, name, twice (the named gram stands there more than once)."""
    import numpy as np

    data = np.frombuffer(b"".join(p for _, _, p in parts) + b"\0" * GRAM, np.uint8)
    sizes = np.array([len(p) for _, _, p in parts])
    ends = np.cumsum(sizes)
    n = int(ends[-1])
    words = np.ndarray((n + GRAM - 7,), "<u8", data, strides=(1,)).copy()
    grams = np.zeros(n, np.uint64)
    for j in range(0, GRAM, 8):
        grams = (grams ^ words[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
        grams ^= grams >> np.uint64(31)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    low = (grams >> np.uint64(POS_BITS) << np.uint64(POS_BITS)) | np.arange(n, dtype=np.uint64)
    # least over the grams of each window, by doubling
    reach, width = length - GRAM + 1, 1
    while 2 * width <= reach:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    low = np.minimum(low[: len(low) - (reach - width)], low[reach - width :])
    part = np.repeat(np.arange(len(parts)), np.maximum(sizes - length + 1, 0))
    first = ends - sizes
    starts = np.arange(len(part)) - np.repeat(np.cumsum(np.maximum(sizes - length + 1, 0)) - np.maximum(sizes - length + 1, 0), np.maximum(sizes - length + 1, 0))
    at = first[part] + starts
    name = low[at] >> np.uint64(POS_BITS)
    gram = low[at] & np.uint64((1 << POS_BITS) - 1)
    new = np.ones(len(at), bool)
    new[1:] = (name[1:] != name[:-1]) | (part[1:] != part[:-1])
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(at)))
    moved = np.zeros(len(at), bool)
    moved[1:] = (gram[1:] != gram[:-1]) & ~new[1:]
    twice = np.logical_or.reduceat(moved, begin) if len(begin) else np.zeros(0, bool)
    if len(size) and size.max() > reach:  # periodic text: cut long runs
        cuts = -(-size // reach)
        rank = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        total = np.repeat(size, cuts)
        begin, twice = np.repeat(begin, cuts) + rank * reach, np.repeat(twice, cuts)
        size = np.minimum(total - rank * reach, reach)
    return part[begin], starts[begin], size, name[begin].astype(np.int64), twice


def _column(n: int):
    """The column of a collection: in memory, or in a scratch file once the collection has outgrown it."""
    import numpy as np

    if n <= IN_MEMORY:
        return np.empty(n, "<u8")
    with tempfile.TemporaryFile() as f:
        f.truncate(8 * n)
        return np.memmap(f, "<u8", "r+", shape=(n,))


def sort_collection(strings: list[bytes], cap: int):
    """All suffixes of the strings in order: arrays string, suffix length, common prefix with the suffix before (at most cap).

    Each round inserts the suffixes that are one symbol longer. A suffix's place is the
    rank of its symbol in the transform so far; its common prefix is one more than the
    least common prefix between it and the last same symbol above. An entry packs the symbol before
    the suffix (the transform), the common prefix, the suffix's length and its string, from the lowest byte up.
    """
    import numpy as np

    u8 = np.uint64
    count = len(strings)
    sizes = np.array([len(s) for s in strings], np.int64)
    flat = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint8) + np.uint8(1)  # 0 ends a string; UTF-8 has no byte 255
    last = np.cumsum(sizes)
    before = np.where(sizes > 0, flat[np.maximum(last - 1, 0)], 0).astype(u8) if len(flat) else np.zeros(count, u8)
    entries = np.arange(count, dtype=u8) << u8(24) | before
    # the transform's symbols with their places, in the order of the suffixes they lead to
    low = (1 << 32) - 1
    leads = before.astype(np.int64) << 32 | np.arange(count)
    leads = np.sort(leads[before > 0])
    rank = np.arange(len(leads))
    for step in range(1, int(sizes.max(initial=0)) + 1):
        n = len(entries)
        lcp = np.empty(n + 1, np.uint8)
        lcp[:n], lcp[n] = entries.view(np.uint8)[1::8], 0

        def least(lo, hi, lcp=lcp):
            """One more than the minima of the common prefixes at lo .. hi - 1, at most cap."""
            by = np.argsort(lo, kind="stable")
            pairs = np.empty(2 * len(lo), np.int64)
            pairs[0::2], pairs[1::2] = lo[by], hi[by]
            out = np.empty(len(lo), np.uint8)
            if len(lo):
                out[by] = np.minimum.reduceat(lcp, pairs)[0::2]
            return np.minimum(out, cap - 1) + np.uint8(1)

        lead = leads[rank]
        source, symbol = lead & low, lead >> 32
        above, below = leads[np.maximum(rank - 1, 0)], leads[np.minimum(rank + 1, len(leads) - 1)]
        has_above, has_below = (rank > 0) & (above >> 32 == symbol), (rank + 1 < len(leads)) & (below >> 32 == symbol)
        mine, next_ = np.zeros(len(rank), np.uint8), np.zeros(len(rank), np.uint8)
        mine[has_above] = least((above[has_above] & low) + 1, source[has_above] + 1)
        next_[has_below] = least(source[has_below] + 1, (below[has_below] & low) + 1)
        place = count + rank
        who = (entries[source] >> u8(24)).astype(np.int64)
        symbols = np.where(sizes[who] > step, flat[np.maximum(last[who] - step - 1, 0)], 0).astype(np.int64)
        grown = _column(n + len(rank))
        old = np.ones(n + len(rank), bool)
        old[place] = False
        moved = np.flatnonzero(old)
        grown[moved] = entries
        grown[place] = who.astype(u8) << u8(24) | u8(step) << u8(16) | mine.astype(u8) << u8(8) | symbols.astype(u8)
        after = place + 1
        inside = after < len(grown)
        after, next_ = after[inside], next_[inside]
        held = old[after]
        after = after[held]
        grown[after] = grown[after] & ~u8(0xFF00) | next_[held].astype(u8) << u8(8)
        entries = grown
        more = np.sort((symbols << 32 | place)[symbols > 0])
        leads = leads & ~low | moved.astype(np.int32)[leads & low]
        at = np.searchsorted(leads, more)
        leads = np.insert(leads, at, more)
        rank = at + np.arange(len(more))
    entries = np.asarray(entries)
    return (entries >> u8(24)).astype(np.int64), (entries >> u8(16) & u8(255)).astype(np.int64), (entries >> u8(8) & u8(255)).astype(np.int64)


def repeats(strings, ids, rids, starts, length: int):
    """(string, from, to) stretches of windows that also start earlier, among strings each standing at its first place."""
    import numpy as np

    owner, depth, lcp = sort_collection(strings, length)
    keep = np.flatnonzero(depth >= length)
    group = np.cumsum(lcp < length)[keep]
    owner = owner[keep]
    offset = np.array([len(s) for s in strings])[owner] - depth[keep]
    _, group, n = np.unique(group, return_inverse=True, return_counts=True)
    many = n[group] > 1
    owner, offset, group = owner[many], offset[many], group[many]
    by = np.lexsort((starts[owner] + offset, rids[owner], ids[owner], group))
    later = np.zeros(len(by), bool)
    later[1:] = group[by][1:] == group[by][:-1]
    owner, offset = owner[by][later], offset[by][later]
    by = np.lexsort((offset, owner))
    owner, offset = owner[by], offset[by]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length)
    first = np.flatnonzero(new)
    stop = np.append(first[1:], len(owner)) - 1 if len(first) else first
    return owner[first], offset[first], offset[stop] + length


#: Strings hold in stop whether their named gram stands there twice (1); stretches found have no piece.
ROWS = "key long, piece binary, id long, rid long, start long, stop long"


def _rows(out):
    import pyarrow as pa

    cols = list(zip(*out)) if out else [()] * 6
    kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[x.split()[0] for x in ROWS.split(", ")])


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("rid"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """(rid, start, stop) byte stretches to remove; they may overlap. rid is the row's monotonically_increasing_id()."""
    if not GRAM <= length <= 200:
        raise ValueError(f"length must be {GRAM} to 200")
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text_col)

    def names(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for parts in _blocks(batch.column(0), length):
                _, _, _, name, twice = runs(parts, length)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(np.where(twice, 2, 1).astype("int64"))], names=["name", "n"])

    counted = materialise(rows.select("text").mapInArrow(names, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).where("n > 1"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    split = {r[0] for r in counted.where(F.col("n") >= max(MANY, total / 2000)).select("name").collect()}  # 2,000 at most
    shared = spark.sparkContext.broadcast((name_map(counted), split))
    release(counted)

    def pieces(batches):
        import numpy as np
        from xxhash import xxh3_64_intdigest

        held, split = np.frombuffer(shared.value[0], np.uint8), shared.value[1]
        seen: dict[bytes, tuple] = {}
        out = []

        def full(id_, rid, start, stop):
            if out and out[-1][1] is None and out[-1][3] == rid and out[-1][4] <= start <= out[-1][5]:
                out[-1] = (*out[-1][:5], max(stop, out[-1][5]))
            else:
                out.append((rid, None, id_, rid, start, stop))

        def add(key, piece, place, twice):
            known = seen.get(piece)
            if known is None:
                seen[piece] = (key, place, twice)
            else:
                first, later = (place, known[1]) if place < known[1] else (known[1], place)
                seen[piece] = (key, first, twice or known[2])
                full(*later, later[2] + len(piece))

        def drained():
            out.extend((key, piece, *place, twice) for piece, (key, place, twice) in seen.items())
            seen.clear()

        for batch in batches:
            rids, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for parts in _blocks(batch.column(2), length):
                part, start, size, name, twice = runs(parts, length)
                place = _bit_place(name)
                hit = np.flatnonzero((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
                for p, s, w, key, t in zip(part[hit].tolist(), start[hit].tolist(), size[hit].tolist(), name[hit].tolist(), twice[hit].astype(np.int64).tolist()):
                    row, offset, data = parts[p]
                    id_, rid = int(ids[row]), int(rids[row])
                    if key in split:
                        for k in range(s, s + w):
                            window = data[k : k + length]
                            add(xxh3_64_intdigest(window) >> 1, window, (id_, rid, offset + k), 0)
                    else:
                        add(key, data[s : s + w + length - 1], (id_, rid, offset + s), t)
                if len(seen) > LOCAL_STRINGS:
                    drained()
                if len(out) > 20_000:
                    yield _rows(out)
                    out.clear()
        drained()
        for i in range(0, len(out), 20_000):
            yield _rows(out[i : i + 20_000])

    def sorted_pieces(batches):
        """Rows come in the order of their keys, so a task holds one collection at a time."""
        import numpy as np

        out, held = [], []  # held: strings of finished names that need sorting
        seen: dict[bytes, tuple] = {}  # the strings of the name at hand

        def finished():
            # a name's only string has no two equal windows, unless its gram stands there twice
            if len(seen) > 1 or any(twice for _, twice in seen.values()):
                held.extend((place, piece) for piece, (place, _) in seen.items())
            seen.clear()

        def sort():
            places = np.array([x[0] for x in held], np.int64)
            for k, a, b in zip(*(v.tolist() for v in repeats([x[1] for x in held], places[:, 0], places[:, 1], places[:, 2], length))):
                id_, rid, start = held[k][0]
                out.append((None, None, id_, rid, start + a, start + b))
            held.clear()

        last = None
        for batch in batches:
            for key, piece, *place, stop in zip(*[c.to_pylist() for c in batch.columns]):
                if piece is None:
                    out.append((None, None, *place, stop))
                    continue
                if key != last:
                    finished()
                    last = key
                    if len(held) >= COLLECTION:
                        sort()
                place = tuple(place)
                known = seen.get(piece)
                if known is None:
                    seen[piece] = (place, stop)
                else:
                    first, later = (place, known[0]) if place < known[0] else (known[0], place)
                    seen[piece] = (first, stop or known[1])
                    out.append((None, None, *later, later[2] + len(piece)))
            if len(out) > 20_000:
                yield _rows(out)
                out.clear()
        finished()
        if held:
            sort()
        yield _rows(out)

    cut = rows.select("rid", "id", "text").mapInArrow(pieces, ROWS)
    return cut.repartition("key").sortWithinPartitions("key").mapInArrow(sorted_pieces, ROWS).select("rid", "start", "stop")


def name_map(names: DataFrame) -> bytes:
    """A map of 2^FILTER_BITS bits (16 MB, whatever the input's size) in which the bit of each name is set."""
    # Spark's buckets count from 1 and hold the values from 1 on; its bucket of the value 0 is no bucket of the map
    value = f"pmod(name, {1 << FILTER_BITS}L) + 1"
    maps = names.groupBy(F.expr(f"bitmap_bucket_number({value})").alias("b")).agg(F.expr(f"bitmap_construct_agg(bitmap_bit_position({value}))").alias("bits"))
    size = 1 << FILTER_BITS >> 3
    bits = bytearray(size)
    for r in maps.toLocalIterator():
        bits[(r.b - 1) * 4096 : r.b * 4096] = r.bits
        if len(bits) != size:
            raise AssertionError(f"bucket {r.b} does not fit the map of names")
    return bytes(bits)


def _bit_place(name):
    """The place of each name's bit in name_map."""
    import numpy as np

    return (name.astype(np.uint64) & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def with_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """Each input row as struct row, with spans: the array of its (start, stop), unsorted and overlapping; null if none."""
    spans = removed_spans(docs, id_col, text_col, length).groupBy("rid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    whole = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return whole.join(spans, "rid", "left").select("row", "spans")


def merged(spans) -> list[tuple[int, int]]:
    """Sorted disjoint stretches that do not touch."""
    out: list[tuple[int, int]] = []
    for s in sorted((x["start"], x["stop"]) for x in spans or ()):
        if out and s[0] <= out[-1][1]:
            out[-1] = (out[-1][0], max(s[1], out[-1][1]))
        else:
            out.append(s)
    return out


def kept_bytes(data: bytes, spans: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in spans:
        out.append(data[at:a])
        at = b
    return b"".join([*out, data[at:]])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """The input's rows and columns, texts without repeats; a character that a cut breaks goes as a whole.

    A column n_chars of an integer type is set to the new text's number of characters.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            new = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                text = text.as_py()
                new.append(kept_bytes(text.encode("utf-8", "surrogatepass"), merged(spans)).decode("utf-8", "ignore") if spans else text)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(new, pa.string())], names=["row", "text"])

    held = with_spans(docs, id_col, text_col, length)
    kind = held.schema["row"].dataType
    out = held.select("row", F.col("row")[text_col].cast("string").alias("text"), "spans")
    from pyspark.sql import types as T

    out = out.mapInArrow(run, T.StructType([T.StructField("row", kind), T.StructField("text", T.StringType())]))
    cols = []
    for c in docs.columns:
        value = F.col("row")[c]
        if c == text_col:
            value = F.col("text")
        elif c == "n_chars" and dict(docs.dtypes)[c] in ("int", "bigint"):
            value = F.coalesce(F.char_length("text"), F.lit(0)).cast(dict(docs.dtypes)[c])
        cols.append(value.alias(c))
    return out.select(*cols)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")

    def digest(batches):
        from hashlib import sha256

        import pyarrow as pa

        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1), batch.column(2).to_pylist()):
                data, spans = (text.as_py() or "").encode("utf-8", "surrogatepass"), merged(spans)
                rows.append((len(data), sum(b - a for a, b in spans), len(spans), sha256(kept_bytes(data, spans)).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string())))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    held = with_spans(docs).select(F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "spans")
    return held.mapInArrow(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
