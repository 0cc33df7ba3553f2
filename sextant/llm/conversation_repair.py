"""Repair of conversation structure by a trie-shared dynamic programme.

Each row of a conversation is coded as one symbol, its role and fault; the symbols of a
conversation in order are its signature. Distinct signatures are range-partitioned and sorted,
so each task walks them as a prefix trie: the layers of the current path are held, a signature
shares those of its common prefix with the one before, adds a layer for each further symbol, and the
answer is read off at its end. A layer holds, for each state of the pattern ``(s?(ua)+)?``, the least
cost and a pointer back, so a path takes a few bytes a symbol. Answers are joined to conversations by signature, and
edits are applied in one ordered stream, in which a conversation's answer comes before its rows.

Edits: Keep costs 0, Rerole (to user or assistant) 3, Delete 4 and alone allowed for blank and
duplicate rows, Insert (an empty user or assistant row) 3; truncated rows that stay cost 3 more. Ties go to the
ASCII-least string of initials.

Defined results: nulls in roles and texts are one space (so such a text is blank); rows are taken by
turn, nulls first, then role, then text; a null key is one conversation; a role that is empty or has
another initial than s, u, a fits nowhere; repeated rows are duplicates; texts of any length are
streamed, and of a conversation its symbols alone are gathered (one a row, as signature and edits are single values by
definition); empty tables give empty results; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_key, materialise

SPACE = " \t\n\x0b\x0c\r"
#: States: nothing said, system has spoken, user has spoken, assistant has spoken; the first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where a user's or an assistant's row, whichever fits, leads.
SAID = (USER, USER, ASSISTANT, USER)
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
GONE = "x"
Layer = tuple  # for each state None or (cost above the layer's least, rank among the states, edits since the layer before, state there)


def _uses(symbol: str, state: int):
    """(edit, next state, cost) of the ways to use up a row."""
    yield "D", state, DELETE
    if symbol != GONE:
        cost = CUT if symbol.isupper() else 0
        role = symbol.lower()
        if role == "s" and state == START:
            yield "K", SYSTEM, cost
        if (role == "u" and SAID[state] == USER) or (role == "a" and SAID[state] == ASSISTANT):
            yield "K", SAID[state], cost
        yield "R", SAID[state], cost + REROLE


@lru_cache(1 << 16)
def _next(layer: Layer, symbol: str) -> tuple[Layer, int]:
    """The layer after one more row, and how much its least cost has risen.

    Ranks order the edits so far. All edits of a layer end with a used row and use up as
    many, so none is the beginning of another and their order holds whatever is appended.
    """
    best = {}
    for before, held in enumerate(layer):
        if held:
            state, inserts = before, ""
            while len(inserts) < 3:  # two inserts reach every state there is to reach
                for edit, to, cost in _uses(symbol, state):
                    found = (held[0] + INSERT * len(inserts) + cost, held[1], inserts + edit, before)
                    best[to] = min(found, best.get(to, found))
                state, inserts = SAID[state], inserts + "I"
    least = min(x[0] for x in best.values())
    order = sorted(best, key=lambda s: best[s][1:3])
    return tuple((best[s][0] - least, order.index(s), *best[s][2:]) if s in best else None for s in range(4)), least


def _end(layer: Layer) -> tuple[int, str, int]:
    """(cost, last inserts, state of the layer) of the best way to end here."""
    ways = []
    for before, held in enumerate(layer):
        if held:
            state, inserts = before, ""
            while len(inserts) < 3:
                if state == ASSISTANT or (state == START and not inserts):
                    ways.append((held[0] + INSERT * len(inserts), held[1], inserts, before))
                state, inserts = SAID[state], inserts + "I"
    cost, _, inserts, before = min(ways)
    return cost, inserts, before


class Trie:
    """The path of the trie that ends at the last signature; signatures come in order."""

    def __init__(self):
        self.path: list[tuple[Layer, int]] = [(((0, 0, "", START), None, None, None), 0)]
        self.last = ""

    def answer(self, signature: str) -> tuple[int, str]:
        """(cost, edits) of a signature."""
        same = next((i for i, (a, b) in enumerate(zip(self.last, signature)) if a != b), min(len(self.last), len(signature)))
        del self.path[same + 1 :]
        for symbol in signature[same:]:
            layer, base = self.path[-1]
            layer, more = _next(layer, symbol)
            self.path.append((layer, base + more))
        self.last = signature
        cost, inserts, state = _end(self.path[-1][0])
        edits = [inserts]
        for layer, _ in self.path[:0:-1]:
            _, _, edit, before = layer[state]
            edits.append(edit)
            state = before
        return self.path[-1][1] + cost, "".join(reversed(edits))


def solve(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of a table of distinct signatures."""

    def run(batches):
        import pyarrow as pa

        trie = Trie()
        for batch in batches:
            known = batch.column(0).to_pylist()
            found = [trie.answer(s) for s in known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.int64()), pa.array([a for _, a in found], pa.string())], names=["signature", "cost", "audit"])

    return signatures.select("signature").repartitionByRange("signature").sortWithinPartitions("signature").mapInArrow(run, "signature string, cost long, audit string")


def _plain(rows: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{turn}`").cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))


def faults(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, n_rows, gaps, blank, duplicate, truncated, illegal, signature) of each conversation.

    One shuffle by key serves all windows, which Spark runs row by row and spills.
    """
    order = Window.partitionBy("key").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    again = Window.partitionBy("key", "role", "text").orderBy("at")
    initial, before = F.left("role", F.lit(1)), F.lag("turn").over(order)
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    out = _plain(rows, key, turn, role, text).withColumn("at", F.row_number().over(order)).withColumn("initial", initial).withColumn("new", F.col("turn").isNotNull() & ~F.col("turn").eqNullSafe(before))
    out = out.withColumn("pair", F.concat(F.lag("initial").over(order), "initial")).withColumn("copy", F.row_number().over(again) > 1)
    fault = F.when(last == "", "blank").when(F.col("copy"), "duplicate").when(~last.isin(".", "!", "?"), "truncated").otherwise("none")
    spoken = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    out = out.select("key", "turn", "at", "new", "pair", fault.alias("fault"), spoken.alias("spoken"))
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", F.upper("spoken")).otherwise(F.col("spoken"))
    signature = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", symbol.alias("symbol")))), lambda x: x["symbol"]), "")
    counts = [F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")]
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_if("new"), F.lit(0))
    illegal = F.count_if(F.col("pair").isNotNull() & ~F.col("pair").isin("su", "ua", "au"))
    return out.groupBy("key").agg(F.count("*").alias("n_rows"), gaps.alias("gaps"), *counts, illegal.alias("illegal"), signature.alias("signature"))


def plan_repairs(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """faults with cost and audit, the initials of each conversation's edits. Written to the shared folder."""
    found = materialise(faults(rows, key, turn, role, text))
    kinds = found.groupBy("signature").agg(F.count("*").alias("weight"))
    # few signatures may stand for most conversations
    answers = materialise(solve(kinds).join(kinds, "signature"))
    return materialise(by_key(found.withColumn("spread", F.monotonically_increasing_id()), answers, "signature", "weight", "spread").drop("spread"))


def _stream(rows: DataFrame, plans: DataFrame, key: str, turn: str, role: str, text: str, each: bool) -> DataFrame:
    """Edits applied to the rows of each conversation: the repaired rows, or (key, repaired_sha256)."""
    body = _plain(rows, key, turn, role, text).select("key", F.lit(1).alias("kind"), "turn", "role", "text", F.lit("").alias("audit"))
    heads = plans.select(F.col("key"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    merged = heads.union(body).repartition("key").sortWithinPartitions("key", "kind", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        import pyarrow as pa

        kind_of_key, held, audit, at, said, place, digest = None, [], "", 0, START, 0, None

        def say(role, text):
            nonlocal place
            if each:
                held.append((now, place, role, text))
            else:
                digest.update((("\n" if place else "") + role + ":" + text).encode("utf-8", "surrogatepass"))
            place += 1

        def inserts():
            nonlocal at, said
            while audit[at : at + 1] == "I":
                said = SAID[said]
                say(NAMES[said], "")
                at += 1

        def flush():
            columns = list(zip(*held)) or [()] * len(names)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind_of_key, *types))], names=names)

        NAMES = {USER: "user", ASSISTANT: "assistant"}
        names, types = (["key", "place", "role", "text"], (pa.int64(), pa.string(), pa.string())) if each else (["key", "repaired_sha256"], (pa.string(),))
        size, now = 0, None
        for batch in batches:
            kind_of_key = batch.schema.types[0]
            for k, kind, _, role, text, plan in zip(*[c.to_pylist() for c in batch.columns]):
                if kind == 0:
                    if digest:
                        held.append((now, digest.hexdigest()))
                    now, audit, at, said, place, digest = k, plan, 0, START, 0, None if each else sha256()
                    inserts()
                    continue
                edit, at = audit[at], at + 1
                if edit == "R":
                    said = SAID[said]
                    say(NAMES[said], text)
                elif edit == "K":
                    said = SYSTEM if role[:1] == "s" else SAID[said]
                    say(role, text)
                inserts()
                size += len(text)
                if size > 1 << 22:
                    yield flush()
                    size = 0
            yield flush()
        if digest:
            held.append((now, digest.hexdigest()))
            yield flush()

    kind = merged.schema["key"].dataType.simpleString()
    return merged.mapInArrow(run, f"key {kind}, place long, role string, text string" if each else f"key {kind}, repaired_sha256 string")


def repaired(rows: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, place, role, text): the rows of every conversation after its edits, numbered from 0."""
    return _stream(rows, plans, key, turn, role, text, True)


def digests(rows: DataFrame, plans: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, repaired_sha256): of the repaired rows as role:text, joined by newlines. No conversation is held whole."""
    return _stream(rows, plans, key, turn, role, text, False)


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of conversations after the damage that the query's contract describes."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(filled("conv_id"), F.lit(":"), filled("turn")), "utf-8")) % 20
    out = rows.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    out = out.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    return out.drop("copy")


def op12_conversation_repair(spark, sf_dir: str) -> DataFrame:
    whole = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    rows = damaged(whole)
    plans = plan_repairs(rows)
    every = whole.select(F.col("conv_id").alias("of")).distinct()
    made = plans.withColumnRenamed("key", "conv_id")
    shas = digests(rows, plans).withColumnRenamed("key", "same")
    out = every.join(made, F.col("of").eqNullSafe(F.col("conv_id")), "left").join(shas, F.col("of").eqNullSafe(F.col("same")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        F.col("of").alias("conv_id"), *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256(b"").hexdigest())).alias("repaired_sha256"),
    )


def _sql() -> str:
    """The same in SQL, with whole strings of edits in the states: six digits of cost, then the edits."""
    add = lambda x, cost, edit: f"(lpad((substr({x}, 1, 6)::int + {cost})::varchar, 6, '0') || substr({x}, 7) || '{edit}')"
    said = "least(a0, a1, b3)"
    return rf"""
with recursive crc as (
  select distinct conv_id, turn, list_reduce(
    flatten([[unicode(c), -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')]),
    lambda a, x: case when x >= 0 then xor(a, x::bigint) when a % 2 = 1 then xor(a // 2, 3988292384::bigint) else a // 2 end, 4294967295::bigint) as r
  from conversations
), damage as (
  select c.conv_id, c.turn, xor(r, 4294967295::bigint) % 20 as kind, coalesce(role, ' ') as role, coalesce(text, ' ') as text
  from conversations c join crc on crc.conv_id is not distinct from c.conv_id and crc.turn is not distinct from c.turn
), turns as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from damage, range(2) t(i) where kind <> 0 and (i = 0 or kind = 3)
), seen as (
  select *, row_number() over w as pos, left(role, 1) as initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body, lag(left(role, 1)) over w as before
  from turns window w as (partition by conv_id order by turn nulls first, role, text)
), marked as (
  select *, case when body = '' then 'blank' when row_number() over (partition by conv_id, role, text order by pos) > 1 then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' else 'none' end as fault from seen
), coded as (
  select *, case when fault in ('blank', 'duplicate') then 'x' when fault = 'truncated' then upper(case when initial in ('s', 'u', 'a') then initial else 'o' end)
    when initial in ('s', 'u', 'a') then initial else 'o' end as symbol from marked
), talks as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank, count(*) filter (where fault = 'duplicate') as duplicate,
    count(*) filter (where fault = 'truncated') as truncated, count(*) filter (where before is not null and before || initial not in ('su', 'ua', 'au')) as illegal, string_agg(symbol, '' order by pos) as signature
  from coded group by conv_id
), layers(signature, i, a0, a1, a2, a3) as (
  select distinct signature, 0, '000000', null::varchar, null::varchar, null::varchar from talks
  union all
  select signature, i + 1, {add('a0', 4, 'D')},
    least({add('a1', 4, 'D')}, case when role = 's' then {add('a0', 'cut', 'K')} end),
    least({add('b2', 4, 'D')}, case when role = 'u' then {add(said, 'cut', 'K')} end, case when role <> 'x' then {add(said, '3 + cut', 'R')} end),
    least({add('b3', 4, 'D')}, case when role = 'a' then {add('b2', 'cut', 'K')} end, case when role <> 'x' then {add('b2', '3 + cut', 'R')} end)
  from (select *, least(a3, {add('b2', 3, 'I')}) as b3 from (
    select *, least(a2, {add('a0', 3, 'I')}, {add('a1', 3, 'I')}, {add('a3', 3, 'I')}) as b2, lower(substr(signature, i + 1, 1)) as role,
      case when substr(signature, i + 1, 1) in ('S', 'U', 'A', 'O') then 3 else 0 end as cut from layers where i < length(signature)))
), answers as (
  select signature, least(a0, a3, {add('a2', 3, 'I')}, {add(add('a0', 3, 'I'), 3, 'I')}, {add(add('a1', 3, 'I'), 3, 'I')}) as best from layers where i = length(signature)
), plans as (
  select talks.*, substr(best, 1, 6)::bigint as cost, substr(best, 7) as audit from talks join answers using (signature)
), edits as (
  select conv_id, p, substr(audit, p, 1) as edit, length(replace(substr(audit, 1, p), 'I', '')) as pos, length(replace(substr(audit, 1, p), 'D', '')) as place
  from (select conv_id, audit, unnest(range(1, length(audit) + 1)) as p from plans)
), said as (
  select e.conv_id, e.edit, e.place, c.role, c.text, max(case when place = 1 and edit = 'K' and initial = 's' then 1 else 0 end) over (partition by e.conv_id) as led
  from edits e left join coded c on c.conv_id is not distinct from e.conv_id and c.pos = e.pos and e.edit <> 'I' where e.edit <> 'D'
), texts as (
  select conv_id, string_agg(case when edit = 'K' then role when (place - led) % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by place) as body from said group by conv_id
)
select o.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(cost, 0) as cost, coalesce(audit, '') as audit, sha256(coalesce(body, '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join plans on plans.conv_id is not distinct from o.conv_id left join texts on texts.conv_id is not distinct from o.conv_id
"""


OP12_SQL = _sql()
