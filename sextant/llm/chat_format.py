"""Chat formatting by schema fingerprints (DataFrame functions only).

A record's nested field paths are hashed; the hash selects a declarative mapping that
turns the record's layout into canonical turns, an array of (role, text). The template
then marks each turn and escapes control strings inside roles and texts reversibly.

Defined results: null roles and texts count as empty; a null turn number sorts first, and
equal numbers are ordered by role, then text; repeated rows are repeated turns; a null
conversation id is one conversation; a record whose fingerprint is unknown gets no turns
(null) and layout null; empty tables give empty results; columns and keys that no mapping
names are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURN, END = "<|im_start|>", "<|im_end|>"
#: Strings that steer common chat models; none may stand unbroken inside a text.
CONTROL = "<\\|im_start\\|>|<\\|im_end\\|>|</?s>|\\[/?INST\\]"
TURNS = "array<struct<role:string,text:string>>"
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


@dataclass(frozen=True)
class Layout:
    """turns: (role, path) for flat layouts; items, role, text for a list of messages; rows for a table with a row per turn."""

    name: str
    turns: tuple[tuple[str, str], ...] = ()
    items: str = ""
    role: str = ""
    text: str = ""
    rows: tuple[str, str, str] | None = None
    joined: tuple[str, ...] = field(default=())

    def paths(self) -> list[str]:
        if self.rows:
            return sorted(self.rows)
        if self.items:
            return sorted([f"{self.items}[].{self.role}", f"{self.items}[].{self.text}"])
        return sorted({p for _, p in self.turns} | set(self.joined))


def _flat(name: str, ask: str, reply: str, *joined: str) -> list[Layout]:
    body = (("user", ask), ("assistant", reply))
    return [Layout(name, body, joined=joined), Layout(f"{name}+system", (("system", "system"), *body), joined=joined)]


LAYOUTS = [
    Layout("turn_rows", rows=("turn", "role", "text")),
    Layout("messages", items="messages", role="role", text="content"),
    Layout("conversations", items="conversations", role="from", text="value"),
    Layout("turns", items="turns", role="role", text="text"),
    *_flat("prompt_response", "prompt", "response"),
    *_flat("prompt_completion", "prompt", "completion"),
    *_flat("question_answer", "question", "answer"),
    *_flat("instruction_output", "instruction", "output"),
    *_flat("instruction_input_output", "instruction", "output", "input"),
]
KNOWN = sorted({p for x in LAYOUTS for p in x.paths()})
LISTS = sorted({x.items for x in LAYOUTS if x.items})


def fingerprint(paths: list[str]) -> str:
    return sha256("\n".join(sorted(set(paths) & set(KNOWN))).encode()).hexdigest()


BY_FINGERPRINT = {fingerprint(x.paths()): x for x in LAYOUTS}


def schema_paths(schema: T.StructType, above: str = "") -> list[str]:
    """All nested field paths; [] marks an array."""
    found = []
    for f in schema.fields:
        path, kind = above + f.name, f.dataType
        while isinstance(kind, T.ArrayType):
            path, kind = path + "[]", kind.elementType
        found += schema_paths(kind, path + ".") if isinstance(kind, T.StructType) else [path]
    return found


def _role(column: F.Column) -> F.Column:
    out = column
    for name, role in ROLE_NAMES.items():
        out = F.when(column == name, role).otherwise(out)
    return F.coalesce(out, F.lit(""))


def _turn(role: F.Column, text: F.Column) -> F.Column:
    return F.struct(role.cast("string").alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _mapped(layout: Layout, get) -> F.Column:
    """Canonical turns of a layout that has a record per conversation. get: the column at a path."""
    if layout.items:
        return F.transform(get(layout.items), lambda m: _turn(_role(m[layout.role]), m[layout.text]))
    turns = []
    for role, path in layout.turns:
        text = F.coalesce(get(path).cast("string"), F.lit(""))
        if role == "user":
            for more in layout.joined:
                extra = F.coalesce(get(more).cast("string"), F.lit(""))
                text = F.when(extra == "", text).otherwise(F.concat(text, F.lit("\n\n"), extra))
        turns.append(_turn(F.lit(role), text))
    return F.array(*turns)


def canonical_turns(df: DataFrame, key: str) -> DataFrame:
    """(key, layout, turns) of a table whose columns hold the layout, found by its schema's fingerprint."""
    layout = BY_FINGERPRINT.get(fingerprint(schema_paths(T.StructType([f for f in df.schema.fields if f.name != key]))))
    if layout is None:
        return df.select(key, F.lit(None).cast("string").alias("layout"), F.lit(None).cast(TURNS).alias("turns"))
    if layout.rows:
        at, role, text = layout.rows
        row = F.struct(F.col(at).alias("at"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
        held = df.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("held"))
        turns = F.transform("held", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
        return held.select(key, F.lit(layout.name).alias("layout"), turns.alias("turns"))
    return df.select(key, F.lit(layout.name).alias("layout"), _mapped(layout, F.col).alias("turns"))


def json_turns(df: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, layout, turns) of records held as JSON strings, each row by its own fingerprint."""
    body = F.col(payload)
    known = F.array(*[F.lit(x) for x in KNOWN])
    paths = F.coalesce(F.json_object_keys(body), F.array().cast("array<string>"))
    under = lambda name: lambda x: F.concat(F.lit(f"{name}[]."), x)
    for name in LISTS:
        inner = F.coalesce(F.json_object_keys(F.get_json_object(body, f"$.{name}[0]")), F.array().cast("array<string>"))
        paths = F.concat(paths, F.transform(inner, under(name)))
    mark = F.sha2(F.array_join(F.array_sort(F.array_intersect(paths, known)), "\n"), 256)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for hashed, x in BY_FINGERPRINT.items():
        if x.rows:
            continue
        if x.items:
            kind = f"array<struct<`{x.role}`:string,`{x.text}`:string>>"
            found = _mapped(x, lambda p, k=kind: F.from_json(F.get_json_object(body, f"$.{p}"), k))
        else:
            found = _mapped(x, lambda p: F.get_json_object(body, f"$.{p}"))
        layout = F.when(F.col("mark") == hashed, x.name).otherwise(layout)
        turns = F.when(F.col("mark") == hashed, found).otherwise(turns)
    return df.withColumn("mark", mark).select(key, layout.alias("layout"), turns.alias("turns"))


def escape(text: F.Column) -> F.Column:
    """Double each backslash and break each control string by one after its first character."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?=(?:{CONTROL}))([<\\[])", "$1\\\\")


def unescape(text: F.Column) -> F.Column:
    return F.regexp_replace(text, "(?s)\\\\(.)", "$1")


def apply_template(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Adds segments, an array of (text, loss), formatted, their concatenation, and mask, whether a turn's text in formatted counts for the loss.

    The loss mask covers exactly the texts of loss_role.
    """
    def segments(x):
        head = F.concat(F.lit(TURN), F.replace(escape(x["role"]), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
        seg = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        return F.array(seg(head, F.lit(False)), seg(escape(x["text"]), x["role"] == loss_role), seg(F.lit(END + "\n"), F.lit(False)))

    out = turns.withColumn("segments", F.flatten(F.transform("turns", segments)))
    out = out.withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))
    return out.withColumn("mask", F.transform("turns", lambda x: x["role"] == loss_role))


def parse_template(formatted: F.Column) -> F.Column:
    """The turns of a formatted conversation."""
    pieces = F.split(formatted, "<\\|im_end\\|>\n", -1)
    pieces = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))

    def turn(piece):
        role = F.regexp_extract(piece, "(?s)^<\\|im_start\\|>((?:[^\\\\\n]++|\\\\.)*+)\n", 1)
        text = F.substring(piece, F.char_length(role) + len(TURN) + 2, F.char_length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    out = apply_template(canonical_turns(rows.union(own), "conv_id"))
    back = out.select("conv_id", "formatted", "mask", parse_template(F.col("formatted")).alias("read"))
    under = F.filter(F.arrays_zip("read", "mask"), lambda x: x["mask"])
    back = back.withColumn("masked", F.array_join(F.transform(under, lambda x: x["read"]["text"]), ""))
    digest = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("read").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e as (
  select *,
    length(regexp_replace(replace(text, '\', '\\'), '(<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\])', 'x\1', 'g')) as text_len,
    length(replace(regexp_replace(replace(role, '\', '\\'), '(<\|im_start\|>|<\|im_end\|>|</?s>|\[/?INST\])', 'x\1', 'g'), chr(10), 'xx')) as role_len
  from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(12 + role_len + 1 + text_len + 11)::bigint as formatted_chars
from e group by conv_id
"""
