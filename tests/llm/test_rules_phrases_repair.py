"""Quality rules, phrases and conversation repair against brute force, on small tables with nulls, empty and very long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sextant.llm import conversation_repair as repair
from sextant.llm import phrases, quality_rules, registry

SPACES = "\x20\x09-\x0d"


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Write rows as a table with columns that clash with those the operators make."""
    def make(rows, schema, clash):
        df = spark.createDataFrame(rows, schema)
        for c in clash:
            df = df.withColumn(c, F.lit("clash"))
        path = str(tmp_path_factory.mktemp("t") / "x")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


def documents(table, rows):
    return table(rows, "doc_id long, text string, lang string, source string", ["id", "n_words", "kept", "group", "n", "key", "phrase", "k", "rate", "cell"])


# quality rules


def counted(text):
    text = text or ""
    words = re.findall(f"[^{SPACES}]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    again = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(f"[^{SPACES}]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(lines), len(re.findall("[A-Z]", text))


def test_signals_of_odd_and_random_texts():
    r = random.Random(1)
    odd = [None, "", " \n ", "a", "a b c d e a b c d e", "  x y #*$%&|<>", "日本 語 😀😀", "x\n\nx\nx \n y\tz\x0bq\x0c\r", "A" * 3_000_000, "w " * 400_000, "a b c d e f\na b c d e f\n" * 3]
    texts = odd + [" ".join(r.choice("abc") for _ in range(r.randrange(60))) + r.choice(["", "\n", "\nab\nab"]) for _ in range(300)]
    got = list(zip(*quality_rules.signals([t or "" for t in texts])))
    assert got == [counted(t) for t in texts]
    for some in (texts[5:6], texts[:3]):  # windows never reach into the next text
        assert list(zip(*quality_rules.signals([t or "" for t in some]))) == [counted(t) for t in some]


def test_cells_keep_order_and_lie_close_below(spark):
    values = [*range(200), 1000, 4095, 4096, 10**6, 10**12, 2**62]
    rows = spark.createDataFrame([(v,) for v in values], "v long").withColumn("c", quality_rules.cell(F.col("v"))).withColumn("low", quality_rules.lowest(F.col("c"))).orderBy("v").collect()
    assert [r.c for r in rows] == sorted(r.c for r in rows)
    assert all(r.low <= r.v <= r.low + r.low / 32 for r in rows) and all(r.low == r.v for r in rows if r.v < 64)


def test_rules(table):
    r = random.Random(2)
    plain = lambda n=80: "\n".join(" ".join("".join(r.choice("aeioubcd") for _ in range(r.randrange(2, 9))) for _ in range(10)) for _ in range(n // 10))
    rows = [(i, plain(), "en", f"s{i % 3}") for i in range(600)]
    # a source of tables: its many bars are its own custom, and no other source's
    rows += [(1000 + i, re.sub(" ", " | ", plain()), "en", "tables") for i in range(300)]
    junk = [(2000, re.sub(" ", " | ", plain(300)), "en", "s1"), (2001, plain(300).upper(), "en", "s1"), (2002, "\n".join(["same line of text here"] + [plain(10) for _ in range(30)] + [f"same line of text {i // 8}" for i in range(60)]), "en", "s2")]
    odd = [(3000, None, "en", "s0"), (3001, "", None, None), (3002, plain(), None, None), (3003, "one two", "en", "s0"), (None, plain(), "xx", "s0"), (1, plain(), "en", "s1"), (3005, plain() + " e" * 2_000_000, "en", "s0")]
    df = documents(table, rows + junk + odd)
    got = {x.id: x for x in quality_rules.apply_rules(df).collect()}
    assert all(got[i].kept for i in range(600)) and all(got[1000 + i].kept for i in range(300))
    assert got[2000].strayed == ["symbols"] and "capitals" in got[2001].strayed and not any(got[x[0]].kept for x in junk)
    assert [got[i].kept for i in (3000, 3001, 3003)] == [False] * 3 and got[3002].kept and got[None].kept and not got[3005].kept
    assert quality_rules.apply_rules(df).count() == len(rows + junk + odd)
    assert quality_rules.apply_rules(documents(table, [])).count() == 0
    # beyond the broadcast bound limits arrive by a shuffled join
    bound, quality_rules.BROADCAST_GROUPS = quality_rules.BROADCAST_GROUPS, 0
    try:
        again = {x.id: x for x in quality_rules.apply_rules(df).collect()}
    finally:
        quality_rules.BROADCAST_GROUPS = bound
    assert {k: v for k, v in again.items() if k != 1} == {k: v for k, v in got.items() if k != 1}


def test_sketches_merge(table):
    df = documents(table, [(i, "w" * (i % 40 + 1) + " x" * 12, "en" if i % 2 else None, f"s{i % 4}") for i in range(400)])
    rows = quality_rules.counted(df, "doc_id", "text", "lang", "source")
    whole = quality_rules.sketches(rows).groupBy("rate", "cell").agg(F.sum("n").alias("n"))
    halves = quality_rules.sketches(rows.where("id % 3 = 0")).union(quality_rules.sketches(rows.where("id % 3 <> 0"))).groupBy("rate", "cell").agg(F.sum("n").alias("n"))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, halves.collect()))
    assert quality_rules.limits(quality_rules.sketches(rows), 100).count() == 4
    few = {(x.lang, x.source): x for x in quality_rules.limits(quality_rules.sketches(rows), 150).collect()}
    assert few[("en", "s1")].q_length == few[("en", "s3")].q_length  # too few of their own: their language's


# phrases


def brute_phrases(rows, longest=3, least=10, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang in f:
        held = {p: a for p, a in f[lang].items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in held.items():
            score, _, l, r = min((10**6 * a * a // (f[lang][p[:k]] * f[lang][p[k:]]), k, f[lang][p[:k]], f[lang][p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, b in held.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows)[:top])]
    return sorted(out)


def found_phrases(df, longest=3, least=10, top=2000, bits=phrases.BITS):
    frequent = phrases.frequent_phrases(df, longest, least, bits=bits)
    best = phrases.top_phrases(phrases.collocations(frequent), top).join(frequent.where("k = 0").select("lang", F.col("n").alias("all")), "lang")
    return sorted(map(tuple, best.select("lang", "rank", "phrase", "a", "l", "r", "all", "score").collect()))


def test_phrases(table, monkeypatch):
    r = random.Random(3)
    some = ["New", "york", "of", "the", "É", "a", "b c", "ß", "x\x1cy"]
    rows = [(i % 90, "".join(r.choice(some) + r.choice([" ", " ", " ", "\t", ", ", "\n", ".", " ;"]) for _ in range(r.randrange(70))), r.choice(["en", "de", None, "und", "two\nlines", ""]), "s") for i in range(300)]
    rows += [(1, None, "en", None), (2, "", "en", None), (3, "...", "fr", None), (None, "a a a a a a a a a a a a a a a", "en", "s"), (5, "new york times " * 40_000, "long", "s"), (5, "new york times " * 40_000, "long", "s")]
    df = documents(table, rows)
    want = brute_phrases(rows)
    assert len(want) > 100 and found_phrases(df) == want
    # shards of a document or two, ranges of few words, a map that is full of others
    monkeypatch.setattr(phrases, "SHARD", 200)
    assert found_phrases(df) == want
    small = documents(table, rows[:120])
    monkeypatch.setattr(phrases, "AT_ONCE", 3)
    for longest, least, bits in ((3, 3, 1 << 15), (4, 3, 1 << 15), (2, 2, phrases.BITS), (5, 2, phrases.BITS)):
        assert found_phrases(small, longest, least, 7, bits) == brute_phrases(rows[:120], longest, least, 7)
    assert found_phrases(documents(table, [])) == []


def test_bitmaps_across_words_of_64_positions():
    for n in (62, 63, 64, 65, 127, 128, 129):
        shard = phrases.Shard([("en", b"a " * n), ("en", b"a b"), ("de", b"a")])
        got = Counter()
        for columns, counts in phrases.phrases(shard, 3, {}):
            got.update({tuple((shard.langs[w], shard.words[w]) for w in p): c for p, c in zip(zip(*(c.tolist() for c in columns)), counts.tolist())})
        assert got == {(("en", b"a"),) * 3: n - 2}


# conversation repair


def cheapest(symbols):
    """(cost, audit) by trying all edits, over signature symbols."""
    best = {(0, 0): (0, "")}  # (rows used, state): least (cost, edits)
    # edits are tried breadth-first until nothing gets better
    queue = [(0, 0)]
    while queue:
        at = queue.pop()
        cost, edits = best[at]
        i, state = at
        then = repair.SAID[state]
        steps = [(i, then, 3, "I")]
        if i < len(symbols):
            s = symbols[i]
            steps.append((i + 1, state, 4, "D"))
            if s != "x":
                more, role = (3 if s.isupper() else 0), s.lower()
                if (role, state) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                    steps.append((i + 1, {"s": 1, "u": 2, "a": 3}[role], more, "K"))
                steps.append((i + 1, then, 3 + more, "R"))
        for j, to, c, e in steps:
            new = (cost + c, edits + e)
            if new[0] <= 4 * len(symbols) and new < best.get((j, to), (10**9, "")):
                best[(j, to)] = new
                queue.append((j, to))
    return min(best[x] for x in ((len(symbols), 0), (len(symbols), 3)) if x in best)


def test_trie_answers():
    r = random.Random(4)
    every = ["".join(x) for n in range(5) for x in itertools.product("suaoxSUAO", repeat=n)]
    some = ["".join(r.choice("suaoxUA") for _ in range(r.randrange(5, 14))) for _ in range(1500)]
    trie = repair.Trie()
    for signature in sorted(set(every[::3] + some)):
        assert trie.answer(signature) == cheapest(signature), signature
    long = "ua" * 60_000 + "xoU" + "ua" * 60_000
    assert trie.answer(long)[1].startswith("K" * 120_000)


def brute_repair(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, repaired text)} of damaged rows."""
    held = defaultdict(list)
    for conv, turn, role, text in rows:
        held[conv].append((turn is not None, turn or 0, role, text))
    out = {}
    for conv, talk in held.items():
        talk.sort()
        seen, symbols, faults = set(), "", Counter()
        for _, _, role, text in talk:
            body = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            c = role[:1] if role[:1] in ("s", "u", "a") else "o"
            symbols += "x" if fault in ("blank", "duplicate") else c.upper() if fault else c
        turns = [t for known, t, _, _ in talk if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(talk, talk[1:]))
        cost, audit = cheapest(symbols)
        lines, rest, state = [], list(talk), 0
        for e in audit:
            row = rest.pop(0) if e != "I" else None
            if e == "D":
                continue
            state = 1 if e == "K" and row[2][:1] == "s" else repair.SAID[state]
            lines.append((row[2] if e == "K" else {2: "user", 3: "assistant"}[state]) + ":" + (row[3] if row else ""))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, "\n".join(lines))
    return out


def test_repair(table, spark):
    r = random.Random(5)
    text = lambda: r.choice(["", " \n", "hi.", "yes!", "no", "what?\t", None, "é .", "two words. ", "x" * 20_000 + "."])
    rows = [(r.choice([*range(60), None]), r.choice([*range(6), 9, None]), r.choice(["user", "assistant", "system", "tool", "", None, "umpire"]), text()) for _ in range(400)]
    rows += [(77, None, "user", "a."), (77, None, "user", "a."), (78, 0, "user", "tie."), (78, 0, "assistant", "tie.")] + [(79, i, ("user", "assistant")[i % 2], f"turn {i}.") for i in range(3000)]
    df = table(rows, "conv_id long, turn long, role string, text string", ["key", "at", "new", "signature", "audit", "kind", "fault"])
    plans = repair.plan_repairs(df)
    plain = [(c, t, " " if a is None else a, " " if b is None else b) for c, t, a, b in rows]
    want = brute_repair(plain)
    got = {x.key: (x.gaps, x.blank, x.duplicate, x.truncated, x.illegal, x.cost, x.audit) for x in plans.collect()}
    assert got == {k: v[:-1] for k, v in want.items()}
    shas = dict(map(tuple, repair.digests(df, plans).collect()))
    assert shas == {k: hashlib.sha256(v[-1].encode()).hexdigest() for k, v in want.items()}
    lines = defaultdict(list)
    for x in repair.repaired(df, plans).collect():
        lines[x.key].append((x.place, f"{x.role}:{x.text}"))
    assert {k: "\n".join(t for _, t in sorted(v)) for k, v in lines.items()} == {k: v[-1] for k, v in want.items() if v[-1]}
    none = df.limit(0)
    assert repair.digests(none, repair.plan_repairs(none)).count() == 0


def test_repair_query_with_odd_rows(spark, tmp_path):
    r = random.Random(6)
    rows = [(r.choice([*range(40), None]), r.choice([0, 1, 2, 3, None]), r.choice(["user", "assistant", "system", None]), r.choice(["a.", "b", "", None, "c! d?"])) for _ in range(300)] + [(500 + i, 0, "user", "solo.") for i in range(60)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    damaged = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        role, text = "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        damaged += [(c, t, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: (0, 0, 0, 0, 0, 0, "", "") for c in {x[0] for x in rows}} | brute_repair(damaged)
    assert any(v[6] == "" for v in want.values())
    got = {x.conv_id: tuple(x)[1:] for x in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == {c: (*v[:-1], hashlib.sha256(v[-1].encode()).hexdigest()) for c, v in want.items()}


# columns of the contracts


@pytest.mark.parametrize("name, columns", [
    ("op11_phrases", "lang string, rank bigint, phrase string, a bigint, l bigint, r bigint, n bigint, score bigint"),
    ("op12_conversation_repair", "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"),
    ("op13_quality_rules", "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean"),
])
def test_contract_columns(spark, sf_dir, name, columns):
    assert [f"{c} {t}" for c, t in registry.QUERIES[name](spark, sf_dir).dtypes][: len(columns.split(", "))] == columns.split(", ")
