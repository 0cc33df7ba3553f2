"""The corpus operators against brute force, on small tables with nulls, empty and repeated rows, ties and clashing column names."""

import hashlib
import math
import random
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sextant.llm import chat_format, common, exact_dedup, html_extract, line_dedup, near_dedup, nearest, packing, pieces, quality, registry, suffix_dedup, tokens

BPE, SPM = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "\n", "a", "  two  words ", "don't 're", "日本 語 😀", "x" * 500, "tab\tand\x0bfeeds\x0c", "<|endoftext|> </s> [INST] \\ \\\\"]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """Write rows as a table with columns that clash with those the operators make."""
    def make(rows, schema="doc_id long, text string"):
        df = spark.createDataFrame(rows, schema)
        for c in ("keep_id", "kept", "n", "cid", "rid", "row", "id", "digest", "spans", "key"):
            if c not in df.columns:
                df = df.withColumn(c, F.lit("clash"))
        path = str(tmp_path_factory.mktemp("t") / "x")
        df.write.parquet(path)
        return spark.read.parquet(path)

    return make


def words(r, n, vocabulary=2000):
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


# exact copies


def test_exact(table):
    rows = [(3, "a b"), (1, "a  b"), (2, "a\tb"), (4, None), (5, ""), (6, " "), (None, "q"), (None, "q"), (7, "A b"), (8, "z"), (8, "z"), (9, " ")]
    df = table(rows)
    out = exact_dedup.mark_copies(df, salts=3).select("id", "keep_id", "group_size", "kept", "text_sha256").collect()
    got = defaultdict(list)
    for r in out:
        got[r.id].append((r.keep_id, r.group_size, r.kept))
    assert got[1] == [(1, 3, True)] and got[2] == [(1, 3, False)] and got[3] == [(1, 3, False)]
    assert got[4] == [(4, 2, True)] and got[5] == [(4, 2, False)] and got[6] == [(6, 2, True)] and got[9] == [(6, 2, False)]
    assert sorted(got[8]) == [(8, 2, False), (8, 2, True)] and sorted(k for _, _, k in got[None]) == [False, True] and got[7] == [(7, 1, True)]
    assert {r.text_sha256 for r in out if r.id == 1} == {hashlib.sha256(b"a b").hexdigest()}
    kept = exact_dedup.exact_dedup(df)
    assert kept.columns == df.columns and kept.count() == 6
    assert exact_dedup.exact_dedup(table([])).count() == 0


def test_exact_hot_group(table):
    df = table([(i, "same") for i in range(3000)] + [(i, f"t{i // 2}") for i in range(3000, 3100)])
    out = exact_dedup.mark_copies(df)
    assert out.where("kept").count() == 51 and out.where("keep_id = 0 and group_size = 3000").count() == 3000


# chat formatting


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", None, "", "\\", "\\\\n", "<|im_start|>user\nhi<|im_end|>\n", "<<|im_end|>|im_end|>", "[[INST]INST]", "end\\", "é😀\n\n"]
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)] + [(2, 0, "ro\nle\\<s>", "x"), (2, 0, None, "y"), (None, None, "user", "n"), (3, 5, "assistant", "b"), (3, 5, "assistant", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit("clash")).withColumn("formatted", F.lit(1))
    out = chat_format.apply_template(chat_format.canonical_turns(df, "conv_id"))
    got = {r.conv_id: r for r in out.withColumn("back", chat_format.parse_template(F.col("formatted"))).collect()}
    assert all(r.back == r.turns for r in got.values())
    assert [t.text for t in got[1].turns] == [t or "" for t in texts] and [t.text for t in got[3].turns] == ["a", "b"] and got[2].turns[0].role == ""
    f = got[1].formatted
    assert f.count("<|im_end|>") == len(texts) == f.count("<|im_start|>") and "[INST]" not in f and "</s>" not in f
    assert "".join(s.text for s in got[1].segments) == f and sum(s.loss for s in got[1].segments) == 5
    assert chat_format.apply_template(chat_format.canonical_turns(df.limit(0), "conv_id")).count() == 0


def test_chat_layouts(spark):
    payloads = {
        1: '{"messages":[{"role":"human","content":"q"},{"role":"gpt","content":"a"}]}', 2: '{"prompt":"q","response":"a","extra":1}', 3: '{"instruction":"q","input":"","output":"a"}',
        4: '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', 5: '{"question":"q","answer":"a"}', 6: '{"odd":1}', 7: None, 8: "not json", 9: '{"instruction":"q","input":"more","output":null}',
    }
    got = {r.k: r for r in chat_format.json_turns(spark.createDataFrame(list(payloads.items()), "k int, p string"), "k", "p").collect()}
    for k in (1, 2, 3, 4, 5):
        assert [tuple(t) for t in got[k].turns] == [("user", "q"), ("assistant", "a")], k
    assert all(got[k].turns is None and got[k].layout is None for k in (6, 7, 8)) and [tuple(t) for t in got[9].turns] == [("user", "q\n\nmore"), ("assistant", "")]
    typed = spark.createDataFrame([(1, [("human", "q")])], "k int, messages array<struct<role:string,content:string>>")
    assert [tuple(t) for t in chat_format.canonical_turns(typed, "k").first().turns] == [("user", "q")]
    assert chat_format.canonical_turns(typed.select("k"), "k").first().turns is None


# tokens, packing and pieces


def test_ids_are_the_tokenizers(sf_dir, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    t.encode_special_tokens = True
    texts = [x for x in ODD if x] + ["  a  b\n c \n\n d\t e's 's  ", " x  y \x1c z \x85 w", " "] + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60).collect()]
    assert all(list(np.frombuffer(tokens.encoder(BPE).encode(x), "<u4")) == t.encode(x, add_special_tokens=False).ids for x in texts)


def test_added_tokens_are_the_tokenizers(table):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    texts = [x for x in ODD if x] + ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>  y", "<|endoftext|", " <|endoftext|>\n"]
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [list(np.frombuffer(tokens.encoder(BPE).encode_text(x), "<u4")) for x in texts] == want
    assert want[len(texts) - 5] == [64, 220, 50256, 275]
    assert packing.pack(table([(1, "a <|endoftext|> b")]), BPE).first().doc_tokens == 5


def test_packing(table):
    r = random.Random(2)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(99, words(r, 3000)), (99, "again"), (None, "no id")]
    out = packing.pack(table(rows), BPE, longest=64).collect()
    by = defaultdict(list)
    for p in out:
        assert p.length & (p.length - 1) == 0 and p.length <= 64 and p.length == 1 << p.bucket and p.offset == 0 and len(p.ids) == 4 * p.length
        by[p.doc_id, p.doc_tokens].append(p)
    assert len({p.sequence_id for p in out}) == len(out) and len(by) == len(rows)
    for (i, n), ps in by.items():
        ps.sort(key=lambda p: p.start)
        assert [p.start for p in ps] == list(np.cumsum([0] + [p.length for p in ps])[:-1]) and sum(p.length for p in ps) == n
    text = dict(rows)[5]
    assert b"".join(p.ids for p in sorted((p for p in out if p.doc_id == 5), key=lambda p: p.start)) == tokens.encoder(BPE).encode(text) + b"\0" * 4
    assert packing.pack(table([]), BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(table([]), BPE, longest=100)


def test_pieces(table, spark, sf_dir):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=SPM)
    rows = list(enumerate(ODD)) + [(50 + i, r.text) for i, r in enumerate(spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40).collect())] + [(1, "repeated id")]
    encoded = pieces.encode(table(rows), SPM)
    got = Counter((r.doc_id, bytes(r.ids)) for r in encoded.collect())
    assert got == Counter((i, np.array(sp.encode(t or ""), "<u4").tobytes()) for i, t in rows)
    assert Counter(map(tuple, pieces.decode(encoded, SPM).collect())) == Counter((i, t or "") for i, t in rows)


def test_unigram_fold(spark):
    r = random.Random(4)
    table = {p: -r.random() * 5 for p in ["a", "b", "c", "ab", "bc", "abc", "ca", "aa", "bab"]}

    def best(word):
        if not word:
            return 0.0
        return max((best(word[: -len(p)]) + s for p, s in table.items() if word.endswith(p)), default=float("-inf"))

    ws = ["".join(r.choice("abc") for _ in range(r.randint(1, 9))) for _ in range(30)] + ["xyz", None, ""]
    out = pieces.encode_unigram(spark.createDataFrame([(w,) for w in ws], "word string"), spark.createDataFrame(list(table.items()), "piece string, score double")).collect()
    assert len(out) == len({w for w in ws if w is not None})
    for row in out:
        if row.pieces is None:
            assert row.word in ("xyz", "")
        else:
            assert "".join(row.pieces) == row.word and sum(table[p] for p in row.pieces) == pytest.approx(best(row.word))


def test_buckets_hold_one_length(spark, table, tmp_path):
    packed = packing.pack(table([(1, "one two three"), (2, None), (3, "a much longer text than the others here")]), BPE, longest=8)
    packing.write_buckets(packed, str(tmp_path / "b"))
    back = spark.read.parquet(str(tmp_path / "b"))
    assert back.count() == packed.count() and back.where("length <> pow(2, bucket)").count() == 0 and back.select("bucket").distinct().count() > 1


# nearest vectors


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(nearest, "CELL_ROWS", 64)
    r = np.random.default_rng(1)
    v = r.normal(size=(400, 16)) * r.uniform(0.5, 2, (400, 1))
    v[100:180] = v[100]
    rows = [(i, [float(x) for x in v[i]]) for i in range(400)] + [(400, None), (401, []), (402, [0.0] * 16), (403, [float("nan")] * 16), (404, [None] + [1.0] * 15), (405, [1.0] * 3), (None, [1.0] * 16), (7, [float(x) for x in v[8]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("cell", F.lit(2))
    out = nearest.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()
    by = defaultdict(list)
    for x in out:
        by[x.query_id].append(x)
    assert sorted(by) == list(range(0, 400, 20))
    ids, hit = np.array([i for i in range(400)] + [7]), 0
    m = np.vstack([v, v[8]])
    for q, got in by.items():
        s = np.where(ids == q, -np.inf, m @ v[q])
        want = np.lexsort((ids, -np.round(s, 9)))[:5]
        got.sort(key=lambda x: x.rank)
        assert [x.rank for x in got] == [1, 2, 3, 4, 5] and all(a.score >= b.score for a, b in zip(got, got[1:]))
        hit += len({x.vec_id for x in got} & set(ids[want]))
    assert hit >= 0.9 * 5 * len(by)
    assert [x.vec_id for x in by[120]] == [100, 101, 102, 103, 104]
    few = nearest.nearest(df.where("vec_id < 3"), F.col("vec_id") == 0, k=5).collect()
    assert sorted(x.vec_id for x in few) == [1, 2] and nearest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest.chi_square_quantile(0.95, 10) == pytest.approx(18.307, abs=1e-3)


# quality


def test_quality_both_scorers_agree_and_junk_goes(spark, table):
    r = random.Random(3)
    clean = lambda n: " ".join("".join(r.choice(["the", "an", "re", "on", "is"]) for _ in range(r.randint(1, 3))) for _ in range(n)) + "."
    docs = [(i, clean(40), "en") for i in range(120)] + [(i, "".join(chr(r.randint(33, 126)) for _ in range(200)), "en") for i in range(120, 130)]
    docs += [(200, None, "en"), (201, "", None), (202, clean(30), None), (203, clean(30), "xx"), (204, clean(2), "en"), (204, clean(2), "en")]
    df = table([(a, b, c) for a, b, c in docs], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(0, 0), (None, 1), (125, 0)], "doc_id long, quality int")
    one = {r_.rid: r_ for r_ in quality.score(df, labels).collect()}
    two = {r_.rid: r_ for r_ in quality.score(df, labels, model_rows=0).collect()}
    assert len(one) == len(docs) and all(one[k].kept == two[k].kept and (one[k].perplexity is None) == (two[k].perplexity is None) and (one[k].perplexity is None or abs(one[k].perplexity - two[k].perplexity) < 1e-6) for k in one)
    assert {x.id for x in one.values() if not x.kept} == set(range(120, 130))
    assert all(x.perplexity is None and x.kept for x in one.values() if x.id in (200, 201))
    kept = quality.keep_good(df, labels)
    assert kept.columns == df.columns and kept.count() == len(docs) - 10
    assert quality.score(df, labels.limit(0)).where("kept").count() == len(docs) and quality.score(df.limit(0), labels).count() == 0


def _kneser_ney(trained, order=4):
    """Interpolated modified Kneser-Ney from dictionaries: a function of a 4-gram of code units."""
    def units(t):
        raw = t.encode("utf-16-le", "surrogatepass")
        return [0xFFFF] * (order - 1) + [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]

    counts = {order: Counter()}
    for t in trained:
        u = units(t or "")
        counts[order].update(tuple(u[i : i + order]) for i in range(len(u) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discounts, totals, taken = {}, {}, {}
    for k in counts:
        n1, n2, n3, n4 = (max(sum(v == i for v in counts[k].values()), 1) for i in range(1, 5))
        y = n1 / (n1 + 2 * n2)
        d = [0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
        discounts[k] = [min(max(v, 0), i) for i, v in enumerate(d)]
        totals[k], taken[k] = Counter(), Counter()
        for g, n in counts[k].items():
            totals[k][g[:-1]] += n
            taken[k][g[:-1]] += discounts[k][min(n, 3)]

    def p(g):
        if not g:
            return 1 / 65536
        k, lower = len(g), p(g[1:])
        if g[:-1] not in totals[k]:
            return lower
        n = counts[k][g]
        own = (n - discounts[k][min(n, 3)]) / totals[k][g[:-1]] if n else 0
        return own + taken[k][g[:-1]] / totals[k][g[:-1]] * lower

    def perplexity(t):
        u = units(t)
        grams = [tuple(u[i : i + order]) for i in range(len(u) - order + 1)]
        return math.exp(-sum(math.log(p(g)) for g in grams) / len(grams))

    return perplexity


def test_perplexity_against_dictionaries(spark, table):
    r = random.Random(9)
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(1, 6)))
    line = lambda: " ".join(word(r.choice(["abcde", "αβγδ", "漢字仮名", "é😀🙂"])) for _ in range(r.randint(1, 30)))
    docs = [(i, line(), r.choice(["en", "el", None])) for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(0, 60, 3)], "doc_id long, quality int")
    perplexity = _kneser_ney([t for i, t, _ in docs if i % 3 == 0])
    for rows in (quality.MODEL_ROWS, 0):
        got = {x.id: x.perplexity for x in quality.score(table(docs, "doc_id long, text string, lang string"), labels, model_rows=rows).collect()}
        assert all(got[i] == pytest.approx(perplexity(t), rel=1e-9) for i, t, _ in docs)


def test_a_language_with_few_trusted_texts_is_not_rejected_whole(spark, table):
    r = random.Random(4)
    text = lambda words, n=60: " ".join(r.choice(words) for _ in range(n))
    english, french = ["the", "anthem", "resting", "there", "heat"], ["été", "où", "forêt", "naïf", "leçon"]
    junk = lambda: "".join(chr(r.randint(33, 1000)) for _ in range(200))
    docs = [(i, text(english), "en") for i in range(100)] + [(i, text(french), "fr") for i in range(100, 130)] + [(130, junk(), "fr"), (131, junk(), "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(50)] + [(100, 1)], "doc_id long, quality int")
    out = quality.score(table(docs, "doc_id long, text string, lang string"), labels).where("not kept")
    assert {x.id for x in out.collect()} == {130, 131}


def test_model_is_a_distribution(spark):
    model = quality.train(spark.createDataFrame([("abracadabra abra",), ("cadabra",), (None,)], "text string")).toPandas()
    t = quality.Table(model.kind.to_numpy(np.int8), model.gram.to_numpy(), model.value.to_numpy())
    context = 0
    for ch in "abr":
        context = context << quality.BITS | ord(ch)
    codes = (context << quality.BITS) | np.arange(1 << quality.BITS)
    assert np.exp(t.logs(codes)).sum() == pytest.approx(1.0, abs=1e-9)


# pages


def test_html(spark):
    model = html_extract.Model(html_extract.labelled_pages())
    pages = html_extract.labelled_pages(80, seed=77)
    right = total = 0
    for p in pages:
        nodes = html_extract.parse(p)
        for n, m in zip(nodes, model.marginals(nodes)):
            if n.text is not None:
                total += 1
                right += bool(n.label) == (m > 0.5)
    assert right / total > 0.95
    page = '<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu</a></li></ul></nav><div class="ad">Buy now.</div><article><h1>A &amp; B</h1><p><b>One&nbsp;two.<br><p>Three\n  four.</p></article><footer>&copy; site</footer></body>'
    assert model.text(page) == "A & B\n\nOne two.\n\nThree four."
    assert model.text(page[: page.index("four")] + "<p clas") == "A & B\n\nOne two.\n\nThree" and model.text(None) == "" == model.text("<") + model.text("<div></div>")[:0]
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (2, None, ""), (3, "v", "x" * 50_000)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    assert html_extract.extract(df, ["page_id", "url"]).count() == 4 and html_extract.extract(df.limit(0), ["page_id"]).count() == 0


def test_marginals_are_exact():
    """Messages give the marginals of full enumeration."""
    from itertools import product
    from math import exp

    model = html_extract.Model(html_extract.labelled_pages(60))
    nodes = html_extract.parse("<div><p>one two</p><ul><li><a href=x>m</a></ul></div>")
    n = len(nodes)
    total, on = 0.0, [0.0] * n
    for states in product((0, 1), repeat=n - 1):
        s = (0, *states)
        w = 0.0
        for i in range(1, n):
            a = s[nodes[i].parent]
            seen = [f for f in html_extract.features(nodes[i], nodes) if f in model.shift]
            w += (model.base + sum(model.shift[f] for f in seen)) * a + s[i] * (model.prior[a] + sum(model.lean[a][f] for f in seen))
        total += exp(w)
        for i in range(n):
            on[i] += s[i] * exp(w)
    assert all(abs(x / total - m) < 1e-6 for x, m in zip(on[1:], model.marginals(nodes)[1:]))


# repeated byte strings


def test_suffix_sorting():
    r = random.Random(1)
    for _ in range(25):
        s = [bytes(r.choice(b"ab") for _ in range(r.randint(0, 30))) for _ in range(r.randint(1, 12))]
        owner, depth, lcp = suffix_dedup.sort_collection(s, 10)
        suffixes = [s[k][len(s[k]) - d :] for k, d in zip(owner, depth)]
        common_ = [0] + [min(10, next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))) for a, b in zip(suffixes, suffixes[1:])]
        assert suffixes == sorted(suffixes) and list(lcp) == common_ and len(suffixes) == sum(len(x) + 1 for x in s)


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for at, (i, t) in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            w = b[k : k + length]
            if w in seen:
                gone[k : k + length] = b"\1" * length
            seen.add(w)
        out[at] = (i, bytes(x for x, g in zip(b, gone) if not g))
    return Counter(out.values())


@pytest.mark.parametrize("many", [20_000, 3])
def test_repeats(table, monkeypatch, many):
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 4096)
    r = random.Random(6)
    passage, other = words(r, 60), words(r, 40)
    rows = [(i, words(r, r.randint(5, 80)) + (" " + passage if i % 3 == 0 else "") + " " + words(r, 10)) for i in range(40)]
    rows += [(100, None), (101, ""), (102, "a" * 400), (103, "ab" * 300), (104, "x" + "a" * 250), (105, words(r, 900) + passage + other), (106, other), (None, other), (106, other + "é" * 80), (107, "é" * 120)]
    df = table(rows).coalesce(1)
    held = suffix_dedup.with_spans(df).select(F.col("row.doc_id").alias("i"), F.col("row.text").alias("t"), "spans").collect()
    assert Counter((h.i, suffix_dedup.kept_bytes((h.t or "").encode(), suffix_dedup.merged(h.spans))) for h in held) == brute_repeats(rows)
    if many == 3:
        cut = suffix_dedup.remove_repeats(df)
        assert cut.columns == df.columns and cut.count() == len(rows) and suffix_dedup.remove_repeats(table([])).count() == 0


@pytest.mark.parametrize("partitions", [12, 211])
def test_name_map_holds_every_residue(spark, partitions):
    n = 1 << suffix_dedup.FILTER_BITS
    last = 3 * n - 32768
    names = np.array([0, n, -n, n - 1, -1, last, last + 7, 5 * n + 40_000] + ([1] if partitions == 12 else []), np.int64)
    df = spark.createDataFrame([(int(x),) for x in names], "name long").repartition(partitions, "name")
    held = np.frombuffer(suffix_dedup.name_map(df), np.uint8)
    place = suffix_dedup._bit_place(names)
    assert len(held) == n >> 3 and all((held[place >> 3] >> (place & 7).astype(np.uint8)) & 1)
    assert int(np.unpackbits(held).sum()) == len(set((names % n).tolist()))


# lines


def test_lines(table):
    r = random.Random(8)
    letters = lambda n: words(r, n).translate(str.maketrans("0123456789", "abcdefghij"))
    base = [letters(12) for _ in range(6)]
    rows = [(i, "\n".join([base[i % 6], letters(9), "", "--"])) for i in range(12)] + [(20, None), (21, ""), (22, "Page 1 of 2 in this document\nPAGE 3 of 9, in this document!"), (None, base[0]), (22, base[1])]
    df = table(rows)
    out = line_dedup.line_dedup(df).select(F.col("row.doc_id").alias("i"), "gone", "kept", F.size("lines").alias("n")).collect()
    gone = {(x.i, g) for x in out for g in x.gone}
    assert gone == {(i, 0) for i in range(6, 12)} | {(22, 0), (22, 1), (None, 0)} and sum(len(x.gone) for x in out) == 9
    assert all((x.kept == "" and x.n == 1) for x in out if x.i in (20, 21)) and sum(x.n for x in out) == 12 * 4 + 2 + 2 + 2
    assert line_dedup.line_dedup(table([])).count() == 0


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, c in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def test_edited_lines_become_candidates(table):
    """Each line beside an edited copy of it, short lines and lines without blanks among them; at 0.8 with letters strewn over the line."""
    r = random.Random(11)
    rows, pairs = [], Counter()
    for k in range(960):
        edit = ("letter", "word", "tenth", "fifth")[k % 4]
        size = r.choice((7, 12, 18, 30, 60, 120, 300, 700))
        x = "".join(r.choice("abcdefghijklmnopqrstuvwxyz" + "      " * (k // 4 % 4 > 0)) for _ in range(size))
        x = line = " ".join(x.split()) or "abcdefg"
        if edit == "word":
            w = x.split(" ")
            at = r.randrange(len(w))
            w[at] = "".join(r.choice("abcdefghij") for _ in w[at])
            x = " ".join(w)
        else:
            y, letters = list(x), [i for i, c in enumerate(x) if c != " "]
            for p in r.sample(letters, min(max(1, {"letter": 1, "tenth": len(x) // 10, "fifth": len(x) // 5}[edit]), len(letters))):
                y[p] = chr(0x3B1 + r.randrange(17))
            x = "".join(y)
        longer = max(len(x), len(line))
        if x != line and longer >= 6 and distance(x, line) <= int(longer * 0.2 + 1e-9):
            rows += [(2 * k, line), (2 * k + 1, x)]
            pairs[edit] += 1
    out = line_dedup.line_dedup(table(rows)).where("size(gone) > 0").select(F.col("row.doc_id").alias("i")).collect()
    gone = Counter(("letter", "word", "tenth", "fifth")[x.i // 2 % 4] for x in out)
    print({k: (gone[k], n) for k, n in pairs.items()})
    assert all(pairs[k] > 90 and least * pairs[k] <= gone[k] <= pairs[k] for k, least in (("letter", 1), ("word", 0.99), ("tenth", 0.98), ("fifth", 0.75)))


def test_crowded_keys(table, monkeypatch):
    monkeypatch.setattr(line_dedup, "GRAM_LIST", 3)
    r = random.Random(5)
    base = "".join(r.choice("abcdefghij") for _ in range(90))
    rows = [(i, base[: 3 * i] + "x" + base[3 * i + 1 :]) for i in range(30)] + [(100, "unlike all of the others in this table")]
    assert line_dedup.dropped_lines(table(rows)).count() == 29


def test_crowded_simhashes_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "LONG_LIST", 2)
    monkeypatch.setattr(line_dedup, "SIMS", 4)
    r, base = random.Random(3), random.Random(4).getrandbits(63)
    sims = [base ^ sum(1 << b for b in r.sample((0, 1, 2, 3, 60), r.randint(0, 4))) for _ in range(30)]
    want = {(i, j) for i in range(30) for j in range(i + 1, 30) if (sims[i] ^ sims[j]).bit_count() <= 3}
    found, _ = line_dedup.sim_pairs(spark.createDataFrame(list(enumerate(sims)), "line long, sim long"))
    assert {tuple(x) for x in found.collect()} == want and len(want) < 30 * 29 / 2


def test_simhash(spark):
    r = random.Random(9)
    rows = [(words(r, n),) for n in (1, 5, 60, 127, 128, 300)]
    got = line_dedup.with_simhash(spark.createDataFrame(rows, "norm string")).withColumn("h", F.transform(F.split("norm", " "), lambda w: F.xxhash64(w))).collect()
    for x in got:
        want = sum(1 << b for b in range(64) if 2 * sum((h >> b) & 1 for h in x.h) > len(x.h))
        assert x.sim & ((1 << 64) - 1) == want and x.words == len(x.h)


def test_line_sims_equal_simhash(spark):
    r = random.Random(19)
    texts = [words(r, n) for n in (16, 40, 127, 300, 2000)] + [words(r, 8)]
    rows = [(i, 0, i, t, len(t.split())) for i, t in enumerate(texts)] + [(9, 1, 1, texts[1], 40)]
    lines = spark.createDataFrame(rows, "rid long, at int, line long, norm string, words int")
    want = line_dedup.with_simhash(lines.where("words >= 16").select("line", "norm")).select("line", "sim").distinct()
    assert sorted(map(tuple, line_dedup.line_sims(lines).collect())) == sorted(map(tuple, want.collect()))


def test_verify_does_not_depend_on_the_block():
    rng = np.random.default_rng(3)
    v = np.concatenate([np.repeat(rng.standard_normal((1, 48)), 300, 0), rng.standard_normal((1500, 48))])
    ids, q, asks = rng.permutation(len(v)), v[[0, 1, 400, 900]], np.array([-1, -2, -3, -4])
    low, none, longest = v[:, :5], np.full(4, np.nan), (v * v).sum(1).max()
    row, near, score, done = nearest.verify(q, asks, none, q[:, :5], v, ids, low, longest, 1e9, 20)
    assert (done == len(v)).all()
    for i in range(4):
        exact = (v * q[i]).sum(1)
        want = np.lexsort((ids, -exact))[:20]
        assert near[row == i].tolist() == ids[want].tolist() and score[row == i].tolist() == exact[want].tolist()
    # and costs less than products of gathered vectors
    q, more = rng.standard_normal((128, 48)), rng.standard_normal((3000, 48))
    best = [math.inf, math.inf]
    for _ in range(3):
        start = time.process_time()
        order = np.argsort(((q[:, None, :5] - more[:, :5]) ** 2).sum(2), axis=1)
        for i in range(0, len(more), 128):
            (more[order[:, i : i + 128]] * q[:, None, :]).sum(2)
        middle = time.process_time()
        nearest.verify(q, np.full(128, -1), np.full(128, np.nan), q[:, :5], more, np.arange(len(more)), more[:, :5], longest, 1e9, 20)
        best = [min(best[0], middle - start), min(best[1], time.process_time() - middle)]
    assert best[1] < best[0]


# near copies


def shingles(t, w):
    x = (t or "").encode().lower().split()
    return frozenset(tuple(x[i : i + w]) for i in range(max(1, len(x) - w + 1))) if x else frozenset()


@pytest.mark.parametrize("crowd", [False, True])
def test_near(table, monkeypatch, crowd):
    if crowd:
        monkeypatch.setattr(near_dedup, "LONG_LIST", 6)
    r = random.Random(12)

    def edited(t, k):
        x = t.split()
        for _ in range(k):
            x[r.randrange(len(x))] = f"e{r.randrange(10**6)}"
        return " ".join(x)

    origin, passage = words(r, 150), words(r, 40)
    rows = [(i, words(r, 100) + " " + passage) for i in range(30)] + [(100 + i, edited(origin, r.randint(0, 12))) for i in range(40)]
    rows += [(300, None), (301, ""), (302, " \t"), (303, "one"), (304, "ONE"), (305, "a b c d e f"), (306, "a b c d e g"), (307, "a b c d e"), (None, origin), (308, "short one"), (308, edited(origin, 1)), (309, origin)]
    got = Counter(map(tuple, near_dedup.near_components(table(rows), words=2).collect()))
    sets = [(i, shingles(t, 2)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if i is not None and j is not None and x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    assert got == Counter((i, len(s), find(i) if i is not None else None, i is None or find(i) == i) for i, s in sets)


def test_an_unlinked_crowd_goes_through_its_postings_once_more(table, monkeypatch):
    """A passage that 30 documents share: a star that links none of them ends the stars, and its postings serve the step after."""
    monkeypatch.setattr(near_dedup, "LONG_LIST", 6)
    passes, by_key = [], near_dedup.by_key
    monkeypatch.setattr(near_dedup, "by_key", lambda rows, lookup, key, *a, **k: (passes.append(key), by_key(rows, lookup, key, *a, **k))[1])
    r = random.Random(41)
    passage = words(r, 60)
    rows = [(i, words(r, 40) + " " + passage) for i in range(30)]
    rows += [(100, rows[7][1] + " end")]
    got = {x.doc_id: x.component_id for x in near_dedup.near_components(table(rows), words=2).collect()}
    assert got == {i: i for i in range(30)} | {100: 7}
    assert passes.count("key") == 5  # both lists' lengths, two stars, one look for what is unsettled


@pytest.mark.parametrize("least", [512, 5])
def test_members_of_crowds_meet_once(spark, monkeypatch, least):
    """Each pair that set sizes allow, outside a main component on one side at least, meets once; a member goes to few cells."""
    monkeypatch.setattr(near_dedup, "LEAST", least)
    r = random.Random(8)
    rows = [(m, 1000 * m + i, m if i < mains else 1000 * m + i // 2, n) for m, size, mains in ((1, 90, 3), (2, 90, 80), (3, 2, 1), (4, 5, 5)) for i in range(size) for n in [r.choice((4, 5, 80, 100, 125)) if i % 3 else int(2 ** (10 * r.random()))]]
    dealt = near_dedup.crowd_cells(spark.createDataFrame(rows, "main long, cid long, component long, n long"), 80, 10_000)
    held = dealt.withColumn("cell", F.explode("cells")).drop("cells").select("*", "cell.*").drop("cell")
    got = Counter(tuple(sorted(x)) for x in near_dedup.meeting(held).select("cid", "cid2").collect())
    want = {tuple(sorted((a[1], b[1]))) for a in rows for b in rows if a[0] == b[0] and a[2] != b[2] and a[1] < b[1] and 5 * min(a[3], b[3]) >= 4 * max(a[3], b[3])}
    assert want <= set(got) and set(got.values()) == {1}
    assert len(want) > 1000 and (least < 512 or held.count() <= 2 * len(rows) + 2 * sum(x[0] == 2 for x in rows))


def test_bits_keep_every_link(spark):
    r = random.Random(31)
    rows = []
    for i in range(300):
        n = r.choice((1, 5, 40, 200, 900))
        x = [r.randrange(1 << 63) for _ in range(n)]
        y = x[r.randint(0, n // 4) :] + [r.randrange(1 << 63) for _ in range(r.randint(0, n // 6))]
        rows += [(x, y), (x, [r.randrange(1 << 63) for _ in x])]
    bits = lambda hashes: [b - (1 << 64) if b >> 63 else b for b in (sum({1 << h % 512 - 64 * j for h in hashes if h % 512 // 64 == j}) for j in range(near_dedup.LONGS))]
    df = spark.createDataFrame([(x, y, len(x), len(y), bits(x), bits(y)) for x, y in rows], "x array<long>, y array<long>, n long, n2 long, bits array<long>, bits2 array<long>")
    one, two = near_dedup.with_bits(df.select("x", "y", "n", "bits", F.monotonically_increasing_id().alias("at"))), near_dedup.with_bits(df.select("n2", "bits2", F.monotonically_increasing_id().alias("at")).toDF("n", "bits", "at"))
    two = near_dedup._other(two, *[c for c in two.columns if c != "at"])
    got = one.join(two, "at").orderBy("at").select(near_dedup._may_link(80).alias("may"), near_dedup._linked("x", "y", 80).alias("linked"), "n").collect()
    assert all(g.may for g in got if g.linked) and sum(g.linked for g in got) > 100
    assert not any(g.may for g in got[1::2] if 5 < g.n < 900)
    docs = spark.createDataFrame([(1, "a b c d e f g")], "doc_id long, text string")
    one = near_dedup.sketches(docs, "doc_id", "text", 2, full=True).first()
    assert one.bits == bits(one.sketch)


def test_components(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1040)] + [(5, 5), (None, 3)]
    got = dict(map(tuple, common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    low = {x: x for e in edges for x in e if x is not None}
    for _ in range(60):
        for a, b in edges:
            if a is not None:
                low[a] = low[b] = min(low[a], low[b])
    assert got == {k: low[k] for k in got} and set(got) == {x for a, b in edges if a is not None and a != b for x in (a, b)}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# queries


def test_queries_of_the_contract(spark, sf_dir):
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14))
    out = registry.QUERIES["op1_packing"](spark, sf_dir).limit(5).collect()
    ids = tokens.encoder(BPE).encode(spark.read.parquet(f"{sf_dir}/documents.parquet").where(f"doc_id = {out[0].doc_id}").first().text) + b"\0" * 4
    p = out[0]
    assert p.ids_crc32 == zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    from tests.test_queries import compare

    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])
