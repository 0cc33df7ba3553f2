import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sextant.operators import binning, documents as D, joins, models, prices, stats, windows
from sextant.sources import readers, sinks
from sextant.streaming.running import windowed_counts

DAY = dt.date(2021, 1, 4)
day = lambda i: DAY + dt.timedelta(days=i)


def test_asof_is_strict_and_null_before_the_start(spark):
    market = spark.createDataFrame([(day(i), float(i)) for i in range(0, 30, 2)], "of date, v double")
    events = spark.createDataFrame([(1, day(4)), (2, day(5)), (3, day(-3)), (4, day(90)), (5, day(0))], "id int, at date")
    got = {r.id: (r.matched_at, r.v) for r in joins.asof_before(events, market, "at", "of", ["v"]).collect()}
    assert got == {1: (day(2), 2.0), 2: (day(4), 4.0), 3: (None, None), 4: (day(28), 28.0), 5: (None, None)}
    assert joins.asof_before(events.limit(0), market, "at", "of", ["v"]).count() == 0


@pytest.mark.parametrize("large", [False, True])
def test_range_lookup(spark, monkeypatch, large):
    if large:
        monkeypatch.setattr(joins, "BROADCAST_ROWS", 1)
    r = spark.createDataFrame([(100, 999, "A"), (2000, 9999, "B")], "lo int, hi int, s string")
    c = spark.createDataFrame([("2834.0",), ("100",), ("1500",), (None,), ("x",)], "c string")
    assert [x.s for x in joins.range_lookup(c, r, "c", "lo", "hi", "s").orderBy(F.col("c").desc_nulls_last()).collect()] == ["Unclassified", "B", "Unclassified", "A", "Unclassified"]
    with pytest.raises(ValueError):
        joins.assert_disjoint(spark.createDataFrame([(1, 5), (5, 9)], "lo int, hi int"), "lo", "hi")


def test_average_rank_and_spearman(spark):
    df = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0), (2.0, 1.0), (5.0, 0.0), (None, 1.0)], "x double, y double")
    got = sorted((r.x, r.rk) for r in windows.average_rank(df.where("x is not null"), "x", "rk").collect())
    assert got == [(1.0, 1.0), (2.0, 2.5), (2.0, 2.5), (5.0, 4.0)]
    rho, p, n = stats.spearman(df, "x", "y")
    assert n == 4 and rho == pytest.approx(-0.9486833) and 0 < p < 1


def test_hot_market_is_causal(spark):
    rows = [(i, day(7 * i)) for i in range(150)] + [(150 + i, day(7 * 150 + i)) for i in range(150)]
    df = windows.trailing_count(spark.createDataFrame(rows, "id int, d date"), "d", "id", 90, "cnt")
    out = windows.expanding_quantile_flag(df, "d", "id", "cnt", 2 / 3, 50, "hot", "thr").orderBy("id").collect()
    assert all(r.hot is None for r in out[:50]) and {r.hot for r in out[50:]} <= {0.0, 1.0} and all(r.hot == 1.0 for r in out[-50:])
    part = windows.expanding_quantile_flag(df.where("id < 200"), "d", "id", "cnt", 2 / 3, 50, "hot", "thr").orderBy("id").collect()
    assert [r.hot for r in part] == [r.hot for r in out[:200]]


def test_qcut_keeps_distinct_edges(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3, 4, 5, 6, 7]] + [(None,)], "x double")
    got = {r.bin: r.n for r in binning.qcut(df, "x", 5, "bin").groupBy("bin").agg(F.count("*").alias("n")).collect()}
    assert sum(got.values()) == 11 and got[None] == 1 and got[0] == 4


def test_adjusted_p_values(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", None), ("d", 0.03)], "t string, p double")
    got = {r.t: r for r in stats.adjust(df, "t", "p").collect()}
    assert got["c"].p_bh is None and got["a"].p_bonferroni == pytest.approx(0.03)
    assert [got[x].p_bh for x in "adb"] == sorted(got[x].p_bh for x in "adb") and all(got[x].p_bh <= got[x].p_bonferroni + 1e-12 for x in "abd")


def test_ols_matches_numpy_with_collinear_columns(spark):
    import numpy as np

    r = random.Random(3)
    rows = [(x := r.gauss(0, 1), z := r.gauss(0, 1), 2 * x, 1 + 3 * x - z + r.gauss(0, 1 + abs(x))) for _ in range(300)]
    out = stats.ols(spark.createDataFrame(rows, "x double, z double, x2 double, y double"), "y", ["x", "z"])
    m = np.array(rows)
    X = np.c_[np.ones(300), m[:, 0], m[:, 1]]
    inv = np.linalg.inv(X.T @ X)
    beta = inv @ X.T @ m[:, 3]
    e = m[:, 3] - X @ beta
    h = np.einsum("ij,jk,ik->i", X, inv, X)
    hc3 = np.sqrt(np.diag(inv @ (X.T * (e / (1 - h)) ** 2) @ X @ inv))
    assert np.allclose(out["beta"], beta) and np.allclose(out["se"], hc3)
    again = stats.ols(spark.createDataFrame(rows, "x double, z double, x2 double, y double"), "y", ["x", "z", "x2"])
    assert again["rank"] == 3 and again["r2"] == pytest.approx(out["r2"])


def test_variance_tests_see_a_planted_effect(spark):
    r = random.Random(5)
    rows = [(g, r.gauss(0, 1 + g)) for g in (0, 1, 2) for _ in range(150)]
    df = spark.createDataFrame(rows, "g int, x double")
    assert stats.levene(df, "g", "x")["p"] < 0.01 and stats.fligner(df, "g", "x")["p"] < 0.01 and stats.kruskal(df, "g", "x")["p"] > 0.001


def test_bootstrap(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(101)] + [("b", 1.0), ("b", 2.0)], "g string, x double")
    got = {r.g: r for r in stats.bootstrap(df, ["g"], "x", draws=400).collect()}
    assert got["a"].ci_low < got["a"].value == 50.0 < got["a"].ci_high and got["b"].ci_low is None


def test_uniqueness(spark):
    same = [(i, "s", "common filler words appear here again", i) for i in range(15)]
    got = {r.id: r for r in D.expanding_uniqueness(spark.createDataFrame(same, "id int, g string, t string, o int"), "id", "t", "g", ["o"]).collect()}
    assert all(got[i].uniqueness is None for i in range(5)) and all(got[i].uniqueness < 0.05 for i in range(5, 15))


def test_uniqueness_splits_texts_once_in_tasks_of_its_own(spark, monkeypatch):
    plans, write = [], D.scratch.write
    monkeypatch.setattr(D.scratch, "write", lambda df: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), write(df))[1])
    rows = [(i, "a", "one two three" if i % 3 else ("", None, "7 8")[i % 2 + i // 9], i) for i in range(12)]
    got = {r.id: r.prior for r in D.expanding_uniqueness(spark.createDataFrame(rows, "id int, g string, t string, o int"), "id", "t", "g", ["o"]).collect()}
    assert got == {i: i - i // 3 - 1 for i in range(12) if i % 3}
    assert plans[0].count("regexp_replace") == 1 and "RepartitionByExpression" in plans[0]


def test_sections_and_entities(spark):
    body = lambda h: f" Table of Contents\n{h}\n" + "words " * 120
    text = "".join(map(body, ["RISK FACTORS", "USE OF PROCEEDS", "LEGAL MATTERS", "nothing", "DIVIDEND POLICY"])) + "see RISK FACTORS"
    found = D.split_sections(text)
    assert sorted(found) == ["dividend_policy", "legal_matters", "risk_factors", "use_of_proceeds"] and found["risk_factors"].startswith("RISK FACTORS")
    assert D.split_sections("Table of Contents RISK FACTORS") == {} and D.split_sections(None) == {}
    terms = D.search_terms({"goldman sachs": "Goldman", "sachs": "Sachs Only", "td": "TD"}, {"cohen": "Cohen", "apollo": "Apollo"}, {"apollo"})
    assert [k for k, _ in terms] == ["goldman sachs", "sachs", "cohen"]
    docs = spark.createDataFrame([(1, "Cohen & Goldman Sachs and Apollo", "x"), (2, "Sachs", "Sachs Holdings"), (3, None, None)], "id int, t string, i string")
    assert {r.id: r.names for r in D.spot_entities(docs, "id", "t", terms, "i").collect()} == {1: ["Cohen", "Goldman"], 2: [], 3: []}


def test_splits_and_first_day(spark):
    p = [("A", day(i), 10.0 if i < 20 else 5.0) for i in range(40)] + [("B", day(i), 10.0) for i in range(40)]
    prices_ = spark.createDataFrame(p, "k string, d date, c double").withColumn("o", F.col("c"))
    splits = spark.createDataFrame([("A", day(20), 2.0), ("B", day(20), 2.0), ("B", day(25), 1.0)], "k string, d date, r double")
    applied = prices.applied_splits(prices_, splits, "k", "d", "c", "r")
    assert {(r.k, r.d): r.applied for r in applied.collect()} == {("A", day(20)): False, ("B", day(20)): True, ("B", day(25)): False}
    events = spark.createDataFrame([("A", day(0)), ("B", day(0)), ("B", day(20))], "k string, at date")
    assert {(r.k, r.at): r.split_factor for r in prices.split_factor(events, applied, "k", "at", "d", "r").collect()} == {("A", day(0)): 1.0, ("B", day(0)): 2.0, ("B", day(20)): 1.0}
    e = spark.createDataFrame([("A", day(0), 8.0), ("A", day(10), 8.0), ("B", day(-20), 8.0), ("C", day(0), 8.0), ("B", day(0), None)], "k string, at date, offer double")
    got = {(r.k, r.at): r for r in prices.first_day(e, prices_, "k", "at", "offer", "d", "o", "c").collect()}
    assert got["A", day(0)].status == "ok" and got["A", day(0)].first_return == 0.25 and got["A", day(0)].month_return == -0.5
    assert got["A", day(10)].status == "pre_event_history_10d" and got["B", day(-20)].status == "first_trade_20d_after" and got["C", day(0)].status == "no_data" and got["B", day(0)].status == "no_offer_price"


def test_models(spark):
    r = random.Random(1)
    rows = [(i, x := r.gauss(0, 1), "ab"[i % 2], 3 * x + r.gauss(0, 0.1)) for i in range(400)]
    df = spark.createDataFrame(rows, "t int, x double, c string, y double")
    out = models.cross_validate(df, "y", ["t"], ["x"], ["c"], k=3).collect()
    assert min(o.r2 for o in out if o.model == "ridge") > 0.95 > max(o.r2 for o in out if o.model == "mean")
    assert models.time_folds(709, 5)[0] == (1, 119, 118) and models.time_folds(709, 5)[-1] == (5, 591, 118)
    fs = models.select_features(df.withColumn("k", F.lit(1)).withColumn("n", F.lit(None).cast("double")), ["x", "c", "k", "n"])
    assert fs.numeric == ["x"] and fs.categorical == ["c"] and fs.dropped_constant == ["k"] and fs.dropped_missing == ["n"]
    with pytest.raises(ValueError):
        models.select_features(df, ["x"], {"x"})


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,d,s\n1.5,2020-01-02,0012\nNaN,bad,\n")
    assert [tuple(r) for r in readers.csv(spark, f"{tmp_path}/a.csv", "n double, d date, s string").collect()] == [(1.5, dt.date(2020, 1, 2), "0012"), (None, None, None)]
    with pytest.raises(ValueError):
        readers.csv(spark, f"{tmp_path}/a.csv", "missing int")
    (tmp_path / "t").mkdir()
    for name in ("AB_C_2020.txt", "AB_C_2020_mda.txt", "odd.txt"):
        (tmp_path / "t" / name).write_bytes(b"x\xffy")
    got = readers.text_files(spark, f"{tmp_path}/t", ("_mda",)).orderBy("kind").collect()
    assert [(r.key, r.tag, r.kind) for r in got] == [("AB_C", "2020", "full"), ("AB_C", "2020", "mda")]
    html = "<table><tr><td>no</td></tr></table><table id=main-table><thead><tr><th>Symbol</th><th>Price</th></tr></thead><tr><td>A&amp;B</td><td>1</td></tr><tr><td>odd</td></tr></table>"
    assert readers.table_rows(html) == [{"Symbol": "A&B", "Price": "1"}, {"col_0": "odd"}] and readers.table_rows(None) == []
    assert readers.html_tables(spark.createDataFrame([(1, html), (2, None)], "id int, h string"), ["id"], "h").count() == 2
    raw = spark.createDataFrame([('{"0":{"cik_str":42,"ticker":"ab"},"1":{"cik_str":7,"ticker":"C"}}',)], "b string")
    assert {(r.ticker, r.cik) for r in readers.ticker_ids(raw, "b").collect()} == {("AB", "0000000042"), ("C", "0000000007")}
    raw = spark.createDataFrame([(1, '{"f":["S-1","S-1/A"],"d":["2020-01-01"],"sic":" "}')], "id int, b string")
    assert [tuple(r) for r in readers.parallel_arrays(raw, ["id"], "b", ["f", "d"]).collect()] == [(1, "S-1", "2020-01-01")]
    assert readers.json_fields(raw, ["id"], "b", {"sic": "$.sic"}).first().sic is None


def test_sinks(spark, tmp_path):
    (tmp_path / "in.txt").write_text("x")
    df = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    meta = sinks.write_table(df, f"{tmp_path}/out", "three rows", "test", [f"{tmp_path}/in.txt"])
    assert meta["rows"] == 3 and len(meta["input_sha256"]) == 64 and json.loads((tmp_path / "out.meta.json").read_text()) == meta
    assert readers.assert_sha256(spark, f"{tmp_path}/in.txt", meta["input_sha256"])
    with pytest.raises(ValueError):
        readers.assert_sha256(spark, f"{tmp_path}/in.txt", "0" * 64)
    assert sinks.write_once(df, f"{tmp_path}/p") and not sinks.write_once(df, f"{tmp_path}/p")
    assert sinks.missing_and_extra(spark, ["a", "b"], spark.createDataFrame([("b",), ("c",)], "n string"), "n") == (["a"], ["c"])
    claims = spark.createDataFrame([("c1", "12.5 %", "k", "v", 0.05, 1), ("c2", "7", "k", "v", 0.1, 0)], "claim string, literal string, key string, column string, tolerance double, percent int")
    table = spark.createDataFrame([("k", "v", 0.125)], "key string, column string, value double")
    assert {r.claim: r.ok for r in sinks.check_claims(claims, table, "it was 12.5 % then").collect()} == {"c1": True, "c2": False}


def test_stream_counts_what_the_table_counts(spark, tmp_path):
    spark.createDataFrame([(dt.datetime(2024, 1, 1 + h // 24, h % 24), "a") for h in range(48)], "at timestamp, k string").write.parquet(f"{tmp_path}/s")
    table = spark.read.parquet(f"{tmp_path}/s")
    want = sorted(map(tuple, windowed_counts(table, "at", ["k"]).collect()))
    q = windowed_counts(spark.readStream.schema(table.schema).parquet(f"{tmp_path}/s"), "at", ["k"]).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == want


def test_cross_validation_chooses_trees_and_winsorises(spark):
    df = spark.createDataFrame([(i, float(i % 7), "a" if i % 2 else "b", (1e6 if i == 50 else 0.0) + 10.0 * (i % 7)) for i in range(240)], "t long, x double, c string, y double")
    grids = {"forest": models.forest_grid(trees=3, depths=(1, 4)), "boosted": models.boosted_grid(rounds=(2,), steps=(0.1,), depths=(2,))}
    out = {r.model: r for r in models.cross_validate(df, "y", ["t"], ["x"], ["c"], k=1, winsorise=True, trees=grids).collect()}
    assert set(out) == {"mean", "median", "ridge", "forest", "boosted"} and out["mean"].spearman is None
    assert out["forest"].spearman > 0.9 and out["ridge"].spearman > 0.99
    assert out["mean"].rmse < 100  # the outlier of the training window is clipped
    assert models.choose_trees(df, 79, "y", grids["forest"], ["x"], ["c"]) == "depth 1"
    assert len(models.forest_grid()) == 3 and len(models.boosted_grid()) == 8


def test_training_windows_share_passes(spark):
    import numpy as np

    from sextant.operators import selection, windows

    r = random.Random(5)
    rows = [(i, r.choice([None, r.gauss(0, 1), 2.0]), r.choice([1.0, 1e9, -3.5, r.random()]), r.choice([float("nan"), 1.0, 2.0]), None, 7.0) for i in range(600)]
    df = spark.createDataFrame(rows, "pos long, a double, b double, n double, e double, k double").repartition(3)
    names, sizes, shares = ["a", "b", "n", "e", "k"], [600, 50, 1], [0.0, 0.01, 0.5, 0.99, 1.0]
    got = selection.prefix_quantiles(df, "pos", sizes, names, shares)
    for s in sizes:
        for j, c in enumerate(names, 1):
            known = [x[j] for x in rows[:s] if x[j] is not None]
            assert got[s, c] == pytest.approx(np.quantile(np.sort(known), shares), rel=1e-12, nan_ok=True) if known and c != "n" else known or got[s, c] is None
    assert got[600, "n"][2] == 2.0 and math.isnan(got[600, "n"][4])
    learnt = models.learn_numeric(df, sizes, ["a", "b", "e", "k"])
    for c, found in models._learn(df.where(F.col("pos") < 50), ["a", "b", "e", "k"]).items():
        assert learnt[50][c] == pytest.approx(found, rel=1e-9, abs=1e-9)
    edges = sorted(r.gauss(0, 1) for _ in range(13))
    below = df.select("a", windows.edges_below(F.col("a"), edges).alias("n")).collect()
    assert all(x.n == (0 if x.a is None else np.searchsorted(edges, x.a)) for x in below)


def test_prepare_keeps_every_category(spark):
    df = spark.createDataFrame([(f"a{i:05}",) for i in range(1200)] + [("zz",)] * 20, "c string")
    (a, b), names = models.prepare(df, [df, spark.createDataFrame([("unseen",)], "c string")], [], ["c"])
    assert names == ["f_c_0", "f_c_rare"] and a.agg(F.sum("f_c_0"), F.sum("f_c_rare")).first()[:] == (20.0, 1200.0)
    assert b.first()[:] == ("unseen", 0.0, 0.0)


# studies


def test_spearman_interval_and_difference(spark):
    import numpy as np

    from sextant.operators import studies

    r = np.random.default_rng(3)
    x = r.normal(size=300)
    y = 0.6 * x + r.normal(size=300)
    rows = [(float(a), float(b), i % 2) for i, (a, b) in enumerate(zip(x, y))] + [(None, 1.0, 0), (float("nan"), 2.0, 1)]
    df = spark.createDataFrame(rows, "x double, y double, g int")
    got = studies.spearman_interval(df, "x", "y", 500)
    rank = lambda v: np.argsort(np.argsort(v))
    rho = np.corrcoef(rank(x), rank(y))[0, 1]
    assert got["n"] == 300 and abs(got["rho"] - rho) < 1e-9 and got["ci_low"] < rho < got["ci_high"]
    draws = [np.corrcoef(rank(x[i]), rank(y[i]))[0, 1] for i in (r.integers(0, 300, 300) for _ in range(500))]
    assert abs(got["ci_low"] - np.percentile(draws, 2.5)) < 0.04 and abs(got["ci_high"] - np.percentile(draws, 97.5)) < 0.04
    diff = studies.rho_difference(df, "x", "y", "g", 200)
    assert diff["n_1"] + diff["n_0"] == 300 and diff["ci_low"] <= diff["difference"] <= diff["ci_high"]
    assert studies.spearman_interval(df.limit(3), "x", "y", 20)["ci_low"] is None


def test_slopes_match_numpy(spark):
    import numpy as np

    from sextant.operators import studies

    r = np.random.default_rng(5)
    x, z, g = r.normal(size=200), r.normal(size=200), r.integers(0, 3, 200)
    y = 2 * x - z + g + r.normal(size=200) * (1 + abs(x))
    df = spark.createDataFrame([(float(a), float(b), float(c), f"s{d}", 1.0) for a, b, c, d in zip(y, x, z, g)], "y double, x double, z double, g string, one double")
    got = studies.slope(df, "y", "x", ["z", "one", "absent"], ["g"])
    m = np.column_stack([np.ones(200), x, z, g == 1, g == 2]).astype(float)
    inv = np.linalg.inv(m.T @ m)
    beta = inv @ m.T @ y
    u = (y - m @ beta) / (1 - np.einsum("ij,jk,ik->i", m, inv, m))
    se = np.sqrt(np.diag(inv @ (m.T * u**2) @ m @ inv))
    assert got["n"] == 200 and got["estimate"] == pytest.approx(beta[1]) and got["ci_high"] - got["estimate"] == pytest.approx(studies.Z * se[1])
    assert studies.slope(df.limit(10), "y", "x")["estimate"] is None
    both = studies.interaction(df.withColumn("f", (F.col("z") > 0).cast("int")), "y", "x", "f")
    f = z > 0
    apart = [np.polyfit(x[s], y[s], 1)[0] for s in (f, ~f)]
    assert both["estimate"] == pytest.approx(apart[0] - apart[1]) and both["main"] == pytest.approx(apart[1])


def test_study_bundles(spark, sf_dir):
    from dataclasses import replace

    from sextant.operators import studies
    from sextant.plans import study

    rows = study.events(spark, sf_dir).persist()
    small = replace(study.STUDY, draws=48)
    out = {r.test: r for r in studies.summary(rows, small).collect()}
    assert sorted(out) == ["T1", "T2", "T3", "T4", "T5", "T6"] and all(r.p_bonferroni >= r.p_raw and r.p_bh >= r.p_raw for r in out.values())
    assert out["T4"].p_robust is not None and out["T1"].ci_low <= out["T1"].statistic <= out["T1"].ci_high
    table = studies.robustness(rows.where("year < 1997"), small).collect()
    assert len(table) == 4 + 2 + 3 + 5 + 4 and {r.kind for r in table} == {"spearman", "partial_spearman", "ols_beta", "ols_beta_winsorised"}
    assert next(r for r in table if r.specification == "excluded kind only").estimate is None
    assert studies.binned_medians(rows.limit(10), "length", "y", 5).count() == 0
    assert studies.association(rows.limit(10), "length", "y", 5)["method"] == "insufficient data"


def test_correlation_order():
    from sextant.operators import studies

    r = [[1, 0.1, 0.9, 0.2], [0.1, 1, 0.1, -0.8], [0.9, 0.1, 1, 0.1], [0.2, -0.8, 0.1, 1]]
    assert studies.correlation_order(r) == [0, 2, 1, 3]


def test_small_operators(spark, tmp_path):
    from sextant.functions import columns as C, text as T
    from sextant.operators import joins, models
    from sextant.sources import readers, sinks

    df = spark.createDataFrame([(1, 2.5, -9.0, 1), (2, 3.5, 6.001, 3), (3, None, None, None)], "id int, x double, raw double, modal int")
    got = df.select("id", C.half_even(F.col("x")).alias("h"), C.rank_value(F.col("raw")).alias("r"), C.not_equal(F.col("modal"), 1).alias("ne"), C.log1p(F.col("raw")).alias("l"), *[c.alias(n) for n, c in C.code_flags(F.col("modal"), {1: "strong", 3: "weak"}).items()]).collect()
    assert [(r.h, r.r, r.ne, r.strong, r.weak) for r in got] == [(2.0, None, False, 1, 0), (4.0, 6.0, True, 0, 1), (None, None, True, 0, 0)] and got[0].l is None
    assert [r.id for r in df.where(C.any_flag(["modal"])).collect()] == [1, 2]
    assert "p" in C.product_if_absent(df, "p", "id", "x").columns and C.product_if_absent(df, "x", "id", "raw") is df
    wide = spark.createDataFrame([("a", 1.0, None)], "n string, p1 double, p2 double")
    assert [(r.n, r.year, r.rank) for r in C.by_years(wide, ["n"], {"p1": [2018, 2019], "p2": [2020]}).collect()] == [("a", 2018, 1.0), ("a", 2019, 1.0)]
    assert C.union_all(df.select("id"), df.select("id", "x")).where("x is null").count() == 4
    ranks = spark.createDataFrame([("a", 2018, 9.0), ("a", 2019, 8.0)], "n string, year int, rank double")
    asked = spark.createDataFrame([("a", 2019), ("a", 2020), ("b", 2018)], "n string, year int")
    assert {(r.n, r.year): r.rank for r in joins.value_at(asked, ranks, "n", "year", "rank").collect()} == {("a", 2019): 8.0, ("a", 2020): None, ("b", 2018): None}
    words = spark.createDataFrame([("good", 1, 0, 1), ("Bad ", 0, 2, 3), ("none", 0, 0, 0)], "word string, positive int, negative int, modal int")
    lex = D.lexicon(words, "word", ["positive", "negative"], {"modal": {1: "strong", 3: "weak"}})
    assert sorted(map(tuple, lex.collect())) == [("BAD", "negative"), ("BAD", "weak"), ("GOOD", "positive"), ("GOOD", "strong")]
    with pytest.raises(ValueError, match="litigious"):
        D.lexicon(words, "word", ["litigious"])
    page = spark.createDataFrame([(1, "<p>a &amp; b</p><script>no</script>\n\n\n\n<i>c</i>"), (2, None)], "i int, h string")
    assert {r.i: r.t for r in page.select("i", T.exact_text(F.col("h")).alias("t")).collect()} == {1: "a & b \n\n c", 2: ""}
    body = lambda h: f" Table of Contents\n{h}\n" + "words " * 120
    filings = spark.createDataFrame([(1, "".join(map(body, ["RISK FACTORS", "USE OF PROCEEDS", "LEGAL MATTERS", "x", "y"]))), (2, "plain"), (3, " ")], "i int, t string")
    assert tuple(D.section_coverage(filings, "t", ["risk_factors", "mda"]).first()) == (2, 1, 0, 1)
    files = spark.createDataFrame([("A", "1", "full", "text"), ("A", "1", "mda", "talk")], "key string, tag string, kind string, text string")
    rows = readers.with_texts(spark.createDataFrame([("A", "1"), ("B", "2")], "ticker string, day string"), files, "ticker", "day", {"full": "full_text", "mda": "mda_text"})
    assert {r.ticker: (r.full_text, r.mda_text) for r in rows.collect()} == {"A": ("text", "talk"), "B": ("", "")}
    assert [r.status for r in readers.read_status(spark.createDataFrame([("x", None), (" ", None), (None, None), ("x", "Timeout")], "t string, e string"), "t", "e").collect()] == ["ok", "empty", "missing", "error: Timeout"]
    path = str(tmp_path / "pair")
    assert sinks.write_pair(df, path + "1", path + "2", F.col("id") > 1) == (3, 2)
    sinks.write_text(spark, path + "/a.svg", "x" * 50)
    sinks.write_text(spark, path + "/b.svg", "x")
    assert sinks.size_budget(spark, path, {"a.svg": (10, 20), "c.svg": (1, 2)}, (".svg",)) == ["over budget (50 bytes): a.svg", "missing: c.svg", "unexpected: b.svg"]
    assert list(sinks.report(df.where("id = 1"), "%d: %.1f", "id", "x")) == ["1: 2.5"]
    models.assert_before(spark.createDataFrame([(1, 2), (None, 1)], "a int, b int"), "a", "b")
    with pytest.raises(ValueError):
        models.assert_before(spark.createDataFrame([(2, 2)], "a int, b int"), "a", "b")


# order statistics


def test_quantiles_of_large_groups(spark):
    from sextant.operators.selection import group_quantiles, select_ranks

    r = random.Random(8)
    rows = [(r.choice(["a", "b", None, "c"]), r.choice([None, float(r.randrange(50)), r.gauss(0, 1e6), -0.0, 7.0])) for _ in range(6000)] + [("d", None), ("e", 3.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    shares = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.99, 1.0]
    for by in (["g"], []):
        want = {tuple(x[c] for c in by): x.q for x in df.where("x is not null").groupBy(*by).agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).collect()}
        for most in (10**6, 40):  # at once, and in several rounds
            got = {tuple(x[c] for c in by): (x.n, x.q) for x in group_quantiles(df, by, "x", shares, most).collect()}
            assert {k: q for k, (_, q) in got.items()} == want and sum(n for n, _ in got.values()) == sum(x is not None for _, x in rows)
    held = sorted(x for g, x in rows if g == "a" and x is not None)
    targets = spark.createDataFrame([("a", k) for k in (0, 5, len(held) - 1, len(held))] + [("none", 0)], "g string, rank long")
    got = {x["rank"]: (x.value, x.below) for x in select_ranks(df, ["g"], "x", targets, 30).collect()}
    assert got == {k: (held[k], sum(v < held[k] for v in held)) for k in (0, 5, len(held) - 1)}
    assert group_quantiles(df.limit(0), ["g"], "x", [0.5]).count() == 0 and group_quantiles(df.where("g = 'd'"), [], "x", [0.5]).count() == 0
    same = spark.range(5000).select(F.lit(4.5).alias("x"))
    assert group_quantiles(same, [], "x", [0.1, 0.9], 10).first().q == [4.5, 4.5]


@pytest.mark.parametrize("name", ["quantile_bins", "levene", "dispersion", "descriptive_by_group", "winsorise_clip", "trim_central", "climate_terciles"])
def test_queries_through_selection(spark, sf_dir, monkeypatch, name):
    from sextant.operators import selection
    from sextant.plans import registry
    from tests.test_queries import compare

    monkeypatch.setattr(selection, "MOST", 300)
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


def test_medians_of_resamples_follow_their_law():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (3, 8, 51, 200):
        first, second = stats._median_ranks(n, 40_000, [1, n])
        plain = np.sort(rng.integers(n, size=(40_000, n)), axis=1)
        for got, want in ((first, plain[:, (n - 1) // 2]), (second, plain[:, n // 2])):
            assert abs(got.mean() - want.mean()) < 5 * want.std() / 200 and abs(got.std() - want.std()) < 0.03 * want.std() + 1e-9
        assert abs(np.corrcoef(first, second)[0, 1] - np.corrcoef(plain[:, (n - 1) // 2], plain[:, n // 2])[0, 1]) < 0.03


def test_interval_of_a_median_against_resampling(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    values = {"odd": np.round(rng.lognormal(size=1501), 2), "even": np.round(rng.lognormal(size=800), 1)}
    df = spark.createDataFrame([(g, float(v)) for g, x in values.items() for v in x] + [("two", 1.0), ("two", 4.0), ("two", None), (None, 2.0), (None, 3.0), (None, 5.0)], "g string, x double")
    for most in (None, 100):
        got = {r.g: r for r in stats.bootstrap(df, ["g"], "x", most=most).collect()}
        for g, x in values.items():
            draws = np.median(x[rng.integers(len(x), size=(5000, len(x)))], axis=1)
            lo, hi = np.percentile(draws, [2.5, 97.5])
            assert got[g].value == np.median(x) and abs(got[g].ci_low - lo) < 0.25 * (hi - lo) and abs(got[g].ci_high - hi) < 0.25 * (hi - lo) and got[g].n == len(x)
        assert (got["two"].value, got["two"].ci_low, got["two"].n) == (2.5, None, 2) and got[None].value == 3.0 and got[None].ci_low == 2.0


@pytest.mark.parametrize("width", [1 << 13, 40])
def test_ranks_among_earlier_rows(spark, monkeypatch, width):
    """One value, one day and one moment may hold most rows; ranges of positions are cut anywhere."""
    monkeypatch.setattr(windows, "LEAST_WIDTH", width)
    r = random.Random(9)
    values = [r.choice([7, 7, 7, r.randrange(1000)]) for _ in range(700)]
    rows = spark.createDataFrame([(i, day(0 if i < 500 else i), v) for i, v in enumerate(values)], "id long, d date, v long")
    out = windows.expanding_quantile_flag(rows.repartition(7), "d", "id", "v", 0.3, 10, "hit", "limit").orderBy("id").collect()
    import numpy as np

    assert all(x.limit is None and x.hit is None for x in out[:10])
    for x in out[10:]:
        want = float(np.quantile(values[: x.id], 0.3))
        assert abs(x.limit - want) < 1e-9 and x.hit == float(x.v >= x.limit)
    none = rows.limit(0)
    assert windows.expanding_quantile_flag(none, "d", "id", "v", 0.3, 10, "hit", "limit").count() == 0


def test_numbers_follow_the_order(spark):
    rows = [(i % 3, r) for i, r in enumerate(random.Random(2).sample(range(5000), 900))] + [(None, 1), (2, None)]
    got = windows.numbered(spark.createDataFrame(rows, "a int, b int").repartition(5), ["a", "b"], "n").orderBy("n").collect()
    none_first = lambda x: (x is not None, x or 0)
    assert [x.n for x in got] == list(range(902)) and [(x.a, x.b) for x in got] == sorted(rows, key=lambda x: tuple(map(none_first, x)))


# attributions


def conditional_mean(nodes, at, x, known):
    value, rows, split = nodes[at]
    if split is None:
        return value
    f, threshold, left, right = split
    if f in known:
        return conditional_mean(nodes, left if x[f] <= threshold else right, x, known)
    return sum(conditional_mean(nodes, c, x, known) * nodes[c][1] / rows for c in (left, right))


def random_tree(r, features, depth):
    nodes = {}

    def grow(rows, left):
        at = len(nodes)
        nodes[at] = None
        if left == 0 or rows < 4 or r.random() < 0.15:
            nodes[at] = (r.gauss(0, 3), rows, None)
        else:
            part = r.randrange(1, rows)
            split = (r.randrange(features), r.uniform(-1, 1))
            nodes[at] = (0.0, rows, (*split, grow(part, left - 1), grow(rows - part, left - 1)))
        return at

    grow(200, depth)
    return nodes


def test_attributions_against_all_subsets(spark):
    import itertools
    import math

    from sextant.operators import attribution as A

    r = random.Random(3)
    k = 4
    trees = [random_tree(r, k, d) for d in (0, 1, 3, 6, 6)]
    xs = [[r.uniform(-1.2, 1.2) for _ in range(k)] for _ in range(40)]
    found = [p for t in trees for p in A.paths_of_nodes(t, 0.5)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(xs)], "id int, " + ", ".join(f"`f {i}` double" for i in range(k)))
    got = {row.id: list(row)[k + 1 :] for row in A.attribute(df, [f"f {i}" for i in range(k)], found).collect()}
    for i, x in enumerate(xs):
        game = lambda known: sum(0.5 * conditional_mean(t, 0, x, known) for t in trees)
        for f in range(k):
            others = [g for g in range(k) if g != f]
            want = sum(math.factorial(n) * math.factorial(k - n - 1) / math.factorial(k) * (game({*s, f}) - game(set(s))) for n in range(k) for s in itertools.combinations(others, n))
            assert abs(got[i][f] - want) < 1e-9
        assert abs(sum(got[i]) + sum(p.mean() for p in found) - game(set(range(k)))) < 1e-9


def test_attributions_of_fitted_models_add_up(spark):
    from sextant.operators import attribution as A

    r = random.Random(4)
    rows = spark.createDataFrame([(r.random(), r.random(), r.random()) for _ in range(600)], "a double, b double, c double").withColumn("y", F.col("a") * 10 + (F.col("b") > 0.5).cast("double"))
    fitted = models.fit_trees(rows, "y", ["a", "b", "c"], trees=8, depth=4)
    for model in fitted.values():
        found = A.paths(model)
        out = A.attribute(models._vector(rows, ["a", "b", "c"]).transform(model.transform).drop("__features"), ["a", "b", "c"], found)
        gap = out.select(F.abs(F.col("a_a") + F.col("a_b") + F.col("a_c") + F.lit(sum(p.mean() for p in found)) - F.col("prediction")).alias("gap")).agg(F.max("gap")).first()[0]
        assert gap < 1e-9
        mean = {x.feature: x.mean_abs for x in A.mean_attributions(rows, ["a", "b", "c"], found).collect()}
        assert mean["a"] > 5 * mean["b"] > 5 * mean["c"]
    assert A.mean_attributions(rows.limit(0), ["a"], []).first().mean_abs is None


# fixed effects


@pytest.mark.parametrize("effects", [["f"], ["f", "g"], ["g", "f"]])
def test_absorbed_effects_against_columns_for_levels(spark, effects):
    import numpy as np

    from sextant.operators.effects import absorbed_ols

    r = np.random.default_rng(7)
    n = 900
    f, g = r.integers(0, 250, n), r.integers(0, 12, n)
    f[:300] = 3  # one level holds a third
    f[-1], g[-1] = 999, 5  # and one a single row
    x, z = r.normal(size=n) + 0.1 * g, r.normal(size=n)
    y = 2 * x - z + 0.3 * (f % 7) - 0.5 * g + r.normal(size=n) * (1 + np.abs(x))
    df = spark.createDataFrame([(float(a), float(b), float(c), int(d), f"level {e}") for a, b, c, d, e in zip(y, x, z, f, g)] + [(1.0, None, 1.0, 1, "a"), (1.0, 2.0, 1.0, None, "a")], "y double, x double, z double, f long, g string")
    df = df.withColumn("of_f", F.col("f") * 2.0)  # explained wholly by f
    xs = ["x", "z", "of_f"] if "f" in effects else ["x", "z"]
    got = absorbed_ols(df, "y", xs, effects)
    held = [np.eye(int(k.max()) + 1)[k] for k, name in ((f, "f"), (g, "g")) if name in effects]
    design = np.column_stack([x, z, *held])
    inv = np.linalg.pinv(design.T @ design)
    beta = inv @ design.T @ y
    e = y - design @ beta
    h = np.einsum("ij,jk,ik->i", design, inv, design)
    w = np.where(1 - h > 1e-9, e / np.maximum(1 - h, 1e-9), 0) ** 2
    se = np.sqrt(np.maximum(np.diag(inv @ (design.T * w) @ design @ inv), 0))
    # a complete row with a null x or level is left out
    assert got["n"] == n and got["rank"] == np.linalg.matrix_rank(design)
    for i in (0, 1):
        assert abs(got["beta"][i + 1] - beta[i]) < 1e-8 and abs(got["se"][i + 1] - se[i]) < 1e-8
    assert abs(got["ssr"] - e @ e) < 1e-6 and (len(xs) == 2 or got["beta"][3] == 0)


# entities


def test_terms_against_a_pattern_each():
    import re

    r = random.Random(11)
    alphabet = ["ab", "a", "b", "é", "_", "1", "the", "x"]
    for _ in range(300):
        text = lambda n: "".join(r.choice(alphabet) + r.choice(["", " ", " "]) for _ in range(n)).strip() or "a"
        page = text(60)
        terms = sorted({text(r.randrange(1, 4)) for _ in range(12)}, key=len, reverse=True)
        names = [f"n{i % 7}" for i in range(len(terms))]
        taken, first = [False] * len(page), {}
        for term, name in zip(terms, names):
            for m in re.finditer(f"(?<![0-9A-Za-z])(?={re.escape(term)}(?![0-9A-Za-z]))", page):
                a, b = m.start(), m.start() + len(term)
                if not any(taken[a:b]):
                    taken[a:b] = [True] * len(term)
                    first[name] = min(a, first.get(name, a))
                    break
        assert D.spot(page, D.TermTrie(terms), names, dict.fromkeys(names, "")) == sorted(first, key=first.get)


def test_many_terms_cost_a_page_no_more_than_few():
    import time

    r = random.Random(12)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randrange(3, 8))) for _ in range(3000)]
    pages = [" ".join(r.choice(words) for _ in range(2000)) for _ in range(40)]
    terms = sorted({f"{r.choice(words)} {r.choice(words)} zz{i}" for i in range(10_000)}, key=len, reverse=True)

    def seconds(some):
        trie, names = D.TermTrie(some), [""] * len(some)
        began = time.process_time()
        for p in pages:
            D.spot(p, trie, names, {"": ""})
        return time.process_time() - began

    seconds(terms[:10])
    assert min(seconds(terms) for _ in range(3)) < 3 * min(seconds(terms[:10]) for _ in range(3))


# as-of joins of hot groups


@pytest.mark.parametrize("by", [["k"], []])
def test_asof_with_a_key_that_holds_nine_tenths(spark, monkeypatch, by):
    monkeypatch.setattr(joins, "HOT_ROWS", 100)
    monkeypatch.setattr(joins, "CUTS", 8)
    r = random.Random(13)
    key = lambda: r.choice(["hot"] * 9 + ["a", None])
    moment = lambda: dt.datetime(2024, 1, 1 + r.choice([0, 0, 0, 0, 1, 5]), r.randrange(24), r.randrange(3))
    left = [(i, key(), moment()) for i in range(900)]
    right = [(key(), moment(), r.randrange(9)) for _ in range(500)] + [("hot", None, 1)]
    a = spark.createDataFrame(left, "id int, k string, at timestamp")
    b = spark.createDataFrame(right, "k string, of timestamp, v int")
    if not by:
        b = b.drop("k")
    got = {x.id: (x.matched_at, x.v) for x in joins.asof_before(a, b, "at", "of", ["v"], by).collect()}
    assert len(got) == len(left)
    for i, k, at in left:
        earlier = [(of, v) for kk, of, v in right if of and of < at and (not by or kk == k)]
        assert got[i] == max(earlier, default=(None, None))
    # the groups that are ordered at once stay below twice a cut's share
    stream = a.select(F.col("at").alias("t"), "k").where("k = 'hot'")
    edges = joins._hot_groups(stream, ["k"]).first().edges
    sizes = stream.groupBy(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e < joins._number(stream))).alias("cut")).count().agg(F.max("count")).first()[0]
    assert len(edges) == 7 and sizes < 2 * stream.count() / 8 + 30


# leaf-wise boosting


def plain_boost(codes, y, rounds, step, leaves, least, l2):
    """Predictions of best-first trees, one split after the other."""
    import numpy as np

    total = np.full(len(y), y.mean())
    for _ in range(rounds):
        g, groups = total - y, [np.arange(len(y))]

        def best(rows):
            found = (1e-9, None)
            score = lambda r: g[r].sum() ** 2 / (len(r) + l2)
            for f in range(codes.shape[1]):
                for b in range(codes[rows, f].max()):
                    left = codes[rows, f] <= b
                    if min(left.sum(), (~left).sum()) >= least:
                        gain = score(rows[left]) + score(rows[~left]) - score(rows)
                        if gain > found[0] + 1e-9:
                            found = (gain, (rows[left], rows[~left]))
            return found

        plans = [best(groups[0])]
        while len(groups) < leaves and max(p[0] for p in plans if p[1] is not None or p[0]) > 1e-9 and any(p[1] is not None for p in plans):
            i = max((i for i, p in enumerate(plans) if p[1] is not None), key=lambda i: plans[i][0])
            a, b = plans[i][1]
            groups[i : i + 1], plans[i : i + 1] = [a, b], [best(a), best(b)]
        for rows in groups:
            total[rows] -= step * g[rows].sum() / (len(rows) + l2)
    return total


def test_leaf_wise_boosting_against_numpy(spark, monkeypatch):
    import numpy as np

    from sextant.operators import attribution as A, boosting

    monkeypatch.setattr(boosting, "KEEP", 2)
    r = np.random.default_rng(15)
    x = np.column_stack([r.normal(size=500), r.integers(0, 4, 500), r.normal(size=500)])
    y = np.where(x[:, 0] > 0.3, 3.0, 0.0) + x[:, 1] ** 2 + r.normal(size=500)
    df = spark.createDataFrame([(i, *map(float, row), float(t)) for i, (row, t) in enumerate(zip(x, y))] + [(999, 0.0, 0.0, 0.0, None)], "id int, a double, `b c` double, d double, y double").repartition(3)
    features = ["a", "b c", "d"]
    model = boosting.boost(df, "y", features, rounds=5, step=0.3, leaves=7, least=8, l2=2.0, row_share=1.0, column_share=1.0)
    got = {row.id: row for row in A.attribute(model.predict(df), features, model.paths()).collect()}
    codes = np.column_stack([np.searchsorted(np.array(e), x[:, f], "left") for f, e in enumerate(model.edges)])
    want = plain_boost(codes, y, 5, 0.3, 7, 8, 2.0)
    assert max(abs(got[i].prediction - want[i]) for i in range(500)) < 1e-9
    assert all(len([s for s in t.split if s is None]) == 7 and min(n for s, n in zip(t.split, t.rows) if s is None) >= 8 for t in model.trees)
    mean = model.base + sum(p.mean() for p in model.paths())
    assert max(abs(mean + row["a_a"] + row["a_b c"] + row["a_d"] - row.prediction) for row in got.values()) < 1e-9
    part = boosting.boost(df, "y", features, rounds=3, leaves=4)
    assert all(350 < t.rows[0] < 450 for t in part.trees) and part.predict(df.limit(0)).count() == 0


def test_boosting_from_cells_equals_boosting_from_rows(spark, monkeypatch):
    """Trees grow from the sums of cells, with a job for many turns; beyond CELLS from the rows, to the same trees."""
    from sextant.operators import boosting

    rows = spark.range(3000).select(((F.col("id") * 7919) % 11).cast("double").alias("a"), ((F.col("id") * 31) % 7).cast("double").alias("b"), (F.sqrt((F.col("id") * 7919) % 11 + (F.col("id") * 31) % 7) + F.col("id") % 5).alias("y"))
    jobs = []
    sums = boosting._turn_sums
    monkeypatch.setattr(boosting, "_turn_sums", lambda held, cells, turns, share: (jobs.append((len(cells), len(turns))), sums(held, cells, turns, share))[1])
    fit = lambda: boosting.boost(rows, "y", ["a", "b"], rounds=5, leaves=5, column_share=1.0)
    whole = fit()
    assert jobs == [(77, 5)]
    monkeypatch.setattr(boosting, "SUMS", 200)
    assert fit().trees == whole.trees and jobs[1:] == [(77, 2), (77, 2), (77, 1)]
    monkeypatch.setattr(boosting, "CELLS", 76)
    plain = fit()
    assert len(jobs) == 4 and [(t.split, t.rows) for t in plain.trees] == [(t.split, t.rows) for t in whole.trees]
    assert [v for t in plain.trees for v in t.value] == pytest.approx([v for t in whole.trees for v in t.value], abs=1e-9)


def test_selection_counts_without_sorting_rows(spark, monkeypatch):
    """Rows are counted by a hash aggregate: edges that went through it would make each task sort its rows with 63 edges each."""
    from pyspark.sql import functions as F
    from sextant import scratch
    from sextant.operators.selection import group_quantiles

    plans = []
    write = scratch.write
    monkeypatch.setattr(scratch, "write", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df))[1])
    rows = spark.range(4000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 1013).cast("double").alias("v"))
    got = {r.g: r.q for r in group_quantiles(rows, ["g"], "v", [0.1, 0.5], most=50).collect()}
    want = {r.g: r.q for r in rows.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.1), F.lit(0.5))).alias("q")).collect()}
    assert got == want
    assert len(plans) > 4 and not any("SortAggregate" in p for p in plans)


def test_partial_ranks_are_centred(spark, monkeypatch):
    """Sums of products of raw ranks are too ill-conditioned for the pseudo-inverse beyond some 27 million rows."""
    held, gram = [], stats.gram
    monkeypatch.setattr(stats, "gram", lambda df, columns: (held.append(gram(df, columns)), held[-1])[1])
    rows = spark.range(2000).select((F.col("id") * 7 % 13).alias("x"), (F.col("id") * 5 % 17).alias("y"), (F.col("id") % 11).alias("z"))
    got = stats.partial_spearman(rows, "x", "y", ["z"])
    matrix, n = held[0]
    assert got["n"] == n == 2000
    assert abs(matrix[0, 1:]).max() < 1e-6 and abs(matrix[1:, 1:]).max() <= n / 4


def test_ranks_of_few_values_are_broadcast(spark):
    """The ranks of ten values must not deal 40 MB of rows to ten tasks."""
    rows = spark.range(5_000_000).select((F.col("id") % 10).alias("v"))
    ranked = windows.average_rank(rows, "v", "r")
    assert "SortMergeJoin" not in ranked._jdf.queryExecution().executedPlan().toString()
    assert ranked.agg(F.sum("r"), F.min("r"), F.max("r")).first()[:] == (5_000_000 * 5_000_001 / 2, 250_000.5, 4_750_000.5)


def test_replicates_are_drawn_once(spark):
    """Ordering the blocks in Spark sampled them first, which ran all draws twice."""
    from sextant.operators import studies

    ranked = windows.average_ranks(spark.range(600).select("id", (F.col("id") * 7 % 601).alias("y")), {"id": "__rx", "y": "__ry"}).select("__rx", "__ry").persist()
    ranked.count()
    jobs = lambda: len(spark.sparkContext.statusTracker().getJobIdsForGroup("replicates"))
    spark.sparkContext.setJobGroup("replicates", "")
    got = studies.rank_replicates(ranked, 600, 64)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(got) == 64 and jobs() <= 3


def test_events_and_deals_are_tables(spark):
    """Studies and models read their rows many times, so the joins behind them run once."""
    from sextant.plans import inference, study

    for make in (study.events, inference._deals):
        rows = make(spark, "/root/testdata/sf0.001")
        assert "Join" not in rows._jdf.queryExecution().optimizedPlan().toString() and rows.count() > 0


def test_leverages_of_many_levels_at_once(spark, monkeypatch):
    """Levels are worked on in batches, a call takes many of them, and no result depends on the batch."""
    from sextant.operators import effects

    rows = spark.range(900).select((F.col("id") % 120).alias("wide"), (F.col("id") * 7 % 11).alias("narrow"), (F.col("id") * 13 % 101).cast("double").alias("x"), (F.col("id") * 29 % 97).cast("double").alias("y"))
    whole = effects.absorbed_ols(rows, "y", ["x"], ["wide", "narrow"])
    monkeypatch.setattr(effects, "BATCH", 7)
    monkeypatch.setattr(effects, "CELLS", 100)
    cut = effects.absorbed_ols(rows, "y", ["x"], ["wide", "narrow"])
    assert cut["n"] == whole["n"] == 900 and cut["se"][1] == pytest.approx(whole["se"][1], rel=1e-9) and cut["beta"][1] == pytest.approx(whole["beta"][1], rel=1e-9)
