import math

import pytest
from pyspark.sql import functions as F

from sextant.functions import columns as C, dist, text as T


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()[0]


@pytest.mark.parametrize("text, want", [("It's 2024, q3 was GOOD.", ["it", "s", "q3", "was", "good"]), ("", []), (" \n ", []), ("Éa-b_c 12", ["éa", "b_c"]), ("don't stop", ["don", "t", "stop"])])
def test_tokens(spark, text, want):
    assert one(spark, T.tokens(F.col("x")), text) == want


@pytest.mark.parametrize("word, n", [("the", 1), ("table", 1), ("company", 3), ("make", 1), ("rhythm", 1), ("idea", 2)])
def test_syllables(spark, word, n):
    assert one(spark, T.syllables(F.col("x")), word) == n


@pytest.mark.parametrize("name, key", [("Goldman Sachs & Co. LLC", "goldman sachs"), ("J.P. Morgan Securities LLC", "j p morgan"), (None, ""), ("Futu Securities (HK) Ltd", "futu")])
def test_company_key(spark, name, key):
    assert one(spark, T.company_key(F.col("x")), name) == key


@pytest.mark.parametrize("text, shares", [
    ("PRELIMINARY PROSPECTUS 8,250,000 Shares Common Stock", 8250000.0),
    ("Prospectus. None here. " + "x" * 300 + " 9,000,000 shares", None),
    ("SUBJECT TO COMPLETION 1,000,000 American Depositary Shares", 1000000.0),
    ("prospectus nothing " + "y" * 250 + " prospectus 500,000 units", 500000.0), (None, None), ("8,250,000 shares", None),
])
def test_filed_shares(spark, text, shares):
    assert one(spark, T.filed_shares(F.col("x")), text) == shares


def test_cover_without_counsel(spark):
    text = "Name Copies to: Someone, Esq. Approximate date of commencement of sale " + "Copies to: Another " + "z" * 10
    assert one(spark, T.cover(F.col("x")), text) == "Name  Approximate date of commencement of sale  "


def test_numbers_and_flags(spark):
    df = spark.createDataFrame([("$1,234.5",), ("12 %",), ("",), ("n/a",), (None,)], "x string")
    assert [r[0] for r in df.select(C.number(F.col("x"))).collect()] == [1234.5, 12.0, None, None, None]
    f = spark.createDataFrame([(9.0,), (1.0,), (None,)], "x double").select(C.flag(F.col("x"), F.col("x") >= 8), C.log_floor(F.col("x"))).collect()
    assert [r[0] for r in f] == [1.0, 0.0, None] and f[2][1] is None
    assert spark.createDataFrame([(float("nan"),)], "x double").select(C.finite(F.col("x"))).first()[0] is None


def test_rename_synonyms(spark):
    df = spark.createDataFrame([(None, "b"), ("a", None)], "Symbol string, Ticker string")
    assert sorted(r.ticker for r in C.rename_synonyms(df, {"Symbol": "ticker", "Ticker": "ticker"}).collect()) == ["a", "b"]


def test_tail_probabilities():
    assert dist.chi2_upper(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert dist.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.f_upper(4.102821015134163, 2, 10) == pytest.approx(0.05, abs=1e-9)
    assert dist.normal_two_sided(1.959963984540054) == pytest.approx(0.05, abs=1e-9)
    assert dist.correlation_p(-0.1118, 666) == pytest.approx(0.00388, abs=2e-5)
    assert dist.chi2_upper(7.142, 7) == pytest.approx(0.414, abs=5e-4)
    assert math.isclose(dist.f_upper(2.387, 2, 706), 0.0926, abs_tol=2e-4)
