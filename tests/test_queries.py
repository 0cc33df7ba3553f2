"""Every query with SQL gives the rows that DuckDB gives."""

import math

import duckdb
import pytest

from sextant.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows):
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)):
            return "null"
        return f"{float(x):.4f}" if isinstance(x, float) or hasattr(x, "as_tuple") else str(x)

    return sorted(tuple(map(cell, r)) for r in rows)


def compare(spark, sf_dir, query, sql):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    got = query(spark, sf_dir)
    names = sorted(got.columns)
    want = con.execute(sql)
    columns = [d[0] for d in want.description]
    assert sorted(columns) == names
    order = [columns.index(n) for n in names]
    assert canonical(tuple(r[n] for n in names) for r in got.collect()) == canonical(tuple(r[i] for i in order) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    compare(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL) - {"ridge_cv", "holdout", "tree_importance", "model_ranges", "hypothesis_summary", "robustness_table", "boosted_leafwise"}))
def test_without_sql(spark, sf_dir, name):
    out = registry.QUERIES[name](spark, sf_dir)
    assert out.count() > 0


def test_share_counts_are_read_from_whole_texts(spark, sf_dir, monkeypatch):
    from pyspark.sql import functions as F

    from sextant.plans import texts

    monkeypatch.setattr(texts.T, "filed_shares", F.char_length)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.char_length("text").alias("n"))
    both = texts.share_count_extract(spark, sf_dir).join(docs, "doc_id").where("n > 300")
    assert both.count() > 0 and both.where("shares < n").count() == 0


def test_boosted_leafwise_grows_all_trees(spark, sf_dir, monkeypatch):
    from sextant.plans import inference

    fitted = []
    boost = inference.boosting.boost
    monkeypatch.setattr(inference.boosting, "boost", lambda *a, **k: (fitted.append(boost(*a, **k)), fitted[-1])[1])
    assert inference.boosted_leafwise(spark, sf_dir).first().n > 0
    assert len(fitted[0].trees) == 200 and max(sum(s is None for s in t.split) for t in fitted[0].trees) == 31
