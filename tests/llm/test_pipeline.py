"""The pipeline keeps what it should, stage by stage."""

import corpus_pipeline
from sextant.llm.common import materialise, table
from sextant.llm.packing import cuts


def test_pipeline(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    before, sizes = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
        assert docs.columns == before.columns, name
        sizes.append(docs.count())
    assert sizes[0] >= sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0.5 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    per = packed.groupBy("doc_id", "doc_tokens").count().collect()
    assert len(per) == sizes[4] and all(r["count"] == len(list(cuts(r.doc_tokens, 1024))) for r in per)
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    first = materialise(corpus_pipeline.STAGES[0][1](spark, before, sf_dir))
    left = {r.doc_id for r in first.collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in left for d in good) >= 0.97 * len(good)


def test_stages_on_odd_tables(spark, sf_dir):
    """Nulls in every column, empty and repeated rows, an empty table, columns with the operators' own names."""
    kind = table(spark, sf_dir, "documents").schema.simpleString()[len("struct<") : -1].replace(":", " ").replace(",", ", ")
    names = [c.split()[0] for c in kind.split(", ")]
    row = lambda i, t, lang="en": tuple({"doc_id": i, "text": t, "lang": lang, "n_chars": len(t) if t is not None else None}.get(n) for n in names)
    words = " ".join(f"word{k}" for k in range(60))
    rows = [row(1, words), row(1, words), row(2, None), row(3, ""), row(None, "some other text"), row(4, "x", None), (None,) * len(names), row(5, words + " more")]
    odd = spark.createDataFrame(rows, kind)
    for c in ("key", "line", "cid", "rid", "component", "row", "norm"):
        odd = odd.withColumn(c, odd["doc_id"])
    for docs in (odd, odd.limit(0)):
        docs = materialise(docs)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = materialise(stage(spark, docs, sf_dir))
            assert out.columns == docs.columns, name
            docs = out
        left = [(r.doc_id, r.text) for r in docs.collect()]
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
        assert packed.select("doc_id").distinct().count() == len({i for i, _ in left})
        assert not left or {1, 4} <= {i for i, _ in left} and 5 not in {i for i, _ in left} and len(left) < len(rows)
