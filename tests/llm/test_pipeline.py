import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from statweave.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [sum(q.startswith(f"op{n}_") for q in QUERIES) for n in range(1, 11)] == [1] * 10
    assert set(SQL) <= set(QUERIES) <= set(entry.queries()) and "pipeline" in entry.queries()


def test_stages(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame([(-5, "mail me at a.b@c.org now", "en", "x", 24), (-4, None, None, None, None), (-4, None, None, None, None), (None, "no id", "en", "x", 5), (-3, "", "en", "x", 0)], docs.schema)
    docs = docs.unionByName(extra).unionByName(docs.filter("doc_id < 3"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        sizes.append(docs.count())
        if name == "near duplicates":
            rows = docs.collect()
            assert len({r.text for r in rows if r.text}) == len([r for r in rows if r.text])
        if name == "decontamination":
            assert not any(b in (r.text or "") for r in docs.collect() for b in bench)
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 0.6 * len(texts)
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows[-5].text == "mail me at [EMAIL] now" and rows[-5].n_chars == 22 and rows[-4].text is None
    assert not any(re.search(r"[a-z]@[a-z0-9]+\.[a-z]", r.text or "") for r in rows.values())
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF).toPandas()
    assert out.groupby("doc_id", dropna=False).length.sum().sum() == out[out.start == 0].doc_tokens.sum()
    assert set(out.doc_id.dropna()) == {k for k in rows if k is not None}


def test_stages_on_no_rows(spark):
    pytest.importorskip("public_tokenizers")
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
