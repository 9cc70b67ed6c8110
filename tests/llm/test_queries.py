"""Registered queries and the pipeline at the smallest scale."""

import pytest

from compare import assert_same, connect
from gatewright.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    assert_same(spark, connect(SF), name, queries.queries()[name], queries.oracle_sql()[name], SF)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        docs = out
    kept = docs.count()
    assert 0.5 * n < kept < n
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() > 0


def test_pipeline_against_brute_force(spark, tmp_path):
    """Every stage on what its predecessor kept, against SQL or plain loops over the same rows."""
    import re

    import duckdb

    from gatewright.llm import language_id, mixing, oracles, pii

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, inputs = spark.read.parquet(f"{SF}/documents.parquet"), []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        inputs.append(docs)
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
    inputs.append(docs)
    ids = [[r.doc_id for r in x.select("doc_id").orderBy("doc_id").collect()] for x in inputs]

    def sql(k, name):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/{k - 1}/*.parquet')")
        con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SF}/benchmark.parquet')")
        return con.execute(oracles.ORACLES[name]).fetch_df()

    model = language_id.train(inputs[0])
    score = {r.doc_id: r for r in language_id.predict(inputs[0], model).collect()}
    grams = lambda t: language_id.classify(__import__("pyarrow").array([t]), model)[2][0]
    assert ids[1] == [i for i in ids[0] if score[i].lang_pred != "und" and (score[i].lang_score >= language_id.REJECT or grams(score[i].text) < language_id.SHORT)]
    groups = sql(1, "op6_jaccard_join")
    assert ids[2] == sorted(groups.doc_id[groups.doc_id == groups.component_id]) and len(ids[2]) < len(ids[1])
    hits = sql(2, "op9_decontaminate")
    assert ids[3] == sorted(hits.doc_id[~hits.contaminated]) and len(ids[3]) < len(ids[2])
    before = {r.doc_id: r.text for r in inputs[3].collect()}
    after = {r.doc_id: r for r in inputs[4].collect()}
    assert ids[4] == ids[3]
    for i, text in before.items():
        out, at = [], 0
        for lo, hi, kind in pii.base_spans(text or ""):
            if lo >= at:
                out += [text[at:lo], f"<{kind}>"]
            at = max(at, hi)
        plain = None if text is None else "".join(out) + text[at:]
        assert after[i].text == plain or re.sub("<[a-z]+>", "", after[i].text) != after[i].text  # further repeats may be replaced too
        assert text is None or after[i].n_chars == len(after[i].text)
    told = [r for r in mixing.margins(inputs[4]).collect() if r.planned is not None]
    total = sum(r.tokens for r in inputs[5].collect())
    for col, name in (("lang", "language"), ("topic_group", "topic"), ("source", "source")):
        real = {r[0]: r[1] / total for r in inputs[5].groupBy(col).agg({"tokens": "sum"}).collect()}
        for r in told:
            if r.dimension == name and r.realised > 0:
                assert real[r.value] == pytest.approx(r.realised, abs=1e-9)
