import os
from collections import defaultdict

import pytest

import __spark_entry__
import corpus_pipeline
from cloudgrid.llm import jaccard_join, langid, queries, toxicity
from cloudgrid.llm.words import held_out

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    lang = langid.identify(docs, langid.fit(docs.where(~held_out("doc_id")))).collect()
    known = {r.doc_id for r in lang if r.lang_pred != "und" and r.score >= 0.3}
    left = docs.where(docs.doc_id.isin(sorted(known)))
    model = toxicity.fit(left, labels.where(~held_out("doc_id")))
    clean = {r.doc_id for r in toxicity.score(left, model).collect() if not r.predicted}
    left = docs.where(docs.doc_id.isin(sorted(clean)))
    kept = {r.doc_id for r in jaccard_join.join(left).collect() if r.doc_id == r.component_id}
    pieces = defaultdict(list)
    for r in corpus_pipeline.run(spark, DATA).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == kept and 0 < len(kept) < len(texts)
    assert all(sum(r.length for r in p) == p[0].doc_tokens for p in pieces.values())


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_ten_operators_are_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES) and "pipeline" in __spark_entry__.queries()


def test_stages_on_odd_rows(spark):
    rows = [(k, t, "en" if k % 2 else None, "s", None, f"x{k}") for k, t in enumerate(["the cat sat on the mat by the sea", None, "", "the cat sat on the mat by the sea", "12 34", "x " * 30_000])]
    rows += [(None, "the cat sat on a mat by the sea", None, None, 1, None), (0, rows[0][1], "en", None, None, "again")]
    odd = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DATA)
            assert docs.columns == odd.columns
        kept = [(r.doc_id, r._text) for r in docs.collect()]
        assert sum(r.length for r in corpus_pipeline.STAGES[-1][1](spark, docs, DATA).collect()) >= len(kept)
    assert kept == []


def test_odd_rows_that_stay(spark):
    rows = [(k, t, "en", "x") for k, t in enumerate(["the cat sat on the mat by the sea", None, "the cat sat on the mat by the sea", "7 8"])] + [(None, "a b c d e", None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, _text string")
    left = corpus_pipeline.near_duplicates(spark, corpus_pipeline.language_id(spark, docs, DATA), DATA)
    assert sorted(map(str, left.select("doc_id", "_text").collect())) == ["Row(doc_id=0, _text='x')", "Row(doc_id=None, _text=None)"]
