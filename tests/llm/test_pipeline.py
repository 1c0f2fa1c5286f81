"""The pipeline and the registered queries."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import __spark_entry__ as contract
import corpus_pipeline
from check_oracle import compare, connect
from helpers import AWKWARD, docs_of

from scanloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_all_operators_and_the_pipeline_are_registered():
    assert sorted(int(q.split("_")[0][2:]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_duckdb(spark, name):
    ok, text = compare(spark, connect(SF), name, SF)
    assert ok, text


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for name, fn in corpus_pipeline.STAGES:
        after = fn(spark, before, SF)
        if name != "packing":
            assert after.columns == COLUMNS and after.schema.jsonValue()["fields"][0]["type"] == "long"
            lost = before.join(after, "doc_id", "left_anti").count()
            assert after.count() == before.count() - lost and after.count() > 0.7 * before.count()
            after = spark.createDataFrame(after.toPandas(), docs.schema)
        before = after
    pieces = before.count()  # before another run drops the tables of this one
    assert pieces > 0 and contract.queries()["pipeline"](spark, SF).count() == pieces


def test_quality_rejects_what_labels_reject(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, SF).collect()}
    marks = [(r.doc_id, r.quality) for r in labels.collect()]
    assert sum((d in kept) == (q == 1) for d, q in marks) / len(marks) > 0.95


def test_copies_keep_the_smallest_id(spark):
    long = " ".join(f"word{i}" for i in range(300))
    docs = docs_of(spark, [long, long.replace("word77 ", "other "), long, "another text", None, "", long], [9, 3, 5, 1, 2, 4, 9])
    kept = corpus_pipeline.one_of_each_group(spark, docs, SF)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]


def test_repeats_and_leaks(spark):
    passage = " ".join(f"repeated{i}" for i in range(60))
    docs = docs_of(spark, [f"first {passage} end", f"second {passage} tail", passage, None, "clean", "", passage], [4, 7, 8, 9, 10, None, 4])
    got = {r.doc_id: r for r in corpus_pipeline.without_repeats(spark, docs, SF).collect() if r.text != passage}
    assert set(got) == {4, 7, 9, 10, None} and got[4].text == f"first {passage} end" and got[10].text == "clean"
    assert got[7].text == "secondtail" or got[7].text.startswith("second") and len(got[7].text) < 14
    assert got[7].n_chars == len(got[7].text) and got[9].text is None
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first().text
    docs = docs_of(spark, [*AWKWARD, f"before it {item} after it"])
    kept = corpus_pipeline.without_leaks(spark, docs, SF)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(AWKWARD)))


@pytest.mark.parametrize("texts", [[], AWKWARD])
def test_all_stages_take_awkward_tables(spark, texts):
    for name, fn in corpus_pipeline.STAGES:
        docs = docs_of(spark, texts, [None, 1, 1, *range(3, len(texts))] if texts else None)
        got = fn(spark, docs, SF)
        assert got.count() >= bool(texts) and (name == "packing" or got.columns == docs.columns)


def test_pipelines_over_two_inputs_keep_their_tables(spark):
    """A stage over one folder leaves the tables of another folder's pipeline alone."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = corpus_pipeline.without_leaks(spark, docs, SF)
    corpus_pipeline.without_leaks(spark, docs, "/root/testdata/sf0.01").count()
    assert 0 < first.count() <= docs.count()
