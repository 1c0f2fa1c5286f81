"""The rule ensemble: statistics, rules as columns, held-out accuracy."""

import os
import sys
import zlib

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of

from scanloom.llm import quality

SF = "/root/testdata/sf0.01"


def test_statistics():
    got = dict(zip(quality.STATS, quality.text_stats("Aa BB BB c1!\nx. x.")))
    assert got["n_words"] == 6 and got["longest_word"] == 3 and got["n_lines"] == 2 and got["distinct_lines"] == 1
    assert got["distinct_words"] == 4 / 6 and got["repeated_neighbours"] == 2 / 6 and got["capital_words"] == 2 / 6
    assert got["mark_share"] == 1 / 18 and got["digit_share"] == 1 / 18 and got["stops_per_word"] == 3 / 6
    shares = [got[s] for s in quality.STATS if s.endswith("_share")]
    assert abs(sum(shares) - 1) < 1e-12
    assert quality.text_stats("") == [0.0] * len(quality.STATS)
    assert all(np.isfinite(quality.text_stats(t or "")).all() for t in AWKWARD)


def test_rules_as_columns(spark):
    rules = [((("n_words", ">", 2.0),), 1.5), ((("n_words", "<=", 5.0), ("word_length", ">", 3.0)), -2.0)]
    model = quality.RuleModel(0.25, rules)
    rows = [(float(n), float(w)) for n in (1, 2, 3, 5, 6) for w in (3, 4)]
    for r in spark.createDataFrame(rows, "n_words double, word_length double").withColumn("score", model.score()).collect():
        total = 0.25 + 1.5 * (r.n_words > 2) - 2.0 * (r.n_words <= 5 and r.word_length > 3)
        assert abs(r.score - 1 / (1 + np.exp(-total))) < 1e-12


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    got = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got.values())
    held = [(r.quality, got[r.doc_id]) for r in labels.collect() if got[r.doc_id].held_out]
    assert sum(q == r.predicted for q, r in held) / len(held) > 0.97
    good, bad = ([r.score for q, r in held if q == k] for k in (1, 0))
    assert np.mean([g > b for g in good for b in bad]) > 0.99


def test_what_the_score_does_not_see(spark):
    """Other ids, languages and sources, and labels of held-out rows, leave scores alone."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").limit(300), spark.read.parquet(f"{SF}/labels.parquet")
    plain = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    other = docs.selectExpr("doc_id", "text", "'xx' as lang", "'s' as source")
    lies = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 3 = 1 then 1 - quality else quality end as quality")
    changed = {r.doc_id: r.score for r in quality.score_quality(other, lies).collect()}
    assert plain.keys() == changed.keys() and max(abs(plain[d] - changed[d]) for d in plain) < 1e-6


def test_awkward_and_empty(spark):
    docs = docs_of(spark, [*AWKWARD, "a", "a"], [None, *range(1, 13), 4, 4])
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (3, 7), (None, 1), (99, 0)], "doc_id long, quality int")
    got = quality.score_quality(docs, labels, held_out_of=None).collect()
    assert len(got) == 15 and all(0 <= r.score <= 1 for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.score_quality(docs_of(spark, []), labels).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.count() == 15 and kept.columns == docs.columns
