"""Lattice likelihood against enumerated segmentations; the base against plain counts."""

import math
import os
import sys
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of, words

from scanloom.llm import language_model, lattice

PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return lattice.Vocabulary(PIECES)


def segmentations(vocabulary, ids, word):
    """All ways to spell a word: lists of piece ids."""
    if not word:
        yield []
        return
    for k in range(1, min(len(word), vocabulary.longest) + 1):
        head = word[:k]
        if head in ids:
            first = [ids[head]]
        elif k == 1:
            first = [int(vocabulary.bytes[b]) for b in head.encode()]
        else:
            continue
        for rest in segmentations(vocabulary, ids, word[k:]):
            yield first + rest


def test_likelihood_and_expectations(vocabulary):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=PIECES)
    known = [(model.id_to_piece(i), i) for i in range(vocabulary.size) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    ids = {p: i for p, i in known if len(p) == 1 or p.strip(lattice.MARK)}
    some, times = ["the", "thation", "a", "日\U0001f600x", "überall", "x" * 9, "▁"], np.array([3.0, 2.0, 5.0, 1.0, 2.0, 1.0, 1.0])
    logp = np.log(np.random.default_rng(0).dirichlet(np.ones(vocabulary.size + 1)) + 1e-12)
    got = lattice.log_likelihood(vocabulary, logp, some)
    counts = np.zeros(vocabulary.size + 1)
    for w, t, g in zip(some, times, got):
        paths = [(math.exp(sum(logp[i] for i in p)), p) for p in segmentations(vocabulary, ids, lattice.MARK + w)]
        total = sum(x for x, _ in paths)
        assert g == pytest.approx(math.log(total), rel=1e-9)
        for x, p in paths:
            for i in p:
                counts[i] += t * x / total
    assert lattice.expected_counts(vocabulary, logp, some, times) == pytest.approx(counts, abs=1e-9)


def test_batches_do_not_matter(vocabulary, monkeypatch):
    some = [w for t in AWKWARD for w in words(t)][:300]
    logp = np.log(vocabulary.prior + 1e-12)
    whole = lattice.log_likelihood(vocabulary, logp, some)
    monkeypatch.setattr(lattice, "_CHARS", 50)
    assert lattice.log_likelihood(vocabulary, logp, some) == pytest.approx(whole)


def check(spark, docs, rounds=1):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    counts, ends = Counter(), 0
    held = lambda d: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2
    for d, t in rows:
        if not held(d):
            counts.update(words(t))
            ends += 1
    train, distinct = sum(counts.values()) + ends, len(counts) + (ends > 0)
    of = lambda w: ends if w is None else counts[w]
    want = []
    for d, t in rows:
        tokens = [*words(t), None]
        base = sum(math.log10((of(w) + 1) / (train + distinct + 1)) for w in tokens)
        want.append((str(d), held(d), len(tokens), sum(of(w) > 0 for w in tokens), train, round(base, 6)))
    got = language_model.score_texts(docs, PIECES, rounds=rounds).collect()
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == sorted(want)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    return got


@pytest.mark.parametrize("frequent", [1 << 19, 20])
def test_documents(spark, vocabulary, monkeypatch, frequent):
    monkeypatch.setattr(language_model, "FREQUENT", frequent)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(spark, docs)
    # The score is the sum over words and the end, with the pieces learnt from all training words.
    rows = {r.doc_id: r.text for r in docs.collect()}
    counts = Counter(w for d, t in rows.items() if zlib.crc32(str(d).encode()) % 7 != 2 for w in words(t))
    p = vocabulary.prior * vocabulary.size + lattice.expected_counts(
        vocabulary, np.log(np.maximum(vocabulary.prior, 1e-300)), list(counts), np.array(list(counts.values()), float)
    )
    p[vocabulary.size] += sum(zlib.crc32(str(d).encode()) % 7 != 2 for d in rows)
    logp = np.log(np.maximum(p / p.sum(), 1e-300))
    for r in got[:40]:
        own = words(rows[r.doc_id])
        want = (lattice.log_likelihood(vocabulary, logp, own).sum() + logp[-1]) / math.log(10) if own else logp[-1] / math.log(10)
        assert r.score == pytest.approx(want, rel=1e-9)


def test_learning_helps_held_out_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mean = lambda rounds: sum(r.score for r in language_model.score_texts(docs, PIECES, rounds=rounds).collect() if r.held_out)
    assert mean(2) > mean(1) > mean(0)


def test_awkward(spark):
    texts = [*AWKWARD, "again", "again"]
    check(spark, docs_of(spark, texts, [None, *range(1, 13), 4, 4]))


def test_no_training_rows_and_empty(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    check(spark, docs_of(spark, ["held out only"], [held]))
    assert language_model.score_texts(docs_of(spark, []), PIECES).count() == 0
