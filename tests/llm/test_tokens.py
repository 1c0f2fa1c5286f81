"""Packing and token counts against the tokenizer libraries."""

import os
import sys
import zlib
from collections import Counter

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of

from scanloom.llm import packing, token_counts
from scanloom.llm.tokens import ByteBpe, PieceCounter

BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"

reference_bpe = Tokenizer.from_file(BPE)
reference_pieces = SentencePieceProcessor(model_file=PIECES)
fast_bpe, fast_pieces = ByteBpe(BPE), PieceCounter(PIECES)

odd_text = st.lists(
    st.sampled_from([*"ab Z09.,'!\n\t\r\u00a0\u3000\x1c\u0085\u00df\u00e9\u65e5\U0001f600\u2581<|>_s\x00", "  ", " \n", "<|endoftext|>", "</s>", "'s", " word"]),
    max_size=30,
).map("".join)


def ids_of(text):
    return reference_bpe.encode(text, add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_fast_ids_are_those_of_the_library(text):
    raw = fast_bpe.ids(text)
    assert [int.from_bytes(raw[i : i + 4], "little") for i in range(0, len(raw), 4)] == ids_of(text)


@settings(max_examples=400, deadline=None)
@given(odd_text)
def test_fast_counts_are_those_of_the_library(text):
    assert fast_pieces.count(text) == len(reference_pieces.encode(text))


@pytest.mark.parametrize("n", [1, 2, 1023, 1024, 1025, 5000])
def test_piece_lengths(n):
    parts = packing.piece_lengths(n, 1024)
    assert sum(parts) == n and all(p & (p - 1) == 0 and p <= 1024 for p in parts) and parts == sorted(parts, reverse=True)


def check_packing(rows, texts):
    want = Counter()
    for doc, text in texts:
        want[doc, len(ids_of(text or "")) + 1] += 1
    got, sequences = Counter(), set()
    by_doc = {}
    for r in rows:
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 1024
        assert r.sequence_id not in sequences
        sequences.add(r.sequence_id)
        got[r.doc_id, r.doc_tokens] += r.length
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert got == Counter({k: k[1] * n for k, n in want.items()})
    assert sequences == set(range(len(rows)))
    lengths = [r.length for r in sorted(rows, key=lambda r: r.sequence_id)]
    assert lengths == sorted(lengths, reverse=True)
    return by_doc


def test_pack_awkward(spark):
    texts = list(enumerate(AWKWARD)) + [(None, "no id"), (4, "again four")]
    rows = packing.pack(docs_of(spark, [t for _, t in texts], [i for i, _ in texts]), BPE, with_ids=True).collect()
    by_doc = check_packing(rows, texts)
    for doc, text in texts:
        ids = ids_of(text or "") + [0]
        parts = sorted(by_doc[doc, len(ids)], key=lambda r: r.start)
        assert [i for r in parts for i in r.ids] == ids
        for r in parts:
            raw = b"".join(i.to_bytes(4, "little") for i in ids[r.start : r.start + r.length])
            assert r.ids_crc32 == zlib.crc32(raw)


def test_pack_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_packing(packing.pack(docs, BPE).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_pack_empty_and_bad_length(spark):
    assert packing.pack(docs_of(spark, []), BPE).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs_of(spark, []), BPE, longest=1000)


def test_counts_and_cache(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    texts = [*AWKWARD, "unique to the first call"]
    docs = docs_of(spark, texts, [None, *range(1, len(texts))])
    rows = token_counts.count_tokens(docs, cache, PIECES, limit=4).collect()
    want = Counter()
    for i, t in zip([None, *range(1, len(texts))], texts):
        n = len(reference_pieces.encode(t or ""))
        want[i, len((t or "").encode()), n, n > 4] += 1
    assert Counter(tuple(r) for r in rows) == want
    stored = spark.read.parquet(cache)
    assert stored.count() == len({t or "" for t in texts})  # distinct texts only
    # A second call encodes what is new and nothing else.
    more = docs_of(spark, [*AWKWARD, "new one", "new one"])
    assert token_counts.count_tokens(more, cache, PIECES).count() == len(AWKWARD) + 2
    assert spark.read.parquet(cache).count() == stored.count() + 1
    # Counts of another vocabulary are not used.
    version = token_counts.tokenizer_version(PIECES)
    assert token_counts.read_cache(spark, cache, "other").count() == 0
    assert token_counts.read_cache(spark, cache, version).count() == stored.count() + 1


def test_stored_counts_are_used(spark, tmp_path):
    cache = f"file://{tmp_path}/cache"
    docs = docs_of(spark, ["some text"])
    token_counts.count_tokens(docs, cache, PIECES).collect()
    stored = spark.read.parquet(cache).selectExpr("digest", "cast(99 as bigint) as n_tokens", "version").collect()
    spark.createDataFrame(stored, token_counts.CACHE_SCHEMA).write.mode("overwrite").parquet(cache + "2")
    assert token_counts.count_tokens(docs, cache + "2", PIECES).first().n_tokens == 99


def test_count_empty(spark, tmp_path):
    assert token_counts.count_tokens(docs_of(spark, []), f"file://{tmp_path}/c", PIECES).count() == 0
