"""Order MinHash against a plain version, and the edits of a table."""

import hashlib
import os
import random
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of

from scanloom.llm import fingerprints
from scanloom.llm.fingerprints import OrderMinHash, likeness

SF = "/root/testdata/sf0.001"


def plain_signature(make, text):
    """Every k-mer hashed by itself, occurrences numbered from the left, smallest taken by sorting."""
    k = min(make.k, len(text))
    if not text:
        return [0] * len(make._salt)
    grams = [make._kmers(text[i : i + k])[0] for i in range(len(text) - k + 1)]
    h, kmer, place = make._numbered(np.array(grams, np.uint64))
    seen = Counter()
    for p in range(len(grams)):  # the n-th occurrence of a k-mer has a hash of its own
        seen[grams[p]] += 1
    assert sum(n - 1 for n in seen.values()) == len(h) - len({int(x) for x in kmer})
    out = []
    for a, b, salt in zip(make._a[:, 0].tolist(), make._b[:, 0].tolist(), make._salt.tolist()):
        ranked = sorted((((int(x) * a + b) & 0xFFFFFFFF), i) for i, x in enumerate(h))[: make.per_slot]
        value = np.uint64(salt)
        for i in sorted((i for _, i in ranked), key=lambda i: place[i]):
            value = fingerprints._mix(np.array([value * np.uint64(31) + kmer[i]]))[0]
        out.append(int(value) & 0xFFFF)
    return out


@pytest.mark.filterwarnings("ignore:overflow")
@pytest.mark.parametrize("text", ["a", "abcdefg", "abcdefgh", "abcabcabc" * 20, "日本語😀" * 9, "x" * 300, "The quick brown fox jumps over it. " * 4])
def test_signature(text, monkeypatch):
    make = OrderMinHash()
    want = plain_signature(make, text)
    assert make.signature(text).tolist() == want
    monkeypatch.setattr(fingerprints, "_COLUMNS", 7)
    assert make.signature(text).tolist() == want


def direct_signature(make, text):
    """No sorting by k-mer: a k-mer is its whole 64-bit hash, occurrences are counted from the left."""
    grams, seen, ranks = make._kmers(text), Counter(), []
    for g in grams.tolist():
        ranks.append((g + seen[g] * fingerprints._BASE) & fingerprints._MASK64)
        seen[g] += 1
    x = fingerprints._mix(np.array(ranks, np.uint64)) >> np.uint64(32)
    out = []
    for a, b, salt in zip(make._a[:, 0].tolist(), make._b[:, 0].tolist(), make._salt):
        under = [((v * a + b) & 0xFFFFFFFF, g, p) for p, (v, g) in enumerate(zip(x.tolist(), grams.tolist()))]
        value = np.array([salt])
        for p in sorted(p for _, _, p in sorted(under)[: make.per_slot]):
            value = fingerprints._mix(value * np.uint64(31) + grams[p : p + 1])
        out.append(int(value[0]) & 0xFFFF)
    return out


@pytest.mark.parametrize("n", [1031, 4103, 16391])
def test_a_few_characters_across_a_power_of_two(n):
    draw = random.Random(n)
    make, text = OrderMinHash(), "".join(draw.choices("abcdefghij ", k=n))
    longer = text + "".join(draw.choices("abcdefghij ", k=4))  # 1024 k-mers and 1028, and so on
    own, other = make.signature(text), make.signature(longer)
    assert own.tolist() == direct_signature(make, text) and other.tolist() == direct_signature(make, longer)
    assert likeness(own, other) > 0.9


def test_order_matters_and_likeness_follows_edits():
    draw = random.Random(2)
    make, text = OrderMinHash(slots=256), "".join(draw.choices("abcdefghij ", k=2000))
    swapped = text[1000:] + text[:1000]
    few, many = list(text), list(text)
    for p in draw.sample(range(2000), 5):
        few[p] = "#"
    for p in draw.sample(range(2000), 120):
        many[p] = "#"
    own = make.signature(text)
    near = [likeness(own, make.signature("".join(t))) for t in (text, few, many)]
    assert near[0] == 1.0 and near[0] > near[1] > near[2]
    assert near[1] > 0.7 and likeness(own, make.signature(swapped)) < 0.75  # the same k-mers, another order
    assert likeness(own, make.signature("".join(draw.choices("abcdefghij ", k=2000)))) < 0.05


def check(spark, docs):
    make = OrderMinHash()
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True)
    got = fingerprints.fingerprint_edits(docs).collect()
    by_id = {d: 0 for d, _ in rows}
    assert len(got) == len(rows)
    if len(by_id) < len(rows):  # the order among rows of one id is that of a hash
        return got
    found = {r.doc_id: r for r in got}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        new, r = t[: len(t) - half] + following[:half], found[d]
        own, edit, other = make.signature(t), make.signature(new), make.signature(following)
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprints.as_text(own), fingerprints.as_text(edit))
        assert (r.near_edited, r.near_next) == (likeness(own, edit), likeness(own, other))
    return got


@pytest.mark.parametrize("parts", ["1", "3", "64"])
def test_documents(spark, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        check(spark, spark.read.parquet(f"{SF}/documents.parquet"))
        check(spark, docs_of(spark, AWKWARD, [None, *range(100, 0, -9)]))
        assert fingerprints.fingerprint_edits(docs_of(spark, [])).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_one_row_and_repeated_ids(spark):
    (r,) = check(spark, docs_of(spark, ["only one text here"]))
    assert r.near_next == 1.0 and r.edited_sha256 == hashlib.sha256("only one only one ".encode()).hexdigest()
    got = check(spark, docs_of(spark, ["same"] * 3 + ["other", None, None], [1, 1, 1, 2, None, None]))
    assert Counter(r.doc_id for r in got) == {1: 3, 2: 1, None: 2}
    assert len({r.fingerprint for r in got if r.doc_id == 1}) == 1
