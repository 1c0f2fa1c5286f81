"""The scheduled mix against a plain version."""

import hashlib
import os
import sys
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, WORD, docs_of

from scanloom.llm import mixing

SF = "/root/testdata/sf0.01"


def plain_targets(sizes, weights=(3, 1, 2), share=1.5, passes=2):
    """Sources in order, their targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    full, total = set(), sum(sizes.values())
    while True:
        free = [s for s in order if s not in full]
        left = share * total - sum(passes * sizes[s] for s in full)
        rate = left / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if weight[s] * rate > passes * sizes[s]}
        if not above:
            return {s: passes * sizes[s] if s in full else weight[s] * rate for s in order}
        full |= above


def plain_taken(rows):
    """(doc_id, source, text) rows -> multiset of (doc_id, size, target, taken)."""
    sources = defaultdict(list)
    for doc, source, text in rows:
        text = text or ""
        key = ":".join(["mix-1", *([] if doc is None else [str(doc)]), hashlib.md5(text.encode()).hexdigest()])
        sources[source].append((hashlib.md5(key.encode()).hexdigest(), doc, len(WORD.findall(text))))
    targets = plain_targets({s: sum(d[2] for d in docs) for s, docs in sources.items()})
    out = Counter()
    for source, docs in sources.items():
        want, taken = int(targets[source] + 0.5), Counter()
        passes = [sorted(range(len(docs)), key=lambda i: docs[i][0])]
        passes.append(sorted(range(len(docs)), key=lambda i: hashlib.md5(f"{docs[i][0]}:1".encode()).hexdigest()))
        for order in passes:
            for i in order:
                took = min(docs[i][2], want)
                taken[i] += took
                want -= took
        for i, (_, doc, size) in enumerate(docs):
            out[doc, size, round(targets[source], 6), taken[i]] += 1
    return out


def check(docs):
    got = mixing.taken_words(docs).collect()
    want = plain_taken([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert Counter((r.doc_id, r["size"], round(r.target, 6), r.taken) for r in got) == want
    return got


def test_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = check(docs)
    assert all(r.taken <= 2 * r["size"] for r in got)
    taken = Counter()
    for r in got:
        taken[r.source] += r.taken
    assert all(abs(taken[r.source] - r.target) <= 0.5 for r in got)
    again = mixing.taken_words(docs.repartition(7)).collect()  # reruns agree, however the rows lie
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_awkward(spark):
    texts = [*AWKWARD, AWKWARD[4], AWKWARD[4]]
    check(docs_of(spark, texts, [None, None, *range(2, 13), 4, 4]))
    check(docs_of(spark, ["one"]))
    check(docs_of(spark, ["one two three"] * 40, [None] * 40))
    assert [r.taken for r in check(docs_of(spark, ["", None]))] == [0, 0]


def test_empty(spark):
    assert mixing.taken_words(docs_of(spark, [])).count() == 0
    assert mixing.mix_sources(docs_of(spark, [])).count() == 0


def test_sources_have_equal_blocks_at_low_discrepancy(spark):
    """Blocks are full but for the last of a source, and every stretch of the mix holds the sources in proportion."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = mixing.mix_sources(docs, block=64).collect()
    slots, filled = {}, Counter()
    for p in pieces:
        assert slots.setdefault(p.slot, p.source) == p.source
        filled[p.slot] += p.length
    short = Counter(slots[s] for s, n in filled.items() if n != 64)
    assert all(n <= 64 for n in filled.values()) and all(n == 1 for n in short.values())
    per_source = Counter(slots.values())
    for stretch in (100, 1000, 5000):
        seen = Counter(slots[s] for s in sorted(slots)[:stretch])
        for source, n in per_source.items():
            assert abs(seen[source] - stretch * n / len(slots)) <= 8
    for p in pieces[:200]:  # offsets tile a block
        inside = sorted((q.offset, q.length) for q in pieces if q.slot == p.slot)
        assert inside[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(inside, inside[1:]))


@pytest.mark.parametrize("n", [1, 7, 200])
def test_targets_with_many_sources(spark, n):
    sizes = {(None if i == 3 else f"s{i}é"): (i * 7919) % 977 for i in range(n)}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = plain_targets(sizes)
    for r in mixing.targets(df).collect():
        assert r.target == pytest.approx(want[r.source])


def test_one_source_with_most_rows(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 7)).alias("source"),
        F.repeat(F.lit("w "), (F.col("id") % 13).cast("int")).alias("text"),
    )
    check(docs)
