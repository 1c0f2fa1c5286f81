"""Interleaved shards against a plain version."""

import hashlib
import os
import sys
import zlib
from collections import Counter, defaultdict

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of

from scanloom.llm import sharding

SF = "/root/testdata/sf0.01"


def plain(rows, shards):
    """doc_id, source, size, checksum -> (shard, slot), by sorting in one place."""
    groups = defaultdict(list)
    for doc, source, size, crc in rows:
        seed = sharding.SEED if doc is None else f"{sharding.SEED}:{doc}"
        h = hashlib.md5(seed.encode()).hexdigest()
        groups[source].append((h, doc is not None, doc or 0, crc, size))
    order = []
    for source, members in groups.items():
        for rank, m in enumerate(sorted(members)):
            order.append(((rank + 0.5) / len(members), source is not None, source or "", *m))
    order.sort()
    out, used = Counter(), Counter()
    for place, (*_, h, known, doc, crc, size) in enumerate(order):
        shard = place * shards // len(order)
        out[doc if known else None, size, crc, shard, used[shard]] += 1
        used[shard] += 1
    return out


def compare(spark, docs, shards):
    got = sharding.interleave(docs, shards).collect()
    rows = [(r.doc_id, r.source, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.collect()]
    assert Counter((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == plain(rows, shards)
    sizes = Counter(r.shard for r in got)
    assert not sizes or max(sizes[s] for s in range(shards)) - min(sizes[s] for s in range(shards)) <= 1
    assert all(r.law == "rows" and r.grown_shard is None for r in got)
    return got


def test_documents(spark):
    got = compare(spark, spark.read.parquet(f"{SF}/documents.parquet"), 16)
    total, each = Counter(r.source for r in got), Counter((r.shard, r.source) for r in got)
    for (_, source), n in each.items():  # every shard holds the mixture
        assert abs(n - total[source] / 16) <= 1.01


def test_awkward(spark):
    texts = [*AWKWARD, AWKWARD[4], AWKWARD[4]]
    compare(spark, docs_of(spark, texts, [None, None, *range(2, 13), 4, 4]), 4)
    compare(spark, docs_of(spark, ["one"]), 16)


def test_empty(spark):
    assert sharding.interleave(docs_of(spark, [])).count() == 0
