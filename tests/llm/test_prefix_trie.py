"""The trie of conversation prefixes against plain dictionaries."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest

from scanloom.llm import prefix_trie

SF = "/root/testdata/sf0.01"
SCHEMA = "conv_id long, turn long, role string, text string, key string, pid int, path string"


def plain(rows):
    """(conv_id, turn, role, text) rows -> nodes as a multiset of result rows."""
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs[c].append((turn is not None, turn or 0, digest, (role, text)))
    turns = {c: [t[-1] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(turns.get(c - c % 5, [])[:h] + turns[c][h:])
    nodes = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            nodes[path[:d]].append(c)
    children = Counter(p[:-1] for p in nodes if p)
    saved, leaves = Counter(), Counter()
    for p, members in nodes.items():
        own = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            saved[p[:d]] += own
            leaves[p[:d]] += children[p] == 0
    out = Counter()
    for p, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(built[c]) == len(p))
        parent = min(nodes[p[:-1]]) if p else None
        sha = hashlib.sha256(ends.encode()).hexdigest()
        out[min(members), len(p), parent, len(members), children[p], leaves[p], saved[p], sha] += 1
    return out


def check(df):
    got = Counter(tuple(r) for r in prefix_trie.prefix_trie(df).collect())
    assert got == plain([(r.conv_id, r.turn, r.role, r.text) for r in df.collect()])
    return got


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 7, "p") for r in rows], SCHEMA).repartition(3)


@pytest.fixture
def small_shards(monkeypatch):
    """Shards of a few conversations, chunks of a few ids and blocks of a few columns, so that nodes reach over all edges."""
    monkeypatch.setattr(prefix_trie, "_SHARD_BYTES", 400)
    monkeypatch.setattr(prefix_trie, "_CHUNK", 3)
    monkeypatch.setattr(prefix_trie, "_CELLS", 8)


def test_conversations(spark):
    check(spark.read.parquet(f"{SF}/conversations.parquet"))


def test_conversations_over_many_shards(spark, small_shards):
    check(spark.read.parquet(f"{SF}/conversations.parquet"))


@pytest.mark.parametrize("seed", range(4))
def test_random_shared_prefixes(spark, small_shards, seed):
    draw = random.Random(seed)
    rows = []
    for c in range(90):
        if draw.random() < 0.9:
            deep = draw.choice([0, 1, 2, 3, 9, 25])
            rows += [(c, t, draw.choice(["user", "assistant"]), draw.choice(["", "é", "abc"])) for t in range(deep)]
    rows += [(c, t, "user", f"hot {t}") for c in range(100, 160) for t in range(11)]  # a third of all are equal
    check(frame(spark, rows))


def test_awkward_rows(spark, small_shards):
    rows = [
        (None, 0, "user", "no conversation"),
        (5, None, None, None),
        (5, None, "", ""),
        (5, 2, "user", "x" * 50000),
        (5, 2, "user", "x" * 50000),
        (6, 0, "a", "bc"),
        (7, 0, "ab", "c"),  # roles and texts that run together alike
        (2**62, 1, "user", "日本 \x00 語"),
        (8, -3, "user", ""),
        (8, 3, "user", ""),
    ]
    got = check(frame(spark, rows))
    assert sum(r[1] == 0 for r in got) == 1


def test_one_long_conversation_among_short_ones(spark):
    rows = [(c, 0, "user", "hello") for c in range(1, 300)] + [(0, t, "user", str(t % 7)) for t in range(2500)]
    assert max(r[1] for r in check_deep(spark, rows)) == 2500


def check_deep(spark, rows):
    """As ``check``, but without the plain version, which is quadratic in the depth: depths of the longest must be unbroken."""
    got = [tuple(r) for r in prefix_trie.prefix_trie(frame(spark, rows)).collect()]
    assert sorted(r[1] for r in got if r[0] == 0)[-1] == 2500
    assert {r[1] for r in got} == set(range(2501))
    assert [r[3] for r in got if r[1] == 0] == [300]
    return got


def test_turnless_conversations(spark):
    """Conversations whose turns all come from a base that is absent belong to the root alone."""
    ids = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 1]
    got = check(frame(spark, [(c, 0, "user", "gone") for c in ids]))
    assert sum(got.values()) == 1


def test_empty(spark):
    assert prefix_trie.prefix_trie(frame(spark, [])).count() == 0
