"""Product codes of vectors against plain k-means in whole numbers."""

import hashlib
import itertools
import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from scanloom.llm import vector_codes

SF = "/root/testdata/sf0.01"
SCHEMA = "vec_id long, embedding array<float>, label int, part int, rid string"


def plain(rows, parts=4, entries=256, rounds=4):
    """(vec_id, vector, label) rows -> multiset of (vec_id, code, error, label_error, digest), in Python's integers."""
    kept = [(i, v, n) for i, v, n in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[max(-(2**62), min(2**62, math.floor(1024 * x))) for x in v] for _, v, _ in kept]
    size = len(whole[0]) // parts
    codes, errors, digits = [""] * len(kept), [0] * len(kept), []
    for p in range(parts):
        points = [w[p * size : (p + 1) * size] for w in whole]
        book = [list(x) for x in points[:entries]]
        for last in [False] * rounds + [True]:
            near = [min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(book)) for x in points]
            if last:
                break
            found = defaultdict(list)
            for x, (_, e) in zip(points, near):
                found[e].append(x)
            for e, xs in found.items():
                book[e] = [sum(col) // len(xs) for col in zip(*xs)]
        digits += [str(x) for c in book for x in c]
        for i, (far, e) in enumerate(near):
            codes[i] += f"{e:02x}"
            errors[i] += far
    most = 2**63 - 1
    errors = [min(e, most) for e in errors]
    labels = Counter()
    for (_, _, n), e in zip(kept, errors):
        labels[n] += e
    sha = hashlib.sha256(",".join(digits).encode()).hexdigest()
    return Counter((i, c, e, min(labels[n], most), sha) for (i, _, n), c, e in zip(kept, codes, errors))


def check(spark, rows, **options):
    df = spark.createDataFrame([(i, v, n, 9, "x") for i, v, n in rows], SCHEMA).repartition(3)
    got = vector_codes.compress(df, **options).collect()
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert Counter((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in got) == plain(rows, **options)
    return got


def vectors(n, dims, seed=0, spread=1.0):
    draw = random.Random(seed)
    centres = [[draw.gauss(0, spread) for _ in range(dims)] for _ in range(5)]
    return [(i, [c + draw.gauss(0, 0.1) for c in centres[i % 5]], i % 5 or None) for i in range(n)]


def test_embeddings(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in df.orderBy("vec_id").collect()])
    whole = np.floor(1024 * np.array(x, np.float64)).astype(np.int64)
    codes, errors = [], 0
    for p in range(4):
        points = whole[:, 16 * p : 16 * p + 16]
        book = points[:256].copy()
        for last in (False, False, False, False, True):
            far = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
            near = far.argmin(axis=1)
            for e in set() if last else set(near):
                book[e] = points[near == e].sum(axis=0) // (near == e).sum()
        codes.append(near)
        errors = errors + far.min(axis=1)
    got = {r.vec_id: (r.code, r.error) for r in vector_codes.compress(df).collect()}
    assert got == {i: ("".join(f"{c[k]:02x}" for c in codes), errors[k]) for k, i in enumerate(ids)}


def test_clusters_in_small_blocks(spark):
    """Tight clusters, where most blocks are settled by their box."""
    rows = vectors(300, 8, spread=30.0)
    check(spark, rows, entries=7)
    df = spark.createDataFrame([(i, v, n, 9, "x") for i, v, n in rows], SCHEMA)
    few = Counter(map(tuple, vector_codes.compress(df, entries=7, block=4).collect()))
    assert few == Counter(map(tuple, vector_codes.compress(df, entries=7, block=256).collect()))


def test_ties_copies_and_short_codebooks(spark):
    check(spark, [(i, [0.0, 1.0, 0.5, 0.5], i % 2) for i in range(40)], entries=16)
    check(spark, [(i, [float(i % 3), float(-(i % 2)), 0.0, -0.0005], None) for i in range(30)], entries=8, rounds=2)
    check(spark, [(4, [0.1, 0.2, 0.3, 0.4], 1)])


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        *vectors(20, 4),
        (None, [1.0, 2.0, 3.0, 4.0], None),
        (None, [1.0, 2.0, 3.0, 3.0], 3),
        (3, [1.0, 2.0, 3.0, 4.0], 3),
        (50, None, 1),
        (51, [nan, 0.0, 0.0, 0.0], 1),
        (52, [inf, 0.0, 0.0, 0.0], 1),
        (53, [0.0, -inf, 0.0, 0.0], 1),
        (54, [None, 0.0, 0.0, 0.0], 1),
        (55, [1.0, 2.0], 1),
        (56, [], 1),
    ]
    got = check(spark, rows, entries=6)
    assert len(got) == 23


@pytest.mark.parametrize("big", [40.0, 3e4, 1e9, 1e30])
def test_large_components(spark, big):
    rows = [(i, [v * big for v in vec], n) for i, vec, n in vectors(30, 8)]
    check(spark, rows, entries=5)


def test_empty_and_indivisible(spark):
    df = spark.createDataFrame([(1, None, 1, 1, "")], SCHEMA)
    assert vector_codes.compress(df).count() == 0
    assert vector_codes.compress(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        vector_codes.compress(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, "")], SCHEMA))


def test_shortlists_lose_no_nearest_entry():
    draw = np.random.default_rng(1)
    for _ in range(200):
        points, book = draw.integers(-9, 9, (6, 3)), draw.integers(-9, 9, (12, 3))
        few = vector_codes.shortlist(points.min(axis=0), points.max(axis=0), book)
        far = ((points[:, None] - book[None]) ** 2).sum(axis=2)
        code, error = vector_codes.nearest(points, book, few)
        assert (code == far.argmin(axis=1)).all() and (error == far.min(axis=1)).all()


@pytest.mark.parametrize("dims, bits", [(1, 4), (2, 3), (3, 2), (4, 2)])
def test_curve_visits_neighbours(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = vector_codes.hilbert_keys(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()
