"""Planted passages, the latent basis against a dense decomposition, and subsequences."""

import os
import random
import sys

import numpy as np

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, docs_of

from scanloom.llm import decontamination as dec

SF = "/root/testdata/sf0.01"


def plain_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_subsequence():
    draw = random.Random(4)
    for _ in range(200):
        a = np.array(draw.choices(range(6), k=draw.randrange(1, 80)), np.int32)
        b = np.array(draw.choices(range(-1, 7), k=draw.randrange(0, 90)), np.int32)
        mine = draw.randrange(1, len(a) + 1)
        want = plain_subsequence(a.tolist(), b.tolist()), plain_subsequence(a.tolist()[-mine:], b.tolist())
        assert dec.common_subsequence(a, b, mine) == want


def test_every_planted_passage_and_no_other(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text.strip() for r in bench.collect()}
    want = {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if t in r.text}
    got = {(r.doc_id, r.item_id) for r in dec.find_leaks(docs, bench).collect()}
    assert want and got == want


def rows_for(draw):
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9))) for _ in range(900)]
    clean = [" ".join(draw.choices(vocabulary, k=draw.randrange(50, 400))) for _ in range(60)]
    items = [" ".join(draw.choices(vocabulary, k=n)) + ". " + " ".join(draw.choices(vocabulary, k=6)) + "." for n in (14, 25, 40, 60)]
    return vocabulary, clean, items


def test_paraphrases(spark):
    draw = random.Random(6)
    vocabulary, clean, items = rows_for(draw)

    def changed(text, share, answer=True):
        head, _, tail = text.partition(". ")
        w = head.split()
        for p in draw.sample(range(len(w)), int(share * len(w))):
            w[p] = draw.choice(vocabulary)
        return " ".join(w) + ". " + (tail if answer else " ".join(draw.choices(vocabulary, k=6)) + ".")

    texts, want = list(clean), set()
    for i, item in enumerate(items):
        for share, answer, leak in ((0, True, True), (0.1, True, True), (0.35, True, True), (0.8, False, False)):
            if leak:
                want.add((len(texts), i))
            texts.append(clean[i][:300] + " " + changed(item.upper() if share == 0.1 else item, share, answer) + " " + clean[i + 20][:900])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in dec.find_leaks(docs_of(spark, texts), bench).collect()}
    assert got == want


def test_basis_is_that_of_the_dense_matrix(spark):
    docs, bench = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet").limit(6)
    held = dec.Benchmark([(r.item_id, r.text) for r in bench.collect()])
    rows = []
    for r in docs.collect():
        ids = [held.terms.get(w, -1) for w in dec.words_of(r.text)]
        rows += [ids[k : k + dec.PASSAGE] for k in range(0, len(ids), dec.PASSAGE)]
    counts = {-1: len(rows)}
    for p in rows:
        for t in set(p) - {-1}:
            counts[t] = counts.get(t, 0) + 1
    weights = dec.Weights(held, counts)
    dense = np.zeros((len(rows), len(held.terms)))
    for k, p in enumerate(rows):
        w = weights.of(np.array(p, np.int32))
        norm = max(np.sqrt((w * w).sum()), 1e-9)
        for t, x in zip(p, w):
            if t >= 0:
                dense[k, t] += x / norm
    texts = dec.map_arrow(docs.selectExpr("doc_id", "doc_id as row", "text"), dec._term_ids(held.terms), dec._PACKS)
    found = dec.map_arrow(texts, dec._document_frequency, "term int, n long").groupBy("term").sum("n").collect()
    assert {r[0]: r[1] for r in found} == counts
    basis = dec.latent_basis(texts, weights, rank=20)
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-4)
    best = (np.linalg.svd(dense, compute_uv=False)[:20] ** 2).sum()
    assert ((dense @ basis) ** 2).sum() > 0.9 * best


def test_awkward_and_empty(spark):
    bench = spark.createDataFrame([(1, None), (2, ""), (None, AWKWARD[4]), (4, AWKWARD[6]), (5, "..."), (5, AWKWARD[4])], "item_id long, text string")
    texts = [*AWKWARD, "some clean words that stand in no item at all, honestly"]
    got = [(r.doc_id, r.item_id) for r in dec.find_leaks(docs_of(spark, texts, [None, *range(1, 12), 4, 4]), bench).collect()]
    assert {d for d, i in got if i == 4} == {6, 7} or {d for d, i in got if i == 4} == {6}
    assert {d for d, i in got if i is None} >= {4, 5, 6, 7} and (4, 5) in got and 13 not in {d for d, _ in got}
    assert dec.find_leaks(docs_of(spark, []), bench).count() == 0
    assert dec.find_leaks(docs_of(spark, texts), bench.limit(0)).count() == 0


def test_exact_copies_in_a_large_corpus():
    """Exact copies amid words that are all outside the benchmark, with the weights of a large corpus."""
    draw = random.Random(8)
    words = [f"w{k}" for k in range(900)]
    items = [" ".join(draw.choices(words, k=n)) + "." for n in [5, 9, 12, 14, 20, 30, 45, 60, 150] * 6]
    held = dec.Benchmark(list(enumerate(items)))
    n = 10**9
    weights = dec.Weights(held, {-1: n} | {i: n // draw.choice((30, 60, 200)) for i in range(len(held.terms))})
    basis = np.linalg.qr(np.random.default_rng(1).standard_normal((len(held.terms), 128)))[0].astype(np.float32)
    search = dec._Search(held, weights, basis)
    for k, item in enumerate(held.items):
        for before in range(37, 45):
            ids = np.concatenate([np.full(before, -1), item, np.full(50, -1)]).astype(np.int32)
            pack = dec._Pack(np.array([3, len(ids), 0]), np.append(np.array([0, -1, 2], np.int32), ids))
            assert {(t, i, common) for t, i, _, common, *_ in search.of(pack) if i == k} == {(1, k, 1.0)}


def search_over(items, texts, rank=24):
    """A search of ``items`` with weights and a basis that are counted from ``texts``, in one place."""
    held = dec.Benchmark(list(enumerate(items)))
    ids = [np.array([held.terms.get(w, -1) for w in dec.words_of(t)], np.int32) for t in texts]
    passages = [i[k : k + dec.PASSAGE] for i in ids for k in range(0, len(i), dec.PASSAGE)]
    counts = {-1: len(passages)}
    for p in passages:
        for t in set(p.tolist()) - {-1}:
            counts[t] = counts.get(t, 0) + 1
    weights = dec.Weights(held, counts)
    dense = np.zeros((len(passages), len(held.terms)))
    for k, p in enumerate(passages):
        np.add.at(dense[k], p[p >= 0], weights.of(p[p >= 0]))
    basis = np.linalg.svd(dense, full_matrices=False)[2][:rank].T.astype(np.float32)
    return dec._Search(held, weights, basis), ids


def plain_search(search, ids):
    """Every item at every place of one text: windows by their cosine, runs by their words, then the full subsequences."""
    out = {}
    for item, words in enumerate(search.benchmark.items):
        width, places = int(search.width[item]), []
        for start in range(0, max(1, len(ids) - width + dec.STEP), dec.STEP):
            near = ids[start : start + width]
            near = near[near >= 0]
            x = (search.weights.of(near)[:, None] * search.basis[near]).sum(axis=0)
            if x @ search.latent[item] >= dec.COSINE * np.linalg.norm(x) > 0:
                places.append((start, width))
        run = min(dec.RUN, len(words))
        for a in range(len(words) - run + 1 if run else 0):
            for p in range(len(ids) - run + 1):
                if (ids[p : p + run] == words[a : a + run]).all():
                    places.append((p - a, len(words)))
        answer, margin = search.benchmark.answers[item], max(dec.STEP, len(words) // 2)
        for start, width in places:
            near = ids[max(0, start - margin) : max(0, start + width + margin)].tolist()
            common = plain_subsequence(words.tolist(), near) / len(words)
            ends = plain_subsequence(words.tolist()[len(words) - answer :], near) / max(1, answer) if answer else 0.0
            if common >= dec.COPY or (common >= dec.PARAPHRASE and ends >= dec.ANSWER):
                out[item] = max(out.get(item, (0, 0)), (common, ends))
    return out


def test_search_against_all_places_of_all_items():
    draw = random.Random(12)
    common = ["the", "of", "and", "to", "in"]
    vocabulary = common * 20 + ["".join(draw.choices("abcdefgh", k=5)) for _ in range(120)]
    item = lambda n: " ".join(draw.choices(vocabulary, k=n)) + ". " + " ".join(draw.choices(vocabulary, k=4)) + "."
    items = [item(n) for n in (1, 3, 10, 14, 20, 28, 40, 60, 5, 9)] + ["the of and to in", "...", "the " * 30]
    texts = ["", "the", " ".join(draw.choices(vocabulary, k=300))]
    for _ in range(24):
        words = draw.choices([*vocabulary, *(f"other{k}" for k in range(60))], k=draw.randrange(0, 160))
        planted = draw.choice(items).split()
        for k in draw.sample(range(len(planted)), int(len(planted) * draw.choice([0, 0.1, 0.3, 0.5]))):
            planted[k] = draw.choice(vocabulary)
        at = draw.randrange(len(words) + 1)
        texts.append(" ".join(words[:at] + planted + words[at:]))
    search, ids = search_over(items, texts)
    pack = dec._Pack(np.array([len(i) for i in ids]), np.concatenate(ids))
    got = {(t, i): found for t, i, _, *found, _ in search.of(pack)}
    want = {(t, i): found for t, own in enumerate(ids) for i, found in plain_search(search, own).items()}
    assert len(want) > 15 and set(got) == set(want)
    for pair, found in want.items():
        assert tuple(np.round(got[pair], 9)) == tuple(np.round(found, 9)) or got[pair][0] == 1.0


def paraphrase_recall(changed, seed=3):
    """Share of planted paraphrases found when this share of an item's words (but for its answer) is replaced."""
    draw = random.Random(seed)
    vocabulary = ["".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9))) for _ in range(900)]
    items, texts = [], []
    for k in range(120):
        head = draw.choices(vocabulary, k=draw.randrange(15, 60))
        tail = " ".join(draw.choices(vocabulary, k=6))
        items.append(" ".join(head) + ". " + tail + ".")
        for p in draw.sample(range(len(head)), int(changed * len(head))):
            head[p] = draw.choice(vocabulary)
        around = draw.choices([*vocabulary, *(f"other{j}" for j in range(900))], k=300)
        texts.append(" ".join(around[:150] + head) + ". " + tail + ". " + " ".join(around[150:]))
    search, ids = search_over(items, texts, rank=128)
    pack = dec._Pack(np.array([len(i) for i in ids]), np.concatenate(ids))
    found = {(t, i) for t, i, *_ in search.of(pack)}
    leaks = [k for k, own in enumerate(ids) if k in plain_leaks(search, own, k)]
    return sum((k, k) in found for k in leaks) / len(leaks), len(leaks)


def plain_leaks(search, ids, item):
    """The item, if its words and answer are in the text's planted place at all."""
    words, answer = search.benchmark.items[item], search.benchmark.answers[item]
    common = plain_subsequence(words.tolist(), ids[140:240].tolist()) / len(words)
    ends = plain_subsequence(words.tolist()[len(words) - answer :], ids[140:240].tolist()) / max(1, answer)
    return {item} if common >= dec.COPY or (common >= dec.PARAPHRASE and ends >= dec.ANSWER) else set()


def test_paraphrase_recall():
    for changed in (0.1, 0.2, 0.3, 0.4, 0.5):
        recall, n = paraphrase_recall(changed)
        print(f"words changed {changed:.0%}: recall {recall:.3f} of {n}")
        assert n > 20 and recall >= 0.9


def test_blocks_of_items(spark, monkeypatch):
    """A benchmark above the bounds is searched block by block, with the leaks of one search."""
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    items = bench.selectExpr("item_id AS i", "text AS t").orderBy("i")
    sizes = [(len(b.ids), sum(map(len, b.items))) for b in dec.blocks_of(items, 11, 300)]
    assert len(sizes) > 4 and sum(n for n, _ in sizes) == bench.count()
    assert all(n <= 11 and (words <= 300 or n == 1) for n, words in sizes)
    want = {(r.doc_id, r.item_id) for r in dec.find_leaks(docs, bench).collect()}
    blocks = dec.blocks_of
    monkeypatch.setattr(dec, "blocks_of", lambda df: blocks(df, 16, 10000))
    assert {(r.doc_id, r.item_id) for r in dec.find_leaks(docs, bench).collect()} == want
