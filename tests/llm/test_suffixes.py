"""Removed repeats against a plain scan of all strings."""

import hashlib
import os
import random
import sys

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD, SENTENCES, docs_of

from scanloom.llm import suffixes

SF = "/root/testdata/sf0.001"


def plain(rows, n=50):
    """(doc_id, text) -> sorted (doc_id, n_bytes, n_removed, n_spans, digest); null ids are the largest."""
    order = lambda d: (d is None, d or 0)
    least = {}
    for d, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - n + 1):
            g = b[p : p + n]
            if g not in least or order(d) < order(least[g]):
                least[g] = d
    out = []
    for d, t in rows:
        b = (t or "").encode()
        hit = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if order(least[b[p : p + n]]) < order(d):
                hit[p : p + n] = b"\1" * n
        spans = sum(1 for i in range(len(b)) if hit[i] and not (i and hit[i - 1]))
        kept = bytes(x for x, h in zip(b, hit) if not h)
        out.append((d, len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, n=50, anchor=20):
    got = suffixes.remove_repeats(docs, n, anchor).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert sorted(map(tuple, got.collect()), key=str) == plain([(r.doc_id, r.text) for r in docs.collect()], n)


def test_documents(spark):
    check(spark, spark.read.parquet(f"{SF}/documents.parquet"))


def test_awkward(spark):
    texts = [*AWKWARD, *AWKWARD[4:8], "y" * 49, "y" * 49, "z" * 50, "z" * 50, "q" + SENTENCES[2]]
    check(spark, docs_of(spark, texts, [None, *range(40, 40 - len(texts) + 2, -1), 41]))
    check(spark, docs_of(spark, [SENTENCES[0], SENTENCES[0]], [5, 5]))  # one id: nothing is removed
    check(spark, docs_of(spark, [SENTENCES[0]] * 3, [None, None, 1]))


@pytest.mark.parametrize("seed,alphabet,n,anchor", [(1, "ab", 50, 20), (2, "abcdefgh", 50, 20), (3, "abc ", 24, 8), (4, "é日a", 50, 20)])
def test_random_cuttings(spark, seed, alphabet, n, anchor):
    draw = random.Random(seed)
    pool = ["".join(draw.choices(alphabet, k=draw.randrange(20, 160))) for _ in range(12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(draw.randrange(1, 5)):
            p = draw.choice(pool)
            lo = draw.randrange(len(p))
            parts.append(p[lo : lo + draw.randrange(10, 160)])
            parts.append("".join(draw.choices(alphabet, k=draw.randrange(12))))
        texts.append("".join(parts))
    check(spark, docs_of(spark, texts, draw.sample(range(1000), 60)), n, anchor)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PIECE", 1 << 9)
    monkeypatch.setattr(suffixes, "_FLUSH", 100)
    draw = random.Random(7)
    long = "".join(draw.choices("abcdefghijklmnop ", k=4000))
    texts = [long, "head " + long[300:3000], long[1000:1060] + long[2000:2049] + "?", long[::-1], long[510:560]]
    rows = docs_of(spark, texts).coalesce(1)
    hashes = list(suffixes.runs([t.encode() for t in texts]))
    assert len(hashes) > 5
    check(spark, rows)


def one_line_in_all(count, draw):
    """Texts of random words around one line, too short to be removed."""
    line = "this line is found in every text of the table."
    word = lambda: "".join(draw.choices("abcdefghijklmnop", k=draw.randrange(3, 9)))
    return [" ".join([*(word() for _ in range(20)), line, *(word() for _ in range(20))]) for _ in range(count)]


def test_hot_line_is_spread(spark):
    draw, parts = random.Random(5), 128
    texts = one_line_in_all(4000, draw)
    packed = [suffixes.zstd.ZstdCompressor().compress(t.encode()) for t in texts]
    table = spark.createDataFrame([(p,) for p in packed], "packed binary")
    hot = suffixes.hot_anchors(table, parts, 50, 20)
    assert 0 < len(hot) <= 2 * parts
    n = list(range(len(texts)))
    batch = pa.RecordBatch.from_arrays([pa.array(n), pa.array(n), pa.array(packed, pa.binary())], ["row", "doc", "packed"])

    def sizes(blobs, types):
        total = dict.fromkeys(range(parts), 0)
        for b in blobs:
            for part, kind, blob in zip(*(c.to_pylist() for c in b.columns)):
                total[part] += 0 if kind else len(suffixes._unpack(blob, types)[0])
        total = sorted(total.values())
        return total[len(total) // 2], total[-1]

    median, most = sizes(suffixes._deal(parts, 50, 20, hot)([batch]), suffixes._RUN)
    assert most <= 2 * median
    assert sizes(suffixes._deal(parts, 50, 20, hot[:0])([batch]), suffixes._RUN)[1] > 4 * median
    spans = [[{"first": 0, "n": len(t) - 49}] for t in texts]  # all starts open
    kind = pa.list_(pa.struct([("first", pa.int64()), ("n", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, kind)], [*batch.schema.names, "spans"])
    median, most = sizes(suffixes._expand(parts, 50)([batch]), suffixes._START)
    assert most <= 2 * median


def test_hot_lines_and_passages(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "_PART_BYTES", 1 << 8)
    draw = random.Random(6)
    texts = one_line_in_all(80, draw)
    passage = "a passage of more than fifty bytes that half of the texts have " * 2
    texts = [t[:60] + passage[: draw.randrange(40, 120)] + t[60:] if draw.random() < 0.5 else t for t in texts]
    check(spark, docs_of(spark, texts, draw.sample(range(1000), 80)))


def test_table_is_dropped_when_a_job_fails(spark, monkeypatch):
    def fail(*_):
        raise RuntimeError("stop")

    before = len(spark.catalog.listTables())
    monkeypatch.setattr(suffixes, "repeated_starts", fail)
    with pytest.raises(RuntimeError):
        suffixes.remove_repeats(docs_of(spark, ["a"]))
    assert len(spark.catalog.listTables()) == before


def test_text_is_cut_at_characters(spark):
    a, b = "é日" * 20 + "x", "日" * 3 + "é日" * 20 + "y"
    docs = docs_of(spark, [a, b])
    got = {r.doc_id: r for r in suffixes.remove_repeats(docs, with_text=True, carry=["row", "tie", "lang"]).collect()}
    assert [got[k].rest.asDict() for k in (0, 1)] == [{"row": k, "tie": "y", "lang": "en"} for k in (0, 1)]
    assert got[0].text == a and got[1].n_removed >= 50 and "é日é日é日é日" not in got[1].text and got[1].text.endswith("y")
    assert suffixes.kept_text("aé日b".encode(), [(2, 4)]) == "aé日b"
    assert suffixes.kept_text("aé日b".encode(), [(1, 6)]) == "ab"


def test_empty(spark):
    assert suffixes.remove_repeats(docs_of(spark, [])).count() == 0
