"""Language-model scores of texts: a unigram base, and subword lattices with marginal likelihood."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from math import log, log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanloom.llm import lattice
from scanloom.llm.common import map_arrow, text_of
from scanloom.llm.quality import remainder
from scanloom.plans.stage import stage

HELD_OUT = (7, 2)
ROUNDS = 2
#: Words with more than one of so many occurrences go to every task; there can be no more of them than this.
FREQUENT = 1 << 19
_ENTRIES, _ROWS = 300_000, 100_000


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> lattice.Vocabulary:
    return lattice.Vocabulary(path)


def words_of(text: str) -> list[bytes]:
    """Words of the lower-cased text; A-Z and ASCII white space only."""
    return text.encode().lower().split()


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = (Counter(), Counter())

    def flush():
        words = list(counts[0].keys() | counts[1].keys())
        cols = [pa.array(words, pa.binary()).cast(pa.string())]
        cols += [pa.array([counts[0][w] + counts[1][w] for w in words], pa.int64()), pa.array([counts[0][w] for w in words], pa.int64())]
        for c in counts:
            c.clear()
        return pa.RecordBatch.from_arrays(cols, ["word", "n", "c"])

    for batch in batches:
        for held_out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            counts[held_out].update(words_of(text))
            if len(counts[0]) + len(counts[1]) > _ENTRIES:
                yield flush()
    yield flush()


def _expect(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        total = np.zeros(vocabulary.size + 1)
        for batch in batches:
            total += lattice.expected_counts(
                vocabulary, logp, batch.column(0).to_pylist(), batch.column(1).to_numpy().astype(float)
            )
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(total[seen])], ["piece", "expected"])

    return run


def _word_scores(path: str, logp: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(path)
        for batch in batches:
            found = lattice.log_likelihood(vocabulary, logp, batch.column(0).to_pylist()) / log(10)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], ["word", "n", "c", "lp"])

    return run


def learn_pieces(words: DataFrame, texts: int, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Log-probabilities of the pieces and the end, from all training words.

    Start from the vocabulary's own scores; each round takes the counts expected
    over all segmentations of every distinct word, and adds the scores as
    one pseudo-count a piece. What reaches the driver is a row per piece.
    """
    v = _vocabulary(vocabulary)
    p = v.prior
    for _ in range(rounds):
        logp = np.log(np.maximum(p, 1e-300))
        rows = map_arrow(words.filter("c > 0").select("word", "c"), _expect(vocabulary, logp), "piece int, expected double")
        counts = v.prior * v.size
        for r in rows.groupBy("piece").agg(F.sum("expected").alias("expected")).collect():
            counts[r["piece"]] += r["expected"]
        counts[v.size] += texts
        p = counts / counts.sum()
    return np.log(np.maximum(p, 1e-300))


_LINES = "row long, word string, n long, doc_id long, held_out boolean, n_tokens long, known long, base double, score double"


def _split_texts(frequent: dict[bytes, tuple[int, float]], denominator: int, ends: int, end_score: float):
    """Per text a line with the sums over its frequent words, and a line per other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _LINES.split(", ")]
        kinds = {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
        types = [kinds[f.split()[1]] for f in _LINES.split(", ")]
        cols: list[list] = [[] for _ in names]

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)
            for c in cols:
                c.clear()
            return out

        floor = log10(denominator)
        for batch in batches:
            for row, doc, held_out, text in zip(*(c.to_pylist() for c in batch.columns)):
                counts, n_tokens = Counter(words_of(text)), 1
                known, base, score = int(ends > 0), log10(ends + 1) - floor, end_score
                rare: list[tuple[bytes, int]] = []
                for w, n in counts.items():
                    n_tokens += n
                    hit = frequent.get(w)
                    if hit is None:
                        rare.append((w, n))
                    else:
                        known += n if hit[0] > 0 else 0
                        base += n * (log10(hit[0] + 1) - floor)
                        score += n * hit[1]
                for c, v in zip(cols, (row, f" {row}", 0, doc, held_out, n_tokens, known, base, score)):
                    c.append(v)
                k = len(rare)
                cols[0].extend([row] * k)
                cols[1].extend([w.decode() for w, _ in rare])
                cols[2].extend([n for _, n in rare])
                for c in cols[3:]:
                    c.extend([None] * k)
                if len(cols[0]) >= _ROWS:
                    yield flush()
        yield flush()

    return run


def score_texts(
    docs: DataFrame,
    vocabulary: str,
    held_out_of: tuple[int, int] = HELD_OUT,
    rounds: int = ROUNDS,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Score every whole text by a unigram base and by the subword lattice model.

    Both learn from the rows whose remainder (CRC-32 of the id as text) is not
    the held-out one. The base is the add-one log10 probability of the words and
    one end per text. The lattice model spells the words of a text, each after a
    space mark, in pieces of ``vocabulary`` (a sentencepiece file, not trained
    here) and ends it; a word's probability is the sum over all its
    segmentations by forward recursion, and characters the vocabulary lacks are
    spelt in bytes. Piece weights start from the stored scores and are
    re-estimated on all training words (``learn_pieces``).

    Each distinct word is scored once. Words that make up more than one in
    ``FREQUENT`` of all occurrences (so fewer than that many) are known to every
    task; the others meet their texts in a join on the word, so no hot word is
    shuffled.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and
    score, a row per row. Null texts are empty (one token, the end); null ids
    have the remainder 0; repeated ids and rows are kept; with no training rows
    the counts are 0 and pieces keep their stored weights; an empty table gives
    no rows.
    """
    n, r = held_out_of
    texts = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (remainder(id_col, n) == r).alias("held_out"),
        text_of(text_col).alias("text"),
    )
    words = map_arrow(texts.select("held_out", "text"), _count_words, "word string, n long, c long")
    words = stage(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "words")
    size = words.agg(F.sum("n"), F.sum("c"), F.count(F.when(F.col("c") > 0, 1))).first()
    ends = docs.filter(remainder(id_col, n) != r).count()
    every, train, distinct = (size[0] or 0), (size[1] or 0) + ends, size[2] + (ends > 0)
    logp = learn_pieces(words, ends, vocabulary, rounds)
    scored = stage(map_arrow(words, _word_scores(vocabulary, logp), "word string, n long, c long, lp double"), "word-scores")
    common = scored.filter(F.col("n") > every / FREQUENT).select("word", "c", "lp").collect()
    frequent = {r["word"].encode(): (r["c"], r["lp"]) for r in common}

    rows = texts.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    denominator, end_score = train + distinct + 1, float(logp[-1] / log(10))
    split = map_arrow(rows, _split_texts(frequent, denominator, ends, end_score), _LINES)
    rare = scored.filter(F.col("n") <= every / FREQUENT).select("word", "c", "lp")
    times = F.col("n")
    lines = split.join(rare, "word", "left").select(
        "row",
        "doc_id",
        "held_out",
        "n_tokens",
        F.coalesce("known", F.when(F.col("c") > 0, times).otherwise(0)).alias("known"),
        F.coalesce("base", times * (F.log10(F.col("c") + 1) - F.lit(log10(denominator)))).alias("base"),
        F.coalesce("score", times * F.col("lp")).alias("score"),
    )
    return lines.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("known").alias("n_known"),
        F.lit(train).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row")
