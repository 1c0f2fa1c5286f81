"""Benchmark passages in documents, by latent semantic retrieval with subsequence and answer checks."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of
from scanloom.plans.stage import stage

#: Words of a passage of the term matrix, and of a step between search windows.
PASSAGE, STEP = 32, 8
WINDOWS = (16, 32, 64)
RANK, EXTRA, SEED = 128, 10, 11
#: Terms in more than this share of all passages have no weight, but for the rarest few of every item.
COMMON, RAREST = 0.05, 8
#: A window is a candidate for an item from this cosine on.
COSINE = 0.5
COPY, PARAPHRASE, ANSWER = 0.8, 0.5, 0.8
#: Words and items that go to every task together; a larger benchmark is searched in blocks.
MOST_WORDS, MOST_ITEMS = 1 << 20, 1 << 17
_BLOCK, _CELLS, _PAIRS = 32, 1 << 20, 1 << 12
_PACK_TEXTS, _PACK_WORDS = 128, 1 << 16
#: Share of an item's words, its most frequent ones, that count as found without being looked up.
UNLISTED = 0.3
#: Words of an exact run that makes a candidate; shorter items are one run.
RUN = 8
_BASE = 0x9E3779B97F4A7C15

_SPLIT = bytes(32 if 32 < b < 48 or 57 < b < 65 or 90 < b < 97 or 122 < b < 128 else b for b in range(256))
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words, without ASCII punctuation."""
    return text.encode().lower().translate(_SPLIT).split()


class Benchmark:
    """The items as term ids; ``answers`` has the number of words of each item's last sentence."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [words_of(t) for _, t in rows]
        self.terms: dict[bytes, int] = {}
        self.items = [np.array([self.terms.setdefault(w, len(self.terms)) for w in ws], np.int32) for ws in words]
        last = [next((s for s in map(words_of, reversed(_SENTENCE.split(t.strip()))) if s), []) for _, t in rows]
        self.answers = [len(s) for s in last]


def blocks_of(items: DataFrame, most_items: int = MOST_ITEMS, most_words: int = MOST_WORDS) -> Iterator[Benchmark]:
    """Runs of items (columns i and t, sorted) of bounded size; an item with more words than that is a block of its own."""
    rows: list[tuple[int, str]] = []
    words = 0
    for r in items.toLocalIterator():  # the driver holds a block and a partition
        own = len(words_of(r["t"]))
        if rows and (len(rows) == most_items or words + own > most_words):
            yield Benchmark(rows)
            rows, words = [], 0
        rows.append((r["i"], r["t"]))
        words += own
    if rows:
        yield Benchmark(rows)


_PACKS = "doc_ids array<bigint>, rows array<bigint>, lengths binary, ids binary"


def _term_ids(terms: dict[bytes, int]):
    """Texts as ids of benchmark terms (-1: another word), some texts packed together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack, find, other = zstd.ZstdCompressor(level=1).compress, terms.get, repeat(-1)
        for batch in batches:
            docs, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            ids, lengths, first, packs = array("i"), [], 0, []
            for k in range(batch.num_rows):
                before = len(ids)
                ids.extend(map(find, words_of(batch.column(2)[k].as_py()), other))
                lengths.append(len(ids) - before)
                if len(ids) >= _PACK_WORDS or len(lengths) == _PACK_TEXTS or k == batch.num_rows - 1:
                    packs.append((docs[first : k + 1], rows[first : k + 1], np.array(lengths, np.int64).tobytes(), pack(ids.tobytes())))
                    ids, lengths, first = array("i"), [], k + 1
            types = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary())
            cols = list(zip(*packs)) if packs else [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["doc_ids", "rows", "lengths", "ids"])

    return run


def _packs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    """Packs one by one: the row, the texts' lengths, and all their ids."""
    unpack = zstd.ZstdDecompressor().decompress
    for batch in batches:
        for k in range(batch.num_rows):
            pack = batch.slice(k, 1).to_pylist()[0]
            yield pack, np.frombuffer(pack["lengths"], np.int64), np.frombuffer(unpack(pack["ids"]), np.int32)


def _places(lengths: np.ndarray) -> np.ndarray:
    """Place of every word in its text."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _passages(lengths: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of the passage of every word, and the number of passages."""
    own = -(-lengths // PASSAGE)
    return np.repeat(np.cumsum(own) - own, lengths) + _places(lengths) // PASSAGE, int(own.sum())


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Passages with a term; the term -1 stands for all passages."""
    seen, n = np.zeros(1, np.int64), 0
    for _, lengths, ids in _packs(batches):
        where, k = _passages(lengths)
        known = ids >= 0
        pairs = np.sort(where[known] << 21 | ids[known])
        pairs = pairs[np.append(True, pairs[1:] != pairs[:-1])] if len(pairs) else pairs
        counts = np.bincount(pairs & ((1 << 21) - 1))
        if len(counts) > len(seen):
            counts[: len(seen)] += seen
            seen = counts
        else:
            seen[: len(counts)] += counts
        n += k
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(some, -1).astype(np.int32)), pa.array(np.append(seen[some], n).astype(np.int64))], ["term", "n"]
    )


class Weights:
    """Inverse passage frequencies of the terms, with 0 for common ones, and of all other words."""

    def __init__(self, benchmark: Benchmark, counts: dict[int, int]):
        n, size = max(1, counts.get(-1, 0)), len(benchmark.terms)
        df = np.array([counts.get(i, 0) for i in range(size)], float)
        self.frequency = df
        self.terms = np.log(1 + n / np.maximum(df, 1))
        self.other = float(np.log(1 + n))
        kept = df <= COMMON * n
        for item in benchmark.items:
            own = np.unique(item)
            kept[own[np.argsort(df[own], kind="stable")[:RAREST]]] = True
        self.terms[~kept] = 0.0

    def of(self, ids: np.ndarray) -> np.ndarray:
        return np.append(self.terms, self.other)[ids]  # the last one for -1


def _sketch(weights: Weights, basis: np.ndarray):
    """A^T (A basis) over a task's passages; the rows of A are passages of unit length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(basis.shape)
        for _, lengths, ids in _packs(batches):
            where, n = _passages(lengths)
            w = weights.of(ids)
            norm = np.sqrt(np.bincount(where, w * w, minlength=n))
            some = np.flatnonzero((ids >= 0) & (w > 0))
            if not len(some):
                continue
            ids, where = ids[some], where[some]
            w = w[some] / norm[where]
            cuts = np.searchsorted(where, np.arange(0, n + _BLOCK, _BLOCK))
            for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):  # small dense blocks of passages by their terms
                if lo < hi:
                    terms, at = np.unique(ids[lo:hi], return_inverse=True)
                    cells = (where[lo:hi] - k * _BLOCK) * len(terms) + at
                    block = np.bincount(cells, w[lo:hi], minlength=_BLOCK * len(terms))
                    block = block.reshape(_BLOCK, len(terms)).astype(np.float32)
                    total[terms] += block.T @ (block @ basis[terms])
        some = np.flatnonzero(total.any(axis=1))
        values = pa.FixedSizeListArray.from_arrays(pa.array(total[some].ravel()), total.shape[1]).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), values], ["term", "v"])

    return run


def latent_basis(texts: DataFrame, weights: Weights, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (term by rank) of the passage matrix, by randomised subspace iteration.

    Two passes over all passages, each summing term rows per task and then per
    term; the driver holds matrices of term by rank only.
    """
    size = len(weights.terms)
    width = min(rank + EXTRA, size)
    basis = np.random.default_rng(SEED).standard_normal((size, width)).astype(np.float32)

    def times(q: np.ndarray) -> np.ndarray:
        rows = map_arrow(texts, _sketch(weights, q.astype(np.float32)), "term int, v array<double>")
        sums = rows.groupBy("term").agg(F.array(*[F.sum(F.col("v")[i]) for i in range(width)]).alias("v"))
        out = np.zeros((size, width))
        for r in sums.toLocalIterator():
            out[r["term"]] = r["v"]
        return out

    q = np.linalg.qr(times(basis))[0]
    small = q.T @ times(q)
    values, vectors = np.linalg.eigh((small + small.T) / 2)
    return (q @ vectors[:, np.argsort(values)[::-1][:rank]]).astype(np.float32)


def common_subsequence(item: np.ndarray, other: np.ndarray | list[int], mine: int | None = None) -> tuple[int, int]:
    """Length of the longest common subsequence, and that of the last ``mine`` words of the item alone."""

    def length(words: list[int]) -> int:
        masks: dict[int, int] = {}
        for k, w in enumerate(words):
            masks[w] = masks.get(w, 0) | 1 << k
        full = (1 << len(words)) - 1
        rows = full
        for w in other if isinstance(other, list) else other.tolist():
            m = masks.get(w)
            if m:
                hit = rows & m
                rows = ((rows + hit) | (rows - hit)) & full
        return len(words) - rows.bit_count()

    words = item.tolist()
    return length(words), length(words[len(words) - mine :]) if mine else 0


_FOUND = "doc_id long, row long, item_id long, cosine double, common_share double, answer_share double, first_word long"


def _run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` ids."""
    h = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for k in range(n if len(h) else 0):
        h = h * np.uint64(_BASE) + ids[k : k + len(h)].astype(np.uint64) + np.uint64(1)
    return h


class _Postings:
    """A term's items, for a necessary condition: as many words of an item near a window as a leak must share.

    An item is listed under its rarest terms only, which hold all but ``UNLISTED`` of its
    words; the others count as found. So frequent words cost nothing, and no leak is lost.
    """

    def __init__(self, benchmark: Benchmark, weights: Weights):
        found: dict[int, list[int]] = {}
        self.need = np.zeros(len(benchmark.items), np.int64)
        for k, words in enumerate(benchmark.items):
            if not len(words):
                continue
            own, n = np.unique(words, return_counts=True)
            rarest = np.argsort(weights.frequency[own], kind="stable")
            held = np.cumsum(n[rarest])
            listed = int(np.searchsorted(held, (1 - UNLISTED) * len(words))) + 1
            for t in own[rarest[:listed]].tolist():
                found.setdefault(t, []).append(k)
            self.need[k] = int(np.ceil(PARAPHRASE * len(words))) - (len(words) - held[listed - 1])
        self.sizes = np.array([len(found.get(t, ())) for t in range(len(benchmark.terms))] + [0], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([k for t in sorted(found) for k in found[t]], np.int64)

    def of(self, pack: _Pack) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of text and item with enough words in the whole text, and the words: the number of their pair, and their step."""
        at = np.flatnonzero(self.sizes[pack.ids])
        n = self.sizes[pack.ids[at]]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        items = self.items[np.repeat(self.starts[pack.ids[at]], n) + inside]
        key, step = np.repeat(pack.text[at], n) * len(self.need) + items, np.repeat(pack.place[at] // STEP, n)
        if len(pack.lengths) * len(self.need) <= _CELLS:
            total = np.bincount(key, minlength=1)
            some, which = np.flatnonzero(total), None
            total = total[some]
        else:
            some, which, total = np.unique(key, return_inverse=True, return_counts=True)
        enough = total >= self.need[some % len(self.need)]
        number = np.cumsum(enough) - 1
        if which is None:
            spread = np.zeros(int(some.max(initial=0)) + 1, np.int64)
            spread[some] = np.arange(len(some))
            which = spread[key]
        kept = enough[which]
        pairs = some[enough]
        return pairs // len(self.need), pairs % len(self.need), number[which[kept]], step[kept]


class _Pack:
    """Several texts as one array of ids, with a word outside the benchmark between them."""

    def __init__(self, lengths: np.ndarray, ids: np.ndarray):
        self.lengths = lengths
        texts = np.arange(len(lengths))
        self.starts = np.cumsum(lengths) - lengths + texts
        self.text = np.repeat(texts, lengths + 1)
        self.place = np.arange(len(ids) + len(lengths)) - self.starts[self.text]
        self.ids = np.full(len(self.text), -1, np.int32)
        self.ids[self.place < lengths[self.text]] = ids
        self.n_steps = lengths // STEP + 1
        self.first_step = np.cumsum(self.n_steps) - self.n_steps
        self.step = self.first_step[self.text] + np.minimum(self.place // STEP, self.n_steps[self.text] - 1)

    def near(self, text: int, start: int, stop: int) -> np.ndarray:
        """Words ``start`` to ``stop`` of a text, as far as it has them."""
        first, length = int(self.starts[text]), int(self.lengths[text])
        return self.ids[first + min(max(0, start), length) : first + min(max(0, stop), length)]


class _Search:
    def __init__(self, benchmark: Benchmark, weights: Weights, basis: np.ndarray):
        self.benchmark, self.weights, self.basis = benchmark, weights, basis
        self.postings = _Postings(benchmark, weights)
        latent = np.array([weights.of(i) @ basis[i] if len(i) else np.zeros(basis.shape[1]) for i in benchmark.items])
        latent = latent.reshape(len(benchmark.items), basis.shape[1])
        size = np.linalg.norm(latent, axis=1, keepdims=True)
        self.latent = np.where(size > 1e-9, latent / np.maximum(size, 1e-9), 0.0)
        lengths = np.array([len(i) for i in benchmark.items])
        edges = [(a + b) / 2 for a, b in zip(WINDOWS, WINDOWS[1:])]
        self.width = np.array(WINDOWS)[np.searchsorted(edges, lengths)]
        self.margin = np.maximum(STEP, lengths // 2)
        self.sets = [set(i.tolist()) for i in benchmark.items]
        self.runs: dict[int, tuple[np.ndarray, list[list[tuple[int, int]]]]] = {}
        for n in range(1, RUN + 1):
            found: dict[int, list[tuple[int, int]]] = {}
            for k, i in enumerate(benchmark.items):
                if len(i) == n or len(i) > n == RUN:
                    for at, h in enumerate(_run_hashes(i, n).tolist()):
                        found.setdefault(h, []).append((k, at))
            if found:
                self.runs[n] = np.array(sorted(found), np.uint64), [found[h] for h in sorted(found)]

    def windows(self, pack: _Pack) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Texts, items and steps of windows that have enough words of the item about them, in groups of bounded size."""
        text, item, number, step = self.postings.of(pack)
        order = np.argsort(number, kind="stable")
        number, step = number[order], step[order]
        # Pairs with enough words within the reach of one window, before any window is counted.
        until = np.arange(len(number)) + self.postings.need[item[number]] - 1
        until = np.minimum(until, len(number) - 1)
        reach = (self.width + 2 * self.margin) // STEP + 2
        dense = (number[until] == number) & (step[until] - step <= reach[item[number]])
        dense &= np.arange(len(number)) + self.postings.need[item[number]] <= len(number)
        held = np.zeros(len(text), bool)
        held[number[dense]] = True
        kept = held[number]
        number, step = (np.cumsum(held) - 1)[number[kept]], step[kept]
        text, item = text[held], item[held]
        n_steps = pack.n_steps[text]
        cells = np.cumsum(n_steps)
        a = 0
        while a < len(text):
            b = max(a + 1, int(np.searchsorted(cells, (cells[a - 1] if a else 0) + _CELLS, side="right")))
            lo, hi = np.searchsorted(number, [a, b])
            own_steps, mine = n_steps[a:b], item[a:b]
            offset = np.cumsum(own_steps) - own_steps
            size = int(own_steps.sum())
            counts = np.bincount(offset[number[lo:hi] - a] + step[lo:hi], minlength=size)
            counts = np.append(0, np.cumsum(counts))
            width, margin = self.width[mine], self.margin[mine]
            n = -(-np.maximum(1, pack.lengths[text[a:b]] - width + STEP) // STEP)
            row = np.repeat(np.arange(b - a), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            first = np.maximum(at - (-(-margin // STEP))[row], 0)
            last = np.minimum(at + (-(-(width + margin) // STEP))[row], own_steps[row])
            enough = counts[offset[row] + last] - counts[offset[row] + first] >= self.postings.need[mine][row]
            row, at = row[enough], at[enough]
            if len(row):
                yield text[a:b][row], mine[row], at
            a = b

    def cosines(self, pack: _Pack, texts: np.ndarray, items: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Cosine of each window with its item; word vectors are summed by step once, whatever windows share the step."""
        n, first = self.width[items] // STEP, pack.first_step[texts]
        needed = np.zeros(int(pack.n_steps.sum()), bool)
        for k in range(int(n.max())):
            some = (n > k) & (at + k < pack.n_steps[texts])
            needed[first[some] + at[some] + k] = True
        place = np.cumsum(needed) - 1
        words = np.flatnonzero(needed[pack.step] & (pack.ids >= 0))
        w = self.weights.of(pack.ids[words])
        words, w = words[w > 0], w[w > 0]
        sums = np.zeros((int(needed.sum()), self.basis.shape[1]), np.float32)
        if len(words):
            step, begins = np.unique(place[pack.step[words]], return_index=True)
            sums[step] = np.add.reduceat(self.basis[pack.ids[words]] * w[:, None].astype(np.float32), begins, axis=0)
        x = np.zeros((len(items), sums.shape[1]), np.float32)
        for k in range(int(n.max())):
            some = np.flatnonzero((n > k) & (at + k < pack.n_steps[texts]))
            x[some] += sums[place[first[some] + at[some] + k]]
        return np.einsum("ij,ij->i", x, self.latent[items]) / np.maximum(np.linalg.norm(x, axis=1), 1e-9)

    def exact(self, pack: _Pack) -> set[tuple[int, int, int]]:
        """Texts, items and the places where these would begin, from exact runs of their words."""
        out = set()
        for n, (keys, places) in self.runs.items():
            if len(pack.ids) < n:
                continue
            unknown = np.concatenate([[0], np.cumsum(pack.ids < 0)])
            at = np.flatnonzero(unknown[n:] == unknown[:-n])
            if len(at):
                h = _run_hashes(pack.ids, n)[at]
                where = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                same = keys[where] == h
                for t, p, i in zip(pack.text[at[same]].tolist(), pack.place[at[same]].tolist(), where[same].tolist()):
                    out.update((t, item, p - offset) for item, offset in places[i])
        return out

    def of(self, pack: _Pack) -> Iterator[tuple]:
        """Items that the texts hold: text, item, cosine, shares of words and of the answer in common, place."""
        best: dict[tuple[int, int], tuple] = {}

        def take(text: int, item: int, cosine: float, start: int, width: int) -> None:
            found = self.check(pack, text, item, start, width)
            if found and ((text, item) not in best or found > best[text, item][1:3]):
                best[text, item] = (cosine, *found, max(0, start))

        for texts, items, at in self.windows(pack):
            for a in range(0, len(items), _PAIRS):
                t, i, s = texts[a : a + _PAIRS], items[a : a + _PAIRS], at[a : a + _PAIRS]
                cosine = self.cosines(pack, t, i, s)
                for k in np.flatnonzero(cosine >= COSINE).tolist():
                    take(int(t[k]), int(i[k]), float(cosine[k]), int(s[k]) * STEP, int(self.width[i[k]]))
        for text, item, start in sorted(self.exact(pack)):
            if (text, item) in best and best[text, item][1] == 1.0:
                continue
            words = len(self.benchmark.items[item])
            near = pack.near(text, start, start + words)
            near = near[near >= 0]
            x = self.weights.of(near).astype(np.float32) @ self.basis[near]
            take(text, item, float(x @ self.latent[item] / max(np.linalg.norm(x), 1e-9)), start, words)
        for (text, item), found in best.items():
            yield (text, item, *found)

    def check(self, pack: _Pack, text: int, item: int, start: int, width: int) -> tuple[float, float] | None:
        words, answer = self.benchmark.items[item], self.benchmark.answers[item]
        margin = int(self.margin[item])
        own = self.sets[item]
        near = [w for w in pack.near(text, start - margin, start + width + margin).tolist() if w in own]
        if len(near) < PARAPHRASE * len(words):
            return None  # as many words at least are in the common subsequence of a leak
        common = common_subsequence(words, near)[0] / len(words)
        if common < PARAPHRASE:
            return None
        ends = common_subsequence(words[len(words) - answer :], near)[0] / max(1, answer) if answer else 0.0
        return (common, ends) if common >= COPY or ends >= ANSWER else None


def _retrieve(search: _Search):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pack, lengths, ids in _packs(batches):
            rows = []
            for text, item, *found in search.of(_Pack(lengths, ids)):
                rows.append((pack["doc_ids"][text], pack["rows"][text], search.benchmark.ids[item], *found))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 3 + [pa.float64()] * 3 + [pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, types)], [f.split()[0] for f in _FOUND.split(", ")]
            )

    return run


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    rank: int = RANK,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    row_col: str | None = None,
) -> DataFrame:
    """Documents that hold a benchmark passage, copied or paraphrased.

    Texts are lower-cased words without ASCII punctuation. Passages of 32 words
    of all documents form the term matrix, over the benchmark's terms; other
    words count in a passage's length. Its leading singular vectors span the
    latent space. Windows of 16, 32 and 64 words, one every 8, meet the items of
    about their length there, if they have enough words of the item about them
    for a leak at all; a cosine of ``COSINE`` makes a candidate, and so
    does an exact run of ``RUN`` words of an item (all of a shorter one). Words
    outside the benchmark do not count in either. A candidate is a leak if the
    longest common subsequence of the item and the window (with half an item to
    both sides) has ``COPY`` of the item's words, or ``PARAPHRASE`` of them and
    ``ANSWER`` of those of its answer, its last sentence.

    Items go to every task, with their terms and vectors, in blocks of at most
    ``MOST_ITEMS`` items and ``MOST_WORDS`` words; the documents are searched
    once a block. Documents never leave their task after they are written as
    term ids.

    Returns doc_id, row (``row_col``, or a new number), item_id, cosine, common_share,
    answer_share and first_word, a row per leak; of several places of an item in
    a text the one with the largest share. Null texts are empty and hold
    nothing, items without words are in nothing, null ids and repeated rows are
    kept, and no documents or no items give no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), text_of(item_text_col).alias("t")).orderBy("i", "t")
    row = (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), row, text_of(text_col).alias("text"))
    found: DataFrame | None = None
    for held in blocks_of(items):
        if not held.terms:
            continue
        if found is not None:  # a block is done before the next one begins
            found = stage(found, "leaks")
        texts = stage(map_arrow(docs, _term_ids(held.terms), _PACKS), "term-ids")
        counts = map_arrow(texts, _document_frequency, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
        weights = Weights(held, {r["term"]: r["n"] for r in counts.collect()})  # a row per term
        leaks = map_arrow(texts, _retrieve(_Search(held, weights, latent_basis(texts, weights, rank))), _FOUND)
        found = leaks if found is None else found.union(leaks)
    return spark.createDataFrame([], _FOUND) if found is None else found
