"""Marginal probability of words over all their segmentations into vocabulary pieces."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from sentencepiece import SentencePieceProcessor

MARK = "▁"
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 1 << 18
_CHARS = 200_000


class Vocabulary:
    """Pieces of a sentencepiece file, found by a hash of their characters.

    Ids below ``size`` are pieces; id ``size`` is the end of a text. ``prior``
    turns the stored scores into weights: in these files a score is minus the
    rank of a piece, and a piece of rank r weighs 1 / (r + 10) (Zipf's law).
    """

    def __init__(self, path: str):
        model = SentencePieceProcessor(model_file=path)
        self.size = model.get_piece_size()
        weight, pieces, self.bytes = np.zeros(self.size + 1), {}, np.zeros(256, np.int64)
        for i in range(self.size):
            if model.is_byte(i):
                self.bytes[int(model.id_to_piece(i)[3:5], 16)] = i
                weight[i] = 1e-7
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                if len(piece) == 1 or piece.strip(MARK):  # runs of spaces never occur in a word
                    pieces[piece] = i
                    rank = -model.get_score(i)
                    weight[i] = 1.0 / (rank + 10) if rank < 1e6 else 1e-7
        weight[self.size] = weight.max()
        self.prior = weight / weight.sum()
        self.longest = max(map(len, pieces))
        codes, starts, ends = _flatten(list(pieces))
        hashes = _spans(codes, starts, ends)
        self._hash, self._id = np.zeros(_SLOTS, np.uint64), np.full(_SLOTS, -1, np.int32)
        for h, i in zip(hashes.tolist(), pieces.values()):
            at = (h >> 40) % _SLOTS
            while self._id[at] >= 0:
                at = (at + 1) % _SLOTS
            self._hash[at], self._id[at] = h, i

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids, or -1."""
        at = ((hashes >> np.uint64(40)) % np.uint64(_SLOTS)).astype(np.int64)
        out, open_ = np.full(len(hashes), -1, np.int32), np.arange(len(hashes))
        while len(open_):
            ids = self._id[at[open_]]
            hit = (self._hash[at[open_]] == hashes[open_]) & (ids >= 0)
            out[open_[hit]] = ids[hit]
            open_ = open_[~hit & (ids >= 0)]
            at[open_] = (at[open_] + 1) % _SLOTS
        return out


def _flatten(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    ends = np.cumsum([len(w) for w in words])
    return codes, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def _spans(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of every span [start, end)."""
    out, width = np.zeros(len(starts), np.uint64), ends - starts
    for k in range(int(width.max(initial=0))):
        live = width > k
        out[live] = out[live] * _BASE + codes[starts[live] + k] + np.uint64(1)
    return _mixed(out)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Lattice:
    """Arcs of a batch of words, as piece ids by length and place; a character the vocabulary lacks has an id of its own."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary, self.n = vocabulary, len(words)
        codes, self.starts, self.ends = _flatten([MARK + w for w in words])
        last = np.repeat(self.ends, self.ends - self.starts)
        live, running = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        self.arcs = np.full((vocabulary.longest, len(codes)), -1, np.int32)
        for k in range(vocabulary.longest):
            live = live[live + k < last[live]]
            running[live] = running[live] * _BASE + codes[live + k] + np.uint64(1)
            self.arcs[k, live] = vocabulary.find(_mixed(running[live]))
        unknown = np.flatnonzero(self.arcs[0] < 0)
        letters, which = np.unique(codes[unknown], return_inverse=True)
        self.spelt = [vocabulary.bytes[list(chr(int(c)).encode("utf-8", "surrogatepass"))] for c in letters]
        self.arcs[0, unknown] = vocabulary.size + 1 + which

    def weights(self, logp: np.ndarray) -> np.ndarray:
        """Log-probability by arc id: pieces, end, characters spelt in bytes, and (last) no arc."""
        return np.concatenate([logp, [logp[ids].sum() for ids in self.spelt], [-np.inf]])

    def groups(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words of equal length, with their arcs as (length of the piece - 1, place, word)."""
        width = self.ends - self.starts
        order = np.argsort(width, kind="stable")
        for words in np.split(order, np.flatnonzero(np.diff(width[order])) + 1) if self.n else ():
            n = int(width[words[0]])
            places = np.arange(n)[:, None] + self.starts[words][None, :]
            yield words, self.arcs[: min(n, len(self.arcs)), places]


def forward(arcs: np.ndarray) -> np.ndarray:
    """Log-sums over all segmentations of the first t characters, for every t and word; ``arcs`` holds log-weights."""
    lengths, width, n = arcs.shape
    sums = np.full((width + 1, n), -np.inf)
    sums[0] = 0.0
    for t in range(1, width + 1):
        k = np.arange(min(lengths, t))
        sums[t] = _log_sum(arcs[k, t - 1 - k] + sums[t - 1 - k])
    return sums


def backward(arcs: np.ndarray) -> np.ndarray:
    """Log-sums over all segmentations of the characters from t on."""
    lengths, width, n = arcs.shape
    sums = np.full((width + 1, n), -np.inf)
    sums[width] = 0.0
    for t in range(width - 1, -1, -1):
        k = np.arange(min(lengths, width - t))
        sums[t] = _log_sum(arcs[k, t] + sums[t + 1 + k])
    return sums


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(axis=0))


def batches(words: list[str]) -> Iterator[slice]:
    """Runs of words of bounded total length."""
    lo = size = 0
    for i, w in enumerate(words):
        size += len(w) + 1
        if size >= _CHARS:
            yield slice(lo, i + 1)
            lo, size = i + 1, 0
    if lo < len(words):
        yield slice(lo, len(words))


def log_likelihood(vocabulary: Vocabulary, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Natural log of each word's probability, summed over all its segmentations."""
    out = np.zeros(len(words))
    for part in batches(words):
        lattice = Lattice(vocabulary, words[part])
        weights = lattice.weights(logp)
        for group, arcs in lattice.groups():
            out[part.start + group] = forward(weights[arcs])[-1]
    return out


def expected_counts(vocabulary: Vocabulary, logp: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """How often each piece is expected in ``counts`` occurrences of the words, over all segmentations."""
    total = np.zeros(vocabulary.size + 1)
    for part in batches(words):
        lattice = Lattice(vocabulary, words[part])
        weights, times = lattice.weights(logp), counts[part]
        seen = np.zeros(len(weights))
        for group, arcs in lattice.groups():
            logs = weights[arcs]
            ahead, behind = forward(logs), backward(logs)
            for k in range(len(arcs)):
                at = np.arange(logs.shape[1] - k)
                share = np.exp(logs[k, at] + ahead[at] + behind[at + k + 1] - ahead[-1]) * times[group]
                seen += np.bincount(arcs[k, at].ravel() % len(weights), share.ravel(), minlength=len(weights))
        total += seen[: len(total)]
        for ids, n in zip(lattice.spelt, seen[len(total) : -1]):
            np.add.at(total, ids, n)
    return total
