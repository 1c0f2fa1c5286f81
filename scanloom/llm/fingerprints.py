"""Document fingerprints sensitive to edit distance: Order MinHash."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of

K = 8
SLOTS = 32
PER_SLOT = 2
_SEED = 20240611
_BASE = 0x9E3779B97F4A7C15
_MASK64 = (1 << 64) - 1
_COLUMNS = 1 << 15
_FIRST = -(1 << 63)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class OrderMinHash:
    """Signatures of ``slots`` 16-bit values over the character ``k``-mers of a text.

    For every slot the ``per_slot`` k-mers smallest under the slot's hash are
    taken, where the n-th occurrence of a k-mer counts as a k-mer of its own;
    they are put back in text order, and the tuple is hashed. Two texts agree in
    a slot if they share those k-mers in the same order.
    """

    def __init__(self, k: int = K, slots: int = SLOTS, per_slot: int = PER_SLOT):
        draw = np.random.default_rng(_SEED)
        self.k, self.per_slot = k, per_slot
        self._a = draw.integers(1 << 31, size=(slots, 1), dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self._b = draw.integers(1 << 32, size=(slots, 1), dtype=np.uint64).astype(np.uint32)
        self._salt = _mix(np.arange(1, slots + 1, dtype=np.uint64))

    def _kmers(self, text: str) -> np.ndarray:
        """Hashes of all k-mers; a shorter text is one k-mer."""
        codes = np.frombuffer(text.encode("utf-32-le"), "<u4").astype(np.uint64) + np.uint64(1)
        if not len(codes):
            return codes
        h, width, want = codes, 1, min(self.k, len(codes))
        while width < want:  # join neighbours; the last step may overlap
            step = min(width, want - width)
            factor = np.uint64(pow(_BASE, step, 1 << 64))
            tail = codes if step == 1 else self._span(codes, step)
            h = h[: len(codes) - width - step + 1] * factor + tail[width : width + len(codes) - width - step + 1]
            width += step
        return _mix(h)

    @staticmethod
    def _span(codes: np.ndarray, width: int) -> np.ndarray:
        h = np.zeros(len(codes) - width + 1, np.uint64)
        for i in range(width):
            h = h * np.uint64(_BASE) + codes[i : i + len(h)]
        return h

    def _numbered(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """32-bit hash of (k-mer, which occurrence), k-mer hash and place, of all occurrences, sorted by k-mer and place."""
        place = h.argsort(kind="stable")  # the whole hash is the k-mer's identity, whatever the text's length
        kmer = h[place]
        new = np.flatnonzero(np.concatenate([[True], kmer[1:] != kmer[:-1]]))
        nth = np.arange(len(h)) - np.repeat(new, np.diff(np.append(new, len(h))))
        return (_mix(kmer + nth.astype(np.uint64) * np.uint64(_BASE)) >> np.uint64(32)).astype(np.uint32), kmer, place

    def signature(self, text: str) -> np.ndarray:
        h = self._kmers(text)
        if not len(h):
            return np.zeros(len(self._salt), np.uint16)
        x, kmer, place = self._numbered(h)
        slots = np.arange(len(self._salt))[:, None]
        best, at = None, None
        for lo in range(0, len(x), _COLUMNS):  # bounded columns at a time; the smallest so far go along
            part = self._a * x[None, lo : lo + _COLUMNS] + self._b
            index = np.broadcast_to(np.arange(lo, lo + part.shape[1]), part.shape)
            if best is not None:
                part, index = np.hstack([best, part]), np.hstack([at, index])
            chosen = []
            for _ in range(min(self.per_slot, part.shape[1])):
                j = part.argmin(axis=1)[:, None]
                chosen.append((part[slots, j].copy(), index[slots, j]))
                part[slots, j] = np.uint32(0xFFFFFFFF)
            best, at = np.hstack([c[0] for c in chosen]), np.hstack([c[1] for c in chosen])
        at = np.take_along_axis(at, place[at].argsort(axis=1), axis=1)
        out = self._salt.copy()
        for column in at.T:
            out = _mix(out * np.uint64(31) + kmer[column])
        return (out & np.uint64(0xFFFF)).astype(np.uint16)


def as_text(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.mean(a == b))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by the first as many, or all, of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _compare(options: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = OrderMinHash(**options)
        names = [f.split()[0] for f in _OUT.split(", ")]
        last = None  # bucket, id, text, signature of the row that waits for its next

        def close(held, text, signature):
            _, doc, own, mine = held
            new = edited(own, text)
            theirs = mine if new == own else make.signature(new)
            digest = hashlib.sha256(new.encode()).hexdigest()
            return (doc, len(own), digest, as_text(mine), as_text(theirs), likeness(mine, theirs), likeness(mine, signature))

        for batch in batches:
            rows = []
            for bucket, extra, doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                if extra and (last is None or last[0] != bucket):
                    continue  # only the first row after a bucket counts
                signature = make.signature(text)
                if last is not None and last[0] == bucket:
                    rows.append(close(last, text, signature))
                last = None if extra else (bucket, doc, text, signature)
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names)

    return run


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Order MinHash of every whole text, and how it bears an edit.

    The edit puts the start of the next document, by descending id (after the
    last: the first), in place of the text's last half. Ids are cut at
    percentiles into as many ranges as there are shuffle partitions; texts move
    once, to the task of their range, and the rows with a range's highest id
    also to the range before it, so no task holds more than its range and two
    texts at a time.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (32
    16-bit values in hex), near_edited and near_next (share of equal values). A
    null text is empty; empty texts have the fingerprint zero. Rows with one id
    follow each other by a hash of their text; null ids come after all others. A
    single row is its own next. An empty table gives no rows.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(_FIRST))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [i / parts for i in range(1, parts)]
    found = docs.select(key.alias("key")).agg(F.max("key").alias("top"), F.percentile_approx("key", shares, 100_000).alias("at") if shares else F.array().cast("array<long>").alias("at")).first()
    tops = np.array(sorted({found["top"], *(found["at"] or [])} - {None}), np.int64)  # the highest id of each range

    @F.pandas_udf("int")
    def bucket_of(ids: pd.Series) -> pd.Series:
        return pd.Series(len(tops) - 1 - np.searchsorted(tops, ids.to_numpy()), dtype="int32")

    rows = docs.select(key.alias("key"), F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.withColumn("bucket", bucket_of("key"))
    own = F.struct(F.col("bucket").alias("bucket"), F.lit(0).alias("extra"))
    if len(tops):
        before = F.struct(F.expr(f"cast(pmod(bucket - 1, {len(tops)}) as int)").alias("bucket"), F.lit(1).alias("extra"))
        highest = F.col("key").isin(*tops.tolist())
        rows = rows.withColumn("to", F.explode(F.when(highest, F.array(own, before)).otherwise(F.array(own))))
    else:
        rows = rows.withColumn("to", own)
    dealt = (
        rows.select("to.bucket", "to.extra", "doc_id", "text", F.col("key"), F.xxhash64("text").alias("tie"))
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "extra", F.desc("key"), "tie")
        .select("bucket", "extra", "doc_id", "text")
    )
    return map_arrow(dealt, _compare(options), _OUT)
