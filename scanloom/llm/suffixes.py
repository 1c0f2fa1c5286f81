"""Repeated byte strings across documents, by ranks of content-chosen positions.

Every position of a text would have to be ranked by its first bytes, then by
pairs of ranks at growing offsets, until its rank is unique or covers the
threshold. Positions are dropped as early as that allows:

1. Each string of ``threshold`` bytes is represented by its anchor, the prefix
   of ``ANCHOR`` bytes within it that has the least hash. Equal strings have
   equal anchors at equal places, so one rank per anchor stands for the run of
   about sixteen positions it represents.
2. Anchors are ranked by their own bytes, and at once by the pair with all bytes
   of their run. A rank of the pair that a smaller document has too settles the
   whole run; an anchor that no smaller document has is unique, and its run
   drops out.
   Anchors that would fill a task are counted before; their runs are not dealt
   but stay open.
3. Only positions of runs that are open after that (the ends of repeated
   passages) are ranked one by one, by the pair of the ranks of their first and
   second half; the pair covers the threshold. They are dealt by the pair, and of
   equal pairs only those of a task's smallest document move.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanloom.llm.common import map_arrow, settings, text_of
from scanloom.plans.stage import stage

THRESHOLD = 50
ANCHOR = 20
_BASE = 0x9E3779B97F4A7C15
_PIECE = 1 << 18
_FLUSH = 240_000
#: Compressed text for one part of the ranks, and the most parts.
_PART_BYTES, _MOST_PARTS = 2 << 20, 1 << 20
_LAST = (1 << 63) - 1
#: The bucket column alone may place both sides of a join; batches that hold whole texts are small.
_SETTINGS = {
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}
_MARKS = "row long, first long, n int, kind int"
_BLOBS = "part int, kind int, blob binary"
_CUT = "row long, doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
#: Kinds of marked runs: starts whose string a smaller document has, and starts still to be ranked.
SETTLED, OPEN = 1, 2


class _Hashes:
    """Hashes of any span of a byte array, from sums of weighted bytes modulo 2^64."""

    def __init__(self, longest: int = 2 * _PIECE):
        self._up = np.cumprod(np.full(longest, _BASE, np.uint64))
        self._down = np.cumprod(np.full(longest, pow(_BASE, -1, 1 << 64), np.uint64))
        self._letters = np.random.default_rng(20240612).integers(1 << 63, size=256, dtype=np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._letters[raw] * self._up[: len(raw)])])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self._down[start])


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


_shared: list[_Hashes] = []


def _hashes() -> _Hashes:
    if not _shared:
        _shared.append(_Hashes())
    return _shared[0]


def pieces(texts: Iterable[bytes], threshold: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray]]:
    """Bytes of several texts (or of a part of a long one), with the valid starts: which text, place there, place here."""
    held, which, offset, size = [], [], [], 0

    def flush():
        joined = b"".join(held)
        lengths = np.array([len(h) for h in held])
        here = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        starts = np.maximum(lengths - threshold + 1, 0)
        at = np.repeat(here, starts) + (np.arange(starts.sum()) - np.repeat(np.cumsum(starts) - starts, starts))
        return joined, np.repeat(which, starts), at - np.repeat(here - np.array(offset), starts), at

    for i, text in enumerate(texts):
        for lo in range(0, max(0, len(text) - threshold + 1), _PIECE - threshold):
            part = text[lo : lo + _PIECE - 1]  # parts overlap, each start belongs to one
            held.append(part)
            which.append(i)
            offset.append(lo)
            size += len(part)
            if size >= _PIECE - threshold:
                yield flush()
                held, which, offset, size = [], [], [], 0
    if held:
        yield flush()


def runs(texts: Iterable[bytes], threshold: int = THRESHOLD, anchor: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of starts that share an anchor: text, first start, number of starts, and ranks.

    The ranks are those of the anchor, of the run, and (8 bits, 0 if the run
    does not reach so far) of half the bytes that a string has besides its
    anchor, to the left and to the right of it: two strings with one anchor are
    equal only if their runs agree on one of the two.
    """
    hashes, window, half = _hashes(), threshold - anchor + 1, (threshold - anchor + 1) // 2
    for joined, which, place, at in pieces(texts, threshold):
        raw = np.frombuffer(joined, np.uint8)
        sums = hashes.sums(raw)
        grams = np.arange(len(raw) - anchor + 1)
        ranks = hashes.spans(sums, grams, grams + anchor)
        low = np.uint64((1 << 21) - 1)
        least, width = (ranks & ~low) | grams.astype(np.uint64), 1
        while width < window:
            step = min(width, window - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        chosen = (least[at] & low).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
        n = np.diff(np.append(new, len(at)))
        whole = hashes.spans(sums, at[new], at[new] + n + threshold - 1)
        inside = (chosen[new] - at[new]).astype(np.uint64) * np.uint64(_BASE)
        at_anchor, stop = chosen[new], at[new] + n + threshold - 1
        sides = []
        for lo, hi in ((at_anchor - half, at_anchor), (at_anchor + anchor, at_anchor + anchor + half)):
            inner = (lo >= at[new]) & (hi <= stop)
            side = np.zeros(len(new), np.uint8)
            side[inner] = hashes.spans(sums, lo[inner], hi[inner]) % np.uint64(255) + np.uint64(1)
            sides.append(side)
        # Anchors have the least hashes of their windows, so they are mixed again before they are dealt.
        yield which[new], place[new], n, _mixed(ranks[at_anchor] * np.uint64(_BASE)), whole ^ inside, *sides


#: Packed runs: rank of the anchor (40 bits besides those of the part) and of the run (48 bits), sides, document, row, place.
_RUN = ("<u4", "u1", "<u4", "<u2", "u1", "u1", "<i8", "<i8", "<u4", "u1")
#: Packed starts: ranks of the halves (48 bits each), document, row, place.
_START = ("<u4", "<u2", "<u4", "<u2", "<i8", "<i8", "<u4")
#: Packed marks: row, place, number of starts.
_MARK = ("<i8", "<u4", "<u4")


def _pack(cols: list[np.ndarray], types: tuple[str, ...]) -> bytes:
    raw = b"".join(np.ascontiguousarray(c).astype(t).tobytes() for c, t in zip(cols, types))
    return len(cols[0]).to_bytes(4, "little") + zstd.ZstdCompressor(level=1).compress(raw)


def _unpack(blob: bytes, types: tuple[str, ...]) -> list[np.ndarray]:
    n, raw, at, cols = int.from_bytes(blob[:4], "little"), _inflate(blob[4:]), 0, []
    for t in types:
        size = n * np.dtype(t).itemsize
        cols.append(np.frombuffer(raw[at : at + size], t))
        at += size
    return cols


def _inflate(packed: bytes) -> bytes:
    return zstd.ZstdDecompressor().decompress(packed)


def _by_part(part: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
    some = some[np.argsort(part[some], kind="stable")]
    return np.split(some, np.flatnonzero(np.diff(part[some])) + 1) if len(some) else []


def _blobs(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [(), (), ()]
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["part", "kind", "blob"])


def _later(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Which rows share all their keys with a row of a smaller document."""
    order = np.lexsort((doc, *keys))
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    out = np.zeros(len(doc), bool)
    out[order] = doc[order] > doc[order][np.flatnonzero(new)][np.cumsum(new) - 1]
    return out


def _words(rank: np.ndarray) -> list[np.ndarray]:
    """The low 48 bits of a rank, as packed."""
    return [rank & np.uint64(0xFFFFFFFF), rank >> np.uint64(32) & np.uint64(0xFFFF)]


def _whole(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return low.astype(np.uint64) | high.astype(np.uint64) << np.uint64(32)


def _settled_here(row, first, n, kind: int, parts: int) -> list[tuple[int, int, bytes]]:
    """One blob of marks that meet nothing else, for any part; marks that follow each other in a text are put together."""
    if not len(row):
        return []
    new = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (first[1:] != first[:-1] + n[:-1])]))
    row, first, n = row[new], first[new], np.add.reduceat(n.astype(np.int64), new)
    any_part = _mixed(np.array([row[0], first[0]]).astype(np.uint64) * np.uint64(_BASE)).sum() % np.uint64(parts)
    return [(int(any_part), kind, _pack([row, first, n], _MARK))]


def _part_of(rank: np.ndarray, parts: int) -> np.ndarray:
    return ((rank >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _counts(parts: int, threshold: int, anchor: int):
    """Runs of different content per anchor, of anchors with a fair share of a task's runs; those of a null anchor are all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            a, whole = (np.concatenate(c) for c in zip(*held))
            held.clear()
            order = np.lexsort((whole, a))
            a, whole = a[order], whole[order]
            a = a[np.concatenate([[True], (a[1:] != a[:-1]) | (whole[1:] != whole[:-1])])]
            head = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
            n = np.diff(np.append(head, len(a)))
            much = (n > 1) & (n * 2 * parts >= len(a))
            anchors = pa.array([None, *a[head][much].view(np.int64).tolist()], pa.int64())
            sizes = pa.array([len(a), *n[much].tolist()], pa.int64())
            return pa.RecordBatch.from_arrays([anchors, sizes], ["anchor", "n"])

        for batch in batches:
            for _, _, _, a, whole, _, _ in runs(map(_inflate, batch.column(0).to_pylist()), threshold, anchor):
                held.append([a, whole])
                size += len(a)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def hot_anchors(packed: DataFrame, parts: int, threshold: int, anchor: int) -> np.ndarray:
    """Sorted ranks of the anchors with as many runs as an average part, at most ``2 * parts``.

    An anchor with that share of all runs has half of it within the groups of runs where its share is at least half
    of that, so it is enough that tasks report those.
    """
    counts = map_arrow(packed, _counts(parts, threshold, anchor), "anchor long, n long")
    counts = stage(counts.groupBy("anchor").agg(F.sum("n").alias("n")), "anchor-counts")
    total = counts.where(F.col("anchor").isNull()).first()
    if total is None:
        return np.zeros(0, np.uint64)
    hot = counts.where(F.col("anchor").isNotNull() & (F.col("n") * 2 * parts >= total.n)).select("anchor")
    return np.sort(np.array([r.anchor for r in hot.collect()], np.int64).view(np.uint64))


def _deal(parts: int, threshold: int, anchor: int, hot: np.ndarray):
    """Runs dealt to ``parts`` by the rank of their anchor, packed; other kinds hold marks of runs that need not meet others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def flush():
            a, whole, left, right, doc, row, first, n = (np.concatenate(c) for c in zip(*held))
            held.clear()
            # Of runs with one content only those of the smallest document go on to be ranked.
            settled = _later((whole, a), doc)
            still = ~settled & (hot[np.searchsorted(hot, a).clip(max=len(hot) - 1)] == a) if len(hot) else np.zeros(len(a), bool)
            part, rows = _part_of(a, parts), []
            for g in _by_part(part, np.flatnonzero(~(settled | still))):
                ranks = [a[g] & np.uint64(0xFFFFFFFF), a[g] >> np.uint64(32) & np.uint64(0xFF), *_words(whole[g])]
                rows.append((int(part[g[0]]), 0, _pack([*ranks, left[g], right[g], doc[g], row[g], first[g], n[g]], _RUN)))
            for kind, some in ((SETTLED, settled), (OPEN, still)):
                rows += _settled_here(row[some], first[some], n[some], kind, parts)
            return _blobs(rows)

        for batch in batches:
            ids, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts = map(_inflate, batch.column(2).to_pylist())
            for which, first, n, a, whole, left, right in runs(texts, threshold, anchor):
                held.append([a, whole, left, right, docs[which], ids[which], first, n])
                size += len(a)
                if size >= _FLUSH:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return run


def _marks(row, first, n, kind: int) -> Iterator[pa.RecordBatch]:
    cols = [pa.array(np.asarray(row, np.int64)), pa.array(first.astype(np.int64)), pa.array(n.astype(np.int32))]
    cols.append(pa.array(np.full(len(row), kind, np.int32)))
    for lo in range(0, len(row), 100_000):
        yield pa.RecordBatch.from_arrays([c.slice(lo, 100_000) for c in cols], ["row", "first", "n", "kind"])


def _several(keys: tuple[np.ndarray, ...], doc: np.ndarray) -> np.ndarray:
    """Which rows share their keys with a row of another document."""
    order = np.lexsort(keys)
    new = np.concatenate([[True], np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)])
    at, heads = np.cumsum(new) - 1, np.flatnonzero(new)
    sorted_ = doc[order]
    out = np.zeros(len(doc), bool)
    out[order] = (np.minimum.reduceat(sorted_, heads) < np.maximum.reduceat(sorted_, heads))[at]
    return out


def _rank_runs(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Settle or open the runs of one part; see the module's second step."""
    low, high, low_c, high_c, left, right, doc, row, first, n = (np.concatenate(c) for c in zip(*held))
    a, whole = _whole(low, high), _whole(low_c, high_c)
    later = _later((whole, a), doc)
    yield from _marks(row[later], first[later], n[later], SETTLED)
    a, left, right, doc, row, first, n = (x[~later] for x in (a, left, right, doc, row, first, n))
    still = np.zeros(len(a), bool)
    for side in (left, right):
        some = np.flatnonzero(side)
        if len(some):
            still[some] |= _several((side[some], a[some]), doc[some])
    yield from _marks(row[still], first[still], n[still], OPEN)


def _rank_starts(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Starts whose pair of ranks a smaller document has."""
    low, high, low_2, high_2, doc, row, first = (np.concatenate(c) for c in zip(*held))
    later = _later((_whole(low_2, high_2), _whole(low, high)), doc)
    yield from _marks(row[later], first[later], np.ones(later.sum(), np.int32), SETTLED)


def _per_part(types: tuple[str, ...], rank):
    """Apply ``rank`` to all packed rows of a part; parts come in runs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if kind:
                    yield from _marks(*_unpack(blob, _MARK), kind)
                    continue
                cols = _unpack(blob, types)
                if part != last and held:
                    yield from rank(held)
                    held = []
                last = part
                held.append(cols)
        if held:
            yield from rank(held)

    return run


def _expand(parts: int, threshold: int):
    """Open starts with the ranks of their halves, dealt to ``parts`` by both, packed; kind 1 holds those settled here."""
    half = threshold // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size = _hashes(), [], 0

        def flush():
            one, two, doc, row, first = (np.concatenate(c) for c in zip(*held))
            held.clear()
            settled = _later((two, one), doc)
            part = _part_of(_mixed(one * np.uint64(_BASE) + two), parts)
            rows = []
            for g in _by_part(part, np.flatnonzero(~settled)):
                rows.append((int(part[g[0]]), 0, _pack([*_words(one[g]), *_words(two[g]), doc[g], row[g], first[g]], _START)))
            ones = np.ones(settled.sum(), np.int64)
            return _blobs(rows + _settled_here(row[settled], first[settled], ones, SETTLED, parts))

        for batch in batches:
            ids, docs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, (first, n) in enumerate(_spans(batch.column(3))):
                text = _inflate(batch.column(2)[i].as_py())
                within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                starts = np.unique(np.repeat(first, n) + within)
                for lo in range(0, len(text), _PIECE):
                    some = starts[(starts >= lo) & (starts < lo + _PIECE)] - lo
                    if not len(some):
                        continue
                    sums = hashes.sums(np.frombuffer(text[lo : lo + _PIECE + threshold], np.uint8))
                    one, two = hashes.spans(sums, some, some + half), hashes.spans(sums, some + half, some + threshold)
                    held.append([one, two, np.full(len(some), docs[i]), np.full(len(some), ids[i]), some + lo])
                    size += len(some)
                    if size >= _FLUSH:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    return run


def _deflate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstd.ZstdCompressor(level=3).compress
    for batch in batches:
        texts = pa.array([pack(t.encode()) for t in batch.column(2).to_pylist()], pa.binary())
        cols = [batch.column(0), batch.column(1), texts, batch.column(3)]
        yield pa.RecordBatch.from_arrays(cols, ["row", "doc", "packed", "rest"])


def _spans(column: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts and lengths of every row's runs; none for a null row."""
    first, n = (column.values.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
    offsets, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    for lo, hi, ok in zip(offsets, offsets[1:], known):
        yield (first[lo:hi], n[lo:hi]) if ok else (first[:0], n[:0])


def removed_runs(first: np.ndarray, n: np.ndarray, threshold: int) -> list[tuple[int, int]]:
    """Maximal byte ranges covered by the strings that start in the runs."""
    if not len(first):
        return []
    order = np.argsort(first, kind="stable")
    lo, hi = first[order], np.maximum.accumulate(first[order] + n[order] - 1 + threshold)
    new = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[new].tolist(), hi[np.append(new[1:], len(lo)) - 1].tolist()))


def kept_bytes(raw: bytes, removed: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for lo, hi in removed:
        parts.append(raw[at:lo])
        at = hi
    return b"".join([*parts, raw[at:]])


class _Texts:
    """The texts of a table, compressed, with a row number each, in a table bucketed by the task that wrote them.

    A later join on (pid, row) moves only what is joined to the texts, never
    the texts.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, carry: list[str]):
        self.spark = docs.sparkSession
        rest = F.struct(*[F.col(f"`{c}`") for c in carry]) if carry else F.struct(F.lit(None).cast("int").alias("none"))
        rows = docs.select(
            F.monotonically_increasing_id().alias("row"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("doc"),
            text_of(text_col).alias("text"),
            rest.alias("rest"),
        )
        self.rest = T.StructField("rest", rows.schema["rest"].dataType)
        schema = T.StructType([*T._parse_datatype_string("row long, doc long, packed binary"), self.rest])
        packed = map_arrow(rows, _deflate, schema).withColumn("pid", _pid("row"))
        self.name = f"scanloom_texts_{uuid.uuid4().hex}"
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        packed.write.options(**{"compression": "uncompressed", "parquet.block.size": str(16 << 20)}).bucketBy(buckets, "pid").saveAsTable(self.name)
        self.rows = self.spark.table(self.name)

    def join(self, other: DataFrame, how: str) -> DataFrame:
        """The texts joined with ``other`` on row; ``other`` has one row per text at most."""
        return self.rows.join(other.withColumn("pid", _pid("row")), ["pid", "row"], how)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")


def _pid(row: str):
    return F.shiftright(row, 33).cast("int")


def repeated_starts(texts: _Texts, threshold: int, anchor: int) -> DataFrame:
    """Runs of starts (row, first, n) whose string of ``threshold`` bytes also starts in a smaller document."""
    conf = int(texts.spark.conf.get("spark.sql.shuffle.partitions"))
    size = texts.rows.agg(F.sum(F.octet_length("packed").cast("long"))).first()[0] or 0
    parts = min(_MOST_PARTS, max(conf, math.ceil(size / _PART_BYTES)))
    hot = hot_anchors(texts.rows.select("packed"), parts, threshold, anchor)
    dealt = map_arrow(texts.rows.select("row", "doc", "packed"), _deal(parts, threshold, anchor, hot), _BLOBS)
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    marks = stage(map_arrow(dealt, _per_part(_RUN, _rank_runs), _MARKS), "ranked-runs")
    todo = marks.filter(F.col("kind") == OPEN).groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    some = texts.join(todo, "inner").select("row", "doc", "packed", "spans")
    starts = map_arrow(some, _expand(parts, threshold), _BLOBS)
    starts = starts.repartitionById(parts, F.col("part")).sortWithinPartitions("part")
    found = map_arrow(starts, _per_part(_START, _rank_starts), _MARKS)
    return marks.filter(F.col("kind") == SETTLED).drop("kind").union(found.drop("kind"))


def _cut(threshold: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, docs = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (row, doc, spans) in enumerate(zip(ids, docs, _spans(batch.column(3)))):
                raw = _inflate(batch.column(2)[i].as_py())
                removed = removed_runs(*spans, threshold)
                kept = kept_bytes(raw, removed)
                text = kept_text(raw, removed) if with_text else None
                total = sum(hi - lo for lo, hi in removed)
                rows.append((row, None if doc == _LAST else doc, len(raw), total, len(removed), hashlib.sha256(kept).hexdigest(), text))
            cols = list(zip(*rows)) if rows else [()] * 7
            types = [pa.int64()] * 5 + [pa.string()] * 2
            cut = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays(
                [*cut, batch.column(4)], [*(f.split()[0] for f in _CUT.split(", ")), "rest"]
            )

    return run


def kept_text(raw: bytes, removed: list[tuple[int, int]]) -> str:
    """What is left as text: a character that is removed in part stays whole."""
    inner = []
    for lo, hi in removed:
        while lo < hi and raw[lo] & 0xC0 == 0x80:  # the character began before
            lo += 1
        while hi > lo and hi < len(raw) and raw[hi] & 0xC0 == 0x80:  # the character ends later
            hi -= 1
        inner.append((lo, hi))
    return kept_bytes(raw, inner).decode()


def remove_repeats(
    docs: DataFrame,
    threshold: int = THRESHOLD,
    anchor: int = ANCHOR,
    with_text: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Remove every byte covered by a string of ``threshold`` bytes that also starts in a document with a smaller id.

    Texts are UTF-8 bytes; strings are judged on the input, and matches do not
    cross documents. Texts are written once, compressed, where they are read;
    what moves is ranks: about twelve bytes for each run of positions, in blobs
    dealt by the rank of the anchor, and of runs with one content only those of
    a task's smallest document, so a passage that a third of all documents share
    moves once per task. Anchors that would fill a part of their own (a line in
    many documents with different surroundings) are counted first and not dealt;
    all places of their runs are ranked by the pair of their halves.

    Returns row (a number), doc_id, n_bytes, n_removed, n_spans (maximal removed
    runs), kept_sha256 and text (what is left, without cutting characters, if
    ``with_text``) and rest (a struct of the columns ``carry``), a row per row. Null texts are empty, null ids count as the
    largest; rows of one id do not remove from each other; an empty table gives
    no rows. Ranks are hashes of 40 bits and more within groups that agree on
    others; two different strings meet in one with negligible chance.
    """
    if not 0 < threshold - anchor + 1 < 256:
        raise ValueError("a string may have 1 to 255 anchors")
    with settings(docs.sparkSession, _SETTINGS):
        texts = _Texts(docs, id_col, text_col, list(carry))
        try:
            found = repeated_starts(texts, threshold, anchor)
            spans = found.groupBy("row").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
            cut = _cut(threshold, with_text)
            schema = T.StructType([*T._parse_datatype_string(_CUT), texts.rest])
            rows = texts.join(spans, "left").select("row", "doc", "packed", "spans", "rest")
            return stage(map_arrow(rows, cut, schema), "kept")
        finally:
            texts.drop()
