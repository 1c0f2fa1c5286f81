"""Product codes of vectors: k-means over Hilbert-sorted blocks with boxes, exact in integers.

The vectors of each part position are sorted along a Hilbert curve and cut into
flat blocks that keep their bounding box and their sum. A round compares the box
with the codebook: entries whose least distance from the box exceeds the greatest
of another cannot be nearest to anything inside. Only the rest is compared with
the vectors, and a block with one entry left is settled by its stored sum.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow
from scanloom.plans.stage import attach, stage

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
BLOCK = 256
_MOST = 2**62  # components beyond are held there
_WIDE = 2**63 - 1

_POINTS = "rid long, vec_id long, label string, part int, key long, vector binary, wide boolean"


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x) of finite floats, as 64-bit integers."""
    return np.clip(np.floor(values.astype(np.float64) * SCALE), -_MOST, _MOST).astype(np.int64)


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places along a Hilbert curve of cells (rows of integers below 2**bits), ``bits`` times columns at most 63.

    Axes are turned level by level from the highest bit down: where a bit is set
    the lower bits of the first axis are inverted, else exchanged with those of
    that axis; a Gray code over the axes then gives the bits of the place.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            on = (x[axis] >> level) & 1 == 1
            swap = np.where(on, 0, (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(on, low, swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    turn = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[n - 1] >> level) & 1 == 1, (1 << level) - 1, 0)
    x ^= turn
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            key = (key << 1) | ((x[axis] >> level) & 1)
    return key


def _kind(bound: int, width: int):
    """The narrowest exact arithmetic for squared distances of components up to ``bound``: floats, integers or Python's."""
    most = 4 * bound * bound * width
    return np.float64 if most < 2**52 else np.int64 if most < 2**62 else object


def nearest(points: np.ndarray, book: np.ndarray, shortlist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each point among ``shortlist`` (ascending), ties to the lower, and its squared distance."""
    bound = max(int(np.abs(points).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = _kind(bound, points.shape[1])
    p, c = points.astype(kind), book[shortlist].astype(kind)
    far = (c * c).sum(axis=1)[None, :] - 2 * (p @ c.T)
    best = np.argmin(far, axis=1)
    return shortlist[best], far[np.arange(len(p)), best] + (p * p).sum(axis=1)


def shortlist(low: np.ndarray, high: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Entries that may be nearest to a point of the box, ascending; none that could tie is missing."""
    bound = max(int(np.abs(low).max(initial=0)), int(np.abs(high).max(initial=0)), int(np.abs(book).max(initial=0)))
    kind = _kind(bound, book.shape[1])
    c, a, b = book.astype(kind), low.astype(kind), high.astype(kind)
    gap = np.maximum(np.maximum(a - c, c - b), kind(0) if kind is not object else 0)
    reach = np.maximum(np.abs(c - a), np.abs(b - c))
    return np.flatnonzero((gap * gap).sum(axis=1) <= (reach * reach).sum(axis=1).min())


def _block(row: dict) -> np.ndarray:
    return np.frombuffer(row["vectors"], np.int64 if row["wide"] else np.int16).reshape(row["count"], -1)


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int64)


def _points_of(low: np.ndarray, high: np.ndarray, parts: int):
    """Cuts every vector into its parts and gives each its place along the curve of its position."""
    dims = len(low) // parts
    used = min(dims, 63)
    bits = max(1, min(8, 63 // used))
    span = np.maximum(high - low, 1e-30)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            values = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            ints = _integers(values)
            cells = np.clip((values.astype(np.float64) - low) / span * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
            wide = np.abs(ints).max(initial=0) > 2**15 - 1
            flat = ints if wide else ints.astype(np.int16)
            nothing = pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())
            for part in range(parts):
                mine = slice(part * dims, (part + 1) * dims)
                vec_id, label = (batch.column("vec_id"), batch.column("label")) if part == 0 else nothing
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("rid"),
                        vec_id,
                        label,
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(hilbert_keys(cells[:, mine][:, :used], bits)),
                        pa.array([r.tobytes() for r in np.ascontiguousarray(flat[:, mine])], pa.binary()),
                        pa.array(np.full(n, wide)),
                    ],
                    names=["rid", "vec_id", "label", "part", "key", "vector", "wide"],
                )

    return run


_BLOCK_SCHEMA = (
    "part int, count int, wide boolean, rids binary, vec_ids array<bigint>, labels array<string>, "
    "vectors binary, low binary, high binary, sums array<decimal(38,0)>"
)


def _sums(vectors: np.ndarray, wide: bool) -> list[int]:
    return [int(x) for x in (vectors.astype(object) if wide else vectors.astype(np.int64)).sum(axis=0)]


def _blocks_of(size: int):
    """Cuts sorted points into flat blocks of at most ``size`` of one part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [
                ("part", pa.int32()),
                ("count", pa.int32()),
                ("wide", pa.bool_()),
                ("rids", pa.binary()),
                ("vec_ids", pa.list_(pa.int64())),
                ("labels", pa.list_(pa.string())),
                ("vectors", pa.binary()),
                ("low", pa.binary()),
                ("high", pa.binary()),
                ("sums", pa.list_(pa.decimal128(38, 0))),
            ]
        )
        for batch in batches:
            part = batch.column("part").to_numpy(zero_copy_only=False)
            wides = batch.column("wide").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero((np.diff(part) != 0) | (np.diff(wides.astype(np.int8)) != 0)) + 1
            out = []
            for a, b in zip([0, *edges], [*edges, batch.num_rows]):
                for at in range(a, b, size):
                    n = min(size, b - at)
                    piece = batch.slice(at, n)
                    wide = bool(wides[at])
                    flat = b"".join(piece.column("vector").to_pylist())
                    vectors = np.frombuffer(flat, np.int64 if wide else np.int16).reshape(n, -1)
                    first = part[at] == 0
                    out.append(
                        {
                            "part": int(part[at]),
                            "count": n,
                            "wide": wide,
                            "rids": piece.column("rid").to_numpy().astype(np.int64).tobytes(),
                            "vec_ids": piece.column("vec_id").to_pylist() if first else None,
                            "labels": piece.column("label").to_pylist() if first else None,
                            "vectors": flat,
                            "low": vectors.min(axis=0).astype(np.int64).tobytes(),
                            "high": vectors.max(axis=0).astype(np.int64).tobytes(),
                            "sums": _sums(vectors, wide),
                        }
                    )
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _small(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield from batch.slice(at, rows).to_pylist()


def _round_of(books: list[np.ndarray]):
    """Counts and sums of what each entry attracts, one row per part and entry and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, object) for b in books]
        for row in _small(batches):
            part, book = row["part"], books[row["part"]]
            few = shortlist(_ints(row["low"]), _ints(row["high"]), book)
            if len(few) == 1:  # the whole block at once
                counts[part][few[0]] += row["count"]
                sums[part][few[0]] += np.array([int(s) for s in row["sums"]], object)
                continue
            vectors = _block(row)
            code, _ = nearest(vectors, book, few)
            order = np.argsort(code, kind="stable")
            entries, starts, n = np.unique(code[order], return_index=True, return_counts=True)
            wide = vectors.astype(object) if row["wide"] else vectors.astype(np.int64)
            counts[part][entries] += n
            sums[part][entries] += np.add.reduceat(wide[order], starts, axis=0).astype(object)
        used = [(p, e) for p in range(len(books)) for e in np.flatnonzero(counts[p])]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in used], pa.int32()),
                pa.array([int(e) for _, e in used], pa.int32()),
                pa.array([int(counts[p][e]) for p, e in used], pa.int64()),
                pa.array([[Decimal(int(s)) for s in sums[p][e]] for p, e in used], pa.list_(pa.decimal128(38, 0))),
            ],
            names=["part", "entry", "count", "sums"],
        )

    return run


def _codes_of(books: list[np.ndarray]):
    """Entry and squared distance of every part, with the ids of the vector on its first part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _small(batches):
            book = books[row["part"]]
            few = shortlist(_ints(row["low"]), _ints(row["high"]), book)
            code, far = nearest(_block(row), book, few)
            n = row["count"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(_ints(row["rids"])),
                    pa.array(np.full(n, row["part"], np.int32)),
                    pa.array(code.astype(np.int32)),
                    pa.array([Decimal(int(x)) for x in far], pa.decimal128(38, 0)),
                    pa.array(row["vec_ids"] or [None] * n, pa.int64()),
                    pa.array(row["labels"] or [None] * n, pa.string()),
                ],
                names=["rid", "part", "code", "far", "vec_id", "label"],
            )

    return run


def first_books(kept: DataFrame, parts: int, entries: int) -> list[np.ndarray]:
    """The codebooks to start from: the parts of the vectors with the smallest ids, a bounded number of rows."""
    order = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    first = _integers(np.array([r.v for r in kept.orderBy(*order).limit(entries).select("v").collect()], np.float64))
    return list(np.split(first, parts, axis=1))


def learn_codebooks(blocks: DataFrame, books: list[np.ndarray], rounds: int) -> list[np.ndarray]:
    """``rounds`` rounds of assignment and floored means; an entry that attracts nothing stays."""
    dims = books[0].shape[1]
    for _ in range(rounds):
        found = map_arrow(blocks, _round_of(books), "part int, entry int, count long, sums array<decimal(38,0)>")
        total = [F.sum(F.col("sums")[d]).alias(f"s{d}") for d in range(dims)]
        books = [b.copy() for b in books]
        for r in found.groupBy("part", "entry").agg(F.sum("count").alias("count"), *total).collect():  # parts x entries rows
            books[r.part][r.entry] = [int(r[f"s{d}"]) // r["count"] for d in range(dims)]
    return books


def digest_of(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, with commas between."""
    return hashlib.sha256(",".join(str(int(x)) for book in books for x in book.ravel()).encode()).hexdigest()


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """Code of every vector, its error, the error of its label, and the digest of the codebooks.

    Components count as floor(1024 x). Each of ``parts`` equal parts has its own
    codebook of ``entries`` (at most 256) integer vectors, which starts as the
    parts of the vectors with the smallest ids and goes through ``rounds``
    rounds of exact assignment, ties to the lower index, and floored means.

    Returns vec_id, code (two hexadecimal digits a part), error (sum of the
    squared distances), label_error (sum of errors of the label's vectors),
    codebooks_sha256 and label.

    Null vectors, and those with a null, NaN or infinite component, are left
    out. The smallest id's vector sets the length (of which the number of parts
    must be a divisor, else it raises); vectors of another length are left out
    too, as no code fits them. Null ids come after all others and null labels
    are one label; rows of equal ids count one by one, in the order of their
    vectors. With fewer vectors than entries the codebooks are shorter.
    Components beyond 2^62 are held there, sums of errors beyond 2^63 - 1 too.
    An empty table gives no rows.

    A codebook is the only thing broadcast (parts x entries x length). Equal
    vectors are dealt by row, so a group of copies spreads over many blocks.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code of two hexadecimal digits has at most 256 entries")
    x = F.col(vector_col).cast("array<double>")
    finite = ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == F.lit(float("inf"))))
    kept = vectors.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), x.alias("v")
    ).filter(F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    label_type = vectors.schema[label_col].dataType
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), F.col("v")).first()
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if head is None:
        return vectors.sparkSession.createDataFrame([], schema).withColumn("label", F.lit(None).cast(label_type))
    if not head.v or len(head.v) % parts:
        raise ValueError(f"vectors of {len(head.v)} components cannot be cut into {parts} equal parts")
    kept = kept.filter(F.size("v") == len(head.v))

    books = first_books(kept, parts, entries)
    start = np.hstack(books) / SCALE
    points = map_arrow(
        kept.withColumn("rid", F.monotonically_increasing_id()), _points_of(start.min(axis=0), start.max(axis=0), parts), _POINTS
    )
    order = ["part", "wide", "key", "rid"]
    sorted_points = points.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stage(map_arrow(sorted_points, _blocks_of(block), _BLOCK_SCHEMA), "vector-blocks")
    books = learn_codebooks(blocks, books, rounds)

    codes = map_arrow(
        blocks, _codes_of(books), "rid long, part int, code int, far decimal(38,0), vec_id long, label string"
    )
    digits = [F.lpad(F.lower(F.hex(F.max(F.when(F.col("part") == p, F.col("code"))))), 2, "0") for p in range(parts)]
    widest = F.lit(_WIDE).cast("decimal(38,0)")
    rows = codes.groupBy("rid").agg(
        F.max("vec_id").alias("vec_id"),
        F.max("label").alias("label"),
        F.concat(*digits).alias("code"),
        F.least(F.sum("far"), widest).cast("long").alias("error"),
    )
    rows = stage(rows, "vector-codes")
    errors = rows.groupBy("label").agg(F.least(F.sum(F.col("error").cast("decimal(28,0)")), widest).cast("long").alias("label_error"))
    return attach(rows, errors, ["label"]).select(
        "vec_id",
        "code",
        "error",
        "label_error",
        F.lit(digest_of(books)).alias("codebooks_sha256"),
        F.col("label").cast(label_type).alias("label"),
    )
