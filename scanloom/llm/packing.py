"""Training sequences without padding: power-of-two decomposition of documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of
from scanloom.llm.tokens import ByteBpe
from scanloom.plans.stage import stage

MAX_TOKENS = 1024
END_ID = 0
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, pid int, nth long"
#: Pieces, and ids that go along, per batch that leaves a task.
_BATCH, _IDS = 20_000, 500_000


@lru_cache(maxsize=4)
def _tokenizer(path: str) -> ByteBpe:
    return ByteBpe(path)


def piece_lengths(n: int, longest: int) -> list[int]:
    """``n`` as pieces of ``longest``, then the powers of two of the rest, from large to small."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _cut(path: str, longest: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, pid = _tokenizer(path), TaskContext.get().partitionId()
        end, nth = END_ID.to_bytes(4, "little"), dict.fromkeys((1 << b for b in range(longest.bit_length())), 0)
        out: list[list] = [[] for _ in range(6 + with_ids)]
        held = 0

        def flush():
            cols = [pa.array(out[0], pa.int64()), *(pa.array(c, pa.int64()) for c in out[1:5])]
            cols += [pa.array([pid] * len(out[0]), pa.int32()), pa.array(out[5], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "pid", "nth"]
            if with_ids:
                offsets = np.concatenate([[0], np.cumsum(out[2])]).astype(np.int32)
                ids = np.frombuffer(b"".join(out[6]), "<i4")
                cols, names = [*cols, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], [*names, "ids"]
            for c in out:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(tokenizer.ids(text) + end)
                total, at = len(ids) // 4, 0
                for n in piece_lengths(total, longest):
                    part = ids[4 * at : 4 * (at + n)]
                    row = [doc, at, n, zlib.crc32(part), total, nth[n]] + ([bytes(part)] if with_ids else [])
                    for c, v in zip(out, row):
                        c.append(v)
                    nth[n] += 1
                    at += n
                    held += n if with_ids else 0
                    if len(out[0]) >= _BATCH or held >= _IDS:
                        yield flush()
                        held = 0
        yield flush()

    return run


def pack(
    docs: DataFrame,
    tokenizer: str,
    longest: int = MAX_TOKENS,
    with_ids: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Cut every document's ids into pieces of power-of-two length, each a sequence of its own.

    ``tokenizer`` is a byte-level BPE file; a document's ids are those of its
    text (null: empty) and an end id. ``longest`` is a power of two. Sequences
    of one length have consecutive ids, the longest first, so that a loader can
    take batches of equal length; no sequence crosses documents and none needs
    padding. Numbers come from counts per task and length, so no document
    leaves its task.

    Returns a row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset (0), and ids (array of int) if ``with_ids``. An empty
    text has one piece, its end id; null and repeated ids are packed like any
    other row; an empty table gives no rows.
    """
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    schema = _PIECES + (", ids array<int>" if with_ids else "")
    pieces = stage(map_arrow(texts, _cut(tokenizer, longest, with_ids), schema), "pieces")
    counts = pieces.groupBy("length", "pid").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("length"), "pid")
    bases = counts.select("length", "pid", (F.sum("__n").over(order) - F.col("__n")).alias("__base"))
    # A row per task and length: at most eleven per task for 1,024 tokens.
    return pieces.join(F.broadcast(bases), ["length", "pid"]).select(
        "doc_id",
        "start",
        "length",
        "ids_crc32",
        "doc_tokens",
        (F.col("__base") + F.col("nth")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
