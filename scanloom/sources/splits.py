"""Input splits of about equal cost: small files share a split, large ones are cut into ranges.

A split costs its bytes and, per file, what opening one costs. Splits have
``splitBytes`` at most; smaller inputs are dealt to ``minPartitions`` splits, but not
below 4 MB. Where a small ``splitBytes`` would give more than ``MOST_SPLITS``, files are
still cut so, but their parts share splits of up to ``SPLIT_BYTES``, as a task costs
more than a part. Files keep their order, so those of one folder stay together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql.datasource import InputPartition

from scanloom.sources.files import SPLIT_BYTES

#: Bytes that could be read while a file is opened.
OPEN_BYTES = 64 << 10
LEAST_BYTES = 4 << 20
PARTITIONS = 16
MOST_SPLITS = 1024


@dataclass
class Piece:
    """Part number ``part`` of ``parts`` equal parts of a file."""

    path: str
    size: int
    part: int
    parts: int

    def share(self, count: int) -> tuple[int, int]:
        """First and last (exclusive) of ``count`` records that belong to this part."""
        return count * self.part // self.parts, count * (self.part + 1) // self.parts


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece] = field(default_factory=list)


def shared_bytes(target: int, total: int) -> int:
    """Bytes of a split: ``target``, or so many that ``total`` makes ``MOST_SPLITS`` splits, but not above ``SPLIT_BYTES``."""
    return max(target, min(SPLIT_BYTES, -(-total // MOST_SPLITS)))


def pack(files: Sequence[tuple[str, int]], options: dict) -> list[Pieces]:
    """Splits for files with their sizes; one empty split if there is no file."""
    total = sum(size + OPEN_BYTES for _, size in files)
    wanted = max(1, int(options.get("minpartitions", PARTITIONS)))
    target = min(int(options.get("splitbytes", SPLIT_BYTES)), max(LEAST_BYTES, -(-total // wanted)))
    counts = [max(1, -(-size // target)) for _, size in files]
    shared = shared_bytes(target, sum(size for _, size in files) + OPEN_BYTES * sum(counts))
    splits: dict[int, Pieces] = {}
    done = 0
    for (path, size), parts in zip(files, counts):
        for i in range(parts):
            piece = Piece(path, size, i, parts)
            first, last = piece.share(size)
            cost = last - first + OPEN_BYTES
            splits.setdefault((done + cost // 2) // shared, Pieces()).pieces.append(piece)
            done += cost
    return list(splits.values()) or [Pieces()]
