"""WARC archives with a shared Zstandard dictionary: writer, reader, and the round trip of a page table.

An archive is a skippable frame that holds the dictionary, then one frame per
record, so that any record can be read from its offset and the dictionary.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanloom.llm.common import map_arrow, text_of
from scanloom.plans.stage import stage
from scanloom.sources.files import resolve

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MIN_REVISIT_BYTES = 100
DICTIONARY_BYTES = 64 << 10
SAMPLE_RECORDS, SAMPLE_BYTES = 512, 16 << 10
ARCHIVE_BYTES = 256 << 20
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
INDEX_SCHEMA = "path string, offset long, length long, page_id long, record_type string"
RECORD_SCHEMA = (
    "path string, offset long, page_id long, url string, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
_ROWS, _BYTES = 5_000, 16 << 20


def _urn(page_id: int | None) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    digits = (urn or "").strip("<>").rpartition(":")[2]
    return int(digits) if digits else None


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = [f"{k}: {v}" for k, v in [*fields, ("Content-Length", str(len(block)))]]
    return "\r\n".join(["WARC/1.1", *head, "", ""]).encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, refers_to, date: str = DATE) -> bytes:
    """A response with the payload, or a revisit with its headers only if ``refers_to`` is set."""
    kind = "response" if refers_to is None else "revisit"
    fields = [("WARC-Type", kind), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:  # a target may not break the header
        fields.append(("WARC-Target-URI", " ".join(url.split())))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", _urn(refers_to)), ("WARC-Profile", PROFILE)]
    fields.append(("Content-Type", "application/http; msgtype=response"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return _record(fields, http + payload if refers_to is None else http)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields by lower-case name, and the payload (without the HTTP head)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    block = rest[: int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2] if fields["warc-type"] in ("response", "revisit") else block


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary; too few samples to train on serve as they are."""
    try:
        return zstd.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstd.ZstdError:
        return b"".join(samples)[:size]


def _writer(folder: str, dictionary: bytes, archive_bytes: int, date: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = resolve(folder)
        pid, roll, out, at, temporary, final = TaskContext.get().partitionId(), 0, None, 0, "", ""
        shared = zstd.ZstdCompressionDict(dictionary)
        shared.precompute_compress(level=LEVEL)
        compressor = zstd.ZstdCompressor(dict_data=shared, level=LEVEL)

        def close():
            out.close()
            fs.move(temporary, final)

        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, payload, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is not None and at >= archive_bytes:
                    close()
                    out, roll = None, roll + 1
                if out is None:
                    final = f"{root}/part-{pid:06d}-{roll:04d}.warc.zst"
                    temporary = f"{root}/.{uuid.uuid4().hex}.tmp"  # a lost or second attempt never shows
                    out = fs.open_output_stream(temporary, compression=None)
                    info = _record(
                        [("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:x-archive:{pid}-{roll}>"), ("WARC-Date", date)],
                        b"software: scanloom\r\nformat: WARC File Format 1.1\r\n",
                    )
                    first = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary + compressor.compress(info)
                    out.write(first)
                    at = len(first)
                frame = compressor.compress(page_record(page_id, url, payload, digest, refers_to, date))
                out.write(frame)
                kind = "response" if refers_to is None else "revisit"
                rows.append((f"{folder}/{final.rpartition('/')[2]}", at, len(frame), page_id, kind))
                at += len(frame)
            yield _batch(rows, INDEX_SCHEMA)
        if out is not None:
            close()

    return run


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names = [f.split() for f in schema.split(", ")]
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, types[t]) for c, (_, t) in zip(cols, names)], [n for n, _ in names])


def frames(stream, chunk: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """Offset and content of every record of an open archive, one at a time."""
    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_MAGIC:
        raise ValueError("archive has no dictionary frame")
    decompressor = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(stream.read(size)))
    at, held = 8 + size, b""
    while True:
        held = held or stream.read(chunk)
        if not held:
            return
        one, parts, used = decompressor.decompressobj(), [], 0
        while True:
            parts.append(one.decompress(held))
            used += len(held)
            if one.eof:
                held = one.unused_data
                used -= len(held)
                break
            held = stream.read(chunk)
            if not held:
                raise ValueError("archive ends within a record")
        yield at, b"".join(parts)
        at += used


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, inner = resolve(path)
            rows: list[tuple] = []
            with fs.open_input_stream(inner, compression=None) as stream:
                for at, raw in frames(stream):
                    fields, payload = parse_record(raw)
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    digest, size = fields["warc-payload-digest"].partition(":")[2], int(fields["x-payload-length"])
                    if kind == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
                        raise ValueError(f"{path} at {at}: payload differs from its digest")
                    page, first = _page(fields["warc-record-id"]), _page(fields.get("warc-refers-to"))
                    rows.append((path, at, page, fields.get("warc-target-uri"), size, digest, kind, first))
                    if len(rows) >= _ROWS:
                        yield _batch(rows, RECORD_SCHEMA)
                        rows = []
            yield _batch(rows, RECORD_SCHEMA)


def read_archives(paths: DataFrame) -> DataFrame:
    """The records of the archives in column ``path``, one task an archive, each payload checked against its digest."""
    spark = paths.sparkSession
    spread = paths.select("path").repartition(max(1, paths.count()), "path")
    return map_arrow(spread, _reader, RECORD_SCHEMA)


def write_archives(
    pages: DataFrame,
    folder: str,
    archive_bytes: int = ARCHIVE_BYTES,
    date: str = DATE,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
) -> DataFrame:
    """Write every page as a WARC record below ``folder`` and return the index of records.

    Of pages with equal payloads of at least ``MIN_REVISIT_BYTES`` bytes the one
    with the smallest id is a response and the others revisit it; shorter ones
    are responses. Groups are found on (id, digest, length) rows, so pages never
    gather by content; only revisits are joined back to their page. The
    dictionary is trained once, on the first ``SAMPLE_BYTES`` of the
    ``SAMPLE_RECORDS`` responses that come first by a digest (it changes sizes
    only, no content). A task writes archives of about ``archive_bytes`` under
    temporary names and renames them when whole, so an attempt that is lost
    leaves no archive and one that is repeated replaces its own.

    A null payload is empty; a null url gives no target; a null id counts as
    the largest. Rows that repeat id and payload are alike (all response or all
    revisit). An empty table writes no archive.
    """
    spark = pages.sparkSession
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        text_of(payload_col).cast("binary").alias("payload"),
        F.sha2(text_of(payload_col).cast("binary"), 256).alias("digest"),
    )
    keys = rows.filter(F.octet_length("payload") >= MIN_REVISIT_BYTES).select("page_id", "digest")
    firsts = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    firsts = firsts.filter((F.col("n") > 1) & F.col("refers_to").isNotNull()).drop("n")
    marks = stage(
        keys.join(firsts, "digest").filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).distinct(), "revisits"
    ).withColumnsRenamed({"page_id": "__page", "digest": "__digest"})
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("digest") == F.col("__digest"))
    marked = rows.join(marks, same, "left").select("page_id", "url", "payload", "digest", "refers_to")

    key = F.sha2(F.concat_ws(":", F.col("page_id").cast("string"), F.col("digest")), 256).alias("key")
    head = F.substring(F.col("payload"), 1, SAMPLE_BYTES).alias("head")
    # Only keys below a bound leave their task: about four times the rows needed, however many pages there are.
    share = min(1.0, 4 * SAMPLE_RECORDS / max(1, pages.count()))
    low = F.conv(F.substring("key", 1, 13), 16, 10).cast("double") < share * 2.0**52
    few = rows.select(key, "page_id", "url", "digest", head).filter(low)
    picked = few.orderBy("key").limit(SAMPLE_RECORDS).collect()
    samples = [page_record(r.page_id, r.url, bytes(r["head"]), r.digest, None, date) for r in picked]
    if isinstance(resolve(folder)[0], pa.fs.LocalFileSystem):
        resolve(folder)[0].create_dir(resolve(folder)[1], recursive=True)
    return stage(map_arrow(marked, _writer(folder, train(samples), archive_bytes, date), INDEX_SCHEMA), "warc-index")


def archive_pages(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write ``pages`` to archives, read them back, and return what the archives say of each page."""
    index = write_archives(pages, folder, **options)
    return read_archives(index.select("path").distinct())
