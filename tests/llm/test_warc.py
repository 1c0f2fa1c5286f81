"""Archives: exact round trips, the dictionary frame, revisits."""

import hashlib
import os
import random
import struct
import sys

import zstandard as zstd

sys.path.insert(0, os.path.dirname(__file__))

from helpers import AWKWARD

from scanloom.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, digest string, refers_to string"


def pages_of(spark, rows):
    return spark.createDataFrame([(i, u, h, "a", "b", "c") for i, u, h in rows], SCHEMA).repartition(3)


def expected(rows):
    firsts = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 100:
            firsts[h] = min(firsts.get(h, i), i)
    counts = [h for _, _, h in rows]
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        first = firsts.get(h) if counts.count(h) > 1 else None
        again = first is not None and i != first
        out.append((i, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=str)


def archive(spark, rows, folder, **options):
    found = warc.archive_pages(pages_of(spark, rows), f"file://{folder}", **options).collect()
    assert sorted(
        ((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=str
    ) == expected(rows)
    return found


def test_round_trip(spark, tmp_path):
    big = "".join(random.Random(1).choices("abc <>\r\n", k=400_000)) + "\r\n\r\nWARC/1.1\r\n"
    texts = [*AWKWARD, big, "y" * 99, "y" * 99, "z" * 100, "z" * 100, big]
    rows = [(k, None if k % 4 == 3 else f"http://h{k}/é x\r\nEvil: 1", t) for k, t in enumerate(texts)]
    rows += [(None, "http://n/", "z" * 100), (3, "http://three/", "z" * 100), (18, "http://same/", "z" * 100)]
    archive(spark, rows, tmp_path / "a", archive_bytes=2_000)
    files = list((tmp_path / "a").iterdir())
    assert len(files) > 3 and not [f for f in files if f.suffix == ".tmp"]
    for f in files:  # a leading skippable frame with the dictionary, then records one by one
        raw = f.read_bytes()
        magic, size = struct.unpack("<II", raw[:8])
        assert magic == warc.DICTIONARY_MAGIC and zstd.ZstdCompressionDict(raw[8 : 8 + size]).dict_id() >= 0
        with f.open("rb") as stream:
            records = [warc.parse_record(x) for _, x in warc.frames(stream, 7)]
        assert records[0][0]["warc-type"] == "warcinfo"
        for fields, payload in records[1:]:
            assert "evil" not in fields
            if fields["warc-type"] == "response":
                assert "sha256:" + hashlib.sha256(payload).hexdigest() == fields["warc-payload-digest"]
            else:
                assert payload == b"" and fields["warc-profile"] == warc.PROFILE


def test_index_finds_records(spark, tmp_path):
    rows = [(k, f"http://h/{k}", f"<p>page {k}</p>" * 30) for k in range(20)]
    index = warc.write_archives(pages_of(spark, rows), f"file://{tmp_path}/i").collect()
    assert sorted(r.page_id for r in index) == list(range(20))
    for r in index:
        with open(r.path.removeprefix("file://"), "rb") as f:
            _, size = struct.unpack("<II", f.read(8))
            d = zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(f.read(size)))
            f.seek(r.offset)
            fields, payload = warc.parse_record(d.decompress(f.read(r.length)))
        assert payload.decode() == rows[r.page_id][2] and fields["warc-record-id"] == f"<urn:x-page:{r.page_id}>"


def test_damage_is_noticed(spark, tmp_path):
    warc.write_archives(pages_of(spark, [(1, "http://h/", "<p>text</p>" * 20)]), f"file://{tmp_path}/d").collect()
    (path,) = (tmp_path / "d").iterdir()
    path.write_bytes(path.read_bytes()[:-5])
    paths = spark.createDataFrame([(f"file://{path}",)], "path string")
    try:
        warc.read_archives(paths).collect()
    except Exception as e:
        assert "ends within a record" in str(e)
    else:
        raise AssertionError("a cut archive was read")


def test_empty(spark, tmp_path):
    assert archive(spark, [], tmp_path / "e") == []
