import base64
import gzip
import hashlib
import json
import zlib

import pytest

from loomgraph.llm import common, warc

PAGES = [(5, "http://a", "same"), (2, "http://b", "same"), (9, "http://c", "same"), (1, None, None), (3, "u\r\nX: y", ""), (4, "http://d", "é\r\n\r\nWARC/1.1\r\n" * 50000), (None, "http://e", "same"), (7, "http://f", "alone"), (2, "http://b", "same")]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, path string, n int").repartition(3)
    folder = common.fresh_dir(spark, "test-warc")
    done = warc.archive(pages, folder)
    got = warc.read(done).collect()
    assert len(got) == len(PAGES) == sum(r.n for r in done.collect())
    first = {}
    for i, _, html in PAGES:
        if i is not None:
            first[html or ""] = min(i, first.get(html or "", i))
    seen = []
    for r in got:
        i = int(r.record_id) if r.record_id else None
        html = next(h for j, _, h in PAGES if j == i) or ""
        raw = html.encode()
        assert r.payload_bytes == len(raw)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        is_response = i == first[html]
        assert r.record_type == ("response" if is_response else "revisit")
        assert r.refers_to == (None if is_response else str(first[html]))
        assert r.payload == (raw if is_response else None)
        seen.append(i)
    assert sorted(map(str, seen)) == sorted(str(p[0]) for p in PAGES)
    for r in done.collect():
        fs, path = warc.place(r.path)
        raw = fs.open_input_stream(path, compression=None).read()
        fs, path = warc.place(r["index"])
        entries = [json.loads(x) for x in fs.open_input_stream(path).read().splitlines()]
        assert sum(e["length"] for e in entries) == len(raw)
        for e in entries:
            engine = zlib.decompressobj(31)
            engine.decompress(raw[e["offset"] : e["offset"] + e["length"]])
            assert engine.eof and not engine.unused_data


def test_streams_in_any_pieces():
    whole = [warc.record(i, "u", b"x" * i * 37 + b"\r\n\r\n", "D", None if i % 2 else 3) for i in range(40)]
    data = b"".join(whole)
    for size in (1, 7, 1000, len(data)):
        assert list(warc.records(data[i : i + size] for i in range(0, len(data), size))) == whole
    with pytest.raises(ValueError):
        list(warc.records([data[:-3]]))


def test_inflating_members_and_cut_streams(tmp_path):
    path = tmp_path / "x.gz"
    path.write_bytes(gzip.compress(b"a" * 3_000_000) + gzip.compress(b"b"))
    assert b"".join(warc.inflate(path.open("rb"))) == b"a" * 3_000_000 + b"b"
    path.write_bytes(gzip.compress(b"abc" * 1000)[:-9])
    with pytest.raises(ValueError):
        list(warc.inflate(path.open("rb")))


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.archive(pages, common.fresh_dir(spark, "test-warc"))).count() == 0
