from __future__ import annotations

import gzip
import hashlib
import json
import zlib

import pytest

from rowforge.llm import warc


def brute(rows):
    bodies = [(key, (html or "").encode()) for key, _, html in rows]
    out = []
    for i, (key, body) in enumerate(bodies):
        same = [(k is None, k or 0, j) for j, (k, b) in enumerate(bodies) if b == body]
        first = min(same)
        equals = [k for k, b in bodies if b == body]
        again = len(body) >= 100 and (key is None, key or 0) != first[:2]
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), again, equals))
    return out


ROWS = [
    (5, "http://a.example/x y\r\nz", "<p>é</p>" * 30),
    (2, None, "<p>é</p>" * 30),
    (9, "", "<p>é</p>" * 30),
    (3, "http://a", None),
    (4, "http://b", ""),
    (6, "http://c", "s" * 99),
    (7, "http://c", "s" * 99),
    (8, "http://d", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9),
    (10, "http://e", "\r\n\r\n" + "t" * 100 + "\r\n"),
    (11, "http://f", "long " * 300_000),
]


def stored(spark, rows, folder, **options):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as file", "2 as id")
    return warc.archive_pages(spark, df, str(folder), **options)


@pytest.mark.parametrize("rows", [[], ROWS, [(1, "u", "x" * 200)] * 3, [(None, "u", "x" * 200), (None, "u", "x" * 200), (4, "u", "x" * 200)]])
def test_pages_come_back(spark, tmp_path, rows):
    got = warc.read_archives(stored(spark, rows, tmp_path / "a")).collect()
    assert sorted((str(r["id"]), r["payload_bytes"], r["payload_digest"]) for r in got) == sorted(
        (str(k), n, d) for k, n, d, _, _ in brute(rows)
    )
    for digest in {r["payload_digest"] for r in got}:
        same = [r for r in got if r["payload_digest"] == digest]
        responses = [r for r in same if r["record_type"] == "response"]
        if same[0]["payload_bytes"] < 100:
            assert len(responses) == len(same) and all(r["refers_to"] is None for r in same)
            continue
        (response,) = responses
        named = [r["id"] for r in same if r["id"] is not None]
        assert response["id"] == (min(named) if named else None)
        assert hashlib.sha256(response["payload"]).hexdigest() == digest
        assert all(r["refers_to"] == response["id"] and r["payload"] is None for r in same if r is not response)


def test_every_record_is_a_member_of_its_own(spark, tmp_path):
    archives = stored(spark, ROWS, tmp_path / "a").collect()
    assert sum(a["records"] for a in archives) == len(ROWS)
    assert not (tmp_path / "a" / "streams").exists()
    for a in archives:
        raw = open(a["archive"], "rb").read()
        entries = [json.loads(line) for line in open(a["sidecar"])]
        end = 0
        for entry in entries:
            assert entry["offset"] == end
            end += entry["length"]
            engine = zlib.decompressobj(31)
            plain = engine.decompress(raw[entry["offset"] : end])
            assert engine.eof and not engine.unused_data and plain.startswith(b"WARC/1.1\r\n") and plain.endswith(b"\r\n\r\n")
        assert end == len(raw)
        # the whole file is one valid stream as well
        assert len(list(warc.split_records(iter([gzip.decompress(raw)])))) == len(entries)


def test_streams_are_cut_by_size_and_are_single_members(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"{i}" * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    index = warc.write_streams(df, str(tmp_path / "s"), archive_bytes=4000)
    files = {r["file"] for r in index.collect()}
    assert len(files) > 3
    for name in files:
        engine = zlib.decompressobj(31)
        engine.decompress(open(name, "rb").read())
        assert engine.eof and not engine.unused_data
    archives = warc.normalise(index, str(tmp_path / "n"))
    assert sorted(r["id"] for r in warc.read_archives(archives).select("id").collect()) == list(range(40))


def test_broken_streams_raise():
    data = warc.record("response", "urn:x", {}, b"block")
    assert [b for _, b in warc.split_records(iter([data[:9], data[9:], data]))] == [b"block", b"block"]
    with pytest.raises(ValueError):
        list(warc.split_records(iter([data[:-20]])))


def test_folders_without_a_scheme_are_on_the_default_file_system(spark, tmp_path):
    assert warc.qualified(spark, str(tmp_path)) == str(tmp_path)
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "hdfs://127.0.0.1:9")
    try:
        assert warc.qualified(spark, "/user/x") == "hdfs://127.0.0.1:9/user/x"
    finally:
        conf.set("fs.defaultFS", before)
    assert warc.arrow_address("s3a://bucket/x") == "s3://bucket/x"
    with pytest.raises(ValueError, match="viewfs"):
        warc.arrow_address("viewfs://store/x")
