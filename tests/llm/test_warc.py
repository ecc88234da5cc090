import base64
import gzip
import hashlib
import io

import pytest

from maskwright.llm import warc
from maskwright.llm.scratch import Scratch

SCHEMA = "page_id long, url string, html string"


def pages(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def written(spark, rows, **more):
    path = Scratch(spark).path("warc")
    warc.write_archive(pages(spark, rows), path, **more)
    return path


def captures(spark, path):
    c = warc.read_captures(spark, path)
    return c.select("capture.*", "request", "metadata").collect()


def test_round_trip(spark):
    texts = ["<p>a</p>", "", None, "same", "same", "same", "é漢😀\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n", "tail\n", "x" * 300_000]
    rows = [(i * 3, None if i == 4 else f"http://h/{i} b\r\nc", t) for i, t in enumerate(texts)]
    got = {int(r.record_id.split(":")[2]): r for r in captures(spark, written(spark, rows))}
    assert len(got) == len(rows)
    for i, _, t in rows:
        raw = (t or "").encode()
        peers = [j for j, _, u in rows if (u or "") == (t or "")]
        r = got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert r.kind == ("response" if i == max(peers) else "revisit")
        assert r.refers_to == (None if i == max(peers) else got[max(peers)].record_id)
        assert r.payload == (raw if i == max(peers) else None)
        assert r.request.record_id.endswith(":request>") and r.metadata.fields["page-id"] == str(i)
        assert "\r" not in r.target_uri


def test_least_size_of_revisits_null_and_repeated_ids(spark):
    rows = [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd"), (4, "u", "abcd"), (None, "u", "abcd"), (None, "u", "zz")]
    got = sorted((str(warc_id), kind) for warc_id, kind in ((r.record_id.split(":")[2], r.kind) for r in captures(spark, written(spark, rows, least_revisit=3))))
    assert got == sorted([("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response"), ("4", "response"), ("none", "revisit"), ("none", "response")])


def test_empty_table_and_clashing_columns(spark):
    assert captures(spark, written(spark, [])) == []
    path = Scratch(spark).path("warc")
    warc.write_archive(pages(spark, [(1, "u", "h")]).selectExpr("*", "1 as digest", "2 as payload", "3 as n"), path)
    assert len(captures(spark, path)) == 1


def test_parser_takes_what_others_write():
    block = b"HTTP/1.0 200 OK\r\nX: y\r\n\r\nbody"
    one = b"WARC/1.0\r\nwarc-type: response\r\nWARC-Record-ID: <a>\r\nX-Folded: b\r\n  c\r\nContent-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    both = gzip.compress(info) + gzip.compress(one)
    got = list(warc.parse(io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(both)))))
    assert [f["warc-type"] for f, _ in got] == ["warcinfo", "response"] and got[1][0]["x-folded"] == "b c"
    assert warc.split_http(got[1][1]) == ({"x": "y"}, b"body")
    with pytest.raises(ValueError):
        list(warc.parse(io.BytesIO(one[:-10])))
