import base64
import hashlib

from riskloom.llm import warc
from riskloom.llm.common import shared_dir
from riskloom.llm.queries import QUERIES, SQL
from tests.llm.oracle import assert_same


def test_query_against_sql(spark):
    rows = assert_same(spark, QUERIES["op2_warc"], SQL["op2_warc"], "/root/testdata/sf0.01")
    assert rows


def test_keys():
    assert warc.url_key("https://m.a.example.net/en/25?x=1#top") == "net,example,a,m)/en/25?x=1"
    assert warc.url_key("http://u@Host.org:8080") == "org,host:8080)/"
    assert warc.url_key(None) == "" and warc.url_key("not a url") == "not a url" and warc.url_key("http://[bad") == "http://[bad"


def test_round_trip_with_odd_rows(spark):
    html = {1: "é" * 100, 2: "", 3: None, 4: "é" * 100, 5: "x\r\n\r\ny", None: "é" * 100, 6: "big " * 300_000}
    urls = {1: "http://a.org/1", 2: None, 3: "", 4: "http://a.org/1", 5: "http://b.a.org/\n é", None: "http://a.org/1", 6: "http://c.org"}
    rows = [(i, urls[i], html[i], 3) for i in html] + [(1, urls[1], html[1], 3)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string, digest int")
    out = warc.archive_and_read(spark, frame).collect()
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {1: None, 2: None, 3: 2, 4: 1, 5: None, None: 1, 6: None}
    want = [(i, len((html[i] or "").encode()), digest(html[i]), "revisit" if first[i] else "response", first[i]) for i, *_ in rows]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.payload.decode() == (html[r.page_id] or "") for r in out if r.record_type == "response")
    assert warc.archive_and_read(spark, frame.limit(0)).count() == 0
    large = warc.archive_and_read(spark, frame, min_bytes=201).collect()
    assert all(r.record_type == "response" for r in large)


def test_index_over_many_blocks_and_files(spark):
    frame = spark.range(3000).selectExpr("id as page_id", "concat('http://h', id % 7, '.org/', id % 50) as url", "concat('p', id) as html")
    folder = shared_dir(spark, "test-warc")
    captures = warc.write_archives(frame, f"{folder}/a", file_bytes=20_000)
    assert captures.select("path").distinct().count() > 5
    files = warc.build_index(captures, f"{folder}/i", block_lines=16)
    index = warc.CaptureIndex(files, folder)
    key = warc.url_key("http://h3.org/10")
    found = [index.read(x)["page_id"] for x in index.captures([key, -1], [key, warc.NO_ID])]
    assert found == [i for i in range(3000) if i % 7 == 3 and i % 50 == 10]
    assert list(index.captures(["zz", 0], ["zz", 5])) == [] and list(index.captures(["", 0], ["", 5])) == []
    got = warc.look_up(frame.select("url", "page_id"), files, folder)
    assert got.count() == 3000 and got.filter("decode(payload, 'utf-8') != concat('p', page_id)").count() == 0


def test_a_page_id_under_two_urls_of_one_key(spark):
    frame = spark.createDataFrame([(1, "http://a.org/x", "one"), (1, "https://a.org/x#part", "two"), (2, "http://a.org/x", "one")], "page_id bigint, url string, html string")
    out = warc.archive_and_read(spark, frame).collect()
    assert sorted((r.page_id, r.url, r.record_type, r.payload_bytes) for r in out) == [(1, "http://a.org/x", "response", 3), (1, "https://a.org/x#part", "response", 3), (2, "http://a.org/x", "revisit", 3)]
