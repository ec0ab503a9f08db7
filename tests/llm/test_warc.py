from hashlib import sha256

import pytest

from quire.llm import warc


def test_a_record_parses_back():
    digest = sha256(b"x").hexdigest()
    head, http, payload = warc.parse(warc.record(7, "http://a/\r\nX: y", b"x\r\n\r\nWARC/1.1\r\n\r\n", digest, None))
    assert payload == b"x\r\n\r\nWARC/1.1\r\n\r\n" and head["warc-target-uri"] == "http://a/%0D%0AX: y" and head["warc-type"] == "response"
    head, http, payload = warc.parse(warc.record(8, None, b"x" * 200, digest, 7))
    assert payload == b"" and head["warc-type"] == "revisit" and http["content-length"] == "200" and head["warc-refers-to"] == "<urn:page:7>"
    with pytest.raises(ValueError):
        warc.parse(b"HTTP/1.1 200 OK")


def test_keys():
    assert warc.surt("http://www.Example.com/p?q#f") == "com,example,www)/p?q#f"
    assert warc.surt(None) == ")" and warc.surt("x") == ")x" and warc.surt("http://a") == "a)"


def expected(rows):
    first = {}
    for i, _, h in rows:
        h = (h or "").encode()
        if i is not None and len(h) >= 100:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, _, h in rows:
        h = (h or "").encode()
        to = first.get(h) if i is not None else None  # a page without an id is a response
        out.append((i, len(h), sha256(h).hexdigest(), "revisit" if to is not None and to < i else "response", to if to is not None and to < i else None))
    return sorted(out, key=str)


def test_round_trip_with_ties_and_odd_rows(spark):
    rows = [(k, f"http://h{k % 3}.org/{k % 5}", "p" * (60 + 20 * (k % 4))) for k in range(60)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://q/", "é" * 50), (103, "http://q/", "é" * 50), (103, "http://q/", "é" * 50), (104, "http://q/", "é" * 49 + "a"), (105, "u", "z" * 3_000_000), (None, "http://q", "p" * 120), (None, "http://r", None), (-7, "http://q", "m")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(5)
    archive = warc.write(pages)
    found = warc.read(archive, warc.lookup(archive, pages)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in found), key=str) == expected(rows)
    payloads = {(r[0], (r[2] or "").encode()) for r in rows}
    assert all((r["page_id"], bytes(r["payload"])) in payloads for r in found if r["record_type"] == "response")
    missing = spark.createDataFrame([(5000, "http://none/"), (1, "http://other/"), (None, None)], "page_id long, url string")
    assert warc.lookup(archive, missing).count() == 0


def test_many_blocks_and_one_url(spark):
    pages = spark.range(2500).selectExpr("id AS page_id", "'http://same.org/' AS url", "concat('body ', id) AS html")
    archive = warc.write(pages)
    some = pages.where("page_id % 100 = 3")
    assert sorted(r["page_id"] for r in warc.read(archive, warc.lookup(archive, some)).collect()) == list(range(3, 2500, 100))


def test_an_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    archive = warc.write(pages)
    assert archive.shards == [] and warc.read(archive, warc.lookup(archive, pages)).count() == 0
