"""Files in, files out."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quire.sources import blobs, manifests, reports


def test_manifest_files(spark, tmp_path):
    good = {
        "version": 8, "output": "o.pdf", "dir": "in", "timestamp": 5, "metadata": {"title": "T"}, "fitting": {"target": "A4"},
        "page_numbers": {"mode": "physical", "start": 3, "kinds": []},
        "items": [
            {"source": "a.pdf", "pages": [[1, 2], [4, 4]]}, {"page": {"size": "A4", "text": {"value": "x"}}, "count": 2}, {"contents": {"title": "C"}},
            {"title": "G", "start_on": "odd", "divider": {}, "numbering": False, "items": [{"dir": "d", "items": [{"source": "b.pdf"}]}]},
        ],
    }
    bad = {
        "syntax": "{", "twice": '{"version":8,"version":8,"items":[{"source":"a"}]}', "version": json.dumps({**good, "version": 7}),
        "member": json.dumps({**good, "extra": 1}), "null": json.dumps({**good, "output": None}), "type": json.dumps({**good, "output": 3}),
        "empty": json.dumps({**good, "items": []}), "item": json.dumps({**good, "items": [{"source": 5}]}), "list": "[]",
        "deep": json.dumps({**good, "items": [{"title": "t", "items": [{"sauce": "x"}]}]}),
    }
    (tmp_path / "good.json").write_text(json.dumps(good, indent=1))
    for name, text in bad.items():
        (tmp_path / f"{name}.json").write_text(text)
    got = manifests.scan_manifests(spark, str(tmp_path))
    rows = {r.ref: r for r in got.items.collect()}
    assert sorted(rows) == ["/items/0", "/items/1", "/items/2", "/items/3", "/items/3/items/0", "/items/3/items/0/items/0"]
    assert [(p.first, p.last) for p in rows["/items/0"].ranges] == [(1, 2), (4, 4)]
    assert [rows[r].kind for r in sorted(rows)] == ["source", "page", "contents", "group", "group", "source"]
    assert rows["/items/1"]["count"] == 2 and rows["/items/1"]["size"] == "A4" and rows["/items/1"].text == "x"
    assert rows["/items/3"].divider and rows["/items/3"].numbering is False and rows["/items/2"].title == "C"
    assert rows["/items/3/items/0/items/0"].ref_path == [3, 0, 0] and rows["/items/3/items/0/items/0"].parent_ref == "/items/3/items/0"
    packet = got.packets.collect()
    assert len(packet) == 1 and packet[0].number_kinds == [] and packet[0].timestamp == 5 and packet[0].structure == "preserve"
    codes = {r.packet_id.rsplit("/", 1)[1].removesuffix(".json"): r.code for r in got.rejects.collect()}
    assert codes == {
        "syntax": "plan_syntax", "twice": "plan_duplicate_member", "version": "plan_version_unsupported", "member": "plan_unknown_member", "null": "plan_null",
        "type": "plan_type", "empty": "plan_value", "item": "plan_type", "list": "plan_type", "deep": "plan_unknown_member",
    }


def test_blob_files(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"\xff\xfejunk%PDF-1.7 rest")
    (tmp_path / "b.pdf").write_bytes(b"no header")
    got = {r.path.rsplit("/", 1)[1]: r for r in blobs.scan_blobs(spark, str(tmp_path / "*.pdf")).collect()}
    assert got["a.pdf"].recognised and got["a.pdf"].header_at == 6 and got["a.pdf"].bytes == 19
    assert got["b.pdf"].digest == hashlib.sha256(b"no header").hexdigest() and got["b.pdf"].header_at is None


def report_tables(spark):
    headers = spark.createDataFrame([("p", "ok", 1, 2, 3), ("q", "ok", 0, 0, 0), ("r", "invalid", None, None, None)],
                                    "packet_id string, status string, source_pages bigint, generated_pages bigint, total_pages bigint")
    parts = spark.createDataFrame([("p", 2, "b", 2, [(1, 2, 2)]), ("p", 1, "a", 1, None)],
                                  "packet_id string, order bigint, item string, pages bigint, spans array<struct<src_first:bigint,src_last:bigint,out_first:bigint>>")
    sections = spark.createDataFrame([("p", 1, "s", "T")], "packet_id string, order bigint, item string, title string")
    found = spark.createDataFrame([("r", 1, "plan_value", ["x"])], "packet_id string, order bigint, code string, items array<string>")
    return headers, parts, sections, found


@pytest.mark.parametrize("slice_rows", [100, 1])
def test_reports_round_trip(spark, tmp_path, slice_rows):
    path = str(tmp_path / "reports")
    reports.write_reports(reports.report_records(*report_tables(spark), slice_rows=slice_rows), path)
    saved = reports.read_reports(spark, path)
    assert [(r.packet_id, r.place, r["item"], r.pages) for r in saved.parts.orderBy("place").collect()] == [("p", 1, "a", 1), ("p", 2, "b", 2)]
    assert [(s.src_first, s.out_first) for s in saved.spans.collect()] == [(1, 2)]
    assert [(s["item"], s.title, s.parent) for s in saved.sections.collect()] == [("s", "T", None)]
    assert [(f.packet_id, f["items"]) for f in saved.findings.collect()] == [("r", ["x"])]
    assert saved.headers.count() == 3
    lines = {}
    for text in spark.read.text(path).collect():
        record = json.loads(text[0])
        lines.setdefault(record["packet_id"], record)
    # unknown stays null, resolved but empty is an empty list, and both are written
    assert lines["r"]["parts"] is None and lines["q"]["parts"] == [] and lines["q"]["findings"] == [] and "sections" in lines["r"]


def test_publish_never_replaces_an_input(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(3).write.parquet(source)
    frame = spark.read.parquet(source)
    reports.publish(frame, target, [source])
    with pytest.raises(reports.PublishRefused):
        reports.publish(frame, target, [source])
    reports.publish(frame.limit(1), target, [source], overwrite=True)
    assert spark.read.parquet(target).count() == 1
    for path in (source, source + "/x", str(tmp_path)):
        with pytest.raises(reports.PublishRefused):
            reports.publish(frame, path, [source], overwrite=True)
    assert spark.read.parquet(source).count() == 3


def test_saved_reports_keep_their_findings(spark):
    from quire.plans import load_queries

    load_queries()
    from quire.plans import store_queries

    turns = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").collect()
    high = {(str(r.conv_id), f"turn/{r.conv_id}/{r.turn}") for r in turns if 12 + 6 * (len(r.text) % 4) > 25}
    both = store_queries.saved_reports(spark, "/root/testdata/sf0.001")
    saved = both.findings.collect()
    assert {h.packet_id for h in both.headers.collect() if h.status == "invalid"} == {p for p, _ in high}
    assert high and {(f.packet_id, f.file) for f in saved} == high and len(saved) == len(high)
    assert all(f.code == "text_overflow" and f.severity == "error" and f["items"] == [f.file] for f in saved)
    places = {}
    for f in saved:
        places.setdefault(f.packet_id, []).append(f.place)
    assert all(sorted(p) == list(range(1, len(p) + 1)) for p in places.values())
