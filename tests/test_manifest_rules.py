"""Refused and accepted manifests: one fault each, and texts whose first fault counts."""

import pytest

from quire.sources import manifests

SOURCE = '{"source": "a"}'


def root(members, items=SOURCE):
    return f'{{"version": 8, {members}, "items": [{items}]}}'


def item(text):
    return f'{{"version": 8, "items": [{text}]}}'


def page(text):
    return item(f'{{"page": {{"text": {text}}}}}')


def pages(text):
    return item(f'{{"source": "x", "pages": {text}}}')


REFUSED = {
    "plan_syntax": ["", "{", '{"version": 8', item(SOURCE) + " null", item(SOURCE) + "]", item(SOURCE) + "}", item(SOURCE) + "," + item(SOURCE),
                    "{'version': 8}", item('{"source": "\\ud800"}'), item('{"source": "\\udc00x"}')],
    "plan_duplicate_member": ['{"version": 8, "version": 8, "items": [null]}', root('"page_numbers": {"margin": 1, "margin": 2}')],
    "plan_version_unsupported": ["{}", '{"version": 4}', '{"version": 8.0, "items": []}', '{"version": 1, "blank": {}, "items": []}'],
    "plan_unknown_member": [root('"unknown": 1'), '{"blank": {}, "items": [], "version": 1}', '{"Version": 3}', page('{"colour": 1}'), page('{"font": {"name": "x"}}')],
    "plan_null": ["null", item("null"), item('{"page": {}, "count": null}'), page('{"size": null}'), page('{"wrap": null}'), root('"page_numbers": null'), pages("[[1, null]]"), pages("[null]"), root('"metadata": {"title": null}')],
    "plan_type": ["[]", "5", '{"version": 8}', '{"version": "8", "items": []}', '{"version": 8, "items": "x"}', item('{"page": {}, "count": "3"}'), page('{"wrap": true}'), page('{"font": {}}'), pages("[[1, 2, 3]]"),
                  pages("[[1]]"), pages("[[]]"), pages("[1]"), pages('[["x", 2]]'), pages("{}"), root('"page_numbers": {"mode": 5}'), root('"metadata": {"title": 5}'), root('"timestamp": 1.5'),
                  root('"fitting": {}'), item("5"), item('{"source": "a", "numbering": 1}'), page('{"leading": "2"}')],
    "plan_value": [item(""), item('{"page": {}, "count": 3.0}'), item('{"page": {}, "count": 3e0}'), item('{"page": {}, "count": 0}'), page('{"width": 0}'), page('{"wrap": "anywhere"}'), item('{"page": {"size": "0x10"}}'),
                   item('{"dir": "x", "items": []}'), pages("[]"), pages("[[0, 2]]"), pages("[[2, 1]]"), pages("[[1, 2], [2, 3]]"), pages("[[4, 4], [1, 2]]"), pages("[[1.0, 2]]"), pages("[[1, 2e0]]"),
                   pages("[[1, 9223372036854775808]]"), root('"page_numbers": {"margin": -1}'), root('"page_numbers": {"size": 0}'), root('"page_numbers": {"kinds": ["page", "page"]}'), root('"page_numbers": {"start": 0}'),
                   root('"structure": "keep"'), root('"timestamp": -1'), root('"metadata": {"language": "e"}'), root('"metadata": {"title": "\\u0001"}'), root('"fitting": {"target": "A4", "tolerance": -1}'),
                   root('"fitting": {"target": "inherit"}'), item('{"title": "A", "divider": {"text": {"value": "B"}}, "items": [{"source": "x"}]}'), item('{"title": "A", "items": [{"contents": {"size": "inherit"}}]}'),
                   item(SOURCE + ', {"title": "A", "items": [{"contents": {}}, {"contents": {}}]}'), item('{"title": " ", "items": [{"source": "x"}]}'), page('{"color": "none"}'), page('{"color": "#12"}'), page('{"leading": 11}'),
                   page('{"x": "5 mm"}'), page('{"x": 1e400}'), item('{"start_on": "never", "items": [{"source": "x"}]}')],
    "plan_limit": [item('{"page": {}, "count": 100001}'), item('{"page": {}, "count": 9223372036854775808}'), page(f'{{"value": "{"v" * 10001}"}}'), item(f'{{"title": "{"v" * 10001}", "items": [{SOURCE}]}}')],
    "plan_item_shape": [item('{"page": {}, "dir": "x"}'), item('{"items": [{"source": "a.pdf"}]}'), item('{"source": "x", "count": 2}'), item('{"divider": {}, "start_on": "odd", "items": [{"source": "x"}]}'), item("{}")],
    "path_invalid": [item('{"source": "\\u0000"}'), item('{"source": ""}'), root('"output": ""'), page('{"font": {"file": "\\u0000"}}'), item('{"dir": "", "items": [{"source": "x"}]}')],
}
ACCEPTED = [
    "﻿" + item(SOURCE), item(SOURCE) + " \n", pages("[[1, 2], [4, 4]]"), item('{"page": {}, "count": 100000}'), item('{"source": "\\ud83d\\ude00"}'), item('{"source": "\\\\ud800"}'), item('{"contents": {}}, {"source": "x"}'),
    page('{"value": "", "font": "default", "size": "12pt", "color": "#abc", "x": -5, "y": "-1in", "width": "50mm", "leading": 1.5, "anchor": "top", "align": "justify", "overflow": "allow", "wrap": "emergency"}'),
    page('{"font": {"file": "f.ttf"}}'), item('{"page": {"size": "inherit", "background": "none"}}'), root('"page_numbers": {"mode": "physical", "kinds": [], "margin": "0mm", "position": "top-left"}'),
    root('"metadata": {"title": "", "language": "en-GB"}, "timestamp": 0, "structure": "discard", "dir": "d", "$schema": ""'), root('"fitting": {"target": "A4", "tolerance": "1mm"}'),
    item('{"title": "A", "start_on": "any", "divider": {"background": "#000000"}, "items": [{"source": "x"}]}'), item('{"numbering": false, "items": [{"source": "x"}]}'),
]


@pytest.fixture(scope="module")
def found(spark):
    cases = [(f"{code} {k}", text) for code, texts in REFUSED.items() for k, text in enumerate(texts)]
    cases += [(f"fine {k}", text) for k, text in enumerate(ACCEPTED)] + [("plan_syntax none", None)]
    got = manifests.parse_manifests(spark.createDataFrame(cases, "packet_id string, manifest string"))
    rejects = {}
    for r in got.rejects.collect():
        rejects.setdefault(r["packet_id"], []).append(r["code"])
    return dict(cases), rejects, {r["packet_id"] for r in got.items.collect()}, {r["packet_id"] for r in got.packets.collect()}


def test_codes(found):
    cases, rejects, items, packets = found
    wrong = {name: (cases[name], rejects.get(name)) for name in cases if rejects.get(name, ["fine"]) != [name.split()[0]]}
    assert not wrong
    assert items == packets == {name for name in cases if name.startswith("fine")}


def test_lines_keep_what_was_written(spark, tmp_path):
    lines = [
        f'{{"packet_id": "twice", "manifest": {root(chr(34) + "dir" + chr(34) + ": " + chr(34) + "a" + chr(34) + ", " + chr(34) + "dir" + chr(34) + ": " + chr(34) + "b" + chr(34))}}}',
        f'{{"packet_id": "real", "manifest": {pages("[[1.0, 2]]")}}}', f'{{"packet_id": 7, "manifest": {item(SOURCE)}}}', '{"packet_id": "none"}', "no json",
    ]
    (tmp_path / "m.jsonl").write_text("\n".join(lines))
    got = manifests.scan_manifests(spark, str(tmp_path), "lines")
    codes = {r["packet_id"]: r["code"] for r in got.rejects.collect()}
    assert {k: v for k, v in codes.items() if len(k) < 64} == {"twice": "plan_duplicate_member", "real": "plan_value", "none": "plan_syntax"}
    assert [v for k, v in codes.items() if len(k) == 64] == ["plan_syntax"]
    assert [(r["packet_id"], r["path"]) for r in got.items.collect()] == [("7", "a")]
