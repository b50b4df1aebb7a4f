"""Readers of responses against a plain reading of their JSON; recorded attempts."""

import json

import pytest

from attesta.sources import documents, responses

ELEMENTS = [
    {"id": 1, "page": 2, "category": "paragraph", "text": "a", "content": "b", "boundingBox": [0.1, 0.2, 0.3, 0.4, 9]},
    {"id": 2, "pageNumber": 3.7, "category": ["list", "x"], "content": "b", "Content": "c", "box": {"left": 1, "top": 2, "w": 3, "h": 4}},
    {"page_number": 4, "Content": "c", "bbox": {"x": 0, "left": 5, "y": 6, "width": 7, "height": "8.5"}},
    {"pageIndex": 5, "textContent": "d", "category": [], "boundingBox": [], "bbox": [1, 2, 3, 4]},
    {"pagenum": 6, "TEXT": "e", "category": 7, "box": [1, 2, 3]},
    {"page": "7", "text": 5, "content": {"text": "f", "Content": "g"}},
    {"text": None, "content": {"text": "", "Content": "g"}},
    {"content": {"text": 9, "Content": "g"}},
    {"content": {"Content": "h", "html": "<p>"}, "category": None, "coordinates": [{"x": 0.1, "y": 0.2}, {"x": 0.5, "y": 0.4}]},
    {"text": "", "content": "not this"},
    {},
]


def plain(e):
    text = next((e[k] for k in responses.TEXT_KEYS if isinstance(e.get(k), str)), None)
    if text is None and isinstance(e.get("content"), dict):
        inner = e["content"].get("text") or e["content"].get("Content")
        text = inner if isinstance(inner, str) else ""
    category = e.get("category")
    category = str(category[0]) if isinstance(category, list) and category else category if isinstance(category, str) else ""
    page = next((int(e[k]) for k in responses.PAGE_KEYS if isinstance(e.get(k), int | float)), 0)
    box, where = e.get("boundingBox") or e.get("box") or e.get("bbox"), None
    if isinstance(box, dict):
        where = tuple(float(next((box[k] for k in ks if box.get(k)), 0.0)) for ks in (("x", "left"), ("y", "top"), ("width", "w"), ("height", "h")))
    elif isinstance(box, list) and len(box) >= 4:
        where = tuple(map(float, box[:4]))
    elif not box and e.get("coordinates"):
        xs, ys = [p["x"] for p in e["coordinates"]], [p["y"] for p in e["coordinates"]]
        where = (min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys))
    return text or "", category, page, where


WRAPPED = {"elements": lambda e: {"elements": e}, "content": lambda e: {"content": {"elements": e, "text": "x"}}, "list": lambda e: e, "data": lambda e: {"data": e}, "result": lambda e: {"result": {"elements": e}}, "response": lambda e: {"data": 5, "response": {"elements": e}}}


@pytest.mark.parametrize("how", WRAPPED)
def test_elements_in_every_form(spark, how):
    r = spark.createDataFrame([(how, json.dumps(WRAPPED[how](ELEMENTS)))], "key string, body string")
    got = sorted(responses.elements_of(r).collect(), key=lambda x: x.ord)
    for g, e in zip(got, ELEMENTS, strict=True):
        where = (g.x, g.y, g.w, g.h)
        text, category, page, box = plain(e)
        assert (g.text, g.category, g.page, g.id) == (text, category, page, e.get("id"))
        assert where == ((None,) * 4 if box is None else pytest.approx(box)), e


def test_states_of_responses(spark):
    rows = [("a", '{"elements": []}'), ("b", '{"pages": 3}'), ("c", "{oops"), ("d", None), ("e", "[1]"), ("f", '"text"')]
    r = spark.createDataFrame(rows, "key string, body string")
    assert {x.key: x.state for x in responses.response_state(r).collect()} == {"a": "parsed", "b": "no_elements", "c": "not_json", "d": "missing", "e": "parsed", "f": "no_elements"}
    assert [(x.key, x.text) for x in responses.elements_of(r).collect()] == [("e", "")]


def test_references_as_items_or_list(spark):
    items = [{"id": 1, "raw": "r", "doi": "10.1/a", "year": 2001, "confidence": 0.7, "notes": ["n"]}, {"title": None, "first_author": "Kim", "confidence": "high", "notes": 5}]
    r = spark.createDataFrame([("a", json.dumps({"items": items})), ("b", json.dumps(items)), ("c", "{}"), ("d", "x")], "key string, body string")
    got = sorted(responses.references_of(r).collect(), key=lambda x: (x.key, x.ord))
    assert [(x.key, x.id, x.doi, x.year, x.confidence, x.notes, x.first_author) for x in got] == [(k, *v) for k in "ab" for v in (("1", "10.1/a", "2001", 0.7, ["n"], None), (None, None, None, None, None, "Kim"))]


def test_a_folder_of_responses(spark, tmp_path):
    for name, body in (("0a1b", '{"elements": [{"text": "one"}, {"text": "two"}]}'), ("ffff", "{broken")):
        (tmp_path / f"{name}.json").write_text(body)
    r = responses.bodies(spark, str(tmp_path))
    assert {(x.key, x.state) for x in responses.response_state(r).collect()} == {("0a1b", "parsed"), ("ffff", "not_json")}
    assert [(x.ord, x.text) for x in documents.parse_responses(spark, str(tmp_path)).collect()] == [(0, "one"), (1, "two")]


def test_recorded_attempts(spark):
    attempts = [("ok", 1, 200), ("again", 1, 503), ("again", 2, 200), ("gone", 1, 404), ("gone", 2, 200), ("busy", 1, 429), ("busy", 2, 500), ("busy", 3, 200), ("dead", 1, None), ("dead", 2, None), ("open", 1, 502)]
    a = spark.createDataFrame([(k, n, s, f"{k}{n}") for k, n, s in attempts], "key string, attempt int, status int, body string")
    wanted = spark.createDataFrame([(k,) for k in ("ok", "again", "gone", "busy", "dead", "open", "never")], "key string")
    got = {r.key: (r.state, r.tries, r.status, r.body) for r in responses.answered(wanted, a).collect()}
    assert got == {"ok": ("ok", 1, 200, "ok1"), "again": ("ok", 2, 200, "again2"), "gone": ("http_error", 1, 404, "gone1"), "busy": ("http_error", 2, 500, "busy2"), "dead": ("unreachable", 2, None, "dead2"), "open": ("retry", 1, 502, "open1"), "never": ("missing", 0, None, None)}
    assert {r.key: r.state for r in responses.settled(a, 2).collect()}["busy"] == "ok"
