import json

from shelfmark.operators import nested

RECORD = {
    "schema_version": 2,
    "pages": [
        {"number": 1, "text": "a", "images": ["assets/x"], "tables": {"id": "t1", "rows": 1, "cols": 2, "asset": "assets/y", "cells": [{"row": 0, "col": 0, "rowspan": 1, "colspan": 1, "text": "é"}, {"row": 0, "col": "1", "text": None}]}},
        {"number": "2", "text": "b", "tables": None},
        {"text": "no number", "tables": []},
        "not an object",
    ],
    "assets": {"assets/x": {"sha256": "0", "bytes": 3}, "assets/y": None},
    "embedded_media": {"asset": "assets/x", "package_part": "word/1.png"},
}
EXPECTED = {
    ("page", "v", "1"), ("page", "v", "2"), ("page", "v", "3"), ("table", "1", "t1"), ("cell", "t1", "0,0"), ("cell", "t1", "0,1"), ("asset", "", "assets/x"), ("asset", "", "assets/y"), ("media", "assets/x", "word/1.png"),
}


def rows(spark, payloads, extra=False):
    df = spark.createDataFrame([("v", p) for p in payloads], "version_id string, payload string")
    if extra:
        for c in ("pages", "child_kind", "_p", "assets", "cells"):
            df = df.withColumn(c, df.payload)
    return {(r.child_kind, r.parent_key, r.child_key) for r in nested.links(df).collect()}


def test_every_wrapping_gives_the_same_children(spark):
    plain = json.dumps(RECORD, ensure_ascii=False)
    for p in (plain, "﻿" + plain, json.dumps(plain), json.dumps(json.dumps(plain)), json.dumps(json.dumps(json.dumps(json.dumps(json.dumps(plain))))), "  " + json.dumps(RECORD, indent=1) + "\n", "﻿" + json.dumps("﻿" + plain)):
        assert rows(spark, [p]) == EXPECTED


def test_repeats_and_extra_columns(spark):
    other = json.dumps(dict(reversed(RECORD.items())))
    assert rows(spark, [json.dumps(RECORD), other, other], extra=True) == EXPECTED


def test_broken_and_empty_payloads_give_nothing(spark):
    plain = json.dumps(RECORD)
    assert rows(spark, [None, "", " ", "[]", "3", "null", '"', "{", plain[:-1], plain[: len(plain) // 2], json.dumps(plain)[:-5], '{"pages": null, "assets": [], "embedded_media": ""}', "{}"]) == set()


def test_empty_table(spark):
    df = spark.createDataFrame([], "version_id string, payload string")
    for f in (nested.links, nested.page_table, nested.table_table, nested.cell_table, nested.asset_table, nested.media_table, nested.asset_references):
        assert f(df).count() == 0


def test_flat_tables_keep_their_fields(spark):
    df = spark.createDataFrame([("v", json.dumps(RECORD))], "version_id string, payload string")
    assert {(r.page, r.row, r.col, r.text) for r in nested.cell_table(df).collect()} == {("1", "0", "0", "é"), ("1", "0", "1", None)}
    assert {(r.asset, r.kind) for r in nested.asset_references(df).collect()} == {("assets/x", "image"), ("assets/y", "table"), ("assets/x", "media")}


def test_very_long_record(spark):
    big = {"pages": [{"number": i, "text": "x" * 1000, "tables": [{"id": f"t{i}", "cells": [{"row": 0, "col": c} for c in range(5)]}]} for i in range(1, 401)]}
    got = rows(spark, [json.dumps(big)])
    assert len(got) == 400 + 400 + 2000


def _children(record):
    """The links of one record by plain Python."""
    listed = lambda x: [y for y in (x if isinstance(x, list) else [x]) if isinstance(y, dict)]
    out = set()
    for i, p in enumerate(listed(record.get("pages")), 1):
        n = str(p.get("number") if p.get("number") is not None else i)
        out.add(("page", "v", n))
        for t in listed(p.get("tables")):
            out.add(("table", n, t.get("id")))
            out |= {("cell", t.get("id") or "", f"{c.get('row')},{c.get('col')}") for c in listed(t.get("cells"))}
    out |= {("asset", "", a) for a in record.get("assets") or {}} if isinstance(record.get("assets"), dict) else set()
    return out | {("media", m.get("asset") or "", m.get("package_part")) for m in listed(record.get("embedded_media"))}


def test_fitting_and_other_shapes_give_what_plain_python_gives(spark):
    import random

    rng = random.Random(4)

    def some(make):
        items = [make() for _ in range(rng.randint(0, 3))]
        return rng.choice([items, items, items, items[0] if items else None, [*items, 3, None, "x"], None, "text", 7])

    def cell():
        return {"row": rng.randint(0, 9), "col": str(rng.randint(0, 9)), "header": rng.choice([True, None, "yes"]), "text": rng.choice(["a", None, 5, {"b": 1}])}

    def page():
        return {k: v for k, v in {"number": rng.choice([rng.randint(1, 9), "4", None]), "text": "t", "tables": some(lambda: {"id": f"t{rng.randint(1, 9)}", "cells": some(cell)})}.items() if rng.random() < 0.9}

    records = [
        {"pages": some(page), "assets": rng.choice([{"a/x": {"sha256": "0", "bytes": "3"}, "a/y": None}, {}, None, [], {"a/z": "text"}]), "embedded_media": some(lambda: {"asset": rng.choice(["a/x", None]), "package_part": "p"})}
        for _ in range(300)
    ]
    df = spark.createDataFrame([(str(i), json.dumps(r)) for i, r in enumerate(records)], "version_id string, payload string")
    got = {(r.version_id, r.child_kind, "v" if r.child_kind == "page" else r.parent_key, r.child_key) for r in nested.links(df).collect()}
    assert got == {(str(i), *c) for i, r in enumerate(records) for c in _children(r)}
