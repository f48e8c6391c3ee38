"""Deeply nested extraction records turned into flat tables with parent-child links (problem 1).

Method: higher-order SQL projection. Nested ``transform`` calls attach ancestor keys and indices, ``flatten``
combines the arrays, and one ``inline`` per target table emits the rows. No shuffle is needed before the last
de-duplication.

A payload is parsed once, by the whole nested schema with text at the leaves and only as deep as the wanted table needs.
Where a record does not fit that schema (a bare object in place of a list, an element that is no object), its lists are
taken apart level by level as raw JSON instead; both ways give the same rows.

Defined results:

* A payload is used if it is one complete JSON object after removing a byte-order mark, outer white space and all
  wrappings as a JSON string. Null, empty, cut-off and non-object payloads give no rows.
* Absent, null, scalar and empty lists give no rows; a bare object stands for a list of one; list elements that are
  no objects are skipped.
* Numbers may come as text; they are written as decimal text. A page without number takes its position (from 1).
* Repeated records give the same rows once. Extra columns of the input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each wrapping doubles the escapes of the one inside, so no text within Spark's bound of 2 GB has more.
WRAPS = 31
#: White space, byte-order mark and null character.
_EDGES = " \t\n\x0b\f\r\ufeff\x00"

_CELL = "row string, col string, rowspan string, colspan string, text string, header boolean"
_ASSET = "struct<sha256 string, bytes string, media_type string, role string>"
_MEDIA = "struct<asset string, package_part string>"
KINDS = ("pages", "tables", "cells", "assets", "media")
#: What can be wanted besides, as raw JSON in the rows of pages, tables and cells.
PAGE_EXTRAS, TABLE_EXTRAS, CELL_EXTRAS = ("text_items", "locator"), ("provenance",), ("bbox",)


def _clean(col: Column) -> Column:
    return F.btrim(col, F.lit(_EDGES))


def _number(col: Column) -> Column:
    """A number given as number or text, as decimal text; other text stays."""
    trimmed = F.trim(col)
    value = trimmed.try_cast("decimal(38,6)")
    return F.when(trimmed.rlike(r"^(?:0|-?[1-9][0-9]{0,30})$"), trimmed).when(value == F.floor(value), F.floor(value).cast("string")).otherwise(trimmed)


def _objects(raw: Column) -> Column:
    """The objects of a raw JSON list as raw JSON texts; a bare object counts as a list of one."""
    listed = F.when(raw.startswith("["), raw).when(raw.startswith("{"), F.concat(F.lit("["), raw, F.lit("]")))
    return F.filter(F.coalesce(F.from_json(listed, "array<string>"), F.array().cast("array<string>")), lambda x: x.startswith("{"))


def _unwrapped(payload: Column) -> Column:
    """The payload without outer marks and wrappings as a JSON string."""

    def inner(p: Column, _: Column) -> Column:
        return F.when(p.startswith('"'), _clean(F.from_json(F.concat(F.lit('{"v":'), p, F.lit("}")), "v string")["v"])).otherwise(p)

    p = _clean(payload)
    return F.when(p.startswith('"'), F.aggregate(F.sequence(F.lit(1), F.lit(WRAPS)), p, inner)).otherwise(p)


def _complete(extractions: DataFrame) -> DataFrame:
    """version_id, received_at (if there), _p: the payload as one JSON object; null where it is none."""
    keep = [c for c in ("version_id", "received_at") if c in extractions.columns]
    df = extractions.select(*keep, _unwrapped(F.col("payload")).alias("_p"))
    return df.withColumn("_p", F.when(F.col("_p").startswith("{") & F.col("_p").endswith("}"), F.col("_p")))


_RAW = "pages string, assets string, embedded_media string, ocr_language string, settings string, _bad string"


def _raw(p: Column) -> Column:
    """The record with its lists as raw JSON; _bad is set where it is no complete JSON."""
    return F.from_json(p, _RAW, {"columnNameOfCorruptRecord": "_bad"})


def records(extractions: DataFrame) -> DataFrame:
    """One row per complete payload: version_id, received_at (if there), pages, assets and embedded_media as raw JSON."""
    df = _complete(extractions).withColumn("_r", _raw(F.col("_p")))
    return df.filter(F.col("_r").isNotNull() & F.col("_r._bad").isNull()).select(
        *[c for c in df.columns if not c.startswith("_")],
        "_r.pages",
        "_r.assets",
        "_r.embedded_media",
        F.coalesce(F.col("_r.ocr_language"), F.from_json("_r.settings", "ocr_language string")["ocr_language"]).alias("ocr_language"),
    )


def _schema(kinds: tuple[str, ...]) -> str:
    """The nested schema of a record, as deep as the wanted tables need."""
    more = lambda extras: "".join(f", {x} string" for x in extras if x in kinds)
    cells = f", cells array<struct<{_CELL}{more(CELL_EXTRAS)}>>" if "cells" in kinds else ""
    tables = f", tables array<struct<id string, rows string, cols string, asset string{more(TABLE_EXTRAS)}{cells}>>" if {"tables", "cells"} & set(kinds) else ""
    fields = [f"pages array<struct<number string, text string, preview string, images string{more(PAGE_EXTRAS)}{tables}>>"] if {"pages", "tables", "cells"} & set(kinds) else []
    fields += [f"assets map<string, {_ASSET}>"] * ("assets" in kinds) + [f"embedded_media array<{_MEDIA}>"] * ("media" in kinds)
    return ", ".join([*fields, "_bad string"])


def _there(array: Column) -> Column:
    return F.filter(F.coalesce(array, F.array()), lambda x: x.isNotNull())


def _extras(x: Column, names: tuple[str, ...], kinds: tuple[str, ...]) -> list[Column]:
    return [x[n].alias(n) for n in names if n in kinds]


def _pages(items: Column, typed: bool, kinds: tuple[str, ...]) -> Column:
    """array<struct<page, ordinal, text, preview, images, and if deep tables>> of the page list: typed structs, or raw JSON texts."""

    def page(x: Column, i: Column) -> Column:
        p = x if typed else F.from_json(x, "number string, text string, preview string, images string, tables string, text_items string, locator string")
        number = F.coalesce(_number(p["number"]), (i + 1).cast("string"))
        return F.struct(number.alias("page"), (i + 1).alias("ordinal"), p["text"].alias("text"), p["preview"].alias("preview"), p["images"].alias("images"), *_extras(p, PAGE_EXTRAS, kinds), *([p["tables"].alias("tables")] if {"tables", "cells"} & set(kinds) else []))

    return F.transform(items, page)


def _tables(pages: Column, typed: bool, kinds: tuple[str, ...]) -> Column:
    """array<struct<page, table, ordinal, rows, cols, asset, and if deep cells>> over all pages."""

    def of_page(p: Column) -> Column:
        def table(x: Column, i: Column) -> Column:
            t = x if typed else F.from_json(x, "id string, rows string, cols string, asset string, provenance string, cells string")
            return F.struct(p["page"].alias("page"), t["id"].alias("table"), (i + 1).alias("ordinal"), _number(t["rows"]).alias("rows"), _number(t["cols"]).alias("cols"), t["asset"].alias("asset"), *_extras(t, TABLE_EXTRAS, kinds), *([t["cells"].alias("cells")] if "cells" in kinds else []))

        return F.transform(_there(p["tables"]) if typed else _objects(p["tables"]), table)

    return F.flatten(F.transform(pages, of_page))


def _cells(tables: Column, typed: bool, kinds: tuple[str, ...]) -> Column:
    """array<struct<page, table, row, col, ...>> over all tables."""

    def of_table(t: Column) -> Column:
        def cell(x: Column, i: Column) -> Column:
            c = x if typed else F.from_json(x, "row string, col string, rowspan string, colspan string, text string, header boolean, bbox string")
            return F.struct(
                t["page"].alias("page"), t["table"].alias("table"), (i + 1).alias("ordinal"), _number(c["row"]).alias("row"), _number(c["col"]).alias("col"),
                _number(c["rowspan"]).alias("rowspan"), _number(c["colspan"]).alias("colspan"), c["text"].alias("text"), c["header"].alias("header"), *_extras(c, CELL_EXTRAS, kinds),
            )

        return F.transform(_there(t["cells"]) if typed else _objects(t["cells"]), cell)

    return F.flatten(F.transform(tables, of_table))


def _assets(record: Column, typed: bool) -> Column:
    """array<struct<asset, sha256, bytes, media_type, role>> of the address map."""
    raw = record["assets"]
    given = raw if typed else F.from_json(F.when(raw.startswith("{"), raw), "map<string,string>")
    entries = F.map_entries(F.coalesce(given, F.create_map()))

    def asset(e: Column) -> Column:
        a = e["value"] if typed else F.from_json(F.when(e["value"].startswith("{"), e["value"]), "sha256 string, bytes string, media_type string, role string")
        return F.struct(e["key"].alias("asset"), a["sha256"].alias("sha256"), _number(a["bytes"]).alias("bytes"), a["media_type"].alias("media_type"), a["role"].alias("role"))

    return F.transform(entries, asset)


def _media(record: Column, typed: bool) -> Column:
    """array<struct<asset, package_part, ordinal>> of the media list."""

    def item(x: Column, i: Column) -> Column:
        m = x if typed else F.from_json(x, "asset string, package_part string")
        return F.struct(m["asset"].alias("asset"), m["package_part"].alias("package_part"), (i + 1).alias("ordinal"))

    return F.transform(_there(record["embedded_media"]) if typed else _objects(record["embedded_media"]), item)


def shredded(extractions: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """version_id with one array column per wanted child kind: pages, tables, cells, assets, media.

    kinds may also name ``PAGE_EXTRAS``, ``TABLE_EXTRAS`` and ``CELL_EXTRAS`` beside their kind.
    """
    # No filter stands between the steps: it would be pushed down and parse every record again. Damaged records give null arrays.
    fits = F.col("_t._bad").isNull()
    df = _complete(extractions).withColumn("_t", F.from_json("_p", _schema(kinds), {"columnNameOfCorruptRecord": "_bad"}))
    df = df.withColumn("_r", F.when(~fits, _raw(F.col("_p"))))
    own = [("t", True, fits), ("r", False, ~fits & F.col("_r._bad").isNull())]
    layers: list[list] = [[], [], []]
    for x, typed, mine in own:
        record = F.col(f"_{x}")
        if {"pages", "tables", "cells"} & set(kinds):
            layers[0].append(F.when(mine, _pages(_there(record["pages"]) if typed else _objects(record["pages"]), typed, kinds)).alias(f"{x}_pages"))
        if {"tables", "cells"} & set(kinds):
            layers[1].append(_tables(F.col(f"{x}_pages"), typed, kinds).alias(f"{x}_tables"))
        if "cells" in kinds:
            layers[2].append(_cells(F.col(f"{x}_tables"), typed, kinds).alias(f"{x}_cells"))
        layers[0] += [F.when(mine, f(record, typed)).alias(f"{x}_{k}") for k, f in (("assets", _assets), ("media", _media)) if k in kinds]
    df = df.select("version_id", *layers[0])
    for more in layers[1:]:
        if more:
            df = df.select("*", *more)
    plain = {
        "pages": lambda c: F.transform(c, lambda p: F.struct(p["page"].alias("page"), p["ordinal"].alias("ordinal"), p["text"].alias("text"), p["preview"].alias("preview"), p["images"].alias("images"), *_extras(p, PAGE_EXTRAS, kinds))),
        "tables": lambda c: F.transform(c, lambda t: F.struct(*[t[n].alias(n) for n in ("page", "table", "ordinal", "rows", "cols", "asset")], *_extras(t, TABLE_EXTRAS, kinds))),
    }
    one = lambda c: c
    return df.select("version_id", *[F.coalesce(plain.get(k, one)(F.col(f"t_{k}")), plain.get(k, one)(F.col(f"r_{k}"))).alias(k) for k in KINDS if k in kinds])


def _shredded(df: DataFrame, ready: bool, *kinds: str) -> DataFrame:
    """ready: df already comes from :func:`shredded` (written once, for several tables)."""
    return df if ready else shredded(df, kinds)


def page_table(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, page, ordinal, text, preview: one distinct row per page object."""
    return _shredded(extractions, ready, "pages").select("version_id", F.inline("pages")).drop("images").distinct()


def table_table(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, page, table, ordinal, rows, cols, asset."""
    return _shredded(extractions, ready, "tables").select("version_id", F.inline("tables")).distinct()


def cell_table(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, page, table, ordinal, row, col, rowspan, colspan, text, header."""
    return _shredded(extractions, ready, "cells").select("version_id", F.inline("cells")).distinct()


def asset_table(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, asset, sha256, bytes, media_type, role."""
    return _shredded(extractions, ready, "assets").select("version_id", F.inline("assets")).distinct()


def media_table(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, asset, package_part, ordinal."""
    return _shredded(extractions, ready, "media").select("version_id", F.inline("media")).distinct()


def asset_references(extractions: DataFrame, ready: bool = False) -> DataFrame:
    """version_id, asset, kind (preview, image, table, media): every reference of a record to an asset."""
    one = lambda kind, x: F.struct(x.alias("asset"), F.lit(kind).alias("kind"))
    images = F.flatten(F.transform("pages", lambda p: F.transform(F.coalesce(F.from_json(F.when(p["images"].startswith("["), p["images"]), "array<string>"), F.array().cast("array<string>")), lambda x: one("image", x))))
    every = F.concat(
        F.transform("pages", lambda p: one("preview", p["preview"])), images, F.transform("tables", lambda t: one("table", t["asset"])), F.transform("media", lambda m: one("media", m["asset"]))
    )
    return _shredded(extractions, ready, "pages", "tables", "media").select("version_id", F.inline(every)).filter(F.coalesce("asset", F.lit("")) != "").distinct()


def links(extractions: DataFrame) -> DataFrame:
    """version_id, child_kind, parent_key, child_key: every child object once, over all five tables."""

    def as_links(kind: str, col: str, parent, child) -> Column:
        return F.transform(F.col(col), lambda x: F.struct(F.lit(kind).alias("child_kind"), F.coalesce(parent(x), F.lit("")).alias("parent_key"), child(x).alias("child_key")))

    own = F.col("version_id")
    every = F.flatten(
        F.array(
            as_links("page", "pages", lambda x: own, lambda x: x["page"]),
            as_links("table", "tables", lambda x: x["page"], lambda x: x["table"]),
            as_links("cell", "cells", lambda x: x["table"], lambda x: F.concat_ws(",", x["row"], x["col"])),
            as_links("asset", "assets", lambda x: F.lit(""), lambda x: x["asset"]),
            as_links("media", "media", lambda x: x["asset"], lambda x: x["package_part"]),
        )
    )
    return shredded(extractions).select("version_id", F.inline(every)).distinct()
