"""Tables of extraction records: spans, merges, grids, rendering, coverage."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import html_escaped

#: Limits of a table: rows, columns, places.
MAX_ROWS, MAX_COLS, MAX_PLACES = 10_000, 1_000, 100_000


def cell_places(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, row, col, r, c: every place that a cell covers, within the limits of a table."""
    valid = (F.col("rowspan") >= 1) & (F.col("colspan") >= 1) & (F.col("rowspan") * F.col("colspan") <= MAX_PLACES)
    down = F.explode(F.sequence(F.col("row"), F.col("row") + F.col("rowspan") - 1)).alias("r")
    return cells.filter(valid).select(*keys, "row", "col", "colspan", down).select(*keys, "row", "col", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("colspan") - 1)).alias("c"))


def overlaps(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, r, c, n of places that more than one cell covers."""
    return cell_places(cells, keys).groupBy(*keys, "r", "c").agg(F.count("*").alias("n")).filter("n > 1")


def span_problems(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, problem: tables outside the limits, and cells outside their table. tables: keys, rows, cols."""
    size = tables.filter((F.col("rows") > MAX_ROWS) | (F.col("cols") > MAX_COLS) | (F.col("rows") * F.col("cols") > MAX_PLACES) | (F.col("rows") < 0) | (F.col("cols") < 0)).select(*keys, F.lit("dimensions").alias("problem"))
    out = (F.col("row") < 0) | (F.col("col") < 0) | (F.col("rowspan") < 1) | (F.col("colspan") < 1) | (F.col("row") + F.col("rowspan") > F.col("rows")) | (F.col("col") + F.col("colspan") > F.col("cols"))
    span = cells.join(tables, keys).filter(out).select(*keys, F.lit("span").alias("problem"))
    return size.unionByName(span).distinct()


def visible_cells(cells: DataFrame, merges: DataFrame, sheet: str = "sheet") -> DataFrame:
    """Cells (sheet, row, col) that no merged range (sheet, r1, r2, c1, c2) hides: outside of all, or its origin.

    The range join is made an equi-join on the places that the ranges cover.
    """
    hidden = merges.select(sheet, F.col("r1").alias("_r1"), F.col("c1").alias("_c1"), F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2")
    hidden = hidden.select(sheet, "row", F.explode(F.sequence("c1", "c2")).alias("col"), "_r1", "_c1").filter((F.col("row") != F.col("_r1")) | (F.col("col") != F.col("_c1"))).select(sheet, "row", "col").distinct()
    return cells.join(hidden, [sheet, "row", "col"], "left_anti")


def column_counts(cells: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_cols, n_rows: what the cells of each table reach."""
    return cells.groupBy(*keys).agg(F.max(F.col("col") + F.col("colspan")).alias("n_cols"), F.max(F.col("row") + F.col("rowspan")).alias("n_rows"))


def table_html(cells: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """keys, html of each table (rows, cols within the limits), spans kept, text escaped, uncovered places as empty cells.

    A table has at most ``MAX_PLACES`` places, so the rows of one are a bounded group.
    """
    grid = tables.filter((F.col("rows") > 0) & (F.col("cols") > 0) & (F.col("rows") <= MAX_ROWS) & (F.col("cols") <= MAX_COLS) & (F.col("rows") * F.col("cols") <= MAX_PLACES))
    places = grid.select(*keys, "cols", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r")).select(*keys, "r", F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("c"))
    covered = cell_places(cells, keys).groupBy(*keys, "r", "c").agg(F.lit(True).alias("covered"))
    tag = F.when(F.coalesce("header", F.lit(False)), "th").otherwise("td")
    start = cells.select(*keys, F.col("row").alias("r"), F.col("col").alias("c"), F.concat(F.lit("<"), tag, F.lit(' rowspan="'), F.col("rowspan").cast("string"), F.lit('" colspan="'), F.col("colspan").cast("string"), F.lit('">'), html_escaped(F.coalesce("text", F.lit(""))), F.lit("</"), tag, F.lit(">")).alias("cell"))
    on = [*keys, "r", "c"]
    full = places.join(start.dropDuplicates(on), on, "left").join(covered, on, "left").withColumn("cell", F.coalesce("cell", F.when(F.col("covered").isNull(), "<td></td>").otherwise("")))
    lines = full.groupBy(*keys, "r").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c", "cell"))), lambda x: x["cell"]), "").alias("line"))
    body = lines.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat(F.lit("<tr>"), "line", F.lit("</tr>")).alias("l")))), lambda x: x["l"]), "\n").alias("b"))
    return body.select(*keys, F.concat(F.lit("<table>\n"), "b", F.lit("\n</table>")).alias("html"))


_GRID = "row int, col int, rowspan int, colspan int, text string, header boolean"


def place_in_grid(rows: DataFrame, key: str) -> DataFrame:
    """key, row, col, rowspan, colspan, text, header: where the cells of table rows come to stand.

    rows: key, r (row), i (order in the row), rowspan, colspan, text, header. A cell takes the next column that no span from
    above fills. One table is a bounded group.
    """

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: set[tuple[int, int]] = set()
        out, at = [], (-1, 0)
        for x in pdf.sort_values(["r", "i"]).itertuples():
            c = at[1] if at[0] == x.r else 0
            while (x.r, c) in taken:
                c += 1
            rs, cs = max(1, int(x.rowspan)), max(1, int(x.colspan))
            taken.update((a, b) for a in range(x.r, x.r + rs) for b in range(c, c + cs))
            out.append((getattr(x, key), x.r, c, rs, cs, x.text, bool(x.header)))
            at = (x.r, c + cs)
        return pd.DataFrame(out, columns=[key, "row", "col", "rowspan", "colspan", "text", "header"])

    bounded = rows.filter((F.col("rowspan") <= MAX_ROWS) & (F.col("colspan") <= MAX_COLS))
    return bounded.groupBy(key).applyInPandas(place, f"{key} {rows.schema[key].dataType.simpleString()}, {_GRID}")


def page_coverage(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """version_id, missing, extra, duplicated: page numbers against 1..n. expected: version_id, n."""
    have = pages.groupBy("version_id").agg(F.collect_set("number").alias("have"), F.count("number").alias("rows"))
    joined = expected.join(have, "version_id", "left")
    want = F.when(F.col("n") >= 1, F.sequence(F.lit(1), F.col("n").cast("int"))).otherwise(F.array().cast("array<int>"))
    got = F.coalesce("have", F.array().cast("array<int>"))
    return joined.select("version_id", F.size(F.array_except(want, got)).alias("missing"), F.size(F.array_except(got, want)).alias("extra"), (F.coalesce("rows", F.lit(0)) - F.size(got)).alias("duplicated"))


def table_pages(tables: DataFrame, keys: list[str], pages: str = "pages") -> DataFrame:
    """keys, page: the pages over which a table reaches, by its provenance."""
    return tables.select(*keys, F.explode(F.array_distinct(pages)).alias("page"))


def with_cached_value(cells: DataFrame, values: DataFrame) -> DataFrame:
    """Formula cells with the value cached for their place (sheet, coordinate)."""
    return cells.join(values.select("sheet", "coordinate", "value"), ["sheet", "coordinate"], "left")


def paired_by_position(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The n-th item of each key on the left with the n-th on the right. left, right: key, position, item."""
    a = left.select(key, "position", F.col("item").alias("left_item"))
    b = right.select(key, "position", F.col("item").alias("right_item"))
    return a.join(b, [key, "position"], "full_outer")


def provenance_problem(provenance: str = "provenance", pages: str = "expected_pages"):
    """Code of an invalid provenance list of struct<page, bbox, charspan>; null if all are valid."""
    ok = F.forall(provenance, lambda p: (p["page"] >= 1) & F.array_contains(F.col(pages), p["page"]) & p["bbox"].isNotNull() & (F.size(p["charspan"]) == 2) & F.forall(p["charspan"], lambda x: x >= 0))
    return F.when(~F.coalesce(ok, F.lit(False)), "DOCLING_INVALID_PROVENANCE")


def texts_of_page(items: str, page):
    """Items without provenance, or with one on the page."""
    return F.filter(items, lambda i: (F.size(i["prov"]) == 0) | F.exists(i["prov"], lambda p: p["page"] == page))
