"""Queries of the general data-processing problems over the standard tables, and their SQL."""

from __future__ import annotations

from contextlib import suppress
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators import hierarchy, incremental, nested, orphans
from shelfmark.session import new_path, table, written


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.links(table(spark, sf, "extractions"))


def p1_pages(spark: SparkSession, sf: str) -> DataFrame:
    return nested.page_table(table(spark, sf, "extractions"))


def p1_tables(spark: SparkSession, sf: str) -> DataFrame:
    return nested.table_table(table(spark, sf, "extractions"))


def p1_cells(spark: SparkSession, sf: str) -> DataFrame:
    return nested.cell_table(table(spark, sf, "extractions"))


def p1_assets(spark: SparkSession, sf: str) -> DataFrame:
    return nested.asset_table(table(spark, sf, "extractions"))


def p1_media(spark: SparkSession, sf: str) -> DataFrame:
    return nested.media_table(table(spark, sf, "extractions"))


def _references(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    in_effect = written(orphans.rows_in_effect(table(spark, sf, "entries")), "in-effect")
    return orphans.library_references(in_effect, table(spark, sf, "inventory_roots"), table(spark, sf, "versions"), table(spark, sf, "documents"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return orphans.report_columns(orphans.orphan_rows(*_references(spark, sf)))


def p2_orphan_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = orphans.orphan_counts(*_references(spark, sf))
    return counts.select(F.substring_index("group", ".", 1).alias("table_name"), F.substring_index("group", ".", -1).alias("field_name"), F.col("period").alias("period_month"), "n_references", "n_orphans", "n_missing_keys")


def _landed(spark: SparkSession, sf: str, until: datetime | None = None) -> DataFrame:
    versions = table(spark, sf, "versions")
    if until is not None:
        versions = versions.filter(F.col("landed_at") < F.lit(until).cast("timestamp_ntz"))
    return written(incremental.landed_sources(versions, table(spark, sf, "documents"), table(spark, sf, "scans")), "landed")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The first run over a new state: every partition counts as changed."""
    found, _ = incremental.bring_up_to_date(_landed(spark, sf), new_path(spark, "incremental"))
    return found.select("source_path", "source_hash")


#: Time of the first run of p3_second_run.
FIRST_RUN = datetime(2025, 5, 15)


class _Lost(Exception):
    """Stands for the end of a run's driver."""


def p3_second_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run over what had landed by ``FIRST_RUN``, one that dies before its commit, and one over all: each content with the run it came out in."""
    folder = new_path(spark, "incremental")
    incremental.bring_up_to_date(_landed(spark, sf, FIRST_RUN), folder)
    landed = _landed(spark, sf)

    def dies() -> None:
        raise _Lost

    with suppress(_Lost):
        incremental.bring_up_to_date(landed, folder, dies)
    found, _ = incremental.bring_up_to_date(landed, folder)
    return found


def p3_partition_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    landed = _landed(spark, sf)
    return incremental.fingerprints(incremental.with_partition(landed, "source_path", incremental.buckets_for(landed, "root"), "root").drop("root"))


def _resolved(spark: SparkSession, sf: str, with_lines: bool) -> DataFrame:
    in_effect = written(orphans.rows_in_effect(table(spark, sf, "entries")), "in-effect")
    return hierarchy.resolve(in_effect, table(spark, sf, "inventory_roots"), with_lines)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.places(_resolved(spark, sf, False))


def p7_paths(spark: SparkSession, sf: str) -> DataFrame:
    return _resolved(spark, sf, True).select("file_id", F.array_join("path", "/").alias("path"))


def p7_descendants(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendants(_resolved(spark, sf, True))


def p7_descendant_counts(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.descendant_counts(_resolved(spark, sf, True))


def p7_rings(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.cycle_members(_resolved(spark, sf, False))


QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p1_tables, p1_cells, p1_assets, p1_media, p2_found, p2_orphan_counts, p3_found, p3_second_run, p3_partition_fingerprints, p7_found, p7_paths, p7_descendants, p7_descendant_counts, p7_rings)}

IN_EFFECT_SQL = """eff AS (
  SELECT file_id, parent_id, name, kind, captured_at, removed_at, size, integrity['sha256'] AS sha256 FROM (
    SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY captured_at DESC NULLS LAST, parent_id DESC NULLS LAST, name DESC NULLS LAST, kind DESC NULLS LAST, removed_at DESC NULLS LAST) AS rn
    FROM entries WHERE file_id IS NOT NULL) WHERE rn = 1)"""

_ORPHANS = f"""{IN_EFFECT_SQL},
refs AS (
  SELECT 'entries' AS table_name, 'parent_id' AS field_name, file_id AS row_key, parent_id AS k, parent_id AS missing_key, captured_at AS ref_at FROM eff WHERE trim(parent_id) <> ''
  UNION ALL
  SELECT 'entries', 'name', file_id, coalesce(parent_id, '') || chr(2) || left(name, length(name) - 3), left(name, length(name) - 3), captured_at
  FROM eff WHERE kind = 'file' AND regexp_matches(name, '(?s)^.+\\.(?i:pdf|docx|xlsx|txt|md|pptx)\\.md\\z')
  UNION ALL
  SELECT 'versions', 'document_id', version_id, document_id, document_id, created_at FROM versions WHERE trim(document_id) <> ''),
targets AS (
  SELECT 'entries' AS table_name, 'parent_id' AS field_name, file_id AS k, removed_at AS until FROM eff
  UNION ALL SELECT 'entries', 'parent_id', file_id, NULL FROM inventory_roots
  UNION ALL SELECT 'entries', 'name', coalesce(parent_id, '') || chr(2) || name, removed_at FROM eff WHERE kind = 'file'
  UNION ALL SELECT 'versions', 'document_id', document_id, removed_at FROM documents),
found AS (
  SELECT DISTINCT table_name, field_name, row_key, missing_key, strftime(ref_at, '%Y-%m') AS period_month FROM refs r
  WHERE NOT EXISTS (SELECT 1 FROM targets t WHERE t.table_name = r.table_name AND t.field_name = r.field_name AND t.k = r.k AND (t.until IS NULL OR t.until > r.ref_at)))"""

_LANDED = """cut AS (
  SELECT root, max(CASE WHEN complete AND success_at IS NOT NULL AND error IS NULL THEN attempted_at END) AS cutoff FROM scans GROUP BY root),
docs AS (
  SELECT d.document_id, d.source_path, c.cutoff, row_number() OVER (PARTITION BY d.document_id ORDER BY length(c.root) DESC NULLS LAST) AS rn
  FROM documents d LEFT JOIN cut c ON starts_with(d.source_path, c.root || '/'))"""

TREE_SQL = f"""{IN_EFFECT_SQL},
nodes AS (
  SELECT file_id, CASE WHEN trim(parent_id) <> '' THEN parent_id END AS parent_id, name FROM eff),
walk AS (
  SELECT n.file_id, n.file_id AS top_id, 0 AS tree_depth, 'loose' AS tree_state, n.name AS path, [n.file_id] AS line FROM nodes n
  WHERE n.parent_id IS NULL OR (n.parent_id NOT IN (SELECT file_id FROM nodes) AND n.parent_id NOT IN (SELECT file_id FROM inventory_roots))
  UNION ALL
  SELECT n.file_id, r.file_id, 1, 'rooted', r.name || '/' || n.name, [r.file_id, n.file_id] FROM nodes n JOIN inventory_roots r ON n.parent_id = r.file_id
  UNION ALL
  SELECT n.file_id, w.top_id, w.tree_depth + 1, w.tree_state, w.path || '/' || n.name, list_append(w.line, n.file_id) FROM walk w JOIN nodes n ON n.parent_id = w.file_id),
bound AS (SELECT n.* FROM nodes n WHERE n.file_id NOT IN (SELECT file_id FROM walk)),
chase AS (
  SELECT file_id, parent_id AS cur FROM bound
  UNION
  SELECT c.file_id, b.parent_id FROM chase c JOIN bound b ON b.file_id = c.cur),
ring_nodes AS (SELECT file_id FROM chase WHERE cur = file_id),
ringed AS (
  SELECT c.file_id, min(c.cur) AS top_id FROM chase c JOIN ring_nodes r ON r.file_id = c.cur GROUP BY c.file_id),
placed AS (
  SELECT file_id, top_id, tree_depth::BIGINT AS tree_depth, tree_state, path, line FROM walk
  UNION ALL
  SELECT r.file_id, r.top_id, -1, 'cycle', n.name, [r.file_id] FROM ringed r JOIN nodes n ON n.file_id = r.file_id)"""

RECORD_SQL = """clean AS (
  SELECT version_id, regexp_replace(payload, '^[\\s\\x{FEFF}]+|\\s+$', '', 'g') AS p FROM extractions),
one AS (
  SELECT version_id, CASE WHEN p LIKE '"%' AND json_valid(p) THEN regexp_replace(p::JSON->>'$', '^[\\s\\x{FEFF}]+|\\s+$', '', 'g') ELSE p END AS p FROM clean),
rec AS (SELECT version_id, p::JSON AS j FROM one WHERE p LIKE '{%' AND json_valid(p)),
pg AS (
  SELECT version_id, coalesce(x->>'$.number', CAST(i AS VARCHAR)) AS page, i AS ordinal, x->>'$.text' AS text, x->>'$.preview' AS preview, x->'$.tables' AS tables, x->'$.images' AS images, x->'$.text_items' AS text_items FROM (
    SELECT version_id, unnest(CASE json_type(j->'$.pages') WHEN 'ARRAY' THEN (j->'$.pages')::JSON[] WHEN 'OBJECT' THEN [j->'$.pages'] END) AS x, generate_subscripts(CASE json_type(j->'$.pages') WHEN 'ARRAY' THEN (j->'$.pages')::JSON[] WHEN 'OBJECT' THEN [j->'$.pages'] END, 1) AS i FROM rec)),
tb AS (
  SELECT version_id, page, x->>'$.id' AS tid, i AS ordinal, x->>'$.rows' AS n_rows, x->>'$.cols' AS n_cols, x->>'$.asset' AS asset, x->'$.cells' AS cells, x->'$.provenance' AS provenance FROM (
    SELECT version_id, page, unnest(CASE json_type(tables) WHEN 'ARRAY' THEN tables::JSON[] WHEN 'OBJECT' THEN [tables] END) AS x, generate_subscripts(CASE json_type(tables) WHEN 'ARRAY' THEN tables::JSON[] WHEN 'OBJECT' THEN [tables] END, 1) AS i FROM pg)),
ce AS (
  SELECT version_id, page, tid, i AS ordinal, x FROM (
    SELECT version_id, page, tid, unnest(CASE json_type(cells) WHEN 'ARRAY' THEN cells::JSON[] WHEN 'OBJECT' THEN [cells] END) AS x, generate_subscripts(CASE json_type(cells) WHEN 'ARRAY' THEN cells::JSON[] WHEN 'OBJECT' THEN [cells] END, 1) AS i FROM tb)),
ast AS (
  SELECT version_id, k AS asset, list_extract(CAST(json_extract(j, '$.assets.*') AS JSON[]), i) AS v FROM (
    SELECT version_id, j, unnest(json_keys(j, '$.assets')) AS k, generate_subscripts(json_keys(j, '$.assets'), 1) AS i FROM rec)),
md AS (
  SELECT version_id, x->>'$.asset' AS asset, x->>'$.package_part' AS package_part, i AS ordinal FROM (
    SELECT version_id, unnest(CASE json_type(j->'$.embedded_media') WHEN 'ARRAY' THEN (j->'$.embedded_media')::JSON[] WHEN 'OBJECT' THEN [j->'$.embedded_media'] END) AS x, generate_subscripts(CASE json_type(j->'$.embedded_media') WHEN 'ARRAY' THEN (j->'$.embedded_media')::JSON[] WHEN 'OBJECT' THEN [j->'$.embedded_media'] END, 1) AS i FROM rec))"""

SQL = {
    "p1_found": f"""WITH {RECORD_SQL}
SELECT DISTINCT version_id, 'page' AS child_kind, version_id AS parent_key, page AS child_key FROM pg
UNION SELECT version_id, 'table', page, tid FROM tb
UNION SELECT version_id, 'cell', tid, (x->>'$.row') || ',' || (x->>'$.col') FROM ce
UNION SELECT version_id, 'asset', '', asset FROM ast
UNION SELECT version_id, 'media', coalesce(asset, ''), package_part FROM md""",
    "p1_pages": f"WITH {RECORD_SQL} SELECT DISTINCT version_id, page, ordinal::INTEGER AS ordinal, text, preview FROM pg",
    "p1_tables": f'WITH {RECORD_SQL} SELECT DISTINCT version_id, page, tid AS "table", ordinal::INTEGER AS ordinal, n_rows AS "rows", n_cols AS cols, asset FROM tb',
    "p1_cells": f"""WITH {RECORD_SQL} SELECT DISTINCT version_id, page, tid AS "table", ordinal::INTEGER AS ordinal, x->>'$.row' AS "row", x->>'$.col' AS col, x->>'$.rowspan' AS rowspan, x->>'$.colspan' AS colspan, x->>'$.text' AS text, (x->>'$.header')::BOOLEAN AS header FROM ce""",
    "p1_assets": f"WITH {RECORD_SQL} SELECT DISTINCT version_id, asset, v->>'$.sha256' AS sha256, v->>'$.bytes' AS bytes, v->>'$.media_type' AS media_type, v->>'$.role' AS role FROM ast",
    "p1_media": f"WITH {RECORD_SQL} SELECT DISTINCT version_id, asset, package_part, ordinal::INTEGER AS ordinal FROM md",
    "p2_found": f"WITH {_ORPHANS} SELECT * FROM found",
    "p2_orphan_counts": f"""WITH {_ORPHANS},
tot AS (SELECT table_name, field_name, strftime(ref_at, '%Y-%m') AS period_month, count(DISTINCT (row_key, k)) AS n_references FROM refs GROUP BY ALL),
orp AS (
  SELECT table_name, field_name, period_month, count(*) AS n_orphans, count(DISTINCT k) AS n_missing_keys FROM (
    SELECT DISTINCT r.table_name, r.field_name, r.row_key, r.k, strftime(r.ref_at, '%Y-%m') AS period_month FROM refs r JOIN found f USING (table_name, field_name, row_key, missing_key)
    WHERE strftime(r.ref_at, '%Y-%m') = f.period_month) GROUP BY ALL)
SELECT t.table_name, t.field_name, t.period_month, t.n_references, coalesce(o.n_orphans, 0) AS n_orphans, coalesce(o.n_missing_keys, 0) AS n_missing_keys
FROM tot t LEFT JOIN orp o USING (table_name, field_name, period_month)""",
    "p3_found": f"""WITH {_LANDED}
SELECT d.source_path, lower(v.source_hash) AS source_hash FROM versions v JOIN docs d ON d.document_id = v.document_id AND d.rn = 1
WHERE v.source_hash IS NOT NULL GROUP BY d.source_path, lower(v.source_hash)
HAVING max(d.cutoff) IS NULL OR min(v.landed_at) > max(d.cutoff)""",
    "p3_second_run": f"""WITH {_LANDED},
c AS (
  SELECT d.source_path, lower(v.source_hash) AS source_hash, min(v.landed_at) AS first_landed, max(d.cutoff) AS cutoff
  FROM versions v JOIN docs d ON d.document_id = v.document_id AND d.rn = 1 WHERE v.source_hash IS NOT NULL GROUP BY ALL)
SELECT source_path, source_hash, CASE WHEN first_landed < TIMESTAMP '{FIRST_RUN}' THEN 1 ELSE 2 END AS run FROM c WHERE cutoff IS NULL OR first_landed > cutoff""",
    "p7_found": f"WITH RECURSIVE {TREE_SQL} SELECT file_id, top_id, tree_depth, tree_state FROM placed",
    "p7_paths": f"WITH RECURSIVE {TREE_SQL} SELECT file_id, path FROM placed",
    "p7_descendants": f"WITH RECURSIVE {TREE_SQL} SELECT unnest(line) AS ancestor_id, file_id, (len(line) - generate_subscripts(line, 1))::BIGINT AS distance FROM placed",
    "p7_descendant_counts": f"""WITH RECURSIVE {TREE_SQL}, d AS (SELECT unnest(line) AS ancestor_id, file_id, (len(line) - generate_subscripts(line, 1))::BIGINT AS distance FROM placed)
SELECT ancestor_id, count(*) AS n_descendants, max(distance) AS max_distance FROM d WHERE distance > 0 GROUP BY ancestor_id""",
    "p7_rings": f"WITH RECURSIVE {TREE_SQL} SELECT top_id AS ring_id, file_id FROM placed WHERE tree_state = 'cycle'",
}
