"""Queries of the document library over the standard tables, and their SQL."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import assets, health, hierarchy, incremental, inventory, navigation, nested, quality, reading, search, tables, versions
from shelfmark.plans.general_queries import RECORD_SQL, TREE_SQL
from shelfmark.session import table, written
from shelfmark.sources import bundle
from shelfmark.streaming import settle

#: Terms, kind and time of the standard queries.
QUERY = "linearity series"
KIND = "guide"
NOW = datetime(2025, 6, 20)
NOW_SECONDS = 1_750_000_000.0
QUIET = 30 * 86_400.0


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


# --- search ----------------------------------------------------------------------------------------------------------


def search_all_terms(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(*_t(spark, sf, "versions", "documents", "pages"), query=QUERY)


def search_kind_filter(spark: SparkSession, sf: str) -> DataFrame:
    return search.search(*_t(spark, sf, "versions", "documents", "pages"), query=QUERY, kind=KIND)


def search_first_results(spark: SparkSession, sf: str) -> DataFrame:
    return search.first_results(search_all_terms(spark, sf))


# --- versions --------------------------------------------------------------------------------------------------------


def newer_candidate(spark: SparkSession, sf: str) -> DataFrame:
    return versions.newer_candidates(*_t(spark, sf, "versions", "documents"))


def latest_version(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest(table(spark, sf, "versions")).select("document_id", "version_id", "quality")


def latest_by_path(spark: SparkSession, sf: str) -> DataFrame:
    return versions.latest_by_path(*_t(spark, sf, "versions", "documents")).select("source_path", "version_id")


def version_history(spark: SparkSession, sf: str) -> DataFrame:
    return versions.history_positions(table(spark, sf, "versions"))


def audit_tail(spark: SparkSession, sf: str) -> DataFrame:
    return versions.audit_tail(table(spark, sf, "events")).select("event_id", "event_type", "props")


def status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.status_counts(*_t(spark, sf, "versions", "documents"))


def quality_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return versions.quality_histogram(table(spark, sf, "versions"))


def kind_map(spark: SparkSession, sf: str) -> DataFrame:
    return versions.kind_map(*_t(spark, sf, "versions", "documents"))


def publish_gate(spark: SparkSession, sf: str) -> DataFrame:
    return versions.publishable(table(spark, sf, "versions"))


def duplicate_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    return versions.duplicate_fingerprints(table(spark, sf, "versions"))


def identical_sources(spark: SparkSession, sf: str) -> DataFrame:
    return versions.identical_sources(table(spark, sf, "versions"))


def unchanged_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Paths whose latest version has the bytes of the version current there."""
    v, d = _t(spark, sf, "versions", "documents")
    observed = versions.current(v, d).select(F.col("source_path").alias("path"), F.col("source_hash").alias("sha256"))
    last = versions.latest(v).join(versions.once(v).select("version_id", "source_hash"), "version_id").join(d.select("document_id", "source_path"), "document_id")
    return versions.unchanged(observed, last.select(F.col("source_path").alias("path"), F.col("source_hash").alias("sha256"), "quality"))


def lifecycle_replay(spark: SparkSession, sf: str) -> DataFrame:
    return versions.replayed(table(spark, sf, "events"))


def metadata_digest(spark: SparkSession, sf: str) -> DataFrame:
    fields = ["aliases", "brand", "external_reference", "kind", "language", "model", "title"]
    doc = tx.canonical(*[(f, F.col(f"metadata.{f}")) for f in fields])
    return versions.once(table(spark, sf, "versions")).select("version_id", tx.digest(doc).alias("sha256"))


def metadata_violations(spark: SparkSession, sf: str) -> DataFrame:
    return assets.metadata_problems(table(spark, sf, "versions"))


# --- quality ---------------------------------------------------------------------------------------------------------


def page_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.page_quality(*_t(spark, sf, "versions", "pages"))


def sidecar_status(spark: SparkSession, sf: str) -> DataFrame:
    p = versions.pages_once(table(spark, sf, "pages"))
    return p.groupBy(quality.sidecar_status(F.coalesce("text", F.lit(""))).alias("status")).agg(F.count("*").alias("n"))


def leak_guard(spark: SparkSession, sf: str) -> DataFrame:
    return quality.leak_counts(table(spark, sf, "documents"))


def markdown_images(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").agg(F.count("*").alias("n"), F.count_if(quality.markdown_images(F.col("text"))).alias("n_with_images"))


def pipeline_markers(spark: SparkSession, sf: str) -> DataFrame:
    logs = table(spark, sf, "scans").select("scan_id", F.coalesce("error", F.lit("")).alias("log")).distinct()
    return logs.select("scan_id", F.array_join(quality.pipeline_markers(F.col("log"), F.lit(False)), ",").alias("markers"))


# --- reading and navigation ------------------------------------------------------------------------------------------


def langextract_spans(spark: SparkSession, sf: str) -> DataFrame:
    return reading.spans(table(spark, sf, "pages"))


def joined_text_digest(spark: SparkSession, sf: str) -> DataFrame:
    return reading.joined_text(table(spark, sf, "pages")).select("version_id", tx.digest(F.col("text")).alias("sha256"))


def rendered_page_digest(spark: SparkSession, sf: str) -> DataFrame:
    p = versions.pages_once(table(spark, sf, "pages"))
    return p.select("version_id", "number", tx.digest(reading.rendered(F.col("text"), F.col("preview"))).alias("sha256"))


def full_markdown_digest(spark: SparkSession, sf: str) -> DataFrame:
    return reading.full_markdown_digest(*_t(spark, sf, "versions", "pages"))


def first_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Page 1 of every current version, its length."""
    cur = versions.current(*_t(spark, sf, "versions", "documents")).select("version_id")
    p = versions.pages_once(table(spark, sf, "pages")).filter("number = 1")
    return p.join(cur.distinct(), "version_id", "left_semi").select("version_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_chars"))


def brief_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    return versions.pages_once(table(spark, sf, "pages")).select("version_id", "number", tx.excerpt(F.col("text")).alias("excerpt"))


def brief_tree(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.brief_leaves(table(spark, sf, "pages")).select("version_id", "number", "card", "position", "depth")


def brief_card_digest(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.brief_cards(table(spark, sf, "pages")).select("version_id", "card", tx.digest(F.col("markdown")).alias("sha256"))


def _catalog(spark: SparkSession, sf: str) -> DataFrame:
    root = F.concat(F.lit("groups/"), F.substring(F.sha2("source", 256), 1, 16), F.lit(".md"))
    return navigation.catalog_leaves(table(spark, sf, "documents"), "source", ["doc_id"], F.col("source_path"), root)


def catalog_tree(spark: SparkSession, sf: str) -> DataFrame:
    return _catalog(spark, sf).select("source", "doc_id", "card", "position", "depth")


def catalog_sizes(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.tree_sizes(_catalog(spark, sf), "source")


def title_labels(spark: SparkSession, sf: str) -> DataFrame:
    return versions.once(table(spark, sf, "versions")).select("version_id", tx.label(F.col("metadata.title")).alias("label"))


# --- inventory -------------------------------------------------------------------------------------------------------


def _scope(spark: SparkSession, sf: str) -> DataFrame:
    entries, roots = _t(spark, sf, "entries", "inventory_roots")
    full = written(inventory.in_effect_full(entries), "inventory")
    return inventory.scoped(hierarchy.resolve(full, roots, False, carry=inventory.CARRIED), roots)


def inventory_ancestry(spark: SparkSession, sf: str) -> DataFrame:
    return _scope(spark, sf).select("file_id", "top_id", "archived")


def inventory_classes(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.classified(_scope(spark, sf)).select("file_id", "class")


def inventory_counts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.class_counts(_scope(spark, sf))


def inventory_missing_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.without_sidecar(_scope(spark, sf))


def inventory_orphan_sidecars(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.without_original(_scope(spark, sf))


def inventory_empty_files(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.empty_files(_scope(spark, sf))


def inventory_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.name_conflicts(_scope(spark, sf))


def inventory_identical_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.identical_bytes(_scope(spark, sf))


def inventory_violations(spark: SparkSession, sf: str) -> DataFrame:
    return inventory.violations(table(spark, sf, "entries")).distinct()


def name_parts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("name")
    return table(spark, sf, "entries").select("name").distinct().select("name", tx.suffix(n).alias("suffix"), tx.extension(n).alias("extension"), tx.is_sidecar(n).alias("sidecar"))


# --- sources ---------------------------------------------------------------------------------------------------------


def source_health(spark: SparkSession, sf: str) -> DataFrame:
    scans = table(spark, sf, "scans")
    return health.source_health(scans, scans, NOW)


def all_sources_fresh(spark: SparkSession, sf: str) -> DataFrame:
    return health.all_fresh(source_health(spark, sf))


def missing_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Removed documents under roots whose last scan was complete."""
    d, scans = _t(spark, sf, "documents", "scans")
    last = health.last_scans(scans)
    known = incremental.with_root(d.select("document_id", "source_path", "removed_at"), last.select("root", F.col("attempted_at").alias("cutoff"))).select("root", F.col("source_path").alias("path"), "removed_at")
    return health.missing_sources(known, known.filter("removed_at IS NULL"), last.filter("complete"))


def settle_batch(spark: SparkSession, sf: str) -> DataFrame:
    v, d = _t(spark, sf, "versions", "documents")
    once = versions.once(v).filter("source_hash IS NOT NULL").join(d.select("document_id", "source_path"), "document_id")
    sides = once.groupBy("source_path").agg(F.max(F.struct("created_at", "version_id", "source_hash")).alias("l"), F.min(F.struct("created_at", "version_id", "source_hash")).alias("f"))
    seconds = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    observed = sides.select(F.col("source_path").alias("path"), F.lower("l.source_hash").alias("signature"), seconds("l.created_at").alias("mtime"))
    previous = sides.select(F.col("source_path").alias("path"), F.lower("f.source_hash").alias("signature"), seconds("f.created_at").alias("stable_since"))
    return health.settle_states(observed, previous, NOW_SECONDS, QUIET).select("path", "state")


def settle_observations(spark: SparkSession, sf: str) -> DataFrame:
    """The landed versions as observations of their paths, settled in order of landing."""
    v, d = _t(spark, sf, "versions", "documents")
    rows = v.filter("source_hash IS NOT NULL").join(d.select("document_id", "source_path"), "document_id")
    seconds = lambda c: (F.unix_micros(F.col(c).cast("timestamp")) / 1e6)
    observed = rows.select(F.col("source_path").alias("path"), F.lower("source_hash").alias("signature"), seconds("created_at").alias("mtime"), seconds("landed_at").alias("seen_at")).distinct()
    return settle.settle_observations(observed, QUIET).select("path", "signature", "seen_at", "stable_since", "state")


def nested_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Folders of documents that lie in one another."""
    folder = F.regexp_replace("source_path", "/[^/]*$", "")
    return assets.overlapping_paths(table(spark, sf, "documents").select(folder.alias("path")))


# --- assets, tables, coverage, bundle --------------------------------------------------------------------------------


def _shred(spark: SparkSession, sf: str, *kinds: str) -> DataFrame:
    """The wanted kinds of the records taken apart once, for queries that need several of their tables; pages without their texts."""
    parts = nested.shredded(table(spark, sf, "extractions"), kinds)
    if "pages" in kinds:
        parts = parts.withColumn("pages", F.transform("pages", lambda p: F.struct(p["preview"].alias("preview"), p["images"].alias("images"))))
    return written(parts, "shredded")


def asset_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    x = _shred(spark, sf, "pages", "tables", "assets", "media")
    return assets.unresolved(nested.asset_references(x, True), nested.asset_table(x, True))


def asset_violations(spark: SparkSession, sf: str) -> DataFrame:
    return assets.manifest_problems(nested.asset_table(table(spark, sf, "extractions")))


def asset_totals(spark: SparkSession, sf: str) -> DataFrame:
    return assets.asset_totals(nested.asset_table(table(spark, sf, "extractions")))


def unlocated_media(spark: SparkSession, sf: str) -> DataFrame:
    x = _shred(spark, sf, "pages", "tables", "media")
    return assets.unlocated_media(nested.media_table(x, True), nested.asset_references(x, True).filter("kind = 'image'"))


def page_coverage(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "pages")
    return tables.page_coverage(p, p.groupBy("version_id").agg(F.max("number").alias("n")))


_KEYS = ["version_id", "page", "table"]


def _cells(x: DataFrame) -> DataFrame:
    c = nested.cell_table(x, True)
    return c.select(*_KEYS, *[F.col(k).try_cast("int").alias(k) for k in ("row", "col", "rowspan", "colspan")], "text", "header").distinct()


def _sizes(x: DataFrame) -> DataFrame:
    t = nested.table_table(x, True)
    return t.groupBy(*_KEYS).agg(F.max(F.col("rows").try_cast("int")).alias("rows"), F.max(F.col("cols").try_cast("int")).alias("cols"))


def span_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return tables.overlaps(_cells(_shred(spark, sf, "cells")), _KEYS)


def span_reach(spark: SparkSession, sf: str) -> DataFrame:
    return tables.column_counts(_cells(_shred(spark, sf, "cells")), _KEYS)


def span_problems(spark: SparkSession, sf: str) -> DataFrame:
    x = _shred(spark, sf, "tables", "cells")
    return tables.span_problems(_cells(x), _sizes(x), _KEYS)


def table_html_digest(spark: SparkSession, sf: str) -> DataFrame:
    x = _shred(spark, sf, "tables", "cells")
    cells = written(_cells(x), "cells")
    clean = cells.join(tables.overlaps(cells, _KEYS).select(*_KEYS).distinct(), _KEYS, "left_anti")
    return tables.table_html(clean, _sizes(x), _KEYS).select(*_KEYS, tx.digest(F.col("html")).alias("sha256"))


def visible_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as cells of a sheet per order, with orders' first lines as merged ranges."""
    cells = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sheet"), F.col("l_linenumber").alias("row"), F.lit(1).alias("col"))
    merges = cells.groupBy("sheet").agg(F.lit(1).alias("r1"), F.least(F.max("row"), F.lit(3)).alias("r2"), F.lit(1).alias("c1"), F.lit(2).alias("c2"))
    return tables.visible_cells(cells, merges)


def bundle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.manifest(bundle.bundle_files(*_t(spark, sf, "versions", "documents", "pages")))


QUERIES = {
    f.__name__: f
    for f in (
        search_all_terms, search_kind_filter, search_first_results, newer_candidate, latest_version, latest_by_path, version_history, audit_tail, status_counts, quality_histogram, kind_map, publish_gate,
        duplicate_fingerprints, identical_sources, unchanged_sources, lifecycle_replay, metadata_digest, metadata_violations, page_quality, sidecar_status, leak_guard, markdown_images, pipeline_markers, langextract_spans,
        joined_text_digest, rendered_page_digest, full_markdown_digest, first_pages, brief_excerpts, brief_tree, brief_card_digest, catalog_tree, catalog_sizes, title_labels, inventory_ancestry, inventory_classes, inventory_counts,
        inventory_missing_sidecars, inventory_orphan_sidecars, inventory_empty_files, inventory_conflicts, inventory_identical_bytes, inventory_violations, name_parts, source_health, all_sources_fresh, missing_sources, settle_batch,
        settle_observations, nested_paths, asset_unresolved, asset_violations, asset_totals, unlocated_media, page_coverage, span_overlap, span_reach, span_problems, table_html_digest, visible_cells, bundle_manifest,
    )
}

_V = "v AS (SELECT DISTINCT version_id, document_id, fingerprint, source_hash, metadata, filename, quality, created_at FROM versions WHERE version_id IS NOT NULL)"
_P = "pg0 AS (SELECT DISTINCT version_id, number, text, preview FROM pages WHERE version_id IS NOT NULL AND number IS NOT NULL)"
_CUR = f"{_V}, cur AS (SELECT v.* EXCLUDE (document_id), d.document_id, d.source_path FROM v JOIN documents d ON d.current_version = v.version_id)"
_LATEST = f"{_V}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at DESC, version_id DESC) AS rn FROM v WHERE document_id IS NOT NULL) WHERE rn = 1)"
_SPACE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_SPACE}+|{_SPACE}+$', '', 'g')"


def _label(x: str) -> str:
    return f"replace(replace(replace(replace(regexp_replace({_strip(x)}, '{_SPACE}+', ' ', 'g'), '[', '\\['), ']', '\\]'), '<', '&lt;'), '>', '&gt;')"


def _excerpt(x: str) -> str:
    return f"CASE WHEN {_strip(f"coalesce({x}, '')")} = '' THEN '[No extracted text]' ELSE {_label(f"substring({_strip(f"coalesce({x}, '')")}, 1, 160)")} END"


# The compatibility forms that the tables hold besides the full-width ones, and what they fold to.
_FORMS = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "µ": "μ", "™": "tm", "½": "12", "¼": "14", "¾": "34", "ß": "ss", "ς": "σ"}
_ONE_TO_ONE = ("²³¹ªº⁰⁴⁵⁶⁷⁸⁹" + "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "231ao0456789" + "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)))


def _fold_exact(x: str) -> str:
    """Normal form KC, case folded, letters and digits only."""
    quoted = [t.replace("'", "''") for t in _ONE_TO_ONE]
    one = f"lower(nfc_normalize(translate({x}, '{quoted[0]}', '{quoted[1]}')))"
    for form, to in _FORMS.items():
        one = f"replace({one}, '{form}', '{to}')"
    return f"regexp_replace({one}, '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def _search(kind: str = "") -> str:
    terms = tx.search_terms(QUERY)
    fields = [f"CASE WHEN metadata.{f} IS NOT NULL THEN '{f}' || {f"array_to_string(metadata.{f}, '')" if f == 'aliases' else f'metadata.{f}'} END" for f in ("aliases", "brand", "external_reference", "kind", "language", "model", "title")]
    any_term = " OR ".join(f"contains(t, '{t}')" for t in terms)
    return f"""WITH {_CUR}, {_P},
ft AS (SELECT version_id, number, {_fold_exact("coalesce(text, '')")} AS t FROM pg0),
al AS (SELECT version_id, string_agg(t, '' ORDER BY number) AS allt, string_agg(CASE WHEN {any_term} THEN number::VARCHAR END, ',' ORDER BY number) AS mp FROM ft GROUP BY version_id),
res AS (SELECT cur.document_id, cur.version_id, coalesce(mp, '') AS matching_pages, {_fold_exact(f"concat_ws('', {', '.join(fields)})")} || coalesce(allt, '') AS w FROM cur LEFT JOIN al USING (version_id) {kind}),
found AS (SELECT document_id, version_id, matching_pages FROM res WHERE {" AND ".join(f"contains(w, '{t}')" for t in terms)})"""


def _tree(items: str, keys: str, fanout: int, child: str) -> str:
    return f"""walk AS (
  SELECT {keys}, pos, k, card, 0 AS depth FROM ({items})
  UNION ALL
  SELECT {keys}, pos % w, least(w, k - (pos // w) * w), {child}, depth + 1 FROM (SELECT *, (k + {fanout - 1}) // {fanout} AS w FROM walk WHERE k > {fanout})),
leaves AS (SELECT {keys}, card, pos::BIGINT AS position, depth::INTEGER AS depth FROM walk WHERE k <= {fanout})"""


_BRIEF = f"""{_P}, {_tree("SELECT version_id, number, row_number() OVER (PARTITION BY version_id ORDER BY number) - 1 AS pos, count(*) OVER (PARTITION BY version_id) AS k, 'brief.md' AS card FROM pg0", "version_id, number", 8,
    "CASE WHEN card = 'brief.md' THEN 'sections/' || (pos // w + 1) || '.md' ELSE 'sections/' || regexp_replace(card, '^sections/|\\.md$', '', 'g') || '-' || (pos // w + 1) || '.md' END")}"""
_CATALOG = _tree("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos, count(*) OVER (PARTITION BY source) AS k, 'groups/' || left(sha256(source), 16) || '.md' AS card FROM documents", "source, doc_id", 32, "regexp_replace(card, '\\.md$', '') || '-' || (pos // w + 1) || '.md'")
_RENDERED = "coalesce(text, '') || CASE WHEN coalesce(preview, '') <> '' THEN '\n\n[Original page preview](' || preview || ')\n' ELSE '' END"
_SPANS = f"""{_P}, n AS (SELECT version_id, number, length(coalesce(text, '')) AS n, coalesce(text, '') AS t FROM pg0),
f AS (SELECT version_id, min(number) FILTER (n > 0) AS first FROM n GROUP BY version_id),
g AS (SELECT n.*, CASE WHEN number > first THEN 2 ELSE 0 END AS gap FROM n JOIN f USING (version_id))"""
_SCOPE = f"""{TREE_SQL},
sc AS (SELECT e.*, p.top_id, r.root_role = 'archive' AS archived FROM eff e JOIN placed p USING (file_id) JOIN inventory_roots r ON r.file_id = p.top_id WHERE p.tree_state = 'rooted'),
cl AS (SELECT *, CASE WHEN kind = 'folder' THEN 'folder' WHEN archived THEN 'archived_files'
  WHEN name IN ({", ".join(f"'{n}'" for n in inventory.GENERATED_NAMES)}) THEN 'generated_files'
  WHEN name LIKE '%.md' AND lower(string_split(left(name, length(name) - 3), '.')[-1]) IN ({", ".join(f"'{n}'" for n in tx.SOURCE_EXTENSIONS)}) THEN 'sidecars'
  WHEN lower(string_split(name, '.')[-1]) IN ({", ".join(f"'{n}'" for n in tx.SOURCE_EXTENSIONS)}) THEN 'source_documents'
  WHEN name = '{inventory.NOTES_NAME}' THEN 'human_note_files' ELSE 'other_files' END AS class FROM sc)"""
_LAST_SCAN = "last AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY attempted_at DESC, scan_id DESC) AS rn FROM scans WHERE root IS NOT NULL) WHERE rn = 1)"
_HEALTH = f"""{_LAST_SCAN},
h AS (SELECT root, CASE WHEN attempted_at IS NULL THEN 'never_scanned' WHEN NOT coalesce(complete, false) OR success_at IS NULL THEN 'incomplete'
  WHEN epoch_us(TIMESTAMP '2025-06-20') - epoch_us(success_at) > {health.MAX_AGE * 1_000_000} THEN 'stale' ELSE 'fresh' END AS state FROM last)"""
_REFS = f"""{RECORD_SQL},
refs AS (
  SELECT DISTINCT version_id, asset, kind FROM (
    SELECT version_id, preview AS asset, 'preview' AS kind FROM pg
    UNION ALL SELECT version_id, unnest(json_extract_string(images, '$[*]')), 'image' FROM pg WHERE json_type(images) = 'ARRAY'
    UNION ALL SELECT version_id, asset, 'table' FROM tb
    UNION ALL SELECT version_id, asset, 'media' FROM md) WHERE coalesce(asset, '') <> '')"""
_CELLS = f"""{RECORD_SQL},
c0 AS (SELECT DISTINCT version_id, page, tid, (x->>'$.row')::INT AS "row", (x->>'$.col')::INT AS col, (x->>'$.rowspan')::INT AS rowspan, (x->>'$.colspan')::INT AS colspan, x->>'$.text' AS text, (x->>'$.header')::BOOLEAN AS header FROM ce),
places AS (SELECT DISTINCT version_id, page, tid, "row", col, r, unnest(range(col, col + colspan)) AS c FROM (SELECT *, unnest(range("row", "row" + rowspan)) AS r FROM c0 WHERE rowspan >= 1 AND colspan >= 1 AND rowspan * colspan <= 100000)),
pl AS (SELECT version_id, page, tid, "row", col, r, unnest(range(col, col + colspan)) AS c FROM (SELECT *, unnest(range("row", "row" + rowspan)) AS r FROM c0 WHERE rowspan >= 1 AND colspan >= 1 AND rowspan * colspan <= 100000)),
ov AS (SELECT version_id, page, tid, r, c, count(*) AS n FROM pl GROUP BY ALL HAVING count(*) > 1),
sz AS (SELECT version_id, page, tid, max(n_rows::INT) AS n_rows, max(n_cols::INT) AS n_cols FROM tb GROUP BY ALL)"""

SQL = {
    "search_all_terms": f"{_search()} SELECT * FROM found",
    "search_kind_filter": f"{_search(f"WHERE coalesce(metadata.kind, 'document') = '{KIND}'")} SELECT * FROM found",
    "search_first_results": f"{_search()} SELECT *, (SELECT count(*) FROM found) AS total, (SELECT count(*) FROM found) > 20 AS truncated FROM found ORDER BY document_id, version_id LIMIT 20",
    "newer_candidate": f"WITH {_CUR} SELECT document_id, version_id, EXISTS (SELECT 1 FROM v n WHERE n.document_id = cur.document_id AND n.created_at > cur.created_at) AS newer FROM cur",
    "latest_version": f"WITH {_LATEST} SELECT document_id, version_id, quality FROM latest",
    "latest_by_path": f"WITH {_LATEST} SELECT d.source_path, l.version_id FROM latest l JOIN documents d USING (document_id)",
    "version_history": f"WITH {_V} SELECT document_id, version_id, row_number() OVER (PARTITION BY document_id ORDER BY created_at, version_id)::INTEGER AS position FROM v WHERE document_id IS NOT NULL",
    "audit_tail": "SELECT event_id, event_type, props FROM events ORDER BY event_id DESC LIMIT 100",
    "status_counts": "SELECT count(*) AS n_documents, (SELECT count(DISTINCT version_id) FROM versions) AS n_versions, count(current_version) AS n_current FROM documents",
    "quality_histogram": f"WITH {_V} SELECT quality, count(*) AS n FROM v GROUP BY quality",
    "kind_map": f"WITH {_CUR} SELECT coalesce(metadata.kind, 'document') AS kind, count(*) AS n FROM cur GROUP BY 1",
    "publish_gate": f"WITH {_V} SELECT version_id FROM v WHERE quality = 'extracted'",
    "duplicate_fingerprints": f"WITH {_V} SELECT document_id, lower(fingerprint) AS fingerprint, count(*) AS n, min(version_id) AS first_version FROM v WHERE document_id IS NOT NULL AND fingerprint IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1",
    "identical_sources": f"WITH {_V} SELECT lower(source_hash) AS source_hash, count(*) AS n_versions, count(DISTINCT document_id) AS n_documents FROM v WHERE source_hash IS NOT NULL GROUP BY 1 HAVING count(DISTINCT document_id) > 1",
    "unchanged_sources": f"WITH {_LATEST}, cur AS (SELECT v.source_hash, d.source_path FROM v JOIN documents d ON d.current_version = v.version_id) SELECT DISTINCT c.source_path AS path FROM cur c JOIN documents d ON d.source_path = c.source_path JOIN latest l ON l.document_id = d.document_id WHERE l.quality = 'extracted' AND lower(l.source_hash) = lower(c.source_hash)",
    "lifecycle_replay": "WITH e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events WHERE event_type IN ('purchase', 'error') AND user_id IS NOT NULL) WHERE rn = 1) SELECT user_id, event_id FROM e WHERE event_type = 'purchase'",
    "metadata_digest": f"WITH {_V} SELECT version_id, sha256(to_json({{'aliases': metadata.aliases, 'brand': metadata.brand, 'external_reference': metadata.external_reference, 'kind': metadata.kind, 'language': metadata.language, 'model': metadata.model, 'title': metadata.title}})::VARCHAR) AS sha256 FROM v",
    "metadata_violations": f"WITH {_V} SELECT DISTINCT version_id, problem FROM (SELECT version_id, CASE WHEN greatest(length(metadata.title), length(metadata.kind), length(metadata.brand), length(metadata.model), length(metadata.language), length(metadata.external_reference)) > 500 THEN 'METADATA_SCHEMA' WHEN len(metadata.aliases) > 50 OR list_max(list_transform(metadata.aliases, lambda a: coalesce(length(a), 201))) > 200 THEN 'METADATA_SCHEMA_ALIASES' END AS problem FROM v) WHERE problem IS NOT NULL",
    "page_quality": f"""WITH {_V}, {_P}, c AS (SELECT version_id, count(*) AS n_pages, count(*) FILTER ({_strip("coalesce(text, '')")} <> '') AS n_with_text FROM pg0 GROUP BY 1),
j AS (SELECT v.version_id, filename, coalesce(n_pages, 0) AS n_pages, coalesce(n_with_text, 0) AS n_with_text FROM v LEFT JOIN c USING (version_id))
SELECT version_id, n_pages, n_with_text, CASE WHEN n_with_text = 0 THEN CASE WHEN regexp_matches(lower(filename), '[^/]\\.(txt|md)$') THEN 'empty' ELSE 'needs_ocr' END WHEN n_with_text < n_pages THEN 'partial' ELSE 'extracted' END AS status,
CASE WHEN n_with_text = 0 THEN 'NO_EXTRACTED_TEXT' WHEN n_with_text < n_pages THEN 'PAGES_WITHOUT_TEXT' END AS warning FROM j""",
    "sidecar_status": f"""WITH {_P} SELECT CASE WHEN {_strip("coalesce(text, '')")} = '' THEN 'EMPTY' WHEN regexp_matches(text, 'ocr_status:\\s*needs_ocr|需 OCR 後補摘要') THEN 'OCR_REQUIRED' WHEN contains(text, '未做完整摘要與章節抽取') OR contains(text, 'lite sidecar') THEN 'METADATA_ONLY'
WHEN contains(text, '## 摘要') AND contains(text, '## 原始檔') THEN 'BRIEF_ONLY' ELSE 'TEXT_UNVERIFIED' END AS status, count(*) AS n FROM pg0 GROUP BY 1""",
    "leak_guard": " UNION ALL ".join(f"SELECT '{k}' AS pattern, count(*) FILTER (regexp_matches(text, '{p.replace(chr(39), chr(39) * 2)}')) AS n_texts FROM documents" for k, p in quality.LEAK_PATTERNS.items()),
    "markdown_images": "SELECT count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)!\\[|<img\\b')) AS n_with_images FROM documents",
    "pipeline_markers": "SELECT scan_id, concat_ws(',', CASE WHEN regexp_matches(log, '(?i)\\bosd\\b|orientation\\s+and\\s+script|script\\s+detection') THEN 'DOCLING_PIPELINE_OSD' END, CASE WHEN regexp_matches(log, '(?i)table[\\s_-]*fallback|fallback[\\s_-]*table') THEN 'DOCLING_PIPELINE_TABLEFALLBACK' END, CASE WHEN regexp_matches(log, '(?i)\\b(?:error|warning|failed)\\b') THEN 'DOCLING_PIPELINE_WARNING' END) AS markers FROM (SELECT DISTINCT scan_id, coalesce(error, '') AS log FROM scans)",
    "langextract_spans": f"WITH {_SPANS} SELECT version_id, number, s::BIGINT AS start, (s + n)::BIGINT AS \"end\" FROM (SELECT *, coalesce(sum(n + gap) OVER (PARTITION BY version_id ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + gap AS s FROM g)",
    "joined_text_digest": f"WITH {_SPANS} SELECT version_id, sha256(string_agg(CASE WHEN gap > 0 THEN '\n\n' ELSE '' END || t, '' ORDER BY number)) AS sha256 FROM (SELECT n.*, CASE WHEN number > first THEN 2 ELSE 0 END AS gap FROM n LEFT JOIN f USING (version_id)) GROUP BY version_id",
    "rendered_page_digest": f"WITH {_P} SELECT version_id, number, sha256({_RENDERED}) AS sha256 FROM pg0",
    "full_markdown_digest": f"""WITH {_V}, {_P}, body AS (SELECT version_id, string_agg('\n## Page ' || number || '\n\n' || {_RENDERED} || '\n', '' ORDER BY number) AS b FROM pg0 GROUP BY 1)
SELECT version_id, sha256('---\nschema_version: 1\ndocument_id: ' || to_json(document_id)::VARCHAR || '\nversion_id: ' || to_json(version_id)::VARCHAR || '\nsource_sha256: ' || to_json(lower(source_hash))::VARCHAR || '\nextraction_status: ' || to_json(quality)::VARCHAR || '\nevidence_status: "unverified"\n---\n\n# '
|| replace(coalesce(metadata.title, filename, ''), '\n', ' ') || '\n\n{reading.NOTICE}\n' || coalesce(b, '')) AS sha256 FROM v LEFT JOIN body USING (version_id) WHERE document_id IS NOT NULL AND source_hash IS NOT NULL AND quality IS NOT NULL""",
    "first_pages": f"WITH {_CUR}, {_P} SELECT version_id, length(coalesce(text, '')) AS n_chars FROM pg0 WHERE number = 1 AND version_id IN (SELECT version_id FROM cur)",
    "brief_excerpts": f"WITH {_P} SELECT version_id, number, {_excerpt('text')} AS excerpt FROM pg0",
    "brief_tree": f"WITH RECURSIVE {_BRIEF} SELECT * FROM leaves",
    "brief_card_digest": f"""WITH RECURSIVE {_BRIEF} SELECT version_id, card, sha256(string_agg('- [Page ' || number || '](' || CASE WHEN card = 'brief.md' THEN 'full.md' ELSE '../full.md' END || '#page-' || number || '): ' || {_excerpt("text")} || CASE WHEN coalesce(preview, '') <> '' THEN ' (page preview available)' ELSE '' END, '\n' ORDER BY position)) AS sha256 FROM leaves JOIN pg0 USING (version_id, number) GROUP BY version_id, card""",
    "catalog_tree": f"WITH RECURSIVE {_CATALOG} SELECT * FROM leaves",
    "catalog_sizes": f"WITH RECURSIVE {_CATALOG} SELECT source, count(DISTINCT card) AS n_leaf_cards, max(depth) AS depth FROM leaves GROUP BY source",
    "title_labels": f"WITH {_V} SELECT version_id, {_label('metadata.title')} AS label FROM v",
    "inventory_ancestry": f"WITH RECURSIVE {_SCOPE} SELECT file_id, top_id, archived FROM sc",
    "inventory_classes": f"WITH RECURSIVE {_SCOPE} SELECT file_id, class FROM cl",
    "inventory_counts": f"WITH RECURSIVE {_SCOPE} SELECT class, count(*) AS n FROM cl GROUP BY class UNION ALL SELECT 'files', count(*) FROM cl WHERE class <> 'folder' HAVING count(*) > 0",
    "inventory_missing_sidecars": f"WITH RECURSIVE {_SCOPE} SELECT file_id FROM cl a WHERE class = 'source_documents' AND NOT EXISTS (SELECT 1 FROM sc b WHERE b.kind = 'file' AND coalesce(b.parent_id, '') = coalesce(a.parent_id, '') AND b.name = a.name || '.md')",
    "inventory_orphan_sidecars": f"WITH RECURSIVE {_SCOPE} SELECT file_id FROM cl a WHERE class = 'sidecars' AND NOT EXISTS (SELECT 1 FROM sc b WHERE b.kind = 'file' AND coalesce(b.parent_id, '') = coalesce(a.parent_id, '') AND b.name = left(a.name, length(a.name) - 3))",
    "inventory_empty_files": f"WITH RECURSIVE {_SCOPE} SELECT file_id FROM cl WHERE size = 0 AND class NOT IN ('folder', 'archived_files', 'generated_files')",
    "inventory_conflicts": f"WITH RECURSIVE {_SCOPE} SELECT parent_id, name, count(*) AS n FROM sc GROUP BY 1, 2 HAVING count(*) > 1",
    "inventory_identical_bytes": f"WITH RECURSIVE {_SCOPE} SELECT lower(sha256) AS sha256, size, count(*) AS n FROM cl WHERE class = 'source_documents' AND regexp_full_match(sha256, '[a-fA-F0-9]{{64}}') AND size > 0 GROUP BY 1, 2 HAVING count(*) > 1",
    "inventory_violations": "SELECT DISTINCT file_id, problem FROM (SELECT file_id, CASE WHEN coalesce(trim(file_id), '') = '' THEN 'missing id' WHEN coalesce(trim(name), '') = '' THEN 'missing name' WHEN kind IS NULL OR kind NOT IN ('file', 'folder') THEN 'unknown kind' WHEN size < 0 THEN 'negative size' WHEN parent_id = file_id THEN 'own parent' END AS problem FROM entries) WHERE problem IS NOT NULL",
    "name_parts": f"SELECT DISTINCT name, lower(regexp_extract(name, '[^/](\\.[^./]+)$', 1)) AS suffix, lower(string_split(name, '.')[-1]) AS extension, (name LIKE '%.md' AND lower(string_split(left(name, length(name) - 3), '.')[-1]) IN ({', '.join(f"'{n}'" for n in tx.SOURCE_EXTENSIONS)})) AS sidecar FROM entries",
    "source_health": f"WITH {_HEALTH} SELECT root, state FROM h",
    "all_sources_fresh": f"WITH {_HEALTH} SELECT coalesce(bool_and(state = 'fresh'), true) AS fresh FROM h",
    "missing_sources": f"WITH {_LAST_SCAN}, d AS (SELECT * FROM (SELECT d.source_path, d.removed_at, l.complete, row_number() OVER (PARTITION BY d.document_id ORDER BY length(l.root) DESC) AS r2 FROM documents d JOIN last l ON starts_with(d.source_path, l.root || '/')) WHERE r2 = 1) SELECT source_path AS path FROM d WHERE complete AND removed_at IS NOT NULL",
    "settle_batch": f"""WITH {_V}, s AS (SELECT d.source_path AS path, v.* FROM v JOIN documents d USING (document_id) WHERE source_hash IS NOT NULL),
e AS (SELECT path, arg_max(lower(source_hash), (created_at, version_id)) AS sig, epoch_us(max(created_at)) / 1e6 AS mtime, arg_min(lower(source_hash), (created_at, version_id)) AS old, epoch_us(min(created_at)) / 1e6 AS since FROM s GROUP BY path)
SELECT path, CASE WHEN old <> sig OR {NOW_SECONDS} - since < {QUIET} OR {NOW_SECONDS} - mtime < {QUIET} THEN 'waiting' ELSE 'staged' END AS state FROM e""",
    "settle_observations": f"""WITH o AS (SELECT DISTINCT d.source_path AS path, lower(source_hash) AS signature, epoch_us(created_at) / 1e6 AS mtime, epoch_us(landed_at) / 1e6 AS seen_at FROM versions v JOIN documents d USING (document_id) WHERE source_hash IS NOT NULL),
p AS (SELECT *, lag(signature) OVER (PARTITION BY path ORDER BY seen_at, signature, mtime) AS before FROM o),
g AS (SELECT *, sum(CASE WHEN before = signature THEN 0 ELSE 1 END) OVER (PARTITION BY path ORDER BY seen_at, signature, mtime ROWS UNBOUNDED PRECEDING) AS run FROM p),
s AS (SELECT *, min(seen_at) OVER (PARTITION BY path, run) AS stable_since FROM g)
SELECT path, signature, seen_at, stable_since, CASE WHEN before IS DISTINCT FROM signature OR seen_at - stable_since < {QUIET} OR seen_at - mtime < {QUIET} THEN 'waiting' ELSE 'staged' END AS state FROM s""",
    "nested_paths": "WITH p AS (SELECT DISTINCT regexp_replace(source_path, '/[^/]*$', '') AS path FROM documents) SELECT a.path AS \"inner\", b.path AS \"outer\" FROM p a JOIN p b ON starts_with(a.path, b.path || '/') WHERE a.path <> b.path",
    "asset_unresolved": f"WITH {_REFS} SELECT version_id, asset, kind FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ast a WHERE a.version_id = r.version_id AND a.asset = r.asset)",
    "asset_violations": f"""WITH {RECORD_SQL}, a AS (SELECT DISTINCT version_id, asset, v->>'$.sha256' AS sha, try_cast(v->>'$.bytes' AS BIGINT) AS n, v->>'$.media_type' AS media, v->>'$.role' AS role FROM ast)
SELECT version_id, asset, problem FROM (SELECT version_id, asset, CASE WHEN NOT regexp_full_match(asset, 'assets/[0-9a-f]{{64}}\\.(png|jpg|gif|webp|tiff|bmp|json|html|xml|pdf|bin)') OR sha IS DISTINCT FROM regexp_extract(asset, '([0-9a-f]{{64}})', 1) THEN 'address' WHEN n IS NULL OR n < 0 THEN 'size' WHEN media IS NULL OR role IS NULL THEN 'metadata' END AS problem FROM a) WHERE problem IS NOT NULL
UNION ALL SELECT version_id, NULL, 'total' FROM a GROUP BY version_id HAVING sum(n) > {assets.MAX_ASSET_BYTES}""",
    "asset_totals": f"WITH {RECORD_SQL}, a AS (SELECT DISTINCT version_id, asset, v->>'$.sha256' AS sha, v->>'$.bytes' AS n, v->>'$.media_type' AS media, v->>'$.role' AS role FROM ast) SELECT version_id, count(*) AS n_assets, sum(n::BIGINT)::BIGINT AS n_bytes FROM a GROUP BY version_id",
    "unlocated_media": f"WITH {_REFS} SELECT DISTINCT version_id, asset FROM md m WHERE NOT EXISTS (SELECT 1 FROM refs r WHERE r.kind = 'image' AND r.version_id = m.version_id AND r.asset = m.asset)",
    "page_coverage": "SELECT version_id, (max(number) - count(DISTINCT number) FILTER (number >= 1))::INTEGER AS missing, (count(DISTINCT number) FILTER (number < 1))::INTEGER AS extra, (count(number) - count(DISTINCT number)) AS duplicated FROM pages GROUP BY version_id",
    "span_overlap": f'WITH {_CELLS} SELECT version_id, page, tid AS "table", r::INTEGER AS r, c::INTEGER AS c, n FROM ov',
    "span_reach": f'WITH {_CELLS} SELECT version_id, page, tid AS "table", max(col + colspan) AS n_cols, max("row" + rowspan) AS n_rows FROM c0 GROUP BY ALL',
    "span_problems": f"""WITH {_CELLS} SELECT version_id, page, tid AS "table", 'dimensions' AS problem FROM sz WHERE n_rows > 10000 OR n_cols > 1000 OR n_rows * n_cols > 100000 OR n_rows < 0 OR n_cols < 0
UNION SELECT version_id, page, tid, 'span' FROM c0 JOIN sz USING (version_id, page, tid) WHERE "row" < 0 OR col < 0 OR rowspan < 1 OR colspan < 1 OR "row" + rowspan > n_rows OR col + colspan > n_cols""",
    "table_html_digest": f"""WITH {_CELLS},
ok AS (SELECT * FROM c0 a WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.version_id = a.version_id AND ov.page = a.page AND ov.tid = a.tid)),
cov AS (SELECT DISTINCT p.version_id, p.page, p.tid, p.r, p.c FROM places p SEMI JOIN ok USING (version_id, page, tid)),
st AS (SELECT version_id, page, tid, "row" AS r, col AS c, '<' || CASE WHEN header THEN 'th' ELSE 'td' END || ' rowspan="' || rowspan || '" colspan="' || colspan || '">' || replace(replace(replace(replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;'), '\n', '<br>') || '</' || CASE WHEN header THEN 'th' ELSE 'td' END || '>' AS cell FROM ok),
grid AS (SELECT version_id, page, tid, r, unnest(range(n_cols)) AS c FROM (SELECT *, unnest(range(n_rows)) AS r FROM sz WHERE n_rows > 0 AND n_cols > 0 AND n_rows <= 10000 AND n_cols <= 1000 AND n_rows * n_cols <= 100000)),
cells2 AS (SELECT g.version_id, g.page, g.tid, g.r, g.c, coalesce(st.cell, CASE WHEN cov.r IS NULL THEN '<td></td>' ELSE '' END) AS cell FROM grid g LEFT JOIN st USING (version_id, page, tid, r, c) LEFT JOIN cov USING (version_id, page, tid, r, c)),
lines AS (SELECT version_id, page, tid, r, '<tr>' || string_agg(cell, '' ORDER BY c) || '</tr>' AS l FROM cells2 GROUP BY ALL)
SELECT version_id, page, tid AS "table", sha256('<table>\n' || string_agg(l, '\n' ORDER BY r) || '\n</table>') AS sha256 FROM lines GROUP BY version_id, page, tid""",
    "visible_cells": """WITH c AS (SELECT l_orderkey AS sheet, l_linenumber AS "row", 1 AS col FROM lineitem), m AS (SELECT sheet, 1 AS r1, least(max("row"), 3) AS r2 FROM c GROUP BY sheet)
SELECT sheet, "row", col FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.sheet = c.sheet AND c."row" BETWEEN m.r1 AND m.r2 AND c."row" <> m.r1)""",
}
