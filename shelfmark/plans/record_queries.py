"""Queries over extraction records, reading, cards, bundles and the smaller rules, and their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions import text as tx
from shelfmark.operators import assets, health, incremental, inventory, navigation, nested, ordinals, orphans, quality, reading, records, search, tables, versions
from shelfmark.plans.general_queries import IN_EFFECT_SQL, RECORD_SQL
from shelfmark.plans.library_queries import _CUR, _HEALTH, _LAST_SCAN, _LATEST, _P, _RENDERED, _V, NOW, QUERY, _excerpt, _fold_exact, _label, _search, _strip
from shelfmark.session import table, written
from shelfmark.sources import bundle


def _t(spark: SparkSession, sf: str, *names: str) -> list[DataFrame]:
    return [table(spark, sf, n) for n in names]


# --- records ---------------------------------------------------------------------------------------------------------


def _of_records(function, name: str):
    def query(spark: SparkSession, sf: str) -> DataFrame:
        return function(table(spark, sf, "extractions"))

    query.__name__, query.__doc__ = name, function.__doc__
    return query


_RECORD_QUERIES = [
    _of_records(f, f.__name__)
    for f in (
        records.recognition_languages, records.sorted_warnings, records.key_problems, records.settings_differences, records.request_settings, records.parser_outputs, records.page_visuals, records.cell_boxes, records.provenance,
        records.table_pages, records.tables_without_content, records.table_ids, records.text_items, records.header_cells, records.asset_set_differences, records.media_by_position, records.package_problems,
    )
]


def rewritten_references(spark: SparkSession, sf: str) -> DataFrame:
    return records.with_addresses(table(spark, sf, "extractions")).select("version_id", "n_replaced", tx.digest(F.col("payload")).alias("sha256")).distinct()


def asset_addresses(spark: SparkSession, sf: str) -> DataFrame:
    """Whether each asset's address is made of its hash and its media type's extension."""
    a = nested.asset_table(table(spark, sf, "extractions"))
    made = tx.asset_address(F.col("sha256"), F.substring_index("media_type", "/", -1))
    return a.select("version_id", "asset", F.coalesce(made == F.col("asset"), F.lit(False)).alias("regular")).distinct()


def cached_values(spark: SparkSession, sf: str) -> DataFrame:
    """Cells with the number that their text is, looked up by sheet and coordinate."""
    cells = nested.cell_table(table(spark, sf, "extractions")).select(F.concat_ws("/", "version_id", "page", F.col("table")).alias("sheet"), F.concat_ws(",", "row", "col").alias("coordinate"), "text").distinct()
    values = cells.filter(F.col("text").rlike(r"^[0-9]+(\.[0-9]+)?$")).groupBy("sheet", "coordinate").agg(F.max(F.col("text").try_cast("double")).alias("value"))
    return tables.with_cached_value(cells, values).groupBy("sheet").agg(F.count("*").alias("n_cells"), F.count("value").alias("n_values"))


def layout_status(spark: SparkSession, sf: str) -> DataFrame:
    """The quality that layout-parsed records get from their texts."""
    e = table(spark, sf, "extractions")
    heads = records.heads(e).filter(F.col("method").startswith("layout")).groupBy("version_id").agg(F.bool_or(F.coalesce("ocr", F.lit(False))).alias("ocr"))
    texts = nested.page_table(e).groupBy("version_id").agg(F.count_if(quality.has_text(F.col("text"))).alias("n"))
    joined = heads.join(texts, "version_id", "left")
    return joined.select("version_id", quality.layout_quality(F.coalesce("n", F.lit(0)), F.col("ocr")).alias("status"))


def request_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The first code of each version's parse request by file name and recorded settings."""
    h = records.heads(table(spark, sf, "extractions")).select("version_id", F.coalesce("set_language", "top_language", F.lit("eng")).alias("language"), F.coalesce("ocr_scale", F.lit(3.0)).alias("scale")).distinct()
    v = versions.once(table(spark, sf, "versions")).select("version_id", tx.suffix(F.col("filename")).alias("suffix"))
    return h.join(v, "version_id").select("version_id", quality.request_problem(F.col("suffix"), F.col("language"), F.lit("cpu"), F.col("scale")).alias("problem")).distinct()


# --- scans and logs --------------------------------------------------------------------------------------------------


def scan_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What each scan's error tells: failed or unsupported, and whether recognition failed."""
    e = table(spark, sf, "scans").filter(F.col("error").isNotNull()).select("scan_id", "error").distinct()
    return e.select("scan_id", quality.failure_status(F.upper("error")).alias("status"), quality.ocr_failed(F.col("error")).alias("ocr_failed"))


def scan_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """The event payload of each scan: canonical JSON without the error."""
    s = table(spark, sf, "scans").drop("error").distinct()
    return s.select("scan_id", "attempted_at", tx.canonical(("complete", F.col("complete")), ("root", F.col("root")), ("scan_id", F.col("scan_id"))).alias("payload")).distinct()


def scan_report(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each root after its last scan."""
    d, scans = _t(spark, sf, "documents", "scans")
    return health.scan_report(incremental.with_root, scans, d)


def event_kinds(spark: SparkSession, sf: str) -> DataFrame:
    """Events by the last part of their kind, as a log writes it."""
    e = table(spark, sf, "events").select(tx.status_tail(F.concat(F.lit("EventKind."), F.upper("event_type"))).alias("kind"))
    return e.groupBy("kind").agg(F.count("*").alias("n"))


def commit_sequence(spark: SparkSession, sf: str) -> DataFrame:
    """The sequence numbers that a commit after number 1000 gives the events in order of time."""
    e = table(spark, sf, "events").select(F.lit(1).alias("log"), "event_id", "ts")
    return ordinals.with_ordinal(e, "log", ["ts", "event_id"]).select("event_id", (F.col("o") + 1001).alias("seq"))


# --- versions --------------------------------------------------------------------------------------------------------


def idempotent_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """The fingerprints that the later half of the deliveries adds to the earlier one."""
    v = table(spark, sf, "versions").filter("document_id IS NOT NULL").select("document_id", F.lower("fingerprint").alias("fingerprint"), "version_id", "landed_at")
    late = F.col("landed_at") >= F.lit("2024-06-01").cast("timestamp_ntz")
    return versions.new_fingerprints(v.filter(late), v.filter(~late))


def hash_problems(spark: SparkSession, sf: str) -> DataFrame:
    """Versions whose four content addresses are not all complete."""
    return versions.hash_problems(table(spark, sf, "versions"))


def fingerprint_digest(spark: SparkSession, sf: str) -> DataFrame:
    return versions.composed_fingerprints(table(spark, sf, "versions"))


def identity_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that would bind a path, or a document, otherwise than the library has it: every version as if it came from its file's own folder."""
    v, d = _t(spark, sf, "versions", "documents")
    own = versions.once(v).filter("document_id IS NOT NULL").join(d.select("document_id", "source_path"), "document_id")
    incoming = own.select("document_id", F.concat(F.regexp_replace("source_path", "[^/]*$", ""), "filename").alias("path"))
    return versions.identity_conflicts(incoming, d.select("document_id", F.col("source_path").alias("path")))


def kind_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents of each kind in order."""
    cur = versions.current(*_t(spark, sf, "versions", "documents")).select(F.coalesce("metadata.kind", F.lit("document")).alias("kind"), "document_id").distinct()
    return ordinals.with_ordinal(cur, "kind", ["document_id"]).select("kind", "o", "document_id").withColumnRenamed("o", "position")


def metadata_source(spark: SparkSession, sf: str) -> DataFrame:
    """Metadata as its JSON source, read by the fixed schema; unknown keys are told."""
    v = versions.once(table(spark, sf, "versions")).filter("metadata IS NOT NULL").select("version_id", F.to_json("metadata").alias("json"))
    return assets.metadata_from_json(v, "version_id", "json").select("version_id", "metadata.title", "problem")


# --- reading ---------------------------------------------------------------------------------------------------------


def readable_versions(spark: SparkSession, sf: str) -> DataFrame:
    return reading.readable(*_t(spark, sf, "versions", "documents"), historical=True)


def read_second_page(spark: SparkSession, sf: str) -> DataFrame:
    """The page at position 2 of every current version that has one."""
    v = reading.readable(*_t(spark, sf, "versions", "documents"))
    return reading.pages_at(table(spark, sf, "pages"), v, 2).select("version_id", "number", tx.digest(F.coalesce("text", F.lit(""))).alias("sha256"), F.lit(reading.LAYERS["page"]).alias("layer"))


def read_assets(spark: SparkSession, sf: str) -> DataFrame:
    """The assets of every current version with the place of their bytes."""
    v = reading.readable(*_t(spark, sf, "versions", "documents")).select("version_id")
    a = nested.asset_table(table(spark, sf, "extractions")).join(v, "version_id", "left_semi")
    return a.select("version_id", "asset", "sha256", "bytes", "media_type", "role", F.concat(F.lit("objects/"), "sha256").alias("snapshot_path"))


def read_sources(spark: SparkSession, sf: str) -> DataFrame:
    v = reading.readable(*_t(spark, sf, "versions", "documents")).filter("source_sha256 IS NOT NULL")
    return v.select("version_id", F.concat(F.lit("objects/"), "source_sha256").alias("snapshot_path"), F.lit(reading.LAYERS["source"]).alias("layer"))


def search_results(spark: SparkSession, sf: str) -> DataFrame:
    """The found versions with all that an answer says of them; stale sources are allowed."""
    return search.results(*_t(spark, sf, "versions", "documents", "pages"), query=QUERY, allow_stale=True)


def folded_titles(spark: SparkSession, sf: str) -> DataFrame:
    v = versions.once(table(spark, sf, "versions")).filter("metadata.title IS NOT NULL")
    return search.exactly_folded(v.select("version_id", "metadata.title"), F.col("title"), "folded").select("version_id", "folded")


# --- cards and bundle ------------------------------------------------------------------------------------------------


def full_briefs(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.full_briefs(*_t(spark, sf, "versions", "pages")).select("version_id", "card", tx.digest(F.col("markdown")).alias("sha256"))


def kind_catalogs(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.kind_catalogs(versions.current(*_t(spark, sf, "versions", "documents"))).select("kind", "card", tx.digest(F.col("markdown")).alias("sha256"))


def library_map(spark: SparkSession, sf: str) -> DataFrame:
    return navigation.library_map(versions.current(*_t(spark, sf, "versions", "documents")))


def bundle_documents(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.documents(versions.current(*_t(spark, sf, "versions", "documents")))


def bundle_assets(spark: SparkSession, sf: str) -> DataFrame:
    return bundle.asset_files(versions.current(*_t(spark, sf, "versions", "documents")), table(spark, sf, "extractions"))


def bundle_reference_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The references of the bundle's documents against its files; only versions with pages have their text and cards, only those with an extraction record its file."""
    v, d, p, e = _t(spark, sf, "versions", "documents", "pages", "extractions")
    cur = written(versions.current(v, d), "current")
    base = F.concat(F.lit("documents/"), "version_id", F.lit("/"))
    docs = bundle.documents(cur)
    with_pages = cur.select("version_id").join(p.select("version_id").distinct(), "version_id", "left_semi").select(F.explode(F.array(F.concat(base, F.lit("full.md")), F.concat(base, F.lit("brief.md")))).alias("path"), F.lit(None).cast("string").alias("sha256"))
    with_records = cur.join(e.select("version_id").distinct(), "version_id", "left_semi").select(F.concat(base, F.lit("extraction.json")).alias("path"), F.lit(None).cast("string").alias("sha256"))
    originals = docs.filter("source_sha256 IS NOT NULL").select(F.col("original").alias("path"), F.col("source_sha256").alias("sha256"))
    return bundle.reference_problems(docs, with_pages.unionByName(with_records).unionByName(originals).distinct())


# --- inventory and paths ---------------------------------------------------------------------------------------------


def entry_signatures(spark: SparkSession, sf: str) -> DataFrame:
    """The signature of each entry in effect: canonical JSON of size and time of capture in microseconds."""
    e = inventory.in_effect_full(table(spark, sf, "entries"))
    return e.select("file_id", F.to_json(F.array(F.col("size"), F.unix_micros(F.col("captured_at").cast("timestamp")))).alias("signature"))


def merged_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """The hashes of each entry merged over all of its observations, later ones before earlier ones."""
    return inventory.merged_integrity(table(spark, sf, "entries")).select("file_id", F.try_element_at("integrity", F.lit("sha256")).alias("sha256"))


def inventory_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Entries whose first observation differs from the last one in size or hash."""
    e = table(spark, sf, "entries").filter("file_id IS NOT NULL")
    side = F.struct("captured_at", "size", F.try_element_at("integrity", F.lit("sha256")).alias("sha256"))
    both = written(e.groupBy("file_id").agg(F.min(side).alias("a"), F.max(side).alias("b")), "observations")
    of = lambda x: both.select(F.col("file_id").alias("path"), F.col(f"{x}.size").alias("bytes"), F.col(f"{x}.sha256").alias("sha256"))
    return assets.file_differences(of("a"), of("b"))


def snapshot_problems(spark: SparkSession, sf: str) -> DataFrame:
    """The deliveries of entries as one snapshot: what it may not hold, repeated identifiers included."""
    return inventory.snapshot_problems(table(spark, sf, "entries"))


def safe_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Paths below the top folder as a bundle and a model manifest see them."""
    p = table(spark, sf, "documents").select(F.expr("substring(source_path, 2)").alias("path")).distinct()
    return p.select("path", tx.safe_bundle_path(F.col("path")).alias("safe"), assets.relative_model_path(F.col("path")).alias("relative"))


def tree_guard(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that a public tree may not hold, by rule."""
    return quality.tree_guard(table(spark, sf, "documents").select("source_path", "text"))


def marked_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads with a byte-order mark, and the length without it."""
    p = F.col("payload")
    return table(spark, sf, "extractions").filter(p.startswith("﻿")).select("version_id", F.length(F.regexp_replace(p, r"^\x{FEFF}", "")).alias("n")).distinct()


def path_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under the configured roots with an ingested extension."""
    from shelfmark.sources import files

    d = table(spark, sf, "documents").select("document_id", "source_path")
    ok = files.in_scope(F.col("source_path"), ["/library", "/intake/vendor"]) & tx.suffix(F.col("source_path")).isin(files.EXTENSIONS)
    return d.select("document_id", ok.alias("in_scope"))


QUERIES = {
    f.__name__: f
    for f in (
        *_RECORD_QUERIES, rewritten_references, asset_addresses, cached_values, layout_status, request_problems, scan_failures, scan_payloads, scan_report, event_kinds, commit_sequence, idempotent_ingest, hash_problems,
        fingerprint_digest, identity_conflicts, kind_documents, metadata_source, readable_versions, read_second_page, read_assets, read_sources, search_results, folded_titles, full_briefs, kind_catalogs, library_map,
        bundle_documents, bundle_assets, bundle_reference_problems, entry_signatures, merged_integrity, inventory_changes, snapshot_problems, safe_paths, tree_guard, marked_payloads, path_scope,
    )
}

_HEADS = f"""{RECORD_SQL},
h AS (SELECT version_id, j, j->>'$.schema_version' AS schema_version, j->>'$.method' AS method, (j->'$.settings'->>'$.ocr')::BOOLEAN AS ocr, j->>'$.ocr_language' AS top_language, j->'$.settings'->>'$.ocr_language' AS set_language,
  (j->'$.settings'->>'$.ocr_scale')::DOUBLE AS ocr_scale FROM rec)"""
_PROVENANCE = f"""{RECORD_SQL},
pr AS (SELECT version_id, tid, i - 1 AS place, x FROM (SELECT version_id, tid, unnest(provenance::JSON[]) AS x, generate_subscripts(provenance::JSON[], 1) AS i FROM tb WHERE json_type(provenance) = 'ARRAY')),
pv AS (SELECT DISTINCT version_id, tid AS "table", place::INTEGER AS place, (x->>'$.page')::INTEGER AS on_page, (x->>'$.charspan[0]')::BIGINT AS first, (x->>'$.charspan[1]')::BIGINT AS last,
  CASE WHEN NOT coalesce((x->>'$.page')::INT >= 1 AND EXISTS (SELECT 1 FROM pg WHERE pg.version_id = pr.version_id AND try_cast(pg.page AS INT) = (x->>'$.page')::INT) AND json_array_length(x->'$.charspan') = 2
    AND (x->>'$.charspan[0]')::BIGINT >= 0 AND (x->>'$.charspan[1]')::BIGINT >= 0 AND x->>'$.bbox.l' IS NOT NULL AND x->>'$.bbox.t' IS NOT NULL AND x->>'$.bbox.r' IS NOT NULL AND x->>'$.bbox.b' IS NOT NULL, false)
    THEN 'DOCLING_INVALID_PROVENANCE' END AS problem FROM pr)"""
_IMAGES = "SELECT version_id, ordinal, page, unnest(json_extract_string(images, '$[*]')) AS image, generate_subscripts(json_extract_string(images, '$[*]'), 1) AS i FROM pg WHERE json_type(images) = 'ARRAY'"
_REFERRED = f"""{RECORD_SQL},
used AS (SELECT DISTINCT version_id, asset FROM (SELECT version_id, preview AS asset FROM pg UNION ALL SELECT version_id, image FROM ({_IMAGES}) UNION ALL SELECT version_id, asset FROM tb UNION ALL SELECT version_id, asset FROM md) WHERE coalesce(asset, '') <> ''),
decl AS (SELECT DISTINCT version_id, asset FROM ast)"""
_FRONT = "'---\nschema_version: 1\ndocument_id: ' || to_json(document_id)::VARCHAR || '\nversion_id: ' || to_json(version_id)::VARCHAR || '\nsource_sha256: ' || to_json(lower(source_hash))::VARCHAR || '\nextraction_status: ' || to_json(quality)::VARCHAR || '\nevidence_status: \"unverified\"'"
_BRIEF_PARTS = f"""walk AS (
  SELECT version_id, number, pos, k, card, '' AS parent, 0::BIGINT AS line FROM (SELECT version_id, number, row_number() OVER (PARTITION BY version_id ORDER BY number) - 1 AS pos, count(*) OVER (PARTITION BY version_id) AS k, 'brief.md' AS card FROM pg0)
  UNION ALL
  SELECT version_id, number, pos % w, least(w, k - (pos // w) * w), CASE WHEN card = 'brief.md' THEN 'sections/' || (pos // w + 1) || '.md' ELSE 'sections/' || regexp_replace(card, '^sections/|\\.md$', '', 'g') || '-' || (pos // w + 1) || '.md' END, card, pos // w + 1
  FROM (SELECT *, (k + 7) // 8 AS w FROM walk WHERE k > 8)),
lines AS (
  SELECT version_id, card, pos AS position, '- [Page ' || number || '](' || CASE WHEN card = 'brief.md' THEN 'full.md' ELSE '../full.md' END || '#page-' || number || '): ' || {_excerpt("text")} || CASE WHEN coalesce(preview, '') <> '' THEN ' (page preview available)' ELSE '' END AS line
  FROM walk JOIN pg0 USING (version_id, number) WHERE k <= 8
  UNION ALL
  SELECT version_id, parent, line, '- [Pages ' || lo || '-' || hi || '](' || CASE WHEN parent = 'brief.md' THEN card ELSE regexp_replace(card, '^.*/', '') END || '): ' || {_label(f"substring({_strip('t')}, 1, 100)")}
  FROM (SELECT version_id, parent, card, line, min(number) AS lo, max(number) AS hi, arg_min(coalesce(text, ''), number) AS t FROM walk JOIN pg0 USING (version_id, number) WHERE parent <> '' GROUP BY ALL)),
body AS (SELECT version_id, card, string_agg(line || '\n', '' ORDER BY position) AS b FROM lines GROUP BY ALL),
briefs AS (SELECT version_id, coalesce(card, 'brief.md') AS card, {_FRONT} || '\nfulltext_sha256: ' || coalesce(to_json(lower(markdown_hash))::VARCHAR, 'null') || '\nbrief_method: "{navigation.BRIEF_METHOD}"\n---\n\n{navigation.BRIEF_HEAD}' || coalesce(b, '{navigation.BRIEF_EMPTY}') AS markdown
  FROM (SELECT DISTINCT version_id, document_id, source_hash, quality, markdown_hash FROM versions WHERE document_id IS NOT NULL AND source_hash IS NOT NULL AND quality IS NOT NULL) v LEFT JOIN body USING (version_id))"""
_BRIEFS = f"{_V}, {_P}, {_BRIEF_PARTS}"
# In a bundle a version belongs to the document that it is the current one of.
_OWN_VERSIONS = "(SELECT DISTINCT version_id, document_id, source_hash, quality, markdown_hash FROM versions WHERE document_id IS NOT NULL AND source_hash IS NOT NULL AND quality IS NOT NULL)"
_BUNDLED = "(SELECT DISTINCT x.version_id, cur.document_id, x.source_hash, x.quality, x.markdown_hash FROM versions x JOIN cur ON cur.version_id = x.version_id WHERE x.source_hash IS NOT NULL AND x.quality IS NOT NULL)"


def _catalog(entries: str, title: str) -> str:
    """Cards of a catalog; entries: g, o (order), label, dest, root."""
    return f"""walk AS (
  SELECT g, o, label, dest, pos, k, card, '' AS parent, 0::BIGINT AS line, 0::BIGINT AS first FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY o) - 1 AS pos, count(*) OVER (PARTITION BY g) AS k, root AS card FROM ({entries}))
  UNION ALL
  SELECT g, o, label, dest, pos % w, least(w, k - (pos // w) * w), regexp_replace(card, '\\.md$', '') || '-' || (pos // w + 1) || '.md', card, pos // w + 1, (pos // w) * w + 1 FROM (SELECT *, (k + 31) // 32 AS w FROM walk WHERE k > 32)),
lines AS (
  SELECT g, card, pos AS position, '- [' || {_label("label")} || '](' || CASE WHEN contains(card, '/') THEN '../' ELSE '' END || dest || ')' AS line FROM walk WHERE k <= 32
  UNION ALL
  SELECT g, parent, line, '- [Entries ' || first || '-' || (first + n - 1) || ': ' || {_label("label")} || '](' || regexp_replace(card, '^.*/', '') || ')' FROM (SELECT g, parent, card, line, first, count(*) AS n, arg_min(label, o) AS label FROM walk WHERE parent <> '' GROUP BY ALL)),
cards AS (SELECT g, card, '# ' || {_label(title)} || '\n\n' || string_agg(line || '\n', '' ORDER BY position) AS markdown FROM lines GROUP BY g, card)"""


_KINDS = "coalesce(metadata.kind, 'document')"
_KIND_ENTRIES = f"SELECT {_KINDS} AS g, (document_id, version_id) AS o, coalesce(metadata.title, filename, '') || ' / ' || version_id AS label, 'documents/' || version_id || '/brief.md' AS dest, 'groups/' || left(sha256({_KINDS}), 16) || '.md' AS root FROM cur"
_MAP_ENTRIES = f"SELECT 'kinds' AS g, kind AS o, kind || ': ' || n || ' documents' AS label, 'groups/' || left(sha256(kind), 16) || '.md' AS dest, '_AI_MAP.md' AS root FROM (SELECT {_KINDS} AS kind, count(*) AS n FROM cur GROUP BY 1)"
_SUFFIX = lambda x: f"lower(regexp_extract({x}, '[^/](\\.[^./]+)$', 1))"
_DOCS = f"""{_CUR},
docs AS (SELECT document_id, version_id, metadata.title AS title, {_KINDS} AS kind, filename AS original_filename, lower(source_hash) AS source_sha256, 'documents/' || version_id || '/original' || coalesce({_SUFFIX("filename")}, '') AS original,
  'documents/' || version_id || '/brief.md' AS brief, 'documents/' || version_id || '/full.md' AS fulltext, 'documents/' || version_id || '/extraction.json' AS extraction, 'unverified' AS evidence_status FROM cur)"""
_GUARDED = ", ".join(f"'{x}'" for x in quality.BLOCKED_SUFFIXES)
_META = ["aliases", "brand", "external_reference", "kind", "language", "model", "title"]



def _renamed(parts: str, mark: str) -> str:
    """The same with table names of its own."""
    return re.sub(r"\b(walk|lines|cards)\b", rf"{mark}_\1", parts)


_BUNDLE = f"""{_CUR}, {_P}, {_renamed(_BRIEF_PARTS.replace(_OWN_VERSIONS, _BUNDLED), "b")}, {_renamed(_catalog(_KIND_ENTRIES, "g"), "k")}, {_renamed(_catalog(_MAP_ENTRIES, "'Library map'"), "m")},
fbody AS (SELECT version_id, string_agg('\n## Page ' || number || '\n\n' || {_RENDERED} || '\n', '' ORDER BY number) AS b FROM pg0 GROUP BY 1),
files AS (
  SELECT 'documents/' || version_id || '/full.md' AS path, {_FRONT} || '\n---\n\n# ' || replace(coalesce(metadata.title, filename, ''), '\n', ' ') || '\n\n{reading.NOTICE}\n' || coalesce(b, '') AS content FROM cur LEFT JOIN fbody USING (version_id) WHERE document_id IS NOT NULL AND source_hash IS NOT NULL AND quality IS NOT NULL
  UNION ALL SELECT 'documents/' || version_id || '/' || card, markdown FROM briefs
  UNION ALL SELECT card, markdown FROM k_cards
  UNION ALL SELECT card, markdown || CASE WHEN card = '_AI_MAP.md' THEN '{navigation.MAP_END}' ELSE '' END FROM m_cards
  UNION ALL SELECT '00_CONSTITUTION.md', '# Library reading rules\n\n{"\n\n".join(r.replace("'", "''") for r in bundle.RULES)}\n')"""

SQL = {
    "bundle_manifest": f"WITH RECURSIVE {_BUNDLE} SELECT path, octet_length(encode(content))::BIGINT AS bytes, sha256(content) AS sha256 FROM files",
    "recognition_languages": f"WITH {_HEADS} SELECT DISTINCT version_id, array_to_string(list_filter(string_split(g, '+'), lambda x, i: x <> '' AND list_position(string_split(g, '+'), x) = i), ',') AS languages FROM (SELECT version_id, coalesce(top_language, set_language) AS g FROM h) WHERE g <> ''",
    "sorted_warnings": f"WITH {_HEADS} SELECT DISTINCT version_id, len(w)::INTEGER AS n_warnings, array_to_string(w, ',') AS warnings FROM (SELECT version_id, list_sort(list_distinct(CASE WHEN json_type(j->'$.warnings') = 'ARRAY' THEN json_extract_string(j->'$.warnings', '$[*]') ELSE [] END)) AS w FROM h)",
    "key_problems": f"""WITH {_HEADS}, k AS (SELECT DISTINCT version_id, schema_version, json_keys(j) AS keys FROM h)
SELECT DISTINCT version_id, key, 'unknown' AS problem FROM (SELECT version_id, unnest(keys) AS key FROM k) WHERE key NOT IN ({", ".join(f"'{x}'" for x in records.RECORD_KEYS)})
UNION SELECT version_id, key, 'missing' FROM k, (SELECT unnest([{", ".join(f"'{x}'" for x in records.REQUIRED_KEYS)}]) AS key) WHERE schema_version = '2' AND NOT list_contains(keys, key)""",
    "settings_differences": f"WITH {_HEADS} SELECT DISTINCT version_id, top_language, set_language FROM h WHERE top_language IS NOT NULL AND ocr IS NOT NULL AND top_language IS DISTINCT FROM set_language",
    "request_settings": f"WITH {_HEADS} SELECT DISTINCT version_id, to_json({{'ocr': coalesce(ocr, false), 'ocr_language': CASE WHEN ocr THEN coalesce(set_language, top_language) END}})::VARCHAR AS request FROM h",
    "parser_outputs": f"WITH {_HEADS} SELECT DISTINCT version_id, kind, asset FROM (SELECT version_id, 'raw' AS kind, j->>'$.raw_asset' AS asset FROM h UNION ALL SELECT version_id, 'rendered', j->>'$.rendered_asset' FROM h) WHERE coalesce(asset, '') <> ''",
    "page_visuals": f"""WITH {RECORD_SQL}, n AS (SELECT version_id, page, count(*) AS n_tables FROM (SELECT DISTINCT version_id, page, tid, ordinal FROM tb) GROUP BY ALL)
SELECT DISTINCT p.version_id, p.page, coalesce(n.n_tables, 0) AS n_tables, CASE WHEN json_type(images) = 'ARRAY' THEN json_array_length(images)::BIGINT ELSE 0 END AS n_images, coalesce(preview, '') <> '' AS has_preview FROM pg p LEFT JOIN n ON n.version_id = p.version_id AND n.page = p.page""",
    "cell_boxes": f"""WITH {RECORD_SQL} SELECT DISTINCT version_id, page, tid AS "table", x->>'$.row' AS "row", x->>'$.col' AS col, (x->>'$.bbox.l')::DOUBLE AS l, (x->>'$.bbox.t')::DOUBLE AS t, (x->>'$.bbox.r')::DOUBLE AS r, (x->>'$.bbox.b')::DOUBLE AS b, x->>'$.bbox.coord_origin' AS coord_origin
FROM ce WHERE x->>'$.bbox.l' IS NOT NULL AND x->>'$.bbox.t' IS NOT NULL AND x->>'$.bbox.r' IS NOT NULL AND x->>'$.bbox.b' IS NOT NULL""",
    "provenance": f"WITH {_PROVENANCE} SELECT * FROM pv",
    "table_pages": f'WITH {_PROVENANCE} SELECT DISTINCT version_id, "table", on_page AS page FROM pv WHERE on_page IS NOT NULL',
    "tables_without_content": f"""WITH {RECORD_SQL} SELECT DISTINCT version_id, page, tid AS "table" FROM tb WHERE n_rows = '0' AND n_cols = '0' AND NOT EXISTS (SELECT 1 FROM ce WHERE ce.version_id = tb.version_id AND ce.page = tb.page AND ce.tid = tb.tid)""",
    "table_ids": f"""WITH {RECORD_SQL} SELECT DISTINCT version_id, page, tid AS "table", 'table-' || page || '-' || ordinal AS expected, tid IS NOT DISTINCT FROM 'table-' || page || '-' || ordinal AS regular FROM tb""",
    "text_items": f"WITH {RECORD_SQL} SELECT DISTINCT version_id, page, len(list_filter(text_items::JSON[], lambda i: i->>'$.text' IS NOT NULL)) AS n_items FROM pg WHERE json_type(text_items) = 'ARRAY'",
    "header_cells": f"""WITH {RECORD_SQL}, c AS (SELECT DISTINCT version_id, page, tid AS "table", ordinal, x->>'$.row', x->>'$.col', x->>'$.rowspan', x->>'$.colspan', x->>'$.text', (x->>'$.header')::BOOLEAN AS header FROM ce)
SELECT version_id, page, "table", count(*) FILTER (header) AS n_headers, count(*) AS n_cells FROM c GROUP BY ALL""",
    "asset_set_differences": f"WITH {_REFERRED} SELECT version_id, asset, 'declared' AS side FROM decl ANTI JOIN used USING (version_id, asset) UNION ALL SELECT version_id, asset, 'used' FROM used ANTI JOIN decl USING (version_id, asset)",
    "media_by_position": f"""WITH {RECORD_SQL}, rj AS (SELECT DISTINCT version_id, j FROM rec),
x AS (SELECT version_id, flatten([coalesce(CASE WHEN json_type(p->'$.images') = 'ARRAY' THEN json_extract_string(p->'$.images', '$[*]') END, []) FOR p IN (CASE json_type(j->'$.pages') WHEN 'ARRAY' THEN (j->'$.pages')::JSON[] WHEN 'OBJECT' THEN [j->'$.pages'] ELSE [] END)]) AS im,
  [m->>'$.asset' FOR m IN (CASE json_type(j->'$.embedded_media') WHEN 'ARRAY' THEN (j->'$.embedded_media')::JSON[] WHEN 'OBJECT' THEN [j->'$.embedded_media'] ELSE [] END)] AS me FROM rj)
SELECT DISTINCT version_id, i::INTEGER AS position, im[i] AS image, me[i] AS media FROM (SELECT version_id, im, me, unnest(range(1, greatest(len(im), len(me)) + 1)) AS i FROM x)""",
    "package_problems": f"""WITH {RECORD_SQL}, s AS (SELECT version_id, asset, max(try_cast(v->>'$.bytes' AS BIGINT)) AS n FROM ast GROUP BY ALL), m AS (SELECT DISTINCT version_id, asset, package_part, ordinal FROM md),
g AS (SELECT m.version_id, count(*) AS k, count(DISTINCT package_part) AS d, sum(s.n) AS n FROM m LEFT JOIN s ON s.version_id = m.version_id AND s.asset = m.asset GROUP BY 1)
SELECT version_id, problem FROM (SELECT version_id, CASE WHEN k > {records.MAX_PARTS} THEN 'parts' WHEN k <> d THEN 'duplicate' WHEN n > {records.MAX_EXPANDED} THEN 'size' END AS problem FROM g) WHERE problem IS NOT NULL""",
    "asset_addresses": f"WITH {RECORD_SQL} SELECT DISTINCT version_id, asset, coalesce('assets/' || (v->>'$.sha256') || '.' || regexp_replace(v->>'$.media_type', '^.*/', '') = asset, false) AS regular FROM ast",
    "cached_values": f"""WITH {RECORD_SQL}, c AS (SELECT DISTINCT concat_ws('/', version_id, page, tid) AS sheet, concat_ws(',', x->>'$.row', x->>'$.col') AS coordinate, x->>'$.text' AS text FROM ce),
n AS (SELECT DISTINCT sheet, coordinate FROM c WHERE regexp_full_match(text, '[0-9]+(\\.[0-9]+)?'))
SELECT sheet, count(*) AS n_cells, count(n.coordinate) AS n_values FROM c LEFT JOIN n USING (sheet, coordinate) GROUP BY sheet""",
    "layout_status": f"""WITH {_HEADS}, l AS (SELECT version_id, bool_or(coalesce(ocr, false)) AS ocr FROM h WHERE starts_with(method, 'layout') GROUP BY 1),
t AS (SELECT version_id, count(*) FILTER ({_strip("coalesce(text, '')")} <> '') AS n FROM (SELECT DISTINCT version_id, page, ordinal, text, preview FROM pg) GROUP BY 1)
SELECT l.version_id, CASE WHEN coalesce(n, 0) = 0 AND NOT ocr THEN 'needs_ocr' ELSE 'partial' END AS status FROM l LEFT JOIN t USING (version_id)""",
    "request_problems": f"""WITH {_HEADS}, {_V} SELECT DISTINCT h.version_id, CASE WHEN {_SUFFIX("filename")} NOT IN ('.pdf', '.docx', '.pptx', '.xlsx', '.png', '.jpg', '.jpeg', '.tiff') OR filename IS NULL THEN 'DOCLING_PROFILE_UNSUPPORTED'
WHEN NOT regexp_full_match(coalesce(set_language, top_language, 'eng'), '[a-z0-9_]+(\\+[a-z0-9_]+)*') THEN 'INVALID_OCR_LANGUAGE' WHEN coalesce(ocr_scale, 3.0) NOT BETWEEN 0.1 AND 8.0 THEN 'INVALID_DOCLING_OCR_SCALE' END AS problem FROM h JOIN v USING (version_id)""",
    "scan_failures": f"SELECT DISTINCT scan_id, CASE WHEN upper(error) IN ({', '.join(f"'{x}'" for x in quality.UNSUPPORTED_CODES)}) THEN 'unsupported' ELSE 'failed' END AS status, regexp_matches(error, '(?i)\\[ocr\\].*failed|Failed loading language|Tesseract couldn''t load') AS ocr_failed FROM scans WHERE error IS NOT NULL",
    "scan_payloads": "SELECT DISTINCT scan_id, attempted_at, to_json({'complete': complete, 'root': root, 'scan_id': scan_id})::VARCHAR AS payload FROM scans",
    "scan_report": f"""WITH {_LAST_SCAN}, ok AS (SELECT root, max(success_at) AS success_at FROM scans WHERE root IS NOT NULL AND complete AND error IS NULL GROUP BY 1),
d AS (SELECT * FROM (SELECT l.root, d.removed_at, row_number() OVER (PARTITION BY d.document_id ORDER BY length(l.root) DESC) AS r2 FROM documents d JOIN last l ON starts_with(d.source_path, l.root || '/')) WHERE r2 = 1),
n AS (SELECT root, count(*) AS n_known, count(removed_at) AS n_gone FROM d GROUP BY 1)
SELECT l.root, l.attempted_at, ok.success_at, coalesce(l.complete, false) AND l.error IS NULL AS complete, coalesce(n_known, 0) AS n_known, CASE WHEN coalesce(l.complete, false) AND l.error IS NULL THEN coalesce(n_gone, 0) ELSE 0 END AS n_missing
FROM last l LEFT JOIN ok USING (root) LEFT JOIN n USING (root)""",
    "event_kinds": "SELECT lower(event_type) AS kind, count(*) AS n FROM events GROUP BY 1",
    "commit_sequence": "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 1000 AS seq FROM events",
    "idempotent_ingest": """WITH v AS (SELECT document_id, lower(fingerprint) AS fingerprint, version_id, landed_at >= TIMESTAMP '2024-06-01' AS late FROM versions WHERE document_id IS NOT NULL)
SELECT document_id, fingerprint, min(version_id) AS version_id FROM v a WHERE late AND NOT EXISTS (SELECT 1 FROM v b WHERE NOT b.late AND b.document_id = a.document_id AND b.fingerprint = a.fingerprint) GROUP BY 1, 2""",
    "hash_problems": "SELECT DISTINCT version_id, field, CASE WHEN h IS NULL THEN 'missing' ELSE 'address' END AS problem FROM ("
    + " UNION ALL ".join(f"SELECT version_id, '{c}' AS field, {c} AS h FROM versions WHERE version_id IS NOT NULL" for c in ("source_hash", "markdown_hash", "extraction_hash", "brief_hash"))
    + ") WHERE h IS NULL OR NOT regexp_full_match(h, '[0-9a-fA-F]{64}')",
    "fingerprint_digest": f"WITH v AS (SELECT DISTINCT version_id, source_hash, extraction_hash, metadata FROM versions WHERE version_id IS NOT NULL) SELECT version_id, sha256(to_json({{'brief_method': '{navigation.BRIEF_METHOD}', 'extraction': lower(extraction_hash), 'metadata': {{{', '.join(f"'{m}': metadata.{m}" for m in _META)}}}, 'renderer': '{versions.RENDERER}', 'source': lower(source_hash)}})::VARCHAR) AS sha256 FROM v",
    "identity_conflicts": f"""WITH {_V}, i AS (SELECT DISTINCT v.document_id, regexp_replace(d.source_path, '[^/]*$', '') || v.filename AS path FROM v JOIN documents d USING (document_id))
SELECT DISTINCT i.document_id, i.path, CASE WHEN p.document_id IS NOT NULL THEN 'path' ELSE 'document' END AS problem FROM i LEFT JOIN documents p ON p.source_path = i.path LEFT JOIN documents o ON o.document_id = i.document_id
WHERE i.path IS NOT NULL AND (p.document_id <> i.document_id OR p.document_id IS NULL AND o.source_path <> i.path)""",
    "kind_documents": f"WITH {_CUR}, k AS (SELECT DISTINCT {_KINDS} AS kind, document_id FROM cur) SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY document_id) - 1 AS position, document_id FROM k",
    "metadata_source": f"WITH {_V} SELECT version_id, metadata.title AS title, NULL::VARCHAR AS problem FROM v WHERE metadata IS NOT NULL",
    "readable_versions": "WITH v AS (SELECT DISTINCT version_id, document_id, filename, source_hash, markdown_hash, brief_hash, extraction_hash, quality FROM versions WHERE version_id IS NOT NULL) SELECT v.version_id, v.document_id, v.filename, coalesce(d.current_version = v.version_id, false) AS is_current, lower(source_hash) AS source_sha256, lower(markdown_hash) AS markdown_sha256, lower(brief_hash) AS brief_sha256, lower(extraction_hash) AS extraction_sha256, quality AS extraction_status, 'unverified' AS evidence_status FROM v JOIN documents d USING (document_id)",
    "read_second_page": f"WITH {_V}, {_P}, c AS (SELECT v.version_id FROM v JOIN documents d ON d.document_id = v.document_id AND d.current_version = v.version_id) SELECT version_id, number, sha256(coalesce(text, '')) AS sha256, 'L3' AS layer FROM (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY number) AS o FROM pg0 WHERE version_id IN (SELECT version_id FROM c)) WHERE o = 2",
    "read_assets": f"WITH {RECORD_SQL}, {_V}, c AS (SELECT v.version_id FROM v JOIN documents d ON d.document_id = v.document_id AND d.current_version = v.version_id) SELECT DISTINCT version_id, asset, v->>'$.sha256' AS sha256, v->>'$.bytes' AS bytes, v->>'$.media_type' AS media_type, v->>'$.role' AS role, 'objects/' || (v->>'$.sha256') AS snapshot_path FROM ast WHERE version_id IN (SELECT version_id FROM c)",
    "read_sources": f"WITH {_V} SELECT v.version_id, 'objects/' || lower(source_hash) AS snapshot_path, 'L4' AS layer FROM v JOIN documents d ON d.document_id = v.document_id AND d.current_version = v.version_id WHERE source_hash IS NOT NULL",
    "search_results": f"{_search()} SELECT f.document_id, f.version_id, f.matching_pages, lower(c.source_hash) AS source_sha256, c.quality AS extraction_status, c.metadata.title AS title, EXISTS (SELECT 1 FROM v n WHERE n.document_id = f.document_id AND n.created_at > c.created_at) AS newer_candidate_exists, 'unverified' AS evidence_status FROM found f JOIN cur c USING (document_id, version_id)",
    "folded_titles": f"WITH {_V} SELECT version_id, {_fold_exact('metadata.title')} AS folded FROM v WHERE metadata.title IS NOT NULL",
    "full_briefs": f"WITH RECURSIVE {_BRIEFS} SELECT version_id, card, sha256(markdown) AS sha256 FROM briefs",
    "kind_catalogs": f"WITH RECURSIVE {_CUR}, {_catalog(_KIND_ENTRIES, 'g')} SELECT g AS kind, card, sha256(markdown) AS sha256 FROM cards",
    "library_map": f"WITH RECURSIVE {_CUR}, {_catalog(_MAP_ENTRIES, "'Library map'")} SELECT card, markdown || CASE WHEN card = '_AI_MAP.md' THEN '{navigation.MAP_END}' ELSE '' END AS markdown FROM cards",
    "bundle_documents": f"WITH {_DOCS} SELECT * FROM docs",
    "bundle_assets": f"WITH {RECORD_SQL}, {_CUR} SELECT DISTINCT 'documents/' || version_id || '/' || asset AS path, try_cast(v->>'$.bytes' AS BIGINT) AS bytes, lower(v->>'$.sha256') AS sha256 FROM ast WHERE version_id IN (SELECT version_id FROM cur)",
    "bundle_reference_problems": f"""WITH {_DOCS} SELECT version_id, field, 'BUNDLE_SCHEMA' AS problem FROM (
  SELECT version_id, 'brief' AS field FROM docs WHERE version_id NOT IN (SELECT version_id FROM pages WHERE version_id IS NOT NULL) UNION ALL SELECT version_id, 'fulltext' FROM docs WHERE version_id NOT IN (SELECT version_id FROM pages WHERE version_id IS NOT NULL)
  UNION ALL SELECT version_id, 'extraction' FROM docs WHERE version_id NOT IN (SELECT version_id FROM extractions WHERE version_id IS NOT NULL) UNION ALL SELECT version_id, 'original' FROM docs WHERE source_sha256 IS NULL)""",
    "entry_signatures": f"WITH {IN_EFFECT_SQL} SELECT file_id, '[' || coalesce(size::VARCHAR, 'null') || ',' || coalesce(epoch_us(captured_at)::VARCHAR, 'null') || ']' AS signature FROM eff",
    "merged_integrity": "SELECT file_id, arg_max(integrity['sha256'], (captured_at, integrity['sha256'])) FILTER (integrity['sha256'] IS NOT NULL) AS sha256 FROM entries WHERE file_id IS NOT NULL GROUP BY 1",
    "inventory_changes": """WITH o AS (SELECT DISTINCT file_id, captured_at, size, integrity['sha256'] AS sha FROM entries WHERE file_id IS NOT NULL),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY captured_at NULLS FIRST, size NULLS FIRST, sha NULLS FIRST) AS rn FROM o) WHERE rn = 1),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY captured_at DESC NULLS LAST, size DESC NULLS LAST, sha DESC NULLS LAST) AS rn FROM o) WHERE rn = 1)
SELECT file_id AS path, CASE WHEN a.size <> b.size THEN 'size' ELSE 'hash' END AS problem FROM a JOIN b USING (file_id) WHERE a.size <> b.size OR lower(a.sha) <> lower(b.sha)""",
    "snapshot_problems": "SELECT DISTINCT file_id, problem FROM (SELECT file_id, CASE WHEN coalesce(file_id, '') = '' THEN 'id' WHEN coalesce(name, '') = '' THEN 'name' WHEN kind IS NULL OR kind NOT IN ('file', 'folder') THEN 'kind' WHEN size < 0 THEN 'size' WHEN count(*) OVER (PARTITION BY file_id) > 1 THEN 'duplicate' END AS problem FROM entries) WHERE problem IS NOT NULL",
    "safe_paths": "SELECT DISTINCT p AS path, regexp_full_match(p, '[a-zA-Z0-9_./-]+') AND NOT starts_with(p, '/') AND NOT list_contains(string_split(p, '/'), '..') AS safe, CASE WHEN NOT (replace(p, '\\', '/') = '' OR starts_with(replace(p, '\\', '/'), '/') OR regexp_matches(p, '^[A-Za-z]:') OR list_has_any(string_split(replace(p, '\\', '/'), '/'), ['', '.', '..'])) THEN replace(p, '\\', '/') END AS relative FROM (SELECT substring(source_path, 2) AS p FROM documents)",
    "tree_guard": f"SELECT 'private-artifact-or-link' AS rule, count(*) FILTER ({_SUFFIX('source_path')} IN ({_GUARDED})) AS n FROM documents UNION ALL SELECT 'binary-or-large-file', count(*) FILTER (coalesce({_SUFFIX('source_path')}, '') NOT IN ({_GUARDED}) AND (octet_length(encode(text)) > 1000000 OR contains(text, chr(0)))) FROM documents",
    "marked_payloads": "SELECT DISTINCT version_id, length(payload) - 1 AS n FROM extractions WHERE starts_with(payload, chr(65279))",
    "path_scope": "SELECT document_id, (starts_with(source_path, '/library/') OR starts_with(source_path, '/intake/vendor/')) AND " + _SUFFIX("source_path") + " IN ('.txt', '.md', '.pdf', '.doc', '.docx', '.xlsx', '.pptx', '.png', '.jpg', '.jpeg', '.tiff') AS in_scope FROM documents",
}
