"""The library's settings: their schema, and the empty tables of a new library."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

from shelfmark.sources.files import EXTENSIONS, MAX_FILE_BYTES
from shelfmark.sources.store import Table

#: The tables of a library and their schemas.
TABLES = {
    "documents": "document_id string, source_path string, current_version string",
    "versions": "version_id string, document_id string, fingerprint string, source_hash string, metadata struct<title:string,kind:string,brand:string,model:string,language:string,external_reference:string,aliases:array<string>>, filename string, quality string, created_at timestamp_ntz",
    "events": "seq long, at double, kind string, payload string",
    "observations": "path string, signature string, stable_since double",
    "scans": "root string, attempted_at double, success_at double, complete boolean, error string",
}


def default_policy(roots: list[str]) -> dict:
    # The settings that a new library starts with.
    return {"schema_version": 1, "source_roots": roots, "extensions": list(EXTENSIONS), "max_file_bytes": MAX_FILE_BYTES, "settle_seconds": 30, "max_scan_age_seconds": 172_800, "publication": "manual"}


def inside(path: str, other: str) -> bool:
    """One path is the other or lies in it."""
    return Path(path).is_relative_to(other)


def has_link(path: str) -> bool:
    """The path or one of its folders is a symbolic link."""
    p = Path(os.path.abspath(path))
    return any(x.is_symlink() for x in (p, *p.parents))


def policy_problem(policy: object, home: str) -> str | None:
    """POLICY_SCHEMA or SOURCE_SCOPE for settings that can't be used; null for good ones.

    The keys are exactly those of :func:`default_policy`. Limits are whole numbers above 0, not truth values. Roots are absolute, no two
    of them overlap, and none overlaps the library's own folder.
    """
    if not isinstance(policy, dict) or set(policy) != set(default_policy([])):
        return "POLICY_SCHEMA"
    whole = [policy[k] for k in ("schema_version", "max_file_bytes", "settle_seconds", "max_scan_age_seconds")]
    if any(type(x) is not int or x < 1 for x in whole) or policy["schema_version"] != 1 or policy["publication"] != "manual":
        return "POLICY_SCHEMA"
    roots, kinds = policy["source_roots"], policy["extensions"]
    if not isinstance(roots, list) or not roots or not all(isinstance(r, str) and os.path.isabs(r) for r in roots):
        return "POLICY_SCHEMA"
    if not isinstance(kinds, list) or not kinds or any(k not in EXTENSIONS for k in kinds):
        return "POLICY_SCHEMA"
    places = [*roots, home]
    if any(inside(a, b) or inside(b, a) for i, a in enumerate(places) for b in places[i + 1 :]) or any(has_link(r) for r in roots):
        return "SOURCE_SCOPE"
    return None


def initialize(spark: SparkSession, home: str, roots: list[str]) -> dict[str, Table]:
    """The empty tables of a new library under home; raises for settings that can't be used or a home that has tables."""
    problem = policy_problem(default_policy(roots), home) or next(("SOURCE_SCOPE" for r in roots if not Path(r).is_dir()), None)
    if problem:
        raise ValueError(problem)
    tables = {name: Table(spark, f"file://{home}/{name}", schema) for name, schema in TABLES.items()}
    if any(t.last() for t in tables.values()):
        raise ValueError("ALREADY_INITIALIZED")
    for t in tables.values():
        t.append(spark.createDataFrame([], t.schema))
    return tables
