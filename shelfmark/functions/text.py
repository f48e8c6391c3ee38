"""Text rules of the library as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.strip and str.split see it.
SPACE = r"[\s\x1c-\x1f]"


def fold(text: str) -> str:
    """NFKC, case folded, letters and digits only."""
    return "".join(c for c in unicodedata.normalize("NFKC", text).casefold() if c.isalnum())


def _fold_series(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else fold(t))


def folded_exact(col: Column) -> Column:
    """Exact folding in Arrow batches; null stays null."""
    return F.pandas_udf(_fold_series, "string")(col)


def folded(col: Column) -> Column:
    """Native folding: equal to the exact one on text without compatibility forms."""
    return F.regexp_replace(F.regexp_replace(F.lower(col), "ß", "ss"), r"[^\p{L}\p{N}]", "")


def search_terms(query: str) -> list[str]:
    """Folded terms of a query; empty ones fall away."""
    return [t for t in map(fold, query.split()) if t]


def stripped(col: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(col, f"(?U)^{SPACE}+|{SPACE}+$", "")


def label(col: Column) -> Column:
    """White space collapsed and Markdown brackets escaped."""
    one = F.regexp_replace(stripped(col), f"(?U){SPACE}+", " ")
    for ch, to in (("[", r"\["), ("]", r"\]"), ("<", "&lt;"), (">", "&gt;")):
        one = F.replace(one, F.lit(ch), F.lit(to))
    return one


def excerpt(col: Column, length: int = 160) -> Column:
    """Label of the first characters; a fixed text for blank input."""
    s = stripped(F.coalesce(col, F.lit("")))
    return F.when(s == "", F.lit("[No extracted text]")).otherwise(label(F.substring(s, 1, length)))


def suffix(name: Column) -> Column:
    """Lower-case extension with its dot; empty for none and for dot files."""
    return F.lower(F.regexp_extract(name, r"[^/](\.[^./]+)$", 1))


def extension(name: Column) -> Column:
    """What follows the last dot, lower case; the whole name if it has none."""
    return F.lower(F.substring_index(name, ".", -1))


# Extensions of source files in the folder inventory.
SOURCE_EXTENSIONS = ["pdf", "doc", "docx", "xls", "xlsx", "xlsm", "ppt", "pptx", "rtf", "jpg", "jpeg", "png", "tif", "tiff", "bmp"]


def is_sidecar(name: Column) -> Column:
    """Name of a text file beside an original: ends in .md (this case) after a name with a source extension."""
    base = F.regexp_replace(name, r"\.md$", "")
    return name.endswith(".md") & extension(base).isin(SOURCE_EXTENSIONS)


def html_escaped(col: Column) -> Column:
    """HTML escapes of & < > and both quotes, line breaks as <br>."""
    for ch, to in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"), ("\n", "<br>")):
        col = F.replace(col, F.lit(ch), F.lit(to))
    return col


def digest(col: Column) -> Column:
    return F.sha2(col, 256)


def canonical(*fields: tuple[str, Column]) -> Column:
    """Canonical JSON of named fields: keys sorted, no spaces, nulls kept. No floating-point fields."""
    return F.to_json(F.struct(*[c.alias(n) for n, c in sorted(fields, key=lambda f: f[0])]), {"ignoreNullFields": "false"})


def asset_address(sha: Column, ext: Column) -> Column:
    return F.concat(F.lit("assets/"), sha, F.lit("."), ext)


# Fixed value: the form of an asset's address.
ASSET_ADDRESS = r"^assets/([0-9a-f]{64})\.(png|jpg|gif|webp|tiff|bmp|json|html|xml|pdf|bin)$"


def safe_bundle_path(path: Column) -> Column:
    """A relative path of plain characters without parent steps."""
    return path.rlike(r"^[a-zA-Z0-9_./-]+$") & ~path.startswith("/") & ~F.array_contains(F.split(path, "/"), "..")


def status_tail(col: Column) -> Column:
    """Last dotted part in lower case, as of an enum's name."""
    return F.lower(F.substring_index(col, ".", -1))


# Leading bytes of the known formats, in hexadecimal.
MAGIC = {"png": "89504E470D0A1A0A", "jpg": "FFD8FF", "gif": "474946383761|474946383961", "bmp": "424D", "pdf": "255044462D"}


def magic_kind(content: Column) -> Column:
    """Format by leading bytes; bin for any other."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("bin")
    for kind, prefixes in MAGIC.items():
        out = F.when(F.lit(False) | head.rlike(f"^(?:{prefixes})"), kind).otherwise(out)
    return out
