"""Text cleaning, tag tokens, content types and public URLs."""

from __future__ import annotations

from mimetypes import MimeTypes

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsepress.schemas import BLOCKED_AUTHORS, MAX_WORDS

# White space at the ends of a text and between words, and what counts as a token.
_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_TOKEN = r"[\p{L}\p{N}]+"


def _column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(column) -> Column:
    """Without white space at both ends; NULL when nothing is left."""
    return F.nullif(F.btrim(_column(column), F.lit(_SPACES)), F.lit(""))


def count_words(column) -> Column:
    """Words between white space, at most the largest small integer; 0 for NULL."""
    # A class with all spaces in the pattern would cost three times as much.
    plain = F.translate(_column(column), _SPACES, " " * len(_SPACES))
    return F.least(F.coalesce(F.regexp_count(plain, F.lit(r"\S+")), F.lit(0)), F.lit(MAX_WORDS))


def clean_author(column) -> Column:
    name = strip(column)
    return F.when(F.lower(name).isin(BLOCKED_AUTHORS), None).otherwise(name)


def tokens(column) -> Column:
    """Lower-case runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(_column(column)), F.lit(_TOKEN), F.lit(0))


def tags_text(*arrays) -> Column:
    """The elements of all arrays joined by spaces; NULL arrays and NULL elements are left out."""
    empty = F.array().cast("array<string>")
    parts = [F.coalesce(_column(a), empty) for a in arrays]
    return F.array_join(F.array_compact(F.concat(*parts)), " ")


def tag_tokens(regions="regions", entities="entities", categories="categories") -> Column:
    """Searchable tags of an article: tokens of its regions, entities and categories."""
    return tokens(tags_text(regions, entities, categories))


# Content type by file extension.
CONTENT_TYPES = {
    "css": "text/css",
    "csv": "text/csv",
    "gif": "image/gif",
    "htm": "text/html",
    "html": "text/html",
    "jpeg": "image/jpeg",
    "jpg": "image/jpeg",
    "js": "text/javascript",
    "json": "application/json",
    "md": "text/markdown",
    "mp3": "audio/mpeg",
    "mp4": "video/mp4",
    "pdf": "application/pdf",
    "png": "image/png",
    "svg": "image/svg+xml",
    "txt": "text/plain",
    "xml": "text/xml",
    "zip": "application/zip",
}
#: The standard table of extensions; the types above go first.
STANDARD_TYPES = {k.lstrip("."): v for k, v in MimeTypes(filenames=()).types_map[True].items()} | CONTENT_TYPES


def content_type(path) -> Column:
    """Content type by file extension, octet stream when it is not known."""
    extension = F.lower(F.regexp_extract(_column(path), r"\.([A-Za-z0-9]+)$", 1))
    pairs = [F.lit(v) for pair in sorted(STANDARD_TYPES.items()) for v in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), extension), F.lit("application/octet-stream"))


def public_url(path, base: str | None) -> Column:
    """Address of an exported item: base address and key, or the key alone."""
    path = _column(path)
    return F.concat_ws("/", F.lit(base.rstrip("/")), path) if base else path
