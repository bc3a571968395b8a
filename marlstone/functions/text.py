"""Text measures that every stage shares, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word character of any script; the same in every engine that knows Unicode classes, unlike \w.
WORD = r"[\p{L}\p{N}_]+"


def column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_count(text: str | Column) -> Column:
    """Stretches without white space."""
    return F.size(F.regexp_extract_all(column(text), F.lit(r"\S+"), F.lit(0)))


def tokens(text: str | Column) -> Column:
    """Lower-cased word tokens, in order."""
    return F.regexp_extract_all(F.lower(column(text)), F.lit(WORD), F.lit(0))


def chunk_tokens(words: str | Column) -> Column:
    """Estimated tokens of so many words: 1.3 a word, truncated."""
    return F.floor(column(words) * F.lit(1.3).cast("double")).cast("int")


def char_tokens(text: str | Column) -> Column:
    """Estimated tokens of a text: a quarter of its characters, at least one unless it is empty."""
    n = F.length(column(text))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4).cast("int")))


def xml_escape(text: str | Column) -> Column:
    out = column(text)
    for a, b in ("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def paragraphs(text: str | Column) -> Column:
    """Non-empty paragraphs, trimmed."""
    return F.filter(F.transform(F.split(column(text), "\n\n"), lambda x: F.trim(x)), lambda x: x != "")


def section_number(heading: str | Column) -> Column:
    """The leading dotted number of a heading as integers; empty if there is none."""
    found = F.regexp_extract(column(heading), r"^(\d+(?:\.\d+)*)\b", 1)
    return F.when(found == "", F.array().cast("array<int>")).otherwise(F.transform(F.split(found, r"\."), lambda x: x.cast("int")))


def is_descendant(child: Column, parent: Column) -> Column:
    """Whether a section number lies below another; both must be known."""
    return (F.size(parent) > 0) & (F.size(child) > F.size(parent)) & (F.slice(child, 1, F.greatest(F.size(parent), F.lit(1))) == parent)


def pdf_date(text: str | Column) -> Column:
    """``D:yyyyMMddHHmmss+..`` as a timestamp; anything that doesn't have an offset sign behind 14 digits is null."""
    clean = F.regexp_replace(F.trim(column(text)), r"^D:", "")
    signed = F.substring(clean, 15, 1).isin("+", "-")
    return F.when(signed, F.try_to_timestamp(F.substring(clean, 1, 14), F.lit("yyyyMMddHHmmss")))


def mime_type(path: str | Column) -> Column:
    ext = F.lower(F.regexp_extract(column(path), r"\.([^./]+)$", 1))
    return F.when(ext == "pdf", "application/pdf").when(ext == "txt", "text/plain").when(ext == "json", "application/json").when(ext == "html", "text/html").otherwise("application/octet-stream")


def is_hidden(path: str | Column) -> Column:
    """Whether any part of the path starts with a dot."""
    return F.exists(F.split(column(path), "/"), lambda x: x.startswith("."))
