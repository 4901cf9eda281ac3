"""Scalar text functions as Column expressions; none is a UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(x: Column) -> Column:
    """Without white space at both ends, Unicode's included (``trim`` only knows the space)."""
    return F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def replace_all(x: Column, pairs: list[tuple[str, str]]) -> Column:
    """Literal replacements, in the order given."""
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, x)


def stem(name: Column) -> Column:
    """A file name without folders and its last extension."""
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def extension(name: Column) -> Column:
    """The last extension, lower-case, without the dot; empty if there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)$", 1))


def slug(x: Column, pairs: list[tuple[str, str]] | None = None, suffix: str = "") -> Column:
    """An identifier: suffix off, ordered replacements, brackets, dots, underscores and spaces to one hyphen."""
    x = F.regexp_replace(x, suffix, "") if suffix else x
    x = replace_all(x, pairs or [])
    for pattern in (r"[\[\]().]+", r"(?U)[_\s]+", "-+"):
        x = F.regexp_replace(x, pattern, "-")
    return F.lower(F.btrim(x, F.lit("-")))


def word_count(x: Column) -> Column:
    """Words between white space; 0 for a null or blank text."""
    s = strip(F.coalesce(x, F.lit("")))
    return F.when(s == "", 0).otherwise(F.size(F.split(s, r"(?U)[\s\x1c-\x1f]+"))).cast("long")


def line_count(x: Column) -> Column:
    """Lines as a reader counts them: a break at the very end begins no further line."""
    x = F.coalesce(x, F.lit(""))
    return F.when(x == "", 0).otherwise(F.size(F.split(F.regexp_replace(x, r"\r?\n$", ""), "\n"))).cast("long")


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole``, and 0 of nothing."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def rounded(x: Column, digits: int = 3) -> Column:
    """Rounded half to even on the exact binary value."""
    return _fixed(x, digits).cast("double")


def _fixed(x: Column, digits: int) -> Column:
    """A number with so many digits after the point, and no commas."""
    return F.call_function("format_number", x, F.lit("0." + "0" * digits if digits else "0"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.concat(_fixed(x * 100, digits), F.lit("%"))


def word_set(x: Column) -> Column:
    """The distinct lower-case words of a text."""
    return F.array_distinct(F.filter(F.split(F.lower(x), r"(?U)[^\w]+"), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two texts' sets of lower-case words; 0 if both are empty."""
    a, b = word_set(a), word_set(b)
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def strip_html(x: Column) -> Column:
    """The text of a page: scripts, styles and tags off, the commonest entities decoded."""
    for pattern, by in ((r"(?is)<(script|style)\b.*?</\1>", " "), (r"(?s)<!--.*?-->", " "), (r"(?i)<(br|/p|/div|/li|/h\d|/tr)\b[^>]*>", "\n"), (r"(?s)<[^>]*>", " ")):
        x = F.regexp_replace(x, pattern, by)
    x = replace_all(x, [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")])
    return strip(F.regexp_replace(F.regexp_replace(x, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


def placeholder(x: Column) -> Column:
    """Whether a draft still has a place to be filled in."""
    return x.rlike(r"\bTBD\b|\$_{2,}|_{4,}|\[\s*\]|\[(?i:insert|name|date|amount|●)[^\]]*\]")


#: Patterns of content that must not leave the house; our own list, by name.
PRIVILEGED = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}",
    "key": r"(?:[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]) ?[=:] ?.[A-Za-z0-9]{16,}",
    "notice": r"(?i)attorney[- ]client|privileged (and|&) confidential|work product",
}


def privileged(x: Column) -> dict[str, Column]:
    """For each name of ``PRIVILEGED`` whether ``x`` holds such content."""
    return {name: x.rlike(pattern) for name, pattern in PRIVILEGED.items()}
