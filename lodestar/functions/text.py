"""Text normalisation, parsing and matching as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inflection endings and what may stand for each.
SUFFIXES = (
    ("ої", ""), ("ому", ""), ("ами", ""), ("ями", ""), ("ові", ""), ("еві", ""), ("ою", "а"), ("ею", "я"), ("єю", "я"), ("ій", "а"),
    ("ої", "а"), ("у", "а"), ("ю", "я"), ("і", "а"), ("и", "а"), ("ї", "я"), ("а", ""), ("я", ""), ("у", ""), ("ю", ""), ("і", ""),
    ("ом", ""), ("ем", ""), ("є", "я"), ("е", "а"), ("ы", "а"), ("ой", "а"), ("ах", "и"),
)


def norm(text: Column) -> Column:
    """Lower case, one kind of apostrophe, ё as е, single spaces."""
    plain = F.translate(text, "’ʼ`´‘", "'''''")
    return F.lower(F.trim(F.regexp_replace(F.translate(plain, "ёЁ", "еЕ"), r"\s+", " ")))


def variants(name: Column, rules: tuple[tuple[str, str], ...] = SUFFIXES, spare: int = 2) -> Column:
    """The name, then each form that a suffix rule gives it, in order and without repeats."""
    forms = [
        F.when(F.endswith(name, F.lit(end)) & (F.length(name) > len(end) + spare), F.concat(F.substring(name, F.lit(1), F.length(name) - len(end)), F.lit(put)))
        for end, put in rules
    ]
    return F.array_distinct(F.array_compact(F.array(name, *forms)))


def first_class(text: Column, classes: list[tuple[str, tuple[str, ...]]], default: str | None = None) -> Column:
    """Label of the first class any of whose words the text contains."""
    out = F.lit(default)
    for label, words in reversed(classes):
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(F.lower(text), F.lit(w))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def strip_html(html: Column) -> Column:
    """Text of a fragment: breaks become line feeds, tags go, the common entities are read."""
    out = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>", " ")
    out = F.regexp_replace(F.regexp_replace(out, r"(?i)<br\s*/?>", "\n"), r"(?s)<[^>]*>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(out)


def family(callsign: Column) -> Column:
    """Letters before the number of a callsign; null if it has no such form."""
    return F.nullif(F.regexp_extract(F.trim(callsign), r"^([A-Z]{2,6})\d", 1), F.lit(""))


def citations(text: Column) -> Column:
    """Numbers of facts cited as [F1] or [F2, F3], in order."""
    return F.regexp_extract_all(text, F.lit(r"F(\d+)"), F.lit(1))


def cites_well(text: Column, known: Column, least: int = 2) -> Column:
    """Every fact cited is known and at least so many different ones are."""
    found = F.array_distinct(citations(text))
    return (F.size(F.array_except(found, known)) == 0) & (F.size(found) >= least)


def without_thoughts(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def split_filled(text: Column, separator: str = ";") -> Column:
    """Parts of a separated list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(text, separator), lambda x: F.trim(x)), lambda x: x != "")


def suffix_key(text: Column, separator: str = "///") -> Column:
    return F.trim(F.element_at(F.split(text, separator), -1))


def valid_mmsi(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[2-7]\d{8}$"), F.lit(False))


def hash_id(*parts: Column, size: int = 16, separator: str = "|") -> Column:
    """Leading characters of a SHA-1 of the joined parts."""
    return F.substring(F.sha1(F.concat_ws(separator, *parts)), 1, size)


def required(value: Column, message: str, kind: str = "double") -> Column:
    """Strict cast: a value that is missing or does not read raises."""
    return F.coalesce(value.try_cast(kind), F.raise_error(F.lit(message)).cast(kind))


def ops(op: str, left: Column, right: Column) -> Column:
    """Comparison by name; a missing left side is false but for == and !=, which take null as a value."""
    table = {
        "==": lambda: left.eqNullSafe(right), "!=": lambda: ~left.eqNullSafe(right),
        ">": lambda: left > right, ">=": lambda: left >= right, "<": lambda: left < right, "<=": lambda: left <= right,
        "contains": lambda: F.contains(F.lower(left.cast("string")), F.lower(right.cast("string"))),
    }
    if op not in table:
        raise ValueError(f"unknown comparison {op!r}")
    return F.coalesce(table[op](), F.lit(False))
