"""Patterns of the detectors and the columns that scan for them. Offsets count code points; ends are exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,type:string,raw_type:string,value:string>"
NO_SPANS = f"array<{SPAN}>"

# The detectors' regexes, in RE2's syntax.
EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
PHONE = r"(?:\+?\d{1,3}[\s-]?)?(?:\(\d{1,4}\)[\s-]?)?[\d\s-]{7,15}\b"
CREDIT_CARD = r"\b(?:\d[ -]*?){13,19}\b"
IP_ADDRESS = r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"
TAG = r"<[A-Z_]+_\d+>"
BLANK = r"\t\n\f\r "


def jvm(pattern: str) -> str:
    """The pattern for the JVM's engine: word boundaries and blanks in ASCII, as RE2 reads them."""
    edge = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
    out, inside, at = "", False, 0
    while at < len(pattern):
        two = pattern[at : at + 2]
        if two == r"\b" and not inside:
            out, at = out + edge, at + 2
        elif two == r"\s":
            out, at = out + (r"\t\n\f\r " if inside else r"[\t\n\f\r ]"), at + 2
        elif two[0] == "\\":
            out, at = out + two, at + 2
        else:
            inside = two[0] == "[" or inside and two[0] != "]"
            out, at = out + two[0], at + 1
    return out


def is_blank(text: Column) -> Column:
    """Null, empty or only white space."""
    return text.isNull() | F.rlike(text, F.lit(r"^\s*$"))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of all leftmost non-overlapping matches of a non-empty pattern.

    The text is cut at the matches; lengths of matches and of the gaps between them give the offsets.
    """
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.filter(F.arrays_zip(found.alias("m"), F.transform(gaps, lambda g: F.length(g)).alias("g")), lambda x: x.m.isNotNull())
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,value:string>>").alias("out"))
    return F.aggregate(
        pairs, start,
        lambda a, x: F.struct((a.at + x.g + F.length(x.m)).alias("at"), F.array_append(a.out, F.struct((a.at + x.g).alias("start"), (a.at + x.g + F.length(x.m)).alias("end"), x.m.alias("value"))).alias("out")),
        lambda a: a.out,
    )


def scan(text: Column, pattern: str, kind: str, keep=None) -> Column:
    """Spans of a pattern: matches without the blanks at their ends, those that become empty left out; null: none.

    Texts without a match, nearly all of them, are ruled out by one search. keep: a further test of the value."""
    own = jvm(pattern)
    lead = F.regexp_extract
    trimmed = F.transform(
        matches(text, own),
        lambda m: F.struct((m.start + F.length(lead(m.value, f"^[{BLANK}]+", 0))).alias("start"), (m.end - F.length(lead(m.value, f"[{BLANK}]+$", 0))).alias("end"), F.regexp_replace(F.regexp_replace(m.value, f"^[{BLANK}]+", ""), f"[{BLANK}]+$", "").alias("value")),
    )
    spans = F.transform(F.filter(trimmed, lambda s: (s.end > s.start) & (keep(s.value) if keep else F.lit(True))), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(kind).alias("type"), F.lit(kind).alias("raw_type"), s.value.alias("value")))
    return F.when(F.rlike(text, F.lit(own)), spans).otherwise(F.array().cast(NO_SPANS))


def is_card_number(value: Column) -> Column:
    """13 to 19 digits, but for blanks and dashes, that pass the Luhn test."""
    digits = F.regexp_replace(value, rf"[{BLANK}-]", "")
    return F.length(digits).between(13, 19) & F.coalesce(F.call_function("luhn_check", digits), F.lit(False))
