"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean query over lower-case trigrams is derived: what any match must contain. Postings
hold which texts have which of the trigrams that the queries name; intersecting them gives each rule's candidates,
and only these are verified with the regex. A rule without mandatory trigrams scans every text.

Defined results: null and empty texts have no spans. Offsets count code points, ends are exclusive. Rows of equal
text get equal spans; repeated rows stay repeated. Columns of other names pass unread.
"""

from __future__ import annotations

import re._constants as op
import re._parser as sre
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType


@dataclass(frozen=True)
class Rule:
    """Matches of pattern, leftmost and non-overlapping; those whose group has fewer than `least` characters are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


def _any_case(text: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in text)


_NAMES = "|".join(map(_any_case, ("password", "passwd", "secret", "token"))) + "|" + _any_case("api") + "_?" + _any_case("key")
#: The base kinds. A run of [0-9a-f] or one that follows AKIA is taken whole, so a least length may stand in the pattern.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("forge", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("url_login", r"[a-z]{2,10}://[A-Za-z0-9._-]{1,64}:[A-Za-z0-9._~!$-]{6,64}@"),
)
RULES = BASE + MORE

#: Strings that a part of a regex may stand for before they are given up as too many, and terms of a query.
_MOST_STRINGS, _MOST_TERMS = 200, 60
Query = frozenset[frozenset[str]]  # any of these sets of trigrams, whole; the empty set holds for every text
ALL: Query = frozenset([frozenset()])


def _least_terms(terms) -> Query:
    terms = set(terms)
    return frozenset(t for t in terms if not any(s < t for s in terms))


def _of_strings(strings: set[str]) -> Query:
    return _least_terms(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


def _both(a: Query, b: Query) -> Query:
    both = _least_terms(s | t for s in a for t in b)
    return both if len(both) <= _MOST_TERMS else min(a, b, key=len)


def _item(kind, value) -> tuple[set[str] | None, Query]:
    """The strings that a part can stand for, in lower case (None: too many to list), and its query."""
    if kind == op.LITERAL:
        return {chr(value).lower()}, ALL
    if kind == op.IN:
        chars: set[str] = set()
        for k, v in value:
            if k == op.LITERAL:
                chars.add(chr(v).lower())
            elif k == op.RANGE and v[1] - v[0] < 8:
                chars |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None, ALL
        return (chars, ALL) if len(chars) <= 8 else (None, ALL)
    if kind == op.SUBPATTERN:
        return _sequence(value[-1])
    if kind == op.BRANCH:
        parts = [_sequence(x) for x in value[1]]
        if all(s is not None for s, _ in parts):
            return set().union(*(s for s, _ in parts)), ALL
        return None, _least_terms(t for s, q in parts for t in (q if s is None else _both(q, _of_strings(s))))
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT):
        least, most, inner = value
        strings, query = _sequence(inner)
        if least == 0:
            return ({""} | strings, ALL) if most == 1 and strings is not None else (None, ALL)
        if strings is not None and least == most and len(strings) ** least <= _MOST_STRINGS:
            return reduce(lambda a, _: {x + y for x in a for y in strings}, range(least), {""}), ALL
        return None, query if strings is None else _both(query, _of_strings(strings))
    return None, ALL


def _sequence(parts) -> tuple[set[str] | None, Query]:
    strings, query, whole = {""}, ALL, True
    for kind, value in parts:
        own, q = _item(kind, value)
        query = _both(query, q)
        if own is not None and len(strings) * len(own) <= _MOST_STRINGS:
            strings = {a + b for a in strings for b in own}
        else:
            query, whole = _both(query, _of_strings(strings)), False
            strings = own if own is not None and len(own) <= _MOST_STRINGS else {""}
    return (strings, query) if whole else (None, _both(query, _of_strings(strings)))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams of which each match has one whole. ALL: nothing is mandatory."""
    strings, query = _sequence(sre.parse(pattern))
    return query if strings is None else _both(query, _of_strings(strings))


def found_spans(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's matches: lengths of matches and of the gaps between them, summed up."""
    pattern = F.lit(rule.pattern)
    matches, gaps = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, rule.pattern, -1)
    pairs = F.arrays_zip(matches.alias("m"), F.transform(gaps, lambda g: F.length(g)).alias("g"))
    empty = F.array().cast("array<struct<start:int,end:int>>")
    step = lambda a, x: F.struct((a.at + x.g + F.length(x.m)).alias("at"), F.when(F.length(F.regexp_extract(x.m, rule.pattern, rule.group)) >= rule.least, F.array_append(a.out, F.struct((a.at + x.g).alias("start"), (a.at + x.g + F.length(x.m)).alias("end")))).otherwise(a.out).alias("out"))
    spans = F.aggregate(F.filter(pairs, lambda x: x.m.isNotNull()), F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda a: a.out)
    return F.transform(spans, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(rule.kind).alias("kind")))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """(trigram, key) of the texts (key, text) that have it, in any case of ASCII letters.

    Texts are lower-cased once, the trigrams' tests are generated code, and the explode is an outer one: for a plain one
    the optimizer tests the array's size below, which makes the array twice."""
    low = texts.select("key", F.lower("text").alias("low"))
    held = low.select("key", F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams)).alias("held"))
    return held.select(F.explode_outer("held").alias("trigram"), "key").where("trigram is not null")


def scan(documents: DataFrame, *, text_col: str = "text", out_col: str = "spans", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """documents with out_col: the spans of all rules, array<struct<start, end, kind>>, by start, then as the rules are listed."""
    queries = {rule: trigram_query(rule.pattern) for rule in rules}
    indexed = {rule: q for rule, q in queries.items() if q != ALL}
    text = F.coalesce(F.col(text_col), F.lit(""))
    none = F.array().cast("array<struct<start:int,end:int,kind:string>>")
    # the key is over all plain columns, so that copies of one text don't meet in one task; rows that share one only add candidates
    plain = [F.col(f"`{f.name}`") for f in documents.schema if isinstance(f.dataType, AtomicType)]
    source = documents.withColumns({"__text": text, "__key": F.xxhash64(*plain)})
    trigrams = sorted({t for q in indexed.values() for term in q for t in term})
    if trigrams:
        has = lambda term: reduce(Column.__and__, (F.array_contains("have", t) for t in sorted(term)))
        of_rule = lambda q: reduce(Column.__or__, (has(term) for term in sorted(q, key=sorted)))
        held = postings(source.select(F.col("__key").alias("key"), F.col("__text").alias("text")), trigrams).groupBy("key").agg(F.collect_set("trigram").alias("have"))
        picked = held.select(F.col("key").alias("__key"), F.array_compact(F.array(*(F.when(of_rule(q), F.lit(rule.kind)) for rule, q in indexed.items()))).alias("__rules")).where(F.size("__rules") > 0)
        source = source.join(picked, "__key", "left")
    else:
        source = source.withColumn("__rules", F.array().cast("array<string>"))
    each = [F.when(F.array_contains("__rules", rule.kind) if rule in indexed else F.rlike("__text", F.lit(rule.pattern)), found_spans(F.col("__text"), rule)) for rule in rules]
    order = F.create_map(*(F.lit(x) for n, rule in enumerate(rules) for x in (rule.kind, n)))
    all_spans = F.flatten(F.array(*(F.coalesce(x, none) for x in each)))
    out = source.withColumn("__spans", all_spans)
    sorted_spans = F.when(F.size("__spans") > 1, F.transform(F.array_sort(F.transform("__spans", lambda s: F.struct(s.start.alias("start"), F.element_at(order, s.kind).alias("rank"), s.end.alias("end"), s.kind.alias("kind")))), lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), s.kind.alias("kind")))).otherwise(F.col("__spans"))
    return out.withColumn(out_col, sorted_spans).drop("__text", "__key", "__rules", "__spans")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """text with every span replaced by the mark; overlapping spans become one mark."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda a, s: F.when(s.start >= a.at, F.struct(s.end.alias("at"), F.concat(a.out, F.substring(text, a.at + 1, s.start - a.at), F.lit(mark)).alias("out"))).otherwise(F.struct(F.greatest(a.at, s.end).alias("at"), a.out.alias("out")))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))))).otherwise(text)
