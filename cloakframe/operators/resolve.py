"""Overlap resolution: sort all spans, then keep each that starts where the last kept one has ended, or later."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ConflictStrategy
from ..functions.patterns import NO_SPANS


def resolve(regex: Column, ml: Column | None, strategy: ConflictStrategy) -> Column:
    """Disjoint spans by start. Of spans with equal start regex ones come first under REGEX_PRIORITY, then longer ones,
    then those of earlier detectors; an earlier start always wins."""
    none = F.array().cast(NO_SPANS)
    keyed = lambda spans, is_ml: F.transform(F.coalesce(spans, none), lambda s, n: F.struct(s.start.alias("start"), F.lit(int(is_ml and strategy == ConflictStrategy.REGEX_PRIORITY)).alias("late"), (s.start - s.end).alias("longest"), F.lit(int(is_ml)).alias("source"), n.alias("n"), s.alias("span")))
    both = keyed(regex, False) if ml is None else F.concat(keyed(regex, False), keyed(ml, True))
    start = F.struct(F.lit(0).alias("end"), none.alias("kept"))
    swept = F.aggregate(
        F.array_sort(both), start,
        lambda a, x: F.when(x.span.start >= a.end, F.struct(x.span.end.alias("end"), F.array_append(a.kept, x.span).alias("kept"))).otherwise(a),
        lambda a: a.kept,
    )
    return F.when(F.size(both) > 0, swept).otherwise(none)


def tag_type(span: Column) -> Column:
    """What a span's tag is named after: the model's own label, else the type."""
    return F.when(span.getField("type") == "MODEL", span.getField("raw_type")).otherwise(span.getField("type"))
