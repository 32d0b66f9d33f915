"""Pseudonyms: tags per session and type, substitution, restoration, the cache and the tables that hold the state.

State is three tables with composite keys: tags (session, type, value, tag, pos), originals (session, tag, original) and
cache (session, text_hash, anonymized). Positions are (order, field, start): the order of messages in a session, of
fields in a message, of spans in a field.
"""

from __future__ import annotations

from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions.patterns import TAG
from ..functions.similarity import Resolution, similarity_index
from .resolve import tag_type


class Store(Protocol):
    """Where the state tables of sessions are kept: sources.chat.StateTables, or one's own."""

    def append(self, name: str, rows: DataFrame) -> None: ...

    def read(self, name: str, session: str | None = None) -> DataFrame: ...


#: Messages in a bucket of the two-step numbering.
ORDER_BUCKET = 65_536


def text_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def exploded(df: DataFrame, *, session: str, order: str, spans: str = "spans", field: Column | None = None) -> DataFrame:
    """(session, type, value, pos) for each span; type is the tag's.

    Exploded as outer: for a plain explode the optimizer pushes a test of the array's size below the projection that
    detects the spans, which then runs once more."""
    each = df.select(F.col(session).alias("session"), F.col(order).cast("long").alias("order"), (F.lit(0) if field is None else field).alias("field"), F.explode_outer(spans).alias("s"))
    return each.where(F.col("s").isNotNull()).select("session", tag_type(F.col("s")).alias("type"), F.col("s.value").alias("value"), F.struct(F.col("order"), F.col("field"), F.col("s.start").alias("start")).alias("pos"))


def first_seen(entities: DataFrame) -> DataFrame:
    """Each value once a session and type, at its first position; pre-aggregated before the shuffle."""
    return entities.groupBy("session", "type", "value").agg(F.min("pos").alias("pos"))


def numbered(values: DataFrame, bucket: int = ORDER_BUCKET) -> DataFrame:
    """n: 1, 2, ... by position in each session and type.

    In two steps, so that no task holds a large session: values are numbered inside buckets of messages, and each
    bucket starts after the sum of those before it."""
    dealt = values.withColumn("bucket", F.floor(F.col("pos.order") / bucket))
    sizes = dealt.groupBy("session", "type", "bucket").agg(F.count("*").alias("size"))
    before = sizes.withColumn("before", F.coalesce(F.sum("size").over(Window.partitionBy("session", "type").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("size")
    inside = dealt.withColumn("n", F.row_number().over(Window.partitionBy("session", "type", "bucket").orderBy("pos", "value")))
    null_safe = lambda a, b: a["session"].eqNullSafe(b["session"]) & (a["type"] == b["type"]) & a["bucket"].eqNullSafe(b["bucket"])
    a, b = inside.alias("a"), before.alias("b")
    joined = a.join(b, null_safe({c: F.col(f"a.{c}") for c in ("session", "type", "bucket")}, {c: F.col(f"b.{c}") for c in ("session", "type", "bucket")}))
    return joined.select("a.session", "a.type", "a.value", "a.pos", (F.col("a.n") + F.col("b.before")).alias("n"))


def tag(kind: Column, n: Column) -> Column:
    return F.concat(F.lit("<"), kind, F.lit("_"), n.cast("string"), F.lit(">"))


def tag_number(tag_col: Column) -> Column:
    return F.regexp_extract(tag_col, r"_(\d+)>$", 1).cast("long")


def new_values(entities: DataFrame, known: DataFrame) -> DataFrame:
    """first_seen of the entities whose value has no tag in its session yet."""
    return _matched(first_seen(entities), known.select("session", "type", "value").distinct(), ("session", "type", "value"), "left_anti")


def _matched(left: DataFrame, right: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Joined by keys of which the first, the session, may be null."""
    renamed = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"__{k}"))
    return left.join(renamed, on, how).drop(*(f"__{k}" for k in keys))


def assign_exact(entities: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """tags table (session, type, value, tag, pos): a tag for each different value, numbered as first seen.

    known (a tags table): the values that it has in their session get no row, and numbers go on behind its largest."""
    if known is None:
        return numbered(first_seen(entities)).select("session", "type", "value", tag(F.col("type"), F.col("n")).alias("tag"), "pos")
    last = known.groupBy("session", "type").agg(F.max(tag_number(F.col("tag"))).alias("last"))
    fresh = _matched(numbered(new_values(entities, known)), last, ("session", "type"), "left")
    return fresh.select("session", "type", "value", tag(F.col("type"), F.col("n") + F.coalesce("last", F.lit(0))).alias("tag"), "pos")


def assign(entities: DataFrame, resolution: Resolution, fuzzy_types: tuple[str, ...] | None, known: DataFrame | None = None) -> DataFrame:
    """As assign_exact, but values of the fuzzy types (None: all) may be aliases of earlier ones and share their tags.

    An alias counts as known from then on, so similarity chains; the work of a session and type is a fold over its
    different values in order, which go to one task. Other types are numbered without it."""
    fuzzy = F.lit(True) if fuzzy_types is None else F.col("type").isin(*fuzzy_types)
    flat = lambda df: df.select("session", "type", "value", "pos.order", "pos.field", "pos.start")

    def fold(values: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        order = ["order", "field", "start", "value"]
        values, earlier = values.sort_values(order, kind="stable"), earlier.sort_values(order, kind="stable")
        tags, index = dict(zip(earlier["value"], earlier["tag"], strict=True)), similarity_index(resolution)
        for value in tags:
            index.add(value)
        made, n = [], max((int(t.rsplit("_", 1)[1][:-1]) for t in tags.values()), default=0)
        for kind, value in zip(values["type"], values["value"], strict=True):
            other = value if value in tags else index.find(kind, value)
            if other is None:
                n += 1
                tags[value] = f"<{kind}_{n}>"
            else:
                tags[value] = tags[other]
            index.add(value)
            made.append(tags[value])
        return values.assign(tag=made)

    source = entities.where(fuzzy)
    values = flat(first_seen(source) if known is None else new_values(source, known))
    schema = StructType([*values.schema.fields, StructField("tag", StringType())])
    if known is None:
        none = pd.DataFrame({"value": [], "tag": [], "order": [], "field": [], "start": []})
        folded = values.groupBy("session", "type").applyInPandas(lambda v: fold(v, none), schema)
    else:
        earlier = known.where(fuzzy).select("session", "type", "value", "tag", "pos.order", "pos.field", "pos.start")
        folded = values.groupBy("session", "type").cogroup(earlier.groupBy("session", "type")).applyInPandas(fold, schema)
    folded = folded.select("session", "type", "value", "tag", F.struct("order", "field", "start").alias("pos"))
    return folded.unionByName(assign_exact(entities.where(~fuzzy), known))


def originals(tags: DataFrame) -> DataFrame:
    """(session, tag, original): the first-seen value of each tag."""
    return tags.groupBy("session", "tag").agg(F.min_by("value", "pos").alias("original"))


def substituted(text: Column, spans: Column) -> Column:
    """text with each span (struct<start, end, tag>, disjoint, by start) replaced by its tag."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    return F.aggregate(
        spans, start,
        lambda a, s: F.struct(s.end.alias("at"), F.concat(a.out, F.substring(text, a.at + 1, s.start - a.at), s.tag).alias("out")),
        lambda a: F.concat(a.out, F.substring(text, a.at + 1, F.length(text))),
    )


def substitute(df: DataFrame, tags: DataFrame, *, id_col: str, session: str, text: str = "text", spans: str = "spans", out: str = "anonymized") -> DataFrame:
    """df with out: its text, spans replaced by the tags of their session. id_col is unique in df."""
    hits = df.select(F.col(id_col).alias("__id"), F.col(session).alias("__session"), F.explode_outer(spans).alias("s"))
    return substitute_hits(df, hits.where(F.col("s").isNotNull()), tags, id_col=id_col, text=text, out=out)


def substitute_hits(df: DataFrame, hits: DataFrame, tags: DataFrame, *, id_col: str, text: str = "text", out: str = "anonymized") -> DataFrame:
    """The same with the spans given as rows (__id, __session, s): df is read for its text alone."""
    hits = hits.withColumn("__type", tag_type(F.col("s")))
    t = tags.select(F.col("session").alias("t_session"), F.col("type").alias("t_type"), F.col("value").alias("t_value"), "tag")
    tagged = hits.join(t, F.col("__session").eqNullSafe(F.col("t_session")) & (F.col("__type") == F.col("t_type")) & (F.col("s.value") == F.col("t_value")))
    by_row = tagged.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct(F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("tag")))).alias("__tagged"))
    return df.join(by_row, F.col(id_col) == F.col("__id"), "left").withColumn(out, F.when(F.col("__tagged").isNotNull(), substituted(F.col(text), F.col("__tagged"))).otherwise(F.col(text))).drop("__id", "__tagged")


def restored(text: Column, known: Column) -> Column:
    """text with each tag that the map knows replaced by its original; others stay as they are."""
    found, gaps = F.regexp_extract_all(text, F.lit(TAG), F.lit(0)), F.split(text, TAG, -1)
    pieces = F.zip_with(gaps, found, lambda g, m: F.concat(g, F.coalesce(F.try_element_at(known, m), m, F.lit(""))))
    return F.array_join(pieces, "")


def tag_maps(df: DataFrame, originals_table: DataFrame, *, id_col: str, session: str, text: str) -> DataFrame:
    """(id_col, known): for each row with tags known in its session, the map of these tags to their originals."""
    used = df.select(F.col(id_col), F.col(session).alias("__session"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(TAG), F.lit(0)))).alias("__tag"))
    o = originals_table.select(F.col("session").alias("o_session"), F.col("tag").alias("o_tag"), "original")
    return used.join(o, F.col("__session").eqNullSafe(F.col("o_session")) & (F.col("__tag") == F.col("o_tag"))).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("__tag", "original"))).alias("known"))


def restore(df: DataFrame, originals_table: DataFrame, *, id_col: str, session: str, text: str, out: str = "restored") -> DataFrame:
    """df with out: its text, the tags known in its session replaced by their originals."""
    maps = tag_maps(df, originals_table, id_col=id_col, session=session, text=text).select(F.col(id_col).alias("__id"), F.col("known").alias("__known"))
    return df.join(maps, F.col(id_col) == F.col("__id"), "left").withColumn(out, F.when(F.col("__known").isNotNull(), restored(F.col(text), F.col("__known"))).otherwise(F.col(text))).drop("__id", "__known")


def known_values(tags: DataFrame) -> DataFrame:
    """The type index: (session, type, value) of every known surface form, aliases among them."""
    return tags.select("session", "type", "value").distinct()


def lookup_tags(entities: DataFrame, tags: DataFrame) -> DataFrame:
    """entities with the tag that each value already has, or null."""
    return entities.join(tags.select("session", "type", "value", "tag"), ["session", "type", "value"], "left")


def cache_entries(df: DataFrame, *, session: str, text: str, anonymized: str) -> DataFrame:
    """(session, text_hash, anonymized): once for each different text of a session; write-back passes restored texts."""
    return df.select(F.col(session).alias("session"), text_hash(F.col(text)).alias("text_hash"), F.col(anonymized).alias("anonymized")).groupBy("session", "text_hash").agg(F.min("anonymized").alias("anonymized"))


def cache_lookup(df: DataFrame, cache: DataFrame, *, session: str, text: str) -> DataFrame:
    """df with anonymized from the cache, null where there is none."""
    keyed = df.withColumn("text_hash", text_hash(F.col(text)))
    return keyed.join(cache.withColumnRenamed("session", "c_session"), (keyed[session].eqNullSafe(F.col("c_session"))) & (keyed["text_hash"] == cache["text_hash"]), "left").drop("c_session", cache["text_hash"])


def clear_session(state: DataFrame, sessions: DataFrame) -> DataFrame:
    """A state table without the rows of the sessions: whole keys are compared, never prefixes."""
    return _matched(state, sessions.select("session").distinct(), ("session",), "left_anti")
