"""Whole plans: detect, resolve, assign, substitute; and back; with or without the stored state of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..functions.patterns import is_blank
from ..functions.similarity import resolution
from ..operators import detect, pseudonyms
from ..operators.pseudonyms import Store
from ..operators.resolve import resolve, tag_type
from ..storage import written


def detected(df: DataFrame, config: Config, *, text: str = "text", ml: Column | None = None, out: str = "spans") -> DataFrame:
    """df with out: disjoint spans of the configured detectors and of the model's spans, if there are any."""
    return df.withColumn("__regex", detect.chain(F.col(text), config.filters)).withColumn(out, resolve(F.col("__regex"), ml, config.conflict_strategy)).drop("__regex")


def assigned(entities: DataFrame, config: Config, known: DataFrame | None = None) -> DataFrame:
    """The tags of the entities' values; with known tags, of those that have none yet."""
    if not config.resolution_enabled or config.resolution in ("", "exact") or config.fuzzy_types == ():
        return pseudonyms.assign_exact(entities, known)
    return pseudonyms.assign(entities, resolution(config.resolution, config.threshold), config.fuzzy_types, known)


def hits(df: DataFrame, config: Config, *, id_col: str, session: str, order: str, text: str = "text", ml: Column | None = None) -> DataFrame:
    """(__id, __session, __order, s) of every span, written once: tags and substitution both read it, no text is detected
    twice, and only texts that have spans have rows."""
    each = detected(df, config, text=text, ml=ml).select(F.col(id_col).alias("__id"), F.col(session).alias("__session"), F.col(order).cast("long").alias("__order"), F.explode_outer("spans").alias("s"))
    return written(each.where(F.col("s").isNotNull()), "spans")


def _entities(found: DataFrame) -> DataFrame:
    pos = F.struct(F.col("__order").alias("order"), F.lit(0).alias("field"), F.col("s.start").alias("start"))
    return found.select(F.col("__session").alias("session"), tag_type(F.col("s")).alias("type"), F.col("s.value").alias("value"), pos.alias("pos"))


def anonymize(df: DataFrame, config: Config, *, id_col: str, session: str, order: str | None = None, text: str = "text", ml: Column | None = None, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(df with anonymized, the tags table). id_col is unique; order (id_col) gives the order in a session.

    known: the tags that sessions have from earlier batches. Values that have one keep it, numbers go on behind them, and
    the tags table returned holds both."""
    found = hits(df, config, id_col=id_col, session=session, order=order or id_col, text=text, ml=ml)
    tags = assigned(_entities(found), config, known)
    if known is not None:
        tags = known.unionByName(written(tags, "tags"))
    return pseudonyms.substitute_hits(df, found, tags, id_col=id_col, text=text), tags


def restore(df: DataFrame, tags: DataFrame, *, id_col: str, session: str, text: str = "anonymized", out: str = "restored") -> DataFrame:
    return pseudonyms.restore(df, pseudonyms.originals(tags), id_col=id_col, session=session, text=text, out=out)


def anonymize_cached(df: DataFrame, config: Config, state: Store, *, id_col: str, session: str, order: str | None = None, text: str = "text", ml: Column | None = None) -> DataFrame:
    """df with anonymized, by way of the stored state: texts that the cache has in their session are taken from it; of the
    others each different text of a session is detected once, at its first place. New tags, originals and cache entries
    are appended. Blank texts pass unread. Where a model failed (ml is null) the text is anonymized without it, not cached."""
    order = order or id_col
    cache, known = state.read("cache"), state.read("tags")
    failed = F.lit(False) if ml is None else ml.isNull()
    keyed = df.withColumns({"__hash": pseudonyms.text_hash(F.col(text)), "__failed": failed})
    blank = is_blank(F.col(text))
    lookup = cache.select(F.col("session").alias("__c"), F.col("text_hash").alias("__h"), F.col("anonymized").alias("__cached"))
    looked_up = keyed.join(lookup, F.col(session).eqNullSafe(F.col("__c")) & (F.col("__hash") == F.col("__h")), "left").drop("__c", "__h")
    misses = looked_up.where(F.col("__cached").isNull() & ~blank)
    # the first row of each different text of a session; ids alone are shuffled
    first = misses.groupBy(F.col(session).alias("__session"), "__hash", "__failed").agg(F.min(F.struct(F.col(order).alias("o"), F.col(id_col).alias("i"))).getField("i").alias("__first"))
    first = written(first, "misses")
    todo = keyed.join(first.select(F.col("__first").alias(id_col)), id_col, "left_semi")
    done, tags = anonymize(todo, config, id_col=id_col, session=session, order=order, text=text, ml=ml, known=known)
    done = done.select(F.col(session).alias("session"), F.col("__hash").alias("text_hash"), F.col("__failed").alias("failed"), "anonymized")
    done = written(done, "anonymized")
    fresh = written(tags.join(known.select("session", "type", "value").withColumnsRenamed({"session": "k_s", "type": "k_t", "value": "k_v"}), F.col("session").eqNullSafe(F.col("k_s")) & (F.col("type") == F.col("k_t")) & (F.col("value") == F.col("k_v")), "left_anti"), "tags")
    # an alias shares the tag of an earlier value: only tags that the session has not had name an original
    had = state.read("originals").select(F.col("session").alias("h_s"), F.col("tag").alias("h_t"))
    news = written(pseudonyms.originals(fresh).join(had, F.col("session").eqNullSafe(F.col("h_s")) & (F.col("tag") == F.col("h_t")), "left_anti"), "originals")
    state.append("tags", fresh)
    state.append("originals", news)
    state.append("cache", done.where("not failed"))
    found = done.select(F.col("session").alias("__s"), F.col("text_hash").alias("__h"), F.col("failed").alias("__f"), F.col("anonymized").alias("__done"))
    joined = looked_up.join(found, F.col(session).eqNullSafe(F.col("__s")) & (F.col("__hash") == F.col("__h")) & (F.col("__failed") == F.col("__f")), "left")
    return joined.withColumn("anonymized", F.coalesce("__cached", "__done", F.col(text))).drop("__hash", "__failed", "__cached", "__s", "__h", "__f", "__done")


def restore_cached(df: DataFrame, state: Store, *, id_col: str, session: str, text: str = "anonymized", out: str = "restored") -> DataFrame:
    """df with out, restored by the stored originals; what is restored goes to the cache with what it came from, so that
    a later request that quotes it needs no detection."""
    back = written(pseudonyms.restore(df, state.read("originals"), id_col=id_col, session=session, text=text, out=out), "restored")
    cache_restored(back, state, session=session, restored=out, anonymized=text)
    return back


def cache_restored(back: DataFrame, state: Store, *, session: str, restored: str, anonymized: str) -> None:
    """Appends cache entries of restored texts and what they came from; those that the cache has stay as they are."""
    entries = pseudonyms.cache_entries(back.where(~is_blank(F.col(restored))), session=session, text=restored, anonymized=anonymized)
    had = state.read("cache").select(F.col("session").alias("h_s"), F.col("text_hash").alias("h_h"))
    state.append("cache", written(entries.join(had, F.col("session").eqNullSafe(F.col("h_s")) & (F.col("text_hash") == F.col("h_h")), "left_anti"), "entries"))
