"""Operational metrics: nearest-rank percentiles, hit ratios, breakdowns of logs; workloads and load results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The log lines' patterns. A hit's line prints regex=0 without a unit.
PIPELINE = r"Pipeline: total=(\d+)ms, cache=(\d+)ms, regex=(\d+)(?:ms)?(?:, ml=(\d+)(?:ms)?)?(?:, subst=(\d+)(?:ms)?)?"
RESTORE = r"Restored \d+ tags in '(\S+)' for session (\S+) in (\d+)µs"
BATCH = r"ML Batch done: size=(\d+), reason=(\w+), pendingAfterFlush=(\d+)"
INFERENCE = r"ML Inference: batchSize=(\d+), (\d+)ms \((\d+)ms/text\)"
GC_DECORATIONS = r"\[([^\]]+)\]\[([^\]]+)\]\[([^\]]+)\]\[gc\]"
GC_PAUSE = r"GC\(\d+\)\s+Pause\s+(\w+)"
GC_HEAP = r"(\d+)([KMG])->(\d+)([KMG])\((\d+)([KMG])\)\s+([\d.]+)ms"


def percentiles(df: DataFrame, value: str, ps: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """by, p50, p95, ...: sorted[min(floor(n * p / 100), n - 1)]; without groups one row, 0 where nothing is.

    Values are counted first, so the sort is over different values, and running counts find the ranks: in one step
    inside ranges of values, in a second over the ranges' sums. No group is ever collected."""
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count("*").alias("c"))
    edges = counts.select(F.percentile_approx("v", [i / 64 for i in range(1, 64)]).alias("edges"))
    # ranges of values, cut at approximate quantiles of all: only how evenly work is dealt rests on them
    cut = counts.crossJoin(F.broadcast(edges)).withColumn("range", F.size(F.filter(F.coalesce("edges", F.array().cast("array<double>")), lambda e: e < F.col("v")))).drop("edges")
    sums = cut.groupBy(*keys, "range").agg(F.sum("c").alias("s"))
    total = sums.withColumns({"before": F.coalesce(F.sum("s").over(Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "n": F.sum("s").over(Window.partitionBy(*keys))}).drop("s")
    upto = F.sum("c").over(Window.partitionBy(*keys, "range").orderBy("v"))
    same = lambda a, b: reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "range"]))
    ranked = cut.withColumn("upto", upto).alias("a").join(total.alias("b"), same("a", "b")).select(*(F.col(f"a.{k}") for k in keys), "a.v", (F.col("a.upto") + F.col("b.before")).alias("upto"), "b.n")
    at = lambda p: F.least(F.floor(F.col("n") * p / 100), F.col("n") - 1)
    aggregates = [F.min(F.when(F.col("upto") > at(p), F.col("v"))).alias(f"p{p:g}") for p in ps]
    if keys:
        return ranked.groupBy(*keys).agg(*aggregates)
    return ranked.agg(*aggregates).select(*(F.coalesce(f"p{p:g}", F.lit(0)).alias(f"p{p:g}") for p in ps))


def hit_ratio(df: DataFrame, hit: Column) -> DataFrame:
    """total, hits, misses and hit_rate in percent, 0 where nothing is."""
    n = df.agg(F.count("*").alias("total"), F.coalesce(F.sum(hit.cast("long")), F.lit(0)).alias("hits"))
    return n.select("total", "hits", (F.col("total") - F.col("hits")).alias("misses"), F.when(F.col("total") > 0, F.col("hits") * 100.0 / F.col("total")).otherwise(0.0).alias("hit_rate"))


def _fields(lines: DataFrame, pattern: str, names: tuple[str, ...], numbers: tuple[str, ...], value: str = "value") -> DataFrame:
    got = lines.where(F.rlike(value, F.lit(pattern)))
    text = lambda n: F.regexp_extract(value, pattern, n)
    number = lambda n, kind: F.nullif(text(n), F.lit("")).cast(kind)
    of = lambda n, name: (number(n, "double" if name == "duration_ms" else "long") if name in numbers else text(n)).alias(name)
    return got.select("*", *(of(n, name) for n, name in enumerate(names, 1)))


def pipeline_lines(lines: DataFrame) -> DataFrame:
    names = ("total_ms", "cache_ms", "regex_ms", "ml_ms", "subst_ms")
    return _fields(lines, PIPELINE, names, names).withColumn("hit", F.contains("value", F.lit("(hit)")))


def restore_lines(lines: DataFrame) -> DataFrame:
    return _fields(lines, RESTORE, ("context", "session", "latency_us"), ("latency_us",))


def batch_lines(lines: DataFrame) -> DataFrame:
    return _fields(lines, BATCH, ("size", "reason", "pending"), ("size", "pending"))


def inference_lines(lines: DataFrame) -> DataFrame:
    names = ("batch_size", "time_ms", "per_text_ms")
    return _fields(lines, INFERENCE, names, names)


def gc_lines(lines: DataFrame) -> DataFrame:
    """Pauses of a JVM's unified log; heap sizes in whole megabytes, whichever unit the line has."""
    sizes = ("before", "after", "total")
    got = _fields(_fields(lines, GC_DECORATIONS, ("time", "uptime", "level"), ()), GC_PAUSE, ("type",), ())
    got = _fields(got, GC_HEAP, (*(n for s in sizes for n in (s, f"{s}_unit")), "duration_ms"), (*sizes, "duration_ms"))
    in_mb = lambda s: F.when(F.col(f"{s}_unit") == "K", F.shiftright(s, 10)).when(F.col(f"{s}_unit") == "G", F.shiftleft(s, 10)).otherwise(F.col(s))
    return got.withColumns({f"{s}_mb": in_mb(s) for s in sizes}).drop(*sizes, *(f"{s}_unit" for s in sizes))


def breakdown(pipeline: DataFrame) -> DataFrame:
    """Average milliseconds of each part and its percentage of the total; what no part accounts for is the model's."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    a = pipeline.agg(zero(F.avg("total_ms")).alias("total"), zero(F.avg("cache_ms")).alias("cache"), zero(F.avg("regex_ms")).alias("regex"), zero(F.avg(F.when(~F.col("hit"), F.col("subst_ms")))).alias("subst"))
    a = a.withColumn("ml", F.greatest(F.lit(0.0), F.col("total") - F.col("cache") - F.col("regex") - F.col("subst")))
    parts = ("cache", "regex", "ml", "subst", "total")
    return a.select(*(F.col(p).alias(f"avg_{p}") for p in parts), *(F.when(F.col("total") > 0, F.col(p) * 100 / F.col("total")).otherwise(0.0).alias(f"pct_{p}") for p in parts[:-1]))


def reason_counts(batches: DataFrame, reason: str = "reason") -> DataFrame:
    return batches.groupBy(reason).agg(F.count("*").alias("n"))


def gc_summary(pauses: DataFrame, order: str) -> DataFrame:
    """n, total_ms, max_ms, percentiles and the last heap of the pauses."""
    own = pauses.agg(F.count("*").alias("n"), F.sum("duration_ms").alias("total_ms"), F.max("duration_ms").alias("max_ms"), F.max_by(F.struct("after_mb", "total_mb"), order).alias("heap"))
    return own.crossJoin(percentiles(pauses, "duration_ms", (50, 95, 99))).select("n", "total_ms", "max_ms", "p50", "p95", "p99", "heap.after_mb", "heap.total_mb")


def gc_counts(pauses: DataFrame) -> DataFrame:
    """type and n of the pauses, the most frequent first."""
    return pauses.groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def load_metrics(results: DataFrame, *, latency: str = "latency_ms", status: str = "status", by: tuple[str, ...] = ()) -> DataFrame:
    """by, n, error_rate, p95, p99 and whether they keep the limits: p95 < 2000 ms, p99 < 5000 ms, errors < 1 %."""
    n = results.groupBy(*by).agg(F.count("*").alias("n"), F.avg((F.col(status) != 200).cast("double")).alias("error_rate"))
    p = percentiles(results, latency, (95, 99), by)
    both = n.join(p, list(by)) if by else n.crossJoin(p)
    return both.withColumn("within", (F.col("p95") < 2000) & (F.col("p99") < 5000) & (F.col("error_rate") < 0.01))


def live_sessions(sessions: DataFrame, now: Column, *, ttl_seconds: int = 300, most: int = 10_000) -> DataFrame:
    """Sessions (session, last_access) that are not over their time, at most `most` of them: the last used."""
    fresh = sessions.where(F.unix_timestamp(now) - F.unix_timestamp("last_access") <= ttl_seconds)
    return fresh.orderBy(F.desc("last_access"), "session").limit(most)


def workload(conversations: DataFrame, pool: DataFrame, templates: DataFrame, *, turns: int = 15, pii_share: float = 0.6, seed: int = 42) -> DataFrame:
    """(conversation, turn, role, content) for ids in `conversation`: 3 to 7 entity types each, a value of each type, a
    template for each turn, pii_share of them with an entity. pool (type, values); templates (type: null for free, text).

    Both tables are configuration; choices are seeded hashes of the conversation and what is chosen."""
    roll = lambda *cols: F.xxhash64(F.lit(seed), *cols)
    values = F.broadcast(pool.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("type", "values"))).alias("pool")))
    by_type = templates.groupBy(F.coalesce("type", F.lit("")).alias("k")).agg(F.array_sort(F.collect_list("text")).alias("texts"))
    texts = F.broadcast(by_type.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("k", "texts"))).alias("templates")))
    c = conversations.select("conversation").crossJoin(values).crossJoin(texts)
    c = c.withColumn("types", F.slice(F.transform(F.array_sort(F.transform(F.map_keys("pool"), lambda t: F.struct(roll(F.col("conversation"), t).alias("h"), t.alias("t")))), lambda x: x.t), 1, (F.pmod(roll("conversation"), F.lit(5)) + 3).cast("int")))
    c = c.withColumn("entities", F.map_from_arrays("types", F.transform("types", lambda t: F.element_at(F.element_at("pool", t), (F.pmod(roll(F.col("conversation"), t, F.lit("v")), F.size(F.element_at("pool", t))) + 1).cast("int")))))
    t = c.select("*", F.explode(F.sequence(F.lit(0), F.lit(turns - 1))).alias("turn"))
    pii = (F.col("turn") == 0) | (F.pmod(roll("conversation", "turn", F.lit("p")), F.lit(1000)) < int(1000 * pii_share))
    kind = F.when(pii, F.element_at("types", (F.pmod(roll("conversation", "turn"), F.size("types")) + 1).cast("int"))).otherwise(F.lit(""))
    t = t.withColumn("kind", kind).withColumn("options", F.coalesce(F.try_element_at("templates", F.col("kind")), F.try_element_at("templates", F.lit("")), F.array(F.lit(""))))
    chosen = F.element_at("options", (F.pmod(roll("conversation", "turn", F.lit("t")), F.size("options")) + 1).cast("int"))
    filled = F.aggregate(F.map_entries("entities"), chosen, lambda a, e: F.replace(a, F.concat(F.lit("{"), e.key, F.lit("}")), e.value))
    return t.select("conversation", "turn", F.lit("user").alias("role"), filled.alias("content"))
