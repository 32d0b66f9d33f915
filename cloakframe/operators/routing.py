"""Requests: which provider, which session, which path; what of their headers goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Provider
from ..functions.patterns import is_blank

#: Headers that are never passed on.
REQUEST_HEADERS_DROPPED = ("host", "content-length", "accept-encoding")
RESPONSE_HEADERS_DROPPED = ("transfer-encoding", "content-length", "accept-encoding")


def providers_table(spark: SparkSession, providers: tuple[Provider, ...]) -> DataFrame:
    return spark.createDataFrame([(p.id, p.host, p.port, p.codec) for p in providers], "id string, host string, port int, codec string")


def with_provider(requests: DataFrame, providers: DataFrame, *, name: str = "provider") -> DataFrame:
    """requests with host, port, codec and tls of their provider, found in any case; status 400 where there is none.

    providers is a configuration table, a handful of rows by nature."""
    known = F.broadcast(providers.select(F.lower("id").alias("__provider"), "host", "port", "codec").dropDuplicates(["__provider"]))
    joined = requests.join(known, F.lower(F.col(name)) == F.col("__provider"), "left")
    return joined.withColumns({"tls": F.col("port") == 443, "status": F.when(F.col("__provider").isNull(), 400), "error": F.when(F.col("__provider").isNull(), F.concat(F.lit("unknown provider: "), F.coalesce(F.col(name), F.lit(""))))}).drop("__provider")


def session_id(header: Column, user: Column, request_id: Column) -> Column:
    """struct<session, ephemeral>: the header, else the body's user, else one of the request's own; blanks don't count.

    The last is a digest of the request's id, so that a task that runs again gives it again."""
    given = lambda c: F.when(~is_blank(c), c)
    found = F.coalesce(given(header), given(user))
    return F.struct(F.coalesce(found, F.sha2(F.concat(F.lit("ephemeral:"), request_id.cast("string")), 256)).alias("session"), found.isNull().alias("ephemeral"))


def target_path(path: Column, provider: Column) -> Column:
    """The path without /provider before it."""
    return F.substring(path, F.length(provider) + 2, F.length(path))


def is_stream(flag: Column) -> Column:
    return F.coalesce(flag, F.lit(False))


def passed_headers(headers: Column, dropped: tuple[str, ...] = REQUEST_HEADERS_DROPPED) -> Column:
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*dropped))
