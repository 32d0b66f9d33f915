"""A query for each operator over the driver's tables, and DuckDB SQL for those that SQL can express.

Sessions are documents' sources, ordered by doc_id. No table holds labelled tokens or logs: where an operator needs them
they are derived from the tables by rules that the SQL repeats.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config, ConflictStrategy, Provider
from ..functions import patterns as P
from ..functions.similarity import JaroWinkler, jaro_winkler
from ..operators import analytics, codec, detect, ner, pseudonyms, routing
from ..operators.resolve import resolve
from ..sources import chat
from ..storage import new_folder
from ..streaming import restore as streams
from . import pipeline

EXACT = Config(resolution="exact")


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# Spans --------------------------------------------------------------------------------------------------------------


def _span_query(detector: detect.Detector, table: str = "documents", key: str = "doc_id", text: str = "text"):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _t(spark, sf_dir, table).select(key, F.explode_outer(detector(F.col(text))).alias("s")).where("s is not null").select(key, "s.start", F.col("s.end").alias("stop"), "s.type", "s.value")

    return run


_LUHN = "list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN (length({d}) - i) % 2 = 0 THEN CAST({d}[i] AS INT) WHEN CAST({d}[i] AS INT) > 4 THEN 2 * CAST({d}[i] AS INT) - 9 ELSE 2 * CAST({d}[i] AS INT) END)) % 10 = 0"


def _spans_sql(pattern: str, kind: str, where: str = "true", table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    """(key, start, stop, type, value) of a pattern's trimmed matches."""
    return f"""SELECT {key}, CAST(s AS INTEGER) AS start, CAST(s + length(value) AS INTEGER) AS stop, '{kind}' AS type, value FROM (
  SELECT {key}, s + length(regexp_extract(v, '^[\\t\\n\\f\\r ]+')) AS s, regexp_replace(regexp_replace(v, '^[\\t\\n\\f\\r ]+', ''), '[\\t\\n\\f\\r ]+$', '') AS value FROM (
    SELECT {key}, m[i] AS v, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM (
      SELECT {key}, m, g, unnest(range(1, len(m) + 1)) AS i FROM (
        SELECT {key}, regexp_extract_all({text}, {_q(pattern)}) AS m, string_split_regex({text}, {_q(pattern)}) AS g FROM {table}))))
WHERE length(value) > 0 AND {where}"""


_DIGITS = "regexp_replace(value, '[\\s-]', '', 'g')"
_IS_CARD = f"length({_DIGITS}) BETWEEN 13 AND 19 AND " + _LUHN.format(d=_DIGITS)
_EMAIL, _PHONE = _spans_sql(P.EMAIL, "EMAIL"), _spans_sql(P.PHONE, "PHONE")
_CARDS, _CARD, _IP = _spans_sql(P.CREDIT_CARD, "CREDIT_CARD"), _spans_sql(P.CREDIT_CARD, "CREDIT_CARD", _IS_CARD), _spans_sql(P.IP_ADDRESS, "IP_ADDRESS")
_ALL = f"SELECT *, 1 AS ord FROM ({_EMAIL}) UNION ALL SELECT *, 2 FROM ({_PHONE}) UNION ALL SELECT *, 3 FROM ({_CARD}) UNION ALL SELECT *, 4 FROM ({_IP})"


def all_regex_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _span_query(lambda t: detect.chain(t, EXACT.filters))(spark, sf_dir)


def pii_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = all_regex_spans(spark, sf_dir)
    return found.groupBy("type").agg(F.count("*").alias("n_spans"), F.countDistinct("doc_id").alias("n_docs"), F.countDistinct("value").alias("n_values"))


# Resolution ---------------------------------------------------------------------------------------------------------

# In place of a model: capitalised words of 6 letters or more that follow a blank, and runs of 4 digits with what stands around them.
_MODEL = r"[A-Z][a-z]{5,}|[0-9+(]?[0-9]{4}[0-9 .-]*"


def _model_spans(text: Column) -> Column:
    return F.transform(P.matches(F.coalesce(text, F.lit("")), _MODEL), lambda m: F.struct(m.start.alias("start"), m.end.alias("end"), F.lit("MODEL").alias("type"), F.lit("ENTITY").alias("raw_type"), m.value.alias("value")))


def _resolved(strategy: ConflictStrategy):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = F.col("text")
        found = _t(spark, sf_dir, "documents").select("doc_id", F.explode_outer(resolve(detect.chain(t, EXACT.filters), _model_spans(t), strategy)).alias("s")).where("s is not null")
        return found.select("doc_id", "s.start", F.col("s.end").alias("stop"), "s.type", "s.value")

    return run


def _resolve_sql(late: str, model: bool = True) -> str:
    own = ""
    if model:  # a model's spans are not trimmed
        raw = f"""SELECT doc_id, CAST(s AS INTEGER) AS start, CAST(s + length(v) AS INTEGER) AS stop, 'MODEL' AS type, v AS value, 9 AS ord FROM (
    SELECT doc_id, m[i] AS v, length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS s FROM (
      SELECT doc_id, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(text, {_q(_MODEL)}) AS m, string_split_regex(text, {_q(_MODEL)}) AS g FROM documents)))"""
        own = f" UNION ALL {raw}"
    return f"""RECURSIVE sp AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, {late}, stop DESC, ord) AS rn FROM ({_ALL}{own})),
keep AS (SELECT doc_id, CAST(1 AS BIGINT) AS rn, stop AS done FROM sp WHERE rn = 1
  UNION ALL SELECT s.doc_id, s.rn, s.stop FROM (SELECT k.doc_id, min(s.rn) AS nxt FROM keep k JOIN sp s ON s.doc_id = k.doc_id AND s.rn > k.rn AND s.start >= k.done GROUP BY k.doc_id) n JOIN sp s ON s.doc_id = n.doc_id AND s.rn = n.nxt),
kept AS (SELECT sp.* FROM sp JOIN keep USING (doc_id, rn))"""


_KEPT = _resolve_sql("0", False)  # of the detectors alone
_RESOLVED = "SELECT doc_id, start, stop, type, value FROM kept"

# Pseudonyms ---------------------------------------------------------------------------------------------------------

_TAGS_SQL = f"""WITH {_KEPT},
firsts AS (SELECT source AS session, type, value, min((doc_id, start)) AS pos FROM kept JOIN documents USING (doc_id) GROUP BY ALL),
tags AS (SELECT session, type, value, '<' || type || '_' || row_number() OVER (PARTITION BY session, type ORDER BY pos) || '>' AS tag FROM firsts)"""
_TAGS2_SQL = _TAGS_SQL.replace("min((doc_id, start))", "min((doc_id % 2, doc_id, start))")  # the even documents came first
_ANON_SQL = f"""{_TAGS_SQL},
t AS (SELECT k.doc_id, k.start, k.stop, tag, lag(k.stop, 1, 0) OVER (PARTITION BY k.doc_id ORDER BY k.start) AS before, max(k.stop) OVER (PARTITION BY k.doc_id) AS final
  FROM kept k JOIN documents d USING (doc_id) JOIN tags ON tags.session = d.source AND tags.type = k.type AND tags.value = k.value),
a AS (SELECT doc_id, string_agg(substring(text, before + 1, start - before) || tag, '' ORDER BY start) || substring(any_value(text), CAST(any_value(final) + 1 AS BIGINT)) AS anonymized FROM t JOIN documents USING (doc_id) GROUP BY doc_id),
anon AS (SELECT d.doc_id, d.source, d.text, coalesce(a.anonymized, d.text) AS anonymized FROM documents d LEFT JOIN a USING (doc_id))"""


_ANON2_SQL = _ANON_SQL.replace(_TAGS_SQL, _TAGS2_SQL)


def _anonymized(spark: SparkSession, sf_dir: str, config: Config = EXACT) -> tuple[DataFrame, DataFrame]:
    return pipeline.anonymize(_t(spark, sf_dir, "documents").select("doc_id", "source", "text"), config, id_col="doc_id", session="source")


def assign_tags_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir)[1].select("session", "type", "value", "tag")


def anonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir)[0].select("doc_id", "anonymized")


def restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, tags = _anonymized(spark, sf_dir)
    return pipeline.restore(done.select("doc_id", "source", "anonymized"), tags, id_col="doc_id", session="source").select("doc_id", "restored")


def roundtrip_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    done, tags = _anonymized(spark, sf_dir)
    back = pipeline.restore(done.select("doc_id", "source", "text", "anonymized"), tags, id_col="doc_id", session="source")
    return back.groupBy("source").agg(F.count("*").alias("n"), F.sum((F.col("text") == F.col("restored")).cast("long")).alias("n_equal"), F.sum((F.col("text") != F.col("anonymized")).cast("long")).alias("n_changed"))


def _two_batches(spark: SparkSession, sf_dir: str) -> tuple[chat.StateTables, DataFrame]:
    """State tables that the even documents were anonymized into, and all documents anonymized by way of them."""
    state = chat.StateTables(spark, new_folder(spark, "state"), parts=4)
    docs = _t(spark, sf_dir, "documents").select("doc_id", "source", "text")
    one = lambda df: pipeline.anonymize_cached(df, EXACT, state, id_col="doc_id", session="source")
    one(docs.where("doc_id % 2 = 0"))
    return state, one(docs)


def assign_tags_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tags of two batches of a session, the even documents and then all: numbers go on."""
    return _two_batches(spark, sf_dir)[0].read("tags").select("session", "type", "value", "tag")


def anonymize_cached(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two_batches(spark, sf_dir)[1].select("doc_id", "anonymized")


def state_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored originals of two batches without the sessions src1 and src2; src10 to src19 stay."""
    state, _ = _two_batches(spark, sf_dir)
    state.clear(spark.createDataFrame([("src1",), ("src2",)], "session string"))
    return state.read("originals")


def sse_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymized documents streamed in frames of 40 characters, a comment between them and [DONE] at the end, restored."""
    done, tags = _anonymized(spark, sf_dir)
    pieces = done.select("source", "doc_id", F.posexplode(F.regexp_extract_all("anonymized", F.lit(r"(?s).{1,40}"), F.lit(0))).alias("seq", "piece"))
    ids = [F.col("source").alias("session"), F.col("doc_id").cast("string").alias("stream")]
    frames = pieces.select(*ids, (F.col("seq") * 2).cast("long").alias("seq"), codec.data_frame(F.col("piece")).alias("frame"))
    frames = frames.unionByName(pieces.select(*ids, (F.col("seq") * 2 + 1).cast("long").alias("seq"), F.when(F.col("seq") % 2 == 0, ": ping").otherwise("data: {broken").alias("frame")))
    frames = frames.unionByName(done.select(*ids, F.lit(2**40).alias("seq"), F.lit("data: [DONE]").alias("frame")))
    back = streams.restore_frames(frames, pseudonyms.originals(tags))
    others = back.where("kind <> 'data'").groupBy("session", "stream").agg(F.count_if(F.col("frame") == "data: [DONE]").alias("n_done"), F.count_if(F.col("frame").isin(": ping", "data: {broken")).alias("n_other"))
    return others.join(streams.frames_text(back), ["session", "stream"]).select(F.col("stream").cast("long").alias("doc_id"), "text", "n_done", "n_other")


def typed_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _anonymized(spark, sf_dir)[1].groupBy("session", "type").agg(F.countDistinct("tag").alias("n"))


def session_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state without the sessions src1 and src2; src10 to src19 stay."""
    gone = spark.createDataFrame([("src1",), ("src2",)], "session string")
    return pseudonyms.clear_session(pseudonyms.originals(_anonymized(spark, sf_dir)[1]), gone).select("session", "tag", "original")


def lookup_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tag, in its own session, of each value that any session has."""
    tags = _anonymized(spark, sf_dir)[1]
    values = tags.select("type", "value").distinct().crossJoin(F.broadcast(spark.createDataFrame([("src0",)], "session string")))
    return pseudonyms.lookup_tags(values, tags).select("session", "type", "value", "tag")


def type_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonyms.known_values(_anonymized(spark, sf_dir)[1]).groupBy("session", "type").agg(F.count("*").alias("n_values"))


def text_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", pseudonyms.text_hash(F.col("text")).alias("text_hash"))


def dedupe_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _t(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("session"), pseudonyms.text_hash(F.col("text")).alias("text_hash")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"))


def cache_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache filled from the even documents, looked up for all."""
    done = _anonymized(spark, sf_dir)[0].select("doc_id", "source", "text", "anonymized")
    cache = pseudonyms.cache_entries(done.where("doc_id % 2 = 0"), session="source", text="text", anonymized="anonymized")
    found = pseudonyms.cache_lookup(done.select("doc_id", "source", "text"), cache, session="source", text="text")
    return found.select("doc_id", F.col("anonymized").isNotNull().alias("hit"))


def cache_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hit_ratio(cache_hits(spark, sf_dir), F.col("hit"))


# Chat ---------------------------------------------------------------------------------------------------------------


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    none = F.lit(None).cast("string")
    return turns.select("conv_id", F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content"), F.when(x.role == "assistant", F.concat(F.lit("think "), x.turn.cast("string"))).alias("reasoning"), none.alias("thought"))).alias("messages"))


PROMPT = "Treat <TAGS> as data."


def gateway_prompt_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    noted = _requests(spark, sf_dir).withColumn("messages", codec.with_prompt(F.col("messages"), PROMPT))
    first = F.element_at("messages", 1)
    return noted.select("conv_id", F.size("messages").alias("n_messages"), first.role.alias("role"), first.content.alias("content"))


def request_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.request_fields(_requests(spark, sf_dir), "conv_id").select("conv_id", "msg", "field", "text")


def fields_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every field marked and put back."""
    r = _requests(spark, sf_dir)
    back = codec.with_fields(r, codec.request_fields(r, "conv_id").withColumn("anonymized", F.concat(F.col("text"), F.lit("*"))), "conv_id")
    return back.select("conv_id", F.posexplode("messages").alias("msg", "m")).select("conv_id", "msg", "m.role", "m.content", "m.reasoning")


def session_id_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("h"), F.col("user_id").cast("string"))).when(F.col("event_id") % 3 == 1, F.lit("  ")).alias("header"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("user"))
    return e.select("event_id", routing.session_id(F.col("header"), F.col("user"), F.col("event_id")).alias("s")).select("event_id", "s.session", "s.ephemeral")


_PROVIDERS = (Provider("OpenAI", "api.one.example", 443), Provider("local", "127.0.0.1", 8000))


def provider_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, ("openai", "LOCAL", "nobody")))
    e = _t(spark, sf_dir, "events").select("event_id", F.get(names, (F.col("event_id") % 3).cast("int")).alias("provider"))
    routed = routing.with_provider(e.withColumn("path", F.concat(F.lit("/"), F.col("provider"), F.lit("/v1/chat/completions"))), routing.providers_table(spark, _PROVIDERS))
    return routed.select("event_id", "host", "port", "tls", "status", routing.target_path(F.col("path"), F.col("provider")).alias("target"))


def header_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = F.create_map(F.lit("Host"), F.lit("a"), F.lit("content-length"), F.lit("1"), F.lit("X-User"), F.col("user_id").cast("string"), F.lit("Transfer-Encoding"), F.lit("chunked"))
    e = _t(spark, sf_dir, "events")
    names = lambda dropped: F.array_join(F.array_sort(F.map_keys(routing.passed_headers(headers, dropped))), ",")
    return e.select("event_id", names(routing.REQUEST_HEADERS_DROPPED).alias("request"), names(routing.RESPONSE_HEADERS_DROPPED).alias("response"))


def stream_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.when(F.col("event_id") % 4 == 0, True).when(F.col("event_id") % 4 == 1, False)
    return _t(spark, sf_dir, "events").groupBy(routing.is_stream(flag).alias("stream")).agg(F.count("*").alias("n"))


def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bodies of which every fifth is cut off."""
    body = F.to_json(F.struct(F.col("role").alias("user"), F.lit(True).alias("stream")))
    c = _t(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 5 == 4, F.expr("left(to_json(named_struct('user', role)), 5)")).otherwise(body).alias("body"))
    good, bad = chat.parsed_requests(c)
    return good.select("conv_id", "turn", "request.user", F.lit(None).cast("int").alias("status")).unionByName(bad.select("conv_id", "turn", F.lit(None).cast("string").alias("user"), "status"))


def blank_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.when(F.col("doc_id") % 5 == 0, F.lit(" \t\n")).when(F.col("doc_id") % 5 == 1, F.lit("")).when(F.col("doc_id") % 5 == 2, F.lit(None)).otherwise(F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", P.is_blank(text).alias("blank"))


def role_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many different tags the users of each conversation name, every turn naming its own, its role and one of its neighbour's."""
    named = F.concat_ws(" ", F.concat(F.lit("<TURN_"), F.col("turn"), F.lit(">")), F.concat(F.lit("<"), F.upper("role"), F.lit("_1>")), F.concat(F.lit("<TURN_"), F.floor(F.col("turn") / 4), F.lit(">")))
    turns = _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", named.alias("content")))).alias("messages"))
    return turns.select("conv_id", F.size(codec.user_tags(F.col("messages"))).cast("long").alias("n"))


def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(codec.token_count(F.col("text"))).cast("long").alias("tokens"))


def tag_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _anonymized(spark, sf_dir)[0]
    return done.select("doc_id", F.posexplode(detect.tags(F.col("anonymized"))).alias("n", "tag"))


def ordered_distinct_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = _anonymized(spark, sf_dir)[0].select("source", "doc_id", detect.tags(F.col("anonymized")).alias("found"))
    return codec.session_tags(done, "source", "doc_id", "found").select(F.col("source").alias("session"), F.array_join("tags", " ").alias("tags"))


def mock_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of its session's tags a reply names: the choice of the reply is a hash of Spark's own."""
    done = _anonymized(spark, sf_dir)[0].select("source", "doc_id", detect.tags(F.col("anonymized")).alias("found"))
    known = codec.session_tags(done, "source", "doc_id", "found")
    return known.select(F.col("source").alias("session"), codec.mock_reply(F.col("tags"), F.col("source")).alias("reply"))


def unary_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of responses as JSON: of the first choice, or with all_choices of all."""
    c = _t(spark, sf_dir, "conversations").where("role = 'assistant'")
    message = lambda text: F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.lit("r").alias("reasoning"), F.array(F.struct(F.lit("d1").alias("text")), F.struct(F.lit("d2").alias("text"))).alias("reasoning_details")).alias("message"))
    body = F.to_json(F.struct(F.array(message(F.col("text")), message(F.lit("second"))).alias("choices")))
    parsed = c.select("conv_id", "turn", F.from_json(body, codec.RESPONSE).alias("response"))
    return parsed.select("conv_id", "turn", F.inline(codec.response_fields(F.col("response"))))


def response_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses that hold anonymized texts, restored in the first choice and left alone in the second."""
    done, tags = _anonymized(spark, sf_dir)
    message = lambda text: F.struct(F.struct(F.lit("assistant").alias("role"), text.alias("content"), F.lit(None).cast("string").alias("reasoning"), F.array(F.struct(text.alias("text"))).alias("reasoning_details")).alias("message"))
    t = F.col("anonymized")
    with_maps = done.select("doc_id", "source", t).join(pseudonyms.tag_maps(done, pseudonyms.originals(tags), id_col="doc_id", session="source", text="anonymized"), "doc_id", "left")
    response = F.struct(F.array(message(t), message(t)).alias("choices"))
    back = with_maps.select("doc_id", codec.with_response_fields(F.from_json(F.to_json(response), codec.RESPONSE), lambda x: F.when(F.col("known").isNull(), x).otherwise(pseudonyms.restored(x, F.col("known")))).alias("r"))
    return back.select("doc_id", F.col("r.choices")[0].message.content.alias("content"), F.col("r.choices")[0].message.reasoning_details[0].text.alias("detail"), (F.col("r.choices")[1].message.content).alias("second"))


def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as an event stream: a chunk for each turn, a comment, the end."""
    c = _t(spark, sf_dir, "conversations").withColumn("frame", codec.data_frame(F.col("text"), None, F.array(F.struct(F.col("role").alias("text")))))
    bodies = c.groupBy("conv_id").agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "frame"))), lambda x: x.frame), "\n\n"), F.lit("\n\n: ping\n\ndata: [DONE]\n\n")).alias("body"))
    frames = chat.split_frames(bodies, "body", "conv_id").withColumn("kind", chat.frame_kind(F.col("frame")))
    keyed = frames.select("conv_id", "seq", "kind", F.explode_outer(codec.chunk_fields(chat.frame_chunk(F.when(F.col("kind") == "data", F.col("frame"))))).alias("f"))
    return keyed.select("conv_id", "seq", "kind", "f.key", "f.text")


# Models -------------------------------------------------------------------------------------------------------------


def _labelled(text: Column) -> Column:
    """Tokens: words of ASCII letters; B-PER where capitalised, I-PER after length 4, I-LOC after length 7, else O."""
    return F.transform(P.matches(F.coalesce(text, F.lit("")), "[A-Za-z]+"), lambda m: F.struct(m.value.alias("token"), m.start.alias("start"), m.end.alias("end"), F.when(F.rlike(m.value, F.lit("^[A-Z]")), "B-PER").when(F.length(m.value) == 4, "I-PER").when(F.length(m.value) == 7, "I-LOC").otherwise("O").alias("label")))


def _decoded(decode):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        b = _t(spark, sf_dir, "benchmark").select("item_id", "text", _labelled(F.col("text")).alias("tokens"))
        return b.select("item_id", F.explode(decode(F.col("tokens"), F.col("text"), ("LOC", "I-LOC"), {"PER": "PERSON"})).alias("s")).select("item_id", "s.start", F.col("s.end").alias("stop"), "s.raw_type", "s.value")

    return run


_TOKENS_SQL = """WITH tok AS (SELECT item_id, text, i, m[i] AS token, CAST(length(array_to_string(g[1:i], '')) + length(array_to_string(m[1:i - 1], '')) AS INTEGER) AS start
  FROM (SELECT item_id, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT item_id, text, regexp_extract_all(text, '[A-Za-z]+') AS m, string_split_regex(text, '[A-Za-z]+') AS g FROM benchmark))),
lab AS (SELECT *, CAST(start + length(token) AS INTEGER) AS stop, CASE WHEN regexp_matches(token, '^[A-Z]') THEN 'B-PER' WHEN length(token) = 4 THEN 'I-PER' WHEN length(token) = 7 THEN 'I-LOC' ELSE 'O' END AS label FROM tok)"""


def label_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _t(spark, sf_dir, "benchmark").select("item_id", F.transform(_labelled(F.col("text")), lambda t: t.label).alias("labels"))
    return b.select("item_id", F.array_join(ner.active_labels(F.col("labels"), F.array(F.lit("LOC"))), ",").alias("labels"))


def argmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest component of each vector, the first of equals."""
    return _t(spark, sf_dir, "embeddings").select("vec_id", ner.argmax(F.col("embedding")).alias("best"))


def ner_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in batches: here a rule that labels words of 9 letters or more; one batch fails and has no tokens."""

    def load():
        import re

        words = re.compile("[A-Za-z]+")
        return lambda texts: [[(m[0], m.start(), m.end(), "B-LONG" if len(m[0]) > 8 else "O") for m in words.finditer(t)] for t in texts]

    tokens = ner.tokens_udf(load)
    b = _t(spark, sf_dir, "benchmark").select("item_id", "text", tokens(F.col("text")).alias("tokens"))
    return b.select("item_id", F.explode(ner.decode_bio(F.col("tokens"), F.col("text"))).alias("s")).select("item_id", "s.start", F.col("s.end").alias("stop"), "s.raw_type", "s.value")


# Similarity ---------------------------------------------------------------------------------------------------------


def jw_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the names of neighbouring customers."""

    @F.pandas_udf("double")
    def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(x, y) for x, y in zip(a, b, strict=True)])

    c = _t(spark, sf_dir, "customer").select("c_custkey", "c_name")
    other = c.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("c_name").alias("other"))
    return c.join(other, "c_custkey").select("c_custkey", "c_name", "other", similarity("c_name", "other").alias("score"))


def resolve_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All types by similarity: tags of values, near ones shared."""
    found = pipeline.detected(_t(spark, sf_dir, "documents"), EXACT)
    entities = pseudonyms.exploded(found, session="source", order="doc_id")
    return pseudonyms.assign(entities, JaroWinkler(0.88), None).select("session", "type", "value", "tag")


def anonymize_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity for names of persons, places and organisations only, of which there are none: as the exact strategy."""
    return _anonymized(spark, sf_dir, Config())[0].select("doc_id", "anonymized")


# Metrics ------------------------------------------------------------------------------------------------------------


def nearest_rank_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.percentiles(_t(spark, sf_dir, "events"), "value", (50, 95, 99), ("event_type",))


def flush_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reason_counts(_t(spark, sf_dir, "events"), "event_type")


def _ms(n: int) -> Column:
    return (F.col("event_id") * n % 97).cast("string")


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log line for each event: every third a hit, every fifth a batch, every seventh a restoration, every eleventh an inference."""
    e = F.col("event_id")
    line = F.when(e % 5 == 0, F.concat(F.lit("[DEBUG] ML Batch done: size="), _ms(3), F.lit(", reason="), F.upper("event_type"), F.lit(", pendingAfterFlush="), _ms(5)))
    line = line.when(e % 7 == 0, F.concat(F.lit("[DEBUG] Restored 2 tags in 'content' for session s"), F.col("user_id").cast("string"), F.lit(" in "), _ms(31), F.lit("µs")))
    line = line.when(e % 11 == 0, F.concat(F.lit("[INFO] ML Inference: batchSize=16, "), _ms(13), F.lit("ms ("), _ms(2), F.lit("ms/text)")))
    line = line.when(e % 3 == 0, F.concat(F.lit("[DEBUG] Pipeline: total="), _ms(7), F.lit("ms, cache=1ms, regex=0, ml=0, subst=0 (hit)")))
    line = line.otherwise(F.concat(F.lit("[DEBUG] Pipeline: total="), _ms(17), F.lit("ms, cache=2ms, regex="), (e % 6).cast("string"), F.lit("ms, ml=1ms, subst="), (e % 4).cast("string"), F.lit("ms")))
    return _t(spark, sf_dir, "events").select("event_id", line.alias("value"))


_LOG_SQL = """WITH l AS (SELECT *, event_id % 5 = 0 AS is_batch, event_id % 5 <> 0 AND event_id % 7 = 0 AS is_restore, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 11 = 0 AS is_inference FROM events),
p AS (SELECT event_id, event_id % 3 = 0 AS hit, CASE WHEN event_id % 3 = 0 THEN event_id * 7 % 97 ELSE event_id * 17 % 97 END AS total_ms, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS cache_ms,
  CASE WHEN event_id % 3 = 0 THEN 0 ELSE event_id % 6 END AS regex_ms, CASE WHEN event_id % 3 <> 0 THEN event_id % 4 END AS subst_ms FROM l WHERE NOT is_batch AND NOT is_restore AND NOT is_inference)"""


def log_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.breakdown(analytics.pipeline_lines(_log(spark, sf_dir)))


def log_hit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.hit_ratio(analytics.pipeline_lines(_log(spark, sf_dir)), F.col("hit"))


def log_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.reason_counts(analytics.batch_lines(_log(spark, sf_dir))).join(analytics.percentiles(analytics.batch_lines(_log(spark, sf_dir)), "size", (50, 95), ("reason",)), "reason")


def log_restores(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = analytics.restore_lines(_log(spark, sf_dir))
    return lines.agg(F.count("*").alias("n"), F.max("latency_us").alias("most")).crossJoin(analytics.percentiles(lines, "latency_us", (50, 95, 99)))


def log_inferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = analytics.inference_lines(_log(spark, sf_dir))
    return lines.agg(F.count("*").alias("n"), F.max("time_ms").alias("most"), F.sum("per_text_ms").alias("per_text")).crossJoin(analytics.percentiles(lines, "time_ms", (50, 95)))


def _gc_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_id") % 3 == 0, "Full").otherwise("Young")
    line = F.concat(F.lit("[2026-01-01T00:00:00][1.0s][info][gc] GC("), F.col("event_id").cast("string"), F.lit(") Pause "), kind, F.lit(" (Normal) (G1 Evacuation Pause) "), (F.col("event_id") % 50 + 100).cast("string"), F.lit("M->"), (F.col("event_id") % 50).cast("string"), F.lit("M(256M) "), (F.col("event_id") % 40).cast("string"), F.lit(".5ms"))
    return analytics.gc_lines(e.select("event_id", line.alias("value")))


def gc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gc_summary(_gc_log(spark, sf_dir), "event_id")


def gc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return analytics.gc_counts(_gc_log(spark, sf_dir))


def load_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "events").select("event_type", (F.col("event_id") * 37 % 2500).alias("latency_ms"), F.when(F.col("event_id") % 150 == 0, 502).otherwise(200).alias("status"))
    return analytics.load_metrics(e, by=("event_type",))


def live_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as sessions: used within a day of the last event of all; the 100 last used."""
    e = _t(spark, sf_dir, "events")
    seen = e.groupBy(F.col("user_id").cast("string").alias("session")).agg(F.max("ts").alias("last_access"))
    last = e.agg(F.max("ts").alias("now"))
    return analytics.live_sessions(seen.crossJoin(F.broadcast(last)), F.col("now"), ttl_seconds=86_400, most=100).select("session", "last_access")


_POOL = {"PERSON": ["Ada", "Bea"], "EMAIL": ["a@b.example", "c@d.example"], "PHONE": ["+1-555-123-4567"], "ORG": ["Acme"], "IP_ADDRESS": ["10.0.0.1"]}
_TEMPLATES = [("PERSON", "I am {PERSON}."), ("EMAIL", "Write to {EMAIL}."), ("PHONE", "Call {PHONE}."), ("ORG", "I work at {ORG}."), ("IP_ADDRESS", "It is at {IP_ADDRESS}."), (None, "What next?")]


def workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = _t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conversation")).distinct()
    return analytics.workload(ids, spark.createDataFrame(list(_POOL.items()), "type string, values array<string>"), spark.createDataFrame(_TEMPLATES, "type string, text string"))


# Streams ------------------------------------------------------------------------------------------------------------


def stream_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anonymized documents cut into fragments of 7 characters, re-cut, restored and put together."""
    done, tags = _anonymized(spark, sf_dir)
    pieces = done.select(F.col("source").alias("session"), F.col("doc_id").cast("string").alias("stream"), F.lit("content").alias("key"), F.posexplode(F.regexp_extract_all("anonymized", F.lit(r"(?s).{1,7}"), F.lit(0))).alias("seq", "text"), F.ceil(F.length("anonymized") / 7).alias("n"))
    fragments = pieces.select("session", "stream", "key", F.col("seq").cast("long"), "text", (F.col("seq") == F.col("n") - 1).alias("last"))
    ready = streams.recut_batch(fragments).withColumn("row", F.concat_ws(":", "stream", "key", "seq"))
    back = pseudonyms.restore(ready, pseudonyms.originals(tags), id_col="row", session="session", text="text")
    return streams.full_texts(back.select("session", "stream", "key", "seq", F.col("restored"), "last"), "restored").select(F.col("stream").cast("long").alias("doc_id"), "text")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "email_spans": _span_query(detect.email), "phone_spans": _span_query(detect.phone), "card_candidates": _span_query(detect.card_candidates), "card_spans_luhn": _span_query(detect.credit_card), "ip_spans": _span_query(detect.ip_address),
    "page_email_spans": _span_query(detect.email, "pages", "page_id", "html"), "page_ip_spans": _span_query(detect.ip_address, "pages", "page_id", "html"),
    "all_regex_spans": all_regex_spans, "pii_counts_by_type": pii_counts_by_type,
    "resolve_longest_wins": _resolved(ConflictStrategy.LONGEST_WINS), "resolve_regex_priority": _resolved(ConflictStrategy.REGEX_PRIORITY),
    "text_hash": text_hashes, "dedupe_by_hash": dedupe_by_hash, "assign_tags_exact": assign_tags_exact, "anonymize_documents": anonymize_documents, "restore_documents": restore_documents, "roundtrip_check": roundtrip_check,
    "typed_counters": typed_counters, "session_clear": session_clear, "lookup_tags": lookup_tags, "type_index": type_index, "cache_hits": cache_hits, "cache_hit_ratio": cache_hit_ratio,
    "gateway_prompt_inject": gateway_prompt_inject, "request_fields": request_fields, "fields_round_trip": fields_round_trip, "session_id_resolution": session_id_resolution, "provider_routing": provider_routing, "header_projection": header_projection,
    "assign_tags_incremental": assign_tags_incremental, "anonymize_cached": anonymize_cached, "state_clear": state_clear, "sse_restore": sse_restore,
    "stream_split": stream_split, "json_decode": json_decode, "blank_guard": blank_guard, "role_filter": role_filter, "token_usage": token_usage, "tag_scan": tag_scan, "ordered_distinct_tags": ordered_distinct_tags, "mock_replies": mock_replies,
    "unary_restore": unary_restore, "response_round_trip": response_round_trip, "sse_frames": sse_frames, "bio_decode": _decoded(ner.decode_bio), "simple_decode": _decoded(ner.decode_simple), "label_inventory": label_inventory, "argmax_labels": argmax_labels, "ner_spans": ner_spans,
    "jw_pairs": jw_pairs, "resolve_fuzzy": resolve_fuzzy, "anonymize_fuzzy": anonymize_fuzzy, "nearest_rank_percentiles": nearest_rank_percentiles, "flush_reason_counts": flush_reason_counts, "log_breakdown": log_breakdown, "log_hit_ratio": log_hit_ratio,
    "log_batches": log_batches, "log_restores": log_restores, "log_inferences": log_inferences, "gc_summary": gc_summary, "gc_counts": gc_counts, "load_metrics": load_metrics, "live_sessions": live_sessions, "workload": workload, "stream_restore": stream_restore,
}


def _p(p: int, column: str, by: str) -> str:
    over = f"PARTITION BY {by}" if by else ""
    return f"max(v) FILTER (rn = least(n * {p} // 100, n - 1) + 1) AS p{p}", f"row_number() OVER ({over} ORDER BY {column}) AS rn, count(*) OVER ({over}) AS n, {column} AS v"


def _percentiles_sql(source: str, column: str, ps: tuple[int, ...], by: str = "", more: str = "") -> str:
    head = f"{by}, " if by else ""
    return f"SELECT {head}{more}{', '.join(_p(p, column, by)[0] for p in ps)} FROM (SELECT *, {_p(50, column, by)[1]} FROM {source})" + (f" GROUP BY {by}" if by else "")


ORACLE_SQL: dict[str, str] = {
    "email_spans": _EMAIL, "phone_spans": _PHONE, "card_candidates": _CARDS, "card_spans_luhn": _CARD, "ip_spans": _IP,
    "page_email_spans": _spans_sql(P.EMAIL, "EMAIL", "true", "pages", "page_id", "html"), "page_ip_spans": _spans_sql(P.IP_ADDRESS, "IP_ADDRESS", "true", "pages", "page_id", "html"),
    "all_regex_spans": f"SELECT doc_id, start, stop, type, value FROM ({_ALL})",
    "pii_counts_by_type": f"SELECT type, count(*) AS n_spans, count(DISTINCT doc_id) AS n_docs, count(DISTINCT value) AS n_values FROM ({_ALL}) GROUP BY type",
    "resolve_longest_wins": f"WITH {_resolve_sql('0')} {_RESOLVED}", "resolve_regex_priority": f"WITH {_resolve_sql('ord = 9')} {_RESOLVED}",
    "text_hash": "SELECT doc_id, sha256(coalesce(text, '')) AS text_hash FROM documents",
    "dedupe_by_hash": "SELECT source AS session, sha256(coalesce(text, '')) AS text_hash, min(doc_id) AS first_doc, count(*) AS n FROM documents GROUP BY ALL",
    "assign_tags_exact": f"{_TAGS_SQL} SELECT session, type, value, tag FROM tags",
    "anonymize_documents": f"{_ANON_SQL} SELECT doc_id, anonymized FROM anon", "anonymize_fuzzy": f"{_ANON_SQL} SELECT doc_id, anonymized FROM anon",
    "restore_documents": "SELECT doc_id, text AS restored FROM documents", "stream_restore": "SELECT doc_id, text FROM documents WHERE text <> ''",
    "roundtrip_check": f"{_ANON_SQL} SELECT source, count(*) AS n, count(*) AS n_equal, count(*) FILTER (text <> anonymized) AS n_changed FROM anon GROUP BY source",
    "typed_counters": f"{_TAGS_SQL} SELECT session, type, count(DISTINCT tag) AS n FROM tags GROUP BY ALL", "type_index": f"{_TAGS_SQL} SELECT session, type, count(*) AS n_values FROM tags GROUP BY ALL",
    "session_clear": f"{_TAGS_SQL} SELECT session, tag, value AS original FROM tags WHERE session NOT IN ('src1', 'src2')",
    "lookup_tags": f"{_TAGS_SQL} SELECT 'src0' AS session, v.type, v.value, tags.tag FROM (SELECT DISTINCT type, value FROM tags) v LEFT JOIN tags ON tags.session = 'src0' AND tags.type = v.type AND tags.value = v.value",
    "assign_tags_incremental": f"{_TAGS2_SQL} SELECT session, type, value, tag FROM tags", "anonymize_cached": f"{_ANON2_SQL} SELECT doc_id, anonymized FROM anon",
    "state_clear": f"{_TAGS2_SQL} SELECT session, tag, value AS original FROM tags WHERE session NOT IN ('src1', 'src2')",
    "sse_restore": "SELECT doc_id, text, 1::BIGINT AS n_done, CAST(ceil(length(anonymized) / 40.0) AS BIGINT) AS n_other FROM (" + f"{_ANON_SQL} SELECT doc_id, text, anonymized FROM anon" + ") WHERE anonymized <> ''",
    "cache_hits": "SELECT d.doc_id, EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND c.source = d.source AND c.text = d.text) AS hit FROM documents d",
    "cache_hit_ratio": "SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS hit_rate FROM (SELECT EXISTS (SELECT 1 FROM documents c WHERE c.doc_id % 2 = 0 AND c.source = d.source AND c.text = d.text) AS hit FROM documents d)",
    "gateway_prompt_inject": f"""SELECT conv_id, CAST(CASE WHEN r = 'system' THEN n ELSE n + 1 END AS INTEGER) AS n_messages, 'system' AS role, CASE WHEN r = 'system' THEN t || {_q(codec.NOTE + PROMPT)} ELSE {_q(PROMPT)} END AS content
      FROM (SELECT conv_id, count(*) AS n, arg_min(role, turn) AS r, arg_min(text, turn) AS t FROM conversations GROUP BY conv_id)""",
    "request_fields": r"""WITH m AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS msg FROM conversations)
      SELECT conv_id, msg, CAST(0 AS INTEGER) AS field, text FROM m WHERE NOT regexp_matches(text, '^\s*$') UNION ALL SELECT conv_id, msg, 1, 'think ' || turn FROM m WHERE role = 'assistant'""",
    "fields_round_trip": "SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS INTEGER) AS msg, role, text || '*' AS content, CASE WHEN role = 'assistant' THEN 'think ' || turn || '*' END AS reasoning FROM conversations",
    "session_id_resolution": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'h' || user_id WHEN event_id % 2 = 0 THEN 'u' || user_id ELSE sha256('ephemeral:' || event_id) END AS session, event_id % 3 <> 0 AND event_id % 2 <> 0 AS ephemeral FROM events",
    "provider_routing": "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'api.one.example' WHEN 1 THEN '127.0.0.1' END AS host, CAST(CASE event_id % 3 WHEN 0 THEN 443 WHEN 1 THEN 8000 END AS INTEGER) AS port, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS tls, CAST(CASE event_id % 3 WHEN 2 THEN 400 END AS INTEGER) AS status, '/v1/chat/completions' AS target FROM events",
    "header_projection": "SELECT event_id, 'Transfer-Encoding,X-User' AS request, 'Host,X-User' AS response FROM events",
    "stream_split": "SELECT event_id % 4 = 0 AS stream, count(*) AS n FROM events GROUP BY ALL",
    "json_decode": "SELECT conv_id, turn, CASE WHEN turn % 5 <> 4 THEN role END AS user, CAST(CASE WHEN turn % 5 = 4 THEN 400 END AS INTEGER) AS status FROM conversations",
    "blank_guard": r"SELECT doc_id, doc_id % 5 < 3 OR text IS NULL OR regexp_matches(text, '^\s*$') AS blank FROM documents",
    "role_filter": """SELECT conv_id, count(DISTINCT tag) AS n FROM (SELECT conv_id, unnest(CASE WHEN role = 'user' THEN ['<TURN_' || turn || '>', '<USER_1>', '<TURN_' || (turn // 4) || '>'] ELSE [NULL] END) AS tag FROM conversations) GROUP BY conv_id""",
    "token_usage": r"SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^\s]+'))) AS BIGINT) AS tokens FROM conversations GROUP BY conv_id",
    "tag_scan": f"{_ANON_SQL} SELECT doc_id, CAST(i - 1 AS INTEGER) AS n, m[i] AS tag FROM (SELECT doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(anonymized, {_q(P.TAG)}) AS m FROM anon))",
    "ordered_distinct_tags": f"""{_ANON_SQL}, o AS (SELECT source, m[i] AS tag, min((doc_id, i)) AS pos FROM (SELECT source, doc_id, m, unnest(range(1, len(m) + 1)) AS i FROM (SELECT source, doc_id, regexp_extract_all(anonymized, {_q(P.TAG)}) AS m FROM anon)) GROUP BY ALL)
      SELECT source AS session, string_agg(tag, ' ' ORDER BY pos) AS tags FROM o GROUP BY source""",
    "unary_restore": "SELECT conv_id, turn, unnest(['content', 'reasoning', 'reasoning_details']) AS key, unnest([text, 'r', 'd1']) AS text FROM conversations WHERE role = 'assistant'",
    "response_round_trip": f"{_ANON_SQL} SELECT doc_id, text AS content, text AS detail, anonymized AS second FROM anon",
    "sse_frames": """WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS seq FROM conversations), n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
      SELECT conv_id, CAST(seq AS INTEGER) AS seq, 'data' AS kind, unnest(['content', 'reasoning_details']) AS key, unnest([text, role]) AS text FROM m
      UNION ALL SELECT conv_id, CAST(n AS INTEGER), 'other', NULL, NULL FROM n UNION ALL SELECT conv_id, CAST(n + 1 AS INTEGER), 'done', NULL, NULL FROM n""",
    "bio_decode": f"""{_TOKENS_SQL}, g AS (SELECT *, count(*) FILTER (label <> 'I-PER') OVER (PARTITION BY item_id ORDER BY i) AS grp FROM lab)
      SELECT item_id, min(start) AS start, max(stop) AS stop, 'PERSON' AS raw_type, substring(any_value(text), min(start) + 1, max(stop) - min(start)) AS value FROM g GROUP BY item_id, grp HAVING arg_min(label, i) = 'B-PER'""",
    "simple_decode": f"{_TOKENS_SQL} SELECT item_id, start, stop, label AS raw_type, token AS value FROM lab WHERE label NOT IN ('O', 'I-LOC')",
    "label_inventory": f"{_TOKENS_SQL} SELECT item_id, coalesce(max('PER') FILTER (label IN ('B-PER', 'I-PER')), '') AS labels FROM lab GROUP BY item_id",
    "argmax_labels": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best FROM embeddings",
    "ner_spans": f"{_TOKENS_SQL} SELECT item_id, start, stop, 'LONG' AS raw_type, token AS value FROM lab WHERE length(token) > 8",
    "nearest_rank_percentiles": _percentiles_sql("events", "value", (50, 95, 99), "event_type"),
    "flush_reason_counts": "SELECT event_type, count(*) AS n FROM events GROUP BY event_type",
    "log_breakdown": f"""{_LOG_SQL}, a AS (SELECT avg(total_ms) AS t, avg(cache_ms) AS c, avg(regex_ms) AS r, avg(subst_ms) AS s FROM p), b AS (SELECT *, greatest(0, t - c - r - s) AS m FROM a)
      SELECT c AS avg_cache, r AS avg_regex, m AS avg_ml, s AS avg_subst, t AS avg_total, c * 100 / t AS pct_cache, r * 100 / t AS pct_regex, m * 100 / t AS pct_ml, s * 100 / t AS pct_subst FROM b""",
    "log_hit_ratio": f"{_LOG_SQL} SELECT count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (NOT hit) AS misses, count(*) FILTER (hit) * 100.0::DOUBLE / count(*) AS hit_rate FROM p",
    "log_batches": f"{_LOG_SQL} " + _percentiles_sql("(SELECT upper(event_type) AS reason, event_id * 3 % 97 AS size FROM l WHERE is_batch)", "size", (50, 95), "reason", "count(*) AS n, "),
    "log_restores": f"{_LOG_SQL} " + _percentiles_sql("(SELECT event_id * 31 % 97 AS us FROM l WHERE is_restore)", "us", (50, 95, 99), "", "count(*) AS n, max(us) AS most, "),
    "log_inferences": f"{_LOG_SQL} " + _percentiles_sql("(SELECT event_id * 13 % 97 AS ms, event_id * 2 % 97 AS pt FROM l WHERE is_inference)", "ms", (50, 95), "", "count(*) AS n, max(ms) AS most, CAST(sum(pt) AS BIGINT) AS per_text, "),
    "gc_summary": _percentiles_sql("(SELECT event_id, event_id % 40 + 0.5::DOUBLE AS d FROM events)", "d", (50, 95, 99), "", "count(*) AS n, sum(d) AS total_ms, max(d) AS max_ms, arg_max(event_id % 50, event_id) AS after_mb, CAST(256 AS BIGINT) AS total_mb, "),
    "gc_counts": "SELECT CASE WHEN event_id % 3 = 0 THEN 'Full' ELSE 'Young' END AS type, count(*) AS n FROM events GROUP BY 1",
    "load_metrics": "SELECT *, p95 < 2000 AND p99 < 5000 AND error_rate < 0.01 AS within FROM (" + _percentiles_sql("(SELECT event_type, event_id * 37 % 2500 AS ms, event_id % 150 = 0 AS bad FROM events)", "ms", (95, 99), "event_type", "count(*) AS n, avg(CAST(bad AS DOUBLE)) AS error_rate, ") + ")",
    "live_sessions": "SELECT CAST(user_id AS VARCHAR) AS session, max(ts) AS last_access FROM events GROUP BY user_id HAVING epoch((SELECT max(ts) FROM events)) // 1 - epoch(max(ts)) // 1 <= 86400 ORDER BY max(ts) DESC, CAST(user_id AS VARCHAR) LIMIT 100",
}

