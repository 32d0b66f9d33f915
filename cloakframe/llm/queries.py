"""The thin queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, jaccard, langid, passages, quality, secrets, topk, warc
from .common import bounded_batches, table
from .hashed import crc_mod

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and what they decode to, as digests."""
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(documents: DataFrame) -> DataFrame:
    bounded_batches(documents.sparkSession)
    both = documents.select("doc_id", bpe.encode_and_decode(F.col("text"), VOCABULARY, public_tokenizers.PATTERN).alias("b"))
    return both.select("doc_id", bpe.n_tokens(F.col("b.ids")).alias("n_tokens"), F.sha2("b.ids", 256).alias("ids_sha256"), F.sha2("b.decoded", 256).alias("decoded_sha256"))


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.ngram_jaccard(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = tuple(r.kind for r in secrets.BASE)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")
    n = lambda kind: F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(n, base), F.sha2(listed(F.filter("spans", lambda s: s.kind.isin(*base))), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = langid.train(documents.where(~held_out))
    found = documents.select("doc_id", held_out.alias("held_out"), langid.predict(F.col("text"), model).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.rejected")


def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = passages.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.end)), ","))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    index = warc.write_archive(table(spark, sf_dir, "pages"), folder)
    found = warc.read_archive(index, folder)
    # what a response says of its payload is not taken on trust
    payload = F.col("payload")
    digest, size = F.coalesce(F.sha1(payload), F.col("payload_digest")), F.coalesce(F.octet_length(payload).cast("long"), F.col("payload_bytes"))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", html_text.html_text(F.col("html")).alias("text"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality.train(documents.where(~held_out), labels.where(~held_out))
    found = documents.select("doc_id", held_out.alias("held_out"), quality.score(F.col("text"), model).alias("score"))
    return found.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item, least(10, len(w)) AS n, array_to_string(w[s:s + least(10, len(w)) - 1], ' ') AS win
       FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lens WHERE len(w) >= n)),
h AS (SELECT doc_id, s, dw.n AS n, item FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM h)) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""


_OP3_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, '|' ORDER BY g)) AS print FROM sh GROUP BY doc_id),
rep AS (SELECT print, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM n GROUP BY print),
rs AS (SELECT rep, rep.n AS n, g FROM rep JOIN sh ON sh.doc_id = rep.rep),
c AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS inter FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep GROUP BY a.rep, b.rep),
l AS (SELECT a, b FROM c WHERE inter * 10 >= 8 * (na + nb - inter)),
reach(x, y) AS (SELECT a, b FROM l UNION SELECT reach.x, l.b FROM reach JOIN l ON reach.y = l.a),
cls AS (SELECT x, least(x, min(y)) AS class_id FROM reach GROUP BY x),
cnt AS (SELECT a, count(*) AS n_text_links, sum(copies) AS n_docs FROM l JOIN rep ON rep.rep = l.b GROUP BY a)
SELECT documents.doc_id, coalesce(class_id, rep, documents.doc_id) AS class_id, coalesce(rep, documents.doc_id) AS copy_of,
       CAST(coalesce(n_docs, 0) + coalesce(copies, 1) - 1 AS BIGINT) AS n_links, CAST(coalesce(n_text_links, 0) AS BIGINT) AS n_text_links
FROM documents LEFT JOIN n ON n.doc_id = documents.doc_id LEFT JOIN rep ON rep.print = n.print LEFT JOIN cls ON cls.x = rep LEFT JOIN cnt ON cnt.a = rep
"""


# The base kinds, as the contract states them: kind, pattern, group whose length counts, least length.
_BASE_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]+", 0, 16),
)


def _op5_sql() -> str:
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    kinds = [*_BASE_SECRETS, *((r.kind, r.pattern, r.group, r.least) for r in secrets.MORE)]
    rows = "\nUNION ALL ".join(
        f"""SELECT doc_id, {n} AS rank, '{kind}' AS kind, start, start + length(v) AS stop FROM (
  SELECT doc_id, v, CAST(sum(length(gap) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) - length(v) AS BIGINT) AS start
  FROM (SELECT doc_id, unnest(m) AS v, unnest(g[1:len(m)]) AS gap, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, regexp_extract_all(text, {quoted(pattern)}) AS m, string_split_regex(text, {quoted(pattern)}) AS g FROM t))
) WHERE length(regexp_extract(v, {quoted(pattern)}, {group})) >= {least}"""
        for n, (kind, pattern, group, least) in enumerate(kinds)
    )
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({rows}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank < {len(secrets.BASE)}) AS base,
  string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans FROM s GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a ON t.doc_id = a.doc_id"""


_OP1_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.r <> c.r AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

_OP8_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS latest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN latest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN latest <> page_id THEN latest END AS refers_to FROM m
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_bpe": op2_bpe,
    "op3_jaccard": op3_jaccard,
    "op4_decontaminate": op4_decontaminate,
    "op5_secrets": op5_secrets,
    "op6_language": op6_language,
    "op7_passages": op7_passages,
    "op8_warc": op8_warc,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
}

ORACLE_SQL: dict[str, str] = {
    "op1_topk": _OP1_SQL,
    "op8_warc": _OP8_SQL,
    "op3_jaccard": _OP3_SQL,
    "op4_decontaminate": _OP4_SQL,
    "op5_secrets": _op5_sql(),
}
