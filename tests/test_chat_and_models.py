import json

import pytest
from pyspark.sql import functions as F

from cloakframe.config import Provider
from cloakframe.functions import patterns as P
from cloakframe.operators import analytics, codec, ner, routing
from cloakframe.sources import chat


def tokens(*rows):
    return F.array(*(F.struct(F.lit(t).alias("token"), F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(label).alias("label")) for t, a, b, label in rows))


@pytest.mark.parametrize("decode, labels, want", [
    (ner.decode_bio, ["B-PER", "I-PER", "O", "B-LOC"], [("PER", 0, 3), ("LOC", 6, 7)]), (ner.decode_bio, ["O", "I-PER"], []), (ner.decode_bio, ["B-PER", "I-LOC"], [("PER", 0, 1)]), (ner.decode_bio, ["B-PER", "##O"], [("PER", 0, 3)]), (ner.decode_bio, ["B-PER", "B-PER"], [("PER", 0, 1), ("PER", 2, 3)]),
    (ner.decode_bio, [], []), (ner.decode_simple, ["PER", "PER", "O"], [("PER", 0, 1), ("PER", 2, 3)]),
])
def test_decoders(spark, decode, labels, want):
    own = tokens(*((("##x" if x.startswith("##") else "x"), 2 * n, 2 * n + 1, x.removeprefix("##")) for n, x in enumerate(labels))) if labels else F.array().cast(ner.TOKENS)
    got = spark.range(1).select(decode(own, F.lit("abcdefghij")).alias("s")).first().s
    assert [(s.raw_type, s.start, s.end) for s in got] == want and all(s.type == "MODEL" and s.value == "abcdefghij"[s.start : s.end] for s in got)


def test_decoder_options(spark):
    show = lambda c: [(s.raw_type, s.start, s.end) for s in spark.range(1).select(c.alias("s")).first().s]
    own, text = tokens(("a", 0, 1, "B-PER"), ("b", 2, 3, "I-XPER"), ("c", 4, 5, "S-LOC"), ("d", None, None, "B-PER"), ("e", 6, 7, "B-ORG"), ("f", 8, 9, "E-ORG")), F.lit("a b c e f g")
    assert show(ner.decode_bio(own, text)) == [("PER", 0, 1), ("ORG", 6, 7)]
    assert show(ner.decode_bio(own, text, suffix_match=True)) == [("PER", 0, 3), ("ORG", 6, 7)]
    assert show(ner.decode_bio(own, text, bioes=True)) == [("PER", 0, 1), ("LOC", 4, 5), ("ORG", 6, 9)]
    assert show(ner.decode_bio(own, text, ("ORG",), {"PER": "PERSON"})) == [("PERSON", 0, 1)]
    assert ner.decoder("bio") is ner.decode_bio
    with pytest.raises(ValueError):
        ner.decoder("none")


def test_labels(spark):
    r = spark.range(1).select(ner.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0))).alias("a"), ner.labels_of(F.array(F.array(F.lit(0.1), F.lit(0.9)), F.array(F.lit(2.0), F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0))), {0: "O", 1: "B-PER"}).alias("l"), ner.active_labels(F.array(*map(F.lit, ("O", "B-PER", "I-PER", "B-LOC"))), F.array(F.lit("LOC"))).alias("x")).first()
    assert r.a == 1 and r.l == ["B-PER", "O", "O"] and r.x == ["PER"]


def test_a_failed_batch_is_told_apart(spark):
    def load():
        def model(texts):
            if "bad" in texts:
                raise RuntimeError
            return [[("x", 0, 1, "B-PER")] for _ in texts]

        return model

    df = spark.createDataFrame([("a",), ("b",), ("bad",), (None,), (" ",)], "t string").coalesce(1)
    got = {r.t: r.k for r in df.select("t", ner.tokens_udf(load, 2)(F.col("t")).alias("k")).collect()}
    assert len(got["a"]) == 1 and got["bad"] is None and got[None] == [] and got[" "] == []
    with pytest.raises(Exception):
        df.select(ner.tokens_udf(load, 2, "fail")(F.col("t"))).collect()


def messages(spark, rows):
    return spark.createDataFrame([(1, rows)], f"id long, messages array<{codec.MESSAGE}>")


@pytest.mark.parametrize("rows, prompt, want", [
    ([("developer", "d", None, None), ("user", "u", None, None)], "P", [("developer", "d\n\n[Gateway Note]: P"), ("user", "u")]), ([("user", "u", None, None)], "P", [("system", "P"), ("user", "u")]),
    ([("user", "u", None, None)], "  ", [("user", "u")]), ([], "P", []), (None, "P", None), ([("system", None, None, None)], "P", [("system", "\n\n[Gateway Note]: P")]),
])
def test_prompts(spark, rows, prompt, want):
    got = messages(spark, rows).select(codec.with_prompt(F.col("messages"), prompt).alias("m")).first().m
    assert (got if got is None else [(m.role, m.content) for m in got]) == want


def test_fields_go_out_and_in(spark):
    df = messages(spark, [("user", "a", None, " "), ("assistant", None, "b", "c")])
    fields = codec.request_fields(df, "id")
    assert sorted((r.msg, r.field, r.text) for r in fields.collect()) == [(0, 0, "a"), (1, 1, "b"), (1, 2, "c")]
    back = codec.with_fields(df, fields.withColumn("anonymized", F.concat(F.lit("<"), "text", F.lit(">"))), "id").first().messages
    assert [tuple(m) for m in back] == [("user", "<a>", None, " "), ("assistant", None, "<b>", "<c>")]


def test_responses_and_replies(spark):
    body = json.dumps({"choices": [{"message": {"content": "c", "reasoning_details": [{"text": "d"}, {"text": "e"}]}}, {"message": {"content": "second"}}]})
    parsed = spark.createDataFrame([(body,)], "b string").select(F.from_json("b", codec.RESPONSE).alias("r"))
    rows = lambda every: [tuple(x) for x in parsed.select(codec.response_fields(F.col("r"), every).alias("f")).first().f]
    assert rows(False) == [("content", "c"), ("reasoning_details", "d")] and rows(True)[-1] == ("content", "second")
    show = lambda tags: spark.range(1).select(codec.mock_reply(F.array(*map(F.lit, tags)).cast("array<string>"), F.lit("s")).alias("t")).first().t
    assert show([]) == codec.NO_TAGS and "<A_1>" in show(["<A_1>"]) and "%s" not in show(["<A_1>", "<B_1>"])
    assert [r.n for r in spark.createDataFrame([("a b  c\n",), ("",), (None,), ("  ",)], "t string").select(codec.token_count(F.col("t")).alias("n")).collect()] == [3, 0, 0, 0]


def test_routing(spark):
    df = spark.createDataFrame([(1, "OPENAI", " ", "u1"), (2, "x", "h", "u"), (3, None, None, None)], "id long, provider string, header string, user string")
    got = {r.id: r for r in routing.with_provider(df.withColumn("s", routing.session_id(F.col("header"), F.col("user"), F.col("id"))), routing.providers_table(spark, (Provider("openai", "h"),))).collect()}
    assert got[1].host == "h" and got[1].tls and got[1].status is None and got[2].status == 400 and got[3].status == 400
    assert tuple(got[1].s) == ("u1", False) and tuple(got[2].s) == ("h", False) and got[3].s.ephemeral and len(got[3].s.session) == 64


def test_bodies_and_frames(spark, tmp_path):
    df = spark.createDataFrame([(1, '{"user": "u", "extra": 1}'), (2, "{bad"), (3, None), (4, "[1]")], "id long, body string")
    good, bad = chat.parsed_requests(df)
    assert [(r.id, r.request.user, r.body) for r in good.collect()] == [(1, "u", '{"user": "u", "extra": 1}')] and sorted(r.id for r in bad.collect()) == [2, 3, 4]
    (tmp_path / "f").write_text('data: {"choices":[{"delta":{"content":"x"}}]}\n\n: ping\n\ndata: {bad\n\ndata: [DONE]\n\n')
    frames = chat.read_frames(spark, str(tmp_path / "f"))
    assert [r.k for r in frames.select(chat.frame_kind(F.col("frame")).alias("k")).collect()] == ["data", "other", "other", "done"]
    chat.write_responses(spark.createDataFrame([('{"a": 1}',), ("<html>",), (None,)], "response string"), str(tmp_path / "out"))
    assert sorted(r.status for r in spark.read.json(str(tmp_path / "out")).collect()) == [200, 502, 502]
    state = chat.StateTables(spark, str(tmp_path / "state"), 4)
    state.append("originals", spark.createDataFrame([("a", "<E_1>", "x"), ("a_b", "<E_1>", "y")], "session string, tag string, original string"))
    assert [r.original for r in state.read("originals", "a").collect()] == ["x"] and state.read("originals").count() == 2
    (tmp_path / "pool.json").write_text('{"PERSON": ["A", "B"]}')
    assert [tuple(r) for r in chat.read_pool(spark, str(tmp_path / "pool.json")).collect()] == [("PERSON", ["A", "B"])]
    (tmp_path / "t.json").write_text('{"user": {"intro": ["I am {PERSON}"], "free": ["x", "y"]}}')
    assert chat.read_templates(spark, str(tmp_path / "t.json")).count() == 3
    (tmp_path / "c.json").write_text('[{"id": "1", "entities": {"PERSON": "A"}, "turns": [{"role": "user", "content": "x"}]}]')
    assert chat.read_conversations(spark, str(tmp_path / "c.json")).first().turns[0].content == "x"


def test_percentiles(spark):
    df = spark.createDataFrame([(g, v) for g in ("a", "b") for v in (range(1, 11) if g == "a" else [5] * 7)] + [("a", None)], "g string, v long")
    assert tuple(analytics.percentiles(df.where("g = 'a'"), "v", (50, 99)).first()) == (6, 10)
    assert {tuple(r) for r in analytics.percentiles(df, "v", (50, 99), ("g",)).collect()} == {("a", 6, 10), ("b", 5, 5)}
    assert tuple(analytics.percentiles(df.limit(0), "v", (50,)).first()) == (0,)


def test_log_lines(spark):
    lines = spark.createDataFrame([("[DEBUG] Pipeline: total=123ms, cache=1ms, regex=5ms, subst=15ms",), ("[DEBUG] Pipeline: total=3ms, cache=1ms, regex=0, ml=0, subst=0 (hit)",), ("[DEBUG] Restored 2 tags in 'ctx' for session X in 300µs",), ("[INFO] ML Inference: batchSize=16, 400ms (25ms/text)",), ("[2026][1s][info][gc] GC(1) Pause Young (Normal) 10M->5M(20M) 1.5ms",)], "value string")
    assert sorted((r.total_ms, r.subst_ms, r.hit) for r in analytics.pipeline_lines(lines).collect()) == [(3, 0, True), (123, 15, False)]
    assert analytics.restore_lines(lines).first().latency_us == 300 and analytics.inference_lines(lines).first().per_text_ms == 25
    r = analytics.gc_summary(analytics.gc_lines(lines.withColumn("n", F.monotonically_increasing_id())), "n").first()
    assert (r.n, r.max_ms, r.after_mb, r.total_mb) == (1, 1.5, 5, 20)
    assert analytics.hit_ratio(lines.limit(0), F.lit(True)).first().hit_rate == 0


def test_gc_pauses_by_type_and_unit(spark):
    head, rows = "[2026][1s][info][gc] GC(1) Pause ", ("Young (Normal) 2048K->1024K(4096K) 0.5ms", "Young (Normal) 1G->512M(2G) 2ms", "Full (System.gc()) 10M->5M(20M) 1.5ms")
    lines = spark.createDataFrame([(n, head + r) for n, r in enumerate(rows)] + [(9, "[2026][1s][info][gc] GC(2) Concurrent Mark Cycle 3ms"), (10, None)], "n int, value string")
    pauses = analytics.gc_lines(lines)
    assert [(r.before_mb, r.after_mb, r.total_mb, r.duration_ms, r.level) for r in pauses.orderBy("n").collect()] == [(2, 1, 4, 0.5, "info"), (1024, 512, 2048, 2.0, "info"), (10, 5, 20, 1.5, "info")]
    assert [tuple(r) for r in analytics.gc_counts(pauses).collect()] == [("Young", 2), ("Full", 1)]
    assert analytics.gc_counts(pauses.limit(0)).count() == 0


def test_workload(spark):
    pool = spark.createDataFrame([("A", ["1", "2"]), ("B", ["x"]), ("C", ["y"])], "type string, values array<string>")
    texts = spark.createDataFrame([("A", "a {A}"), ("B", "b {B}"), ("C", "c {C}"), (None, "free")], "type string, text string")
    make = lambda: sorted(map(tuple, analytics.workload(spark.range(20).withColumnRenamed("id", "conversation"), pool, texts, turns=6).collect()))
    rows = make()
    assert rows == make() and len(rows) == 120 and not any("{" in r[3] for r in rows) and all(r[3] != "free" for r in rows if r[1] == 0)
    assert P.TAG == r"<[A-Z_]+_\d+>"


def test_extension_points(spark):
    from cloakframe.operators import detect

    assert codec.codec(None) is codec.OpenAi is codec.codec("OpenAI") and codec.codec("cloakframe.operators.codec.OpenAi") is codec.OpenAi
    assert ner.decoder("cloakframe.operators.ner.decode_simple") is ner.decode_simple
    assert detect.resolve_names(["email", "cloakframe.operators.detect.phone", "no.such.detector", "none"]) == [detect.email, detect.phone]
    with pytest.raises(ValueError):
        codec.codec("no.such.Codec")
    frame = spark.range(1).select(codec.data_frame(F.lit("x"), None, F.array(F.struct(F.lit("d").alias("text")))).alias("f"))
    assert frame.first().f == 'data: {"choices":[{"delta":{"content":"x","reasoning_details":[{"text":"d"}]}}]}'
    assert [tuple(x) for x in frame.select(codec.chunk_fields(chat.frame_chunk(F.col("f"))).alias("c")).first().c] == [("content", "x"), ("reasoning_details", "d")]
