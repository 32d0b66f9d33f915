import time

import pytest
from hypothesis import given
from hypothesis import strategies as st

from cloakframe.operators import pseudonyms
from cloakframe.streaming import restore as R


def run(chunks):
    held, out = "", []
    for n, c in enumerate(chunks):
        ready, held = R.recut(held, c, n == len(chunks) - 1)
        out.append(ready)
    assert held == ""
    return out


@pytest.mark.parametrize("chunks, want", [
    (["hi <EMA", "IL_1> x"], ["hi ", "<EMAIL_1> x"]), (["<" + "A" * 60], ["<" + "A" * 60]), (["<" + "A" * 30, "A" * 30, "b"], ["", "<" + "A" * 60, "b"]), (["end 3 <5"], ["end 3 <5"]), (["a < b and <EMAIL", "_1>"], ["a < b and ", "<EMAIL_1>"]),
    (["<EMAIL_1> and <PHONE_1> ok"], ["<EMAIL_1> and <PHONE_1> ok"]), (["<a", "b"], ["<a", "b"]), (["", "x"], ["", "x"]), ([None, "x"], ["", "x"]),
])
def test_recut(chunks, want):
    assert run(chunks) == want


@given(st.text(alphabet="<>A_1 ab", max_size=60), st.lists(st.integers(1, 7), min_size=1, max_size=60))
def test_no_tag_is_cut(text, sizes):
    import re

    chunks, at = [], 0
    for s in sizes:
        chunks.append(text[at : at + s])
        at += s
    out = run([*chunks, text[at:]])
    assert "".join(out) == text
    tags = re.findall(r"<[A-Z_]+_\d+>", text)
    assert [t for part in out for t in re.findall(r"<[A-Z_]+_\d+>", part)] == tags


ROWS = [("s", "1", "content", 0, "hi <EMA", False), ("s", "1", "content", 1, "IL_1> and <PHO", False), ("s", "1", "content", 2, "NE_9> <EMAIL_1", True), ("t", "1", "content", 0, "<EMAIL_1>", True), ("s", "1", "reasoning", 0, "<EMAIL", False), ("s", "1", "reasoning", 1, "_1>", True)]
WANT = {("s", "content"): "hi a@b.com and <PHONE_9> <EMAIL_1", ("t", "content"): "<EMAIL_1>", ("s", "reasoning"): "a@b.com"}


def test_batch(spark):
    originals = spark.createDataFrame([("s", "<EMAIL_1>", "a@b.com")], "session string, tag string, original string")
    ready = R.recut_batch(spark.createDataFrame(ROWS, R.FRAGMENT)).selectExpr("*", "concat_ws(':', session, stream, key, seq) AS row")
    back = pseudonyms.restore(ready, originals, id_col="row", session="session", text="text")
    got = R.full_texts(back.drop("text", "row").withColumnRenamed("restored", "text"))
    assert {(r.session, r.key): r.text for r in got.collect()} == WANT


def test_stream_equals_batch(spark, tmp_path):
    originals = spark.createDataFrame([("s", "<EMAIL_1>", "a@b.com")], "session string, tag string, original string")
    found = []
    for n in range(3):  # fragments arrive in three batches
        spark.createDataFrame([r for r in ROWS if r[3] == n], R.FRAGMENT).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(R.FRAGMENT).parquet(str(tmp_path / "in"))
        query = R.restore_stream(stream, originals, lambda df, _: found.extend(df.collect()), str(tmp_path / "check"))
        query.awaitTermination()
    texts = {}
    for r in sorted(found, key=lambda r: r.seq):
        texts[r.session, r.key] = texts.get((r.session, r.key), "") + r.restored
    assert texts == WANT


def test_tags_that_are_added_while_a_stream_runs(spark, tmp_path):
    from cloakframe.sources.chat import StateTables

    state, found = StateTables(spark, f"file://{tmp_path}/state", parts=2), []
    row = lambda n: spark.createDataFrame([("s", f"<EMAIL_{n}>", f"{n}@x.com")], "session string, tag string, original string")
    state.append("originals", row(1))
    source = str(tmp_path / "in")
    spark.createDataFrame([("s", "1", "content", 0, "<EMAIL_1> <EMAIL_2>", True)], R.FRAGMENT).coalesce(1).write.parquet(source)

    def sink(df, batch):
        found.extend((r.stream, r.restored) for r in df.collect())
        if len(found) == 1:  # inside the running query
            state.append("originals", row(2))
            spark.createDataFrame([("s", "2", "content", 0, "hi <EMAIL_2>", True)], R.FRAGMENT).coalesce(1).write.mode("append").parquet(source)

    stream = spark.readStream.schema(R.FRAGMENT).option("maxFilesPerTrigger", 1).parquet(source)
    query = R.restore_stream(stream, lambda: state.read("originals"), sink, str(tmp_path / "check"), available_now=False)
    try:
        for _ in range(240):  # its batches never run out: it is watched, not awaited
            if len(found) > 1 or query.exception():
                break
            time.sleep(0.25)
    finally:
        query.stop()
    assert found == [("1", "1@x.com <EMAIL_2>"), ("2", "hi 2@x.com")]


def test_frames_are_restored(spark, tmp_path):
    import json

    from cloakframe.sources.chat import StateTables

    state = StateTables(spark, f"file://{tmp_path}/state", parts=2)
    chunk = lambda **delta: "data: " + json.dumps({"id": 7, "choices": [{"index": 0, "delta": {"role": "x", **delta}}, {"delta": {"content": "<EMAIL_1>"}}]}, separators=(",", ":"))
    details = lambda *t: [{"text": x, "type": "k"} for x in t]
    sent = [chunk(content="a <EMA", reasoning="<EMAIL"), ": <EMAIL_1>", "data: {no", chunk(content="IL_1> <EMAIL_9>", reasoning_details=details("<EMA", "IL_1>!")), "data: {}", chunk(reasoning="_1> é <PHO"), "data: [DONE]"]
    rows = [("s", "1", n, f) for n, f in enumerate(sent)] + [("t", "2", 0, chunk(content="<EMAIL_1>"))]
    originals = spark.createDataFrame([("s", "<EMAIL_1>", 'q"@x.com')], "session string, tag string, original string")
    got = {(r.stream, r.seq): r.frame for r in R.restore_frames(spark.createDataFrame(rows, "session string, stream string, seq long, frame string"), originals, state).collect()}
    want = [chunk(content="a ", reasoning=""), ": <EMAIL_1>", "data: {no", chunk(content='q"@x.com <EMAIL_9>', reasoning_details=details("", 'q"@x.com!')), "data: {}", chunk(reasoning='q"@x.com é <PHO'), "data: [DONE]"]
    parsed = lambda f: json.loads(f[6:]) if f.startswith("data: {") and f != "data: {no" else f
    assert [parsed(got["1", n]) for n in range(7)] == [parsed(f) for f in want]
    assert parsed(got["2", 0]) == parsed(rows[-1][3])
    # the whole texts of the stream that has ended are known to the cache
    assert {(r.session, r.anonymized) for r in state.read("cache").collect()} == {("s", "a <EMAIL_1> <EMAIL_9>"), ("s", "<EMAIL_1>!"), ("s", "<EMAIL_1> é <PHO")}
