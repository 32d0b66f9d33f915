"""Top-k search, language, quality, archives and page texts."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloakframe.llm import html_text, langid, quality, topk, warc
from cloakframe.llm.queries import QUERIES


def plain_top_k(rows, k=5, scale=256):
    ok = [(i, [int(np.floor(np.float64(x) * scale)) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in ok:
        if q % 2 == 0:
            score = lambda w: max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w, strict=True))))  # noqa: B023, E731
            best = sorted((-score(w), i) for i, w in ok if i != q and len(w) == len(v))[:k]
            out += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("kind", ["plain", "copies", "huge"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(4)
    v = rng.normal(0, 1, (150, 8)).astype(np.float32)
    if kind == "copies":
        v[20:140] = v[20]
    if kind == "huge":
        v *= np.float32(1e12)
    rows = [(n, [float(x) for x in row]) for n, row in enumerate(v)] + [(500, None), (502, [1.0] * 7 + [None]), (504, [1.0] * 7 + [float("nan")]), (506, [float("inf")] * 8), (None, [1.0] * 8), (508, [1.0, 2.0]), (510, [3.0, 4.0]), (512, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "shard": F.lit(0), "q": F.lit(0)})
    got = topk.top_k(df, df.where("vec_id % 2 = 0"), shard_rows=40, block_rows=30, leaf_rows=8)
    assert sorted(tuple(r) for r in got.collect()) == plain_top_k(rows)
    if kind == "plain":
        assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
        assert topk.top_k(df, df.limit(0)).count() == 0


def test_language(spark, sf_dir):
    got = QUERIES["op6_language"](spark, sf_dir).toPandas()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").toPandas()
    both = got.merge(docs, on="doc_id")
    assert len(got) == len(docs) and ((both.held_out) == [zlib.crc32(str(i).encode()) % 3 == 1 for i in both.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.95 and both.score.between(0, 1).all()


def test_language_edges(spark):
    rows = [(1, "the of and", "en"), (2, "der die das", "de"), (3, None, "en"), (4, "", None), (5, "123 !!", "de"), (6, "the " * 200_000, None), (None, "der und die", "de"), (1, "the of and", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"id": F.lit(1), "p": F.lit(2)})
    model = langid.train(df)
    got = df.select("doc_id", "text", langid.predict(F.col("text"), model).alias("g")).collect()
    assert [r.g.lang_pred for r in got if not r.text or r.text == "123 !!"] == ["und"] * 3
    assert next(r for r in got if r.doc_id == 6).g.lang_pred == "en"
    empty = langid.train(df.limit(0))
    assert {(r.g.lang_pred, r.g.score) for r in df.select(langid.predict(F.col("text"), empty).alias("g")).collect()} == {("und", 0.0)}


def test_quality(spark):
    got = QUERIES["op9_quality"](spark, "/root/testdata/sf0.01").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got.merge(labels, on="doc_id")
    held = both[both.held_out]
    assert (held.predicted == held.quality).mean() > 0.85 and (held[held.quality == 1].predicted == 1).mean() > 0.9
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, "Good text here."), (2, None), (3, ""), (4, "bad !! " * 50_000), (None, "x"), (1, "Good text here.")], "doc_id long, text string").withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(1, 1, 0), (4, 0, 1), (None, 1, None), (9, None, 0)], "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash"))
    for own in (labels, labels.limit(0)):
        model = quality.train(docs, own)
        scores = [r.s for r in docs.select(quality.score(F.col("text"), model).alias("s")).collect()]
        assert len(scores) == 6 and all(0 <= s <= 1 for s in scores) and scores[1] == scores[2]
    assert quality.train(docs.limit(0), labels).prior == 0


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(2, 1, (2000, 5)), rng.normal(-2, 1, (2000, 5))
    model = quality.fit(good[:1000], np.concatenate([good[1000:1700], bad[:300]]))
    assert abs(model.prior - 0.7) < 0.12
    wrong = ((good[1700:] @ model.weights + model.bias) < 0).mean() + ((bad[300:] @ model.weights + model.bias) > 0).mean()
    assert wrong < 0.05


def test_warc(spark):
    long = "<p>" + "é" * 800 + "</p>"
    rows = [(1, "http://a", long), (2, "http://b", long), (7, None, long), (3, "c", "short"), (4, "d", "short"), (5, "e", None), (6, "f\r\nX: y", ""), (None, "g", long), (8, "h", "z" * 3_000_000), (9, "i", "\r\n\r\n" * 500), (7, "dup", long)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"id": F.lit(1), "record_type": F.lit("x"), "frame": F.lit(0)})
    folder = warc.archive_folder(spark)
    index = warc.write_archive(pages.repartition(2), folder)
    got = warc.read_archive(index, folder).collect()
    assert len(got) == len(rows)
    for r in got:
        page = [h or "" for i, _, h in rows if i == r.page_id]
        assert r.payload_bytes == len(page[0].encode()) and r.payload_digest == hashlib.sha1(page[0].encode()).hexdigest()
        assert r.record_type == ("revisit" if r.page_id in (1, 2, None) else "response") and r.refers_to == (7 if r.record_type == "revisit" else None)
        assert (bytes(r.payload).decode() == page[0]) if r.record_type == "response" else r.payload is None
    assert {r.url for r in got if r.page_id == 6} == {"f%0D%0AX: y"}
    empty = warc.archive_folder(spark)
    assert warc.read_archive(warc.write_archive(pages.limit(0), empty), empty).count() == 0
    assert len(set(r.frame for r in index.collect())) > 1


@pytest.mark.parametrize("source, text", [
    (None, None), ("", ""), ("plain", "plain"), ("a<br>b", "a\nb"), ("<p>a<p>b", "a\n\nb"), ("<b>a</b> <i>b</i>", "a b"),
    ("<ul><li>x<li>y<ul><li>z</ul></ul>", "- x\n- y\n  - z"), ("<ol start=3><li>x<li>y</ol>", "3. x\n4. y"),
    ("<table><tr><th>N<th>Val<tr><td>long<td>1</table>", "N     Val\nlong  1"), ("<table><td>a<td>b<tr><td>c</table>", "a  b\nc"),
    ("<div hidden>no</div><p style='display: none'>no</p>yes<script>no</script><!-- no --><style>no</style>", "yes"), ("<head><title>t</title></head><body>x", "x"),
    ("<pre>a\n  b</pre>", "a\n  b"), ("1 < 2 &amp; 3 &gt; 2", "1 < 2 & 3 > 2"), ("<img alt='pic'> x", "pic x"), ("<dl><dt>t<dd>d</dl>", "t\n  d"), ("a</p>b", "a\n\nb"), ("<div>a<span>b</div>c", "ab\nc"), ("<select><option>x</select>y", "y"),
    ("<p>one\n  two</p>", "one two"), ("<textarea>a <b></textarea>", "a <b>"), ("<a href='x>y'>z</a>", "z"), ("x<script>var t='</p>'", "x"),
])
def test_page_texts(source, text):
    assert html_text.extract(source) == text


@pytest.mark.parametrize(("source", "text"), [
    ("<math><mi>x</mi><mo>=</mo><mn>2</mn></math>", "x=2"), ("<svg><title>no</title><defs><text>no</text></defs><text>axis</text></svg> y", "axis y"),
    ("<i aria-hidden='true'>icon</i> y", "icon y"), ("<div style='visibility: hidden'>no <b style='visibility:visible'>yes</b> no</div>", "yes"),
    ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"), ("<div style='visibility:hidden'><img alt='no'></div>a", "a"),
])
def test_what_browsers_show_is_kept(source, text):
    assert html_text.extract(source) == text


def test_pages_never_fail(spark):
    rng = np.random.default_rng(2)
    parts = ["<", ">", "</", "table", "tr", "td", "<p>", "</div>", "<!--", "-->", "&amp", "'", '"', "=", " x", "<li>", "</table>", "<td>", "<select>", "<![CDATA[", "<svg/>", "\x00"]
    for _ in range(2000):
        html_text.extract("".join(rng.choice(parts, 30)))
    assert html_text.extract("<div>" * 20_000 + "x") == "x"
    df = spark.createDataFrame([(1, "<p>a"), (2, None), (None, "<p>a"), (1, "<p>a")], "page_id long, html string").withColumn("text", F.lit("clash"))
    assert sorted(str(r.t) for r in df.select(html_text.html_text(F.col("html")).alias("t")).collect()) == ["None", "a", "a", "a"]


def test_no_visible_text_is_lost(spark, sf_dir):
    """Against a plain rule: the words outside of tags, scripts, styles, comments and the head."""
    import re
    from html import unescape

    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        body = re.sub(r"(?s)<!--.*?-->|<(script|style|head|select|svg|noscript|template)\b.*?</\1>", " ", r.html)
        if re.search(r"display:\s*none|\bhidden\b|visibility", body):
            continue
        assert unescape(re.sub(r"<[^>]*>", " ", body)).split() == [w for line in html_text.extract(r.html).split("\n") for w in re.sub(r"^\s*(- |\d+\. )", "", line).split()]


def test_tables_of_any_shape():
    from cloakframe.llm.html_text import extract

    table = "<table><tr><td>a</td><td colspan=2>wide one</td><td>z</td></tr><tr><td rowspan=2>down</td><td>x</td><td>y</td></tr><tr><td>1</td><td>2</td></tr></table>"
    lines = extract(table).split("\n")
    assert [line.split() for line in lines] == [["a", "wide", "one", "z"], ["down", "x", "y"], ["1", "2"]]
    assert lines[1].index("x") == lines[2].index("1") == lines[0].index("wide") and lines[1].index("y") == lines[2].index("2")
    long = "w " * 500_000
    page = f"<table><tr><td>{long}</td><td>end</td></tr>" + "<tr><td>k</td><td>v</td></tr>" * 2000 + "</table>"
    out = extract(page)
    assert len(out) < 1.5 * len(page) and out.split("\n")[0].endswith("w  end") and out.split("\n")[1] == "k" + " " * 81 + "v"
    deep = "<table><tr>" + "<td>c" * 500 + "<td>" + "l<br>" * 20_000 + "</tr></table>"
    out = extract(deep)
    assert len(out) < 10 * len(deep) and out.split().count("l") == 20_000 and out.split().count("c") == 500
    assert extract("<ol><li>a<li value=7>b<li>c</ol>") == "1. a\n7. b\n8. c"
    assert extract("<table></table>") == extract("<table><tr></tr></table>") == ""


def test_queries_that_are_rows(spark):
    rows = [(50, [1.0, 0.0]), (50, [1.0, 0.0]), (50, [0.5, 0.0]), (7, [0.25, 0.0]), (None, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 50, k=2).collect())
    assert got == sorted([(1, 50, 65536), (2, 50, 32768)] * 2 + [(1, 50, 32768), (2, 50, 32768)])


def test_samples_are_bounded(spark):
    from cloakframe.llm.hashed import bounded_sample

    df = spark.createDataFrame([(1, f"t{n % 40}") for n in range(200)], "id long, text string")
    assert bounded_sample(df, "id", 30).count() == 30 and bounded_sample(df, "id", 500).count() == 200
    assert bounded_sample(df.limit(0), "id", 5).count() == 0
