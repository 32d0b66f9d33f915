import pytest
from pyspark.sql import functions as F

from cloakframe.config import Config
from cloakframe.functions.similarity import ByType, JaroWinkler, exact, jaro_winkler, resolution, similarity_index
from cloakframe.operators import pseudonyms as S
from cloakframe.plans import pipeline
from cloakframe.sources.chat import StateTables

JW = JaroWinkler(0.88)


@pytest.mark.parametrize("a, b, score", [("Johnson", "John", 0.914286), ("Martha", "Marhta", 0.961111), ("Johnathan", "Jonathan", 0.903704), ("Johnathan", "John", 0.888889), ("Alexander", "John", 0.453704), ("555-123-4567", "555-123-4568", 0.966667), ("James", "Janes", 0.893333), ("A" * 50 + "B" * 20, "A" * 50 + "C" * 20, 0.885714), ("", "a", 0), ("a", "a", 1), ("a", "b", 0), ("ab", "ba", 0)])
def test_similarity(a, b, score):
    assert jaro_winkler(a, b) == pytest.approx(score, abs=1e-6)


def test_lookups():
    assert exact("EMAIL", "a", ["a", "b"]) == "a" and exact("EMAIL", "c", ["a"]) is None and exact("EMAIL", None, ["a"]) is None
    assert JW("PERSON", "Johnson", ["John", "Jane"]) == "John" and JW("PERSON", "Alexander", ["John", "Jane"]) is None and JW("PERSON", "Martha", ["Marhta"]) == "Marhta"
    assert JW("PERSON", "A" * 50 + "B" * 20, ["A" * 50 + "C" * 20]) and JW("PERSON", "Johnathan", ["John", "Jonathan", "Jane"]) == "Jonathan"
    assert JW("PERSON", "John", [""]) is None and JW("PERSON", None, ["John"]) is None and JW("PERSON", "  ", ["John"]) is None
    typed = ByType(JW, ["PERSON"])
    assert typed("PERSON", "Johnson", ["John"]) == "John" and typed("PHONE", "555-1234", ["555-1235"]) is None and typed("PHONE", "1", ["1"]) == "1"


def test_strategies_by_name():
    assert resolution(None) is exact and resolution(" ") is exact and resolution("EXACT") is exact
    assert isinstance(resolution("jaro-winkler", 0.5), JaroWinkler) and isinstance(resolution("jaro-winkler", 0.5, ["PERSON"]), ByType)
    assert resolution("cloakframe.functions.similarity.JaroWinkler", 0.7).threshold == 0.7 and resolution("cloakframe.functions.similarity.exact") is exact
    for bad in ("no.such.Thing", "cloakframe.functions.similarity.NoSuch", "builtins.str"):
        with pytest.raises(ValueError):
            resolution(bad)


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, session string, text string")


def test_numbers_and_restoring(spark):
    df = frame(spark, [(1, "s", "a@b.com then c@d.com"), (2, "s", "c@d.com and 10.0.0.1"), (3, "t", "c@d.com"), (4, "s", None), (5, "s", "  "), (6, None, "x@y.com"), (7, "s_1", "q@r.com")])
    done, tags = pipeline.anonymize(df, Config(resolution="exact"), id_col="id", session="session")
    got = {r.id: r.anonymized for r in done.collect()}
    assert got == {1: "<EMAIL_1> then <EMAIL_2>", 2: "<EMAIL_2> and <IP_ADDRESS_1>", 3: "<EMAIL_1>", 4: None, 5: "  ", 6: "<EMAIL_1>", 7: "<EMAIL_1>"}
    back = pipeline.restore(done, tags, id_col="id", session="session")
    assert all(r.text == r.restored for r in back.collect())
    unknown = S.restore(frame(spark, [(1, "s", "<EMAIL_9> <EMAIL_1>")]), S.originals(tags), id_col="id", session="session", text="text").first()
    assert unknown.restored == "<EMAIL_9> a@b.com"
    left = {r.session for r in S.clear_session(S.originals(tags), spark.createDataFrame([("s",)], "session string")).collect()}
    assert left == {"t", None, "s_1"}
    assert pipeline.anonymize(df.limit(0), Config(resolution="exact"), id_col="id", session="session")[0].count() == 0


def test_numbering_in_buckets_equals_numbering_at_once(spark):
    df = frame(spark, [(n, f"s{n % 2}", f"u{n * 7 % 40}@b.com u{n * 3 % 40}@b.com") for n in range(200)])
    found = pipeline.detected(df, Config(resolution="exact"))
    entities = S.exploded(found, session="session", order="id")
    rows = lambda b: sorted((r.session, r.value, r.n) for r in S.numbered(S.first_seen(entities), b).collect())
    assert rows(7) == rows(10_000)


def test_aliases_share_tags_and_chain(spark):
    rows = [("s", "PERSON", "John", (1, 0, 0)), ("s", "PERSON", "Johnson", (2, 0, 0)), ("s", "PERSON", "Johnsons", (3, 0, 0)), ("s", "PERSON", "Mary", (4, 0, 0)), ("s", "PHONE", "555-123-4567", (5, 0, 0)), ("s", "PHONE", "555-123-4568", (6, 0, 0)), ("t", "PERSON", "Johnson", (1, 0, 0))]
    e = spark.createDataFrame(rows, "session string, type string, value string, pos struct<order:long,field:int,start:int>")
    tags = S.assign(e, JW, ("PERSON",))
    got = {(r.session, r.value): r.tag for r in tags.collect()}
    assert got == {("s", "John"): "<PERSON_1>", ("s", "Johnson"): "<PERSON_1>", ("s", "Johnsons"): "<PERSON_1>", ("s", "Mary"): "<PERSON_2>", ("s", "555-123-4567"): "<PHONE_1>", ("s", "555-123-4568"): "<PHONE_2>", ("t", "Johnson"): "<PERSON_1>"}
    assert {r.original for r in S.originals(tags).where("session = 's' and tag = '<PERSON_1>'").collect()} == {"John"}
    assert S.assign(e, JW, None).where("value = '555-123-4568'").first().tag == "<PHONE_1>"


def test_cache(spark):
    df = frame(spark, [(1, "s", "a"), (2, "s", "a"), (3, "t", "a")]).withColumn("anonymized", F.col("text"))
    cache = S.cache_entries(df.where("session = 's'"), session="session", text="text", anonymized="anonymized")
    assert cache.count() == 1
    got = {r.id: r.anonymized for r in S.cache_lookup(df.drop("anonymized"), cache, session="session", text="text").collect()}
    assert got == {1: "a", 2: "a", 3: None}


def test_substitution(spark):
    tagged = lambda *s: F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(t).alias("tag")) for a, b, t in s))
    show = lambda text, *s: spark.range(1).select(S.substituted(F.lit(text), tagged(*s)).alias("t")).first().t
    assert show("my email is test@mail.com", (12, 25, "<EMAIL_1>")) == "my email is <EMAIL_1>"
    assert show("email a@b.com phone 1234567890", (6, 13, "<EMAIL_1>"), (20, 30, "<PHONE_1>")) == "email <EMAIL_1> phone <PHONE_1>"
    assert show("Alice met Bob", (0, 5, "<PERSON_1>"), (10, 13, "<PERSON_2>")) == "<PERSON_1> met <PERSON_2>"
    hashed = spark.range(1).select(S.text_hash(F.lit("abc")).alias("h")).first().h
    assert hashed == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"


def test_a_model_label_names_the_tag(spark):
    ml = F.array(F.struct(F.lit(5).alias("start"), F.lit(11).alias("end"), F.lit("MODEL").alias("type"), F.lit("LOCATION").alias("raw_type"), F.lit("Berlin").alias("value")))
    done, _ = pipeline.anonymize(frame(spark, [(1, "s", "city Berlin")]), Config(), id_col="id", session="session", ml=ml)
    assert done.first().anonymized == "city <LOCATION_1>"


def test_a_session_goes_on(spark, tmp_path):
    state = StateTables(spark, f"file://{tmp_path}/state", parts=3)
    one = lambda rows: {r.id: r.anonymized for r in pipeline.anonymize_cached(frame(spark, rows), Config(resolution="exact"), state, id_col="id", session="session").collect()}
    assert one([(1, "s", "a@x.com"), (2, None, "n@x.com"), (3, "s", " "), (4, "s", None)]) == {1: "<EMAIL_1>", 2: "<EMAIL_1>", 3: " ", 4: None}
    assert one([(5, "s", "b@y.com, a@x.com"), (6, "s", "a@x.com"), (7, "s_1", "b@y.com"), (8, None, "m@x.com")]) == {5: "<EMAIL_2>, <EMAIL_1>", 6: "<EMAIL_1>", 7: "<EMAIL_1>", 8: "<EMAIL_2>"}
    assert state.read("cache").count() == 6 - 1  # the sixth was there, the third and the fourth are blank
    back = pipeline.restore_cached(frame(spark, [(1, "s", "see <EMAIL_2> and <EMAIL_1>")]), state, id_col="id", session="session", text="text").first()
    assert back.restored == "see b@y.com and a@x.com"
    assert state.read("cache").where("anonymized = 'see <EMAIL_2> and <EMAIL_1>'").count() == 1
    state.append("tags", spark.createDataFrame([("s", "EMAIL", "late@x.com", "<EMAIL_7>", None)], StateTables.SCHEMAS["tags"]))
    assert one([(9, "s", "new@x.com late@x.com"), (10, "s", "see b@y.com and a@x.com")]) == {9: "<EMAIL_8> <EMAIL_7>", 10: "see <EMAIL_2> and <EMAIL_1>"}
    state.clear(spark.createDataFrame([("s",)], "session string"))
    assert {r.session for name in state.NAMES for r in state.read(name).collect()} == {"s_1", None}
    assert one([(11, "s", "z@x.com")]) == {11: "<EMAIL_1>"}
    state.clear(spark.createDataFrame([("s",), ("s_1",)], "session string"))
    assert {r.session for name in state.NAMES for r in state.read(name).collect()} == {None}


def test_a_text_that_the_model_failed_on_is_not_cached(spark, tmp_path):
    state = StateTables(spark, f"file://{tmp_path}/state", parts=2)
    span = F.struct(F.lit(0).alias("start"), F.lit(3).alias("end"), F.lit("MODEL").alias("type"), F.lit("PERSON").alias("raw_type"), F.lit("Ada").alias("value"))
    ml = F.when(F.col("id") != 1, F.array(span))
    df = frame(spark, [(1, "s", "Ada a@x.com"), (2, "s", "Ada b@x.com")])
    got = {r.id: r.anonymized for r in pipeline.anonymize_cached(df, Config(resolution="exact"), state, id_col="id", session="session", ml=ml).collect()}
    assert got == {1: "Ada <EMAIL_1>", 2: "<PERSON_1> <EMAIL_2>"}
    assert [r.anonymized for r in state.read("cache").collect()] == ["<PERSON_1> <EMAIL_2>"]


def test_aliases_go_on(spark):
    rows = lambda *v: spark.createDataFrame([("s", kind, value, (n, 0, 0)) for n, (kind, value) in enumerate(v)], "session string, type string, value string, pos struct<order:long,field:int,start:int>")
    known = S.assign(rows(("PERSON", "John"), ("PERSON", "Mary"), ("PHONE", "1")), JW, ("PERSON",))
    got = {r.value: r.tag for r in S.assign(rows(("PERSON", "Johnson"), ("PERSON", "Alexander"), ("PERSON", "Mary"), ("PHONE", "2")), JW, ("PERSON",), known).collect()}
    assert got == {"Johnson": "<PERSON_1>", "Alexander": "<PERSON_3>", "2": "<PHONE_2>"}


def test_values_that_are_never_scored_can_not_be_similar():
    import random

    rng = random.Random(4)
    for seed in range(30):
        index, known = similarity_index(JW), {}
        for _ in range(60):
            value = "".join(rng.choice("abcde é\U0001f600") for _ in range(rng.randint(0, 12))) * rng.choice((1, 1, 1, 30))
            assert index.find("X", value) == JW("X", value, known)
            index.add(value)
            known[value] = None


def test_texts_are_detected_once(spark):
    df = frame(spark, [(n, "s", f"a{n}@x.com and 10.0.0.{n}") for n in range(4)])
    found = pipeline.hits(df, Config(resolution="exact"), id_col="id", session="session", order="id")
    assert found.count() == 8
    done, tags = pipeline.anonymize(df, Config(resolution="exact"), id_col="id", session="session")
    for plan in (done, tags):
        assert "regexp_extract_all" not in plan._jdf.queryExecution().optimizedPlan().toString()
    each = pipeline.detected(df, Config(resolution="exact")).select("id", F.explode_outer("spans").alias("s"))
    assert each._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 4
