import pytest
from pyspark.sql import functions as F

from cloakframe.config import Config, ConflictStrategy
from cloakframe.functions import patterns as P
from cloakframe.operators import detect
from cloakframe.operators.resolve import resolve


def one(spark, text, detector):
    return [(s.start, s.end, s.value) for s in spark.createDataFrame([(text,)], "t string").select(detector(F.col("t")).alias("s")).first().s]


@pytest.mark.parametrize("detector, text, values", [
    (detect.email, "contact me at john@example.com please", ["john@example.com"]), (detect.email, "send to user@mail.server.example.com", ["user@mail.server.example.com"]), (detect.email, "john+tag@gmail.com", ["john+tag@gmail.com"]),
    (detect.email, "this is not an email", []), (detect.email, "write to a@b.com or c@d.com", ["a@b.com", "c@d.com"]), (detect.email, None, []), (detect.email, " \n", []),
    (detect.phone, "call +1-555-123-4567 now", ["+1-555-123-4567"]), (detect.phone, "phone: (555) 123-4567 now", ["(555) 123-4567"]), (detect.phone, "tel: 555-123-4567 now", ["555-123-4567"]), (detect.phone, "number 12345", []),
    (detect.credit_card, "card: 4111111111111111", ["4111111111111111"]), (detect.credit_card, "card: 5500000000000004", ["5500000000000004"]), (detect.credit_card, "card: 1234567890123456", []), (detect.credit_card, "card: 123456789012", []),
    (detect.credit_card, "card: 4111-1111-1111-1111", ["4111-1111-1111-1111"]), (detect.credit_card, "card: 4111 1111 1111 1111", ["4111 1111 1111 1111"]),
    (detect.ip_address, "server at 192.168.1.1 running", ["192.168.1.1"]), (detect.ip_address, "connect to 127.0.0.1:8080", ["127.0.0.1"]), (detect.ip_address, "broadcast 255.255.255.255", ["255.255.255.255"]), (detect.ip_address, "invalid 256.1.1.1 address", []),
    (detect.ip_address, "from 10.0.0.1 to 10.0.0.2", ["10.0.0.1", "10.0.0.2"]), (detect.ip_address, "é10.0.0.1", ["10.0.0.1"]),
])
def test_detectors(spark, detector, text, values):
    found = one(spark, text, detector)
    assert [v for _, _, v in found] == values
    assert all(text[a:b] == v for a, b, v in found)


def test_offsets_are_code_points_and_any_character_may_stand_in_a_text(spark):
    text = "😀\x01 a@b.com \x01 c@d.com"
    assert one(spark, text, detect.email) == [(3, 10, "a@b.com"), (13, 20, "c@d.com")]


def spans(*rows, ml=False):
    return F.array(*(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit("MODEL" if ml else kind).alias("type"), F.lit(kind).alias("raw_type"), F.lit("x").alias("value")) for kind, a, b in rows)) if rows else F.array().cast(P.NO_SPANS)


@pytest.mark.parametrize("regex, ml, strategy, kept", [
    ([("EMAIL", 0, 10)], [("PERSON", 0, 10)], "REGEX_PRIORITY", [("EMAIL", 0, 10)]), ([("PERSON", 0, 5)], [("EMAIL", 0, 10)], "LONGEST_WINS", [("EMAIL", 0, 10)]), ([("PERSON", 0, 5)], [("EMAIL", 10, 20)], "LONGEST_WINS", [("PERSON", 0, 5), ("EMAIL", 10, 20)]),
    ([], [("PERSON", 0, 5)], "LONGEST_WINS", [("PERSON", 0, 5)]), ([("EMAIL", 0, 10)], [], "REGEX_PRIORITY", [("EMAIL", 0, 10)]), ([("EMAIL", 0, 10)], [("PERSON", 5, 15), ("PHONE", 20, 30)], "LONGEST_WINS", [("EMAIL", 0, 10), ("PHONE", 20, 30)]),
    ([], [], "LONGEST_WINS", []), ([("PERSON", 5, 8)], [("EMAIL", 5, 20)], "LONGEST_WINS", [("EMAIL", 5, 20)]), ([("EMAIL", 4, 12)], [("PERSON", 0, 8)], "REGEX_PRIORITY", [("PERSON", 0, 8)]), ([("EMAIL", 0, 5)], [("PERSON", 0, 9)], "REGEX_PRIORITY", [("EMAIL", 0, 5)]),
    ([("PHONE", 0, 16), ("CREDIT_CARD", 0, 16)], [], "LONGEST_WINS", [("PHONE", 0, 16)]),
])
def test_resolution(spark, regex, ml, strategy, kept):
    got = spark.range(1).select(resolve(spans(*regex), spans(*ml, ml=True), ConflictStrategy[strategy]).alias("s")).first().s
    assert [(s.raw_type, s.start, s.end) for s in got] == kept


def test_kept_spans_are_disjoint_and_sorted(spark, sf_dir):
    found = spark.read.parquet(f"{sf_dir}/documents.parquet").select(resolve(detect.chain(F.col("text"), Config().filters), None, ConflictStrategy.LONGEST_WINS).alias("s"))
    for r in found.collect():
        assert all(a.end <= b.start for a, b in zip(r.s, r.s[1:], strict=False))


def test_filters_by_name(spark):
    detect.register("digits", lambda t: P.scan(t, r"\d+", "DIGITS"))
    try:
        assert [s.type for s in spark.range(1).select(detect.chain(F.lit("a@b.com 12"), ("digits", "no_such", "email")).alias("s")).first().s] == ["DIGITS", "EMAIL"]
    finally:
        del detect.REGISTRY["digits"]
    assert spark.range(1).select(detect.chain(F.lit("a@b.com"), ()).alias("s")).first().s == []


def test_options():
    c = Config.from_mapping({"pipeline": {"filters": {"email": True, "phone": False}, "conflict_strategy": "regex_priority", "entity_resolution": {"threshold": 0.9}}, "providers": {"x": {"host": "h"}}, "ml": {"tag_mapping": {"PER": "PERSON"}}})
    assert c.filters == ("email", "credit_card", "ip_address") and c.conflict_strategy is ConflictStrategy.REGEX_PRIORITY and c.threshold == 0.9 and c.providers[0].port == 443
    assert ConflictStrategy.parse(None) is ConflictStrategy.LONGEST_WINS and ConflictStrategy.parse("odd") is ConflictStrategy.LONGEST_WINS
    assert Config.from_mapping({"pipeline": {"filters": {"names": ["ip_address", "email"]}}}).filters == ("ip_address", "email")
    with pytest.raises(ValueError):
        Config(ml_tag_mapping={"PER": "Person1"})


def test_options_from_a_file(tmp_path):
    (tmp_path / "c.json").write_text('{"server": {"port": 9000}}')
    assert Config.load(str(tmp_path / "c.json")).server_port == 9000
