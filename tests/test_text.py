from pyspark.sql import functions as F

from recallgrid.functions import text


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_squeeze_and_key(spark):
    assert value(spark, text.squeeze(F.lit("  A   b\n C "))) == "a b c"
    assert value(spark, text.dedupe_key(F.lit("A" * 200))) == "a" * 160
    assert value(spark, text.dedupe_key(F.lit(None).cast("string"))) == ""


def test_tokens_measure_before_signs_come_off(spark):
    assert sorted(value(spark, text.tokens(F.lit("Hello, hello (it) ... ab \"Deep\"")))) == ["", "deep", "hello", "it"]
    assert value(spark, text.tokens(F.lit(None).cast("string"))) == []


def test_jaccard(spark):
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert abs(value(spark, text.jaccard(a, b)) - 1 / 3) < 1e-12
    assert value(spark, text.jaccard(a, F.array().cast("array<string>"))) == 0.0


def test_content_words(spark):
    assert value(spark, text.content_words(F.lit("The quick, (brown) fox is at a pond!"))) == "quick brown fox pond"


def test_names_and_keys(spark):
    assert value(spark, text.normalize_name(F.lit("The Acme-Widgets, Inc."))) == "acme widgets"
    assert value(spark, text.normalize_name(F.lit("LLC"))) == ""
    assert value(spark, text.domain_of(F.lit("https://www.Example.com:80/a"))) == "example.com"
    assert value(spark, text.domain_of(F.lit("me@mail.example.org"))) == "mail.example.org"
    assert value(spark, text.domain_of(F.lit("localhost"))) is None
    assert value(spark, text.phone_key(F.lit("+1 (555) 010-0199"))) == "5550100199"
    assert value(spark, text.phone_key(F.lit("555"))) is None
    keys = value(spark, text.merge_keys(F.lit("acme"), F.lit(None).cast("string"), F.lit("A@b.co"), F.lit("555 010 0199 12")))
    assert keys == ["domain:b.co", "email:a@b.co", "phone:5010019912", "norm:acme"]
    assert value(spark, text.display_name(F.lit("  'Acme   Corp.' "))) == "Acme Corp"


def test_vid_and_event_names(spark):
    assert value(spark, text.fact_id_of(F.lit("gist_12"))) == 12
    assert value(spark, text.fact_id_of(F.lit("situation_12"))) is None
    assert value(spark, text.event_name(F.lit("Trip to Lake Garda"), F.lit("2026-08-13T10:00"))) == "Trip to Lake Garda (2026-08-13)"
    assert value(spark, text.event_name(F.lit(None).cast("string"), F.lit(""))) == "(no title)"


def test_trust_clamps(spark):
    step = lambda old, d: value(spark, text.clamp_trust(F.lit(old), F.lit(d)))
    assert step(0.5, 0.02) == 0.52
    assert step(0.845, 0.02) == 0.85
    assert step(0.36, -0.02) == 0.35
    assert step(0.9, 0.02) == 0.85
    assert step(0.2, -0.02) == 0.35
    assert step(0.0, 0.02) == 0.52


def test_junk_and_personal(spark):
    assert value(spark, text.is_junk(F.lit("x Voice call just ended y")))
    assert not value(spark, text.is_junk(F.lit(None).cast("string")))
    assert value(spark, text.shows_personal(F.lit("write to a.b@c.org")))
    assert not value(spark, text.shows_personal(F.lit("plain words")))
    assert value(spark, text.is_durable(F.lit("her Birthday is soon")))


def test_first_json_object(spark):
    assert value(spark, text.first_json_object(F.lit('so {"a": {"b": 1}} there'))) == '{"a": {"b": 1}}'
    assert value(spark, text.first_json_object(F.lit("{broken"))) is None


def test_tidy_entities(spark):
    names = ["With Alex", "alex", "Arrive Prague", "a b\nc", "lower case many words here", "Prague", "x" * 61, "Kim  Lee"]
    assert value(spark, text.tidy_entities(F.array(*map(F.lit, names)))) == ["Alex", "Prague", "Kim Lee"]
