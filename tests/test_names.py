from uuid import UUID

import pytest
from pyspark.sql import functions as F

from rehome.functions.names import (
    clean_name,
    compose_name,
    has_suffix,
    is_guid,
    move_path,
    sanitize_columns,
    strip_suffix,
)
from rehome.functions.text import elapsed_seconds, encoded, error_message, schema_enabled


def one(spark, value, column, kind="string"):
    df = spark.createDataFrame([(value,)], f"v {kind}")
    return df.select(column.alias("r")).first()["r"]


@pytest.mark.parametrize(
    "name, literal, like",
    [
        ("Sales_DR", (True, "Sales"), (True, "Sales")),
        ("SalesXDR", (False, "SalesXDR"), (True, "SalesXDR")),
        ("A_DR_B_DR", (True, "A_DR_B"), (True, "A_B")),
        ("O'Brien_DR", (True, "O'Brien"), (True, "O'Brien")),
        ("plain", (False, "plain"), (False, "plain")),
        ("_DR", (True, ""), (True, "")),
        (None, (None, None), (None, None)),
    ],
)
def test_suffix(spark, name, literal, like):
    for match, want in (("literal", literal), ("like", like)):
        got = one(spark, name, F.struct(has_suffix("v", "_DR", match), strip_suffix("v", "_DR", match)))
        assert tuple(got) == want


def test_compose_name_cuts_the_whole_name(spark):
    assert one(spark, "x" * 300, compose_name(F.lit("pre"), "v")) == "pre_" + "x" * 252


@pytest.mark.parametrize(
    "value",
    [
        "be3709da-fc46-46f5-be5b-6f9bec79bbfb",
        "BE3709DAFC4646F5BE5B6F9BEC79BBFB",
        "{be3709da-fc46-46f5-be5b-6f9bec79bbfb}",
        "urn:uuid:be3709da-fc46-46f5-be5b-6f9bec79bbfb",
        "be3709da-fc46-46f5-be5b-6f9bec79bbf",
        "be3709da-fc46-46f5-be5b-6f9bec79bbfb\n",
        "ge3709da-fc46-46f5-be5b-6f9bec79bbfb",
        "@pipeline().parameters.x",
        "0000-0000-0000-0000",
        "",
        None,
    ],
)
def test_is_guid(spark, value):
    try:
        UUID(str(value), version=4)
        want = True
    except ValueError:
        want = False
    assert one(spark, value, is_guid("v")) is want


def test_sanitize_columns(spark):
    raw = ["a b", "a.b", "c(1)", "d;{}", "e=f", "A_B", "x\ty\n,"]
    df = spark.createDataFrame([tuple(range(7))], raw)
    clean = sanitize_columns(df)
    assert clean.columns == ["a_b", "a_b_2", "c1", "d", "e=f", "A_B_3", "xy"]
    assert tuple(clean.first()) == tuple(range(7))
    assert clean_name("q,(;)") == "q"


def test_move_path(spark):
    path = "abfss://w1@host/s1.Lakehouse/Tables/t"
    ids = [F.lit(x) for x in ("w1", "w2", "s1", "s2")]
    assert one(spark, path, move_path("v", *ids)) == "abfss://w2@host/s2.Lakehouse/Tables/t"
    by_name = move_path("v", *ids, by="name", suffix="_recovered")
    assert one(spark, path, by_name) == "abfss://w2@host/s2.Lakehouse/Tables/t_recovered"
    assert one(spark, "abfss://w1@host/s1/T", by_name) == "abfss://w2@host/s1/T_recovered"


@pytest.mark.parametrize(
    "text, want",
    [
        ('x Error: {"message":"a\nb"} Headers: {}', "a\nb"),
        ('Error:{"message":"m","in":{"a":{"b":1}}}  Headers:q', "m"),
        ('Error: {"message":"to the end"}', "to the end"),
        ('Error: {"code":1} Headers:', ""),
        ("Error: no body Headers:", None),
        ("timed out", None),
        (None, None),
    ],
)
def test_error_message(spark, text, want):
    assert one(spark, text, error_message("v")) == want


def test_text_helpers(spark):
    import base64

    text = "é" * 200
    assert base64.b64decode(one(spark, text, encoded("v"))).decode() == text
    assert "\n" not in one(spark, text, encoded("v"))
    assert one(spark, '{"defaultSchema":"dbo"}', schema_enabled("v")) is True
    assert one(spark, '{"other":1}', schema_enabled("v")) is False
    later = F.expr("TIMESTAMP '2024-01-01 00:00:01.5'")
    assert one(spark, "x", elapsed_seconds(F.expr("TIMESTAMP '2024-01-01'"), later)) == 1.5
