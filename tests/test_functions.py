"""Column functions."""

import base64
import struct
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import amounts, documents, identity, risk, text, times


def column(spark, values, type_, function):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {type_}")
    return [r["out"] for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


def test_base_units(spark):
    values = ["0", "1", "42", "1.23", "0.5", ".5", "1.2345678", "5.", ".", "", "1.2.3", "-1", "a", None, " 7 "]
    got = column(spark, values, "string", lambda c: amounts.to_base_units(c, F.lit(6)))
    expected = [0, 1_000_000, 42_000_000, 1_230_000, 500_000, 500_000, None, 5_000_000]
    assert got == [*expected, None, None, None, None, None, None, 7_000_000]


def test_truncating_base_units(spark):
    got = column(spark, ["1.2345678", "3", ".5", "x"], "string", lambda c: amounts.truncate_to_base_units(c, F.lit(6)))
    assert got == [1_234_567, 3_000_000, None, None]


@pytest.mark.parametrize(
    "units, places, expected",
    [(0, 6, "0"), (1, 6, "0.000001"), (1_230_000, 6, "1.23"), (42, 0, "42"), (-1500, 3, "-1.5"), (10**25, 9, "1" + "0" * 16)],
)
def test_format_base_units(spark, units, places, expected):
    df = spark.sql(f"SELECT CAST('{units}' AS DECIMAL(38,0)) AS u")
    assert df.select(amounts.format_base_units(F.col("u"), F.lit(places))).first()[0] == expected


def test_plain_text_and_rounding(spark):
    row = spark.range(1).select(
        amounts.plain_text(F.lit("1.500").cast("decimal(38,3)")).alias("a"),
        amounts.half_up(F.lit(-2.5)).alias("b"),
        amounts.half_even(F.lit(2.5), 0).alias("c"),
    ).first()
    assert (row["a"], row["b"], row["c"]) == ("1.5", -2, 2.0)


def test_humanised(spark):
    assert column(spark, [1.25e9, 3.4e6, 1500.0, 7.5], "double", text.currency) == ["$1.3B", "$3.4M", "$1.5K", "$7.50"]
    assert column(spark, [2.5e6, 1500.0, 12.0, 12.5], "double", text.compact_number) == ["2.5M", "1.5K", "12", "12.5"]
    assert column(spark, [0.0123, -0.5], "double", text.signed_percent) == ["+1.23%", "-50.00%"]
    assert column(spark, ["1234567.89", "12", "-1234"], "string", text.grouped_thousands) == ["1,234,567.89", "12", "-1,234"]
    assert column(spark, ["force_burn", "mintTo"], "string", text.title_case) == ["Force Burn", "MintTo"]
    assert column(spark, [" a, ,b,", None], "string", text.split_list) == [["a", "b"], []]


def test_times(spark):
    got = column(spark, ["2024-01-02T03:04:05.678Z", "2024-01-02 03:04:05+02:00", "nope"], "string", times.iso_timestamp)
    assert got == [datetime(2024, 1, 2, 3, 4, 5, 678000), datetime(2024, 1, 2, 1, 4, 5), None]
    now = times.moment("2024-01-02 00:00:00")
    ages = column(
        spark,
        [datetime(2024, 1, 1, 20), datetime(2024, 1, 1, 19, 59), datetime(2023, 12, 31, 23)],
        "timestamp",
        lambda c: times.freshness(c, now),
    )
    assert ages == ["Live", "Delayed", "Stale"]
    due = spark.range(1).select(times.plus_hours(now, F.lit(36))).first()[0]
    assert due == datetime(2024, 1, 3, 12)


def test_documents(spark):
    df = spark.createDataFrame([('{"a":{"b":1},"c":"x"}',), (None,)], "d string")
    merged = [r[0] for r in df.select(documents.merged(F.col("d"), F.lit('{"c":2,"e":"y"}'))).collect()]
    fields = df.select(documents.field(F.col("d"), "a", "b")).first()[0]
    assert fields == "1"
    import json

    assert json.loads(merged[0]) == {"a": {"b": 1}, "c": 2, "e": "y"} and json.loads(merged[1]) == {"c": 2, "e": "y"}


def test_token_uuid(spark):
    mints = ["EPjFWdd5AufqSSqeM2qN1xzybapC8G4wEGGkZwyTDt1v", "a", "ü"]
    namespace = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
    assert column(spark, mints, "string", identity.token_uuid) == [str(uuid.uuid5(namespace, m)) for m in mints]


def test_account_bytes(spark):
    mint, owner = bytes(range(1, 33)), b"\x00" * 31 + b"\x3a"
    full = mint + owner + struct.pack("<Q", 2**64 - 3) + b"\x00" * 93
    texts = [base64.b64encode(full).decode(), base64.b64encode(full[:71]).decode(), "***", None]
    rows = column(spark, texts, "string", identity.decode_account)
    assert rows[1:] == [None, None, None]
    assert bytes(rows[0]["mint_key"]) == mint and int(rows[0]["balance"]) == 2**64 - 3

    def base58(key):
        number, out = int.from_bytes(key, "big"), ""
        while number:
            number, digit = divmod(number, 58)
            out = identity.ALPHABET[digit] + out
        return out or "1"

    keys = [mint, owner, b"\x00" * 32, b"\xff" * 32]
    assert column(spark, keys, "binary", identity.base58) == [base58(k) for k in keys]


@pytest.mark.parametrize(
    "status, provider, score, level, tone",
    [
        ("error", "trm", 9.0, "high", "neutral"),
        ("ok", "elliptic", 9.0, "Check Passed", "green"),
        ("ok", "trm", None, " ", "green"),
        ("ok", "other", 7.0, None, "red"),
        ("ok", "other", 3.0, None, "yellow"),
        ("ok", "other", 0.0, "high", "green"),
        ("ok", "other", None, "Very High", "red"),
        ("ok", "other", None, "watch list", "yellow"),
        ("ok", "other", None, "minimal", "green"),
        ("ok", "other", None, "odd", "neutral"),
        ("ok", "other", None, None, "neutral"),
    ],
)
def test_risk_tone(spark, status, provider, score, level, tone):
    df = spark.createDataFrame([(status, provider, score, level)], "s string, p string, n double, l string")
    assert df.select(risk.risk_tone(F.col("s"), F.col("p"), F.col("n"), F.col("l"))).first()[0] == tone


def test_base58_encodes_arrow_columns(spark):
    from ledgerlens.functions.identity import base58

    rows = spark.createDataFrame([(1, bytearray(b"\x00\x01")), (2, None), (3, bytearray(2)), (4, bytearray(b"\x00\x01"))], "i int, k binary")
    assert base58.evalType == 250
    assert [r[0] for r in rows.select(base58("k"), "i").orderBy("i").collect()] == ["2", None, "1", "2"]
