"""Queries that run the column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerlens.functions import amounts, documents, text, times
from ledgerlens.sources import adapters

AS_OF = "2001-08-02 06:30:15"


def x1_x3_amounts(spark, folder):
    """Prices as decimal text of different shapes, in base units and back."""
    key = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    shaped = (
        F.when(key % 5 == 0, F.concat(price, F.lit("7")))
        .when(key % 5 == 1, F.concat(F.lit("."), F.substring_index(price, ".", -1)))
        .when(key % 5 == 2, F.concat(F.lit("1."), price))
        .otherwise(price)
    )
    rows = adapters.table(spark, folder, "orders").select(key, shaped.alias("text"), F.lit(2).alias("places"))
    units = amounts.to_base_units(F.col("text"), F.col("places"))
    cut = amounts.truncate_to_base_units(F.col("text"), F.col("places"))
    return rows.select(
        "o_orderkey",
        amounts.is_decimal_text(F.col("text")).alias("valid"),
        units.cast("bigint").alias("units"),
        cut.cast("bigint").alias("cut_units"),
        amounts.format_base_units(cut, F.col("places")).alias("formatted"),
        F.round(amounts.ui_amount(cut, F.col("places")), 4).alias("ui_amount"),
    )


def x7_x8_text(spark, folder):
    part = adapters.table(spark, folder, "part")
    mint = F.concat(F.lit("Mint"), F.lpad(F.col("p_partkey").cast("string"), 10, "0"))
    return part.select(
        "p_partkey",
        text.short_address(mint).alias("short"),
        text.first_eight(mint).alias("first_eight"),
        text.title_case(F.concat(F.lower("p_type"), F.lit("_"), F.lower("p_brand"))).alias("title"),
        F.greatest("p_size", F.coalesce(F.when(F.col("p_size") % 2 == 0, F.lit(25)), F.lit(0))).alias("priority"),
    )


def x9_x14_times(spark, folder):
    """Order times written as ISO text and read back."""
    written = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    iso = F.when(F.col("o_orderkey") % 10 == 0, F.lit("not a time")).otherwise(written)
    at, now = times.iso_timestamp(iso), times.moment(AS_OF)
    return adapters.table(spark, folder, "orders").select(
        "o_orderkey",
        F.unix_micros(at).alias("at"),
        F.unix_micros(times.utc_day(at)).alias("day_start"),
        F.unix_micros(times.plus_hours(at, (F.col("o_orderkey") % 50).cast("int"))).alias("due"),
        F.round(times.hours_between(at, now), 6).alias("hours"),
        F.round(times.days_between(at, now), 6).alias("days"),
        text.relative_time(at, now).alias("age"),
    )


def x10_documents(spark, folder):
    """Event properties with a field replaced and one added."""
    extra = F.to_json(F.struct((F.col("event_id") % 7).alias("m"), F.when(F.col("event_id") % 3 == 0, F.lit(-1)).alias("k")))
    merged = documents.merged(F.col("props"), extra)
    return adapters.table(spark, folder, "events").select(
        "event_id", documents.field(merged, "k").alias("k"), documents.field(merged, "m").alias("m")
    )


def x12_humanised(spark, folder):
    scaled = F.col("o_totalprice") * F.pow(F.lit(10.0), F.col("o_orderkey") % 8 - 4)
    cents = F.col("o_totalprice").cast("decimal(38,2)").cast("string")
    return adapters.table(spark, folder, "orders").select(
        "o_orderkey",
        F.regexp_extract(text.currency(scaled), "[KMB]?$", 0).alias("currency_unit"),
        F.regexp_extract(text.compact_number(F.floor(scaled).cast("double")), "[KM]?$", 0).alias("number_unit"),
        F.left(text.signed_percent(F.col("o_totalprice") - 250000), F.lit(1)).alias("sign"),
        text.grouped_thousands(cents).alias("grouped"),
    )


def x11_x15_lists(spark, folder):
    """Part names as untidy lists."""
    part = adapters.table(spark, folder, "part")
    raw = F.concat(F.lit(" "), F.regexp_replace("p_name", " ", " , ,"), F.lit(" ,"))
    items = text.split_list(raw)
    return part.select(
        "p_partkey",
        F.array_join(items, "|").alias("items"),
        F.array_contains(items, "red").alias("has_red"),
        F.get(items, F.lit(1)).alias("second"),
        F.upper(F.get(items, F.lit(0))).alias("first_upper"),
    )


def x13_rounding(spark, folder):
    value = F.col("p_size") / 4.0
    return adapters.table(spark, folder, "part").select(
        "p_partkey", amounts.half_even(value, 1).alias("half_even"), amounts.half_up(-value).alias("half_up")
    )


QUERIES = {
    "x1_x3_amounts": (x1_x3_amounts, """
        WITH c AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS cents, o_orderkey % 5 AS s FROM orders)
        , u AS (SELECT *, CASE s WHEN 1 THEN NULL WHEN 2 THEN NULL ELSE cents END AS cut FROM c)
        SELECT o_orderkey, s <> 2 AS valid, CASE s WHEN 0 THEN NULL WHEN 1 THEN cents % 100 WHEN 2 THEN NULL ELSE cents END
                 AS units, cut AS cut_units,
               CAST(cut // 100 AS VARCHAR) || CASE WHEN cut % 100 = 0 THEN '' ELSE '.' ||
                 rtrim(lpad(CAST(cut % 100 AS VARCHAR), 2, '0'), '0') END AS formatted,
               round(cut / CAST(100 AS DOUBLE), 4) AS ui_amount FROM u"""),
    "x7_x8_text": (x7_x8_text, """
        WITH p AS (SELECT *, 'Mint' || lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS mint FROM part)
        SELECT p_partkey, left(mint, 4) || '...' || right(mint, 4) AS short, left(mint, 8) AS first_eight,
               upper(p_type[1]) || lower(p_type[2:]) || ' ' || upper(p_brand[1]) || lower(p_brand[2:]) AS title,
               greatest(p_size, CASE WHEN p_size % 2 = 0 THEN 25 ELSE 0 END) AS priority FROM p"""),
    "x9_x14_times": (x9_x14_times, """
        WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_orderdate END AS t FROM orders),
        a AS (SELECT *, (epoch_us(TIMESTAMP '2001-08-02 06:30:15') - epoch_us(t)) / 1e6 AS s FROM t)
        SELECT o_orderkey, epoch_us(t) AS "at", epoch_us(date_trunc('day', t)) AS day_start,
               epoch_us(t + to_hours(o_orderkey % 50)) AS due, round(s / 3600, 6) AS hours, round(s / 86400, 6) AS days,
               CASE WHEN s IS NULL THEN NULL WHEN s < 60 THEN CAST(floor(s) AS BIGINT) || 's ago'
                    WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago'
                    WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago'
                    ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age FROM a"""),
    "x10_documents": (x10_documents, """
        SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '-1' ELSE json_extract_string(props, '$.k') END AS k,
               CAST(event_id % 7 AS VARCHAR) AS m FROM events"""),
    "x12_humanised": (x12_humanised, """
        WITH v AS (SELECT *, o_totalprice * power(CAST(10 AS DOUBLE), o_orderkey % 8 - 4) AS x,
                   CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS VARCHAR) AS cents FROM orders)
        SELECT o_orderkey, CASE WHEN x >= 1e9 THEN 'B' WHEN x >= 1e6 THEN 'M' WHEN x >= 1e3 THEN 'K' ELSE '' END
                 AS currency_unit,
               CASE WHEN floor(x) >= 1e6 THEN 'M' WHEN floor(x) >= 1e3 THEN 'K' ELSE '' END AS number_unit,
               CASE WHEN o_totalprice >= 250000 THEN '+' ELSE '-' END AS sign,
               format('{:,}', CAST(floor(CAST(o_totalprice AS DECIMAL(38,2))) AS BIGINT)) || right(cents, 3) AS grouped
        FROM v"""),
    "x11_x15_lists": (x11_x15_lists, """
        WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part)
        SELECT p_partkey, array_to_string(w, '|') AS items, list_contains(w, 'red') AS has_red, w[2] AS second,
               upper(w[1]) AS first_upper FROM s"""),
    "x13_rounding": (x13_rounding, """
        SELECT p_partkey, round_even(p_size / CAST(4 AS DOUBLE), 1) AS half_even,
               CAST(floor(-p_size / CAST(4 AS DOUBLE) + 0.5) AS BIGINT) AS half_up FROM part"""),
}
