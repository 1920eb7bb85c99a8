"""Exact sums of decimal text of any length.

A decimal text is either short (up to 15 whole and 9 fraction digits; a plain decimal holds it) or long.  Long ones are
cut into limbs of 18 digits, numbered from the decimal point: 0 is the lowest limb of the whole part, -1 the first of the
fraction.  A group's sum is the plain sum of its short texts and one partial sum per limb that occurs, so the number of
digits never matters; carrying happens once, when the sum is written as text.

Sums per group are partially aggregated by group and limb.  Running sums (:func:`running_total`) cut each group into
spans of its order, so that no task needs a whole group.

Expressions are written as SQL: built call by call, they would take longer to make than a small query to run.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions.amounts import DECIMAL_TEXT
from ledgerlens.operators.skew import materialise

#: Digits of a limb, and what a short text has at most.
LIMB, SHORT_WHOLE, SHORT_FRACTION = 18, 15, 9

#: A sum of limbs or of short texts: room for 10**14 rows and more.
SHORT, SHORT_SUM, LIMB_TYPE, LIMB_SUM = "decimal(28,9)", "decimal(38,9)", "decimal(28,0)", "decimal(38,0)"

ENTRY = f"struct<place:int,part:{LIMB_SUM}>"
LIMBS = f"array<{ENTRY}>"


def let(value: str, name: str, body: str) -> str:
    """SQL of ``body`` in which ``name`` is a value that is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def amount_parts(text: str) -> dict[str, Column]:
    """``valid``, ``short`` (decimal, null for long or other text) and ``limbs`` (null for short or other text)."""
    trimmed = f"trim({text})"
    point = f"instr({trimmed}, '.')"
    whole = f"if({point} > 0, {point} - 1, length({trimmed}))"
    fraction = f"if({point} > 0, length({trimmed}) - {point}, 0)"
    valid = f"coalesce({trimmed} RLIKE r'{DECIMAL_TEXT}', false)"
    fits = f"{whole} <= {SHORT_WHOLE} AND {fraction} <= {SHORT_FRACTION}"
    fronts, backs = (f"CAST(ceil({n} / {LIMB}) AS INT)" for n in (whole, fraction))
    # Padded to whole limbs, the digits of a place start a fixed distance from the point.
    after = f"if({point} > 0, substring_index({trimmed}, '.', -1), '')"
    digits = f"concat(lpad(substring_index({trimmed}, '.', 1), {fronts} * {LIMB}, '0'), rpad({after}, {backs} * {LIMB}, '0'))"
    part = f"CAST(substring(d, (f - 1 - p) * {LIMB} + 1, {LIMB}) AS {LIMB_SUM})"
    limbs = let(digits, "d", let(fronts, "f", f"transform(sequence(-{backs}, f - 1), p -> named_struct('place', p, 'part', {part}))"))
    return {
        "valid": F.expr(valid),
        "short": F.expr(f"CASE WHEN {valid} AND {fits} THEN CAST(CAST({trimmed} AS DECIMAL(24,9)) AS {SHORT}) END"),
        "limbs": F.expr(f"CASE WHEN {valid} AND NOT ({fits}) THEN CAST({limbs} AS {LIMBS}) END"),
    }


def sum_text(short: str, limbs: str) -> Column:
    """A short sum plus limbs (places may repeat) as one decimal text without superfluous zeros; null counts as 0."""
    sum_ = f"CAST(coalesce({short}, 0) AS {SHORT_SUM})"
    whole = f"CAST(floor({sum_}) AS STRING)"
    rest = f"CAST({sum_} % CAST(1 AS DECIMAL(1,0)) AS DECIMAL(10,{SHORT_FRACTION}))"
    fraction = f"lpad(CAST(CAST({rest} * CAST({10**SHORT_FRACTION} AS DECIMAL(10,0)) AS DECIMAL(10,0)) AS STRING), {SHORT_FRACTION}, '0')"
    padded = f"lpad({whole}, {2 * LIMB}, '0')"
    parts = {1: f"substring({padded}, 1, {LIMB})", 0: f"substring({padded}, {LIMB + 1}, {LIMB})", -1: f"rpad({fraction}, {LIMB}, '0')"}
    own = ", ".join(f"named_struct('place', {place}, 'part', CAST({part} AS {LIMB_SUM}))" for place, part in parts.items())
    carried = let(f"concat({limbs}, CAST(array({own}) AS {LIMBS}))", "x", _carried("x"))
    # Tiny numbers, which a cast may write with an exponent, are put together from their digits.
    digits = _stripped(f"concat_ws('.', {whole}, {fraction})")
    plain = f"if({sum_} < 1, {digits}, trim(TRAILING '.' FROM trim(TRAILING '0' FROM CAST({sum_} AS STRING))))"
    return F.expr(f"CASE WHEN size({limbs}) > 0 THEN {carried} ELSE {plain} END")


def _stripped(text: str) -> str:
    """Decimal text with a point, without superfluous zeros and without a point at its end."""
    return f"regexp_replace({text}, r'^0+(?=[0-9])|\\.?0+$', '')"


def _carried(limbs: str) -> str:
    """Text of the sum of limbs: one pass from the lowest place up, with what is beyond 18 digits carried on.

    The places include 1, 0 and -1, so the point lies within the digits.
    """
    added = f"CAST(CAST(a AS DECIMAL(37,0)) + CAST(y.part AS DECIMAL(37,0)) AS {LIMB_SUM})"
    total = f"aggregate(filter({limbs}, y -> y.place = p), s.carry, (a, y) -> {added})"
    step = let(
        f"lpad(CAST({total} AS STRING), 38, '0')",
        "t",
        f"named_struct('carry', CAST(substring(t, 1, {38 - LIMB}) AS {LIMB_SUM}), 'text', concat(substring(t, {39 - LIMB}, {LIMB}), s.text))",
    )
    start = f"named_struct('carry', CAST(0 AS {LIMB_SUM}), 'text', '')"
    places = f"transform({limbs}, y -> y.place)"
    state = f"aggregate(sequence(low, array_max({places})), {start}, (s, p) -> {step}, s -> concat(CAST(s.carry AS STRING), s.text))"
    cut = f"length(e) + low * {LIMB}"
    pointed = let(state, "e", f"concat(substring(e, 1, {cut}), '.', substring(e, {cut} + 1, length(e)))")
    return let(f"array_min({places})", "low", _stripped(pointed))


#: How a carried column is aggregated: an aggregate that may be applied to its own results, and the column.
Carried = tuple[str, Column]


def sum_amounts(
    rows: DataFrame, keys: Sequence[str], amount: Column, total: str, unsummed: str, others: Mapping[str, Carried] | None = None
) -> DataFrame:
    """Exact sum per group as text (``total``, null without a valid amount) and the number of other, not null amounts.

    ``others`` maps a name to the name of an aggregate and the column of ``rows`` it is applied to, such as
    ``("min", F.col("x"))``.  Without keys the result is one row.
    """
    keys, others = list(keys), dict(others or {})
    read = rows.select(*keys, amount.cast("string").alias("_text"), *[c.alias(f"_{n}") for n, (_, c) in others.items()])
    parts = amount_parts("_text")
    apart = read.select("*", *[c.alias(f"_{n}") for n, c in parts.items()]).selectExpr(
        "*", f"posexplode(coalesce(_limbs, array(CAST(NULL AS {ENTRY})))) AS (_entry, _limb)"
    )
    # Of a long text's entries only the first one counts as the row.
    by_limb = apart.groupBy(*keys, F.expr("_limb.place AS _place")).agg(
        F.expr("sum(_short) AS _short"),
        F.expr(f"sum(CAST(_limb.part AS {LIMB_TYPE})) AS _part"),
        F.expr("max(CAST(_valid AS INT)) AS _valid"),
        F.expr("count_if(_text IS NOT NULL AND NOT _valid) AS _other"),
        *[F.expr(f"{f}(CASE WHEN _entry = 0 THEN _{n} END) AS _{n}") for n, (f, _) in others.items()],
    )
    sums = by_limb.groupBy(*keys).agg(
        F.expr("max(_short) AS _short"),
        F.expr(f"collect_list(CASE WHEN _place IS NOT NULL THEN named_struct('place', _place, 'part', CAST(_part AS {LIMB_SUM})) END) AS _limbs"),
        F.expr("max(_valid) AS _valid"),
        F.expr(f"coalesce(sum(_other), CAST(0 AS BIGINT)) AS {unsummed}"),
        *[F.expr(f"{f}(_{n}) AS {n}") for n, (f, _) in others.items()],
    )
    return sums.withColumn(total, F.when(F.col("_valid") > 0, sum_text("_short", "_limbs"))).select(*keys, *others, total, unsummed)


def running_total(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    span: str,
    sums: Mapping[str, str],
    latest: Mapping[str, str] | None = None,
    totals: bool = False,
) -> DataFrame:
    """Sums over the earlier rows of each row's group as ``name_before``, and the latest value that is not null of others.

    ``span`` numbers consecutive stretches of the order: rows of a smaller span come first.  Rows are sorted within
    their span only, and the spans' sums are added up apart, so one task holds the rows of one span of a group at most.
    ``sums`` and ``latest`` map names to SQL expressions; ``totals`` adds the sums of whole groups as ``name_total``.
    """
    latest = dict(latest or {})
    made = {**sums, **latest}
    # One column for the group and the span: rows are dealt by it once, for the window and for the join.  Null keys are
    # fields like others, so they meet in it.
    group = "named_struct({})".format(", ".join(f"'{k}', {k}" for k in keys))
    spanned = rows.selectExpr("*", f"named_struct('of', {group}, 'span', {span}) AS _part", *[f"{c} AS _{n}" for n, c in made.items()])
    at = ", ".join(order)
    per_span = spanned.groupBy("_part").agg(
        *[F.expr(f"sum(_{n}) AS _{n}") for n in sums],
        *[F.expr(f"max_by(_{n}, CASE WHEN _{n} IS NOT NULL THEN struct({at}) END) AS _{n}") for n in latest],
    )
    earlier = "OVER (PARTITION BY _part.of ORDER BY _part.span ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    inside = f"OVER (PARTITION BY _part ORDER BY {at} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    offsets = per_span.selectExpr(
        "_part",
        *[f"sum(_{n}) {earlier} AS _{n}_offset" for n in sums],
        *[f"last(_{n}, true) {earlier} AS _{n}_offset" for n in latest],
        *[f"sum(_{n}) OVER (PARTITION BY _part.of) AS {n}_total" for n in sums if totals],
    )
    running = spanned.selectExpr(
        "*", *[f"sum(_{n}) {inside} AS _{n}_run" for n in sums], *[f"last(_{n}, true) {inside} AS _{n}_run" for n in latest]
    )
    joined = running.join(offsets, "_part")
    types = dict(joined.dtypes)

    def before(name: str) -> str:
        # Of two decimals of 38 digits Spark would give up fraction digits for a carry; one digit less leaves room for it.
        kind = types[f"_{name}_offset"]
        room = kind.replace("38", "37", 1) if kind.startswith("decimal(38,") else kind
        run, offset = (f"CAST(coalesce(_{name}_{s}, 0) AS {room})" for s in ("run", "offset"))
        return f"CAST({run} + {offset} AS {kind}) AS {name}_before"

    return joined.selectExpr(
        *rows.columns,
        *[before(n) for n in sums],
        *[f"coalesce(_{n}_run, _{n}_offset) AS {n}_before" for n in latest],
        *[f"{n}_total" for n in sums if totals],
    )


def running_amounts(rows: DataFrame, keys: Sequence[str], amount: Column, order: Sequence[str], span: str) -> DataFrame:
    """Add the exact sum of the earlier amounts of each group in parts: ``short_before`` and ``limbs_before``.

    Also the row's own parts ``short``, ``limbs`` and ``valid``, and ``unsummed_before``: how many of the earlier amounts
    are neither null nor decimal text.  Rows that are equal in ``order`` follow each other by their text.
    """
    own = rows.withColumn("_text", amount.cast("string"))
    own = own.select("*", *[c.alias(n) for n, c in amount_parts("_text").items()])
    sums = {"short": f"coalesce(short, CAST(0 AS {SHORT}))", "unsummed": "CAST(_text IS NOT NULL AND NOT valid AS BIGINT)"}
    # Long amounts are rare: a table without any needs no limbs, otherwise they are written apart once.
    long = own.filter(f"length(_text) > {SHORT_FRACTION + 1} AND limbs IS NOT NULL")
    if long.isEmpty():
        running = running_total(own, keys, [*order, "_text"], span, sums)
        return running.withColumn("limbs_before", F.lit(None).cast(LIMBS)).drop("_text")
    long = materialise(long, "long-amounts")
    at = [*order, "_text", "_twin"]
    carried = _limb_totals(long, list(keys), at, span)
    plain = own.filter("limbs IS NULL").selectExpr("*", "0 AS _twin", f"CAST(NULL AS {LIMBS}) AS _after")
    running = running_total(plain.unionByName(carried), keys, at, span, sums, {"limbs": "_after"})
    return running.drop("_text", "_twin", "_after")


def _limb_totals(long: DataFrame, keys: list[str], at: list[str], span: str) -> DataFrame:
    """Add ``_after``: the limb sums of the group up to and including each long row; ``_twin`` tells equal rows apart."""
    named = long.selectExpr("*", f"row_number() OVER (PARTITION BY {', '.join([*keys, *at[:-1]])} ORDER BY 0) AS _twin")
    places = (
        named.selectExpr(*[f"{k} AS _of_{k}" for k in keys], "explode(limbs.place) AS _place")
        .groupBy(*[f"_of_{k}" for k in keys])
        .agg(F.expr("collect_set(_place) AS _places"))
    )
    wide = named.join(places, F.expr(" AND ".join(f"{k} <=> _of_{k}" for k in keys)), "inner").selectExpr(
        *keys, *at, f"{span} AS _span_of", "limbs", "explode(_places) AS _place"
    )
    own = f"CAST(coalesce(get(filter(limbs, y -> y.place = _place), 0).part, 0) AS {LIMB_TYPE}) AS _own"
    entries = wide.selectExpr(*keys, *at, "_span_of", "_place", own)
    summed = running_total(entries, [*keys, "_place"], at, "_span_of", {"limb": "_own"})
    after = f"CAST(CAST(limb_before AS DECIMAL(37,0)) + CAST(_own AS DECIMAL(37,0)) AS {LIMB_SUM})"
    gathered = summed.groupBy(*[F.expr(f"{k} AS _of_{k}") for k in (*keys, *at)]).agg(
        F.expr(f"CAST(collect_list(named_struct('place', _place, 'part', {after})) AS {LIMBS}) AS _after")
    )
    same = " AND ".join(f"{k} <=> _of_{k}" for k in (*keys, *at))
    return named.join(gathered, F.expr(same), "inner").selectExpr(*named.columns, "_after")
