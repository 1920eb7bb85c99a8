"""Whitening against numpy on the expanded fit list."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from ledgerlens.llm import whitening


def usable_rows(rows):
    return [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]


def slow(rows, most=8, once=False):
    """id -> (n, deviation, whitened, explained) per row, in whole numbers up to the eigenvectors; one width only."""
    held = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in usable_rows(rows)]
    fit = [list(x) for x in dict.fromkeys(tuple(x) for _, x in held)] if once else [x for _, x in held]
    n, width = len(fit), len(fit[0])
    sums = [sum(x[d] for x in fit) for d in range(width)]
    centred = [[n * x[d] - sums[d] for d in range(width)] for x in fit]
    covariance = np.array(
        [[float(Fraction(sum(c[a] * c[b] for c in centred), n**3)) for b in range(width)] for a in range(width)]
    )
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:most]
    found = []
    for i, x in held:
        far = [n * x[d] - sums[d] for d in range(width)]
        point = (np.array(far, float) / n) @ (vectors[:, order] / np.sqrt(values[order]))
        found.append((i, n, sum(f * f for f in far), point, values[order] / np.trace(covariance)))
    return found


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, v, "a", 1, 2) for i, v in rows], "vec_id long, embedding array<double>, key string, salt int, n int")
    return whitening.whiten(df, **options).collect()


def check(got, expected, most):
    """Rows as a multiset; each component may have either sign, the same in all rows."""
    assert len(got) == len(expected) * most
    assert {r["component"] for r in got} == set(range(1, most + 1))
    for c in range(1, most + 1):
        mine = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["deviation"], abs(r["whitened"])) for r in got if r["component"] == c)
        theirs = sorted((i is None, i or 0, far, abs(p[c - 1])) for i, _, far, p, _ in expected)
        assert [m[:3] for m in mine] == [t[:3] for t in theirs]
        assert np.allclose([m[3] for m in mine], [t[3] for t in theirs], atol=1e-9)
        signs = {(i, far): p[c - 1] for i, _, far, p, _ in expected}
        pairs = [(r["whitened"], signs[r["vec_id"], r["deviation"]]) for r in got if r["component"] == c]
        ratio = {round(mine / own) for mine, own in pairs if abs(own) > 1e-3}
        assert ratio in ({1}, {-1})
        assert all(math.isclose(r["explained"], expected[0][4][c - 1], rel_tol=1e-9) for r in got if r["component"] == c)
    assert {r["n"] for r in got} == {expected[0][1]}
    (error,) = {r["identity_error"] for r in got}
    assert 0 <= error < 1e-9
    assert all(r["deviation"] == int(r["deviation_exact"]) for r in got)


def sample(count, width, seed=3):
    pick = random.Random(seed)
    return [(i, [pick.gauss(0.0, 0.1 * (d + 1)) for d in range(width)]) for i in range(count)]


def test_equals_numpy_with_copies_and_unusable_rows(spark):
    rows = sample(60, 10)
    rows += [(100 + i, rows[0][1]) for i in range(40)] + [(7, rows[7][1]), (7, rows[9][1]), (None, rows[3][1])]
    rows += [(500, None), (501, [None] + [0.0] * 9), (502, [math.nan] * 10), (503, [math.inf] * 10)]
    check(run(spark, rows), slow(rows), 8)


def test_one_as_weight_fits_on_distinct_vectors(spark):
    rows = sample(30, 5)
    rows += [(100 + i, rows[0][1]) for i in range(30)]
    got = run(spark, rows, weights="one")
    expected = slow(rows, once=True)
    assert {r["n"] for r in got} == {30} and len(got) == 60 * 5
    mine = sorted((r["vec_id"], abs(r["whitened"])) for r in got if r["component"] == 1)
    theirs = sorted((i, abs(p[0])) for i, _, _, p, _ in expected)
    assert [m[0] for m in mine] == [t[0] for t in theirs] and np.allclose([m[1] for m in mine], [t[1] for t in theirs])
    with pytest.raises(ValueError):
        run(spark, rows, weights="two")


def test_many_equal_rows_use_several_tasks_and_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 3)
    rows = sample(40, 3) + [(None, [0.5, 0.25, 0.125])] * 2500 + [(1000 + i, [0.5, 0.25, 0.125]) for i in range(400)]
    got = run(spark, rows)
    check(got, slow(rows), 3)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    parts = whitening.whiten(df).filter("vec_id >= 1000").selectExpr("spark_partition_id() AS p").distinct().count()
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert parts > 1


def test_values_without_variance(spark):
    got = run(spark, [(1, [0.5, 0.5]), (2, [0.5, 0.5])])
    assert len(got) == 4 and all(r["whitened"] is None and r["explained"] is None and r["identity_error"] is None for r in got)
    assert all(r["deviation"] == 0 and r["n"] == 2 for r in got)
    got = run(spark, [(1, [0.5, 0.5]), (2, [0.75, 0.5])])
    assert [r["whitened"] is None for r in sorted(got, key=lambda r: r["component"])] == [False, False, True, True]
    assert {r["explained"] for r in got} == {1.0, 0.0} and {r["identity_error"] for r in got} == {0.0}


def test_widths_are_lists_of_their_own_and_empty_tables_stay_empty(spark):
    rows = sample(20, 3) + [(100 + i, v) for i, v in sample(15, 2, seed=4)] + [(200, [])]
    got = run(spark, rows)
    check([r for r in got if r["vec_id"] < 100], slow(rows[:20]), 3)
    check([r for r in got if 100 <= r["vec_id"] < 200], slow(rows[20:35]), 2)
    assert len(got) == 20 * 3 + 15 * 2
    assert run(spark, []) == [] and run(spark, [(1, None), (2, [])]) == []


def test_large_numbers_stay_exact(spark):
    rows = [(i, [c * 2.0**30, c * 3.0, -c * 2.0**25 + i]) for i, c in enumerate((0.5, 1.25, 3.0, -7.5, 2.0, 1.0))]
    got = {r["vec_id"]: r for r in run(spark, rows) if r["component"] == 1}
    for i, _, far, point, _ in slow(rows):
        assert int(got[i]["deviation_exact"]) == far and got[i]["deviation"] == (far if far < 2**63 else None)
        assert math.isclose(abs(got[i]["whitened"]), abs(point[0]), rel_tol=1e-9)
    far_out = run(spark, [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 0.5])])
    assert len(far_out) == 6 and all(r["deviation_exact"] is not None for r in far_out)
