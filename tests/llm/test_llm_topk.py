"""Exact search against brute force."""

import math
import random

from ledgerlens.llm import topk


def slow(rows, k, every):
    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.setdefault(i, []).append([math.floor(64 * x) for x in v])
    found = []
    for q, own in kept.items():
        if q % every:
            continue
        best = {}
        for c, others in kept.items():
            scores = [sum(a * b for a, b in zip(x, y)) for x in own for y in others if len(x) == len(y)]
            if c != q and scores:
                best[c] = max(min(max(scores), 2**63 - 1), -(2**63))
        ranked = sorted(best.items(), key=lambda e: (-e[1], e[0]))[:k]
        found += [(q, n + 1, c, s) for n, (c, s) in enumerate(ranked)]
    return sorted(found)


def run(spark, rows, k=5, every=4):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int")
    return sorted(map(tuple, topk.top_k(df, df.filter(f"vec_id % {every} = 0"), k=k).collect()))


def test_search_equals_brute_force_with_ties_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_ROWS", 7)
    monkeypatch.setattr(topk, "SHARD_ROWS", 5)
    monkeypatch.setattr(topk, "FAN_IN", 3)
    pick = random.Random(2)
    rows = [(i, [pick.choice([-0.5, 0.0, 0.25, 1.0]) for _ in range(3)]) for i in range(120)]
    assert run(spark, rows) == slow(rows, 5, 4)


def test_gaps_repeats_and_other_widths(spark):
    rows = [
        (0, [0.1, 0.2]), (1, [0.3, -0.2]), (2, None), (4, [None, 0.1]), (8, [float("nan"), 0.1]), (12, [float("inf"), 0.0]), (16, []),
        (20, [0.5]), (24, [0.5, 0.5, 0.5]), (None, [0.1, 0.1]), (1, [0.3, -0.2]), (28, [0.1, 0.2]), (3, [0.9, 0.9]), (3, [0.1, 0.9]), (21, []),
    ]
    assert run(spark, rows) == slow(rows, 5, 4)
    assert run(spark, rows[2:3]) == [] and run(spark, []) == []


def test_products_are_exact_beyond_floating_point(spark):
    rows = [(0, [2.0**40, 1.0, -1.0]), (1, [2.0**10, 3.0, 7.0]), (2, [2.0**10, 3.0, 6.0]), (3, [1e300, 0.0, 0.0]), (4, [-1e300, 0.0, 1.0])]
    assert run(spark, rows) == slow(rows, 5, 4)
