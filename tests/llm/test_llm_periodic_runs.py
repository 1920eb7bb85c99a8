"""Periodic runs against a search over all periods and places."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from ledgerlens.llm import periodic_runs


def slow_runs(t, least_words=24, least_periods=3):
    n, seen = len(t), {}
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            if t[i] != t[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and t[j] == t[j + q]:
                j += 1
            if j - i + q >= max(least_words, least_periods * q):
                seen.setdefault((i, j - i + q), q)
            i = j
    return sorted((s, n, q) for (s, n), q in seen.items())


def slow_row(doc_id, text, plant=True):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if plant and doc_id is not None and n and zlib.crc32(str(doc_id).encode()) % 10 == 0:
        g = zlib.crc32(str(doc_id).encode()) // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = slow_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    rest = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(rest.encode()).hexdigest(), n, len(dropped),
    )


def run(spark, rows, **options):
    df = spark.createDataFrame([(i, t, "x", 7) for i, t in rows], "doc_id long, text string, start string, n_runs int")
    return sorted(map(tuple, periodic_runs.periodic_runs(df, **options).collect()), key=repr)


def noisy(pick, n, k, stretches):
    t = [pick.randrange(k) for _ in range(n)]
    for _ in range(stretches):
        a = pick.randrange(n)
        p = pick.randint(1, max(1, (n - a) // 3))
        for i in range(a, min(n, a + p * pick.randint(2, 9))):
            t[i] = t[a + (i - a) % p]
    return t


@pytest.mark.parametrize("least_words", [1, 6, 24])
def test_runs_equal_the_search_over_all_periods(least_words, monkeypatch):
    monkeypatch.setattr(periodic_runs, "POINTS", 50)
    pick = random.Random(least_words)
    for _ in range(300):
        texts = [noisy(pick, pick.randint(1, 120), pick.choice([1, 2, 3, 10]), pick.randint(0, 3)) for _ in range(pick.randint(1, 5))]
        texts.append([])
        found = periodic_runs.find_runs([np.array(t, "int64") for t in texts], least_words)
        assert [list(map(tuple, f.tolist())) for f in found] == [slow_runs(t, least_words) for t in texts]


def test_extensions_equal_comparing_word_by_word():
    pick = random.Random(5)
    text = noisy(pick, 400, 2, 6)
    words = np.array([1000, *text, 1001], "int64")
    barrier = np.isin(words, (1000, 1001))
    rounds = periodic_runs.grammar(words, barrier)
    assert len(rounds[-1].symbols) == 3 and len(rounds) < 60
    pairs = [sorted(pick.sample(range(1, 401), 2)) for _ in range(3000)]
    left, right = np.array(pairs).T
    ahead = periodic_runs.extensions(rounds, left, right, forward=True)
    behind = periodic_runs.extensions(rounds, left, right, forward=False)
    for (a, b), f, g in zip(pairs, ahead.tolist(), behind.tolist()):
        assert f == next(i for i in range(500) if words[a + i] != words[b + i] or barrier[b + i])
        assert g == next(i for i in range(500) if words[a - i] != words[b - i] or barrier[a - i])


def test_documents_equal_brute_force(spark):
    pick = random.Random(9)
    rows = [(i, " ".join(map(str, noisy(pick, pick.randint(1, 150), pick.choice([2, 5, 50]), pick.randint(0, 2))))) for i in range(150)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (3, rows[3][1]), (900, None), (901, ""), (902, " \t\n"), (903, "a"), (904, "b " * 60)]
    rows += [(905, "x y z " * 40), (906, "a\x0bb\x0cc\r" * 30), (907, "é\x1cé " * 30)]
    assert run(spark, rows, plant=True) == sorted((slow_row(*r) for r in rows), key=repr)
    assert run(spark, rows) == sorted((slow_row(*r, plant=False) for r in rows), key=repr)
    assert any(r[1] > 1 for r in run(spark, rows)) and run(spark, []) == []


def test_very_long_texts_are_whole(spark):
    pick = random.Random(2)
    plain = [pick.randrange(5000) for _ in range(60_000)]
    period = plain[:7000]
    rows = [(1, " ".join(map(str, plain + period * 4 + plain[::-1]))), (2, "z " * 150_000)]
    got = {r[0]: r for r in run(spark, rows)}
    assert got[2][1:6] == (1, 0, 150_000, 1, 150_000_000) and got[2][9] == 149_999
    n_runs, start, length, q = got[1][1:5]
    assert (n_runs, q) == (1, 7000) and start in range(59_990, 60_001) and length >= 28_000


def test_kept_columns_and_listed_runs(spark):
    df = spark.createDataFrame([(5, "ab cd " * 20 + "ef", "s", 1)], "doc_id long, text string, start string, n_runs int")
    (row,) = periodic_runs.periodic_runs(df, keep=["doc_id", "start", "n_runs"], collapsed=True).collect()
    assert (row["start"], row["n_runs"], row["n_runs_"], row["start_"], row["period"]) == ("s", 1, 1, 0, 2)
    assert row["collapsed_text"] == "ab cd ef" and [tuple(r) for r in row["runs"]] == [(0, 40, 2)]
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(df, least_periods=2)
