"""Boilerplate lines against brute force."""

import collections
import random

import pytest

from ledgerlens.llm import line_dedup


def slow(rows, ratio, least):
    pages, held = collections.Counter(), collections.Counter()
    for _, text, host in rows:
        if host is not None:
            pages[host] += 1
            held.update({(host, line.strip(" ")) for line in (text or "").split("\n") if line.strip(" ")})
    bad = {(h, line) for (h, line), n in held.items() if n >= least and n > ratio * pages[h]}
    found = []
    for i, text, host in rows:
        lines = [] if text is None else text.split("\n")
        kept = [line for line in lines if (host, line.strip(" ")) not in bad]
        found.append((str(i), None if text is None else "\n".join(kept), len(lines) - len(kept)))
    return sorted(found, key=str)


def rows_of(count):
    pick = random.Random(1)
    rows = []
    for i in range(count):
        host = pick.choice(["a", "a", "a", "b", "c", None])
        lines = [f"line {pick.randint(0, 400)}" for _ in range(pick.randint(0, 6))]
        lines += ["menu of " + str(host)] * (pick.random() < 0.8) + ["  menu of a "] * (pick.random() < 0.1) + [""] * (pick.random() < 0.3)
        pick.shuffle(lines)
        rows.append((i, "\n".join(lines), host))
    return rows + [(1000, None, "a"), (1001, "", "a"), (None, "menu of a", "a"), (5, rows[5][1], rows[5][2]), (1002, "menu of a\n" * 9, "a")]


@pytest.mark.parametrize("hashes", [1_000_000, -1])
def test_lines_equal_brute_force(spark, monkeypatch, hashes):
    monkeypatch.setattr(line_dedup, "BROADCAST_HASHES", hashes)
    rows = rows_of(150)
    df = spark.createDataFrame([(*r, "x", 7, "y") for r in rows], "doc_id long, text string, source string, host string, salt int, lines_to_drop string")
    found = line_dedup.drop_boilerplate(df, ratio=0.3, least_pages=4)
    assert found.columns == [*df.columns, "n_dropped"]
    assert sorted(((str(r["doc_id"]), r["text"], r["n_dropped"]) for r in found.collect()), key=str) == slow(rows, 0.3, 4)
    assert {(r["host"], r["salt"], r["lines_to_drop"]) for r in found.collect()} == {("x", 7, "y")}
    assert line_dedup.drop_boilerplate(df.limit(0)).count() == 0


def test_the_count_column_can_be_left_out(spark):
    df = spark.createDataFrame([(1, "a", "h", 3)], "doc_id long, text string, source string, n_dropped int")
    assert line_dedup.drop_boilerplate(df).first()["n_dropped"] == 0
    assert line_dedup.drop_boilerplate(df, count=None).first()["n_dropped"] == 3
