"""Katz scores against brute force."""

import collections
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import lm_score


def slow_model(rows):
    """Token lists, and the log10 probability of a token after another, worked out with dictionaries."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + [" "] for _, t, _ in rows]
    one, two, after = collections.Counter(), collections.Counter(), collections.Counter()
    for own, (_, _, held) in zip(tokens, rows):
        if not held:
            one.update(own)
    total = sum(one.values())
    contexts = {w for w, n in one.items() if n >= max(1, lm_score.CONTEXT_SHARE * total) and w != " "} | {"^"}
    for own, (_, _, held) in zip(tokens, rows):
        if not held:
            for a, b in zip(["^", *own], own):
                if a in contexts:
                    two[a, b] += 1
                    after[a] += 1
    small, pair = (lm_score.discounts([sum(v == r for v in c.values()) for r in range(1, 7)]) for c in (one, two))
    kept = lambda n, d: d[n] * n if n <= 5 else n - lm_score.TRIM
    unknown = 1 - sum(kept(n, small) for n in one.values()) / total if total else 1.0
    p_one = lambda w: kept(one[w], small) / total if w in one else unknown
    taken, met = collections.Counter(), collections.Counter()
    for (a, b), n in two.items():
        taken[a] += kept(n, pair) / after[a]
        met[a] += p_one(b)

    def p(a, b):
        if a not in contexts or a not in after:
            return p_one(b)
        return kept(two[a, b], pair) / after[a] if (a, b) in two else (1 - taken[a]) / (1 - met[a]) * p_one(b)

    return tokens, one, p, contexts


def documents(count):
    pick = random.Random(9)
    words = ["the", "of", "And", "rare%d", "x%d", "é", "a,"]
    rows = []
    for i in range(count):
        text = " ".join((w % pick.randint(0, 40)) if "%" in (w := pick.choice(words)) else w for _ in range(pick.randint(0, 30)))
        rows.append((i, text, i % 5 == 0))
    return rows


def scored(spark, rows):
    df = spark.createDataFrame([(i, t, h, 1, "k") for i, t, h in rows], "doc_id long, text string, held boolean, n int, block string")
    return lm_score.score_texts(df, F.col("held"))


@pytest.mark.parametrize("block", [60, 1_000_000])
def test_scores_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    monkeypatch.setattr(lm_score, "CONTEXT_SHARE", 0.02)
    rows = [*documents(60), (100, None, False), (101, "", True), (102, "unheard of things", True), (7, "of the", False), (None, "the the of", False)]
    rows += [rows[8], rows[8]]
    tokens, one, p, contexts = slow_model(rows)
    total, kinds = sum(one.values()), len(one)
    wanted = []
    for own, (i, _, held) in zip(tokens, rows):
        score = sum(math.log10(p(a, b)) for a, b in zip(["^", *own], own))
        base = sum(math.log10((one[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in own)
        wanted.append((str(i), held, len(own), sum(w in one for w in own), total, base, score))
    found = [(str(r[0]), *r[1:]) for r in scored(spark, rows).collect()]
    assert len(found) == len(wanted)
    for a, b in zip(sorted(found), sorted(wanted)):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    for context in ("^", "the", "of"):
        assert sum(p(context, w) for w in [*one, "never seen"]) == pytest.approx(1.0)


@pytest.mark.parametrize("block", [700, 1_000_000])
def test_every_word_of_the_training_documents_is_a_context(spark, monkeypatch, block):
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", block)
    rows = [*documents(200), (200, "once alone", False), (201, "once alone", True), (202, "once of", True), (203, "never of", True)]
    tokens, one, p, contexts = slow_model(rows)
    assert sum(one.values()) > 2000 and contexts == {*one, "^"} - {" "}
    found = {r["doc_id"]: r["score"] for r in scored(spark, rows).collect()}
    for own, (i, _, _) in zip(tokens, rows):
        assert found[i] == pytest.approx(sum(math.log10(p(a, b)) for a, b in zip(["^", *own], own)), rel=1e-9)
    assert found[201] > found[202]


def test_without_training_rows_and_without_rows(spark):
    found = scored(spark, [(1, "a b", True), (2, None, True)]).collect()
    assert [(r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in sorted(found)] == [
        (3, 0, 0, 0.0, 0.0), (1, 0, 0, 0.0, 0.0),
    ]
    assert scored(spark, []).count() == 0


def test_good_turing_factors_and_their_fallback():
    smooth = lm_score.discounts([1000, 300, 140, 80, 50, 35])
    assert all(0 < d < 1 for d in smooth[1:]) and smooth[1] == pytest.approx((2 * 300 / 1000 - 0.21) / 0.79)
    assert list(lm_score.discounts([3, 0, 1, 0, 0, 0])[1:]) == [0.5, 0.75, 2.5 / 3, 0.875, 0.9]
