"""Language models: held-out accuracy, normalisation, gaps."""

import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import language_id
from ledgerlens.llm.common import held_back

FOLDER = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, score int, text_to_judge string"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_held_out_documents(spark):
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = held_back(F.col("doc_id"), 4, 2)
    found = language_id.identify(documents.withColumn("held", held), ~held, keep=["doc_id", "held", "lang", "text"]).toPandas()
    assert len(found) == documents.count() and found["score"].between(0, 1).all()
    own = found[found["held"] & found["text"].str.len().gt(100)]
    assert (own["lang"] == own["lang_pred"]).mean() > 0.99
    assert found["rejected"].mean() < 0.01


def test_texts_without_letters_and_strange_texts(spark):
    english, german = "the cat and the other things with that", "der hund und die anderen sachen mit"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", 0, "x") for i in range(80)]
    rows += [(100, None, "en", 0, ""), (101, "", None, 0, ""), (102, "12 -- 3!", "de", 0, ""), (None, english.upper(), None, 0, "")]
    rows += [(103, "qzxjk wvvkq zzxqj " * 30, None, 0, ""), (103, english, None, 0, "")] + [(104, german * 20_000, None, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r["doc_id"], i): r for i, r in enumerate(language_id.identify(df, F.lit(True), keep=["doc_id", "text"]).collect())}
    assert len(found) == len(rows)
    by_id = {}
    for (doc_id, _), r in found.items():
        by_id.setdefault(doc_id, []).append((r["lang_pred"], r["rejected"]))
    assert by_id[100] == by_id[101] == by_id[102] == [("und", True)]
    assert by_id[None] == [("en", False)] and by_id[104] == [("de", False)]
    assert sorted(r for _, r in by_id[103]) == [False, True]
    assert by_id[0] == [("de", False)] and by_id[1] == [("en", False)]


def test_without_labels_and_without_rows(spark):
    df = spark.createDataFrame([(1, "some text", None, 1, "")], SCHEMA)
    assert [tuple(r) for r in language_id.identify(df, F.lit(True)).collect()] == [(1, "und", 0.0, True)]
    assert language_id.identify(df.limit(0), F.lit(True)).count() == 0
    labelled = spark.createDataFrame([(1, "some text", "en", 1, ""), (2, "--", "fr", 1, "")], SCHEMA)
    assert {r["lang_pred"] for r in language_id.identify(labelled, F.lit(True)).collect()} == {"en", "und"}


def test_probabilities_after_a_context_sum_to_one():
    words = "ab abc abd b ba bab cab dab abba".split()
    parts = []
    found = language_id.grams_of(words)
    for n in range(1, language_id.ORDER + 1):
        at = np.flatnonzero(found.place >= max(1, n - 1))
        parts.append(pd.DataFrame({
            "lang": "x", "n": n, "gram": found.gram[n][at].view("int64"), "context": found.context[n][at].view("int64"),
            "suffix": found.gram[n - 1][at].view("int64") if n > 1 else 0, "opens": (found.place[at] == n - 1) & (n > 1), "count": 1,
        }))
    names = ["lang", "n", "gram", "context", "suffix", "opens"]
    models = language_id.Models(["x"], pd.concat(parts).groupby(names, as_index=False)["count"].sum())

    def next_sign(prefix, sign):
        """Probability of a sign after the first ones of a word; a blank ends the word."""
        codes = np.array([ord(c) for c in f" {prefix}{sign}"], np.uint64)
        place = np.arange(len(codes))
        whole = language_id.Grams(np.zeros(len(codes), int), place)
        single = codes + np.uint64(1)
        raw = single
        whole.gram[1] = language_id._mixed(raw, 1)
        for n in range(2, models.order + 1):
            before = np.r_[np.uint64(0), raw[:-1]]
            whole.context[n] = language_id._mixed(before, n - 1)
            raw = single + language_id._STEP * before
            whole.gram[n] = language_id._mixed(raw, n)
        i, log_p = len(codes) - 1, models.floor[0]
        for n in range(1, min(models.order, len(codes)) + 1):
            known = models._looked_up(models.grams, models.log_p, whole.gram[n][[i]], np.nan)[0, 0]
            if not np.isnan(known):
                log_p = known
            elif n > 1:
                log_p += models._looked_up(models.contexts, models.log_back, whole.context[n][[i]], 0.0)[0, 0]
        return 2.0**log_p

    for prefix in ("", "a", "ab", "abb", "q", "aq", "dabab"):
        assert sum(next_sign(prefix, s) for s in "abcd ሴ") == pytest.approx(1.0, abs=1e-4), prefix
