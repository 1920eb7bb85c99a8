"""I-Match fingerprints: the edit, equal texts, gaps."""

import hashlib
import random

from ledgerlens.llm import fingerprints


def edited(rows):
    """The edited text of each (doc_id, text), in order of the id."""
    ordered = sorted(rows)
    found = {}
    for i, (doc_id, text) in enumerate(ordered):
        half = len(text) // 2
        found[doc_id] = text[: len(text) - half] + ordered[(i + 1) % len(ordered)][1][:half]
    return found


def documents(count, seed=5):
    pick = random.Random(seed)
    words = [a + b for a in "abcdefgh" for b in ["da", "no", "ré", "x", "ül"]]
    ids = pick.sample(range(-500, 10_000_000_000), count)
    return [(i, " ".join(pick.choice(words) + str(pick.randint(0, 3)) for _ in range(pick.randint(0, 60)))) for i in ids]


def test_edited_texts_follow_the_order_of_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_DOCUMENTS", 7)
    rows = documents(90)
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bucket string")
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df).collect()}
    assert len(found) == 90
    for doc_id, text in edited(rows).items():
        row = found[doc_id]
        assert row["edited_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert row["n_chars"] == len(dict(rows)[doc_id])
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    # An edited text fingerprints like the same text as a document of its own with the same lexicon.
    same = [r for r in found.values() if r["edited_fingerprint"] == r["fingerprint"]]
    assert all(r["near_edited"] == 1 for r in same)


def test_equal_texts_and_their_likeness(spark):
    rows = documents(40)
    copy = rows[0][1] + " more"
    rows = [*rows, (20_000_000_000, copy), (20_000_000_001, copy), (20_000_000_002, copy + " tail")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r for r in fingerprints.fingerprint_edits(df, least=0.01, most=0.9).collect()}
    first, second = found[20_000_000_000], found[20_000_000_001]
    assert first["fingerprint"] == second["fingerprint"]
    assert first["near_edited"] > 0 and first["near_next"] == 1.0 and first["edited_sha256"] != ""


def test_gaps_repeats_and_single_rows(spark):
    rows = [(1, None), (2, ""), (None, "lost id"), (3, "one two three"), (3, "one two three"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(((str(r["doc_id"]), r["n_chars"], r["edited_sha256"]) for r in fingerprints.fingerprint_edits(df).collect()))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    three = "one two three"
    # The two equal rows follow each other; after the last comes document 1, which is empty.
    wanted = [
        ("1", 0, sha("")), ("2", 0, sha("")), ("3", 13, sha(three[:7] + three[:6])), ("3", 13, sha(three[:7])),
        ("None", 0, sha("")), ("None", 7, sha("lost")),
    ]
    assert found == sorted(wanted)
    single = fingerprints.fingerprint_edits(df.filter("doc_id = 3").limit(1)).first()
    assert single["edited_sha256"] == sha(three[:7] + three[:6])
    assert fingerprints.fingerprint_edits(df.limit(0)).count() == 0


def test_main_path_is_native_and_shuffles_the_text_once(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = fingerprints.fingerprint_edits(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning(bucket") == 1 and "SinglePartition" not in plan
