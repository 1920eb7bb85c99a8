"""The corpus pipeline, stage by stage, and the registered queries."""

import os

import pytest

import corpus_pipeline
from __spark_entry__ import queries
from ledgerlens.llm import simhash
from ledgerlens.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, n_dropped string, surplus_id int"
ENGLISH = "the cat and the other things with that and more of this kind every day of the week number {}"


def rows():
    made = [(i, ENGLISH.format(i * 7919 % 1000) + " " + " ".join(f"word{i}x{k}" for k in range(30)), "en", f"s{i % 3}", 1, "a", "b", 4) for i in range(40)]
    return made + [(50, made[3][1], "en", "s0", 1, "a", "b", 4), (3, made[3][1], "en", "s0", 1, "a", "b", 4), (60, None, "en", "s0", None, None, None, None)]


def test_stages_on_gaps(spark):
    df = spark.createDataFrame([*rows(), (61, "12 34 !!", "en", None, 1, "", "", 0), (None, ENGLISH, None, None, None, "", "", 0)], SCHEMA)
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "near_duplicates", "packing"]
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language_id"](spark, df, "")
    assert kept.columns == df.columns
    assert {r["doc_id"] for r in kept.collect()} == {*range(40), 50, None}
    cleaned = stages["line_dedup"](spark, kept, "")
    assert cleaned.columns == df.columns and cleaned.count() == kept.count()
    assert {r["n_dropped"] for r in cleaned.collect()} == {"b", ""}
    single = stages["near_duplicates"](spark, kept, "")
    prints = {r["doc_id"]: simhash.fingerprint(r["text"]) for r in kept.collect() if r["doc_id"] is not None}
    gone = {i for i in prints if any(j < i and bin(prints[i] ^ prints[j]).count("1") <= 3 for j in prints)}
    found = [r["doc_id"] for r in single.collect()]
    assert single.columns == df.columns and 50 in gone
    assert sorted(found, key=str) == sorted([*(set(prints) - gone), None], key=str)
    assert stages["packing"](spark, single, "").select("doc_id").distinct().count() == len(found)


def test_stages_on_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")
def test_run_packs_one_document_of_each_group(spark):
    found = corpus_pipeline.run(spark, FOLDER).collect()
    documents = spark.read.parquet(f"{FOLDER}/documents.parquet")
    groups = simhash.near_duplicates(documents).collect()
    kept = {r["doc_id"] for r in found}
    assert kept <= {r["doc_id"] for r in groups} and len(kept) >= 0.9 * len({r["component_id"] for r in groups})
    sizes = {}
    for r in found:
        sizes[r["sequence_id"]] = sizes.get(r["sequence_id"], 0) + r["length"]
    assert max(sizes.values()) <= 1024


def test_queries_are_registered():
    names = set(queries())
    assert {"pipeline", *QUERIES} <= names
    assert {f"op{n}_" for n in range(1, 11)} == {name[: name.index("_") + 1] for name in QUERIES}
