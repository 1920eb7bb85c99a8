"""License notices: fixed phrases, and an exact set-similarity join of text blocks with notice templates.

A block is a window of consecutive words, at any start, as wide as a template with its share of foreign words between;
it matches the template when it contains at least that share of the template's distinct words, and all the words that
tell the template from other licenses.  Words are ordered by their frequency in all documents, rarest first.  A match
must share a word of the template's prefix (its rarest words) that lies in the prefix of the block too, must be large
enough, and must have enough words left after the shared one: only pairs that pass these filters are verified.  Words
outside all templates cannot add to an overlap and are left out of the blocks first.

Every match holds a word of the template's prefix, so blocks are only taken around these words.  A block that does not
start at a word of the template holds no more of them than the one that starts at the next such word, so only starts at
words of the template are looked at; the result is that of all starts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, lower_ascii

# What separates words, the phrases that are looked for, and published notices.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Label, notice, and the words of it that other licenses do not have or have otherwise.
TEMPLATES = [
    ("mit", "released under the mit license", "released mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission granted charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license 2"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu public 3"),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu public"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution binary"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla 2"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc nc"),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("all-rights-reserved", "all rights reserved", "all rights reserved"),
]

#: Share of a template's distinct words that a block must contain.
CONTAINMENT = 0.8


def word_text(text: Column) -> Column:
    """The words of a text, lower-cased and separated by single blanks."""
    return F.trim(F.regexp_replace(lower_ascii(text), NOT_WORD, " "))


def words_of(clean: Column) -> Column:
    return F.when(clean == "", F.array().cast("array<string>")).otherwise(F.split(clean, " "))


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)).cast("array<string>")


def least_overlap(words: set[str], containment: float) -> int:
    return math.ceil(containment * len(words) - 1e-9)


def block_width(text: str, containment: float) -> int:
    """Words of a block: those of the template are at least the given share of them when all are there."""
    return math.ceil(len(text.split()) / containment - 1e-9)


def facts_of(documents: DataFrame, containment: float) -> DataFrame:
    """What one pass over (doc_id, text) tells of every document.

    Result: doc_id, digest (of the text), n_words, present (the template words it holds), n_base, first_word, last_word,
    base (labels of the phrases), and the text again where some template has enough of its words in it.
    """
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    # Lower-casing all letters is cheaper than A-Z alone.  It neither joins nor splits words, and adds at most a word to
    # those present; places and blocks below are taken from the exact text.
    words = F.array_remove(F.split(F.lower(F.coalesce("text", F.lit(""))), NOT_WORD), "")
    rows = documents.select("doc_id", "text", F.xxhash64("text").alias("digest"), words.alias("words"))
    rows = rows.select(
        "doc_id", "text", "digest", F.size("words").cast("bigint").alias("n_words"),
        F.array_intersect("words", _strings(vocabulary)).alias("present"),
    )
    def holds(wanted: set[str], least: int) -> Column:
        return F.size(F.array_intersect("present", _strings(sorted(wanted)))) >= least

    some_phrase, some_template = F.lit(False), F.lit(False)
    for phrase in PHRASES:
        some_phrase = some_phrase | holds(set(phrase.split()), len(set(phrase.split())))
    for _, text, telling in TEMPLATES:
        enough = holds(set(text.split()), least_overlap(set(text.split()), containment))
        some_template = some_template | (enough & holds(set(telling.split()), len(telling.split())))
    # Every word stands between blanks of its own, so that neighbouring phrases share none.
    clean = F.when(some_phrase, F.concat(F.lit(" "), F.replace(word_text(F.col("text")), F.lit(" "), F.lit("  ")), F.lit(" ")))
    rows = rows.withColumn("spaced", F.coalesce(clean, F.lit("")))
    blanks = lambda text: F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in PHRASES.items():
        needle = " " + "  ".join(phrase.split()) + " "
        found = F.col("spaced").contains(needle)
        counts.append(F.when(found, F.size(F.split("spaced", needle, -1)) - 1).otherwise(0))
        firsts.append(F.when(found, blanks(F.substring_index("spaced", needle, 1)) / 2))
        lasts.append(F.when(found, F.col("n_words") - blanks(F.substring_index("spaced", needle, -1)) / 2 - len(phrase.split())))
        labels.append(F.when(found, F.lit(label)))
    return rows.select(
        "doc_id",
        "digest",
        "n_words",
        "present",
        sum(counts[1:], counts[0]).cast("bigint").alias("n_base"),
        F.least(*firsts).cast("bigint").alias("first_word"),
        F.greatest(*lasts).cast("bigint").alias("last_word"),
        F.array_compact(F.array(*labels)).alias("base"),
        F.when(some_template, F.col("text")).alias("text"),
    )


def ordered_vocabulary(facts: DataFrame) -> list[str]:
    """The words of the templates by the number of documents that hold them, rarest first; ties by the word."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    held = facts.select(F.explode("present").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    counts = {row["word"]: row["n"] for row in held.collect()}
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def prefix_index(vocabulary: list[str], containment: float) -> list[dict]:
    """A row per template and word of its prefix; as small as the list of templates."""
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for label, text, telling in TEMPLATES:
        words = sorted(set(text.split()), key=place.__getitem__)
        least = least_overlap(set(words), containment)
        facts = {"label": label, "words": words, "telling": telling.split(), "least": least, "width": block_width(text, containment)}
        rows.extend({**facts, "place": i, "word": word} for i, word in enumerate(words[: len(words) - least + 1]))
    return rows


def template_matches(facts: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """Rows of (doc_id, digest, found, best): labels and best containment of the documents that match a template."""
    vocabulary = ordered_vocabulary(facts)
    index = prefix_index(vocabulary, containment)
    widest = max(r["width"] for r in index)
    rarest = _strings(sorted({r["word"] for r in index}))
    # A block can only match if its document holds a prefix word.
    candidates = facts.filter(F.col("text").isNotNull() & F.arrays_overlap("present", rarest))
    candidates = candidates.select("doc_id", "digest", words_of(word_text(F.col("text"))).alias("all_words"))
    # The words around each prefix word, far enough for every block that holds it; the text itself goes no further.
    everywhere = F.transform("all_words", lambda word, i: F.when(F.array_contains(rarest, word), i + 1))

    def around(place: Column) -> Column:
        first = F.greatest(place - (widest - 1), F.lit(1))
        return F.struct(F.slice("all_words", first, place - first + widest).alias("near"), (place - first + 1).alias("at"))

    anchors = candidates.select("doc_id", "digest", F.inline(F.transform(F.array_compact(everywhere), around)))
    anchors = anchors.withColumn("word", F.element_at("near", F.col("at")))
    # At most a few rows per template, whatever the size of the corpus.
    templates = facts.sparkSession.range(1).select(
        F.inline(F.array(*[
            F.struct(
                F.lit(r["label"]).alias("label"), _strings(r["words"]).alias("words"), _strings(r["telling"]).alias("telling"),
                F.lit(r["least"]).alias("least"), F.lit(r["width"]).alias("width"), F.lit(r["place"]).alias("place"),
                F.lit(r["word"]).alias("word"),
            )
            for r in index
        ]))
    )
    starts = F.filter(
        F.sequence(F.greatest(F.col("at") - F.col("width") + 1, F.lit(1)), F.col("at")),
        lambda s: F.array_contains("words", F.element_at("near", s)),
    )
    windows = F.transform(starts, lambda s: F.array_intersect(_strings(vocabulary), F.slice("near", s, F.col("width"))))
    blocks = anchors.join(F.broadcast(templates), "word").select(
        "doc_id", "digest", "word", "label", "words", "telling", "least", "place",
        F.explode(F.array_distinct(windows)).alias("block"),
    )
    before = F.array_position("block", F.col("word")) - 1
    rest = F.least(F.size("words") - F.col("place"), F.size("block") - before)
    pairs = (
        blocks.filter(F.size("block") >= F.col("least"))
        .filter(before <= F.size("block") - F.col("least"))
        .filter(rest >= F.col("least"))
    )
    overlap = F.size(F.array_intersect("block", "words"))
    told = F.size(F.array_intersect("block", "telling")) == F.size("telling")
    verified = pairs.withColumn("overlap", overlap).filter((F.col("overlap") >= F.col("least")) & told)
    return verified.groupBy("doc_id", "digest").agg(
        F.collect_set("label").alias("found"), F.max(F.col("overlap") / F.size("words")).alias("best")
    )


def scan(documents: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """License phrases and notices of every document.

    Result: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.  ``score`` is 1 if a phrase was
    found, else the largest containment of a matched template, 0 without one.  A null or empty text has no words, no
    labels and null positions.  Repeated rows give repeated rows, null doc_ids are kept.  Other columns are not read.
    """
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    # Read for the word frequencies, the matches and the result; holds texts only where a template may match.
    facts = cut_lineage(facts_of(rows, containment))
    matches = template_matches(facts, containment).withColumnsRenamed({"doc_id": "match_id", "digest": "match_digest"})
    joined = facts.join(matches, F.col("doc_id").eqNullSafe(F.col("match_id")) & (F.col("digest") == F.col("match_digest")), "left")
    found = F.coalesce("found", F.array().cast("array<string>"))
    named = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        named(F.col("base")).alias("base_labels"),
        named(F.concat("base", found)).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def _sql_list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def scan_sql(containment: float = CONTAINMENT) -> str:
    """The same by brute force: the block at every word against every template that the document has enough words of."""
    phrases = ", ".join(f"({_sql_list(p.split())}, '{label}')" for p, label in PHRASES.items())
    templates = ", ".join(
        f"('{label}', {_sql_list(sorted(set(text.split())))}, {_sql_list(telling.split())}, "
        f"{math.ceil(containment * len(set(text.split())) - 1e-9)}, {math.ceil(len(text.split()) / containment - 1e-9)})"
        for label, text, telling in TEMPLATES
    )
    return rf"""
WITH phrases(words, label) AS (VALUES {phrases}), templates(label, words, telling, least, width) AS (VALUES {templates}), split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{"".join(map(chr, range(65, 91)))}',
           '{"".join(map(chr, range(97, 123)))}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), places AS (
    SELECT doc_id, label, unnest([i FOR i IN range(len(split.words)) IF split.words[i + 1 : i + len(phrases.words)] = phrases.words]) AS place
    FROM split, phrases
), base AS (
    SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, list(DISTINCT label) AS labels
    FROM places GROUP BY doc_id
), blocks AS (
    SELECT doc_id, label, templates.words, telling, least,
           unnest([split.words[i + 1 : i + width] FOR i IN range(len(split.words))]) AS block
    FROM split, templates WHERE len(list_intersect(templates.words, split.words)) >= least
), matched AS (
    SELECT doc_id, label, len(list_intersect(words, block)) AS overlap, len(words) AS size
    FROM blocks WHERE len(list_intersect(words, block)) >= least AND list_has_all(block, telling)
), found AS (
    SELECT doc_id, list(DISTINCT label) AS labels, max(overlap / CAST(size AS DOUBLE)) AS best FROM matched GROUP BY doc_id
)
SELECT split.doc_id, len(split.words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base.labels), ','), '') AS base_labels,
       array_to_string(list_sort(list_distinct(coalesce(base.labels, []) || coalesce(found.labels, []))), ',') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score
FROM split LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""
