"""Document fingerprints by I-Match over randomised lexicons.

The lexicon holds the words whose inverse document frequency lies in a band.  A document keeps its distinct lexicon
words, sorted, and hashes the ones that fall into each of several random subsets of the lexicon.  Subsets come in
densities, so that short documents meet the dense ones and long documents are compared on the sparse ones.  Two
documents are as alike as the share of subsets, met by either, that hash alike.

Frequent words bound the lexicon: words in at least a share s of all documents number at most (mean distinct words of a
document) / s, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


#: Band of the lexicon: shares of all documents that hold a word.  With 1000 distinct words a document on average, at most
#: 500 000 words of 8 bytes are broadcast.
LEAST_SHARE, MOST_SHARE = 0.002, 0.2

#: A word of a single document is never in the lexicon.
LEAST_DOCUMENTS = 2

#: One in so many lexicon words falls into some subset of each density (powers of two), and the subsets of a density.
DENSITIES = (1, 4, 16, 64)
SUBSETS = 16

#: Documents per ordered bucket, and buckets at most: their borders are the only values that reach the driver.
BUCKET_DOCUMENTS, MOST_BUCKETS = 1000, 32_768

WORD_BREAK = r"[^\p{L}\p{N}]+"


def distinct_words(text: Column) -> Column:
    """Hashes of the distinct words of a text, letter case aside."""
    words = F.array_remove(F.split(F.lower(text), WORD_BREAK), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def build_lexicon(documents: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Hashes of the words in the band, one row each."""
    total = documents.count()
    held = documents.select(F.explode(distinct_words(F.col("text"))).alias("word"))
    counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    band = (F.col("n") >= max(LEAST_DOCUMENTS, least * total)) & (F.col("n") <= most * total)
    return counts.filter(band).select("word")


def with_subset_hashes(documents: DataFrame, words: str, whole: str, output: str) -> DataFrame:
    """Add the hash of each subset's share of the sorted lexicon words, 0 where a subset has none.

    A document without lexicon words gets the hash of its whole text in every place.  Columns that later steps use more
    than once are worked out in steps of their own.
    """

    def place(word: Column, number: int, density: int) -> Column:
        # Each density reads bits of its own of the word's hash: the subset, or no subset beyond SUBSETS.
        return F.shiftrightunsigned(word, 16 * number).bitwiseAND(F.lit(density * SUBSETS - 1))

    def share(number: int, density: int, subset: int) -> Column:
        return F.filter(f"{output}_{number}", lambda w: place(w, number, density) == subset)

    def thinned(number: int, density: int) -> Column:
        return F.filter(f"{output}_0", lambda w: place(w, number, density) < SUBSETS)

    low = F.lit(0xFFFFFFFF)
    steps = documents.withColumn(f"{output}_0", F.sort_array(words))
    steps = steps.withColumns({f"{output}_{i}": thinned(i, d) for i, d in enumerate(DENSITIES) if i})
    shares = [share(i, d, k) for i, d in enumerate(DENSITIES) for k in range(SUBSETS)]
    hashed = F.transform(F.array(*shares), lambda s: F.when(F.size(s) > 0, F.xxhash64(s).bitwiseAND(low)).otherwise(F.lit(0)))
    missing = F.array_repeat(F.col(whole).bitwiseAND(low), len(shares))
    found = steps.withColumn(output, F.when(F.size(words) > 0, hashed).otherwise(missing))
    return found.drop(words, *[f"{output}_{i}" for i in range(len(DENSITIES))])


def as_text(hashes: Column) -> Column:
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of the subsets met by either document that hash alike."""
    met = F.size(F.filter(F.zip_with(left, right, lambda a, b: (a != 0) | (b != 0)), lambda x: x))
    same = F.size(F.filter(F.zip_with(left, right, lambda a, b: (a == b) & (a != 0)), lambda x: x))
    return F.coalesce(same / met, F.lit(0.0))


def bucket_borders(documents: DataFrame) -> list[int]:
    """The smallest doc_id of each of a bounded number of ordered buckets."""
    ids = documents.filter(F.col("doc_id").isNotNull()).select("doc_id")
    total = ids.count()
    if not total:
        return []
    parts = min(MOST_BUCKETS, max(1, total // BUCKET_DOCUMENTS))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / parts for i in range(parts)], 20 * parts).alias("c")).first()["c"]
    found = ids.groupBy(_bucket(sorted({int(c) for c in cuts})).alias("b")).agg(F.min("doc_id").alias("first"))
    return sorted(r["first"] for r in found.collect())


def _bucket(borders: Sequence[int]) -> Column:
    """Number of the bucket of a doc_id, from 0, found in two steps."""
    width = max(1, int(len(borders) ** 0.5))
    rows = [list(borders[i : i + width]) for i in range(0, len(borders), width)]
    longs = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    doc_id = F.col("doc_id")
    below = lambda values: F.size(F.filter(values, lambda b: b <= doc_id))
    row = F.greatest(below(longs([r[0] for r in rows])), F.lit(1))
    return ((row - 1) * width + F.greatest(below(F.element_at(F.array(*map(longs, rows)), row)), F.lit(1)) - 1).cast("int")


def in_order() -> WindowSpec:
    """A bucket in order; guests come last."""
    return Window.partitionBy("bucket").orderBy("guest", "doc_id", "tie")


def with_next(documents: DataFrame) -> DataFrame:
    """Rows of (bucket, guest, doc_id, tie, text, next_text): every document and the text of the one after it.

    The order is that of doc_id, ties by a hash of the text; the first document follows the last.  The text is shuffled
    once, to ordered buckets; the first document of a bucket is also sent to the bucket before as a guest.
    """
    borders = bucket_borders(documents)
    own = _bucket(borders) if borders else F.lit(0)
    tie = F.xxhash64("text")
    number = max(1, len(borders))
    first = F.col("doc_id").isin(borders) if len(borders) <= 64 else F.array_contains(
        F.array(*[F.lit(b).cast("bigint") for b in borders]), F.col("doc_id")
    )
    placed = documents.select("doc_id", "text", tie.alias("tie"))
    # A row without an id has no place in the order; such rows are dealt out by their text.
    home = F.when(F.col("doc_id").isNull(), -1 - F.pmod("tie", F.lit(number)).cast("int")).otherwise(own)
    placed = placed.withColumn("home", home).withColumn("starts", F.coalesce(first, F.lit(False)))
    seats = F.when(
        F.col("starts"),
        F.array(
            F.struct(F.col("home").alias("bucket"), F.lit(False).alias("guest")),
            F.struct(F.pmod(F.col("home") - 1, F.lit(number)).alias("bucket"), F.lit(True).alias("guest")),
        ),
    ).otherwise(F.array(F.struct(F.col("home").alias("bucket"), F.lit(False).alias("guest"))))
    seated = placed.withColumn("seat", F.explode(seats)).select("seat.bucket", "seat.guest", "doc_id", "tie", "text")
    following = F.lead("text").over(in_order())
    return seated.withColumn("next_text", F.when(F.col("doc_id").isNotNull(), following))


def fingerprint_edits(documents: DataFrame, least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is taken from the next document.

    Result: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.  A null text counts as
    empty; an empty text has the fingerprint of no words.  A row with a null doc_id has no next document: its half is cut
    off, and near_next is 0.  A single document is its own next one.  Rows that are repeated in doc_id and text follow
    each other.  Other columns are not read; an empty table gives no rows.
    """
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(cast(text as string), '') text")
    lexicon = build_lexicon(rows, least, most)
    pairs = with_next(rows)
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(
        F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)
    )
    pairs = pairs.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    numbered = pairs.withColumn("turn", F.row_number().over(in_order()))
    carried = ["bucket", "guest", "doc_id", "tie", "turn", "n_chars", "edited_sha256", "edited_whole"]
    # Every row brings a word that is always kept, so that rows without lexicon words stay.
    anchor = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.lit(False).alias("of_edited"), F.concat(distinct_words(F.col("text")), F.array(anchor)).alias("words")),
        F.struct(F.lit(True).alias("of_edited"), F.concat(distinct_words(F.col("edited")), F.array(anchor)).alias("words")),
    )
    prepared = numbered.select(
        *carried[:6], F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("edited").alias("edited_whole"), sides.alias("sides")
    )
    # The outer form, as the inner one adds a filter that works all words out again; no array is empty.
    halves = prepared.select(*carried, F.explode_outer("sides").alias("side"))
    words = halves.select(*carried, "side.of_edited", F.explode_outer("side.words").alias("word"))
    kept = words.join(F.broadcast(lexicon.union(lexicon.sparkSession.range(1).select(anchor))), "word")
    # The rows of a document lie in its bucket already: no further shuffle.
    gathered = kept.groupBy(*carried).agg(
        F.collect_list(F.when(~F.col("of_edited") & (F.col("word") != anchor), F.col("word"))).alias("own"),
        F.collect_list(F.when(F.col("of_edited") & (F.col("word") != anchor), F.col("word"))).alias("other"),
    )
    marked = with_subset_hashes(gathered, "own", "tie", "own_hashes")
    marked = with_subset_hashes(marked, "other", "edited_whole", "edited_hashes")
    following = F.lead("own_hashes").over(Window.partitionBy("bucket").orderBy("turn"))
    marked = marked.withColumn("next_hashes", F.when(F.col("doc_id").isNotNull(), following)).filter(~F.col("guest"))
    return marked.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_text(F.col("own_hashes")).alias("fingerprint"),
        as_text(F.col("edited_hashes")).alias("edited_fingerprint"),
        likeness(F.col("own_hashes"), F.col("edited_hashes")).alias("near_edited"),
        F.when(F.col("next_hashes").isNotNull(), likeness(F.col("own_hashes"), F.col("next_hashes"))).otherwise(0.0).alias("near_next"),
    )
