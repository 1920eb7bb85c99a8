"""Text scores of a Katz back-off language model.

The model is a bigram model over words.  Every word of the training documents is a context, and so is the start of a
text.  Counts up to :data:`RELIABLE` are discounted by Good-Turing, and the mass this leaves is given to unseen words
in proportion to their unigram probability, with a back-off weight per context that makes the sum exactly one.
Unigrams leave theirs to one unknown word.

Counting and scoring share one shuffle of the texts.  Documents are dealt to blocks; a block asks for each of its
distinct words and pairs once, with its own training count.  Keys are dealt to buckets by their hash, and the requests
of a block for one bucket are one row of packed arrays.  A bucket sums the counts of each key and answers every block
that asked.  Back-off weights go the same way: blocks send what they know of their contexts, and which of them they
need, to the buckets of these.  Everything that depends on constants of the whole corpus (discounts, back-off weights)
is kept as counts per document until these are known.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, cut_lineage, lower_ascii

#: Least share of all tokens that makes a word a context; at 0 every word of the training documents is one.
CONTEXT_SHARE = 0.0

#: Counts up to here are discounted by Good-Turing; larger ones only by TRIM, so that every context can back off.
RELIABLE, TRIM = 5, 0.001

#: Tokens of a block of documents, on average (about 10 MB of text).
BLOCK_TOKENS = 1_500_000

END_WORD, START_WORD = " ", "  "  # no word holds a blank
END, START = (xxhash.xxh64_intdigest(w.encode(), 42) for w in (END_WORD, START_WORD))

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def token_hashes(text: Column) -> Column:
    """Hashes of the words of a text and of its end."""
    words = F.filter(F.split(lower_ascii(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(F.concat(words, F.array(F.lit(END_WORD))), lambda w: F.xxhash64(w))


def discounts(counts_of_counts: Sequence[float]) -> np.ndarray:
    """Katz's factors for counts 0 (unused) to RELIABLE, from the numbers of things counted 1 to RELIABLE + 1 times.

    Where these numbers are too irregular for Good-Turing, half a count is taken off instead.
    """
    n = np.array([0.0, *counts_of_counts])
    plain = np.array([1.0, *[(r - 0.5) / r for r in range(1, RELIABLE + 1)]])
    if (n[1 : RELIABLE + 2] <= 0).any():
        return plain
    r = np.arange(1, RELIABLE + 1)
    over = (RELIABLE + 1) * n[RELIABLE + 1] / n[1]
    found = ((r + 1) * n[r + 1] / n[r] / r - over) / (1 - over) if over < 1 else plain[1:]
    return np.array([1.0, *found]) if ((found > 0) & (found < 1)).all() else plain


def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The counts that seen things keep."""
    small = factors[np.minimum(counts, RELIABLE)] * counts
    return np.where(counts <= RELIABLE, small, counts - TRIM)


class Unigrams:
    """Probabilities of single words, and of the unknown word, which takes what the discounts leave."""

    def __init__(self, total: int, kinds: int, trimmed: int, counts_of_counts: Sequence[float]) -> None:
        """``trimmed`` words have larger counts than RELIABLE."""
        self.total, self.kinds = total, kinds
        self.factors = discounts(counts_of_counts)
        taken = sum((1 - self.factors[r]) * r * n for r, n in zip(range(1, RELIABLE + 1), counts_of_counts)) + TRIM * trimmed
        self.unknown = taken / total if total else 1.0

    def probability(self, counts: np.ndarray) -> np.ndarray:
        known = discounted(counts, self.factors) / max(1, self.total)
        return np.where(counts > 0, known, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.1) / (self.total + 0.1 * (self.kinds + 1)))


class Block:
    """The tokens of a block of documents, as numbers of its distinct words and pairs in an order of their own."""

    def __init__(self, texts: list[str | None], held: np.ndarray) -> None:
        words: list[bytes] = []
        sizes = np.empty(len(texts), np.int64)
        for i, text in enumerate(texts):
            own = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
            words += own
            words.append(END_WORD.encode())
            sizes[i] = len(own) + 1
        coded = pa.array(words, pa.binary()).dictionary_encode()
        del words
        hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()], np.uint64)
        # Distinct words are numbered by their hash, so the numbers don't depend on the order of the documents.
        self.words, place = np.unique(hashes, return_inverse=True)
        self.word = place[coded.indices.to_numpy()]
        self.held = held
        self.document = np.repeat(np.arange(len(texts)), sizes)
        self.training = ~held[self.document]
        # Contexts are the words, and after them the start of a text.
        many = len(self.words)
        self.names = np.r_[self.words, np.uint64(START)]
        self.context = np.r_[many, self.word[:-1]]
        self.context[np.cumsum(sizes)[:-1]] = many
        codes, self.pair_of = np.unique(self.context * many + self.word, return_inverse=True)
        self.pair_context, self.pair_word = codes // many, codes % many
        mixed = (self.words[self.pair_word] ^ (self.names[self.pair_context] * _PAIR)) * _PAIR
        #: A key per distinct word, then one per distinct pair, and their order by key.
        self.keys = np.r_[self.words, mixed ^ (mixed >> np.uint64(31))]
        self.order = np.argsort(self.keys, kind="stable")

    def counts(self) -> np.ndarray:
        """How often each key occurs in training documents."""
        words = np.bincount(self.word, self.training, len(self.words))
        among = np.bincount(self.pair_of, self.training, len(self.pair_word))
        return np.r_[words, among].astype(np.int64)

    def per_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.document, values, len(self.held))


def cut_by_bucket(keys: np.ndarray, number: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of every bucket that has some of the sorted keys."""
    buckets = ((keys >> np.uint64(32)) * np.uint64(number)) >> np.uint64(32)
    ends = [*(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(keys)] if len(keys) else []
    return [(int(buckets[start]), start, end) for start, end in zip([0, *ends[:-1]], ends)]


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte of all; the three high bytes are compressed, the others are random."""
    planes = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return planes[:5].tobytes() + zlib.compress(planes[5:].tobytes(), 1)


def unpacked_keys(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(data[: 5 * size] + zlib.decompress(data[5 * size :]), np.uint8).reshape(8, -1)
    return np.cumsum(planes.T.copy().view("<u8").ravel(), dtype=np.uint64)


def packed(counts: np.ndarray) -> bytes:
    """Counts in the fewest bytes each that hold the largest, byte by byte of all, compressed."""
    kind = np.min_scalar_type(int(counts.max())).newbyteorder("<")
    return zlib.compress(counts.ravel().astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes(), 1)


def unpacked(data: bytes, size: int) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, size)
    return planes.T.copy().view(f"<u{len(planes)}").ravel().astype(np.int64)


def bits(data: bytes, size: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=size).astype(bool)


def train_unigrams(documents: DataFrame) -> Unigrams:
    """Unigrams of training documents."""
    rows = documents.filter(~F.col("held_out"))
    counts = rows.select(F.explode(token_hashes(F.col("text"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    size = [F.count(F.when(F.col("n") == r, 1)).alias(f"n{r}") for r in range(1, RELIABLE + 2)]
    figures = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("kinds"), F.count(F.when(F.col("n") > RELIABLE, 1)).alias("large"), *size
    ).first()
    return Unigrams(figures["total"], figures["kinds"], figures["large"], [figures[f"n{r}"] for r in range(1, RELIABLE + 2)])


#: Rows of documents, and rows of what a block knows of its contexts in one bucket.
FEATURES = (
    "block int, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, log_unigram double, "
    "log_pair double, pairs array<bigint>, unseen array<int>, "
    "bucket int, sums array<bigint>, size int, names binary, kinds binary, large binary, mass binary, met binary, asks binary"
)


def score_texts(documents: DataFrame, held_out: Column) -> DataFrame:
    """Log10 probability of every text under a Katz model learnt from the rows that are not ``held_out``.

    Result: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams), score.  A null or empty
    text is its end alone.  Repeated rows count as often as they occur and give repeated rows; a null doc_id is kept.
    With no training rows every token is the unknown word, which then has probability one.  Other columns are not read.
    """
    rows = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), held_out.alias("held_out")
    )
    unigrams = train_unigrams(rows)
    number = max(1, math.ceil(unigrams.total / BLOCK_TOKENS))
    least = max(1, CONTEXT_SHARE * unigrams.total)
    # Rows without an id are dealt by their text.
    blocks = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(number)).cast("int"))

    def block_of(table: pa.Table) -> Block:
        held = table.column("held_out").to_numpy().astype(bool)
        return Block(table.column("text").to_pylist(), held)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        own = block_of(table)
        keys, n = own.keys[own.order], own.counts()[own.order]
        cuts = cut_by_bucket(keys, number)
        return pa.table({
            "block": pa.array([key[0].as_py()] * len(cuts), pa.int32()),
            "bucket": pa.array([bucket for bucket, _, _ in cuts], pa.int32()),
            "size": pa.array([j - i for _, i, j in cuts], pa.int32()),
            "keys": pa.array([packed_keys(keys[i:j]) for _, i, j in cuts], pa.binary()),
            "n": pa.array([packed(n[i:j]) for _, i, j in cuts], pa.binary()),
        })

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        keys = [unpacked_keys(k, size) for k, size in zip(table.column("keys").to_pylist(), table.column("size").to_pylist())]
        ends = np.cumsum([len(k) for k in keys])
        n = np.concatenate([unpacked(x, len(k)) for x, k in zip(table.column("n").to_pylist(), keys)])
        _, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        total = np.bincount(place, n).astype(np.int64)[place]
        # The first block that asks for a pair speaks for it in the sums over all distinct pairs.
        speaks = np.zeros(len(place), bool)
        speaks[first] = True
        return pa.table({
            "block": table.column("block"), "bucket": table.column("bucket"),
            "size": table.column("size"),
            "n": pa.array([packed(x) for x in np.split(total, ends[:-1])], pa.binary()),
            "speaks": pa.array([np.packbits(x).tobytes() for x in np.split(speaks, ends[:-1])], pa.binary()),
        })

    asked = blocks.groupBy("block").applyInArrow(ask, "block int, bucket int, size int, keys binary, n binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, size int, n binary, speaks binary")

    def tell(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        schema = _arrow(FEATURES)
        if not table.num_rows:
            return pa.Table.from_pylist([], schema)
        own = block_of(table)
        told = answers.sort_by("bucket").select(["size", "n", "speaks"]).to_pylist()
        n, speak = np.empty(len(own.keys), np.int64), np.empty(len(own.keys), bool)
        n[own.order] = np.concatenate([unpacked(x["n"], x["size"]) for x in told])
        speak[own.order] = np.concatenate([bits(x["speaks"], x["size"]) for x in told])
        many = len(own.words)
        words, pairs = n[:many], n[many:]
        probability = unigrams.probability(words)
        count = words[own.word]
        # There are as many starts of texts as ends.
        sizes = np.r_[words, words[np.searchsorted(own.words, np.uint64(END))]]
        is_context = np.r_[words >= least, True]
        # Tokens after a context are pairs, seen or not; the others are unigrams.
        pair_count = np.where(is_context[own.pair_context], pairs, 0)[own.pair_of]
        seen = pair_count > 0
        log_one = np.where(seen, 0.0, np.log10(probability)[own.word])
        kept = np.where(pair_count > RELIABLE, np.maximum(pair_count, 1) - TRIM, np.maximum(pair_count, 1))
        log_two = np.where(seen, np.log10(kept) - np.log10(np.maximum(sizes[own.context], 1)), 0.0)
        kinds = np.stack([own.per_document(seen & (pair_count == r)) for r in range(1, RELIABLE + 1)], axis=1).astype(np.int64)
        missed = np.flatnonzero(is_context[own.context] & ~seen)
        cuts = np.searchsorted(own.document[missed], np.arange(len(own.held) + 1)).astype(np.int32)
        by_hash = np.argsort(own.names, kind="stable")
        asks = np.zeros(many + 1, bool)
        asks[own.context[missed]] = True
        # Numbers of the contexts whose weight is asked for, in the order of their hashes.
        number_of = np.empty(many + 1, np.int32)
        number_of[by_hash] = np.cumsum(asks[by_hash]) - 1
        documents_part = {
            "block": pa.array(np.full(table.num_rows, key[0].as_py(), np.int32)),
            "doc_id": table.column("doc_id").combine_chunks(),
            "held_out": pa.array(own.held),
            "n_tokens": pa.array(own.per_document(np.ones(len(own.word))).astype(np.int64)),
            "n_known": pa.array(own.per_document(count > 0).astype(np.int64)),
            "base_score": pa.array(own.per_document(unigrams.base(count))),
            "log_unigram": pa.array(own.per_document(log_one)),
            "log_pair": pa.array(own.per_document(log_two)),
            "pairs": pa.FixedSizeListArray.from_arrays(pa.array(kinds.ravel()), RELIABLE).cast(pa.list_(pa.int64())),
            "unseen": pa.ListArray.from_arrays(pa.array(cuts), pa.array(number_of[own.context[missed]])),
        }
        # For the distinct seen pairs this block speaks for: per context how many have which count, how many a large
        # one, the sum of the counts, and the unigram probability of the words.
        mine = speak[many:] & (pairs > 0) & is_context[own.pair_context]
        at, value, word = own.pair_context[mine], pairs[mine], own.pair_word[mine]
        per_context = lambda x: np.bincount(at, x, many + 1)
        by_count = np.stack([per_context(value == r) for r in range(1, RELIABLE + 2)]).astype(np.int64)
        large, mass, met = per_context(value > RELIABLE).astype(np.int64), per_context(value).astype(np.int64), per_context(probability[word])
        some = by_hash[(asks | (mass > 0))[by_hash]]
        parts = [(bucket, some[i:j]) for bucket, i, j in cut_by_bucket(own.names[some], number)]
        contexts_part = {
            "block": pa.array([key[0].as_py()] * len(parts), pa.int32()),
            "bucket": pa.array([bucket for bucket, _ in parts], pa.int32()),
            "sums": pa.array([by_count[:, x].sum(axis=1).tolist() for _, x in parts], pa.list_(pa.int64())),
            "size": pa.array([len(x) for _, x in parts], pa.int32()),
            "names": pa.array([packed_keys(own.names[x]) for _, x in parts], pa.binary()),
            "kinds": pa.array([packed(by_count[:RELIABLE, x]) for _, x in parts], pa.binary()),
            "large": pa.array([packed(large[x]) for _, x in parts], pa.binary()),
            "mass": pa.array([packed(mass[x]) for _, x in parts], pa.binary()),
            "met": pa.array([met[x].tobytes() for _, x in parts], pa.binary()),
            "asks": pa.array([np.packbits(asks[x]).tobytes() if asks[x].any() else None for _, x in parts], pa.binary()),
        }
        return pa.concat_tables([_filled(documents_part, schema), _filled(contexts_part, schema)])

    features = blocks.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(tell, FEATURES)
    features = cut_lineage(features)
    contexts = features.filter("bucket is not null").select("block", "bucket", "size", "names", "kinds", "large", "mass", "met", "asks")
    sums = features.agg(*[F.coalesce(F.sum(F.col("sums")[r]), F.lit(0)) for r in range(RELIABLE + 1)]).first()
    factors = discounts(list(sums))

    def weigh(key: tuple, table: pa.Table) -> pa.Table:
        """The exactly normalising weights of the contexts that each block asked for."""
        rows = table.sort_by("block").to_pylist()
        names = [unpacked_keys(x["names"], x["size"]) for x in rows]
        _, place = np.unique(np.concatenate(names), return_inverse=True)
        off = (1 - factors[1:]) * np.arange(1, RELIABLE + 1)
        taken = [
            off @ unpacked(x["kinds"], len(own) * RELIABLE).reshape(RELIABLE, -1) + TRIM * unpacked(x["large"], len(own))
            for x, own in zip(rows, names)
        ]
        taken = np.bincount(place, np.concatenate(taken))
        mass = np.bincount(place, np.concatenate([unpacked(x["mass"], len(own)) for x, own in zip(rows, names)]))
        met = np.bincount(place, np.concatenate([np.frombuffer(x["met"]) for x in rows]))
        weight = np.where(mass > 0, taken / np.maximum(mass, 1) / np.maximum(1.0 - met, 1e-12), 1.0)
        of_row = np.split(np.log10(weight)[place], np.cumsum([len(own) for own in names])[:-1])
        found = [(x, own[bits(x["asks"], len(own))]) for x, own in zip(rows, of_row) if x["asks"] is not None]
        return pa.table({
            "block": pa.array([x["block"] for x, _ in found], pa.int32()),
            "bucket": pa.array([x["bucket"] for x, _ in found], pa.int32()),
            "weights": pa.array([own.tobytes() for _, own in found], pa.binary()),
        })

    weights = contexts.groupBy("bucket").applyInArrow(weigh, "block int, bucket int, weights binary")
    pair = np.log10(factors[1:])

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        back = np.frombuffer(b"".join(answers.sort_by("bucket").column("weights").to_pylist()))
        kinds = np.array(table.column("pairs").to_pylist(), float).reshape(table.num_rows, RELIABLE)
        unseen = table.column("unseen").to_pylist()
        met = np.array([back[own].sum() if own else 0.0 for own in unseen])
        score = table.column("log_unigram").to_numpy() + table.column("log_pair").to_numpy() + kinds @ pair + met
        return pa.table([*(table.column(c) for c in _FIRST), pa.array(score, pa.float64())], [*_FIRST, "score"])

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"
    told = features.filter("bucket is null").select("block", *_FIRST, "log_unigram", "log_pair", "pairs", "unseen")
    scored = told.groupBy("block").cogroup(weights.groupBy("block")).applyInArrow(finish, schema)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(unigrams.total).cast("bigint").alias("train_tokens"), "base_score", "score"
    )


_FIRST = ["doc_id", "held_out", "n_tokens", "n_known", "base_score"]


def _arrow(schema: str) -> pa.Schema:
    kinds = {
        "bigint": pa.int64(), "boolean": pa.bool_(), "double": pa.float64(), "int": pa.int32(),
        "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(),
    }
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])


def _filled(columns: dict[str, pa.Array], schema: pa.Schema) -> pa.Table:
    """A table of the schema; columns that are not given are null."""
    size = len(next(iter(columns.values())))
    return pa.table([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)
