"""Language identification with interpolated Kneser-Ney character models.

One model per language: n-grams of characters within words, a word being its letters between two boundary signs.  The
models are fitted on a bounded sample of labelled rows (:data:`SAMPLE` documents per language); n-grams are counted in
Spark.  A model stores its probabilities as sorted arrays of n-gram hashes, all languages side by side, and is looked
up by binary search.  A text gets the language with the lowest cross-entropy per sign; it is rejected when that
cross-entropy lies farther above the language's own texts than any calibration text did, by a wide margin.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, fresh, slices

#: Documents per language that are drawn for fitting (expected number), and the part of them used for calibration.
SAMPLE, CALIBRATION = 800, 0.25

#: Longest n-gram, and n-grams the models may hold together: at most 40 bytes each plus 8 per language are broadcast.
ORDER, MOST_GRAMS = 4, 2_000_000

#: Share of the way from a language's own texts to foreign ones that the cross-entropy of an accepted text may go.
TOLERANCE = 0.75

#: Words whose scores a worker remembers.
REMEMBERED = 150_000

UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mixed(raw: np.ndarray, order: int) -> np.ndarray:
    """Spread the bits of a rolling sum; the order of the n-gram is part of the hash."""
    x = raw + np.array([order], np.uint64) * _MIX
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _STEP
    return x ^ (x >> np.uint64(32))


@dataclass
class Grams:
    """The n-grams of a list of words: ``place`` is the position in the word, 0 for the boundary in front of it."""

    word: np.ndarray
    place: np.ndarray
    #: By order n: hash of the n-gram that ends at a position, and of its first n - 1 signs.
    gram: dict[int, np.ndarray] = field(default_factory=dict)
    context: dict[int, np.ndarray] = field(default_factory=dict)


def grams_of(words: list[str], order: int = ORDER) -> Grams:
    """All n-grams; position i of order n is one only where ``place[i] >= n - 1`` and ``place[i] >= 1``."""
    joined = " " + "  ".join(words) + " " if words else ""
    codes = np.frombuffer(joined.encode("utf-32-le"), "<u4").astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(codes)) - np.repeat(starts, lengths)
    found = Grams(word, place)
    single = codes + np.uint64(1)
    raw = single
    found.gram[1], found.context[1] = _mixed(raw, 1), np.zeros(len(codes), np.uint64)
    for n in range(2, order + 1):
        before = np.r_[np.uint64(0), raw[:-1]] if len(raw) else raw
        found.context[n] = _mixed(before, n - 1)
        raw = single + _STEP * before
        found.gram[n] = _mixed(raw, n)
    return found


def words_of(texts: pa.Array) -> pa.ListArray:
    """Lower-case words of letters of each text; null texts have none."""
    letters = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}]+", " ")
    return pc.split_pattern(pc.utf8_trim(letters, " "), " ")


class Models:
    """Kneser-Ney models of all languages over one sorted array of hashes."""

    def __init__(self, languages: list[str], counts: pd.DataFrame, order: int = ORDER) -> None:
        """``counts`` has a row per language and n-gram: lang, n, gram, context, suffix, opens, count."""
        self.languages, self.order = languages, order
        number = {l: i for i, l in enumerate(languages)}
        counts = counts.assign(lang=counts["lang"].map(number))
        if len(counts) > MOST_GRAMS:
            top = counts["n"] == order
            spare = counts[top].sort_values(["count", "gram"]).index[: len(counts) - MOST_GRAMS]
            counts = counts.drop(index=spare)
        # A lower-order n-gram counts once per sign that precedes it, one at the start of a word as often as it occurs.
        preceded = counts.groupby(["lang", "n", "suffix"]).size().reset_index(name="types")
        preceded = preceded.assign(n=preceded["n"] - 1).rename(columns={"suffix": "gram"})
        counts = counts.merge(preceded, on=["lang", "n", "gram"], how="left")
        raw = (counts["n"] == order) | counts["opens"]
        counts["kn"] = np.where(raw, counts["count"], counts["types"].fillna(0)).astype("float64")
        counts = counts[counts["kn"] > 0]
        ones = counts[counts["kn"] == 1].groupby(["lang", "n"]).size()
        twos = counts[counts["kn"] == 2].groupby(["lang", "n"]).size()
        pair = pd.MultiIndex.from_product([range(len(languages)), range(1, order + 1)], names=["lang", "n"])
        ones, twos = ones.reindex(pair, fill_value=0), twos.reindex(pair, fill_value=0)
        discount = (ones / (ones + 2 * twos).where(lambda x: x > 0, 1)).clip(0.1, 0.95).rename("discount")
        counts = counts.join(discount, on=["lang", "n"])
        whole = counts.groupby(["lang", "n", "context"])["kn"].agg(["sum", "size"]).reset_index()
        whole = whole.join(discount, on=["lang", "n"])
        whole["back"] = whole["discount"] * whole["size"] / whole["sum"]
        counts = counts.merge(whole[["lang", "n", "context", "sum", "back"]], on=["lang", "n", "context"])
        signs = counts.loc[counts["n"] == 1, "gram"].nunique() + 1
        self.signs = int(signs)
        self.floor = np.zeros(len(languages), np.float32)
        first = whole[whole["n"] == 1]
        self.floor[first["lang"]] = np.log2(first["back"] / signs)
        lower = None
        done = []
        for n in range(1, order + 1):
            part = counts[counts["n"] == n].copy()
            if lower is None:
                part["below"] = 1.0 / signs
            else:
                part = part.merge(lower, on=["lang", "suffix"], how="left")
                part["below"] = part["below"].fillna(0.0)
            part["p"] = (part["kn"] - part["discount"]).clip(lower=0) / part["sum"] + part["back"] * part["below"]
            lower = part[["lang", "gram", "p"]].rename(columns={"gram": "suffix", "p": "below"})
            done.append(part[["lang", "gram", "p"]])
        self.grams, self.log_p = self._table(pd.concat(done), "gram", "p", np.nan)
        self.contexts, self.log_back = self._table(whole[whole["n"] > 1], "context", "back", 0.0)

    def _table(self, rows: pd.DataFrame, key: str, value: str, missing: float) -> tuple[np.ndarray, np.ndarray]:
        keys, place = np.unique(rows[key].to_numpy("int64").view(np.uint64), return_inverse=True)
        table = np.full((len(keys), len(self.languages)), missing, np.float32)
        table[place, rows["lang"].to_numpy()] = np.log2(rows[value].to_numpy())
        return keys, table

    def word_bits(self, words: list[str]) -> np.ndarray:
        """Logarithm to base 2 of the probability of each word in each language."""
        found = grams_of(words, self.order)
        total = np.zeros((len(words), len(self.languages)))
        if not words:
            return total
        told = np.flatnonzero(found.place >= 1)
        log_p = self._looked_up(self.grams, self.log_p, found.gram[1][told], np.nan)
        log_p = np.where(np.isnan(log_p), self.floor, log_p)
        for n in range(2, self.order + 1):
            at = np.flatnonzero(found.place[told] >= n - 1)
            here = told[at]
            higher = self._looked_up(self.grams, self.log_p, found.gram[n][here], np.nan)
            back = self._looked_up(self.contexts, self.log_back, found.context[n][here], 0.0)
            log_p[at] = np.where(np.isnan(higher), log_p[at] + back, higher)
        ends = np.flatnonzero(np.r_[found.word[told][1:] != found.word[told][:-1], True])
        return np.diff(np.concatenate([np.zeros((1, log_p.shape[1])), np.cumsum(log_p, axis=0, dtype=np.float64)[ends]]), axis=0)

    @staticmethod
    def _looked_up(keys: np.ndarray, table: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
        if not len(keys):
            return np.full((len(wanted), table.shape[1]), missing, np.float32)
        distinct, place = np.unique(wanted, return_inverse=True)
        at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
        rows = np.where((keys[at] == distinct)[:, None], table[at], np.float32(missing))
        return rows[place]


class Scorer:
    """Cross-entropies of texts; remembers the words it has met."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.known: dict[str, int] = {}
        self.bits = np.zeros((0, len(models.languages)))

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Bits per sign in each language, and the number of signs (letters, and an end for each word)."""
        lists = words_of(texts)
        words = pc.dictionary_encode(lists.flatten())
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        distinct = words.dictionary.to_pylist()
        if len(self.known) > REMEMBERED:
            self.known, self.bits = {}, self.bits[:0]
        new = [w for w in distinct if w not in self.known]
        if new:
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.bits = np.concatenate([self.bits, self.models.word_bits(new)])
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        bits = self.bits[number]
        signs = np.fromiter(map(len, distinct), np.int64, len(distinct)) + 1
        empty = np.array([w == "" for w in distinct], bool)  # a text without letters gives one empty word
        bits[empty], signs[empty] = 0.0, 0
        index = words.indices.to_numpy()
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        sums = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits[index], axis=0)])
        count = np.r_[0, np.cumsum(signs[index])]
        total = count[offsets[1:]] - count[offsets[:-1]]
        return -(sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(total, 1)[:, None], total


@dataclass
class Calibration:
    """Cross-entropies a language's model gives to its own texts and to texts of others, found on calibration texts."""

    own: np.ndarray
    other: np.ndarray
    #: Deviation of own texts times the root of their signs: short texts vary more.
    spread: np.ndarray
    sharpness: float

    @classmethod
    def fit(cls, entropies: np.ndarray, signs: np.ndarray, truth: np.ndarray, signs_known: int) -> Calibration:
        languages = entropies.shape[1]
        # Until texts of another language say better, a text of random signs stands for them.
        own, other = np.full(languages, 0.5 * np.log2(signs_known)), np.full(languages, np.log2(signs_known))
        spread = np.full(languages, 4.0)
        for l in range(languages):
            mine = truth == l
            if mine.sum() < 8:
                continue
            own[l] = np.median(entropies[mine, l])
            spread[l] = max(0.5, 1.5 * np.median(np.abs(entropies[mine, l] - own[l]) * np.sqrt(signs[mine])))
            if (~mine).sum() >= 8:
                other[l] = np.median(entropies[~mine, l])
        other = np.maximum(other, own + 0.5)
        best, at = -np.inf, 1.0
        for sharpness in (0.25, 0.5, 1.0, 2.0, 4.0, 8.0):
            log = -entropies * np.sqrt(np.maximum(signs, 1))[:, None] * sharpness
            log -= log.max(axis=1, keepdims=True, initial=-np.inf) if languages else 0
            log -= np.log(np.exp(log).sum(axis=1, keepdims=True))
            value = np.maximum(log[np.arange(len(truth)), truth], -20).sum() if len(truth) else 0.0
            if value > best:
                best, at = value, sharpness
        return cls(own, other, spread, at)

    def judge(self, entropies: np.ndarray, signs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, confidence from 0 to 1, and whether the text is rejected.

        A text is rejected when even its best language fits it little better than a text of some other language:
        beyond TOLERANCE of the way, and three deviations more for a short text.
        """
        pick = entropies.argmin(axis=1)
        low = entropies[np.arange(len(pick)), pick]
        root = np.sqrt(np.maximum(signs, 1))
        share = 1 / np.exp(-(entropies - low[:, None]) * root[:, None] * self.sharpness).sum(axis=1)
        way = self.other[pick] - self.own[pick]
        beyond = (low - self.own[pick] - 3 * self.spread[pick] / root) / way - TOLERANCE
        return pick, share / (1 + np.exp(np.clip(12 * beyond, -50, 50))), beyond > 0


def draw_sample(documents: DataFrame, learn: Column, size: int) -> DataFrame:
    """About ``size`` labelled documents of every language, drawn by a hash of the row: text, lang, calibrate."""
    rows = documents.filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("text", "lang", F.lit(False).alias("calibrate")).limit(0)
    share = F.create_map(*[F.lit(x) for l, n in counts.items() for x in (l, min(1.0, size / n))])
    chance = lambda seed: F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(1 << 30)) / (1 << 30)
    drawn = rows.filter(chance(1) < F.element_at(share, F.col("lang")))
    return drawn.select("text", "lang", (chance(2) < CALIBRATION).alias("calibrate"))


def count_grams(sample: DataFrame, order: int) -> DataFrame:
    """Occurrences of each n-gram per language."""
    names = ["lang", "n", "gram", "context", "suffix", "opens", "count"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lists = words_of(batch.column("text"))
            parents = pc.list_parent_indices(lists).to_numpy()
            table = pd.DataFrame({"lang": np.array(batch.column("lang").to_pylist(), object)[parents], "w": lists.flatten().to_pandas()})
            table = table[table["w"] != ""].groupby(["lang", "w"]).size().reset_index(name="c")
            found = grams_of(table["w"].tolist(), order)
            lang, times = table["lang"].to_numpy()[found.word], table["c"].to_numpy()[found.word]
            parts = []
            for n in range(1, order + 1):
                at = np.flatnonzero(found.place >= max(1, n - 1))
                parts.append(pd.DataFrame({
                    "lang": lang[at], "n": n, "gram": found.gram[n][at].view("int64"), "context": found.context[n][at].view("int64"),
                    "suffix": found.gram[n - 1][at].view("int64") if n > 1 else np.int64(0),
                    "opens": (found.place[at] == n - 1) & (n > 1), "count": times[at],
                }))
            rows = pd.concat(parts).groupby(names[:-1], as_index=False)["count"].sum()
            yield pa.RecordBatch.from_pandas(rows.astype({"n": "int32"})[names], preserve_index=False)

    schema = "lang string, n int, gram bigint, context bigint, suffix bigint, opens boolean, count bigint"
    counted = sample.select("text", "lang").mapInArrow(run, schema)
    return counted.groupBy(*names[:-1]).agg(F.sum("count").alias("count"))


def train(documents: DataFrame, learn: Column, order: int = ORDER, size: int = SAMPLE) -> tuple[Models, Calibration] | None:
    """Models fitted on a bounded sample of the labelled rows where ``learn`` holds; None without any."""
    sample = cut_lineage(draw_sample(documents, learn, size))
    counts = count_grams(sample.filter("not calibrate"), order).toPandas()
    if counts.empty:
        counts = count_grams(sample, order).toPandas()
    if counts.empty:
        return None
    languages = sorted(counts["lang"].unique())
    models = Models(languages, counts, order)
    shared = documents.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        for batch in slices(batches, "text"):
            entropies, signs = scorer.entropies(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), pa.array(signs), pa.array(list(entropies), pa.list_(pa.float64()))], ["lang", "signs", "bits"]
            )

    held = sample.filter("calibrate").select("text", "lang").mapInArrow(run, "lang string, signs bigint, bits array<double>")
    rows = held.filter(F.col("signs") > 0).filter(F.col("lang").isin(languages)).collect()
    bits = np.array([r["bits"] for r in rows], float).reshape(len(rows), len(languages))
    truth = np.array([languages.index(r["lang"]) for r in rows], int)
    return models, Calibration.fit(bits, np.array([r["signs"] for r in rows], float), truth, models.signs)


def identify(
    documents: DataFrame,
    learn: Column,
    order: int = ORDER,
    size: int = SAMPLE,
    keep: list[str] | None = None,
    names: Sequence[str] = ("lang_pred", "score", "rejected"),
) -> DataFrame:
    """The language of every whole text.

    ``learn`` says which rows may be learnt from; their ``lang`` is used for nothing else.  The result has the columns
    of ``keep`` (doc_id by default), then those of ``names``: the language, a confidence from 0 to 1, and whether the text
    is rejected.  A null text, or one without a letter, is
    ``und`` with score 0 and rejected; so is every text if no labelled row may be learnt from.  Repeated rows give
    repeated rows.  A kept column with the name of a result is replaced by it.
    """
    trained = train(documents, learn, order, size)
    results = dict(zip(names, ("string", "double", "boolean")))
    kept = [c for c in (keep or ["doc_id"]) if c not in results]
    if trained is None:
        nothing = (F.lit(UNKNOWN), F.lit(0.0), F.lit(True))
        return documents.select(*kept, *[value.alias(name) for value, name in zip(nothing, names)])
    shared = documents.sparkSession.sparkContext.broadcast(trained)
    judged = fresh(documents, "text_to_judge")[0]
    rows = documents.select(*kept, F.col("text").cast("string").alias(judged))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, calibration = shared.value
        scorer, names = Scorer(models), np.array(models.languages, object)
        for batch in slices(batches, judged):
            entropies, signs = scorer.entropies(batch.column(judged))
            pick, score, rejected = calibration.judge(entropies, signs)
            none = signs == 0
            predicted = np.where(none, UNKNOWN, names[pick])
            columns = [pa.array(predicted, pa.string()), pa.array(np.where(none, 0.0, score)), pa.array(none | rejected)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *columns], [*kept, *results])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(kept)]]
    return rows.mapInArrow(run, ", ".join([*fields, *[f"`{n}` {t}" for n, t in results.items()]]))
