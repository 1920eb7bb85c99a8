"""Periodic runs of words in texts, found by recompression.

A run is a stretch of words with smallest period q that no neighbouring word extends, at least ``least_words`` words and
``least_periods`` periods long.  Such a stretch holds a point of the grid of its period (a multiple of a step that grows
with q) together with the words one and two periods on, so only grid points are asked: how far do the text from the
point and the text one period later agree, forwards and backwards?

Those longest common extensions come from a run-length grammar.  Recompression turns the words into ever shorter strings
of symbols: a round replaces blocks of equal neighbours by a symbol each, the next one replaces pairs of a left and a
right symbol, where every symbol is left or right by a hash.  Equal stretches are therefore cut alike apart from their
ends, so an extension is found by stepping over at most one symbol per round on the way up, and one on the way down.

All texts of a batch share one grammar, with barriers between the texts that no round merges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import fresh, slices

#: Bytes of text that are worked on at once, and grid points that are asked at once.
BATCH_BYTES, POINTS = 1_000_000, 2_000_000

RESULT = (
    "n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, "
    "collapsed_sha256 string, n_words bigint, n_dropped bigint"
)


@dataclass
class Round:
    """One string of the grammar: its symbols, which of them are barriers, and how they lie in the next string."""

    symbols: np.ndarray
    #: Place of each symbol's parent in the next string, and place of each parent's first symbol (and one past the end).
    parent: np.ndarray
    first: np.ndarray


def named(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Numbers from 0 for the distinct pairs of two arrays of numbers below 2**31."""
    return pd.factorize((left << 32) | right)[0].astype("int64")


def mixed(symbols: np.ndarray, salt: int) -> np.ndarray:
    """A pseudo-random bit of each symbol, another one for each salt."""
    x = symbols.astype("uint64") + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) & np.uint64(1)).astype(bool)


def grammar(words: np.ndarray, barrier: np.ndarray) -> list[Round]:
    """The strings from the words up, until only one symbol is left between two barriers.

    ``barrier`` marks symbols that stay alone; each of them occurs once.
    """
    rounds, symbols, number = [], words, 0
    while True:
        count = len(symbols)
        inner = ~barrier
        if number % 2 == 0:
            joined = np.zeros(count, bool)
            joined[1:] = (symbols[1:] == symbols[:-1]) & inner[1:] & inner[:-1]
        else:
            right = mixed(symbols, number)
            # Of the two ways round the one that replaces more pairs.
            at = inner[1:] & inner[:-1]
            if np.count_nonzero(at & ~right[:-1] & right[1:]) < np.count_nonzero(at & right[:-1] & ~right[1:]):
                right = ~right
            joined = np.zeros(count, bool)
            joined[1:] = at & ~right[:-1] & right[1:]
        start = np.nonzero(~joined)[0]
        ends = np.append(start[1:], count)
        parent = np.cumsum(~joined) - 1
        rounds.append(Round(symbols, parent, np.append(start, count)))
        # A block is named by its symbol and length, a pair by both symbols; a lone symbol has no second one.
        size = ends - start
        if number % 2 == 0:
            second = size
        else:
            second = np.where(size > 1, symbols[np.minimum(start + 1, count - 1)] + 1, 0)
        symbols, barrier = named(symbols[start], second), barrier[start]
        number += 1
        if number % 2 == 0 and not np.any(~barrier[1:] & ~barrier[:-1]):
            flat = np.arange(len(symbols) + 1)
            rounds.append(Round(symbols, flat[:-1], flat))
            return rounds


def extensions(rounds: list[Round], left: np.ndarray, right: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``left`` on equal those from ``right`` on, for many pairs of different places at once.

    Backwards, the words at the two places are the first ones compared.  Comparison ends at a barrier.
    """
    a, b = left.copy(), right.copy()
    step = 1 if forward else -1
    # The string in which a pair was found to differ; it climbs until then.
    stopped = np.full(len(a), -1)
    climbing = np.arange(len(a))
    for level, this in enumerate(rounds):
        x, y = a[climbing], b[climbing]
        last = level == len(rounds) - 1
        edge = this.first[:-1] if forward else this.first[1:] - 1
        inside = (edge[this.parent[x]] != x) | (edge[this.parent[y]] != y)
        differs = this.symbols[x] != this.symbols[y]
        halt = differs & (inside | last)
        # Step over the rest of the block or pair that one of the two is inside of.
        over = np.nonzero(inside & ~halt)[0]
        if len(over):
            p, q = x[over], y[over]
            far = this.first[1:] - 1 if forward else this.first[:-1]
            rest = 1
            if level % 2 == 0:
                rest = np.minimum(np.abs(far[this.parent[p]] - p), np.abs(far[this.parent[q]] - q)) + 1
            x[over], y[over] = p + step * rest, q + step * rest
            # Now both are at an edge, or one block went on: then the next symbols differ.
            p, q = x[over], y[over]
            halt[over] = (edge[this.parent[p]] != p) | (edge[this.parent[q]] != q)
        a[climbing], b[climbing] = x, y
        stopped[climbing[halt]] = level
        climbing = climbing[~halt]
        if not len(climbing):
            break
        if not last:
            a[climbing], b[climbing] = this.parent[a[climbing]], this.parent[b[climbing]]
    # Down again: under two differing symbols at most one block or symbol is equal.
    for level in range(len(rounds) - 2, -1, -1):
        going = np.nonzero(stopped > level)[0]
        if not len(going):
            continue
        this = rounds[level]
        near, far = (this.first[:-1], this.first[1:] - 1) if forward else (this.first[1:] - 1, this.first[:-1])
        x, y = near[a[going]], near[b[going]]
        same = np.nonzero(this.symbols[x] == this.symbols[y])[0]
        if len(same):
            p, q = a[going[same]], b[going[same]]
            # Of two blocks the shorter one, of two pairs the symbol at the edge.
            rest = 1 if level % 2 else np.minimum(np.abs(far[p] - near[p]), np.abs(far[q] - near[q])) + 1
            x[same] += step * rest
            y[same] += step * rest
        a[going], b[going] = x, y
    return np.abs(a - left)


def grid(lengths: np.ndarray, offsets: np.ndarray, least_words: int, least_periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points of all texts with their periods, in portions of about ``POINTS``.

    A run of period q covers max(least_words, least_periods*q) words, so one of every so many less 2q neighbouring
    places is followed by two more periods inside the run.
    """
    if not len(lengths):
        return
    texts, periods = [], []
    held = 0

    def portion() -> tuple[np.ndarray, np.ndarray]:
        text, period = np.concatenate(texts), np.concatenate(periods)
        step = np.maximum(least_words, least_periods * period) - 2 * period
        count = np.maximum(0, (lengths[text] - 2 * period - 1) // step + 1)
        which = np.repeat(np.arange(len(text)), count)
        place = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        return offsets[text[which]] + place * step[which], period[which]

    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    longest = int(sorted_lengths[0])
    for q in range(1, longest // least_periods + 1):
        need = max(least_words, least_periods * q)
        enough = order[: int(np.searchsorted(-sorted_lengths, -need, side="right"))]
        if not len(enough):
            break
        # A text longer than a portion is asked in portions of its own periods.
        texts.append(enough)
        periods.append(np.full(len(enough), q))
        held += int((lengths[enough] // (need - 2 * q) + 1).sum())
        if held >= POINTS:
            yield portion()
            texts, periods, held = [], [], 0
    if texts:
        yield portion()


def promising(words: np.ndarray, at: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Grid points where a run may lie: some of the words up to one period on equal those a period later.

    All of them must be equal within a run, so a point that differs in one is settled.
    """
    chosen = np.arange(len(at))
    for share in (0, 1, 0.5, 0.25, 0.75, 0.125):
        place = at[chosen] + (period[chosen] * share).astype("int64")
        chosen = chosen[words[place] == words[place + period[chosen]]]
    return chosen


def find_runs(texts: list[np.ndarray], least_words: int = 24, least_periods: int = 3) -> list[np.ndarray]:
    """Runs of each text of word numbers, as rows of (start, length, period) by start, then period."""
    lengths = np.array([len(t) for t in texts], "int64")
    offsets = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype("int64") + 1 if len(texts) else lengths
    none = [np.empty((0, 3), "int64") for _ in texts]
    if not len(texts) or lengths.max() < max(least_words, least_periods):
        return none
    # One barrier before, between and behind the texts, each with a number of its own.
    most = max(int(t.max()) for t in texts if len(t)) + 1
    words = np.empty(int(lengths.sum()) + len(texts) + 1, "int64")
    barrier = np.zeros(len(words), bool)
    words[0], barrier[0] = most, True
    for i, text in enumerate(texts):
        words[offsets[i] : offsets[i] + len(text)] = text
        words[offsets[i] + len(text)] = most + 1 + i
        barrier[offsets[i] + len(text)] = True
    points, periods = [], []
    for at, period in grid(lengths, offsets, least_words, least_periods):
        chosen = promising(words, at, period)
        points.append(at[chosen])
        periods.append(period[chosen])
    at, period = np.concatenate(points), np.concatenate(periods)
    if not len(at):
        return none
    # Texts without a promising point hold no run and stay out of the grammar.
    text = np.searchsorted(offsets, at, side="right") - 1
    needed = np.unique(text)
    kept = np.zeros(len(words), bool)
    kept[0] = True
    for i in needed:
        kept[offsets[i] : offsets[i] + lengths[i] + 1] = True
    moved = np.cumsum(kept) - 1
    rounds = grammar(words[kept], barrier[kept])
    found = []
    for start in range(0, len(at), POINTS):
        p, q = moved[at[start : start + POINTS]], period[start : start + POINTS]
        ahead = extensions(rounds, p, p + q, forward=True)
        behind = extensions(rounds, p, p + q, forward=False) - 1
        length = behind + ahead + q
        long = length >= np.maximum(least_words, least_periods * q)
        # Back to places within the text.
        origin = offsets[text[start : start + POINTS]]
        begin = at[start : start + POINTS] - behind - origin
        found.append(np.stack([text[start : start + POINTS], begin, length, q], axis=1)[long])
    rows = np.concatenate(found)
    # A stretch that has a smaller period too was found with it, with the same ends.
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    fresh_row = np.ones(len(rows), bool)
    fresh_row[1:] = np.any(rows[1:, :3] != rows[:-1, :3], axis=1)
    rows = rows[fresh_row]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]
    at_text, begin = np.unique(rows[:, 0], return_index=True)
    for i, own in zip(at_text, np.split(rows[:, 1:], begin[1:])):
        none[i] = own
    return none


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which words no run holds after its first period."""
    depth = np.zeros(n + 1, "int64")
    np.add.at(depth, runs[:, 0] + runs[:, 2], 1)
    np.add.at(depth, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(depth[:-1]) == 0


def digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def summary(words: list[bytes], runs: np.ndarray) -> tuple:
    """The columns of ``RESULT`` for one text."""
    if not len(runs):
        return 0, None, None, None, None, digest(b""), digest(b" ".join(words)), len(words), 0
    kept = kept_words(len(words), runs)
    # Quotients of numbers below 2**26 are equal only if they are equal fractions.
    start, length, period = max(runs.tolist(), key=lambda r: (r[1] / r[2], -r[0], -r[2]))
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs.tolist())
    rest = b" ".join([w for w, k in zip(words, kept.tolist()) if k])
    left = int(np.count_nonzero(kept))
    return len(runs), start, length, period, 1000 * length // period, digest(listed.encode()), digest(rest), len(words), len(words) - left


def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Every tenth document by the hash of its id, with its end made periodic; the others as they are."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def periodic_runs(
    docs: DataFrame,
    text: str = "text",
    id_column: str = "doc_id",
    least_words: int = 24,
    least_periods: int = 3,
    plant: bool = False,
    keep: list[str] | None = None,
    collapsed: bool = False,
) -> DataFrame:
    """Runs of each row's text: their number, the one of most periods, digests of all runs and of the text without them.

    Words are what ASCII white space separates.  The result has the columns ``keep`` (the id, if not given), then
    n_runs; start, length, period and exponent_milli of the run with the greatest length / period (ties: smallest start,
    then period; null without a run); runs_sha256 of every run's "start,length,period" and line feed, by start, then
    period; collapsed_sha256 of the kept words joined by a space, n_words and n_dropped.  A word is dropped if a run
    holds it after its first period.  ``collapsed=True`` adds collapsed_text, and runs as an array of structs.

    ``plant=True`` first makes the end of some texts periodic, by the hash of the id, as a trial of the operator.

    A null or empty text has no words.  A null id is never planted; repeated rows give repeated results, an empty table an
    empty one.  Whole texts are worked on however long they are: memory grows with the longest text only.  Clashing
    column names of ``docs`` that are kept get an underscore on the result's side.
    """
    if least_periods < 3 or least_words < 1:
        raise ValueError("a run needs at least three periods and one word")
    kept = [id_column] if keep is None else keep
    body, number = fresh(docs, "body_", "number_")
    source = docs.select(*kept, F.coalesce(F.col(text), F.lit("")).alias(body), F.col(id_column).cast("bigint").alias(number))
    fields = RESULT + (", collapsed_text string, runs array<struct<start:bigint,length:bigint,period:bigint>>" if collapsed else "")
    names = [f.split()[0] for f in fields.split(", ")]
    taken = fresh(docs.select(*kept), *names)
    types = [f.split()[1] for f in fields.split(", ")]
    columns = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
    if collapsed:
        columns += [pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, body, BATCH_BYTES):
            ids = piece.column(number).to_pylist()
            texts = [t.encode().split() for t in piece.column(body).to_pylist()]
            if plant:
                texts = [planted(words, i) for words, i in zip(texts, ids)]
            known: dict[bytes, int] = {}
            numbers = [np.array([known.setdefault(w, len(known)) for w in words], "int64") for words in texts]
            found = find_runs(numbers, least_words, least_periods)
            rows = [summary(words, runs) for words, runs in zip(texts, found)]
            if collapsed:
                rows = [(*row, *whole(words, runs)) for row, words, runs in zip(rows, texts, found)]
            values = [pa.array(list(column), kind) for column, kind in zip(zip(*rows), columns)]
            yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in kept), *values], [*kept, *taken])

    result = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema), *(f"`{n}` {t}" for n, t in zip(taken, types))])
    return source.mapInArrow(run, result)


def whole(words: list[bytes], runs: np.ndarray) -> tuple[str, list[dict]]:
    """The collapsed text and the list of runs."""
    kept = kept_words(len(words), runs)
    rest = b" ".join([w for w, k in zip(words, kept.tolist()) if k]).decode()
    return rest, [{"start": s, "length": n, "period": q} for s, n, q in runs.tolist()]

