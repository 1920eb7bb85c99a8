"""Whitening of vectors by a weighted multiplicity covariance.

Entries become whole numbers, and equal vectors are grouped: one distinct vector with its number of copies.  Sums per
dimension, the covariance and the whitened values are worked out once per distinct vector, the copies enter as weights,
and a join sends each row the values of its vector.

The covariance is a weighted matrix product of vectors centred on the nearest whole numbers to the means, summed as
whole numbers, and then moved by the rest of the means (below one half).  Whole sums don't depend on the order of the
tasks, so a task that is run again, or another division into partitions, changes no digit of the components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import cut_lineage, repeated
from ledgerlens.llm.topk import usable

#: Entries beyond this size are set to it, so that sums of products keep to 38 digits.
LARGEST = 2**50

#: Rows of one distinct vector that meet it in one task when rows and whitened vectors are joined.
ROWS_PER_SALT = 200_000

#: A vector's rows are spread over at least that many parts.
LEAST_SALTS = 256

#: Vectors of one matrix product.
BLOCK_ROWS = 1024

#: Eigenvalues below this share of the largest one are rounding errors of zero.
ZERO_SHARE = 1e-12

WEIGHTS = ("counts", "one")


def quantised(vector: Column, scale: float, shift: int) -> Column:
    """floor(scale * entry) + shift of every entry, as whole numbers; entries beyond 2**50 become 2**50."""
    low, high = F.lit(-float(LARGEST)), F.lit(float(LARGEST))
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * scale, low), high)) + F.lit(shift).cast("bigint"))


def digest(x: Column) -> Column:
    """SHA-256 of a vector's numbers: the key by which rows find their vector without sending it along."""
    return F.unhex(F.sha2(F.array_join(x.cast("array<string>"), ","), 256))


def matrix(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of an Arrow batch, one row each."""
    return np.asarray(batch.column("x").flatten(), "int64").reshape(batch.num_rows, width)


def whole_products(centred: np.ndarray, weight: np.ndarray) -> list[list[int]]:
    """Exact sums of weight * centred_i * centred_j: in floating point where nothing is rounded, else in whole numbers."""
    most = int(np.abs(centred).max(initial=0))
    if most * most * int(weight.sum()) < 2**53:
        left = centred.astype("float64")
        return ((left * weight[:, None]).T @ left).astype("int64").tolist()
    if most * most * int(weight.sum()) < 2**63:
        return ((centred * weight[:, None]).T @ centred).tolist()
    big = centred.astype(object)
    return ((big * weight.astype(object)[:, None]).T.dot(big)).tolist()


def totals(groups: DataFrame, width: int) -> list[int]:
    """Weighted sum of each dimension over the fit list, exact."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [0] * width
        for batch in batches:
            x, w = matrix(batch, width), np.asarray(batch.column("w"), "int64")
            if int(np.abs(x).max(initial=0)) * int(w.sum()) < 2**62:
                held = [a + b for a, b in zip(held, (x * w[:, None]).sum(axis=0).tolist())]
            else:
                held = [a + b for a, b in zip(held, (x.astype(object) * w.astype(object)[:, None]).sum(axis=0).tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(range(width), "int32"), pa.array([str(v) for v in held])], ["i", "part"])

    parts = groups.select("x", "w").mapInArrow(run, "i int, part string")
    summed = parts.groupBy("i").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    return [int(r["total"]) for r in sorted(summed.collect(), key=lambda r: r["i"])]


def centred_products(groups: DataFrame, width: int, centre: list[int]) -> np.ndarray:
    """Weighted sums of products of the centred dimensions, exact: a matrix of whole numbers.

    Each task sums its blocks and gives one matrix; the entries are summed by their place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((width, width), dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                x, w = matrix(piece, width), np.asarray(piece.column("w"), "int64")
                held = held + np.array(whole_products(x - np.array(centre, "int64"), w), dtype=object).reshape(width, width)
        upper = [(i, j, str(held[i, j])) for i in range(width) for j in range(i, width)]
        columns = zip(*upper)
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.string()))], ["i", "j", "part"]
        )

    parts = groups.select("x", "w").mapInArrow(run, "i int, j int, part string")
    summed = parts.groupBy("i", "j").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    products = np.zeros((width, width), dtype=object)
    for i, j, total in summed.collect():
        products[i, j] = products[j, i] = int(total)
    return products


def components(products: np.ndarray, n: int, sums: list[int], centre: list[int], most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Eigenvalues (falling), unit eigenvectors as columns, and the trace of the covariance."""
    # sum w (x-S/n)(x-S/n)' = sum w (x-m)(x-m)' - d d'/n with d = S - n m, in whole numbers over n*n.
    rest = np.array([s - n * m for s, m in zip(sums, centre)], dtype=object)
    exact = products * n - np.outer(rest, rest)
    covariance = np.array([[float(v) for v in row] for row in exact]) / float(n) / float(n)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order], float(np.trace(covariance))


def whiten(
    rows: DataFrame,
    most: int = 8,
    scale: float = 1024.0,
    shift: int = 100_000,
    weights: str = "counts",
    id_column: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Every vector's whitened values on the ``most`` strongest components of the fit list's covariance.

    Result, one row per input row and component: the id under its own name, component (from 1), n (size of the fit
    list), deviation (sum over dimensions of (n*x - S)^2), whitened, explained, identity_error, and deviation_exact.

    ``weights="counts"`` fits on all rows, ``"one"`` on each distinct vector once.  Null vectors and vectors that hold
    null or non-finite entries are dropped; a null id, repeated ids and repeated rows stay rows of their own.  Entries
    beyond 2**50 become 2**50.  Vectors of different widths don't mix: each width is a fit list of its own, and an empty
    vector has no components.  A component without variance (all vectors equal, or more components than there are
    independent vectors) has a null whitened value and explains 0, or null where nothing varies at all;
    identity_error covers the others and is null if there are none.  ``deviation`` is null beyond 64 bits,
    ``deviation_exact`` then still holds it.  An empty table gives an empty table.  Other columns are not read.

    The driver holds one matrix of width x width numbers, whatever the number of rows.
    """
    if weights not in WEIGHTS:
        raise ValueError(f"weights must be one of {WEIGHTS}")
    read = rows.filter(usable(F.col(vector))).select(
        F.col(id_column).alias("id"), quantised(F.col(vector), scale, shift).alias("x")
    )
    groups = cut_lineage(read.groupBy("x").agg(F.count(F.lit(1)).alias("rows")))
    widths = {r["width"]: r["rows"] for r in groups.groupBy(F.size("x").alias("width")).agg(F.sum("rows").alias("rows")).collect()}
    fitted = groups.withColumn("w", F.col("rows") if weights == "counts" else F.lit(1).cast("bigint")).drop("rows")
    whitened = [_fit(fitted.filter(F.size("x") == width), width, most) for width in sorted(widths) if width]
    if not whitened:
        whitened = [groups.limit(0).select(digest(F.col("x")).alias("key"), *[F.lit(None).cast(t).alias(c) for c, t in VALUES])]
    values = reduce(DataFrame.unionByName, whitened)
    # The id deals the rows of a frequent vector over its salts; equal rows are counted before they meet.
    salts = max(LEAST_SALTS, sum(widths.values()) // ROWS_PER_SALT)
    held = cut_lineage(
        read.groupBy(digest(F.col("x")).alias("key"), "id")
        .agg(F.count(F.lit(1)).alias("copies"))
        .withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    )
    spread = held.groupBy("key").agg(F.collect_set("salt").alias("salts")).join(values, "key")
    found = held.join(spread.withColumn("salt", F.explode("salts")).drop("salts"), ["key", "salt"])
    return repeated(found, "copies").select(F.col("id").alias(id_column), *[c for c, _ in VALUES[:-1]], F.posexplode("parts").alias("place", "part")).select(
        id_column,
        (F.col("place") + 1).cast("int").alias("component"),
        "n",
        F.expr("try_cast(deviation_exact AS bigint)").alias("deviation"),
        F.col("part.whitened").alias("whitened"),
        F.col("part.explained").alias("explained"),
        "identity_error",
        "deviation_exact",
    )


#: Columns of a distinct vector's result.
VALUES = (
    ("n", "bigint"),
    ("deviation_exact", "decimal(38,0)"),
    ("identity_error", "double"),
    ("parts", "array<struct<whitened:double,explained:double>>"),
)


def _fit(groups: DataFrame, width: int, most: int) -> DataFrame:
    """Fit on the vectors of one width and whiten each distinct one once."""
    n = groups.agg(F.sum("w")).first()[0]
    sums = totals(groups, width)
    centre = [round(s / n) if abs(s) < 2**53 else s // n for s in sums]
    values, vectors, trace = components(centred_products(groups, width, centre), n, sums, centre, most)
    solid = values > ZERO_SHARE * max(float(values[0]), 0.0) if len(values) else values.astype(bool)
    scaled = np.where(solid, vectors / np.sqrt(np.where(solid, values, 1.0)), 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.array(sums, dtype=object)
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK_ROWS):
                piece = batch.slice(start, BLOCK_ROWS)
                x = matrix(piece, width)
                bound = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums))
                far = x * n - np.array(sums, "int64") if bound < 2**62 else x.astype(object) * n - whole
                largest = int(np.abs(far).max(initial=0))
                squares = far * far if largest * largest * width < 2**62 else far.astype(object) ** 2
                points = (far.astype("float64") / n) @ scaled
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("key"),
                        piece.column("w"),
                        pa.array([str(v) for v in squares.sum(axis=1).tolist()]),
                        pa.array(list(points), pa.list_(pa.float64())),
                    ],
                    ["key", "w", "far", "points"],
                )

    keyed = groups.select(digest(F.col("x")).alias("key"), "x", "w")
    points = keyed.mapInArrow(run, "key binary, w bigint, far string, points array<double>")
    kept = [i for i in range(len(values)) if solid[i]]
    error = identity_error(points, n, kept)
    explained = [float(max(v, 0.0)) / trace if trace > 0 else None for v in values]
    parts = F.array(
        *[
            F.struct(
                (F.col("points")[i] if solid[i] else F.lit(None).cast("double")).alias("whitened"),
                F.lit(explained[i]).cast("double").alias("explained"),
            )
            for i in range(len(values))
        ]
    )
    return points.select(
        "key",
        F.lit(n).cast("bigint").alias("n"),
        F.expr("try_cast(far AS decimal(38,0))").alias("deviation_exact"),
        F.lit(error).cast("double").alias("identity_error"),
        parts.alias("parts"),
    )


def identity_error(points: DataFrame, n: int, kept: list[int]) -> float | None:
    """Largest absolute entry of the weighted covariance of the kept components minus the identity."""
    if not kept:
        return None
    means = points.agg(*[(F.sum(F.col("w") * F.col("points")[i]) / n).alias(f"m{i}") for i in kept]).first()
    pairs = [(i, j) for i in kept for j in kept if i <= j]
    away = {i: F.col("points")[i] - F.lit(means[f"m{i}"]) for i in kept}
    sums = points.agg(*[(F.sum(F.col("w") * away[i] * away[j]) / n).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(sums[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
