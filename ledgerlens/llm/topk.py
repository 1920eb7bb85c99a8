"""Exact top-k search by inner product, in tiles.

Queries and candidates are packed into blocks, one row each.  A tile is a block of queries against a block of
candidates: one matrix product, of which only the best ``k`` per query leave the task.  The lists of a query block are
then merged like a tree, a fixed number of candidate blocks at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of queries and of candidates; the scores of a tile take QUERY_ROWS * SHARD_ROWS * 8 bytes at most.
QUERY_ROWS, SHARD_ROWS = 512, 4096

#: Number types a block may be stored in, smallest first.
KINDS = ("int8", "int16", "int32", "float64")

#: Lists that one merge step takes together.
FAN_IN = 16

HITS = "query_id bigint, vec_id bigint, score bigint"


def usable(vector: Column) -> Column:
    """Whether a vector is not null and holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def blocks(rows: DataFrame, id_column: str, vector: str, size: int, scale: float) -> tuple[DataFrame, int]:
    """Rows of (dim, block, ids, kind, numbers), each of about ``size`` quantised vectors of one width; how many blocks."""
    wide = rows.select(F.col(id_column).cast("bigint").alias("id"), F.col(vector).alias("v")).withColumn("dim", F.size("v"))
    count = max(1, -(-rows.count() // size))

    def run(key: tuple[int, int], group: pd.DataFrame) -> pd.DataFrame:
        values = np.floor(np.stack(group["v"].to_numpy()).astype("float64").reshape(len(group), -1) * scale)
        most = np.abs(values).max(initial=0.0)
        kind = next((k for k in KINDS[:3] if most <= np.iinfo(k).max), KINDS[3])
        packed = {"ids": group["id"].to_numpy("int64").tobytes(), "kind": kind, "numbers": values.astype(kind).tobytes()}
        return pd.DataFrame([{"dim": key[0], "block": key[1], **packed}])

    # The hash of the id deals a frequent vector over all blocks.
    dealt = wide.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(count)).cast("int"))
    packed = dealt.groupBy("dim", "block").applyInPandas(run, "dim int, block int, ids binary, kind string, numbers binary")
    return packed, count


def unpacked(row: dict, prefix: str = "") -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of a block."""
    ids = np.frombuffer(row[f"{prefix}ids"], "int64")
    numbers = np.frombuffer(row[f"{prefix}numbers"], row[f"{prefix}kind"]).astype("float64")
    return ids, numbers.reshape(len(ids), row["dim"])


def products(queries: np.ndarray, shard: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in floating point where no sum can be rounded, else in whole numbers.

    A product beyond 64 bits becomes the largest or smallest 64-bit number.
    """
    bound = float(np.abs(queries).max(initial=0.0)) * float(np.abs(shard).max(initial=0.0)) * max(1, queries.shape[1])
    if bound < 2**24:
        return (queries.astype("float32") @ shard.astype("float32").T).astype("int64")
    if bound < 2**53:
        return (queries @ shard.T).astype("int64")
    whole = np.array([[int(x) for x in row] for row in queries], dtype=object).reshape(queries.shape)
    other = np.array([[int(x) for x in row] for row in shard], dtype=object).reshape(shard.shape)
    return np.clip(whole.dot(other.T), -(2**63), 2**63 - 1).astype("int64")


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the k highest scores of each row, ties to the smaller id; columns are in order of id."""
    if scores.shape[1] > k:
        floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k][:, None]
        above = scores > floor
        # Of those equal to the k-th score, the first few complete the list.
        tied = scores == floor
        chosen = above | (tied & (np.cumsum(tied, axis=1) <= k - above.sum(axis=1, keepdims=True)))
    else:
        chosen = np.ones(scores.shape, bool)
    return np.nonzero(chosen)


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = 20, scale: float = 64.0, id_column: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The k rows of ``vectors`` with the highest integer inner product for every row of ``queries``.

    Components are quantised to floor(scale * x).  Result: query_id, rank (from 1), vec_id, score; ties go to the
    smaller id.  A query never finds its own id.  Null vectors, vectors with null, NaN or infinite components, and rows
    without an id take no part; vectors of different widths don't meet.  Repeated rows of an id count once if their
    vectors are equal, otherwise the id takes its highest score.  Other columns are not read.
    """
    asked = queries.filter(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(id_column, vector).distinct()
    held = vectors.filter(usable(F.col(vector)) & F.col(id_column).isNotNull()).select(id_column, vector)
    shards, count = blocks(held, id_column, vector, SHARD_ROWS, scale)
    asking, _ = blocks(asked, id_column, vector, QUERY_ROWS, scale)
    tiles = (
        asking.selectExpr("dim", "ids as query_ids", "kind as query_kind", "numbers as query_numbers")
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
        .join(shards, ["dim", "block"])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                (ids, shard), (asked_ids, asking_rows) = unpacked(row), unpacked(row, "query_")
                order = np.argsort(ids, kind="stable")
                ids = ids[order]
                found = products(asking_rows, shard[order])
                # One more than k, as the query itself may be among them, and copies of an id count once.
                first = np.concatenate([[True], ids[1:] != ids[:-1]])
                if not first.all():
                    found = np.maximum.reduceat(found, np.nonzero(first)[0], axis=1)
                    ids = ids[first]
                at, column = best(found, ids, k + 1)
                hits = {"query_id": asked_ids[at], "vec_id": ids[column], "score": found[at, column]}
                others = hits["query_id"] != hits["vec_id"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(others.sum(), row["block"], "int32")), *(pa.array(v[others]) for v in hits.values())],
                    ["block", *hits],
                )

    hits = tiles.mapInArrow(run, f"block int, {HITS}")
    # Merge the lists of FAN_IN blocks at a time, until one list is left for each query.
    left = count
    while True:
        left = -(-left // FAN_IN)
        hits = hits.withColumn("block", F.floor(F.col("block") / FAN_IN).cast("int"))
        hits = hits.groupBy("query_id", "block", "vec_id").agg(F.max("score").alias("score"))
        ranked = Window.partitionBy("query_id", "block").orderBy(F.desc("score"), "vec_id")
        hits = hits.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)
        if left == 1:
            return hits.select("query_id", "rank", "vec_id", "score")
        hits = hits.drop("rank")
