"""Near-duplicates by SimHash, found with a binary trie self-join.

Two 64-bit fingerprints with at most three differing bits agree in at least one of four 16-bit blocks.  Each distinct
fingerprint is therefore put, rotated, below four trie nodes that stand for such a block without an error.  Below them
pairs of trie nodes are walked together, bit by bit: equal branches keep their count of differing bits, unlike ones add
one, and a pair is pruned when the count exceeds the budget or when all its leaves are known to be connected.  A node
with very many fingerprints is opened further before it is dealt out, as pairs of its subtrees within the budget.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import LOWER, UPPER, cut_lineage, slices
from ledgerlens.llm.components import connected_components

BITS = 64

#: Fingerprints below one trie node from which on it is opened further, and by how many bits at most.
NODE_ROWS, MOST_DEPTH = 8192, 16

#: Node pairs that a task walks at a time.
FRONTIER = 200_000

_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the word shingles of a text, repeats included; zero for a text without words."""
    words = (text or "").encode("utf-8", "replace").translate(_LOWER).split()
    if not words:
        return 0
    joined, take = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts, ends = (ends - lengths)[: len(words) - take + 1], ends[take - 1 :]
    votes, digest = np.zeros(BITS, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = slice(at, at + (1 << 16))
        hashes = [digest(joined[i:j], seed) for i, j in zip(starts[part].tolist(), ends[part].tolist())]
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(documents: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id and fingerprint (the 64 bits as a signed number) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = np.array([fingerprint(t, shingle, seed) for t in batch.column("text").to_pylist()], "<u8")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view("<i8"))], ["doc_id", "fingerprint"])

    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text")
    return rows.mapInArrow(run, "doc_id bigint, fingerprint bigint")


class Forest:
    """Labels of connected leaves, merged as links are found."""

    def __init__(self, size: int) -> None:
        self.label = np.arange(size)
        self.changed()

    def changed(self) -> None:
        """Note where the run of equal labels that a leaf stands in ends."""
        ends = np.flatnonzero(np.r_[self.label[1:] != self.label[:-1], True]) + 1
        self.run_end = np.repeat(ends, np.diff(np.r_[0, ends]))

    def link(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.label[left], self.label[right]
        pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)])[:, a != b], axis=1)
        if not pairs.size:
            return
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        for x, y in pairs.T.tolist():
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
        merged = np.array(list(parent), dtype=np.int64)
        renamed = np.arange(len(self.label))
        renamed[merged] = [root(x) for x in merged.tolist()]
        self.label = renamed[self.label]
        self.changed()

    def joined(self, low_a, high_a, low_b, high_b) -> np.ndarray:
        """Whether all leaves of both ranges have one label."""
        whole = (self.run_end[low_a] >= high_a) & (self.run_end[low_b] >= high_b)
        return whole & (self.label[low_a] == self.label[low_b])


def walk(keys: np.ndarray, pairs: np.ndarray, budget: int, forest: Forest) -> None:
    """Link the leaves of node pairs that differ in at most ``budget`` bits.

    ``keys`` are sorted within every node.  A column of ``pairs`` is (low a, high a, low b, high b, differing bits so
    far): the index ranges of two nodes of equal depth, the same twice for a node with itself.
    """
    ones = {}
    stack = [(BITS, pairs)]
    while stack:
        bit, part = stack.pop()
        if part.shape[1] > FRONTIER:
            stack += [(bit, part[:, i : i + FRONTIER]) for i in range(0, part.shape[1], FRONTIER)]
            continue
        low_a, high_a, low_b, high_b, errors = part
        open_pairs = ~forest.joined(low_a, high_a, low_b, high_b)
        leaves = (high_a - low_a == 1) & (high_b - low_b == 1)
        single = part[:, open_pairs & leaves]
        if single.shape[1]:
            near = np.bitwise_count(keys[single[0]] ^ keys[single[2]]) <= budget
            forest.link(single[0][near], single[2][near])
        part = part[:, open_pairs & ~leaves]
        if not part.shape[1] or not bit:
            continue
        bit -= 1
        if bit not in ones:
            ones[bit] = np.r_[0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1)).astype(np.int64)]
        count = ones[bit]
        low_a, high_a, low_b, high_b, errors = part
        cut_a, cut_b = high_a - (count[high_a] - count[low_a]), high_b - (count[high_b] - count[low_b])
        own = (low_a == low_b) & (high_a == high_b)
        children = [
            np.stack([low_a, cut_a, low_b, cut_b, errors]),
            np.stack([cut_a, high_a, cut_b, high_b, errors]),
            np.stack([low_a, cut_a, cut_b, high_b, errors + 1]),
            np.stack([cut_a, high_a, low_b, cut_b, errors + 1])[:, ~own],
        ]
        down = np.concatenate(children, axis=1)
        down = down[:, (down[0] < down[1]) & (down[2] < down[3]) & (down[4] <= budget)]
        alone = (down[0] == down[2]) & (down[1] - down[0] == 1)
        if (down := down[:, ~alone]).shape[1]:
            stack.append((bit, down))


def masks(depth: int, most: int) -> list[int]:
    """The ways in which two paths of ``depth`` bits may differ in at most ``most`` bits."""
    return sorted(sum(1 << i for i in c) for n in range(most + 1) for c in combinations(range(depth), n))


def near_links(nodes: DataFrame, distance: int = 3) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints with at most ``distance`` differing bits.

    Within a pair of trie nodes only a spanning tree of each connected part is returned, so that a large group of copies
    gives as many links as members.
    """
    parts = distance + 1
    width = BITS // parts
    edges = [(i * width, BITS if i == distance else (i + 1) * width) for i in range(parts)]
    value = F.col("fingerprint")
    turned = [  # the block comes to the top, the other bits follow in their order
        F.struct(
            F.lit(i).alias("part"),
            (F.shiftleft(value, BITS - high).bitwiseOR(F.shiftrightunsigned(value, high)) if high < BITS else value).alias("path"),
            F.lit(high - low).alias("fixed"),
        )
        for i, (low, high) in enumerate(edges)
    ]
    placed = nodes.select(value, F.explode(F.array(*turned)).alias("t")).select("fingerprint", "t.*")
    placed = placed.withColumn("block", F.expr("shiftrightunsigned(path, 64 - fixed)"))
    crowded = (
        placed.groupBy("part", "block")
        .agg(F.count(F.lit(1)).alias("rows"))
        .filter(F.col("rows") > NODE_ROWS)
        .select("part", "block", F.least(F.ceil(F.log2(F.col("rows") / NODE_ROWS)), F.lit(MOST_DEPTH)).cast("int").alias("depth"))
    )
    opened = placed.join(crowded, ["part", "block"], "left").fillna(0, ["depth"])
    # The subtree of a fingerprint below its block, and the subtrees within the budget of it.
    subtree = F.expr("if(depth = 0, 0L, shiftrightunsigned(shiftleft(path, fixed), 64 - depth))")
    ways = F.array(*[F.array(*[F.lit(m).cast("bigint") for m in masks(d, distance)]) for d in range(MOST_DEPTH + 1)])
    paired = opened.withColumn("subtree", subtree).withColumn("other", F.explode(F.element_at(ways, F.col("depth") + 1)))
    paired = paired.withColumn("other", F.col("subtree").bitwiseXOR(F.col("other")))
    keyed = paired.select(
        "part", "block", F.least("subtree", "other").alias("a"), F.greatest("subtree", "other").alias("b"),
        (F.col("subtree") > F.col("other")).alias("second"), "path", "fingerprint",
    )
    key = ["part", "block", "a", "b"]
    # Groups arrive whole and one after the other.
    arranged = keyed.repartition(*key).sortWithinPartitions(*key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table])
            group = _groups(table)
            whole = int(np.flatnonzero(group == group[-1])[0])
            if whole:
                yield from _linked(table.slice(0, whole), group[:whole], distance)
            rest = table.slice(whole)
        if rest is not None:
            yield from _linked(rest, _groups(rest), distance)

    return arranged.mapInArrow(run, "u bigint, v bigint")


def _groups(table: pa.Table) -> np.ndarray:
    """Number of the node pair each row belongs to; rows come in order."""
    new = np.zeros(table.num_rows, bool)
    for name in ("part", "block", "a", "b"):
        values = table.column(name).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.cumsum(new)


def _linked(table: pa.Table, group: np.ndarray, distance: int) -> Iterator[pa.RecordBatch]:
    keys = table.column("path").to_numpy().view(np.uint64)
    second = table.column("second").to_numpy().astype(bool)
    a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
    prints = table.column("fingerprint").to_numpy()
    order = np.lexsort((keys, second, group))
    keys, prints, second, group, a, b = keys[order], prints[order], second[order], group[order], a[order], b[order]
    start = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    stop = np.r_[start[1:], len(group)]
    firsts = np.add.reduceat((~second).astype(np.int64), start)
    own = a[start] == b[start]
    middle = start + firsts
    # The walk starts at the root, so it counts the differing bits of the subtrees itself.
    pairs = np.stack([start, np.where(own, stop, middle), np.where(own, start, middle), stop, np.zeros_like(start)])
    pairs = pairs[:, (pairs[0] < pairs[1]) & (pairs[2] < pairs[3]) & ~(own & (stop - start < 2))]
    forest = Forest(len(keys))
    for budget in sorted({1, distance}):
        if budget <= distance:
            walk(keys, pairs, budget, forest)
    linked = np.flatnonzero(forest.label != np.arange(len(keys)))
    if len(linked):
        yield pa.RecordBatch.from_arrays([pa.array(prints[linked]), pa.array(prints[forest.label[linked]])], ["u", "v"])


def near_duplicates(documents: DataFrame, shingle: int = 3, distance: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    The component of a document holds all documents that can be reached by links of at most ``distance`` differing
    bits; its id is the smallest doc_id in it.  A null or empty text has the fingerprint zero and is linked like any
    other.  Repeated rows give repeated rows.  A row with a null doc_id belongs to its component without naming it; if no
    member has an id, component_id is null.  Other columns are not read.
    """
    prints = cut_lineage(fingerprints(documents, shingle, seed))
    nodes = cut_lineage(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")))
    roots = connected_components(near_links(nodes.select("fingerprint"), distance))
    reached = nodes.join(roots, nodes["fingerprint"] == roots["node"], "left")
    reached = reached.select("fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root"))
    lowest = reached.groupBy("root").agg(F.min("smallest").alias("component_id"))
    named = reached.join(lowest, "root").select("fingerprint", "component_id")
    found = prints.join(named, "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
