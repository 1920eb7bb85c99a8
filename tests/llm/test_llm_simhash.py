"""SimHash and its components against brute force."""

import re

import numpy as np
import xxhash

from ledgerlens.llm import simhash
from ledgerlens.llm.components import connected_components


def slow_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    take = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + take]).encode(), 42) for i in range(len(words) - take + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, distance=3):
    """Smallest index reachable by links, for each of the fingerprints."""
    label = list(range(len(prints)))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= distance:
                x, y = root(i), root(j)
                label[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(prints))]


def linked(spark, prints):
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    roots = {r["node"]: r["root"] for r in connected_components(simhash.near_links(nodes, 3)).collect()}
    names = [roots.get(p, p) for p in signed]
    return [names.index(n) for n in names]


def planted(seed, count):
    pick = np.random.default_rng(seed)
    centres = pick.integers(0, 2**63, 8, dtype=np.uint64)
    found = set()
    while len(found) < count:
        flips = pick.choice(64, int(pick.integers(0, 7)), replace=False)
        found.add(int(centres[pick.integers(8)]) ^ sum(1 << int(b) for b in flips))
    return sorted(found | {0, 2**64 - 1, 1, 2**63})


def test_fingerprints_follow_their_definition():
    texts = [None, "", " \t", "One", "one two", "A b C", "a b c a b c a b c", "É é\x0bx\x0cy\rz w q", "w " * 5000]
    assert [simhash.fingerprint(t) for t in texts] == [slow_fingerprint(t) for t in texts]


def test_links_equal_brute_force(spark):
    prints = planted(1, 400)
    assert linked(spark, prints) == slow_components(prints)


def test_crowded_trie_nodes_are_opened(spark, monkeypatch):
    monkeypatch.setattr(simhash, "NODE_ROWS", 12)
    monkeypatch.setattr(simhash, "FRONTIER", 64)
    prints = planted(2, 300)
    assert linked(spark, prints) == slow_components(prints)


def test_components_of_a_long_path_and_of_nothing(spark):
    path = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(5, 5), (70, 71), (71, 70)], "u long, v long")
    found = {r["node"]: r["root"] for r in connected_components(path).collect()}
    assert set(found) == {*range(61), 70, 71} and {found[i] for i in range(61)} == {0} and found[71] == 70
    assert connected_components(path.limit(0)).count() == 0


def test_documents_with_gaps(spark):
    copy = "the quick brown fox jumps over the lazy dog again and again " * 20
    rows = [(5, copy), (3, copy), (9, copy + "end"), (4, None), (2, ""), (None, copy), (8, "other words here"), (8, "other words here")]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, fingerprint int, component_id string")
    found = simhash.near_duplicates(df).collect()
    texts = [t for _, t in rows]
    wanted = slow_components([slow_fingerprint(t) for t in texts])
    smallest = {w: min((rows[i][0] for i, x in enumerate(wanted) if x == w and rows[i][0] is not None), default=None) for w in wanted}
    expected = sorted((str(i), f"{slow_fingerprint(t):016x}", smallest[w]) for (i, t), w in zip(rows, wanted))
    assert sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in found) == expected
    assert simhash.near_duplicates(df.limit(0)).count() == 0
