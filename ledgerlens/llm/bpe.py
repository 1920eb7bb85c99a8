"""Byte-pair encoding by forced boundaries.

A pair of neighbouring bytes that occurs inside no token of the vocabulary is a certain token boundary.  Texts are cut
at such pairs, each fragment is encoded on its own, and the ids of the fragments are concatenated.  Only pairs that
lead from other characters into ASCII white space are used as cuts, because there the splitting pattern, which looks
ahead past white space, provably sees the same on both sides; a pair of this kind that some token does contain is
left uncut.  Fragments repeat, so a bounded table remembers their ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from ledgerlens.llm.common import ASCII_SPACE, slices

#: The splitting pattern of byte-level vocabularies.  Fixed value.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Fragments a worker remembers, about 50 MB; the table starts anew beyond that.
REMEMBERED = 300_000


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


class Codec:
    """A vocabulary file of the ``tokenizers`` library with byte-level splitting and no normaliser."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError(f"{path} is not a plain byte-level vocabulary")
        as_byte = byte_characters()
        ranks = {bytes(as_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = 1 + max([*ranks.values(), *self.special.values()])
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in [*ranks.items(), *((c.encode(), i) for c, i in self.special.items())]:
            self.token_bytes[i] = token
        self.lengths = np.array([len(t) for t in self.token_bytes])
        self.core = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.inside = {pair for token in ranks for pair in zip(token, token[1:])}
        self.fragment = self._fragment_pattern()
        self.special_parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.opening = frozenset(ASCII_SPACE.encode())
        self.unjoined = self.opening | self.open_ends
        self.ids: dict[bytes, bytes] = {}
        self.forget()

    def _fragment_pattern(self) -> re.Pattern[bytes]:
        space = re.escape(ASCII_SPACE.encode())
        # Pairs into white space that are no certain boundary: the text goes on across them.
        open_pairs = sorted((a, b) for a, b in self.inside if chr(b) in ASCII_SPACE and chr(a) not in ASCII_SPACE)
        self.open_ends = {a for a, _ in open_pairs}
        across = b"|".join(rb"(?<=%s)(?=%s)" % (re.escape(bytes([a])), re.escape(bytes([b]))) for a, b in open_pairs)
        more = rb"(?:(?:%s)[%s]+[^%s]*)*" % (across, space, space) if across else b""
        return re.compile(rb"[%s]*[^%s]+%s|[%s]+" % (space, space, more, space))

    def forget(self) -> None:
        """Empty the table but for the special tokens, whose strings never occur inside a fragment."""
        self.ids = {c.encode(): np.array([i], "<u4").tobytes() for c, i in self.special.items()}

    def fragments(self, text: str) -> list[bytes]:
        """The fragments of a text in order; special tokens are fragments of their own."""
        if self.special_parts is None or not any(s in text for s in self.special):
            return self.fragment.findall(text.encode("utf-8", "replace"))
        found: list[bytes] = []
        for part in self.special_parts.split(text):
            data = part.encode("utf-8", "replace")
            found += [data] if part in self.special else self.fragment.findall(data)
        return found

    def remember(self, split: list[list[bytes]]) -> None:
        """Encode the fragments that are not in the table yet."""
        if len(self.ids) > REMEMBERED:
            self.forget()
        known, opening, unjoined, joined = self.ids, self.opening, self.unjoined, []
        for fragment in set().union(*split).difference(known):
            # Fragments from white space to a closed end can follow each other in one call.
            if fragment[0] in opening and fragment[-1] not in unjoined:
                joined.append(fragment)
            else:
                known[fragment] = np.array(self.core.encode_ordinary(fragment.decode()), "<u4").tobytes()
        for start in range(0, len(joined), 100_000):
            some = joined[start : start + 100_000]
            ids = np.array(self.core.encode_ordinary(b"".join(some).decode()), "<u4")
            ends = np.cumsum([len(f) for f in some])
            token_ends = np.cumsum(self.lengths[ids])
            last = np.searchsorted(token_ends, ends)
            if not np.array_equal(token_ends[last], ends):
                raise AssertionError("a forced boundary lies inside a token")
            blob, first = ids.tobytes(), 0
            for fragment, end in zip(some, (4 * last + 4).tolist()):
                known[fragment] = blob[first:end]
                first = end

    def encode_many(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers; null counts as empty."""
        split = [self.fragments(text or "") for text in texts]
        self.remember(split)
        for parts in split:
            yield b"".join(map(self.ids.__getitem__, parts))

    def decode(self, ids: np.ndarray) -> str:
        table = self.token_bytes
        return b"".join([table[i] for i in ids.tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(documents: DataFrame, path: str, text: str = "text", output: str = "ids") -> DataFrame:
    """Add the token ids of a text column as an array of integers; a null text has no ids.

    ``path`` names a vocabulary file that every worker can open.  An existing column named ``output`` is replaced.
    """
    kept = [c for c in documents.columns if c != output]
    rows = documents.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in slices(batches, text):
            found = [np.frombuffer(b, "<u4") for b in own.encode_many(batch.column(text).to_pylist())]
            flat = np.concatenate([np.empty(0, "<u4"), *found]).astype(np.int32)
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*kept, output]
            )

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{output}` array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids", output: str = "decoded") -> DataFrame:
    """Add the text of an array of ids, special tokens included; null ids give an empty text."""
    kept = [c for c in encoded.columns if c != output]
    rows = encoded.select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        for batch in batches:
            texts = [own.decode(np.array(i or [], "int64")) for i in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*kept, output])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{fields}, `{output}` string")


def round_trip(documents: DataFrame, path: str) -> DataFrame:
    """Digests of the encoded and decoded text of every document.

    Result: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256.  A null or empty text
    has no tokens, and both digests are those of the empty text.  Repeated rows give repeated rows; other columns are
    not read.  A text is encoded by one task in fragments; its ids take four bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path)
        table = own.token_bytes
        written_id = [b"%d," % i for i in range(len(table))]
        decimal: dict[bytes, bytes] = {}
        decoded: dict[bytes, bytes] = {}
        for batch in slices(batches, "text"):
            counts, digests, plain = [], [], []
            split = [own.fragments(t or "") for t in batch.column("text").to_pylist()]
            own.remember(split)
            if len(decimal) > REMEMBERED:
                decimal.clear()
                decoded.clear()
            for fragment in set().union(*split).difference(decimal):
                ids = memoryview(own.ids[fragment]).cast("I").tolist()
                decimal[fragment] = b"".join([written_id[i] for i in ids])
                decoded[fragment] = b"".join([table[i] for i in ids])
            for parts in split:
                written = b"".join(map(decimal.__getitem__, parts))[:-1]
                counts.append(written.count(b",") + 1 if written else 0)
                digests.append(hashlib.sha256(written).hexdigest())
                text = b"".join(map(decoded.__getitem__, parts)).decode("utf-8", "replace")
                plain.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(plain, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return documents.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)
