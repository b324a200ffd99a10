"""Byte-level BPE encoding and decoding.

A text is cut at the added special strings, each stretch into pieces by the
vocabulary's pattern, and each piece into bytes. The bytes form a doubly linked list
of symbols; a priority queue holds the possible merges by rank, then position. A
popped merge is stale, and skipped, if one of its symbols has changed since. Decoding
concatenates the vocabulary's strings and reads the bytes as UTF-8.

Null texts count as empty; empty texts have no ids. The time for a piece of n bytes
grows as n log n, so very long words do no harm. Finished pieces are kept in a cache
of bounded size. Rows are handled one by one: repeated rows and ties need no care, an
empty table gives an empty result, and other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Fixed value: how this kind of vocabulary cuts text into pieces.
PIECES = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
CACHE_PIECES = 300_000
CACHE_LENGTH = 64


def printable_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file, and its byte."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class _Pieces(dict):
    """Packed ids of pieces; encodes what it does not hold yet."""

    def __init__(self, codec: BytePairCodec):
        self.codec = codec

    def __missing__(self, piece: str) -> bytes:
        packed = np.array(self.codec.merge(piece.encode()), "<u4").tobytes()
        if len(piece) <= CACHE_LENGTH:
            if len(self) >= CACHE_PIECES:
                self.clear()
            self[piece] = packed
        return packed


#: A vocabulary file goes to every executor; larger ones are an error.
MOST_VOCABULARY = 64_000_000


def vocabulary_text(path: str) -> str:
    if os.path.getsize(path) > MOST_VOCABULARY:
        raise ValueError(f"a vocabulary of more than {MOST_VOCABULARY} bytes")
    with open(path, encoding="utf-8") as f:
        return f.read()


class BytePairCodec:
    """Encoder and decoder of a vocabulary file's text (see :func:`vocabulary_text`)."""

    def __init__(self, text: str):
        spec = json.loads(text)
        to_byte = printable_bytes()
        ids = spec["model"]["vocab"]
        self.strings = {i: bytes(map(to_byte.__getitem__, s)) for s, i in ids.items() if all(c in to_byte for c in s)}
        self.of_byte = [ids[c] for c, b in sorted(to_byte.items(), key=lambda x: x[1])]
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.strings |= {i: s.encode() for s, i in self.special.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = (rank, ids[left + right])
        self.split = regex.compile(PIECES).findall
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")").split if self.special else None
        self.pieces = _Pieces(self)

    def merge(self, data: bytes) -> list[int]:
        """The ids of one piece."""
        symbol: list[int] = [self.of_byte[b] for b in data]
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue: list[tuple[int, int, int, int, int]] = []

        def offer(left: int, right: int) -> None:
            if found := self.merges.get((symbol[left], symbol[right])):
                heapq.heappush(queue, (found[0], left, symbol[left], symbol[right], found[1]))

        for k in range(n - 1):
            offer(k, k + 1)
        while queue:
            _, left, a, b, made = heapq.heappop(queue)
            right = after[left] if symbol[left] == a else -1
            if right < 0 or symbol[right] != b:
                continue  # stale: one of the two symbols is gone or another by now
            symbol[left], symbol[right] = made, -1
            after[left] = after[right]
            if after[left] >= 0:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [x for x in symbol if x >= 0]

    def encode_packed(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        of, special = self.pieces.__getitem__, self.special
        if self.cut is None or not any(s in text for s in special):
            return b"".join(map(of, self.split(text)))
        parts = self.cut(text)
        return b"".join(np.array([special[x]], "<u4").tobytes() if k % 2 else b"".join(map(of, self.split(x))) for k, x in enumerate(parts))

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_packed(text), "<u4").tolist()

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.strings.__getitem__, ids))

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode("utf-8", "replace")


def bpe_encode(docs: DataFrame, path: str, decoded: bool = True) -> DataFrame:
    """Encode and decode every row of ``docs(doc_id, text)``; no shuffle.

    Returns doc_id, n_tokens (long), ids (binary, little-endian unsigned 32-bit
    integers) and, if asked for, decoded (string).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    # executors need not see the driver's file
    spec = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = BytePairCodec(spec.value)
        for batch in batches:
            for part in (batch.slice(k, 1000) for k in range(0, batch.num_rows, 1000)):
                packed = [codec.encode_packed(x or "") for x in part.column(1).to_pylist()]
                columns = [part.column(0), pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array(packed, pa.binary())]
                if decoded:
                    columns.append(pa.array([codec.decode(np.frombuffer(x, "<u4").tolist()) for x in packed], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])

    schema = f"doc_id {kind}, n_tokens long, ids binary" + ", decoded string" * decoded
    return docs.select("doc_id", "text").mapInArrow(run, schema)
