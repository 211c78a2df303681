"""Operator 4: byte-pair encoding and decoding with tree concatenation.

Ordinary text is encoded whole by the tokenizer library.  A stretch that the
pre-tokenizer cannot split and that is longer than ``leaf`` bytes is a single
piece; it is encoded as a tree: its halves (recursively, down to leaves) are
encoded in parallel threads (the library works outside Python's lock), then every join is repaired by re-encoding a
window of tokens around it.  The window doubles until both of its edges agree
with their neighbours, that is until re-encoding the two tokens at each edge
gives back just these two.  A sequence of byte-pair tokens is the encoding of
its bytes exactly when every pair of neighbours is, so agreement is proof.

Results for odd input: a null text has null tokens, zero tokens and a null
round-trip flag; an empty text has an empty list and a true flag; repeated rows
are encoded as often as they occur; further columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from .common import TOKENIZERS

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LEAF = 1 << 13
THREADS = 4
SCHEMA = "doc_id long, n_tokens long, tokens array<int>, round_trip boolean"


class Codec:
    """A byte-level BPE vocabulary with tree concatenation for long pieces."""

    def __init__(self, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", leaf: int = LEAF):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = {b: a for a, b in ranks.items()}
        self.piece = self.encoding._core_bpe.encode_single_piece
        self.leaf = leaf
        self.pattern = regex.compile(PATTERN)
        self.unsplit = re.compile(r"\S{%d,}|\s{%d,}" % (max(2, leaf // 4), max(2, leaf // 4)))

    def encode(self, text: str) -> list[int]:
        if len(text) * 4 <= self.leaf or not self.unsplit.search(text):
            return self.encoding.encode_ordinary(text)
        out: list[int] = []
        for m in self.pattern.finditer(text):
            data = m.group().encode("utf-8", "replace")
            out += self.tree(data.decode()) if len(data) > self.leaf else self.piece(data)
        return out

    def tree(self, piece: str) -> list[int]:
        """The tokens of one piece: leaves in parallel, then joins level by level."""
        # All characters of a piece are of one kind, so no part of it is split either.
        parts = [piece[i : i + self.leaf] for i in range(0, len(piece), self.leaf)]
        with ThreadPoolExecutor(THREADS) as pool:
            level = list(pool.map(self.encoding._core_bpe.encode_ordinary, parts))
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0] if level else []

    def agree(self, a: int, b: int) -> bool:
        return self.piece(self.bytes_of[a] + self.bytes_of[b]) == [a, b]

    def join(self, left: list[int], right: list[int]) -> list[int]:
        width = 4
        while True:
            a, b = max(0, len(left) - width), min(len(right), width)
            window = self.piece(b"".join(self.bytes_of[t] for t in left[a:] + right[:b]))
            if (a == 0 or self.agree(left[a - 1], window[0])) and (b == len(right) or self.agree(window[-1], right[b])):
                return left[:a] + window + right[b:]
            width *= 2

    def decode(self, tokens) -> str:
        return self.encoding.decode_bytes(tokens).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def codec(path: str, leaf: int = LEAF) -> Codec:
    return Codec(path, leaf)


def encode(docs: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", leaf: int = LEAF) -> DataFrame:
    """Every document's tokens, and whether decoding them gives the text again.

    One narrow pass, no shuffle: doc_id, n_tokens, tokens, round_trip.
    """

    def run(batches):
        c = codec(path, leaf)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, len(ids), 256):
                lists, same = [], []
                for text in texts.slice(at, 256).to_pylist():
                    tokens = None if text is None else c.encode(text)
                    lists.append(tokens)
                    same.append(None if text is None else c.encoding.decode_bytes(tokens) == text.encode("utf-8", "replace"))
                sizes = np.fromiter((len(x or ()) for x in lists), np.int64, len(lists))
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), mask=np.array([x is None for x in lists] + [False]))
                flat = np.concatenate([np.array(x, np.int32) for x in lists if x] or [np.zeros(0, np.int32)])
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, 256).cast(pa.int64()), pa.array(sizes), pa.ListArray.from_arrays(offsets, pa.array(flat)), pa.array(same, pa.bool_())],
                    ["doc_id", "n_tokens", "tokens", "round_trip"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id and text of each token list; null tokens give a null text."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [None if x is None else c.decode(x) for x in batch.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "tokens").mapInArrow(run, "doc_id long, text string")
