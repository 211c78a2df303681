"""Operator 8: token counts that follow edits.

A document is cut into leaves of about ``size`` characters, runs of whole
pre-tokens that end at single spaces between word characters, where the
pre-tokenizer always splits; the tokens of the whole are then the sum over the
leaves.  A segment tree over the leaves holds characters and tokens of every
subtree.  ``plant`` gives the leaves of every document as a column, which can be
kept in a table; ``edit`` takes trees up again from there, encodes what the edits
touch and nothing else, and gives the trees that further edits go on from.  An edit finds its leaves by
descending on characters, takes in further leaves until both ends are certain
cuts again, re-encodes that region only, and updates the sums above it.

Results for odd input: a null text counts as an empty one, of 0 tokens; edits
that reach beyond the text are cut to it, edits whose end lies before their start
insert there, and null edits change nothing; edits
of a document apply in order, each to the text that the last one left; repeated
rows are counted each; further columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import TOKENIZERS

LEAF_CHARS = 512
_CUT = re.compile(r"(?<=\w) (?=\w)")


class Tree:
    """Characters and tokens of a text's leaves, with sums over subtrees."""

    def __init__(self, text: str, encode, size: int = LEAF_CHARS, leaves: list[tuple[int, int]] | None = None):
        """leaves: characters and tokens of each, as ``leaves`` gave them; without them the text is encoded."""
        self.encode, self.size, self.encoded = encode, size, 0
        self.text = text
        if leaves is None:
            pieces = self._cut(text)
            self._build([len(x) for x in pieces], [self._count(x) for x in pieces])
        else:
            self._build([c for c, _ in leaves], [t for _, t in leaves])

    @property
    def leaves(self) -> list[tuple[int, int]]:
        """Characters and tokens of all leaves that have any, in order."""
        return [(c, t) for c, t in zip(self.chars[self.width :], self.tokens[self.width :]) if c]

    def _cut(self, text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > self.size:
            m = _CUT.search(text, at + self.size)
            if not m:
                break
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self.encode(text)) if text else 0

    def _build(self, chars: list[int], tokens: list[int]) -> None:
        self.width = 1 << max(0, len(chars) - 1).bit_length()
        pad = [0] * (self.width - len(chars))
        self.chars = [0] * self.width + chars + pad
        self.tokens = [0] * self.width + tokens + pad
        for i in range(self.width - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def _leaf(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at``, and where it starts."""
        i, start = 1, 0
        while i < self.width:
            i *= 2
            if at - start >= self.chars[i] and self.chars[i + 1]:
                start += self.chars[i]
                i += 1
        return i, start

    def _set(self, leaf: int, chars: int, tokens: int) -> None:
        self.chars[leaf], self.tokens[leaf] = chars, tokens
        i = leaf // 2
        while i:
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            i //= 2

    def edit(self, start: int, end: int, new: str) -> None:
        start = min(max(start, 0), len(self.text))
        end = min(max(end, start), len(self.text))
        first, begin = self._leaf(start)
        last, at = self._leaf(max(start, end - 1))
        stop = at + self.chars[last]
        text = self.text[:start] + new + self.text[end:]
        grown = len(new) - (end - start)
        while begin > 0 and not self._certain(text, begin):
            first -= 1
            begin -= self.chars[first]
        while stop < len(self.text) and not self._certain(text, stop + grown):
            last += 1
            stop += self.chars[last]
        self.text = text
        region = text[begin : stop + grown]
        pieces = self._cut(region)
        leaves = last - first + 1
        if len(pieces) > 4 * leaves:
            # The region has outgrown its leaves: same counts, new shape.
            count = [self._count(x) for x in pieces]
            sizes = self.chars[self.width : first] + [len(x) for x in pieces] + self.chars[last + 1 : 2 * self.width]
            tokens = self.tokens[self.width : first] + count + self.tokens[last + 1 : 2 * self.width]
            self._build(sizes, tokens)
            return
        per = -(-len(pieces) // leaves)
        for k in range(leaves):
            own = pieces[k * per : (k + 1) * per]
            self._set(first + k, sum(map(len, own)), sum(self._count(x) for x in own))

    @staticmethod
    def _certain(text: str, at: int) -> bool:
        return 0 < at < len(text) and _CUT.match(text, at) is not None


TREE = "text string, leaves array<struct<chars:int,tokens:int>>"


def plant(docs: DataFrame, edits: Column | None = None, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", size: int = LEAF_CHARS) -> DataFrame:
    """doc_id, text, leaves of every row of docs, and n_tokens; with edits (as in ``edit``) those too, unchanged."""
    kind = "array<struct<at:int,until:int,new:string>>"
    changes = F.lit(None).cast(kind) if edits is None else edits.cast(kind)

    def run(batches):
        c = codec(path)
        for batch in batches:
            trees = [Tree(text or "", c.encode, size) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, _leaves(trees), pa.array([t.total for t in trees], pa.int64())], ["doc_id", "text", "edits", "leaves", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", changes.alias("edits")).mapInArrow(run, f"doc_id long, text string, edits {kind}, leaves array<struct<chars:int,tokens:int>>, n_tokens long")


def _leaves(trees: list[Tree]) -> pa.Array:
    kind = pa.list_(pa.struct([("chars", pa.int32()), ("tokens", pa.int32())]))
    return pa.array([[{"chars": a, "tokens": b} for a, b in t.leaves] for t in trees], kind)


def edit(trees: DataFrame, edits: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", size: int = LEAF_CHARS, texts: bool = True) -> DataFrame:
    """The trees after edits: doc_id, text, leaves, n_tokens, n_tokens_before, n_chars_encoded.

    trees is what ``plant`` or ``edit`` gave, now or in an earlier run.  edits is an expression over it of type
    array<struct<at int, until int, new string>>; n_chars_encoded says how many characters were encoded again.
    Without texts, text and leaves are null: for those who want counts alone.
    """

    def run(batches):
        c = codec(path)
        for batch in batches:
            out, before = [], []
            for text, leaves, changes in zip(*(batch.column(k).to_pylist() for k in ("text", "leaves", "edits"))):
                tree = Tree(text or "", c.encode, size, [(x["chars"], x["tokens"]) for x in leaves or ()])
                before.append(tree.total)
                for x in changes or ():
                    if x and x["at"] is not None and x["until"] is not None:
                        tree.edit(x["at"], x["until"], x["new"] or "")
                out.append(tree)
            n = len(out)
            state = [pa.array([t.text for t in out], pa.string()), _leaves(out)] if texts else [pa.nulls(n, pa.string()), _leaves([]).take(pa.nulls(n, pa.int32()))]
            counts = [pa.array(x, pa.int64()) for x in ([t.total for t in out], before, [t.encoded for t in out])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *state, *counts], ["doc_id", "text", "leaves", "n_tokens", "n_tokens_before", "n_chars_encoded"])

    return trees.select("doc_id", "text", "leaves", edits.alias("edits")).mapInArrow(run, f"doc_id long, {TREE}, n_tokens long, n_tokens_before long, n_chars_encoded long")


def count_edited(docs: DataFrame, edits: Column, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", size: int = LEAF_CHARS) -> DataFrame:
    """Token counts before and after edits (an expression over docs): doc_id, n_tokens, n_tokens_edited, n_chars_encoded.

    Trees are planted in one narrow pass and edited in another, without a shuffle or a table between them.
    """
    done = edit(plant(docs, edits, path, size), F.col("edits"), path, size, texts=False)
    return done.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_chars_encoded")
