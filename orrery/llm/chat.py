"""Operator 7: chat formatting with offset-aligned loss masks.

Each conversation is rendered whole, encoded once, and every token's byte span
follows from the token lengths.  The spans of the turns that are learnt from
are sorted too, so a token's mask is found by two binary searches: it is set if
the token shares at least one byte with a learnt span.

Results for odd input: turns are ordered by number, then role, then text, nulls
first, so ties and repeated rows have one order and each counts; a null role is
rendered as ``unknown`` and never learnt; a null text is an empty message; rows
of a null conv_id form one conversation of their own; further columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import codec
from .common import TOKENIZERS

OPEN, SEPARATOR, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT = ("assistant",)
SCHEMA = "conv_id long, n_turns long, n_tokens long, n_learnt long, input_ids array<int>, loss_mask array<int>"


def render(turns: list[dict], learnt: tuple[str, ...] = LEARNT) -> tuple[str, np.ndarray, np.ndarray]:
    """The whole conversation, and byte starts and ends of what is learnt: message and closing mark."""
    parts, starts, ends, at = [], [], [], 0
    for t in turns:
        role, body = t["role"] or "unknown", t["text"] or ""
        head = f"{OPEN}{role}{SEPARATOR}"
        h, b = len(head.encode()), len(f"{body}{CLOSE}".encode())
        if t["role"] in learnt:
            starts.append(at + h)
            ends.append(at + h + b)
        parts += [head, body, CLOSE]
        at += h + b
    return "".join(parts), np.array(starts, np.int64), np.array(ends, np.int64)


def mask(token_starts: np.ndarray, token_ends: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 where a token overlaps one of the sorted, disjoint spans."""
    if not len(starts):
        return np.zeros(len(token_starts), np.int32)
    first = np.searchsorted(ends, token_starts, side="right")
    return ((first < len(starts)) & (starts[np.minimum(first, len(starts) - 1)] < token_ends)).astype(np.int32)


def format_chats(turns: DataFrame, path: str = f"{TOKENIZERS}/byte_bpe_50k.tiktoken", learnt: tuple[str, ...] = LEARNT) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_tokens, n_learnt, input_ids, loss_mask.

    One shuffle, on conv_id, which brings the turns of a conversation together.
    """
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))

    def run(batches):
        c = codec(path)
        lengths = np.zeros(max(c.bytes_of) + 1, np.int64)
        for t, raw in c.bytes_of.items():
            lengths[t] = len(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids, masks, n = [], [], []
                for turn_list in part.column("turns").to_pylist():
                    text, starts, ends = render(turn_list, learnt)
                    tokens = np.array(c.encode(text), np.int32)
                    stop = np.cumsum(lengths[tokens])
                    ids.append(tokens)
                    masks.append(mask(stop - lengths[tokens], stop, starts, ends))
                    n.append(len(turn_list))
                sizes = np.array([len(x) for x in ids], np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("conv_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(sizes), pa.array([int(m.sum()) for m in masks], pa.int64())]
                    + [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (ids, masks)],
                    ["conv_id", "n_turns", "n_tokens", "n_learnt", "input_ids", "loss_mask"],
                )

    return whole.mapInArrow(run, SCHEMA)
