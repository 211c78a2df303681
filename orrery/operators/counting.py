"""Counts of words within documents, made while a document's text is at hand.

A document's counts need no shuffle: Python cuts the bytes of an Arrow column at word borders, gives words numbers and
sorts (word, document) as integers, some megabytes of text at a time.  Rows that share a doc_id are one document; they
alone are brought together first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import maybe_broadcast, written

#: Bytes of text that are counted at once.
PIECE = 16 << 20
LETTERS = np.isin(np.arange(256), np.arange(ord("a"), ord("z") + 1)).astype(np.uint8)
WORD = LETTERS | np.isin(np.arange(256), [*range(ord("0"), ord("9") + 1), ord("_")]).astype(np.uint8)


def words(texts: pa.Array, kind: np.ndarray, least: int, stop: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """All words of ``least`` or more characters that are no stop words, in order: row, number, and the words by number.

    Texts are lower-cased, not null and end with a character that is not of a word.
    """
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), pa.array([], pa.string())
    if not len(texts) or at[-1] == at[0]:
        return none
    base = int(at[0])
    edge = np.diff(kind[np.frombuffer(texts.buffers()[2], np.uint8)[base : at[-1]]], prepend=np.uint8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == 255)
    long = end - start >= least
    start, end = start[long], end[long]
    if not len(start):
        return none
    row = np.searchsorted(at[1:] - base, start, side="right")
    # Words and what lies between them, over the same bytes.
    borders = (np.stack([start, end], 1).ravel() + base).astype(np.int32)
    both = pa.StringArray.from_buffers(len(borders) - 1, pa.py_buffer(borders), texts.buffers()[2])
    coded = both.take(pa.array(np.arange(0, len(borders) - 1, 2))).dictionary_encode()
    number = coded.indices.to_numpy().astype(np.int64)
    good = ~pc.is_in(coded.dictionary, pa.array(stop, pa.string())).to_numpy(zero_copy_only=False)
    kept = good[number]
    return row[kept], (np.cumsum(good) - 1)[number[kept]], coded.dictionary.filter(pa.array(good))


def counted(number: np.ndarray, row: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (number, row), sorted, and how often each occurs."""
    key, n = np.unique(number * rows + row, return_counts=True)
    return key // rows, key % rows, n


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, pa.Array]]:
    ids, texts = batch.column(0), batch.column(1)
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(ids):
        j = max(i + 1, int(np.searchsorted(size, (size[i - 1] if i else 0) + PIECE, side="right")))
        yield ids.slice(i, j - i), texts.slice(i, j - i)
        i = j


def _end(text: Column) -> Column:
    return F.concat(F.lower(F.coalesce(text, F.lit(""))), F.lit("\n"))


def per_document(docs: DataFrame, text: Column, make: Callable[[Callable], Callable], schema: str) -> DataFrame:
    """The rows of count(ids, texts, rows) for pieces of the documents; rows: the document of each text, by its place in ids.

    ``make`` is called without arguments on the worker, once for each task, and gives count, which yields record batches.
    """
    lines = docs.select("doc_id", _end(text).alias("text"))

    def run(batches):
        count = make()
        for batch in batches:
            for ids, texts in _pieces(batch):
                yield from count(ids, texts, None)
        yield from getattr(count, "rest", lambda: ())()

    def one(table: pa.Table) -> pa.Table:
        count = make()
        batch = table.combine_chunks()
        texts = batch.column("text").combine_chunks()
        found = list(count(batch.column("doc_id").combine_chunks().slice(0, 1), texts.cast(pa.string()), np.zeros(len(texts), np.int64)))
        found += list(getattr(count, "rest", lambda: ())())
        return pa.Table.from_batches(found) if found else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    more = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("doc_id").alias("again"))
    if more.isEmpty():
        return lines.mapInArrow(run, schema)
    more = maybe_broadcast(written(more, "repeated"))
    same = F.col("doc_id").eqNullSafe(F.col("again"))
    return lines.join(more, same, "left_anti").mapInArrow(run, schema).unionByName(lines.join(more, same, "left_semi").groupBy("doc_id").applyInArrow(one, schema))
