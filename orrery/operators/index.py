"""The inverted index in normal form: postings(term, doc_id, tf)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import STOPWORDS, token_rows, tokens
from .counting import LETTERS, counted, per_document, words


def emit(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """One row (doc_id, term) per token."""
    return docs.select("doc_id", F.explode(token_rows(F.col(text) if isinstance(text, str) else text)).alias("term")).where(~F.col("term").isin(*STOPWORDS))


def _term_counts():
    def count(ids, texts, rows):
        row, number, terms = words(texts, LETTERS, 3, STOPWORDS)
        row = row if rows is None else rows[row]
        term, doc, tf = counted(number, row, len(ids))
        dl = np.bincount(row, minlength=len(ids))
        yield pa.RecordBatch.from_arrays([terms.take(pa.array(term)), ids.take(pa.array(doc)), pa.array(tf, pa.int64()), pa.array(dl[doc], pa.int64())], ["term", "doc_id", "tf", "dl"])

    return count


def sized_postings(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """term, doc_id, tf, and dl, the document's number of tokens. No shuffle, unless rows share a doc_id."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, F.col(text) if isinstance(text, str) else text, _term_counts, f"term string, doc_id {kind}, tf long, dl long")


def _term_blocks(only: tuple[str, ...] | None):
    def count(ids, texts, rows):
        row, number, terms = words(texts, LETTERS, 3, STOPWORDS)
        row = row if rows is None else rows[row]
        term, doc, tf = counted(number, row, len(ids))
        dl, n_terms = np.bincount(row, minlength=len(ids)), np.bincount(doc, minlength=len(ids))
        if only is not None:
            mine = pc.is_in(terms, pa.array(only, pa.string())).to_numpy(zero_copy_only=False)
            kept = mine[term]
            term, doc, tf, terms = (np.cumsum(mine) - 1)[term[kept]], doc[kept], tf[kept], terms.filter(pa.array(mine))
        # Every number has a row at least.
        at, some = np.searchsorted(term, np.arange(len(terms) + 1)), np.flatnonzero(dl)
        whole = np.array([0, len(some)])
        lists = lambda at, *columns: [pa.ListArray.from_arrays(pa.array(at, pa.int32()), c) for c in columns]
        small = lambda x: pa.array(x, pa.int32())
        found = lists(at, ids.take(pa.array(doc)), small(tf), small(dl[doc]))
        sizes = lists(whole, ids.take(pa.array(some)), small(n_terms[some]), small(dl[some]))
        none = lambda n, like: [pa.nulls(n, c.type) for c in like]
        yield pa.RecordBatch.from_arrays([terms, small(np.diff(at)), *found, *none(len(terms), sizes)], _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, terms.type), pa.nulls(1, pa.int32()), *none(1, found), *sizes], _BLOCK)

    return count


_BLOCK = ["term", "n", "doc_ids", "tfs", "dls", "ids", "n_terms", "sizes"]


def blocks(docs: DataFrame, only: tuple[str, ...] | None = None) -> DataFrame:
    """Sized postings in lists: a row (term, n, doc_ids, tfs, dls) for each term of some megabytes of documents.

    One more row for these, without a term, has the documents with tokens (ids), their different terms and their lengths
    (n_terms, sizes).  Rows are several times fewer than postings, and none grows with the corpus.  With ``only``, just these terms have rows; documents
    and their sizes are the same.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return per_document(docs, F.col("text"), lambda: _term_blocks(only), f"term string, n int, doc_ids array<{kind}>, tfs array<int>, dls array<int>, ids array<{kind}>, n_terms array<int>, sizes array<int>")


def unpacked(found: DataFrame) -> DataFrame:
    """Blocks, with any further columns, as rows doc_id, tf, dl."""
    rest = [c for c in found.columns if c not in _BLOCK or c == "term"]
    rows = found.select(*rest, "tfs", "dls", F.posexplode("doc_ids").alias("at", "doc_id"))
    return rows.select(*rest, "doc_id", *[F.get(many, "at").cast("long").alias(one) for many, one in (("tfs", "tf"), ("dls", "dl"))])


def postings(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """term, doc_id, tf. Counted document by document, without a shuffle."""
    return sized_postings(docs, text).select("term", "doc_id", "tf")


def lists(post: DataFrame, span: int | None = None) -> DataFrame:
    """term, df, doc_ids (sorted) and tfs in the same order; with span as in nested."""
    keys = ["term"] if span is None else ["term", F.floor(F.col("doc_id") / span).alias("block")]
    pairs = F.sort_array(F.collect_list(F.struct("doc_id", "tf")))
    return post.groupBy(*keys).agg(F.count("*").alias("df"), pairs.alias("p")).select("term", "df", F.col("p.doc_id").alias("doc_ids"), F.col("p.tf").alias("tfs"))


def nested(post: DataFrame, span: int | None = None) -> DataFrame:
    """term, df, doc_ids (sorted) and tf by doc_id.

    With span, a term has a row for each range of that many doc_ids (and df counts the range), so no row grows with the corpus.
    """
    return lists(post, span).select("term", "df", "doc_ids", F.map_from_arrays("doc_ids", "tfs").alias("tf"))


def merge(*parts: DataFrame) -> DataFrame:
    """Union of partial indexes; the tf of a term and document add up."""
    whole = parts[0].select("term", "doc_id", "tf")
    for p in parts[1:]:
        whole = whole.unionByName(p.select("term", "doc_id", "tf"))
    return whole.groupBy("term", "doc_id").agg(F.sum("tf").alias("tf"))


def remove(post: DataFrame, ids: DataFrame) -> DataFrame:
    return post.join(ids.select("doc_id"), "doc_id", "left_anti").select("term", "doc_id", "tf")


def doc_lengths(post: DataFrame) -> DataFrame:
    return post.groupBy("doc_id").agg(F.sum("tf").alias("dl"))


def lengths_of(docs: DataFrame, text: str | Column = "text") -> DataFrame:
    """Document lengths straight from the text: no shuffle. Documents without tokens are left out."""
    c = F.col(text) if isinstance(text, str) else text
    return docs.select("doc_id", F.size(tokens(c)).cast("long").alias("dl")).where("dl > 0")


def frequencies(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(post: DataFrame) -> DataFrame:
    """total_docs, total_terms, total_length, avgdl over indexed documents, in one pass."""
    return post.agg(F.count_distinct("doc_id").alias("total_docs"), F.count_distinct("term").alias("total_terms"), F.sum("tf").alias("total_length")).withColumn("avgdl", F.round(F.col("total_length") / F.greatest(F.col("total_docs"), F.lit(1)), 4))


def unindexed(docs: DataFrame, meta: DataFrame) -> DataFrame:
    return docs.join(meta.select("doc_id"), "doc_id", "left_anti")


def incremental(docs: DataFrame, post: DataFrame, meta: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The index with all documents that meta lacks, and meta with their token counts.

    Old postings of a document that comes again are dropped first, so nothing counts twice.
    """
    new = unindexed(docs, meta)
    delta = postings(new)
    counts = new.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("term_count"))
    return merge(remove(post, new), delta), meta.select("doc_id", "term_count").unionByName(counts)
