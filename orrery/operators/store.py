"""The stored index: built once from the documents, then read by every search.

Tables are divided into slots by a hash of the term and sorted by term within
them, so that a search's terms prune the scan to their slots (by dynamic
partition pruning) and to row groups within those.  Postings lie in lists, which
only a search for their term unpacks, and carry the length of their document,
which leaves a search one aggregation and one ranking.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..session import dropped, scratch, small, written
from . import index as I

#: Rows that a slot has on average, once there are more than the least number of slots.
SLOT_ROWS = 4_000_000
LEAST_SLOTS = 16
#: What the terms may hold that an index is made of, as they go to all tasks.
ASKED_BYTES = 4 << 20


def slot_of(term: Column, slots: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(slots)).cast("int")


def _save(df: DataFrame, name: str, key: str, slots: int, order: list[str]) -> DataFrame:
    """df by slots of key; adaptive execution divides what a frequent term makes too large for one task."""
    path = scratch(df.sparkSession, name)
    rows = df.withColumn("slot", slot_of(F.col(key), slots)).hint("rebalance", "slot").sortWithinPartitions("slot", *order)
    rows.write.partitionBy("slot").parquet(path)
    schema = rows.select(*[c for c in rows.columns if c != "slot"], "slot").schema
    return df.sparkSession.read.schema(schema).parquet(path)


def terms_of(queries: DataFrame, term: Column, slots: int, name: str = "term") -> DataFrame:
    """query_id, term, slot, times: a small written table, to be broadcast if its size allows."""
    rows = queries.select("query_id", term.alias(name)).groupBy("query_id", name).agg(F.count("*").alias("times")).withColumn("slot", slot_of(F.col(name), slots))
    # A condition tells the optimizer that these rows select slots.
    return written(rows, "terms").where(F.length(name) > 0)


def meet(terms: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The stored rows of these terms, from their slots only."""
    return stored.join(F.broadcast(terms) if small(terms) else terms, ["slot", key])


@dataclass
class Store:
    """blocks (of postings, as in index.blocks), vocabulary (term, df), lengths (doc_id, dl, n_terms), corpus (one row: n, total)."""

    blocks: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame
    corpus: DataFrame
    slots: int
    docs: DataFrame

    @classmethod
    def build(cls, docs: DataFrame, n_docs: DataFrame | None = None, only: tuple[str, ...] | None = None) -> "Store":
        """Indexes docs(doc_id, text); n_docs: one row with n, by default the number of docs, with tokens or without.

        With ``only``, blocks and vocabulary are of these terms alone; lengths and corpus are whole.
        """
        made = written(I.blocks(docs, only), "postings")
        each = made.where("ids is not null").select("sizes", "n_terms", F.posexplode("ids").alias("at", "doc_id"))
        lengths = written(each.select("doc_id", *[F.get(many, "at").cast("long").alias(one) for many, one in (("sizes", "dl"), ("n_terms", "n_terms"))]), "lengths")
        n = docs.agg(F.count("*").alias("n")) if n_docs is None else n_docs
        corpus = written(n.crossJoin(lengths.agg(F.coalesce(F.sum("dl"), F.lit(0)).alias("total"))), "corpus")
        rows = 0 if only is not None else lengths.agg(F.sum("n_terms")).first()[0] or 0
        slots = max(LEAST_SLOTS, -(-rows // SLOT_ROWS))
        index = _save(made.where("term is not null").select("term", "n", "doc_ids", "tfs", "dls"), "index", "term", slots, ["term"])
        dropped(made)
        # A term's blocks lie together by now.
        return cls(index, _save(index.groupBy("term").agg(F.sum("n").alias("df")), "vocabulary", "term", slots, ["term"]), lengths, corpus, slots, docs)

    @classmethod
    def of_terms(cls, docs: DataFrame, queries: DataFrame) -> "Store":
        """An index of the terms of queries(query_id, q), which answers them as the whole one does.

        Every text is read once and every document counts, but no posting of any other term is listed, shuffled or written.
        The terms go to all tasks; where there are too many for that, the index is whole.
        """
        terms = written(queries.select(F.explode(query_terms(F.col("q"))).alias("term")).distinct(), "asked")
        return cls.build(docs, only=tuple(sorted(r.term for r in terms.collect())) if small(terms, ASKED_BYTES) else None)

    @property
    def postings(self) -> DataFrame:
        """slot, term, doc_id, tf, dl."""
        return I.unpacked(self.blocks)

    def hits(self, queries: DataFrame) -> DataFrame:
        """query_id, term, times, df, doc_id, tf, dl: the postings of all queries' terms."""
        terms = terms_of(queries, F.explode(query_terms(F.col("q"))), self.slots)
        known = meet(terms, self.vocabulary, "term")
        # No more rows than the queries have terms.
        return I.unpacked(self.blocks.join(F.broadcast(known) if small(terms) else known, ["slot", "term"]))

    @cached_property
    def features(self) -> tuple[DataFrame, DataFrame]:
        """TF-IDF weights (feature, doc_id, weight) and features (feature, idf), both by slots."""
        from .rank import tfidf

        weights, kept = tfidf(self.docs)
        return _save(weights, "weights", "feature", self.slots, ["feature", "doc_id"]), _save(kept, "features", "feature", self.slots, ["feature"])
