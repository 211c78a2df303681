"""What a user of a search service asks for, one function per request, each giving a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import highlight
from ..operators import federated as FD
from ..operators import index as I
from ..operators import logs as L
from ..operators import rank as R
from ..operators import suggest as SG
from ..operators.store import Store
from ..sources import tables as TB
from ..streaming import live as LV


class Engine:
    """A corpus with its stored index, and the logs around it.

    store (of docs), meta(doc_id, url, title, snippet), pagerank(doc_id, score),
    query_log, click_log, crawl_log.  Requests are tables too, so a hundred
    searches are one plan.  Nothing but ``reindex`` reads a text.
    """

    def __init__(self, store: Store, meta: DataFrame, pagerank: DataFrame | None = None, query_log: DataFrame | None = None, click_log: DataFrame | None = None, crawl_log: DataFrame | None = None, curated: DataFrame | None = None, vectors: DataFrame | None = None):
        self.store, self.meta, self.pagerank, self.vectors = store, meta, pagerank, vectors
        self.query_log, self.click_log, self.crawl_log = query_log, click_log, crawl_log
        self.vocabulary = store.vocabulary.select("term", "df")
        self.postings = store.postings.select("term", "doc_id", "tf")
        self.curated = curated

    def suggest(self, prefixes: DataFrame) -> DataFrame:
        return SG.complete(self.vocabulary, prefixes, least=2)

    def spell(self, words: DataFrame) -> DataFrame:
        return SG.correct(self.vocabulary, words)

    def correct(self, queries: DataFrame) -> DataFrame:
        return SG.correct_queries(self.vocabulary, queries)

    def expand(self, queries: DataFrame) -> DataFrame:
        """With words that occur together, after those of the curated table (term, pos, synonym) if there is one."""
        terms = queries.select(F.explode(F.split(F.trim(F.lower("q")), r"\s+")).alias("term"))
        return SG.expand(queries, SG.synonyms(terms, self.vocabulary, SG.cooccurrence(self.postings), self.curated))

    def search(self, queries: DataFrame, limit: int = 10) -> DataFrame:
        return R.with_meta(R.bm25_stored(self.store, queries, self.pagerank, limit), self.meta)

    def hybrid(self, queries: DataFrame, expanded: DataFrame | None = None, top_n: int = 20) -> DataFrame:
        """Lexical search on the expanded queries, semantic search on the queries as they are.

        With vectors of the documents (doc_id, embedding) the semantic side is vector search; otherwise it is TF-IDF.
        """
        lexical = R.bm25_stored(self.store, queries if expanded is None else expanded, self.pagerank, 2 * top_n)
        if self.vectors is None:
            return R.hybrid(lexical, R.tfidf_stored(self.store, queries, 2 * top_n), 0.05, R.hybrid_weights(2, False), top_n)
        asked = R.encode_words(queries.withColumnRenamed("query_id", "doc_id"), "q").select(F.col("doc_id").alias("query_id"), F.col("embedding").alias("q_vector"))
        found = R.vector_search(self.vectors, asked, 2 * top_n, key="doc_id")
        return R.hybrid(lexical, found, 0.2, R.hybrid_weights(2, True), top_n)

    def page(self, queries: DataFrame) -> DataFrame:
        """A result page: spelling, expansion, hybrid search, click boost, highlighted snippets."""
        active = self.correct(queries).select("query_id", F.col("corrected").alias("q"))
        expanded = self.expand(active).select("query_id", F.col("expanded").alias("q"))
        results = self.hybrid(active, expanded)
        if self.click_log is not None:
            results = R.boost_clicks(results, self.click_log, active)
        return R.with_meta(results, self.meta).join(active, "query_id").withColumn("snippet", highlight(F.col("snippet"), F.col("q")))

    def log_of(self, page: DataFrame, queries: DataFrame, now: str, session: str = "") -> DataFrame:
        """What to append to the query log after a page: query, result_count, timestamp, session_id."""
        counts = page.groupBy("query_id").agg(F.count("*").alias("n"))
        return queries.join(counts, "query_id", "left").select(F.col("q").alias("query"), F.coalesce("n", F.lit(0)).alias("result_count"), F.lit(now).cast("timestamp").alias("timestamp"), F.lit(session).alias("session_id"))

    def stats(self) -> DataFrame:
        return self.store.corpus.select("n").crossJoin(self.vocabulary.agg(F.count("*").alias("terms")))

    def document(self, doc_id: int) -> DataFrame:
        found = TB.document(self.meta, doc_id)
        return found if self.pagerank is None else found.join(self.pagerank, "doc_id", "left").fillna({"score": 0.0})

    def metrics(self) -> DataFrame:
        return L.domain_stats(self.crawl_log)

    def analytics(self, now: str) -> dict[str, DataFrame]:
        return {"top": L.top_queries(self.query_log), "zero": L.zero_result_queries(self.query_log, 10), "clicked": L.top_clicked(self.click_log, self.meta), "hourly": L.hourly(self.query_log, now, 24)}

    def log_analysis(self) -> dict[str, DataFrame]:
        return {"top_terms": L.term_frequency(self.query_log), "position_bias": L.position_bias(self.click_log), "zero_results": L.result_gaps(self.query_log).where("kind = 'zero'"), "hourly_volume": L.hour_volume(self.query_log)}

    def federated(self, queries: DataFrame, shards: int = 3) -> DataFrame:
        return FD.merge_shards(FD.shard_search_stored(self.store, shards, queries, self.pagerank))

    def collaborative(self, queries: DataFrame, now: str, half_life: float = 300.0) -> DataFrame:
        return R.boost_crowd(self.hybrid(queries), LV.crowd_scores(self.click_log, now, half_life))

    def reindex(self, indexed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Postings and index metadata with the documents that ``indexed`` (doc_id, term_count) lacks."""
        return I.incremental(self.store.docs, self.postings.join(indexed.select("doc_id"), "doc_id", "left_semi"), indexed)
