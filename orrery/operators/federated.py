"""Sharded search: shards by document range, statistics of each shard alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import query_terms


def shard(post: DataFrame, n: int) -> DataFrame:
    """post with shard_id = floor(doc_id / ceil((greatest doc_id + 1) / n)); a missing tf is 1."""
    size = post.agg(F.ceil((F.max("doc_id") + 1) / F.lit(n)).alias("size"))
    return post.crossJoin(F.broadcast(size)).select("term", "doc_id", F.coalesce("tf", F.lit(1)).alias("tf"), F.floor(F.col("doc_id") / F.col("size")).alias("shard_id"))


def shard_of(lengths: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """The size of a shard (one row), and the shards' statistics from document lengths: shard_id, n (postings), avgdl."""
    size = lengths.agg(F.ceil((F.max("doc_id") + 1) / F.lit(n)).alias("size"))
    rows = lengths.crossJoin(F.broadcast(size)).withColumn("shard_id", F.floor(F.col("doc_id") / F.col("size")))
    return size, rows.groupBy("shard_id").agg(F.sum("n_terms").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))


def shard_search(shards: DataFrame, queries: DataFrame, pagerank: DataFrame | None = None, top_k: int = 10, weights: tuple[float, float] = (0.85, 0.15)) -> DataFrame:
    """query_id, shard_id, doc_id, score, rank: BM25 with the shard's own N (its number of postings), df and mean length."""
    length = shards.groupBy("shard_id", "doc_id").agg(F.sum("tf").alias("dl"), F.count("*").alias("p"))
    stats = length.groupBy("shard_id").agg(F.sum("p").alias("n"), (F.sum("dl") / F.count("*")).alias("avgdl"))
    terms = queries.select("query_id", F.explode(query_terms(F.col("q"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    mine = shards.join(terms.select("term").distinct(), "term", "left_semi")
    return _ranked(mine.join(terms, "term").join(length.drop("p"), ["shard_id", "doc_id"]), stats, pagerank, top_k, weights)


def shard_search_stored(store, n: int, queries: DataFrame, pagerank: DataFrame | None = None, top_k: int = 10, weights: tuple[float, float] = (0.85, 0.15)) -> DataFrame:
    """The same over a stored index divided into n shards of documents: the terms' slots and the lengths are read, no texts."""
    size, stats = shard_of(store.lengths, n)
    hits = store.hits(queries).drop("df").crossJoin(F.broadcast(size)).withColumn("shard_id", F.floor(F.col("doc_id") / F.col("size")))
    return _ranked(hits, stats, pagerank, top_k, weights)


def _ranked(hits: DataFrame, stats: DataFrame, pagerank: DataFrame | None, top_k: int, weights: tuple[float, float]) -> DataFrame:
    """hits: query_id, term, times, shard_id, doc_id, tf, dl."""
    df = hits.groupBy("shard_id", "term").agg(F.count_distinct("doc_id").alias("df"))
    # As many rows as shards.
    hits = hits.join(df, ["shard_id", "term"]).join(F.broadcast(stats), "shard_id")
    part = F.col("times") * S.idf(F.col("n"), F.col("df")) * S.tf_norm(F.col("tf"), F.col("dl"), F.col("avgdl"))
    found = hits.groupBy("query_id", "shard_id", "doc_id").agg(F.sum(part).alias("s"))
    if pagerank is None:
        found = found.withColumn("s", weights[0] * F.col("s"))
    else:
        found = found.join(pagerank.select("doc_id", F.col("score").alias("pr")), "doc_id", "left").withColumn("s", weights[0] * F.col("s") + weights[1] * 10 * F.coalesce("pr", F.lit(0.0)))
    found = found.select("query_id", "shard_id", "doc_id", F.round("s", 3).alias("score"))
    w = Window.partitionBy("query_id", "shard_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)


def merge_shards(results: DataFrame, top_n: int = 20) -> DataFrame:
    """One list per query: best first, each document once."""
    once = Window.partitionBy("query_id", "doc_id").orderBy(F.col("score").desc(), "shard_id")
    best = results.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r", "rank")
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "doc_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def shard_sizes(shards: DataFrame) -> DataFrame:
    return shards.groupBy("shard_id").agg(F.count_distinct("term").alias("n_terms"), F.count_distinct("doc_id").alias("n_docs"))
