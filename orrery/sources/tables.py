"""Sources and sinks. Reads declare schemas; writes never destroy what they read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..functions.text import log_rank, log_url
from ..session import fresh

PAGE_JSON = "doc_id long, url string, title string, text string, snippet string, links array<string>"
METRICS_JSON = "type string, domain string, duration_ms double, status string, depth long, active_workers long, ts double"
LOG_JSON = "ts double, iso string, level string, logger string, message string, worker_rank int, url string"
INDEX = "term string, doc_id long, tf long"


def json_pages(spark: SparkSession, path: str, whole_files: bool = True, with_id: bool = True) -> DataFrame:
    """One page per JSON file (or per line); what is no JSON gives no row, nor, unless with_id is False, what has no doc_id."""
    rows = spark.read.schema(PAGE_JSON + ", _corrupt_record string").option("mode", "PERMISSIVE").option("multiLine", whole_files).json(path)
    return rows.where("_corrupt_record is null and doc_id is not null" if with_id else "_corrupt_record is null").drop("_corrupt_record")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """Fetch events of a metrics log; malformed lines and other events are skipped."""
    return spark.read.schema(METRICS_JSON).option("mode", "DROPMALFORMED").json(path).where("type = 'fetch'")


def metrics_stream(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.readStream.schema(METRICS_JSON).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("timestamp", F.timestamp_seconds("ts"))


def index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(path)


def ranks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(F.col("doc_id").cast("long"), "score")


def document(docs: DataFrame, doc_id: int) -> DataFrame:
    return docs.where(F.col("doc_id") == doc_id).limit(1)


def url_map(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "url", "title", F.coalesce("snippet", F.lit("")).alias("snippet"))


def upsert_documents(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and new documents, the last one of each URL, then of each doc_id: by crawled_at, then doc_id, then being new."""
    newer, place = fresh(old, "is_new"), fresh(old, "place")
    whole = old.withColumn(newer, F.lit(0)).unionByName(new.withColumn(newer, F.lit(1)))
    for key in ("url", "doc_id"):
        w = Window.partitionBy(key).orderBy(F.col(newer).desc(), F.col("crawled_at").desc(), F.col("doc_id").desc(), F.col("url").desc())
        whole = whole.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)
    return whole.withColumn("domain", U.netloc(F.col("url"))).drop(newer)


def mark_indexed(meta: DataFrame, done: DataFrame) -> DataFrame:
    return meta.join(done.select("doc_id"), "doc_id", "left_anti").select("doc_id", "term_count").unionByName(done.select("doc_id", "term_count"))


def update_ranks(docs: DataFrame, scores: DataFrame) -> DataFrame:
    score = fresh(docs, "new_rank")
    new = scores.select("doc_id", F.col("score").alias(score))
    return docs.join(new, "doc_id", "left").withColumn("pagerank", F.coalesce(score, "pagerank")).drop(score)


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_index(post: DataFrame, path: str, files: int = 16) -> None:
    """Postings in ranges of terms, sorted, so that a reader of some terms skips the other row groups."""
    post.select("term", "doc_id", "tf").repartitionByRange(files, "term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_pages(docs: DataFrame, path: str) -> None:
    write_json(docs.select("doc_id", "url", "title", "text", "snippet", "links"), path)


def migrate(spark: SparkSession, source: str, target: str, whole_files: bool = True, with_id: bool = True) -> int:
    """Page JSON files into a table; the files stay. Gives the number of documents."""
    json_pages(spark, source, whole_files, with_id).write.mode("overwrite").parquet(target)
    return spark.read.parquet(target).count()


def components(vectors: DataFrame) -> DataFrame:
    """vec_id, label, dim (from 1), x (6 places) of stored vectors."""
    rows = vectors.select("vec_id", "label", F.posexplode("embedding").alias("i", "x"))
    return rows.select("vec_id", "label", (F.col("i") + 1).cast("long").alias("dim"), F.round(F.col("x").cast("double"), 6).alias("x"))


def write_index_json(nested: DataFrame, path: str) -> None:
    """An index as lines of JSON, a term each: term, df, doc_ids, tfs in the order of those; nested has tfs or the map tf, made in that order.

    A map is never searched for each of its documents, which takes the square of their number.
    """
    tfs = F.col("tfs") if "tfs" in nested.columns else F.map_values("tf").alias("tfs")
    nested.select("term", "df", "doc_ids", tfs).write.mode("overwrite").json(path)


def index_json(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("term string, df long, doc_ids array<long>, tfs array<long>").json(path)
    return rows.select("term", F.explode(F.arrays_zip("doc_ids", "tfs")).alias("p")).select("term", F.col("p.doc_ids").alias("doc_id"), F.col("p.tfs").alias("tf"))


def write_metrics(fetches: DataFrame, queue: DataFrame, path: str) -> None:
    """Appends fetch events, with durations to one place, and queue events to a metrics log."""
    ts = (F.unix_micros("timestamp") / 1e6).alias("ts")
    fetches.select(F.lit("fetch").alias("type"), "domain", F.round("duration_ms", 1).alias("duration_ms"), "status", ts).write.mode("append").json(path)
    queue.select(F.lit("queue").alias("type"), F.col("depth").cast("long").alias("depth"), F.col("active_workers").cast("long").alias("active_workers"), ts).write.mode("append").json(path)


def queue_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRICS_JSON).option("mode", "DROPMALFORMED").json(path).where("type = 'queue'").select("depth", "active_workers", "ts")


def write_log(lines: DataFrame, path: str) -> None:
    """Appends log lines (timestamp, level, logger, message) as JSON, with the worker's rank and the URL found in the message."""
    iso = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")
    lines.select((F.unix_micros("timestamp") / 1e6).alias("ts"), iso, "level", "logger", "message", log_rank(F.col("message")).alias("worker_rank"), log_url(F.col("message")).alias("url")).write.mode("append").json(path)


def logs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_JSON).option("mode", "DROPMALFORMED").json(path)


def page_sinks(path: str):
    """A sink for streaming.live.start: every batch of pages goes to documents and to the crawl log.

    Both have a folder for each batch, so that one that is run again replaces itself in both.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.select("doc_id", "url", "title").write.mode("overwrite").parquet(f"{path}/documents/epoch={epoch}")
        batch.select("url", "doc_id", F.lit("ok").alias("status")).write.mode("overwrite").parquet(f"{path}/crawl_log/epoch={epoch}")

    return sink


def robots(rules: DataFrame, always: list[str] = (), default: float = 0.5) -> DataFrame:
    """domain, rules, delay, free: the robots table that crawling joins, of texts by domain (the greatest counts of several).

    Domains in always are free and wait the default; so do domains without rules or without a delay for all agents.
    """
    one = rules.groupBy("domain").agg(F.max("rules").alias("rules"))
    free = F.col("domain").isin(*always) if always else F.lit(False)
    return one.select("domain", "rules", F.when(free, F.lit(default)).otherwise(F.coalesce(U.crawl_delay(F.col("rules")), F.lit(default))).alias("delay"), free.alias("free"))


def save_snapshot(frontier: DataFrame, visited: DataFrame, path: str) -> None:
    frontier.write.mode("overwrite").parquet(f"{path}/frontier")
    visited.write.mode("overwrite").parquet(f"{path}/visited")


def load_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """Frontier and visited set, or None where there is no snapshot."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/visited/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.parquet(f"{path}/frontier"), spark.read.parquet(f"{path}/visited")
