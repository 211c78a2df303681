"""Structured Streaming versions of the stateful parts, and their batch forms.

All of them work on event time with a watermark, so a replay gives the same
answers; a batch form next to a stream gives what the stream converges to.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import scores as S

WATERMARK = "10 minutes"


def progress(log: DataFrame) -> DataFrame:
    """Pages and failures of each worker, of a table or a stream (output mode complete)."""
    return log.groupBy("worker_rank").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"))


def query_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.lower("query").alias("query")).agg(F.count("*").alias("n"))


def last_seen(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.max("timestamp").alias("last_seen"))


def active_users(log: DataFrame, now: str, seconds: int = 300) -> DataFrame:
    at = F.lit(now).cast("timestamp")
    return log.where((F.col("timestamp") > at - F.make_dt_interval(secs=F.lit(seconds))) & (F.col("timestamp") <= at)).agg(F.count_distinct("session_id").alias("active_users"))


def active_users_stream(log: DataFrame, watermark: str = WATERMARK, window: str = "5 minutes") -> DataFrame:
    rows = log.withWatermark("timestamp", watermark).groupBy(F.window("timestamp", window)).agg(F.approx_count_distinct("session_id").alias("active_users"))
    return rows.select(F.col("window.start").alias("start"), "active_users")


def crowd_scores(clicks: DataFrame, now: str, half_life: float = S.HALF_LIFE, least: float = 0.001) -> DataFrame:
    """doc_id, score (6 places): click weights decayed to ``now``; scores under ``least`` are dropped."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("timestamp")) / 1e6
    part = S.decayed(S.click_weight(F.col("position")), age, half_life)
    return clicks.where(F.col("timestamp") <= F.lit(now).cast("timestamp")).groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).where(F.col("score") >= least)


def trending_documents(scores: DataFrame, n: int = 5) -> DataFrame:
    return scores.orderBy(F.col("score").desc(), "doc_id").limit(n)


def crowd_stream(clicks: DataFrame, half_life: float = S.HALF_LIFE, watermark: str = WATERMARK, least: float = 0.001) -> DataFrame:
    """doc_id, score, last_ts of documents as clicks come (output mode update).

    The state is one score at one time per document.  A late click adds its
    weight decayed to that time, so the order of arrival does not matter; a
    document whose score has faded below ``least`` by the watermark is forgotten.
    """
    fade = math.log(2) / half_life

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        score, last = state.get if state.exists else (0.0, None)
        for rows in batches:
            for t, p in zip(rows["t"], rows["position"]):
                weight = 2 / math.log2(p + 2)
                if last is None or t >= last:
                    score = score * (math.exp(-(t - last) * fade) if last is not None else 0.0) + weight
                    last = t
                else:
                    score += weight * math.exp(-(last - t) * fade)
        state.update((score, last))
        gone = last + max(0.0, math.log(max(score, least) / least)) / fade
        mark = state.getCurrentWatermarkMs()
        state.setTimeoutTimestamp(max(int(gone * 1000), mark + 1))
        yield pd.DataFrame({"doc_id": [key[0]], "score": [score], "last_ts": [last]})

    rows = clicks.withWatermark("timestamp", watermark).select("doc_id", "timestamp", (F.unix_micros("timestamp") / 1e6).alias("t"), F.col("position").cast("double").alias("position"))
    return rows.groupBy("doc_id").applyInPandasWithState(update, "doc_id long, score double, last_ts double", "score double, last double", "update", GroupStateTimeout.EventTimeTimeout)


def bucket_stream(requests: DataFrame, key: str, rate: float = 1.5, capacity: float = 5.0, watermark: str = WATERMARK) -> DataFrame:
    """id, key, granted, wait_s as requests come (output mode append); a bucket's state is its balance and its time."""

    def update(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (capacity, None)
        rows = pd.concat(list(batches)).sort_values(["t", "id"])
        granted, waits = [], []
        for t in rows["t"]:
            tokens = min(capacity, tokens + max(0.0, t - last) * rate) if last is not None else tokens
            last = t if last is None else max(last, t)
            ok = tokens >= 1.0
            granted.append(ok)
            waits.append(0.0 if ok else round((1.0 - tokens) / rate, 3))
            tokens -= 1.0 if ok else 0.0
        state.update((tokens, last))
        yield pd.DataFrame({"id": rows["id"], "key": k[0], "granted": granted, "wait_s": waits})

    rows = requests.withWatermark("timestamp", watermark).select("id", F.col(key).cast("string").alias("key"), "timestamp", (F.unix_micros("timestamp") / 1e6).alias("t"))
    return rows.groupBy("key").applyInPandasWithState(update, "id long, key string, granted boolean, wait_s double", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def queue_depth(log: DataFrame, window: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """start, mean_depth (3 places), most: of a table, or with a watermark of a stream."""
    rows = log.withWatermark("timestamp", watermark) if watermark else log
    g = rows.groupBy(F.window("timestamp", window)).agg(F.round(F.avg("depth"), 3).alias("mean_depth"), F.max("depth").alias("most"))
    return g.select(F.col("window.start").alias("start"), "mean_depth", "most")


def first_results_stream(results: DataFrame, watermark: str = WATERMARK) -> DataFrame:
    return results.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["doc_id"])


def feed(queries: DataFrame, clicks: DataFrame, n: int = 100) -> DataFrame:
    """The newest n events of both logs: kind, id, what, timestamp."""
    q = queries.select(F.lit("query").alias("kind"), "id", F.col("query").alias("what"), "timestamp")
    c = clicks.select(F.lit("click").alias("kind"), "id", F.col("doc_id").cast("string").alias("what"), "timestamp")
    return q.unionByName(c).orderBy(F.col("timestamp").desc(), F.col("id").desc()).limit(n)


def start(stream: DataFrame, sink, checkpoint: str, mode: str, every: str | None = None):
    """Starts a query that hands every batch to ``sink(df, epoch)``; without ``every`` it ends when the source is read."""
    writer = stream.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def domain_windows(log: DataFrame, window: str = "1 minute", watermark: str | None = None) -> DataFrame:
    """domain, start, fetches, errors, blocked, avg_ms (1 place) by windows of event time: of a table, or with a watermark of a stream."""
    rows = log.withWatermark("timestamp", watermark) if watermark else log
    ok = F.when(F.col("status") == "ok", F.col("duration_ms"))
    g = rows.groupBy("domain", F.window("timestamp", window)).agg(
        F.count("*").alias("fetches"), F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.round(F.avg(ok), 1).alias("avg_ms"),
    )
    return g.select("domain", F.col("window.start").alias("start"), "fetches", "errors", "blocked", "avg_ms")


def activity(queries: DataFrame, clicks: DataFrame, now: str, half_life: float = S.HALF_LIFE, seconds: int = 300, trending: int = 5, newest: int = 10) -> DataFrame:
    """What a page of live activity shows: section, place, what, value (text), from the state of both logs."""
    total = queries.agg(F.count("*").alias("total_queries"), F.count_distinct(F.lower("query")).alias("unique_queries")).crossJoin(active_users(queries, now, seconds))
    names = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("what"), F.col(n).cast("string").alias("value")) for i, n in enumerate(("total_queries", "unique_queries", "active_users"), 1)])
    stats = total.select(F.explode(names).alias("x")).select(F.lit("stats").alias("section"), "x.*")
    by = lambda df, *order: df.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)))
    # Both lists are limited before they are numbered.
    top = by(trending_documents(crowd_scores(clicks, now, half_life), trending), F.col("score").desc(), "doc_id")
    last = by(feed(queries, clicks, newest), F.col("timestamp").desc(), F.col("id").desc())
    return stats.unionByName(top.select(F.lit("trending").alias("section"), "place", F.col("doc_id").cast("string").alias("what"), F.format_string("%.6f", "score").alias("value"))).unionByName(
        last.select(F.lit("feed").alias("section"), "place", F.concat_ws(" ", "kind", F.col("id").cast("string")).alias("what"), F.col("what").alias("value"))
    )


def throughput(log: DataFrame, window: str = "1 hour", points: int = 80) -> DataFrame:
    """The last ``points`` points of a crawl's progress: start, pages so far."""
    per = log.where("status = 'ok'").groupBy(F.window("timestamp", window).alias("w")).agg(F.count("*").alias("n"))
    # One row for each window, which the running sum needs in one order.
    ran = per.select(F.col("w.start").alias("start"), F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("w.start")).alias("pages"))
    return ran.orderBy(F.col("start").desc()).limit(points)


def dashboard(log: DataFrame) -> DataFrame:
    """One row for a crawl dashboard: pages, failed, blocked, workers, imbalance of the latest state."""
    per = progress(log)
    used = F.when(F.col("pages") > 0, F.col("pages"))
    return per.agg(F.sum("pages").alias("pages"), F.sum("failed").alias("failed"), F.sum(F.col("total") - F.col("pages") - F.col("failed")).alias("blocked"), F.count("*").alias("workers"), F.coalesce(F.round(F.max(used) / F.min(used), 2), F.lit(1.0)).alias("imbalance"))


def push(view, path: str):
    """A sink for ``start``: after every batch the view (a function of all rows so far) is written anew as JSON for whoever polls it.

    Rows so far are a table in path/rows; each batch has a folder of its own, so a batch that is run again replaces itself.
    """

    def sink(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/epoch={epoch}")
        rows = batch.sparkSession.read.schema(batch.schema).parquet(f"{path}/rows")
        view(rows.select(batch.columns)).coalesce(1).write.mode("overwrite").json(f"{path}/view/epoch={epoch}")

    return sink
