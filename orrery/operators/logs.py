"""Analytics over query, click, crawl and metrics logs."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scores as S
from ..functions.text import log_terms


def crawl_stats(log: DataFrame) -> DataFrame:
    ok = F.when(F.col("status") == "ok", F.col("duration_ms"))
    return log.agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("ok", "failed", "blocked")], F.coalesce(F.round(F.avg(ok), 1), F.lit(0.0)).alias("avg_ms"))


def top_queries(log: DataFrame, n: int = 20) -> DataFrame:
    return log.groupBy("query").agg(F.count("*").alias("n"), F.round(F.avg("result_count"), 4).alias("avg_results")).orderBy(F.col("n").desc(), "query").limit(n)


def zero_result_queries(log: DataFrame, n: int = 20) -> DataFrame:
    return log.where("result_count = 0").groupBy("query").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "query").limit(n)


def top_clicked(clicks: DataFrame, docs: DataFrame, n: int = 10) -> DataFrame:
    return clicks.join(docs.select("doc_id", "url"), "doc_id").groupBy("doc_id", "url").agg(F.count("*").alias("clicks")).orderBy(F.col("clicks").desc(), "doc_id").limit(n)


def within(now: str, hours: int) -> Column:
    """Whether a row's timestamp lies in the last hours before now."""
    at = F.lit(now).cast("timestamp")
    return (F.col("timestamp") >= at - F.expr(f"interval {hours} hours")) & (F.col("timestamp") <= at)


def hourly(log: DataFrame, now: str | None = None, hours: int | None = None) -> DataFrame:
    """hour (HH:00), n; with ``now`` only the last ``hours`` before it."""
    rows = log if now is None else log.where(within(now, hours))
    return rows.groupBy(F.date_format("timestamp", "HH:00").alias("hour")).agg(F.count("*").alias("n"))


def map_reduce(df: DataFrame, mapper: Callable, reducer: Callable, schema: str, mapped: str, combiner: Callable | None = None) -> DataFrame:
    """A user's map, shuffle, combine and reduce over any rows.

    mapper(pandas rows) gives pandas rows of schema ``mapped`` with a column key;
    combiner does the same for the rows of a key before reducer, whose result has
    ``schema``.  Where the reduction is a Spark aggregate, groupBy().agg() is the
    better choice; this is for what it cannot say.
    """

    def run(batches):
        for rows in batches:
            yield mapper(rows)

    def reduce(rows: pd.DataFrame) -> pd.DataFrame:
        return reducer(combiner(rows) if combiner else rows)

    return df.mapInPandas(run, mapped).groupBy("key").applyInPandas(reduce, schema)


def term_frequency(log: DataFrame, n: int = 20) -> DataFrame:
    return log.select(F.explode(log_terms(F.col("query"))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "term").limit(n)


def position_bias(clicks: DataFrame) -> DataFrame:
    counted = clicks.groupBy("position").agg(F.count("*").alias("clicks"))
    return counted.withColumn("pct", F.round(F.col("clicks") / F.sum("clicks").over(Window.partitionBy()) * 100, 1))


def query_pairs(log: DataFrame, n: int | None = 10) -> DataFrame:
    """q1 < q2 asked in the same session, and in how many."""
    one = log.select("session_id", F.lower(F.trim("query")).alias("q")).distinct()
    a, b = one.select("session_id", F.col("q").alias("q1")), one.select("session_id", F.col("q").alias("q2"))
    pairs = a.join(b, "session_id").where("q1 < q2").groupBy("q1", "q2").agg(F.count("*").alias("n"))
    return pairs if n is None else pairs.orderBy(F.col("n").desc(), "q1", "q2").limit(n)


def result_gaps(log: DataFrame) -> DataFrame:
    """query, n, avg_results, kind: 'zero' if it never finds anything, 'low' if it was asked often and finds under 3."""
    g = log.groupBy(F.lower("query").alias("query")).agg(F.count("*").alias("n"), F.avg("result_count").alias("a"))
    kind = F.when(F.col("a") == 0, "zero").when((F.col("a") > 0) & (F.col("a") < 3) & (F.col("n") > 1), "low")
    return g.withColumn("kind", kind).where("kind is not null").select("query", "n", F.round("a", 4).alias("avg_results"), "kind")


def hour_volume(log: DataFrame) -> DataFrame:
    return log.groupBy(F.date_format("timestamp", "HH").alias("hour")).agg(F.count("*").alias("n"))


def session_journey(log: DataFrame) -> DataFrame:
    return log.groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", "id", "query"))).alias("s")).select("session_id", F.size("s").alias("n"), F.array_join(F.col("s.query"), " > ").alias("journey"))


def percentiles(rows: DataFrame, by: str, value: str, points: tuple[int, ...], prefix: str = "p", suffix: str = "") -> DataFrame:
    """by, p50, ...: of each key's n values in order the one at max(1, n * p / 100, rounded down), to one place.

    Equal values are counted together before the shuffle and a key's counts run up over its different values, so a key
    that has most rows fills no list.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("c"))
    up = Window.partitionBy(by).orderBy(value)
    ran = counts.select(by, value, F.sum("c").over(up).alias("until"), F.sum("c").over(Window.partitionBy(by)).alias("n"))
    at = lambda p: F.greatest(F.lit(1), F.floor(F.col("n") * p / 100))
    return ran.groupBy(by).agg(*[F.round(F.min(F.when(F.col("until") >= at(p), F.col(value))), 1).alias(f"{prefix}{p}{suffix}") for p in points])


def domain_stats(fetches: DataFrame) -> DataFrame:
    """domain, fetches, errors, blocked, error_rate, p50/p95/p99 and mean of successful times."""
    fetches = fetches.withColumn("domain", F.coalesce("domain", F.lit("unknown")))
    ok = F.when(F.col("status") == "ok", F.col("duration_ms"))
    g = fetches.groupBy("domain").agg(F.count("*").alias("fetches"), F.count_if(F.col("status") == "failed").alias("errors"), F.count_if(F.col("status") == "blocked").alias("blocked"), F.coalesce(F.round(F.avg(ok), 1), F.lit(0.0)).alias("avg_ms"))
    points = percentiles(fetches.where("status = 'ok'"), "domain", "duration_ms", (50, 95, 99), suffix="_ms")
    return g.join(points, "domain", "left").select("domain", "fetches", "errors", "blocked", S.error_rate(F.col("errors"), F.col("fetches")).alias("error_rate"), *[F.coalesce(f"p{p}_ms", F.lit(0.0)).alias(f"p{p}_ms") for p in (50, 95, 99)], "avg_ms")


def newest(log: DataFrame, window: int = 200) -> DataFrame:
    """The last ``window`` rows of each domain."""
    w = Window.partitionBy("domain").orderBy(F.col("timestamp").desc(), F.col("id").desc())
    return log.withColumn("place", F.row_number().over(w)).where(F.col("place") <= window)


def p95_rolling(log: DataFrame, window: int = 200, least: int = 5) -> DataFrame:
    """domain, n, p95: over each domain's last ``window`` times; with too few, over all windows; with too few again, null."""
    last = newest(log, window)
    p95 = F.expr("percentile_disc(0.95) within group (order by duration_ms)")
    own = last.groupBy("domain").agg(F.count("*").alias("n"), p95.alias("own"))
    every = last.agg(F.count("*").alias("total"), p95.alias("every"))
    return own.crossJoin(F.broadcast(every)).select("domain", "n", F.when(F.col("n") >= least, F.col("own")).when(F.col("total") >= least, F.col("every")).alias("p95"))


def stragglers(tasks: DataFrame, p95: DataFrame, now: str, factor: float = 1.5) -> DataFrame:
    """Running tasks (doc_id, domain, start) beyond factor times their domain's p95, by how far: doc_id, domain, overdue_ms."""
    elapsed = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("start")) / 1000
    joined = tasks.join(p95.where("p95 is not null").select("domain", "p95"), "domain")
    return joined.select("doc_id", "domain", F.round(elapsed - factor * F.col("p95"), 3).alias("overdue_ms")).where("overdue_ms > 0")


def imbalance(counts: DataFrame, column: str = "pages") -> DataFrame:
    """Greatest over least of the non-zero counts (2 places); 1 with fewer than two."""
    used = counts.where(F.col(column) > 0)
    return used.agg(F.when(F.count("*") > 1, F.round(F.max(column) / F.min(column), 2)).otherwise(1.0).alias("imbalance"))


def pages_by_worker(log: DataFrame) -> DataFrame:
    return log.groupBy("worker_rank").agg(F.count_if(F.col("status") == "ok").alias("pages"))


def crawl_summary(log: DataFrame) -> DataFrame:
    """One row for the end of a run: pages, failures, rate, and how evenly workers shared them."""
    per = pages_by_worker(log)
    total = log.agg(F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("pages"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_distinct("worker_rank").alias("workers"), ((F.unix_micros(F.max("timestamp")) - F.unix_micros(F.min("timestamp"))) / 1e6).alias("seconds"))
    return total.crossJoin(imbalance(per)).select("total", "pages", "failed", "workers", "imbalance", F.round(F.when(F.col("seconds") > 0, F.col("pages") / F.col("seconds")).otherwise(0.0), 4).alias("pages_per_s"))


def shares(rows: DataFrame, by: str) -> DataFrame:
    """by, n and pct (3 places): each value's share of all rows; the total is a one-row aggregate."""
    n = rows.groupBy(by).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select(by, "n", F.round(F.col("n") * 100 / F.col("total"), 3).alias("pct"))


def speculate(late: DataFrame, done: DataFrame) -> DataFrame:
    """The most overdue straggler (doc_id, domain, overdue_ms) that has no result and no copy yet."""
    return late.join(done.select("doc_id").distinct(), "doc_id", "left_anti").orderBy(F.col("overdue_ms").desc(), "doc_id").limit(1)


def speculation_stats(issued: DataFrame, results: DataFrame) -> DataFrame:
    """issued, won, win_rate (1 place, per cent): copies (doc_id, spec_rank) whose worker gave the first result (doc_id, worker_rank)."""
    hit = issued.join(results.select("doc_id", "worker_rank"), "doc_id", "left")
    won = F.count_if(F.col("spec_rank") == F.col("worker_rank"))
    return hit.agg(F.count("*").alias("issued"), won.alias("won")).withColumn("win_rate", F.when(F.col("issued") > 0, F.round(F.col("won") * 100 / F.col("issued"), 1)).otherwise(0.0))
