"""Crawl control as data operators: frontier, admission, pacing, liveness."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import urls as U
from ..session import fresh, written


def admit(links: DataFrame, visited: DataFrame, domains: list[str] | None, depth_below: int = 4, budget: int | None = None) -> DataFrame:
    """url, depth of the links to crawl next: normalised, allowed, not visited, each once at its least depth.

    links(url, depth): depth of the page a link is on.
    """
    c = links.where(F.col("depth") < depth_below).select(U.normalise(F.col("url")).alias("url"), (F.col("depth") + 1).alias("depth"))
    if domains is not None:
        c = c.where(U.in_domains(F.col("url"), domains))
    new = c.groupBy("url").agg(F.min("depth").alias("depth")).join(visited.select("url").distinct(), "url", "left_anti")
    return new if budget is None else new.orderBy("depth", "url").limit(budget)


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_pages: int | None = None) -> DataFrame:
    """node, depth: breadth-first levels from the seeds, one join and one anti-join a level."""
    seen = written(seeds.select("node", F.lit(0).alias("depth")).distinct(), "level")
    front = seen
    for d in range(1, max_depth + 1):
        level = front.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = written(level.select("node", F.lit(d).alias("depth")), "level")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen if max_pages is None else seen.orderBy("depth", "node").limit(max_pages)


def first_results(results: DataFrame) -> DataFrame:
    """The first result of every document, by time and id; later ones are duplicates."""
    w, place = Window.partitionBy("doc_id").orderBy("timestamp", "id"), fresh(results, "place")
    return results.withColumn(place, F.row_number().over(w)).where(F.col(place) == 1).drop(place)


def accepted(results: DataFrame) -> DataFrame:
    return results.where(~F.col("title").isin("Failed", "Blocked"))


def silent(beats: DataFrame, key: str = "worker_rank", seconds: float = 15.0) -> DataFrame:
    """Gaps of over ``seconds`` between a worker's signs of life: key, died_at, gap_s (3 places)."""
    w = Window.partitionBy(key).orderBy("timestamp", "id")
    gap = (F.unix_micros(F.lead("timestamp").over(w)) - F.unix_micros("timestamp")) / 1e6
    return beats.select(key, F.col("timestamp").alias("died_at"), F.round(gap, 3).alias("gap_s")).where(F.col("gap_s") > seconds)


def token_bucket(requests: DataFrame, key: str, rate: float = 1.5, capacity: float = 5.0) -> DataFrame:
    """id, key, granted, wait_s for requests(id, key, timestamp): a bucket per key, refilled at ``rate`` a second.

    The balance after a request depends on every one before it, so a key's
    requests are replayed in order by one Python group.
    """

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["timestamp", "id"])
        tokens, last, granted, waits = capacity, None, [], []
        for t in rows["timestamp"].astype("int64") / 1e9 if str(rows["timestamp"].dtype).endswith("[ns]") else rows["timestamp"].astype("datetime64[ns]").astype("int64") / 1e9:
            tokens = min(capacity, tokens + (t - last) * rate) if last is not None else tokens
            last = t
            ok = tokens >= 1.0
            granted.append(ok)
            waits.append(0.0 if ok else round((1.0 - tokens) / rate, 3))
            tokens -= 1.0 if ok else 0.0
        return pd.DataFrame({"id": rows["id"], "key": rows["key"].astype(str), "granted": granted, "wait_s": waits})

    return requests.select("id", F.col(key).cast("string").alias("key"), "timestamp").groupBy("key").applyInPandas(replay, "id long, key string, granted boolean, wait_s double")


def polite_times(requests: DataFrame, delay: float = 0.5) -> DataFrame:
    """id, domain, earliest: when each request may go if a domain's requests are ``delay`` seconds apart.

    The running maximum of (time - delay * order), shifted back, is the queue's time.
    """
    w = Window.partitionBy("domain").orderBy("timestamp", "id")
    k = (F.row_number().over(w) - 1).cast("long")
    t = F.unix_micros("timestamp")
    step = int(delay * 1_000_000)
    rows = requests.select("id", "domain", "timestamp", (t - k * step).alias("ready"), (k * step).alias("wait"))
    return rows.select("id", "domain", F.timestamp_micros(F.max("ready").over(w) + F.col("wait")).alias("earliest"))


def steal_plan(queue: DataFrame, workers: DataFrame, over: int = 15, whole_below: int = 7) -> DataFrame:
    """worker_rank, victim, domain, whole: what each idle worker steals.

    queue(url, domain, worker_rank), workers(worker_rank).  Idle is who has nothing queued; the victim is the most
    loaded worker with more than ``over`` URLs, the domain its longest; a queue of fewer than ``whole_below`` changes
    hands as a whole.
    """
    by_domain = queue.groupBy("worker_rank", "domain").agg(F.count("*").alias("n"))
    depth = by_domain.groupBy("worker_rank").agg(F.sum("n").alias("depth"), F.max(F.struct("n", "domain")).alias("longest"))
    victim = depth.where(F.col("depth") > over).agg(F.max(F.struct("depth", "worker_rank", "longest")).alias("v")).where("v is not null")
    idle = workers.select("worker_rank").distinct().join(depth.select("worker_rank"), "worker_rank", "left_anti")
    return idle.crossJoin(F.broadcast(victim)).select("worker_rank", F.col("v.worker_rank").alias("victim"), F.col("v.longest.domain").alias("domain"), (F.col("v.longest.n") < whole_below).alias("whole"))


def rehome(owners: DataFrame, places: DataFrame, dead: int) -> DataFrame:
    """domain, owner: domains (domain, url, owner) after a worker's death.

    Its domains go where the ring sends one of their URLs, or to the first worker alive if that is the dead one again.
    """
    from .sketch import route

    orphans = owners.where(F.col("owner") == dead).select("domain", "url")
    first = places.where(F.col("node") != dead).agg(F.min("node").alias("first"))
    moved = route(orphans, "url", places, "to").crossJoin(F.broadcast(first)).select("domain", F.when(F.col("to") == dead, F.col("first")).otherwise(F.col("to")).alias("owner"))
    return owners.where(F.col("owner") != dead).select("domain", "owner").unionByName(moved)


def frontier_stats(frontier: DataFrame) -> DataFrame:
    """size, domains, least_depth, empty of a frontier (url, depth)."""
    g = frontier.agg(F.count("*").alias("size"), F.count_distinct(U.netloc(F.col("url"))).alias("domains"), F.min("depth").alias("least_depth"))
    return g.withColumn("empty", F.col("size") == 0)


def first_links(links: DataFrame, most: int = 50) -> DataFrame:
    """src, dst of the first ``most`` links of each page (src, dsts): an option, off by default."""
    return links.select("src", F.explode(F.slice("dsts", 1, most)).alias("dst"))


def mapper_share(docs: DataFrame, mappers: int = 6, most: int = 500) -> DataFrame:
    """doc_id, mapper: at most the first ``most`` documents of each mapper, which take turns in order of doc_id; an option, off by default."""
    w = Window.partitionBy("mapper").orderBy("doc_id")
    return docs.select("doc_id", F.pmod("doc_id", F.lit(mappers)).alias("mapper")).withColumn("place", F.row_number().over(w)).where(F.col("place") <= most).select("doc_id", "mapper")
