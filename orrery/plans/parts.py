"""Registered queries of operators that are parts of larger ones, of sinks, streams and crawl scheduling, each with a plan and SQL of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import urls as U
from ..operators import crawl as C
from ..operators import federated as FD
from ..operators import graph as G
from ..operators import index as I
from ..operators import logs as L
from ..operators import rank as R
from ..operators import sketch as SK
from ..operators import suggest as SG
from ..session import scratch
from ..sources import tables as TB
from ..streaming import live as LV
from . import inputs as N
from .inputs import Inputs
from .registry import CQ, CQROWS, CROWD, DAY, FED, HOST, HYB, MSG, NORM, NOW, P95, SEARCH, TFIDF, VS, WRONG, _click_boost, _hybrid, c, register

# Joins -------------------------------------------------------------------------------------------
LINKED = lambda t: t.links.select(c("src").alias("doc_id"), F.concat(F.lit("u"), c("dst").cast("string")).alias("url"))
register("join_url_resolve", lambda t: LINKED(t).join(t.links.select(F.concat(F.lit("u"), c("src").cast("string")).alias("url"), c("src").alias("dst")).distinct(), "url").groupBy(c("doc_id").alias("src"), "dst").agg(F.count("*").alias("n")), f"WITH {N.LINKS} SELECT src, dst, count(*) AS n FROM links WHERE dst IN (SELECT src FROM links) GROUP BY src, dst")
register("join_pagerank", lambda t: R.bm25_stored(t.asked, t.queries).join(G.pagerank(t.edges, least=None).withColumnRenamed("score", "pr"), "doc_id", "left").select("query_id", "doc_id", F.coalesce("pr", F.lit(0.0)).alias("pr")), f"WITH {N.pagerank()}, {N.bm25()} SELECT query_id, doc_id, coalesce(pr, 0) AS pr FROM hits LEFT JOIN pr USING (doc_id)")


def _sides(t: Inputs) -> DataFrame:
    lexical = R.bm25_stored(t.store, t.queries, top_n=40).select("query_id", "doc_id", "score")
    semantic = R.tfidf_stored(t.store, t.queries, top_n=40).select("query_id", "doc_id", "similarity")
    return lexical.join(semantic, ["query_id", "doc_id"], "full_outer").select("query_id", "doc_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))


FOUND40 = SEARCH.replace(N.QUERIES + ", ", "").replace("rank <= 20", "rank <= 40")
register("join_hybrid", _sides, f"WITH {N.bm25(top=40)}, {TFIDF}, {FOUND40} SELECT query_id, doc_id, coalesce(score, 0) AS score, coalesce(similarity, 0) AS similarity FROM hits FULL JOIN found USING (query_id, doc_id)")
CROWDED = lambda t: LV.crowd_scores(t.click_log, NOW, DAY)
register("join_crowd", lambda t: R.bm25_stored(t.asked, t.queries).select("query_id", "doc_id").join(CROWDED(t).withColumnRenamed("score", "crowd"), "doc_id", "left").select("query_id", "doc_id", F.coalesce("crowd", F.lit(0.0)).alias("crowd")), f"WITH {N.bm25()}, {N.CLOG}, {CROWD} SELECT query_id, doc_id, coalesce(crowd.score, 0) AS crowd FROM hits LEFT JOIN crowd USING (doc_id)")
ASKED = lambda t: t.rows(CQROWS, "query_id long, q string")
FIRST = lambda: F.lower(F.element_at(F.split(F.trim("q"), r"\s+"), 1))
register("join_click_boost", lambda t: t.click_log.select("id", "doc_id", F.lower("query").alias("logged")).join(F.broadcast(ASKED(t).select("query_id", FIRST().alias("word"))), F.col("logged").contains(F.col("word"))).select("query_id", "id", "doc_id"), f"WITH {N.CLOG}, {CQ} SELECT query_id, id, doc_id FROM cq JOIN click_log ON contains(lower(query), lower(string_split_regex(trim(q), '\\s+')[1]))")
MISSPELT = lambda t: t.rows([(w,) for w in WRONG], "word string")
NEAR = f"{N.VOCAB}, w AS (SELECT unnest({WRONG}) AS word), m AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT term FROM vocabulary)), n AS (SELECT word, term, levenshtein(word, term) AS distance, df FROM m JOIN vocabulary ON substr(word, 1, 2) = substr(term, 1, 2) AND abs(length(word) - length(term)) <= 3)"
register("join_spell_cand", lambda t: SG.candidates(t.store.vocabulary.drop("slot"), MISSPELT(t)).select("word", "term", c("distance").cast("long").alias("distance")), f"WITH {NEAR} SELECT word, term, distance FROM n WHERE distance <= 2")
register("win_spell_best", lambda t: SG.candidates(t.store.vocabulary.drop("slot"), MISSPELT(t)).withColumn("place", F.row_number().over(Window.partitionBy("word").orderBy("distance", c("df").desc(), "term"))).where("place <= 3").select("word", "term", "place"), f"WITH {NEAR} SELECT word, term, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, term) AS INTEGER) AS place FROM n WHERE distance <= 2 QUALIFY place <= 3")
register("join_prefix", lambda t: t.store.vocabulary.join(F.broadcast(t.rows([("th",), ("tio",), ("zzz",)], "prefix string")), F.col("term").startswith(F.col("prefix"))).select("prefix", "term", "df"), f"WITH {N.VOCAB} SELECT prefix, term, df FROM vocabulary JOIN (SELECT unnest(['th', 'tio', 'zzz']) AS prefix) ON starts_with(term, prefix)")
RANKED = f"WITH {N.VOCAB}, top AS (SELECT term, df FROM vocabulary ORDER BY df DESC, term LIMIT 2000)"


def _window_pairs(t: Inputs) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(c("df").desc(), "term")
    top = t.store.vocabulary.select("term", "df").orderBy(c("df").desc(), "term").limit(2000)
    placed = t.store.postings.select("term", "doc_id").join(F.broadcast(top), "term").select("doc_id", F.count("*").over(Window.partitionBy("doc_id")).alias("n"), F.row_number().over(w).alias("i"))
    return placed.groupBy("doc_id").agg(F.sum(F.least(F.lit(5), c("n") - c("i"))).alias("pairs"))


register("join_cooc_window", _window_pairs, f"{RANKED}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, term) AS i FROM postings JOIN top USING (term)) SELECT doc_id, CAST(sum(k) AS BIGINT) AS pairs FROM (SELECT a.doc_id, a.i, (SELECT count(*) FROM o b WHERE b.doc_id = a.doc_id AND b.i - a.i BETWEEN 1 AND 5) AS k FROM o a) GROUP BY doc_id")

# Windows -----------------------------------------------------------------------------------------
register("agg_hourly_24h", lambda t: L.hourly(t.query_log, NOW, 24), f"WITH {N.QLOG} SELECT strftime(timestamp, '%H:00') AS hour, count(*) AS n FROM query_log WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND timestamp <= TIMESTAMP '{NOW}' GROUP BY 1")
register("win_norm_max", lambda t: R.bm25_stored(t.asked, t.queries).select("query_id", "doc_id", F.round(R.share_of_max(c("bm25"), "query_id"), 6).alias("share")), f"WITH {N.bm25()} SELECT query_id, doc_id, round(bm25 / max(bm25) OVER (PARTITION BY query_id), 6) AS share FROM hits")
register("win_last200", lambda t: L.newest(t.crawl_log).select("id", "domain", "place"), f"WITH {N.WLOG} SELECT id, domain, CAST(row_number() OVER (PARTITION BY domain ORDER BY timestamp DESC, id DESC) AS INTEGER) AS place FROM crawl_log QUALIFY place <= 200")
register("win_pct_total", lambda t: L.shares(t.crawl_log, "status"), f"WITH {N.WLOG} SELECT status, count(*) AS n, round(count(*) * 100 / sum(count(*)) OVER (), 3) AS pct FROM crawl_log GROUP BY status")
register("win_dedup_first", lambda t: C.first_results(t.click_log.where("position <= 3")).select("id", "doc_id", "timestamp"), f"WITH {N.CLOG} SELECT id, doc_id, timestamp FROM click_log WHERE position <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY timestamp, id) = 1")
register("win_shard_topk", lambda t: FD.shard_search_stored(t.asked, 3, t.queries, top_k=4), f"WITH {FED.replace('rank <= 10', 'rank <= 4')} SELECT * FROM fed")

# Top lists ---------------------------------------------------------------------------------------
register("top_bm25", lambda t: R.bm25_stored(t.asked, t.queries, top_n=5), f"WITH {N.bm25(top=5)} SELECT * FROM hits")
register("top_blend", lambda t: _hybrid(t).where("rank <= 5").select("query_id", "doc_id", "score", "rank"), f"WITH {HYB.replace('rank <= 20)', 'rank <= 5)')} SELECT query_id, doc_id, score, rank FROM hybrid")
register("top_resort_click", lambda t: _click_boost(t).where("rank <= 5").select("query_id", "doc_id", "rank"), f"WITH {N.CLOG}, {CQ}, k AS (SELECT query_id, cl.doc_id, count(*) AS clicks FROM cq JOIN click_log cl ON contains(lower(query), lower(string_split_regex(trim(q), '\\s+')[1])) GROUP BY ALL), s AS (SELECT query_id, doc_id, round(round(n_chars / 1000.0, 3) * (1 + 0.1 * ln(1 + coalesce(clicks, 0))), 3) AS score FROM (SELECT * FROM documents, cq) LEFT JOIN k USING (query_id, doc_id)) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 5")
register("top_resort_crowd", lambda t: R.boost_crowd(R.bm25_stored(t.asked, t.queries, top_n=10).drop("bm25"), CROWDED(t), weight=0.5, top_n=5), f"WITH {N.bm25(top=10)}, {N.CLOG}, {CROWD}, j AS (SELECT query_id, hits.doc_id, round(coalesce(crowd.score, 0), 3) AS crowd, round(hits.score + 0.5 * round(coalesce(crowd.score, 0), 3), 3) AS score FROM hits LEFT JOIN crowd ON crowd.doc_id = hits.doc_id) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM j QUALIFY rank <= 5")
SIX = FED.replace("/ 3)", "/ 6)")
register("top_shard_heap", lambda t: FD.shard_search_stored(t.asked, 6, t.queries, top_k=1).select("query_id", "shard_id", "doc_id", "score"), f"WITH {SIX} SELECT query_id, shard_id, doc_id, score FROM fed WHERE rank = 1")
register("top_merge", lambda t: FD.merge_shards(FD.shard_search_stored(t.asked, 3, t.queries, top_k=4), top_n=6), f"WITH {FED.replace('rank <= 10', 'rank <= 4')} SELECT query_id, shard_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 6")
register("fd_server", lambda t: FD.merge_shards(FD.shard_search_stored(t.asked, 6, t.queries)), f"WITH {SIX} SELECT query_id, shard_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20")
register("top_argsort", lambda t: R.tfidf_stored(t.store, t.queries, top_n=5).select("query_id", "doc_id", "rank"), f"WITH {TFIDF}, {SEARCH.replace('rank <= 20', 'rank <= 5')} SELECT query_id, doc_id, rank FROM found")
register("top_faiss", lambda t: R.vector_search(t.read("embeddings"), t.read("embeddings").where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("q_vector")), top_n=5), f"WITH {VS} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 5")
register("top_prefix", lambda t: SG.complete(t.store.vocabulary.drop("slot"), t.rows([("in",), ("ti",)], "prefix string"), n=3), f"WITH {N.VOCAB}, p AS (SELECT unnest(['in', 'ti']) AS prefix) SELECT prefix, term, df, CAST(row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS INTEGER) AS rank FROM vocabulary JOIN p ON starts_with(term, prefix) QUALIFY rank <= 3")
register("top_trending_docs", lambda t: R.with_meta(LV.trending_documents(CROWDED(t), 8), t.page_docs).select("doc_id", "score", "title"), f"WITH {N.CLOG}, {N.PDOCS}, {CROWD}, b AS (SELECT * FROM crowd ORDER BY score DESC, doc_id LIMIT 8) SELECT doc_id, score, coalesce(title, 'No title') AS title FROM b LEFT JOIN page_docs USING (doc_id)")
register("lim_feed", lambda t: LV.feed(t.query_log, t.click_log, 10).select("kind", "id"), f"WITH {N.QLOG}, {N.CLOG} SELECT kind, id FROM (SELECT 'query' AS kind, id, timestamp FROM query_log UNION ALL SELECT 'click', id, timestamp FROM click_log) ORDER BY timestamp DESC, id DESC LIMIT 10")
register("lim_docs_mapper", lambda t: C.mapper_share(t.documents, 6, 50), "SELECT doc_id, doc_id % 6 AS mapper FROM documents QUALIFY row_number() OVER (PARTITION BY doc_id % 6 ORDER BY doc_id) <= 50")
register("lim_links50", lambda t: C.first_links(t.edges.groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("dsts")), 3), f"WITH {N.EDGES} SELECT src, dst FROM edges QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 3")
register("ord_sql", lambda t: t.click_log.groupBy("doc_id").agg(F.count("*").alias("clicks")).orderBy(c("clicks").desc(), "doc_id"), f"WITH {N.CLOG} SELECT doc_id, count(*) AS clicks FROM click_log GROUP BY doc_id ORDER BY clicks DESC, doc_id")

# Sets --------------------------------------------------------------------------------------------
register("set_dedup_links", lambda t: t.links.dropDuplicates(["src", "dst"]), f"WITH {N.LINKS} SELECT DISTINCT src, dst FROM links")
register("set_diff_visited", lambda t: t.pages.select(U.normalise(c("url")).alias("url")).distinct().exceptAll(t.pages.where("page_id % 3 = 0").select(U.normalise(c("url")).alias("url")).distinct()), f"WITH v AS (SELECT page_id, {NORM} AS url FROM pages) SELECT DISTINCT url FROM v EXCEPT SELECT url FROM v WHERE page_id % 3 = 0")
BITS = lambda t: t.crawl_log.select(c("worker_rank").alias("filter_id"), (c("doc_id") % 97).alias("pos")).where("pos % 6 <> filter_id - 1").distinct()
BSQL = f"{N.WLOG}, b AS (SELECT DISTINCT worker_rank AS f, doc_id % 97 AS pos FROM crawl_log WHERE doc_id % 97 % 6 <> worker_rank - 1)"
register("set_or_filter", lambda t: SK.merge_filters(*[BITS(t).where(c("filter_id") == k) for k in (1, 2, 3)]), f"WITH {BSQL} SELECT DISTINCT pos FROM b WHERE f IN (1, 2, 3)")
register("set_and_filter", lambda t: SK.common_bits(BITS(t)), f"WITH {BSQL} SELECT x.f AS a, y.f AS b, count(*) AS n FROM b x JOIN b y ON x.pos = y.pos AND x.f < y.f GROUP BY 1, 2")

# Graph, gossip, experiments ------------------------------------------------------------------------
register("gr_viz_subgraph", lambda t: G.nodes_to_draw(G.pagerank(t.edges, least=None), t.edges), f"WITH {N.pagerank()}, b AS (SELECT doc_id, pr FROM pr ORDER BY pr DESC, doc_id LIMIT 300) SELECT doc_id, round(8 + pr / (SELECT max(pr) FROM b) * 50, 3) AS size, CASE doc_id % 3 WHEN 0 THEN 'blue' WHEN 1 THEN 'green' ELSE 'grey' END AS colour, (SELECT count(*) FROM edges WHERE src = doc_id AND dst IN (SELECT doc_id FROM b)) AS drawn_links FROM b")
GOSSIP = f"{BSQL}, r0 AS (SELECT f - 1 AS node, pos FROM b), " + ", ".join(f"r{r} AS MATERIALIZED (SELECT node, pos FROM r{r - 1} UNION SELECT (node + {1 << (r - 1)}) % 6, pos FROM r{r - 1})" for r in (1, 2, 3)) + ", n AS (" + " UNION ALL ".join(f"SELECT {r}::BIGINT AS round, node, count(*) AS n_bits FROM r{r} GROUP BY node" for r in range(4)) + ")"
register("pb_gossip", lambda t: SK.gossip(BITS(t).select((c("filter_id") - 1).alias("node"), "pos"), 6, 3), f"WITH {GOSSIP} SELECT *, n_bits - coalesce(lag(n_bits) OVER (PARTITION BY node ORDER BY round), 0) AS new_bits FROM n")
_M, _K = SK.bloom_size(1000, 0.01)
_HEX = lambda h, n: f"list_reduce(list_transform(range(0, {n // 4}), lambda i: ('0x' || substr({h}, 1 + 4 * i, 4))::BIGINT), lambda acc, x: (acc * 65536 + x) % {_M}, 0::BIGINT)"
FALSE = f"k AS (SELECT item, fresh, list_transform(range(0, {_K}), lambda i: (a + i * b) % {_M}) AS ps FROM (SELECT item, fresh, {_HEX('sha256(item)', 64)} AS a, {_HEX('md5(item)', 32)} AS b FROM (SELECT 'https://seen.example/' || i AS item, false AS fresh FROM range(1000) r(i) UNION ALL SELECT 'https://fresh.example/' || i, true FROM range(2000) r(i)))), f AS (SELECT DISTINCT unnest(ps) AS pos FROM k WHERE NOT fresh), z AS (SELECT list(pos) AS bits FROM f), u AS (SELECT item, unnest(ps) AS pos FROM k WHERE fresh), h AS (SELECT item, bool_and(pos IN (SELECT pos FROM f)) AS hit FROM u GROUP BY item)"
ITEMS = lambda t, what, n: t.spark.range(n).select(F.concat(F.lit(f"https://{what}.example/"), c("id").cast("string")).alias("item"))
register("exp_bloom_fp", lambda t: SK.false_positives(ITEMS(t, "seen", 1000), ITEMS(t, "fresh", 2000), "item", _M, _K), f"WITH {FALSE} SELECT count(*) AS tested, count(*) FILTER (hit) AS found, round(count(*) FILTER (hit) / count(*), 6) AS rate FROM h")


def _sweep(t: Inputs) -> DataFrame:
    out = None
    for n in (1, 2, 3, 6):
        size, _ = FD.shard_of(t.store.lengths, n)
        per = t.store.postings.select("term", "doc_id").crossJoin(F.broadcast(size)).select("term", F.floor(c("doc_id") / c("size")).alias("s")).distinct()
        row = per.groupBy("s").agg(F.count("*").alias("n")).agg(F.lit(n).cast("long").alias("shards"), F.round(F.sum("n") / F.lit(n), 3).alias("terms_per_shard"))
        out = row if out is None else out.unionByName(row)
    return out


register("exp_federated", _sweep, f"WITH {N.POST}, m AS (SELECT max(doc_id) + 1 AS m FROM postings), p AS (SELECT n, count(*) AS k FROM (SELECT DISTINCT n, term, doc_id // ceil(m / n)::BIGINT AS s FROM postings, m, (SELECT unnest([1, 2, 3, 6]) AS n)) GROUP BY n) SELECT n::BIGINT AS shards, round(k / n, 3) AS terms_per_shard FROM p")

# Live signals --------------------------------------------------------------------------------------
register("st_crowd_boost", lambda t: t.documents.select("doc_id").join(CROWDED(t), "doc_id", "left").select("doc_id", F.round(F.coalesce("score", F.lit(0.0)), 3).alias("boost")), f"WITH {N.CLOG}, {CROWD} SELECT doc_id, round(coalesce(score, 0), 3) AS boost FROM documents LEFT JOIN crowd USING (doc_id)")
HOUR = CROWD.replace(str(DAY), "14400.0").replace("crowd AS", "kept AS")
register("st_evict", lambda t: t.click_log.select("doc_id").distinct().join(LV.crowd_scores(t.click_log, NOW, 14400.0), "doc_id", "left_anti"), f"WITH {N.CLOG}, {HOUR} SELECT DISTINCT doc_id FROM click_log WHERE doc_id NOT IN (SELECT doc_id FROM kept)")
register("st_p95_state", lambda t: L.p95_rolling(t.crawl_log, 50), f"WITH {N.WLOG}, {P95.replace('<= 200', '<= 50')} SELECT domain, n, p95 FROM p95")
ACT = f"WITH {N.QLOG}, {N.CLOG}, {CROWD}, a AS (SELECT count(DISTINCT session_id) AS n FROM query_log WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND timestamp <= TIMESTAMP '{NOW}'), fd AS (SELECT *, row_number() OVER (ORDER BY timestamp DESC, id DESC) AS place FROM (SELECT 'query' AS kind, id, query AS what, timestamp FROM query_log UNION ALL SELECT 'click', id, doc_id::VARCHAR, timestamp FROM click_log) QUALIFY place <= 10)"
register("st_collab_stream", lambda t: LV.activity(t.query_log, t.click_log, NOW, DAY, 3600), f"{ACT} SELECT 'stats' AS section, 1 AS place, 'total_queries' AS what, count(*)::VARCHAR AS value FROM query_log UNION ALL SELECT 'stats', 2, 'unique_queries', count(DISTINCT lower(query))::VARCHAR FROM query_log UNION ALL SELECT 'stats', 3, 'active_users', n::VARCHAR FROM a UNION ALL (SELECT 'trending', row_number() OVER (ORDER BY score DESC, doc_id), doc_id::VARCHAR, printf('%.6f', score) FROM crowd ORDER BY score DESC, doc_id LIMIT 5) UNION ALL SELECT 'feed', place, kind || ' ' || id, what FROM fd")
register("st_tp_history", lambda t: LV.throughput(t.crawl_log), f"WITH {N.WLOG}, p AS (SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS start, count(*) AS n FROM crawl_log WHERE status = 'ok' GROUP BY 1) SELECT start, CAST(sum(n) OVER (ORDER BY start) AS BIGINT) AS pages FROM p ORDER BY start DESC LIMIT 80")


def _dashboard(t: Inputs) -> DataFrame:
    """What a stream of crawl events has pushed when all of them are through."""
    events, out = scratch(t.spark, "crawl-events"), scratch(t.spark, "dashboard")
    t.crawl_log.write.parquet(events)
    stream = t.spark.readStream.schema(t.crawl_log.schema).parquet(events)
    LV.start(stream, LV.push(LV.dashboard, out), f"{out}/checkpoint", "append").awaitTermination()
    return t.spark.read.schema("pages long, failed long, blocked long, workers long, imbalance double").json(f"{out}/view").select("pages", "failed", "blocked", "workers", "imbalance").orderBy(F.col("pages").desc()).limit(1)


register("st_sse_dashboard", _dashboard, f"WITH {N.WLOG}, p AS (SELECT worker_rank, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'blocked') AS blocked FROM crawl_log GROUP BY 1) SELECT CAST(sum(ok) AS BIGINT) AS pages, CAST(sum(failed) AS BIGINT) AS failed, CAST(sum(blocked) AS BIGINT) AS blocked, count(*) AS workers, round(max(ok) / min(ok), 2) AS imbalance FROM p")

# Sources and sinks ---------------------------------------------------------------------------------
RULES = lambda: F.when(F.col("url").contains("example.net"), "User-agent: *\nCrawl-delay: 3\nDisallow: /en\n").when(F.col("url").contains("example.org"), "User-agent: *\nDisallow:\n").otherwise("User-agent: other\nCrawl-delay: 9\n")
register("src_robots", lambda t: TB.robots(t.pages.select(U.netloc(c("url")).alias("domain"), RULES().alias("rules"))).select("domain", "delay", "free"), f"SELECT DISTINCT {HOST} AS domain, CASE WHEN {HOST} LIKE '%example.net%' THEN 3.0 ELSE 0.5 END::DOUBLE AS delay, false AS free FROM pages")


def _resumed(t: Inputs) -> DataFrame:
    """A crawl that starts from a snapshot, or from its seeds where there is none."""
    path = scratch(t.spark, "snapshot")
    seeds = t.pages.where("page_id < 3").select("url", F.lit(0).cast("long").alias("depth"))
    front, done = TB.load_snapshot(t.spark, path) or (seeds, seeds.select("url").limit(0))
    TB.save_snapshot(front.unionByName(t.pages.where("page_id % 4 = 1").select("url", (c("page_id") % 3).alias("depth"))), t.pages.where("page_id % 4 = 2").select("url"), path)
    front, done = TB.load_snapshot(t.spark, path)
    return front.withColumn("state", F.lit("queued")).unionByName(done.select("url", F.lit(None).cast("long").alias("depth"), F.lit("visited").alias("state")))


register("src_checkpoint", _resumed, "SELECT url, 0 AS depth, 'queued' AS state FROM pages WHERE page_id < 3 UNION ALL SELECT url, page_id % 3, 'queued' FROM pages WHERE page_id % 4 = 1 UNION ALL SELECT url, NULL, 'visited' FROM pages WHERE page_id % 4 = 2")


def _index_json(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "index-json")
    TB.write_index_json(I.lists(t.postings, span=1 << 16), path)
    return TB.index_json(t.spark, path)


register("snk_index_json", _index_json, f"WITH {N.POST} SELECT term, doc_id, tf FROM postings")


def _page_db(t: Inputs) -> DataFrame:
    pages, out = scratch(t.spark, "pages"), scratch(t.spark, "page-db")
    t.page_docs.select("doc_id", "url", "title").write.parquet(pages)
    LV.start(t.spark.readStream.schema("doc_id long, url string, title string").parquet(pages), TB.page_sinks(out), f"{out}/checkpoint", "append").awaitTermination()
    docs, log = t.spark.read.schema("doc_id long, url string, title string").parquet(f"{out}/documents"), t.spark.read.schema("url string, doc_id long, status string").parquet(f"{out}/crawl_log")
    return docs.select("doc_id", "url", "title").join(log.select("doc_id", "status"), "doc_id")


register("snk_page_db", _page_db, f"WITH {N.PDOCS} SELECT doc_id, url, title, 'ok' AS status FROM page_docs")


def _metric_events(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "metric-events")
    TB.write_metrics(t.crawl_log, t.crawl_log.where("status = 'blocked'").select("timestamp", "depth", c("worker_rank").alias("active_workers")), path)
    fetched = TB.metrics(t.spark, path).select(F.lit("fetch").alias("type"), "domain", "status", F.round("duration_ms", 1).alias("ms"), F.lit(None).cast("long").alias("depth"))
    return fetched.unionByName(TB.queue_metrics(t.spark, path).select(F.lit("queue").alias("type"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("double").alias("ms"), "depth"))


register("snk_metric_event", _metric_events, f"WITH {N.WLOG} SELECT 'fetch' AS type, domain, status, round(duration_ms, 1) AS ms, NULL::BIGINT AS depth FROM crawl_log UNION ALL SELECT 'queue', NULL, NULL, NULL, depth FROM crawl_log WHERE status = 'blocked'")


def _log_lines(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "log-lines")
    TB.write_log(t.crawl_log.select("timestamp", F.lit("INFO").alias("level"), F.lit("worker").alias("logger"), F.when(c("status") == "blocked", "no url here").otherwise(MSG()).alias("message")), path)
    return TB.logs(t.spark, path).select("iso", "level", "worker_rank", "url")


register("snk_structured_log", _log_lines, f"WITH {N.WLOG} SELECT strftime(timestamp, '%Y-%m-%dT%H:%M:%S') AS iso, 'INFO' AS level, CASE WHEN status <> 'blocked' THEN worker_rank::INTEGER END AS worker_rank, CASE WHEN status <> 'blocked' THEN 'https://' || domain || '/p' END AS url FROM crawl_log")


def _migrated(t: Inputs) -> DataFrame:
    source, target = scratch(t.spark, "migrate-json"), scratch(t.spark, "migrate-table")
    t.parsed.write.json(source)
    n = TB.migrate(t.spark, source, target, whole_files=False, with_id=False)
    return t.spark.read.schema(TB.PAGE_JSON).parquet(target).select("doc_id", "url", "title", F.lit(n).cast("long").alias("migrated"))


register("snk_migrate", _migrated, f"WITH {N.PDOCS} SELECT doc_id, url, title, (SELECT count(*) FROM pages) AS migrated FROM page_docs")
register("sc_utc_now", lambda t: t.documents.select("doc_id", T.utc_now().rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{6}$").alias("iso")), "SELECT doc_id, true AS iso FROM documents")
register("sc_session_id", lambda t: t.documents.select("doc_id", T.session_id().rlike("^[0-9a-f]{8}$").alias("hex")), "SELECT doc_id, true AS hex FROM documents")

# Crawl scheduling ----------------------------------------------------------------------------------
QUEUE = lambda t: t.crawl_log.where("status = 'ok' and worker_rank not in (2, 5)").select("id", "domain", "worker_rank")
register("cr_work_steal", lambda t: C.steal_plan(QUEUE(t), t.crawl_log.select("worker_rank")), f"WITH {N.WLOG}, d AS (SELECT worker_rank, domain, count(*) AS n FROM crawl_log WHERE status = 'ok' AND worker_rank NOT IN (2, 5) GROUP BY ALL), v AS (SELECT worker_rank, sum(n) AS depth FROM d GROUP BY 1 HAVING sum(n) > 15 ORDER BY depth DESC, worker_rank DESC LIMIT 1), l AS (SELECT d.* FROM d JOIN v USING (worker_rank) ORDER BY n DESC, domain DESC LIMIT 1) SELECT DISTINCT c.worker_rank, l.worker_rank AS victim, l.domain, l.n < 7 AS whole FROM crawl_log c, l WHERE c.worker_rank IN (2, 5)")


def _rehomed(t: Inputs) -> DataFrame:
    owners = t.pages.groupBy(U.netloc(c("url")).alias("domain")).agg(F.min("url").alias("url"), (F.min("page_id") % 3 + 1).alias("owner"))
    return C.rehome(owners, SK.ring(t.spark, [1, 2, 3]), 2)


register("cr_rehome", _rehomed, f"""WITH ring AS (SELECT md5(n || '-vnode-' || v) AS pos, n::BIGINT AS node FROM range(1, 4) a(n), range(150) b(v)), o AS (SELECT {HOST} AS domain, min(url) AS url, min(page_id) % 3 + 1 AS owner FROM pages GROUP BY 1), k AS (SELECT domain, md5(url) AS h FROM o WHERE owner = 2)
  SELECT domain, owner FROM o WHERE owner <> 2 UNION ALL SELECT domain, CASE WHEN to_node = 2 THEN 1 ELSE to_node END FROM (SELECT domain, coalesce(r.node, (SELECT node FROM ring ORDER BY pos LIMIT 1)) AS to_node FROM k ASOF LEFT JOIN ring r ON k.h <= r.pos)""")
LATE = f"{P95}, late AS (SELECT doc_id, domain, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 1000 - 1.5 * p95, 3) AS overdue_ms FROM crawl_log JOIN p95 USING (domain) WHERE status = 'blocked' AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 1000 - 1.5 * p95 > 0)"
register("cr_speculate", lambda t: L.speculate(L.stragglers(t.crawl_log.where("status = 'blocked'").select("doc_id", "domain", c("timestamp").alias("start")), L.p95_rolling(t.crawl_log), NOW), t.crawl_log.where("status = 'failed'").select("doc_id")), f"WITH {N.WLOG}, {LATE} SELECT * FROM late WHERE doc_id NOT IN (SELECT doc_id FROM crawl_log WHERE status = 'failed') ORDER BY overdue_ms DESC, doc_id LIMIT 1")
register("cr_speculation_stats", lambda t: L.speculation_stats(t.crawl_log.where("status = 'failed'").groupBy("doc_id").agg(F.min("worker_rank").alias("spec_rank")), C.first_results(t.crawl_log.where("status = 'ok'"))), f"WITH {N.WLOG}, i AS (SELECT doc_id, min(worker_rank) AS spec_rank FROM crawl_log WHERE status = 'failed' GROUP BY 1), r AS (SELECT doc_id, worker_rank FROM crawl_log WHERE status = 'ok' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY timestamp, id) = 1) SELECT count(*) AS issued, count(*) FILTER (spec_rank = worker_rank) AS won, round(count(*) FILTER (spec_rank = worker_rank) * 100 / count(*), 1) AS win_rate FROM i LEFT JOIN r USING (doc_id)")
register("cr_queue_io", lambda t: C.frontier_stats(t.pages.select("url", (c("page_id") % 4).alias("depth"))), f"SELECT count(*) AS size, count(DISTINCT {HOST}) AS domains, min(page_id % 4) AS least_depth, count(*) = 0 AS empty FROM pages")
