"""All registered queries of the search and analytics operators, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
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
from ..sources import tables as TB
from ..session import scratch, written
from ..streaming import live as LV
from . import inputs as N
from .inputs import Inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, plan: Callable[[Inputs], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(Inputs(spark, sf_dir))
    if sql:
        ORACLES[name] = sql


NOW = "2024-01-31 12:00:00"
DAY = 86400.0
c = F.col

# Sources -----------------------------------------------------------------------------------------
register("src_doc_by_id", lambda t: TB.document(t.documents, 7), "SELECT * FROM documents WHERE doc_id = 7")
register("src_all_docs", lambda t: t.documents.orderBy("doc_id"), "SELECT * FROM documents ORDER BY doc_id")
register("src_doc_ids", lambda t: t.documents.select("doc_id").orderBy("doc_id"), "SELECT doc_id FROM documents ORDER BY doc_id")
register("src_url_map", lambda t: TB.url_map(t.page_docs), f"WITH {N.PDOCS} SELECT doc_id, url, title, coalesce(snippet, '') AS snippet FROM page_docs")
register("src_crawled_urls", lambda t: t.pages.select("url").distinct(), "SELECT DISTINCT url FROM pages")
register("src_logs", lambda t: t.query_log.orderBy("timestamp", "id"), f"WITH {N.QLOG} SELECT * FROM query_log ORDER BY timestamp, id")


def _json_pages(t: Inputs, whole: bool) -> DataFrame:
    """Pages as JSON and back: whether text, snippet and links came back as they went."""
    path = scratch(t.spark, "pages")
    docs = t.parsed
    TB.write_pages(docs, path)
    mark = F.xxhash64("text", "snippet", "links")
    back = TB.json_pages(t.spark, path, whole_files=False)
    if not whole:
        return back.select("doc_id", "url", "title", (F.length("text") > 0).alias("has_text"))
    return back.select("doc_id", "url", mark.alias("b")).join(docs.select("doc_id", mark.alias("a")), "doc_id").select("doc_id", "url", (c("a") == c("b")).alias("same"))


register("src_json_pages", lambda t: _json_pages(t, False), f"WITH {N.PDOCS} SELECT doc_id, url, title, true AS has_text FROM page_docs")
register("snk_page_json", lambda t: _json_pages(t, True), "SELECT page_id AS doc_id, url, true AS same FROM pages")


def _index_round(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "index")
    TB.write_index(t.postings, path)
    return TB.index(t.spark, path)


register("src_inverted_index", _index_round, f"WITH {N.POST} SELECT term, doc_id, tf FROM postings")


def _metrics_round(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "metrics")
    kind = F.when(c("status") == "blocked", "queue").otherwise("fetch")
    t.crawl_log.select(kind.alias("type"), "domain", F.round("duration_ms", 1).alias("duration_ms"), "status", c("depth").cast("long").alias("depth"), (F.unix_micros("timestamp") / 1e6).alias("ts")).write.json(path)
    return TB.metrics(t.spark, path).groupBy("domain", "status").agg(F.count("*").alias("n"), F.round(F.sum("duration_ms"), 1).alias("ms"))


register("src_metrics_jsonl", _metrics_round, f"WITH {N.WLOG} SELECT domain, status, count(*) AS n, round(sum(round(duration_ms, 1)), 1) AS ms FROM crawl_log WHERE status <> 'blocked' GROUP BY ALL")
VECTORS = "SELECT vec_id, label, i AS dim, round(embedding[i]::DOUBLE, 6) AS x FROM embeddings, range(1, 65) r(i)"
register("src_vectors", lambda t: TB.components(t.read("embeddings")), VECTORS)

# Sinks as transformations ------------------------------------------------------------------------
register(
    "snk_document",
    lambda t: TB.upsert_documents(
        t.pages.select(c("page_id").alias("doc_id"), "url", F.lit("old").alias("state"), F.lit(NOW).cast("timestamp").alias("crawled_at")),
        t.pages.select((c("page_id") + 1_000_000).alias("doc_id"), F.regexp_replace("url", r"[?#].*$", "").alias("url"), F.lit("new").alias("state"), F.lit(NOW).cast("timestamp").alias("crawled_at")),
    ).select("doc_id", "url", "state", "domain"),
    """WITH a AS (SELECT page_id AS doc_id, url, 'old' AS state, 0 AS n FROM pages UNION ALL SELECT page_id + 1000000, regexp_replace(url, '[?#].*$', ''), 'new', 1 FROM pages),
       b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY n DESC, doc_id DESC) = 1)
       SELECT doc_id, url, state, regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1) AS domain FROM b""",
)
register(
    "snk_index_meta",
    lambda t: TB.mark_indexed(t.documents.select("doc_id", F.lit(0).cast("long").alias("term_count")), t.lengths.select("doc_id", c("dl").alias("term_count"))),
    f"SELECT doc_id, len({N.toks('text')}) AS term_count FROM documents",
)
register(
    "snk_pagerank",
    lambda t: TB.update_ranks(t.read("part").select(c("p_partkey").alias("doc_id"), F.lit(0.0).alias("pagerank")), G.pagerank(t.edges, least=None)),
    f"WITH {N.pagerank()} SELECT p_partkey AS doc_id, coalesce(pr, 0) AS pagerank FROM part LEFT JOIN pr ON doc_id = p_partkey",
)

# Scalars -----------------------------------------------------------------------------------------
register("sc_tokenise", lambda t: t.documents.select("doc_id", F.explode(T.tokens(c("text"))).alias("token")), f"SELECT doc_id, unnest({N.toks('text')}) AS token FROM documents")
register("sc_doc_text", lambda t: t.documents.select("doc_id", T.doc_text(c("source"), c("text")).alias("doc")), "SELECT doc_id, coalesce(source, '') || ' ' || coalesce(text, '') AS doc FROM documents")
CONV = "conversations"
register("sc_query_terms", lambda t: t.read(CONV).select("conv_id", "turn", F.explode(T.query_terms(c("text"))).alias("term")), f"SELECT conv_id, turn, unnest({N.qterms('text')}) AS term FROM conversations")
register("sc_log_terms", lambda t: t.read(CONV).select("conv_id", "turn", F.explode(T.log_terms(c("text"))).alias("term")), f"SELECT conv_id, turn, unnest(list_filter({N.qterms('text')}, lambda t: NOT list_contains({N.LOGSTOP}, t))) AS term FROM conversations")
register("sc_edit_distance", lambda t: t.read("nation").alias("a").crossJoin(t.read("nation").alias("b")).select(c("a.n_name").alias("a"), c("b.n_name").alias("b"), F.levenshtein("a.n_name", "b.n_name").cast("long").alias("d")), "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS d FROM nation a, nation b")
register("sc_highlight", lambda t: t.page_docs.select("doc_id", T.highlight(c("title"), F.lit("the tion éa (")).alias("marked")), f"WITH {N.PDOCS} SELECT doc_id, regexp_replace(title, '(?i)(\\Qthe\\E|\\Qtion\\E)', '<mark>\\1</mark>', 'g') AS marked FROM page_docs")
NORM = """lower(regexp_extract(url, '^([^:/?#]+)://', 1)) || '://' || lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) ||
  CASE WHEN regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') = '' THEN '/' ELSE regexp_replace(regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1), '/+$', '') END"""
register("sc_normalise_url", lambda t: t.pages.select("page_id", U.normalise(c("url")).alias("url")), f"SELECT page_id, {NORM} AS url FROM pages")
HOST = "regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)"
register("sc_domain_of", lambda t: t.pages.select("page_id", U.domain_of(c("url")).alias("domain")), f"SELECT page_id, coalesce(nullif({HOST}, ''), 'unknown') AS domain FROM pages")
register("sc_domain", lambda t: t.pages.groupBy(U.netloc(c("url")).alias("domain")).agg(F.count("*").alias("n")), f"SELECT {HOST} AS domain, count(*) AS n FROM pages GROUP BY 1")
register("sc_is_allowed", lambda t: t.pages.select("page_id", U.in_domains(c("url"), ["example.com", "thther.example.org"]).alias("ok")), f"SELECT page_id, lower({HOST}) IN ('example.com', 'thther.example.org') OR lower({HOST}) LIKE '%.example.com' OR lower({HOST}) LIKE '%.thther.example.org' AS ok FROM pages")
register("sc_same_domain", lambda t: t.pages.select("page_id", U.same_domain(c("url"), F.lit("https://thther.example.org/x")).alias("same")), f"SELECT page_id, {HOST} = 'thther.example.org' AS same FROM pages")
register(
    "sc_robots_allowed",
    lambda t: t.pages.select("page_id", U.robots_allowed(c("url"), F.when(c("url").contains("example.net"), F.lit("User-agent: *\nDisallow: /en\n")), c("url").contains("//m.")).alias("allowed")),
    "SELECT page_id, NOT (url LIKE '%example.net%' AND url NOT LIKE '%//m.%' AND regexp_matches(url, '^[^:/?#]+://[^/?#]*/en')) AS allowed FROM pages",
)
register("sc_parse_title", lambda t: t.pages.select("page_id", U.title_of(c("html")).alias("title")), f"SELECT page_id, {N.TITLE} AS title FROM pages")
PARSED = lambda t: t.pages.select("page_id", U.parse_page("html", "url").alias("p")).select("page_id", "p.*")
register("sc_parse_page", lambda t: PARSED(t))
register("sc_parse_text", lambda t: PARSED(t).select("page_id", "text"))
register("sc_parse_snippet", lambda t: PARSED(t).select("page_id", "snippet"))
register("sc_parse_links", lambda t: PARSED(t).select("page_id", F.explode("links").alias("link")))
register("sc_embed_text", lambda t: t.documents.select("doc_id", T.embed_text(c("source"), c("text")).alias("e")), "SELECT doc_id, substr(concat_ws(' ', source, source, source, text), 1, 512) AS e FROM documents")
MSG = lambda: F.concat(F.lit("worker rank "), c("worker_rank").cast("string"), F.lit(" got https://"), "domain", F.lit("/p now"))
register("sc_log_extract", lambda t: t.crawl_log.select("id", T.log_rank(MSG()).alias("rank"), T.log_url(MSG()).alias("url")), f"WITH {N.WLOG} SELECT id, CAST(worker_rank AS INTEGER) AS rank, 'https://' || domain || '/p' AS url FROM crawl_log")
register("sc_hour_substr", lambda t: t.query_log.select("id", T.hour_of(F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss")).alias("hour")), f"WITH {N.QLOG} SELECT id, substr(strftime(timestamp, '%Y-%m-%dT%H:%M:%S'), 12, 2) AS hour FROM query_log")
register("sc_hour_label", lambda t: t.query_log.select("id", F.date_format("timestamp", "HH:00").alias("hour")), f"WITH {N.QLOG} SELECT id, strftime(timestamp, '%H:00') AS hour FROM query_log")
register("sc_round", lambda t: t.events.select("event_id", *[F.round("value", k).alias(f"r{k}") for k in (2, 3, 4, 6)]), "SELECT event_id, round(value, 2) AS r2, round(value, 3) AS r3, round(value, 4) AS r4, round(value, 6) AS r6 FROM events")
register("sc_click_boost_fn", lambda t: t.click_log.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.round(S.click_boost(c("n")), 6).alias("boost")), f"WITH {N.CLOG} SELECT doc_id, round(1 + 0.1 * ln(1 + count(*)), 6) AS boost FROM click_log GROUP BY doc_id")
register("sc_dcg_weight", lambda t: t.click_log.select("id", F.round(S.click_weight(c("position")), 6).alias("w")), f"WITH {N.CLOG} SELECT id, round(2 / log2(position + 2), 6) AS w FROM click_log")
register("sc_decay", lambda t: t.events.select("event_id", F.round(S.decayed(c("value"), c("user_id")), 6).alias("d")), "SELECT event_id, round(value * exp(-user_id * ln(2) / 300), 6) AS d FROM events")
register("sc_json_links", lambda t: t.page_docs.select("doc_id", F.to_json(F.array("url", "url")).alias("j")).select("doc_id", F.explode(F.from_json("j", "array<string>")).alias("link")), "SELECT page_id AS doc_id, unnest([url, url]) AS link FROM pages")
register("sc_idf", lambda t: t.vocabulary.crossJoin(F.broadcast(t.n_docs)).select("term", F.round(S.idf(c("n"), c("df")), 6).alias("idf")), f"WITH {N.VOCAB} SELECT term, round(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM vocabulary")
register("sc_tf_norm", lambda t: t.postings.join(t.lengths, "doc_id").select("term", "doc_id", F.round(S.tf_norm(c("tf"), c("dl"), F.lit(250.0)), 6).alias("x")), f"WITH {N.POST} SELECT term, doc_id, round(tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * sum(tf) OVER (PARTITION BY doc_id) / 250.0)), 6) AS x FROM postings")
register("sc_error_rate", lambda t: t.crawl_log.groupBy("domain").agg(F.count("*").alias("n"), F.count_if(c("status") == "failed").alias("e")).select("domain", S.error_rate(c("e"), c("n")).alias("rate")), f"WITH {N.WLOG} SELECT domain, round(count(*) FILTER (status = 'failed') / count(*) * 100, 1) AS rate FROM crawl_log GROUP BY domain")


def _progress(t: Inputs) -> DataFrame:
    rate, pct, eta = S.progress(c("pages"), F.lit(3600.0), F.lit(2500))
    return LV.progress(t.crawl_log).select("worker_rank", rate.alias("rate"), pct.alias("pct"), eta.alias("eta"))


register("sc_progress", _progress, f"WITH {N.WLOG}, p AS (SELECT worker_rank, count(*) FILTER (status = 'ok') AS pages FROM crawl_log GROUP BY 1) SELECT worker_rank, round(pages / 3600.0, 2) AS rate, least(100.0, round(pages / 2500 * 100, 1))::DOUBLE AS pct, CASE WHEN round(pages / 3600.0, 2) > 0 THEN round(greatest(2500 - pages, 0) / round(pages / 3600.0, 2), 1) END AS eta FROM p")

# Filters -----------------------------------------------------------------------------------------
for _s in ("ok", "failed", "blocked"):
    register(f"flt_status_{_s}", lambda t, s=_s: t.crawl_log.where(c("status") == s), f"WITH {N.WLOG} SELECT * FROM crawl_log WHERE status = '{_s}'")
register("flt_zero_results", lambda t: t.query_log.where("result_count = 0"), f"WITH {N.QLOG} SELECT * FROM query_log WHERE result_count = 0")
register("flt_like_prefix_word", lambda t: t.click_log.where(F.lower("query").contains("term1")), f"WITH {N.CLOG} SELECT * FROM click_log WHERE query ILIKE '%TERM1%'")
register("flt_last_24h", lambda t: t.query_log.where(L.within(NOW, 24)), f"WITH {N.QLOG} SELECT * FROM query_log WHERE timestamp >= TIMESTAMP '{NOW}' - INTERVAL 24 HOUR AND timestamp <= TIMESTAMP '{NOW}'")
register("flt_len_diff", lambda t: t.read("nation").crossJoin(t.read("region")).where(F.abs(F.length("n_name") - F.length("r_name")) <= 3).select("n_name", "r_name"), "SELECT n_name, r_name FROM nation, region WHERE abs(length(n_name) - length(r_name)) <= 3")
register("flt_cooc_ge3", lambda t: SG.cooccurrence(t.postings).where("n >= 3"), f"WITH {N.VOCAB}, top AS (SELECT term, df FROM vocabulary ORDER BY df DESC, term LIMIT 2000), o AS (SELECT doc_id, term, row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, term) AS i FROM postings JOIN top USING (term)), p AS (SELECT a.term AS t1, b.term AS t2 FROM o a JOIN o b ON a.doc_id = b.doc_id AND b.i - a.i BETWEEN 1 AND 5) SELECT t1, t2, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT t2, t1 FROM p) GROUP BY ALL HAVING count(*) >= 3")
register("flt_low_result", lambda t: L.result_gaps(t.query_log).where("kind = 'low'"), f"WITH {N.QLOG} SELECT lower(query) AS query, count(*) AS n, round(avg(result_count), 4) AS avg_results, 'low' AS kind FROM query_log GROUP BY 1 HAVING avg(result_count) > 0 AND avg(result_count) < 3 AND count(*) > 1")
register("flt_active", lambda t: LV.last_seen(t.query_log).where(c("last_seen") > F.lit(NOW).cast("timestamp") - F.expr("interval 1 day")), f"WITH {N.QLOG} SELECT session_id, max(timestamp) AS last_seen FROM query_log GROUP BY 1 HAVING max(timestamp) > TIMESTAMP '{NOW}' - INTERVAL 1 DAY")
register("flt_depth", lambda t: t.crawl_log.where("depth < 4"), f"WITH {N.WLOG} SELECT * FROM crawl_log WHERE depth < 4")
register("flt_title_ok", lambda t: C.accepted(t.crawl_log.withColumn("title", F.when(c("status") == "failed", "Failed").when(c("status") == "blocked", "Blocked").otherwise("page"))), f"WITH {N.WLOG} SELECT *, 'page' AS title FROM crawl_log WHERE status = 'ok'")
register("flt_content_type", lambda t: t.pages.select("page_id", F.when(c("page_id") % 3 == 0, "text/html; charset=utf-8").otherwise("image/png").alias("kind")).where(c("kind").contains("text/html")), "SELECT page_id, 'text/html; charset=utf-8' AS kind FROM pages WHERE page_id % 3 = 0")
register("flt_self_loop", lambda t: t.edges, f"WITH {N.EDGES} SELECT * FROM edges")
register("flt_shard_range", lambda t: FD.shard(t.postings, 3).select("doc_id", "shard_id").distinct(), f"WITH {N.POST}, z AS (SELECT ceil((max(doc_id) + 1) / 3)::BIGINT AS size FROM postings) SELECT DISTINCT doc_id, doc_id // size AS shard_id FROM postings, z")
register("flt_min_prefix", lambda t: SG.complete(t.store.vocabulary.drop("slot"), t.rows([("th",), ("t",)], "prefix string"), least=2), f"WITH {N.VOCAB} SELECT 'th' AS prefix, term, df, CAST(row_number() OVER (ORDER BY df DESC, term) AS INTEGER) AS rank FROM vocabulary WHERE starts_with(term, 'th') QUALIFY rank <= 8")


def _running(t: Inputs) -> DataFrame:
    return t.crawl_log.where("status = 'blocked'").select("doc_id", "domain", c("timestamp").alias("start"))


P95 = "last AS (SELECT domain, duration_ms FROM crawl_log QUALIFY row_number() OVER (PARTITION BY domain ORDER BY timestamp DESC, id DESC) <= 200), p95 AS (SELECT domain, count(*) AS n, quantile_disc(duration_ms, 0.95) AS p95 FROM last GROUP BY domain)"
register("flt_straggler", lambda t: L.stragglers(_running(t), L.p95_rolling(t.crawl_log), NOW), f"WITH {N.WLOG}, {P95} SELECT doc_id, domain, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 1000 - 1.5 * p95, 3) AS overdue_ms FROM crawl_log JOIN p95 USING (domain) WHERE status = 'blocked' AND (epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 1000 - 1.5 * p95 > 0")

# Joins -------------------------------------------------------------------------------------------
register("join_click_docs", lambda t: t.click_log.join(t.page_docs, "doc_id").select("id", "doc_id", "url"), f"WITH {N.CLOG} SELECT id, doc_id, url FROM click_log JOIN pages ON doc_id = page_id")
register("join_unindexed", lambda t: I.unindexed(t.documents, t.lengths).select("doc_id"), f"SELECT doc_id FROM documents WHERE len({N.toks('text')}) = 0")
register("join_terms_postings", lambda t: t.postings.join(F.broadcast(t.queries.select(F.explode(T.query_terms(c("q"))).alias("term")).distinct()), "term"), f"WITH {N.POST}, {N.QUERIES} SELECT term, doc_id, tf FROM postings WHERE term IN (SELECT unnest({N.qterms('q')}) FROM queries)")
register("join_doclen", lambda t: t.documents.select("doc_id").join(t.lengths, "doc_id", "left").select("doc_id", F.coalesce("dl", F.lit(250)).cast("long").alias("dl")), f"SELECT doc_id, CASE WHEN len({N.toks('text')}) > 0 THEN len({N.toks('text')}) ELSE 250 END AS dl FROM documents")
register("join_visited", lambda t: t.edges.select(c("dst").alias("node")).distinct().join(t.edges.select(c("src").alias("node")), "node", "left_anti"), f"WITH {N.EDGES} SELECT DISTINCT dst AS node FROM edges WHERE dst NOT IN (SELECT src FROM edges)")
register("join_session_pairs", lambda t: L.query_pairs(t.query_log, None), f"WITH {N.QLOG}, o AS (SELECT DISTINCT session_id, lower(trim(query)) AS q FROM query_log) SELECT a.q AS q1, b.q AS q2, count(*) AS n FROM o a JOIN o b ON a.session_id = b.session_id AND a.q < b.q GROUP BY ALL")
register("join_ring", lambda t: SK.route(t.pages.select("page_id", U.netloc(c("url")).alias("host")), "host", SK.ring(t.spark, [1, 2, 3, 4, 5, 6])), f"""WITH ring AS (SELECT md5(n || '-vnode-' || v) AS pos, n::BIGINT AS node FROM range(1, 7) a(n), range(150) b(v)), k AS (SELECT page_id, {HOST} AS host, md5({HOST}) AS h FROM pages)
  SELECT page_id, host, coalesce(r.node, (SELECT node FROM ring ORDER BY pos LIMIT 1)) AS node FROM k ASOF LEFT JOIN ring r ON k.h <= r.pos""")
register("join_graph_top", lambda t: G.subgraph(t.edges, G.pagerank(t.edges, least=None)), f"WITH {N.pagerank()}, b AS (SELECT doc_id, pr FROM pr ORDER BY pr DESC, doc_id LIMIT 300), z AS (SELECT doc_id, round(8 + pr / (SELECT max(pr) FROM b) * 50, 3) AS size FROM b) SELECT src, dst, a.size AS src_size, b2.size AS dst_size FROM edges JOIN z a ON a.doc_id = src JOIN z b2 ON b2.doc_id = dst ORDER BY src, dst LIMIT 800")
register("join_incoming", lambda t: t.edges.join(t.edges.groupBy("src").agg(F.count("*").alias("degree")), "src").groupBy(c("dst").alias("doc_id")).agg(F.round(F.sum(1 / c("degree")), 6).alias("got")), f"WITH {N.EDGES} SELECT dst AS doc_id, round(sum(1 / degree), 6) AS got FROM edges JOIN (SELECT src, count(*) AS degree FROM edges GROUP BY src) USING (src) GROUP BY dst")
register("join_meta", lambda t: R.with_meta(t.click_log.select("doc_id").distinct().union(t.rows([(-1,)], "doc_id long")), t.page_docs), f"WITH {N.CLOG}, {N.PDOCS}, d AS (SELECT DISTINCT doc_id FROM click_log UNION ALL SELECT -1) SELECT doc_id, coalesce(url, '') AS url, coalesce(title, 'No title') AS title, coalesce(snippet, '') AS snippet FROM d LEFT JOIN page_docs USING (doc_id)")

# Aggregations ------------------------------------------------------------------------------------
register("agg_tf", lambda t: t.postings, f"WITH {N.POST} SELECT * FROM postings")
register("agg_index", lambda t: I.lists(t.postings).select("term", "df", F.array_join(c("doc_ids").cast("array<string>"), ",").alias("ids"), F.array_join(c("tfs").cast("array<string>"), ",").alias("tfs")), f"WITH {N.POST} SELECT term, count(*) AS df, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS ids, string_agg(tf::VARCHAR, ',' ORDER BY doc_id) AS tfs FROM postings GROUP BY term")
register("agg_merge_index", lambda t: I.merge(t.postings, t.postings), f"WITH {N.POST} SELECT term, doc_id, 2 * tf AS tf FROM postings")
register("agg_remove_docs", lambda t: I.remove(t.postings, t.read("labels").select("doc_id")), f"WITH {N.POST} SELECT term, doc_id, tf FROM postings WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
register("agg_doclen", lambda t: I.doc_lengths(t.postings), f"WITH {N.POST} SELECT doc_id, CAST(sum(tf) AS BIGINT) AS dl FROM postings GROUP BY doc_id")
register("agg_df", lambda t: t.vocabulary, f"WITH {N.VOCAB} SELECT * FROM vocabulary")
register("agg_corpus_stats", lambda t: I.corpus_stats(t.postings), f"WITH {N.POST} SELECT count(DISTINCT doc_id) AS total_docs, count(DISTINCT term) AS total_terms, CAST(sum(tf) AS BIGINT) AS total_length, round(sum(tf) / count(DISTINCT doc_id), 4) AS avgdl FROM postings")
register("agg_push_sum", lambda t: SK.push_sum(L.pages_by_worker(t.crawl_log).select(c("worker_rank").cast("long").alias("node"), c("pages").cast("double").alias("value")).union(t.rows([(0, 0.0)], "node long, value double")), 7, 4), f"WITH {N.WLOG}, {N.push_sum(7, 4)}")
register("agg_crawl_stats", lambda t: L.crawl_stats(t.crawl_log), f"WITH {N.WLOG} SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS ok, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'blocked') AS blocked, coalesce(round(avg(duration_ms) FILTER (status = 'ok'), 1), 0) AS avg_ms FROM crawl_log")
register("agg_doc_count", lambda t: t.n_docs, "SELECT count(*) AS n FROM documents")
register("agg_query_totals", lambda t: t.query_log.agg(F.count("*").alias("total_queries"), F.count_distinct("query").alias("unique_queries")).crossJoin(t.click_log.agg(F.count("*").alias("total_clicks"))), f"WITH {N.QLOG}, {N.CLOG} SELECT count(*) AS total_queries, count(DISTINCT query) AS unique_queries, (SELECT count(*) FROM click_log) AS total_clicks FROM query_log")
register("agg_top_queries", lambda t: L.top_queries(t.query_log), f"WITH {N.QLOG} SELECT query, count(*) AS n, round(avg(result_count), 4) AS avg_results FROM query_log GROUP BY query ORDER BY n DESC, query LIMIT 20")
register("agg_zero_queries", lambda t: L.zero_result_queries(t.query_log), f"WITH {N.QLOG} SELECT query, count(*) AS n FROM query_log WHERE result_count = 0 GROUP BY query ORDER BY n DESC, query LIMIT 20")
register("agg_top_clicked", lambda t: L.top_clicked(t.click_log, t.page_docs), f"WITH {N.CLOG} SELECT doc_id, url, count(*) AS clicks FROM click_log JOIN pages ON page_id = doc_id GROUP BY ALL ORDER BY clicks DESC, doc_id LIMIT 10")
register("agg_hourly", lambda t: L.hourly(t.query_log), f"WITH {N.QLOG} SELECT strftime(timestamp, '%H:00') AS hour, count(*) AS n FROM query_log GROUP BY 1")


def _map_reduce(t: Inputs) -> DataFrame:
    import pandas as pd

    return L.map_reduce(
        t.query_log.select("query", "result_count"), lambda rows: pd.DataFrame({"key": rows["query"], "n": 1, "r": rows["result_count"]}),
        lambda rows: pd.DataFrame({"key": [rows["key"].iloc[0]], "n": [rows["n"].sum()], "r": [rows["r"].sum()]}), "key string, n long, r long", "key string, n long, r long",
        combiner=lambda rows: rows.groupby("key", as_index=False).sum(),
    )


register("agg_map_reduce", _map_reduce, f"WITH {N.QLOG} SELECT query AS key, count(*) AS n, CAST(sum(result_count) AS BIGINT) AS r FROM query_log GROUP BY query")
register("agg_job1_terms", lambda t: L.term_frequency(t.query_log), f"WITH {N.QLOG} SELECT term, count(*) AS n FROM (SELECT unnest({N.qterms('query')}) AS term FROM query_log) WHERE NOT list_contains({N.LOGSTOP}, term) GROUP BY term ORDER BY n DESC, term LIMIT 20")
register("agg_job2_position", lambda t: L.position_bias(t.click_log), f"WITH {N.CLOG} SELECT position, count(*) AS clicks, round(count(*) / sum(count(*)) OVER () * 100, 1) AS pct FROM click_log GROUP BY position")
register("agg_job3_cooc", lambda t: L.query_pairs(t.query_log), f"WITH {N.QLOG}, o AS (SELECT DISTINCT session_id, lower(trim(query)) AS q FROM query_log) SELECT a.q AS q1, b.q AS q2, count(*) AS n FROM o a JOIN o b ON a.session_id = b.session_id AND a.q < b.q GROUP BY ALL ORDER BY n DESC, q1, q2 LIMIT 10")
register("agg_job4_zero", lambda t: L.result_gaps(t.query_log), f"WITH {N.QLOG}, g AS (SELECT lower(query) AS query, count(*) AS n, avg(result_count) AS a FROM query_log GROUP BY 1) SELECT query, n, round(a, 4) AS avg_results, CASE WHEN a = 0 THEN 'zero' ELSE 'low' END AS kind FROM g WHERE a = 0 OR (a < 3 AND n > 1)")
register("agg_job5_hour", lambda t: L.hour_volume(t.query_log), f"WITH {N.QLOG} SELECT strftime(timestamp, '%H') AS hour, count(*) AS n FROM query_log GROUP BY 1")
register("agg_session_journey", lambda t: L.session_journey(t.query_log), f"WITH {N.QLOG} SELECT session_id, CAST(count(*) AS INTEGER) AS n, string_agg(query, ' > ' ORDER BY timestamp, id, query) AS journey FROM query_log GROUP BY session_id")
PCT = lambda p: f"CASE WHEN len(v) > 0 THEN round(v[greatest(1, CAST(floor(len(v) * {p} / 100) AS INTEGER))], 1) ELSE 0 END"
register("agg_pct_floor", lambda t: L.percentiles(t.crawl_log, "domain", "duration_ms", (50, 95, 99)), f"WITH {N.WLOG}, g AS (SELECT domain, list(duration_ms ORDER BY duration_ms) AS v FROM crawl_log GROUP BY domain) SELECT domain, {PCT(50)} AS p50, {PCT(95)} AS p95, {PCT(99)} AS p99 FROM g")
register("agg_pct_ceil", lambda t: t.crawl_log.groupBy("domain").agg(F.expr("percentile_disc(0.95) within group (order by duration_ms)").alias("p95")), f"WITH {N.WLOG} SELECT domain, quantile_disc(duration_ms, 0.95) AS p95 FROM crawl_log GROUP BY domain")
DSTATS = f"WITH {N.WLOG}, g AS (SELECT domain, count(*) AS fetches, count(*) FILTER (status = 'failed') AS errors, count(*) FILTER (status = 'blocked') AS blocked, list(duration_ms ORDER BY duration_ms) FILTER (status = 'ok') AS v, avg(duration_ms) FILTER (status = 'ok') AS a FROM crawl_log GROUP BY domain) SELECT domain, fetches, errors, blocked, round(errors / fetches * 100, 1) AS error_rate, {PCT(50)} AS p50_ms, {PCT(95)} AS p95_ms, {PCT(99)} AS p99_ms, coalesce(round(a, 1), 0) AS avg_ms FROM g"
register("agg_domain_stats", lambda t: L.domain_stats(t.crawl_log), DSTATS)
register("agg_p95_rolling", lambda t: L.p95_rolling(t.crawl_log), f"WITH {N.WLOG}, {P95} SELECT domain, n, p95 FROM p95")
register("agg_cooc", lambda t: SG.cooccurrence(t.postings), ORACLES["flt_cooc_ge3"].replace(" HAVING count(*) >= 3", ""))
register("agg_worker_pages", lambda t: L.pages_by_worker(t.crawl_log), f"WITH {N.WLOG} SELECT worker_rank, count(*) FILTER (status = 'ok') AS pages FROM crawl_log GROUP BY 1")
register("agg_imbalance", lambda t: L.imbalance(L.pages_by_worker(t.crawl_log)), f"WITH {N.WLOG}, p AS (SELECT worker_rank, count(*) FILTER (status = 'ok') AS pages FROM crawl_log GROUP BY 1) SELECT round(max(pages) / min(pages), 2) AS imbalance FROM p WHERE pages > 0")
register("agg_trending_q", lambda t: LV.query_counts(t.query_log).orderBy(c("n").desc(), "query").limit(5), f"WITH {N.QLOG} SELECT lower(query) AS query, count(*) AS n FROM query_log GROUP BY 1 ORDER BY n DESC, query LIMIT 5")
register("agg_collab_stats", lambda t: LV.active_users(t.query_log, NOW, 86400).crossJoin(LV.query_counts(t.query_log).agg(F.sum("n").alias("total"), F.count("*").alias("unique_queries"))), f"WITH {N.QLOG} SELECT (SELECT count(DISTINCT session_id) FROM query_log WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 DAY AND timestamp <= TIMESTAMP '{NOW}') AS active_users, count(*) AS total, count(DISTINCT lower(query)) AS unique_queries FROM query_log")
register("agg_bloom_similarity", lambda t: SK.filter_similarity(t.crawl_log.select(c("worker_rank").alias("filter_id"), (c("doc_id") % 97).alias("pos")).distinct()), f"WITH {N.WLOG}, b AS (SELECT DISTINCT worker_rank AS f, doc_id % 97 AS pos FROM crawl_log), z AS (SELECT f, count(*) AS n FROM b GROUP BY f), p AS (SELECT x.f AS a, y.f AS b, x.n AS na, y.n AS nb, (SELECT count(*) FROM b u JOIN b v ON u.pos = v.pos WHERE u.f = x.f AND v.f = y.f) AS i FROM z x JOIN z y ON x.f < y.f) SELECT round(avg(i / (na + nb - i)), 6) AS mean_jaccard, avg(i / (na + nb - i)) > 0.95 AS converged FROM p")
register("agg_inlinks", lambda t: G.inlink_shares(t.edges), f"WITH {N.EDGES} SELECT dst AS doc_id, round(count(*) / max(count(*)) OVER (), 6) AS share FROM edges GROUP BY dst")

# Retrieval ---------------------------------------------------------------------------------------
register("ir_map_emit", lambda t: I.emit(t.documents), f"WITH {N.POST} SELECT doc_id, term FROM tok")
register("ir_build_index", lambda t: I.postings(t.documents), f"WITH {N.POST} SELECT * FROM postings")


def _incremental(t: Inputs, what: int) -> DataFrame:
    old = t.documents.where("lang = 'en'")
    post, meta = I.incremental(t.documents, I.postings(old), old.select("doc_id", F.size(T.tokens(c("text"))).cast("long").alias("term_count")))
    return (post, meta)[what]


register("ir_incremental", lambda t: _incremental(t, 0), f"WITH {N.POST} SELECT term, doc_id, tf FROM postings")
register("ir_incremental_meta", lambda t: _incremental(t, 1), f"SELECT doc_id, len({N.toks('text')}) AS term_count FROM documents")
register("ir_bm25", lambda t: R.bm25_stored(t.asked, t.queries), f"WITH {N.bm25()} SELECT * FROM hits")
register("ir_bm25_pagerank", lambda t: R.bm25_stored(t.asked, t.queries, G.pagerank(t.edges, least=None)), f"WITH {N.pagerank()}, {N.bm25(blend='0.8 * s + 0.2 * 10 * coalesce(pr, 0)')} SELECT * FROM hits")
register("ir_bm25_api", lambda t: R.with_meta(R.bm25_stored(t.asked, t.queries, top_n=10), t.page_docs), f"WITH {N.bm25(top=10)}, {N.PDOCS} SELECT hits.*, coalesce(url, '') AS url, coalesce(title, 'No title') AS title, coalesce(snippet, '') AS snippet FROM hits LEFT JOIN page_docs USING (doc_id)")
TFIDF = f"""ft AS ({N.feats('doc_id', 'text', 'documents')}), cnt AS (SELECT feature, doc_id, count(*) AS tf FROM ft GROUP BY ALL),
  kept AS (SELECT feature, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf FROM cnt GROUP BY feature HAVING count(*) >= 2 ORDER BY sum(tf) DESC, feature LIMIT 30000),
  w AS (SELECT doc_id, feature, (1 + ln(tf)) * idf AS w FROM cnt JOIN kept USING (feature)), weights AS (SELECT doc_id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM w)"""
register("ir_tfidf_build", lambda t: R.tfidf(t.documents)[0].select("doc_id", "feature", F.round("weight", 6).alias("weight")), f"WITH {TFIDF} SELECT doc_id, feature, round(weight, 6) AS weight FROM weights")
SEARCH = f"""{N.QUERIES}, qf AS ({N.feats('query_id', 'q', 'queries')}), qw AS (SELECT query_id, feature, (1 + ln(count(*))) * any_value(idf) AS w FROM qf JOIN kept USING (feature) GROUP BY ALL),
  qn AS (SELECT query_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1), sims AS (SELECT query_id, doc_id, round(sum(weight * w) / any_value(norm), 4) AS similarity FROM weights JOIN qw USING (feature) JOIN qn USING (query_id) GROUP BY ALL HAVING similarity > 0),
  found AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 20)"""
register("ir_tfidf_search", lambda t: R.tfidf_stored(t.store, t.queries), f"WITH {TFIDF}, {SEARCH} SELECT * FROM found")
# The queries are every vector whose id is divisible by 50, against all rows.
QV = lambda t: t.read("embeddings").where("vec_id % 50 = 0").select(c("vec_id").alias("query_id"), c("embedding").alias("q_vector"))
VS = "vs AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])), 4) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)"
register("ir_vector_search", lambda t: R.vector_search(t.read("embeddings"), QV(t)), f"WITH {VS} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 20")
register("ir_embed_build", lambda t: R.encode_words(t.documents).select("doc_id", F.posexplode("embedding").alias("dim", "x")).where("x <> 0").select("doc_id", c("dim").cast("long").alias("dim"), F.round(c("x").cast("double"), 5).alias("x")), f"WITH w AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS dim FROM (SELECT doc_id, unnest({N.qterms('text')}) AS w FROM documents)), n AS (SELECT doc_id, dim, count(*) AS n FROM w GROUP BY ALL) SELECT doc_id, dim, round((n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)))::FLOAT::DOUBLE, 5) AS x FROM n")
register("flt_bert_gt", lambda t: R.vector_search(t.read("embeddings"), QV(t)).where("similarity > 0.2"), f"WITH {VS} SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, doc_id) AS INTEGER) AS rank FROM vs QUALIFY rank <= 20 AND similarity > 0.2")


def _hybrid(t: Inputs) -> DataFrame:
    lexical = R.bm25_stored(t.store, t.queries, top_n=40)
    return R.hybrid(lexical, R.tfidf_stored(t.store, t.queries, top_n=40), 0.05, R.hybrid_weights(2, False))


HYB = f"""{N.bm25(top=40)}, {TFIDF}, {SEARCH.replace(N.QUERIES + ', ', '').replace('rank <= 20', 'rank <= 40')},
  lx AS (SELECT query_id, doc_id, score / CASE WHEN max(score) OVER w = 0 THEN 1 ELSE max(score) OVER w END AS l FROM hits WINDOW w AS (PARTITION BY query_id)),
  se AS (SELECT query_id, doc_id, similarity / max(similarity) OVER (PARTITION BY query_id) AS s FROM found WHERE similarity > 0.05),
  bl AS (SELECT query_id, doc_id, round(coalesce(l, 0), 3) AS bm25, round(coalesce(s, 0), 3) AS semantic, round(0.60 * coalesce(l, 0) + 0.40 * coalesce(s, 0), 3) AS score FROM lx FULL JOIN se USING (query_id, doc_id)),
  hybrid AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM bl QUALIFY rank <= 20)"""
register("ir_hybrid", _hybrid, f"WITH {HYB} SELECT * FROM hybrid")
register("flt_tfidf_gt", lambda t: R.tfidf_stored(t.store, t.queries).where("similarity > 0.05"), f"WITH {TFIDF}, {SEARCH} SELECT * FROM found WHERE similarity > 0.05")
WRONG = ["tione", "thonn", "inge", "blle", "zzqx", "th", "thther"]
register("ir_spell", lambda t: SG.correct(t.store.vocabulary.drop("slot"), t.rows([(w,) for w in WRONG], "word string")).select("word", "correction", c("distance").cast("long").alias("distance"), "df"), f"""WITH {N.VOCAB}, w AS (SELECT unnest({WRONG}) AS word), m AS (SELECT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT term FROM vocabulary)),
  n AS (SELECT word, term AS correction, levenshtein(word, term) AS distance, df FROM m JOIN vocabulary ON substr(word, 1, 2) = substr(term, 1, 2) AND abs(length(word) - length(term)) <= 3)
  SELECT * FROM n WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, df DESC, correction) = 1""")
register("ir_spell_query", lambda t: SG.correct_queries(t.store.vocabulary.drop("slot"), t.rows([(1, "Tione ingg"), (2, "thon zzqx th")], "query_id long, q string")), f"""WITH {N.VOCAB}, qs(query_id, q) AS (VALUES (1::BIGINT, 'Tione ingg'), (2, 'thon zzqx th')), w AS (SELECT query_id, q, unnest(string_split_regex(trim(lower(q)), '\\s+')) AS word, generate_subscripts(string_split_regex(trim(lower(q)), '\\s+'), 1) AS pos FROM qs),
  m AS (SELECT DISTINCT word FROM w WHERE length(word) >= 3 AND word NOT IN (SELECT term FROM vocabulary)), n AS (SELECT word, term, levenshtein(word, term) AS d, df FROM m JOIN vocabulary ON substr(word, 1, 2) = substr(term, 1, 2) AND abs(length(word) - length(term)) <= 3),
  b AS (SELECT * FROM n WHERE d <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY d, df DESC, term) = 1)
  SELECT query_id, q, string_agg(coalesce(term, word), ' ' ORDER BY pos) AS corrected, count(term) AS n_fixed FROM w LEFT JOIN b USING (word) GROUP BY ALL""")


def _synonyms(t: Inputs) -> DataFrame:
    curated = t.rows([("tion", 0, "ing"), ("tion", 1, "nosuchterm"), ("tion", 2, "ble")], "term string, pos int, synonym string")
    return SG.synonyms(t.queries.select(F.explode(T.query_terms(c("q"))).alias("term")), t.store.vocabulary.drop("slot"), SG.cooccurrence(t.store.postings), curated)


SYN = f"""{ORACLES['agg_cooc'][5:].rsplit(' SELECT t1', 1)[0]}, cooc AS (SELECT t1, t2, count(*) AS n FROM (SELECT * FROM p UNION ALL SELECT t2, t1 FROM p) GROUP BY ALL), {N.QUERIES}, ts AS (SELECT DISTINCT unnest({N.qterms('q')}) AS term FROM queries),
  cur(term, pos, synonym) AS (VALUES ('tion', 0, 'ing'), ('tion', 1, 'nosuchterm'), ('tion', 2, 'ble')),
  u AS (SELECT cur.term, synonym, 0 AS source, pos::BIGINT AS o FROM cur JOIN vocabulary v ON v.term = synonym UNION ALL SELECT t1, t2, 1, -n FROM cooc JOIN ts ON t1 = term WHERE n >= 3 AND t1 <> t2),
  f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY term, synonym ORDER BY source, o) = 1), syn AS (SELECT term, synonym, CAST(row_number() OVER (PARTITION BY term ORDER BY source, o, synonym) AS INTEGER) AS rank FROM f QUALIFY rank <= 3)"""
register("ir_synonyms", _synonyms, f"WITH {SYN} SELECT * FROM syn")
register("ir_expand", lambda t: SG.expand(t.queries, _synonyms(t)), f"WITH {SYN}, x AS (SELECT query_id, q, unnest({N.qterms('q')}) AS term, generate_subscripts({N.qterms('q')}, 1) AS pos FROM queries), y AS (SELECT query_id, string_agg(synonym, ' ' ORDER BY pos, rank) AS more FROM x JOIN syn USING (term) GROUP BY 1) SELECT query_id, q, q || coalesce(' ' || more, '') AS expanded FROM queries LEFT JOIN y USING (query_id)")
register("ir_suggest", lambda t: SG.complete(t.store.vocabulary.drop("slot"), t.rows([("th",), ("TIO",), ("zzz",)], "prefix string")), f"WITH {N.VOCAB}, p AS (SELECT unnest(['th', 'tio', 'zzz']) AS prefix) SELECT prefix, term, df, CAST(row_number() OVER (PARTITION BY prefix ORDER BY df DESC, term) AS INTEGER) AS rank FROM vocabulary JOIN p ON starts_with(term, prefix) QUALIFY rank <= 8")
CQ = "cq(query_id, q) AS (VALUES (1::BIGINT, 'term1 x'), (2, 'TERM2'))"
CQROWS = [(1, "term1 x"), (2, "TERM2")]


def _click_boost(t: Inputs) -> DataFrame:
    q = t.rows(CQROWS, "query_id long, q string")
    results = t.documents.crossJoin(q).select("query_id", "doc_id", F.round(c("n_chars") / 1000.0, 3).alias("score"))
    return R.boost_clicks(results, t.click_log, q)


register("ir_click_boost", _click_boost, f"WITH {N.CLOG}, {CQ}, k AS (SELECT query_id, cl.doc_id, count(*) AS clicks FROM cq JOIN click_log cl ON contains(lower(query), lower(string_split_regex(trim(q), '\\s+')[1])) GROUP BY ALL), s AS (SELECT query_id, doc_id, coalesce(clicks, 0) AS clicks, round(round(n_chars / 1000.0, 3) * (1 + 0.1 * ln(1 + coalesce(clicks, 0))), 3) AS score FROM (SELECT * FROM documents, cq) LEFT JOIN k USING (query_id, doc_id)) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20")

# Graph, sketches, shards -------------------------------------------------------------------------
register("gr_pagerank", lambda t: G.pagerank(t.edges, least=None), f"WITH {N.pagerank()} SELECT doc_id, pr AS score FROM pr")
register("gr_link_graph", lambda t: G.link_graph(t.edges.select(c("src").alias("doc_id"), F.concat(F.lit("u"), c("dst").cast("string")).alias("l")).groupBy("doc_id").agg(F.collect_list("l").alias("links")).withColumn("url", F.concat(F.lit("u"), c("doc_id").cast("string")))), f"WITH {N.EDGES} SELECT src, dst FROM edges WHERE dst IN (SELECT src FROM edges)")
register("gr_neighbourhood", lambda t: G.neighbours(t.edges, t.rows([(1,)], "doc_id long")), f"WITH {N.EDGES}, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), h1 AS (SELECT DISTINCT b FROM b WHERE a = 1), h2 AS (SELECT DISTINCT b.b FROM h1 JOIN b ON b.a = h1.b), u AS (SELECT 1 AS d, 0 AS hop UNION ALL SELECT b, 1 FROM h1 UNION ALL SELECT b, 2 FROM h2) SELECT 1::BIGINT AS start, d::BIGINT AS doc_id, min(hop) AS hop FROM u GROUP BY d")
register("top_pagerank", lambda t: G.pagerank(t.edges, least=None).orderBy(c("score").desc(), "doc_id").limit(5), f"WITH {N.pagerank()} SELECT doc_id, pr AS score FROM pr ORDER BY pr DESC, doc_id LIMIT 5")
M, KH = SK.bloom_size(100_000, 0.001)
HEXMOD = lambda h, n: f"list_reduce(list_transform(range(0, {n // 4}), lambda i: ('0x' || substr({h}, 1 + 4 * i, 4))::BIGINT), lambda acc, x: (acc * 65536 + x) % {M}, 0::BIGINT)"
BITS = f"pos AS (SELECT url, unnest(list_transform(range(0, {KH}), lambda i: (a + i * b) % {M})) AS pos FROM (SELECT url, {HEXMOD('sha256(url)', 64)} AS a, {HEXMOD('md5(url)', 32)} AS b FROM pages))"
register("pb_bloom", lambda t: SK.bloom(t.pages, "url", M, KH), f"WITH {BITS} SELECT DISTINCT pos FROM pos")
register("pb_bloom_contains", lambda t: SK.bloom_contains(t.pages.select("url").union(t.rows([("https://no.example/1",)], "url string")), "url", SK.bloom(t.pages, "url", M, KH), M, KH), "SELECT DISTINCT url, true AS maybe_present FROM pages UNION ALL SELECT 'https://no.example/1', false")
register("pb_bloom_stats", lambda t: SK.bloom_stats(SK.bloom(t.pages, "url", M, KH), t.pages.select("url").distinct().agg(F.count("*").alias("n")), M, KH), f"WITH {BITS} SELECT (SELECT count(DISTINCT url) FROM pages) AS n_items, count(DISTINCT pos) AS bits_set, round(count(DISTINCT pos) / {M}, 6) AS load_factor, {M // 8}::BIGINT AS memory_bytes, round(pow(1 - exp(-{KH} * (SELECT count(DISTINCT url) FROM pages) / {float(M)}), {KH}), 6) AS fp_rate FROM pos")
register("pb_check_and_add", lambda t: SK.check_and_add(t.pages.select("url"), "url", t.pages.where("page_id % 2 = 0")), "SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 2 = 0)")
register("pb_merge", lambda t: SK.merge_filters(SK.bloom(t.pages.where("page_id % 2 = 0"), "url", M, KH), SK.bloom(t.pages.where("page_id % 2 = 1"), "url", M, KH)), f"WITH {BITS} SELECT DISTINCT pos FROM pos")
register("hs_ring", lambda t: SK.route(t.events.select("event_id"), "event_id", SK.ring(t.spark, [1, 2, 3])).groupBy("node").agg(F.count("*").alias("n")), """WITH ring AS (SELECT md5(n || '-vnode-' || v) AS pos, n::BIGINT AS node FROM range(1, 4) a(n), range(150) b(v)), k AS (SELECT md5(event_id::VARCHAR) AS h FROM events)
  SELECT coalesce(r.node, (SELECT node FROM ring ORDER BY pos LIMIT 1)) AS node, count(*) AS n FROM k ASOF LEFT JOIN ring r ON k.h <= r.pos GROUP BY 1""")
FED = f"""{N.POST}, z AS (SELECT ceil((max(doc_id) + 1) / 3)::BIGINT AS size FROM postings), sh AS (SELECT term, doc_id, tf, doc_id // size AS shard_id FROM postings, z), {N.QUERIES},
  qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({N.qterms('q')}) AS term FROM queries) GROUP BY ALL), ln1 AS (SELECT shard_id, doc_id, sum(tf) AS dl, count(*) AS p FROM sh GROUP BY ALL),
  st AS (SELECT shard_id, sum(p) AS n, sum(dl) / count(*) AS avgdl FROM ln1 GROUP BY 1), df AS (SELECT shard_id, term, count(*) AS df FROM sh GROUP BY ALL),
  sc AS (SELECT query_id, shard_id, doc_id, round(0.85 * sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)))), 3) AS score FROM sh JOIN qt USING (term) JOIN df USING (shard_id, term) JOIN st USING (shard_id) JOIN ln1 USING (shard_id, doc_id) GROUP BY ALL),
  fed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM sc QUALIFY rank <= 10)"""
register("fd_shard", lambda t: FD.shard(t.postings, 3), f"WITH {N.POST}, z AS (SELECT ceil((max(doc_id) + 1) / 3)::BIGINT AS size FROM postings) SELECT term, doc_id, tf, doc_id // size AS shard_id FROM postings, z")
register("fd_shard_search", lambda t: FD.shard_search_stored(t.asked, 3, t.queries), f"WITH {FED} SELECT * FROM fed")
register("fd_merge", lambda t: FD.merge_shards(FD.shard_search_stored(t.asked, 3, t.queries)), f"WITH {FED} SELECT query_id, shard_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM fed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20")
register("fd_api", lambda t: FD.shard_sizes(FD.shard(t.postings, 3)), f"WITH {N.POST}, z AS (SELECT ceil((max(doc_id) + 1) / 3)::BIGINT AS size FROM postings) SELECT doc_id // size AS shard_id, count(DISTINCT term) AS n_terms, count(DISTINCT doc_id) AS n_docs FROM postings, z GROUP BY 1")

# Live signals, as batches ------------------------------------------------------------------------
CROWD = f"crowd AS (SELECT doc_id, round(sum(2 / log2(position + 2) * exp(-((epoch_us(TIMESTAMP '{NOW}') - epoch_us(timestamp)) / 1e6) * ln(2) / {DAY})), 6) AS score FROM click_log WHERE timestamp <= TIMESTAMP '{NOW}' GROUP BY doc_id HAVING score >= 0.001)"
register("st_crawl_stats", lambda t: LV.progress(t.crawl_log), f"WITH {N.WLOG} SELECT worker_rank, count(*) AS total, count(*) FILTER (status = 'ok') AS pages, count(*) FILTER (status = 'failed') AS failed FROM crawl_log GROUP BY 1")
register("st_record_query", lambda t: LV.query_counts(t.query_log), f"WITH {N.QLOG} SELECT lower(query) AS query, count(*) AS n FROM query_log GROUP BY 1")
register("st_record_click", lambda t: LV.crowd_scores(t.click_log, NOW, DAY), f"WITH {N.CLOG}, {CROWD} SELECT * FROM crowd")
register("st_trending_docs", lambda t: LV.trending_documents(LV.crowd_scores(t.click_log, NOW, DAY)), f"WITH {N.CLOG}, {CROWD} SELECT * FROM crowd ORDER BY score DESC, doc_id LIMIT 5")
register("st_active_users", lambda t: LV.active_users(t.query_log, NOW, 3600), f"WITH {N.QLOG} SELECT count(DISTINCT session_id) AS active_users FROM query_log WHERE timestamp > TIMESTAMP '{NOW}' - INTERVAL 1 HOUR AND timestamp <= TIMESTAMP '{NOW}'")
register("st_live_feed", lambda t: LV.feed(t.query_log, t.click_log), f"WITH {N.QLOG}, {N.CLOG} SELECT 'query' AS kind, id, query AS what, timestamp FROM query_log UNION ALL SELECT 'click', id, doc_id::VARCHAR, timestamp FROM click_log ORDER BY timestamp DESC, id DESC LIMIT 100")
register("st_collab_search", lambda t: R.boost_crowd(R.bm25_stored(t.asked, t.queries).drop("bm25"), LV.crowd_scores(t.click_log, NOW, DAY)), f"WITH {N.bm25()}, {N.CLOG}, {CROWD}, j AS (SELECT query_id, hits.doc_id, round(coalesce(crowd.score, 0), 3) AS crowd, round(hits.score + 0.1 * round(coalesce(crowd.score, 0), 3), 3) AS score FROM hits LEFT JOIN crowd ON crowd.doc_id = hits.doc_id) SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM j QUALIFY rank <= 20")
register("st_token_bucket", lambda t: C.token_bucket(t.crawl_log, "domain", rate=0.001, capacity=2.0), f"WITH RECURSIVE {N.WLOG}, o AS MATERIALIZED (SELECT id, domain AS key, epoch_us(timestamp) / 1e6 AS t, row_number() OVER (PARTITION BY domain ORDER BY timestamp, id) AS k FROM crawl_log), b AS (SELECT key, k, id, t, 2.0::DOUBLE AS tok FROM o WHERE k = 1 UNION ALL SELECT o.key, o.k, o.id, o.t, least(2.0, (b.tok - CASE WHEN b.tok >= 1 THEN 1 ELSE 0 END) + (o.t - b.t) * 0.001) FROM b JOIN o ON o.key = b.key AND o.k = b.k + 1) SELECT id, key, tok >= 1 AS granted, CASE WHEN tok >= 1 THEN 0.0 ELSE round((1 - tok) / 0.001, 3) END AS wait_s FROM b")
register("st_heartbeat", lambda t: C.silent(t.crawl_log, seconds=3600.0), f"WITH {N.WLOG}, g AS (SELECT worker_rank, timestamp AS died_at, round((epoch_us(lead(timestamp) OVER (PARTITION BY worker_rank ORDER BY timestamp, id)) - epoch_us(timestamp)) / 1e6, 3) AS gap_s FROM crawl_log) SELECT * FROM g WHERE gap_s > 3600")
register("st_queue_depth", lambda t: LV.queue_depth(t.crawl_log, "1 hour"), f"WITH {N.WLOG} SELECT time_bucket(INTERVAL 1 HOUR, timestamp) AS start, round(avg(depth), 3) AS mean_depth, max(depth) AS most FROM crawl_log GROUP BY 1")
register("st_dup_suppress", lambda t: C.first_results(t.crawl_log), f"WITH {N.WLOG} SELECT * FROM crawl_log QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY timestamp, id) = 1")
register("st_domain_metrics", lambda t: LV.domain_windows(t.crawl_log, "1 day"), f"WITH {N.WLOG} SELECT domain, time_bucket(INTERVAL 1 DAY, timestamp) AS start, count(*) AS fetches, count(*) FILTER (status = 'failed') AS errors, count(*) FILTER (status = 'blocked') AS blocked, round(avg(duration_ms) FILTER (status = 'ok'), 1) AS avg_ms FROM crawl_log GROUP BY 1, 2")

# Crawl -------------------------------------------------------------------------------------------
register("cr_bfs", lambda t: C.bfs(t.edges, t.rows([(1,), (2,)], "node long"), 2), f"WITH {N.EDGES}, h1 AS (SELECT DISTINCT dst AS n FROM edges WHERE src IN (1, 2)), h2 AS (SELECT DISTINCT dst AS n FROM edges WHERE src IN (SELECT n FROM h1)), u AS (SELECT unnest([1, 2])::BIGINT AS node, 0 AS depth UNION ALL SELECT n, 1 FROM h1 UNION ALL SELECT n, 2 FROM h2) SELECT node, min(depth) AS depth FROM u GROUP BY node")
register("cr_enqueue", lambda t: C.admit(t.pages.select("url", (c("page_id") % 6).alias("depth")), t.pages.where("page_id % 7 = 0").select(U.normalise(c("url")).alias("url")), ["example.com", "example.org"]), f"WITH v AS (SELECT page_id, page_id % 6 AS depth, {NORM} AS url, lower({HOST}) AS host FROM pages), a AS (SELECT url, min(depth) + 1 AS depth FROM v WHERE depth < 4 AND (host IN ('example.com', 'example.org') OR host LIKE '%.example.com' OR host LIKE '%.example.org') GROUP BY url) SELECT url, depth FROM a WHERE url NOT IN (SELECT url FROM v WHERE page_id % 7 = 0)")
register("cr_summary", lambda t: L.crawl_summary(t.crawl_log), f"WITH {N.WLOG}, p AS (SELECT worker_rank, count(*) FILTER (status = 'ok') AS pages FROM crawl_log GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (status = 'ok') AS pages, count(*) FILTER (status = 'failed') AS failed, count(DISTINCT worker_rank) AS workers, (SELECT round(max(pages) / min(pages), 2) FROM p WHERE pages > 0) AS imbalance, round(count(*) FILTER (status = 'ok') / ((epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6), 4) AS pages_per_s FROM crawl_log")
register("cr_delay", lambda t: C.polite_times(t.crawl_log, 30.0), f"WITH {N.WLOG}, o AS (SELECT id, domain, epoch_us(timestamp) AS t, row_number() OVER (PARTITION BY domain ORDER BY timestamp, id) - 1 AS k FROM crawl_log) SELECT id, domain, make_timestamp(max(t - k * 30000000) OVER (PARTITION BY domain ORDER BY k) + k * 30000000) AS earliest FROM o")

# Sinks and sources as round trips through the shared folder -----------------------------------------


def _kept(t: Inputs, name: str, df: DataFrame) -> DataFrame:
    path = scratch(t.spark, name)
    TB.append(df, path)
    return t.spark.read.schema(df.schema).parquet(path)


register("src_pagerank", lambda t: TB.ranks(t.spark, _saved_ranks(t)), ORACLES["gr_pagerank"])


def _saved_ranks(t: Inputs) -> str:
    path = scratch(t.spark, "ranks")
    TB.append(G.pagerank(t.edges, least=None), path)
    return path


def _json(t: Inputs, name: str, df: DataFrame) -> DataFrame:
    path = scratch(t.spark, name)
    TB.write_json(df, path)
    return t.spark.read.schema(df.schema).json(path)


register("snk_crawl_log", lambda t: _kept(t, "crawl", t.crawl_log), f"WITH {N.WLOG} SELECT * FROM crawl_log")
register("snk_query_log", lambda t: _kept(t, "query", t.query_log), f"WITH {N.QLOG} SELECT * FROM query_log")
register("snk_click_log", lambda t: _kept(t, "click", t.click_log), f"WITH {N.CLOG} SELECT * FROM click_log")
register("snk_stats_json", lambda t: _json(t, "stats", I.corpus_stats(t.postings)), ORACLES["agg_corpus_stats"])
register("snk_vectors", lambda t: TB.components(_kept(t, "vectors", t.read("embeddings"))), VECTORS)


def _snapshot(t: Inputs) -> DataFrame:
    path = scratch(t.spark, "snapshot")
    TB.save_snapshot(t.pages.select("url", (c("page_id") % 4).alias("depth")), t.pages.select("url"), path)
    front, visited = TB.load_snapshot(t.spark, path)
    return front.select("url", "depth").unionByName(visited.select("url", F.lit(-1).cast("long").alias("depth")))


register("snk_checkpoint", _snapshot, "SELECT url, page_id % 4 AS depth FROM pages UNION ALL SELECT url, -1 FROM pages")

RANKED = f"WITH {N.VOCAB}, top AS (SELECT term, df FROM vocabulary ORDER BY df DESC, term LIMIT 2000)"
register("top_terms_df", lambda t: t.vocabulary.orderBy(c("df").desc(), "term").limit(2000), f"{RANKED} SELECT * FROM top")


def _ranked(t: Inputs) -> DataFrame:
    made = written(I.blocks(t.documents), "postings")
    df = made.where("term is not null").groupBy("term").agg(F.sum("n").alias("df"))
    # 2000 rows, whatever the input: only postings of these terms are unpacked, and travel as places in their order.
    best = df.orderBy(c("df").desc(), "term").limit(2000)
    best = written(best.select("term", (F.row_number().over(R.Window.orderBy(c("df").desc(), "term")) - 1).alias("of_all")), "best-terms")
    names = best.agg(F.sort_array(F.collect_list(F.struct("of_all", "term")))["term"].alias("names"))
    w = R.Window.partitionBy("doc_id").orderBy("of_all")
    found = made.join(F.broadcast(best), "term").select("of_all", F.explode("doc_ids").alias("doc_id"))
    placed = found.select("doc_id", "of_all", F.row_number().over(w).alias("place"), *[F.lead("of_all", k).over(w).alias(f"next{k}") for k in (1, 5)])
    return placed.crossJoin(F.broadcast(names)).select("doc_id", F.get("names", "of_all").alias("term"), "place", *[F.get("names", k).alias(k) for k in ("next1", "next5")])


register("win_rank_terms", lambda t: _ranked(t).select("doc_id", "term", "place"), f"{RANKED} SELECT doc_id, term, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY df DESC, term) AS INTEGER) AS place FROM postings JOIN top USING (term)")
register("win_lead5", lambda t: _ranked(t).select("doc_id", "term", "next1", "next5"), f"{RANKED} SELECT doc_id, term, lead(term, 1) OVER w AS next1, lead(term, 5) OVER w AS next5 FROM postings JOIN top USING (term) WINDOW w AS (PARTITION BY doc_id ORDER BY df DESC, term)")
register("agg_click_count", lambda t: R.click_counts(t.click_log, t.documents.crossJoin(t.rows(CQROWS, "query_id long, q string")), t.rows(CQROWS, "query_id long, q string")), f"WITH {N.CLOG}, {CQ} SELECT query_id, doc_id, count(*) AS clicks FROM cq JOIN click_log ON contains(lower(query), lower(string_split_regex(trim(q), '\\s+')[1])) WHERE doc_id IN (SELECT doc_id FROM documents) GROUP BY ALL")
register("set_distinct_session", lambda t: t.query_log.select("session_id", F.lower(F.trim("query")).alias("q")).distinct(), f"WITH {N.QLOG} SELECT DISTINCT session_id, lower(trim(query)) AS q FROM query_log")
register("set_union_ids", lambda t: t.query_log.select(c("session_id").alias("s")).union(t.click_log.select("session_id")).distinct(), f"WITH {N.QLOG}, {N.CLOG} SELECT session_id AS s FROM query_log UNION SELECT session_id FROM click_log")
register("flt_budget", lambda t: C.admit(t.pages.select("url", (c("page_id") % 6).alias("depth")), t.pages.where("page_id < 0").select("url"), None, budget=50), f"WITH v AS (SELECT page_id % 6 AS depth, {NORM} AS url FROM pages) SELECT url, min(depth) + 1 AS depth FROM v WHERE depth < 4 GROUP BY url ORDER BY depth, url LIMIT 50")


def _engine(t: Inputs):
    from .api import Engine

    return Engine(t.store, t.page_docs, None, t.query_log, t.click_log, t.crawl_log)


register("ir_search_page", lambda t: _engine(t).page(t.queries))
register("ir_search_log", lambda t: _engine(t).log_of(_engine(t).search(t.queries, 20), t.queries, NOW), f"WITH {N.bm25()} SELECT q AS query, count(rank) AS result_count, TIMESTAMP '{NOW}' AS timestamp, '' AS session_id FROM queries LEFT JOIN hits USING (query_id) GROUP BY query_id, q")

from . import parts  # noqa: E402, F401 - registers the operators that are parts of the above
