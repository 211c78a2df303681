import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import scores as S
from orrery.functions import text as T
from orrery.functions import urls as U
from orrery.operators import crawl as C
from orrery.operators import federated as FD
from orrery.operators import graph as G
from orrery.operators import index as I
from orrery.operators import logs as L
from orrery.operators import rank as R
from orrery.operators import sketch as SK
from orrery.operators import suggest as SG
from orrery.operators.store import Store
from orrery.sources import tables as TB


def search(spark, docs, query, **options):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame([(1, query)], "query_id long, q string")
    return R.bm25(I.postings(d), I.lengths_of(d), d.agg(F.count("*").alias("n")), q, **options).orderBy("rank").collect()


PAPERS = [(0, "glacier melting northern rivers"), (1, "violin strings maker workshop"), (2, "glacier northern weather")]


def test_bm25_prefers_higher_frequency(spark):
    assert search(spark, [(0, "otter otter river otter"), (1, "otter bank")], "otter")[0].doc_id == 0


def test_bm25_finds_only_documents_with_a_term(spark):
    rows = search(spark, PAPERS, "glacier northern")
    assert {r.doc_id for r in rows} == {0, 2} and all(r.score >= 0 for r in rows)
    assert search(spark, PAPERS, "unknownterm") == [] and search(spark, PAPERS, "an of") == []
    assert len(search(spark, PAPERS, "glacier", top_n=1)) == 1


def test_index_merge_remove_and_nested(spark):
    d = spark.createDataFrame(PAPERS, "doc_id long, text string")
    post = I.postings(d)
    assert {(r.term, r.doc_id, r.tf) for r in I.merge(post, post).collect()} == {(r.term, r.doc_id, 2 * r.tf) for r in post.collect()}
    gone = I.remove(post, spark.createDataFrame([(1,)], "doc_id long"))
    assert {r.doc_id for r in gone.collect()} == {0, 2}
    row = I.nested(post).where("term = 'northern'").first()
    assert row.doc_ids == [0, 2] and row.tf == {0: 1, 2: 1} and row.df == 2


def test_incremental_counts_nothing_twice(spark):
    d = spark.createDataFrame(PAPERS, "doc_id long, text string")
    old = d.where("doc_id = 0")
    post, meta = I.incremental(d, I.postings(old), old.select("doc_id", F.lit(4).cast("long").alias("term_count")))
    assert sorted(post.collect()) == sorted(I.postings(d).select("term", "doc_id", "tf").collect())
    assert {r.doc_id: r.term_count for r in meta.collect()} == {0: 4, 1: 4, 2: 3}


def test_nested_rows_by_ranges_hold_the_same(spark):
    post = spark.createDataFrame([("a", i, 1 + i % 3) for i in range(25)] + [("b", 7, 2)], "term string, doc_id long, tf long")
    rows = I.nested(post, span=10).collect()
    assert sorted((r.term, r.df) for r in rows) == [("a", 5), ("a", 10), ("a", 10), ("b", 1)]
    assert {(r.term, d, r.tf[d]) for r in rows for d in r.doc_ids} == {tuple(r) for r in post.collect()}


def vocabulary(spark, rows):
    return spark.createDataFrame(rows, "term string, df long")


def test_completion_orders_by_frequency(spark):
    v = vocabulary(spark, [("lantern", 100), ("landing", 2), ("language", 50), ("zebra", 9)])
    p = spark.createDataFrame([("lan",), ("LAN",), ("q",), ("",)], "prefix string")
    rows = SG.complete(v, p).orderBy("prefix", "rank").collect()
    assert [r.term for r in rows if r.prefix == "lan"] == ["lantern", "language", "landing"]
    assert len([r for r in rows if r.prefix == ""]) == 4 and not [r for r in rows if r.prefix == "q"]
    assert SG.complete(v, p, n=2).where("prefix = 'lan'").count() == 2
    assert SG.complete(v, p, least=2).where("prefix = ''").count() == 0


@pytest.mark.parametrize(("a", "b", "d"), [("lantern", "lantern", 0), ("lantarn", "lantern", 1), ("lanttern", "lantern", 1), ("lanern", "lantern", 1), ("lantren", "lantern", 2)])
def test_edit_distance(spark, a, b, d):
    assert spark.range(1).select(F.levenshtein(F.lit(a), F.lit(b))).first()[0] == d


def test_spelling(spark):
    v = vocabulary(spark, [(w, 10) for w in ("mountain", "railway", "harbour", "garden")])
    words = spark.createDataFrame([("mountan",), ("garden",), ("ab",), ("zzzzz",), ("graden",)], "word string")
    assert {r.word: r.correction for r in SG.correct(v, words).collect()} == {"mountan": "mountain"}
    q = spark.createDataFrame([(1, "mountan railwy"), (2, "garden")], "query_id long, q string")
    rows = {r.query_id: (r.corrected, r.n_fixed) for r in SG.correct_queries(v, q).collect()}
    assert rows == {1: ("mountain railway", 2), 2: ("garden", 0)}


def test_curated_synonyms_come_first(spark):
    v = vocabulary(spark, [("parallel", 5), ("concurrent", 4), ("nodes", 3)])
    cooc = spark.createDataFrame([("distributed", "nodes", 9), ("distributed", "rare", 2)], "t1 string, t2 string, n long")
    terms = spark.createDataFrame([("Distributed",)], "term string")
    curated = spark.createDataFrame([("distributed", 0, "parallel"), ("distributed", 1, "concurrent"), ("distributed", 2, "decentral")], "term string, pos int, synonym string")
    syn = SG.synonyms(terms, v, cooc, curated)
    assert [r.synonym for r in syn.orderBy("rank").collect()] == ["parallel", "concurrent", "nodes"]
    q = spark.createDataFrame([(1, "distributed x"), (2, "ab")], "query_id long, q string")
    assert {r.query_id: r.expanded for r in SG.expand(q, syn).collect()} == {1: "distributed x parallel concurrent nodes", 2: "ab"}


def test_ring_spreads_keys_evenly_and_stably(spark):
    assert SK.ring(spark, [1, 2, 3], 100).count() == 300
    urls = spark.createDataFrame([(f"https://site{i}.example/page{j}", f"site{i}.example") for i in range(50) for j in range(10)], "url string, host string")
    ring = SK.ring(spark, [1, 2, 3, 4, 5, 6])
    routed = SK.route(urls, "url", ring)
    counts = [r["count"] for r in routed.groupBy("node").count().collect()]
    assert sum(counts) == 500 and len(counts) == 6 and all(0.3 * 500 / 6 <= n <= 3 * 500 / 6 for n in counts)
    assert SK.route(urls, "host", ring).groupBy("host").agg(F.count_distinct("node").alias("n")).where("n > 1").count() == 0


@pytest.mark.parametrize(("capacity", "fp", "m", "k"), [(1_000_000, 0.001, 14_377_587, 9), (10_000, 0.01, 95_850, 6), (500_000, 0.001, 7_188_793, 9), (10_000_000, 0.001, 143_775_875, 9)])
def test_bloom_sizing(capacity, fp, m, k):
    assert SK.bloom_size(capacity, fp) == (m, k)


def test_bloom_positions_are_those_of_big_integers(spark):
    import hashlib

    m, k = SK.bloom_size(10_000, 0.01)
    got = spark.createDataFrame([("https://é.example/x",)], "u string").select(SK.bloom_positions(F.col("u"), m, k)).first()[0]
    raw = "https://é.example/x".encode()
    a, b = int(hashlib.sha256(raw).hexdigest(), 16), int(hashlib.md5(raw).hexdigest(), 16)
    assert got == [(a + i * b) % m for i in range(k)]


def test_push_sum_of_seven_nodes(spark):
    values = spark.createDataFrame([(i, 500.0 if i else 0.0) for i in range(7)], "node long, value double")
    got = {r.node: r["sum"] for r in SK.push_sum(values, 7, 4).collect()}
    assert got[0] == 2843.75 and len(got) == 7


def test_gossip_spreads_all_bits_by_doubling(spark):
    bits = spark.createDataFrame([(i, i) for i in range(6)] + [(0, 0)], "node long, pos long")
    got = {(r.round, r.node): (r.n_bits, r.new_bits) for r in SK.gossip(bits, 6, 3).collect()}
    assert all(got[0, i] == (1, 1) and got[1, i] == (2, 1) and got[2, i] == (4, 2) and got[3, i] == (6, 2) for i in range(6))


def test_routes_are_those_of_a_sorted_ring(spark):
    import bisect
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    for nodes, virtual, digits in (([1, 2, 3], 150, 3), ([7], 1, 2), ([1, 2], 2, 1)):
        ring = sorted((md5(f"{n}-vnode-{v}"), n) for n in nodes for v in range(virtual))
        places = [p for p, _ in ring]
        keys = [f"k{i}" for i in range(600)]
        df = spark.createDataFrame([(k, "x", 1) for k in keys], "k string, ring_hash string, node long")
        got = SK.route(df, "k", SK.ring(spark, nodes, virtual), digits=digits)
        assert got.columns == ["k", "ring_hash", "node"]
        assert {r.k: r.node for r in got.collect()} == {k: ring[bisect.bisect_left(places, md5(k)) % len(ring)][1] for k in keys} and got.count() == len(keys)


def test_stored_search_equals_search_of_postings(spark):
    d = spark.createDataFrame([*PAPERS, (70, None), (71, ""), (72, "the of")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "glacier northern"), (2, "violin violin nothing"), (3, None), (4, "")], "query_id long, q string")
    store = Store.build(d)
    n = d.agg(F.count("*").alias("n"))
    rows = lambda df: sorted(map(tuple, df.select("query_id", "doc_id", "rank").collect()))
    assert rows(R.bm25_stored(store, q)) == rows(R.bm25(I.postings(d), I.lengths_of(d), n, q)) != []
    assert rows(R.tfidf_stored(store, q)) == rows(R.tfidf_search(*R.tfidf(d), q))
    per = lambda df: sorted(map(tuple, df.select("query_id", "shard_id", "doc_id", "score").collect()))
    assert per(FD.shard_search_stored(store, 2, q)) == per(FD.shard_search(FD.shard(I.postings(d), 2), q)) != []
    assert "PartitionFilters: [isnotnull(slot" in R.bm25_stored(store, q)._jdf.queryExecution().toString() and "dynamicpruning" in R.bm25_stored(store, q)._jdf.queryExecution().toString()
    empty = Store.build(d.limit(0))
    assert R.bm25_stored(empty, q).count() == 0 and R.tfidf_stored(empty, q).count() == 0


def test_percentiles_are_those_of_sorted_lists(spark):
    import random

    rng = random.Random(3)
    rows = [("a", float(rng.randint(0, 40))) for _ in range(333)] + [("b", 7.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.p50, r.p95, r.p99) for r in L.percentiles(df, "k", "v", (50, 95, 99)).collect()}
    a = sorted(v for k, v in rows if k == "a")
    assert got == {"a": tuple(a[max(0, int(len(a) * p / 100) - 1)] for p in (50, 95, 99)), "b": (7.0, 7.0, 7.0)}


def test_robots_tables_and_delays(spark):
    rules = spark.createDataFrame([("a", "User-agent: *\nCrawl-delay: 2\n"), ("b", "User-agent: x\nCrawl-delay: 9"), ("c", None), ("d", "User-agent: *\nCrawl-delay: 2")], "domain string, rules string")
    assert {r.domain: (r.delay, r.free) for r in TB.robots(rules, ["d"]).collect()} == {"a": (2.0, False), "b": (0.5, False), "c": (0.5, False), "d": (0.5, True)}


def test_idle_workers_steal_and_dead_ones_are_rehomed(spark):
    queue = spark.createDataFrame([(str(i), "long" if i < 12 else "short", 1) for i in range(18)] + [("x", "z", 2)], "url string, domain string, worker_rank long")
    workers = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "worker_rank long")
    assert sorted(tuple(r) for r in C.steal_plan(queue, workers).collect()) == [(3, 1, "long", False), (4, 1, "long", False)]
    assert C.steal_plan(queue.limit(5), workers).count() == 0
    assert {r.whole for r in C.steal_plan(queue, workers, over=3, whole_below=13).collect()} == {True}
    owners = spark.createDataFrame([(f"d{i}", f"http://d{i}/", i % 3 + 1) for i in range(30)], "domain string, url string, owner long")
    after = {r.domain: r.owner for r in C.rehome(owners, SK.ring(spark, [1, 2, 3]), 2).collect()}
    assert len(after) == 30 and 2 not in after.values() and all(after[f"d{i}"] == i % 3 + 1 for i in range(30) if i % 3 != 1)


def test_the_most_overdue_task_without_result_is_speculated(spark):
    late = spark.createDataFrame([(1, "a", 5.0), (2, "a", 9.0), (3, "b", 7.0)], "doc_id long, domain string, overdue_ms double")
    done = spark.createDataFrame([(2,), (2,)], "doc_id long")
    assert [r.doc_id for r in L.speculate(late, done).collect()] == [3]
    issued, results = spark.createDataFrame([(1, 4), (2, 5)], "doc_id long, spec_rank long"), spark.createDataFrame([(1, 4), (2, 6)], "doc_id long, worker_rank long")
    assert tuple(L.speculation_stats(issued, results).first()) == (2, 1, 50.0)


def test_pagerank_by_hand(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (3, 1)], "src long, dst long")
    r = dict.fromkeys((1, 2, 3), 1 / 3)
    for _ in range(20):
        r = {1: 0.05 + 0.85 * (r[2] + r[3]), 2: 0.05 + 0.85 * r[1], 3: 0.05}
    got = {x.doc_id: x.score for x in G.pagerank(edges, least=None).collect()}
    assert got == {n: round(x / max(r.values()), 6) for n, x in r.items()}
    assert G.pagerank(edges.limit(0)).count() == 0


def test_link_graph_drops_loops_duplicates_and_unknown_links(spark):
    pages = spark.createDataFrame([(0, "a", ["b", "b", "a", "x"]), (1, "b", ["a"]), (2, "b", [])], "doc_id long, url string, links array<string>")
    assert {(r.src, r.dst) for r in G.link_graph(pages).collect()} == {(0, 2), (1, 0)}


def test_token_bucket(spark):
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "a", "2024-01-01 00:00:00.01"), (3, "a", "2024-01-01 00:00:00.02"), (4, "a", "2024-01-01 00:00:00.17"), (5, "b", "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id long, k string, t string").select("id", "k", F.to_timestamp("t").alias("timestamp"))
    got = {r.id: r for r in C.token_bucket(df, "k", rate=10.0, capacity=2.0).collect()}
    assert [got[i].granted for i in (1, 2, 3, 4, 5)] == [True, True, False, True, True] and got[3].wait_s > 0
    slow = {r.id: r for r in C.token_bucket(df, "k", rate=0.1, capacity=1.0).collect()}
    assert slow[1].granted and not slow[2].granted and slow[2].wait_s > 9


def test_parse_page():
    html = "<html><head><title> T &amp; x </title><style>p{}</style></head><body><script>var a='</p>'</script><p>short<p>" + "long " * 20 + "</p><a href=' /a#f'>l</a><a href='mailto:x'>m</a><a href='http://o.example/b'>n</a></body></html>"
    title, text, snippet, links = U.parse(html, "https://h.example/d/")
    assert title == "T & x" and text.startswith("T & x short long") and "var a" not in text
    assert snippet.startswith("long") and links == ["https://h.example/a", "http://o.example/b"]
    assert U.parse(None, None) == ("No title", "", "", [])


def test_urls_and_text(spark):
    df = spark.createDataFrame([(" HTTPS://Ex.COM:80/A/b/?q=1#f",), ("http://u@h.example",), ("nothing",)], "u string")
    rows = df.select(U.normalise(F.col("u")).alias("n"), U.domain_of(F.trim("u")).alias("d"), U.in_domains(F.trim("u"), ["h.example"]).alias("ok")).collect()
    assert rows[0].n == "https://ex.com:80/A/b" and rows[0].d == "Ex.COM:80" and rows[1].n == "http://u@h.example/" and rows[2].d == "unknown"
    t = spark.range(1).select(T.highlight(F.lit("A.b ab"), F.lit("a.b zz")).alias("h"), T.highlight(F.lit("x"), F.lit("a")).alias("same"), T.tokens(F.lit("The Café can't PARSE")).alias("t")).first()
    assert t.h == "<mark>A.b</mark> ab" and t.same == "x" and t.t == ["caf", "can", "parse"]


def test_boosts_and_percentiles(spark):
    df = spark.createDataFrame([(n,) for n in (0, 1, 5, 20)], "n long")
    assert [round(r[0], 3) for r in df.select(S.click_boost(F.col("n"))).collect()] == [1.0, 1.069, 1.179, 1.304]
    assert [round(r[0], 3) for r in spark.createDataFrame([(0,), (1,), (10,)], "p long").select(S.click_weight(F.col("p"))).collect()] == [2.0, 1.262, 0.558]
    v = spark.range(1, 31).agg(F.collect_list(F.col("id").cast("double")).alias("v"))
    assert v.select(S.percentile_floor(F.col("v"), 95)).first()[0] == 28.0
    assert round(spark.range(1).select(S.decayed(F.lit(1.0), F.lit(300))).first()[0], 9) == 0.5


def test_shards_are_ranges_and_merge_keeps_each_document_once(spark):
    d = spark.createDataFrame([(i, "alpha beta" if i % 2 else "alpha gamma gamma") for i in range(10)], "doc_id long, text string")
    sh = FD.shard(I.postings(d), 3)
    assert {r.doc_id: r.shard_id for r in sh.collect()} == {i: i // 4 for i in range(10)}
    q = spark.createDataFrame([(1, "alpha gamma")], "query_id long, q string")
    rows = FD.merge_shards(FD.shard_search(sh, q)).collect()
    assert sorted(r.doc_id for r in rows) == list(range(10))


def test_upserts_and_metadata(spark):
    schema = "doc_id long, url string, crawled_at timestamp"
    import datetime as dt

    old = spark.createDataFrame([(1, "http://a.example/", dt.datetime(2024, 1, 1)), (2, "http://b.example/", dt.datetime(2024, 1, 1))], schema)
    new = spark.createDataFrame([(3, "http://a.example/", dt.datetime(2024, 1, 2))], schema)
    assert {(r.doc_id, r.domain) for r in TB.upsert_documents(old, new).collect()} == {(2, "b.example"), (3, "a.example")}
    meta = spark.createDataFrame([(1, 5), (2, 6)], "doc_id long, term_count long")
    assert {tuple(r) for r in TB.mark_indexed(meta, spark.createDataFrame([(2, 9), (4, 1)], "doc_id long, term_count long")).collect()} == {(1, 5), (2, 9), (4, 1)}


def test_frontier(spark):
    links = spark.createDataFrame([("http://A.example/x/", 0), ("http://a.example/x", 1), ("http://b.example/", 0), ("http://a.example/y", 9)], "url string, depth int")
    seen = spark.createDataFrame([("http://a.example/z",)], "url string")
    assert [tuple(r) for r in C.admit(links, seen, ["a.example"]).collect()] == [("http://a.example/x", 1)]
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src long, dst long")
    assert {tuple(r) for r in C.bfs(edges, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0), (2, 1), (3, 2)}


def test_map_reduce_is_generic(spark):
    import pandas as pd

    df = spark.createDataFrame([("a b a",), ("b",)], "line string")
    out = L.map_reduce(df, lambda rows: pd.DataFrame([(w, 1) for line in rows["line"] for w in line.split()], columns=["key", "n"]), lambda rows: pd.DataFrame({"key": [rows["key"].iloc[0]], "n": [rows["n"].sum()]}), "key string, n long", "key string, n long")
    assert {r.key: r.n for r in out.collect()} == {"a": 2, "b": 2}


def test_vector_search_is_exact(spark):
    v = spark.createDataFrame([(i, [math.cos(i), math.sin(i)]) for i in range(8)], "vec_id long, embedding array<double>")
    q = v.where("vec_id = 3").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector"))
    rows = R.vector_search(v, q, top_n=3).orderBy("rank").collect()
    assert rows[0].doc_id == 3 and rows[0].similarity == 1.0
    assert [r.doc_id for r in rows] == sorted(range(8), key=lambda i: (-round(math.cos(i - 3), 4), i))[:3]


def test_every_fiftieth_vector_is_a_query_against_all_and_agrees_with_the_sql(spark):
    import duckdb
    import numpy as np
    from conftest import SF
    from orrery.plans import registry

    found = registry.QUERIES["ir_vector_search"](spark, SF).toPandas()
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert set(found.query_id) == set(range(0, rows, 50)) and len(found) == found.query_id.nunique() * min(20, rows)
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    sql = con.execute(registry.ORACLES["ir_vector_search"]).df()
    tuples = lambda df: {(int(r.query_id), int(r.doc_id), float(r.similarity), int(r.rank)) for r in df.itertuples()}
    assert tuples(found) == tuples(sql)
    # Small blocks: the best of all blocks are merged, ties by doc_id.
    x = np.random.default_rng(2).integers(-1, 2, (50, 3)).astype(float)
    x[x.any(axis=1) == 0] = 1
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "vec_id long, embedding array<double>")
    got = R.vector_search(v, v.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q_vector")), top_n=4, rows=7).collect()
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    want = {(i, j, k + 1) for i in range(50) for k, j in enumerate(sorted(range(50), key=lambda j: (-round(float(unit[i] @ unit[j]), 4), j))[:4])}
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == want


def test_all_requests_of_an_engine(spark):
    import datetime as dt

    from orrery.plans.api import Engine

    t0 = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([*PAPERS, (3, "glacier glacier harbour weather")], "doc_id long, text string")
    meta = spark.createDataFrame([(i, f"http://x/{i}", f"title {i}", f"glacier text {i}") for i in range(4)], "doc_id long, url string, title string, snippet string")
    queries = spark.createDataFrame([(i, ("glacier", "Glacier", "none")[i % 3], 0 if i % 3 == 2 else 2, t0 + dt.timedelta(minutes=i), f"s{i % 2}") for i in range(6)], "id long, query string, result_count long, timestamp timestamp, session_id string")
    clicks = spark.createDataFrame([(9, "glacier", 2, 1, t0, "s0")], "id long, query string, doc_id long, position long, timestamp timestamp, session_id string")
    log = spark.createDataFrame([(1, 1, 1, "ok", 3.0, "d", 0, t0)], "id long, doc_id long, worker_rank long, status string, duration_ms double, domain string, depth long, timestamp timestamp")
    ranks = spark.createDataFrame([(0, 1.0), (3, 0.5)], "doc_id long, score double")
    e = Engine(Store.build(docs), meta, ranks, queries, clicks, log)
    q = spark.createDataFrame([(1, "glacier"), (2, "glacer")], "query_id long, q string")
    best = lambda df, i=1: [r.doc_id for r in df.where(f"query_id = {i}").orderBy("rank").collect()]
    assert best(e.search(q)) == [0, 3, 2] and best(e.search(q), 2) == []
    assert [r.term for r in e.suggest(spark.createDataFrame([("gla",), ("g",)], "prefix string")).collect()] == ["glacier"]
    assert e.spell(spark.createDataFrame([("glacer",)], "word string")).first().correction == "glacier"
    assert {r.corrected for r in e.correct(q).collect()} == {"glacier"}
    assert {r.expanded for r in e.expand(q).collect()} >= {"glacer"}
    # The misspelt query finds what the other one does, and the clicked document is lifted.
    page = e.page(q)
    assert best(page) == best(page, 2) and set(best(page)) == {0, 2, 3} and page.where("snippet like '%<mark>glacier</mark>%'").count() == 6
    vectors = R.encode_words(docs)
    with_vectors = Engine(e.store, meta, ranks, vectors=vectors).hybrid(q.where("query_id = 1"))
    assert best(with_vectors)[0] in (0, 3) and with_vectors.where("semantic > 0").count() > 0
    assert tuple(e.stats().first()) == (4, docs.select(F.explode(F.split("text", " "))).distinct().count())
    assert e.document(3).first().score == 0.5 and e.document(2).first().score == 0.0
    assert e.metrics().first().fetches == 1 and {k: v.count() for k, v in e.analytics(str(t0 + dt.timedelta(hours=1))).items()} == {"top": 3, "zero": 1, "clicked": 1, "hourly": 1}
    assert {k: v.count() for k, v in e.log_analysis().items()} == {"top_terms": 2, "position_bias": 1, "zero_results": 1, "hourly_volume": 1}
    assert set(best(e.federated(q, 2))) == {0, 2, 3} and set(best(e.collaborative(q, str(t0)))) == {0, 2, 3}
    post, done = e.reindex(spark.createDataFrame([(0, 4), (1, 4)], "doc_id long, term_count long"))
    assert sorted((r.term, r.doc_id) for r in post.collect()) == sorted((r.term, r.doc_id) for r in I.postings(docs).collect()) and done.count() == 4
    assert {r.result_count for r in e.log_of(e.search(q), q, str(t0)).collect()} == {0, 3}


def test_lists_of_an_index_are_never_searched(spark, tmp_path):
    post = spark.createDataFrame([("a", i, 1 + i % 3) for i in range(25)] + [("b", 7, 2)], "term string, doc_id long, tf long")
    for made in (I.lists(post), I.lists(post, span=10), I.nested(post, span=10)):
        TB.write_index_json(made, str(tmp_path / "i"))
        assert sorted(TB.index_json(spark, str(tmp_path / "i")).collect()) == sorted(post.collect())
    from conftest import SF
    from orrery.plans import registry

    assert "element_at" not in registry.QUERIES["agg_index"](spark, SF)._jdf.queryExecution().toString()


def test_postings_count_rows_of_one_doc_id_together_and_take_odd_texts(spark):
    rows = [(1, "Otter otter, river"), (1, "otter the"), (2, None), (3, ""), (4, "été RIVERbank_river a1bcd İster"), (None, "moss"), (None, "moss fern")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    slow = I.emit(d).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    key = lambda r: tuple(map(str, r))
    assert sorted(I.postings(d).collect(), key=key) == sorted(slow.collect(), key=key) != []
    assert {(r.doc_id, r.dl) for r in I.sized_postings(d).collect()} == {(1, 4), (4, 4), (None, 3)}
    once = d.where("doc_id > 1")
    assert sorted(I.postings(once).collect()) == sorted(slow.where("doc_id > 1").collect()) and "Exchange" not in I.postings(once)._jdf.queryExecution().toString()


def test_words_are_cut_in_slices_of_a_column():
    import pyarrow as pa
    from orrery.operators.counting import LETTERS, counted, words

    texts = pa.array(["abc the\n", "abc\n", "\n", "xyz abc xyz\n"])
    row, number, found = words(texts.slice(1), LETTERS, 3, ("the",))
    assert [(int(r), found[int(k)].as_py()) for r, k in zip(row, number)] == [(0, "abc"), (2, "xyz"), (2, "abc"), (2, "xyz")]
    assert [x.tolist() for x in counted(number, row, 3)] == [[0, 0, 1], [0, 2, 2], [1, 1, 2]]
    assert len(words(texts.slice(2, 1), LETTERS, 3, ())[2]) == 0


def test_tfidf_lists_only_pairs_that_can_be_kept_and_loses_none(spark):
    import random
    from collections import Counter

    random.seed(5)
    pool = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(random.choice(pool) + (" moss fern" if random.random() < 0.3 else "") for _ in range(60))) for i in range(30)] + [(7, "moss fern, moss"), (31, None), (32, "the of")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    tf = Counter()
    for i, text in rows:
        found = [w for w in (text or "").lower().replace(",", " ").split() if w not in T.ENGLISH]
        tf.update([(i, f) for f in found + [f"{a} {b}" for a, b in zip(found, found[1:])]])
    total, df = Counter(), Counter(f for _, f in tf)
    for (_, f), n in tf.items():
        total[f] += n
    for most in (20, 5000):
        best = sorted((f for f in total if df[f] >= 2), key=lambda f: (-total[f], f))[:most]
        idf = {f: math.log((1 + len(rows)) / (1 + df[f])) + 1 for f in best}
        w = {k: (1 + math.log(n)) * idf[k[1]] for k, n in tf.items() if k[1] in idf}
        norm = Counter()
        for (i, _), x in w.items():
            norm[i] += x * x
        weights, kept = R.tfidf(d, max_features=most)
        assert {r.feature: round(r.idf, 9) for r in kept.collect()} == {f: round(x, 9) for f, x in idf.items()}
        assert {(r.doc_id, r.feature): round(r.weight, 9) for r in weights.collect()} == {k: round(x / math.sqrt(norm[k[0]]), 9) for k, x in w.items()}
    assert "Exchange" not in R.tfidf(d.where("doc_id <> 7"))[0]._jdf.queryExecution().toString()


def test_cooccurrence_counts_neighbours_across_batches(spark):
    import random
    from collections import Counter

    random.seed(3)
    rows = [(t, d, 1) for d in [*range(12), None] for t in random.sample("abcdefghijklmnop", random.randint(1, 14))]
    df = Counter(t for t, _, _ in rows)
    order = sorted(df, key=lambda t: (-df[t], t))[:10]
    want = Counter()
    for d in {d for _, d, _ in rows}:
        mine = [t for t in order if (t, d, 1) in rows]
        for i, a in enumerate(mine):
            for b in mine[i + 1 : i + 4]:
                want[a, b] += 1
                want[b, a] += 1
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = SG.cooccurrence(spark.createDataFrame(rows, "term string, doc_id long, tf long"), n_terms=10, window=3).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.t1, r.t2): r.n for r in got} == want and len(got) == len(want)


def test_ranked_terms_shuffle_only_the_best(spark):
    from conftest import SF
    from orrery.plans import registry

    for name in ("win_rank_terms", "win_lead5"):
        plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_pages_are_parsed_some_at_a_time():
    import pyarrow as pa

    pages = ["<title>t</title>" + "x" * 300_000, None, "<a href='/b'>l</a>", "y" * 900_000, ""]
    parts = list(U._parsed(pa.array(pages), pa.array(["https://h.example/"] * 5)))
    assert len(parts) > 1 and [tuple(r.values()) for p in parts for r in p.to_pylist()] == [U.parse(h, "https://h.example/") for h in pages]


def test_pagerank_of_many_blocks_and_other_kinds_of_nodes(spark, monkeypatch):
    monkeypatch.setattr(G, "BLOCK", 7)
    monkeypatch.setattr(G, "PACKED", 50)
    monkeypatch.setattr(G, "SHARE", 200)
    rng = np.random.default_rng(5)
    pairs = sorted({(int(a) * 10**15 - 4 * 10**16, int(b) * 10**15 - 4 * 10**16) for a, b in rng.integers(0, 80, (900, 2)) if a != b} | {(k, -4 * 10**16) for k in range(1, 40)})
    nodes = sorted({x for p in pairs for x in p})
    degree = Counter(a for a, _ in pairs)
    r = dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(20):
        got = dict.fromkeys(nodes, 0.0)
        for a, b in pairs:
            got[b] += r[a] / degree[a]
        r = {x: 0.15 / len(nodes) + 0.85 * got[x] for x in nodes}
    want = {x: round(v / max(r.values()), 6) for x, v in r.items()}
    edges = spark.createDataFrame(pairs, "src long, dst long")
    assert {x.doc_id: x.score for x in G.pagerank(edges, least=None).collect()} == pytest.approx(want, abs=1.1e-6)
    names = spark.createDataFrame([(f"p{a}", f"p{b}") for a, b in pairs], "src string, dst string")
    assert {x.doc_id: x.score for x in G.pagerank(names, least=None).collect()} == pytest.approx({f"p{k}": v for k, v in want.items()}, abs=1.1e-6)
    few = {x.doc_id: x.score for x in G.pagerank(edges, spark.createDataFrame([(nodes[0],), (nodes[1],), (99,)], "doc_id long"), least=None).collect()}
    assert set(few) == {nodes[0], nodes[1], 99} and few[99] == min(few.values())
    assert {x.doc_id for x in G.pagerank(spark.createDataFrame([(1, 2), (None, 2), (3, None)], "src int, dst int"), least=1e-6).collect()} == {1, 2, 3, None}


def test_pages_parsed_in_pieces_are_those_parsed_one_by_one(spark):
    pages = [(i, f"https://h.example/{i}/", f"<title>t</title><p>{'word ' * (i * 997 % 9000)}</p><a href='x{i}'>") for i in range(150)] + [(None, None, None), (7, "u", "")]
    df = spark.createDataFrame(pages, "doc_id long, base string, html string").coalesce(1)
    got = sorted((tuple(r) for r in U.parse_pages(df, "html", "base").collect()), key=repr)
    assert got == sorted(((i, b, *U.parse(h, b)[1:]) for i, b, h in pages), key=repr)
    assert U.parse_pages(df.limit(0), "html", "base").count() == 0


def test_the_stored_index_gets_its_postings_without_a_shuffle(spark, tmp_path):
    spark.createDataFrame([(1, "one two two"), (2, "two three")], "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    plan = I.postings(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and Store.build(docs).postings.where("term = 'two'").agg(F.sum("tf")).first()[0] == 3


def test_the_stored_index_keeps_postings_in_lists_and_unpacks_the_same(spark):
    rows = [(1, "Otter otter, river"), (1, "otter the"), (2, None), (3, ""), (5, "river moss river"), (None, "moss"), (None, "moss fern")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    store, key = Store.build(d), lambda r: tuple(map(str, r))
    want = I.sized_postings(d).select("term", "doc_id", "tf", "dl").collect()
    assert sorted(store.postings.select("term", "doc_id", "tf", "dl").collect(), key=key) == sorted(want, key=key) != []
    assert {tuple(r) for r in store.lengths.collect()} == {(1, 4, 2), (5, 3, 2), (None, 3, 2)}
    assert {(r.term, r.df) for r in store.vocabulary.collect()} == {("otter", 1), ("river", 2), ("moss", 2), ("fern", 1)}
    many = Store.build(spark.createDataFrame([(i, "one two three") for i in range(100)], "doc_id long, text string").coalesce(1))
    assert many.blocks.count() == 3 and many.postings.count() == 300


def test_ranked_terms_travel_as_places_and_are_those_of_the_sql(spark, tmp_path):
    import duckdb
    from orrery.plans import registry

    rows = [(1, "otter otter river moss fern reed lake"), (1, "otter birch"), (2, None), (3, ""), (4, "lake river river the"), (5, "moss")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("win_lead5", "win_rank_terms"):
        found = registry.QUERIES[name](spark, str(tmp_path))
        want = con.execute(registry.ORACLES[name])
        columns = [c[0] for c in want.description]
        got = [tuple(r) for r in found.select(columns).collect()]
        assert len(got) == 10 and set(got) == set(want.fetchall())
        assert "Sort [doc_id" in (plan := found._jdf.queryExecution().executedPlan().toString()) and "of_all#" in plan.split("Sort [doc_id")[1].split("]")[0]


@pytest.mark.parametrize("name", ["win_norm_max", "ir_bm25", "fd_merge", "win_shard_topk"])
def test_a_search_lists_postings_of_its_own_terms_only_and_finds_those_of_the_sql(spark, tmp_path, name):
    import duckdb
    from orrery.plans import inputs, registry

    rows = [(1, "tion otter, tion ing"), (1, "ing river"), (2, None), (3, ""), (4, "ther thon the"), (5, "moss"), (8, "Thth moss ble fern"), (9, "station ither"), (10, "tion"), (11, "tion")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in want.description]
    key = (spark.sparkContext.applicationId, str(tmp_path))
    got = registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 3 and key not in inputs._STORES
    made = inputs._ASKED[key]
    assert {r.term for r in made.blocks.collect()} == {r.term for r in made.vocabulary.collect()} == {"tion", "ing", "ther", "thon", "ble", "thth"}
    assert {(r.doc_id, r.dl) for r in made.lengths.collect()} == {(1, 6), (4, 2), (5, 1), (8, 4), (9, 2), (10, 1), (11, 1)}
    whole = inputs.Inputs(spark, str(tmp_path)).store
    assert inputs.Inputs(spark, str(tmp_path)).asked is whole
    again = registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, got))


def test_an_index_of_more_terms_than_may_be_sent_is_whole(spark, monkeypatch):
    from orrery.operators import store as ST

    d = spark.createDataFrame([*PAPERS, (70, None)], "doc_id long, text string")
    q = spark.createDataFrame([(1, "glacier northern"), (2, None), (3, "nothing")], "query_id long, q string")
    rows = lambda s: sorted(map(tuple, R.bm25_stored(s, q).collect()))
    few = Store.of_terms(d, q)
    monkeypatch.setattr(ST, "ASKED_BYTES", 1)
    whole = Store.of_terms(d, q)
    assert few.vocabulary.count() == 2 < whole.vocabulary.count() and rows(few) == rows(whole) != []
    none = spark.createDataFrame([(1, "an"), (2, None)], "query_id long, q string")
    monkeypatch.undo()
    assert Store.of_terms(d, none).blocks.count() == 0 and R.bm25_stored(Store.of_terms(d, none), none).count() == 0


def test_packed_links_and_ranks_are_small_and_lose_nothing():
    import zlib

    import numpy as np
    import pyarrow as pa

    ends = np.array([-(2**63), -1, 0, 2**40, 2**63 - 1])
    rng = np.random.default_rng(3)
    src, dst = np.sort(np.concatenate([rng.integers(0, 60000, 100000), ends])), np.concatenate([rng.integers(0, 60000, 100000), ends])
    row = next(G._packed(np.array([], np.int64))([pa.RecordBatch.from_arrays([pa.array(src), pa.array(dst)], ["src", "dst"])]))
    s, s_at, d, d_at = G._ids(row["src"][0]), G._ids(row["src_at"][0], np.int32), G._ids(row["dst"][0]), G._numbers(row["dst_at"][0], np.int32)
    assert (s[s_at] == src).all() and (d[d_at] == dst).all()
    # Of 65,536 nodes of a block, ids and degrees must not cost what the ranks do.
    table = pa.table({"doc_id": pa.array(rng.permutation(60000) * 3), "degree": pa.array(rng.integers(0, 60, 60000))})
    state = G._blocked(np.array([], np.int64), 1 / 60000)(table)
    assert sum(len(zlib.compress(state[c][0].as_py(), 1)) for c in ("ids", "degree")) < 2 * 60000
    assert (G._ids(state["ids"][0]) == np.arange(60000) * 3).all() and set(G._numbers(state["r"][0], np.float64)) == {1 / 60000}


def test_nodes_and_degrees_of_links_come_from_one_aggregation(spark, monkeypatch):
    kept = {}
    real = G.written
    monkeypatch.setattr(G, "written", lambda df, name: kept.setdefault(name, real(df, name)))
    G.pagerank(spark.createDataFrame([(1, 2), (1, 3), (2, None), (None, 2), (3, 1)], "src long, dst long"), rounds=1)
    assert {(r.doc_id, r.degree) for r in kept["nodes"].collect()} == {(1, 2), (2, 1), (3, 1), (None, 1)}
