import datetime as dt
import math

from pyspark.sql import functions as F

from orrery.operators import crawl as C
from orrery.sources import tables as TB
from orrery.streaming import live as LV

T0 = dt.datetime(2024, 1, 1)


def run(spark, stream, tmp_path, mode, schema):
    """The rows of all batches, in order of arrival."""
    got = []
    LV.start(stream, lambda df, epoch: got.extend(df.collect()), str(tmp_path / "cp"), mode).awaitTermination()
    return got


def source(spark, df, tmp_path, files=3):
    path = str(tmp_path / "in")
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_crowd_scores_of_a_stream_are_those_of_the_closed_form(spark, tmp_path):
    rows = [(i % 3, T0 + dt.timedelta(seconds=20 * i), i % 10 + 1) for i in range(24)]
    df = spark.createDataFrame(rows, "doc_id long, timestamp timestamp, position long")
    got = run(spark, LV.crowd_stream(source(spark, df, tmp_path), watermark="1 hour"), tmp_path, "update", None)
    last = {r.doc_id: r for r in got}
    for d in range(3):
        t_last = max(t for x, t, _ in rows if x == d)
        want = sum(2 / math.log2(p + 2) * 2 ** (-(t_last - t).total_seconds() / 300) for x, t, p in rows if x == d)
        assert abs(last[d].score - want) < 1e-6
    now = str(T0 + dt.timedelta(seconds=480))
    batch = {r.doc_id: r.score for r in LV.crowd_scores(df, now).collect()}
    want = {d: round(sum(2 / math.log2(p + 2) * 2 ** (-(480 - (t - T0).total_seconds()) / 300) for x, t, p in rows if x == d), 6) for d in range(3)}
    assert all(abs(batch[d] - want[d]) < 2e-6 for d in range(3))


def test_token_buckets_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    df = spark.createDataFrame([(i, f"k{i % 2}", T0 + dt.timedelta(milliseconds=300 * i)) for i in range(20)], "id long, k string, timestamp timestamp")
    stream = LV.bucket_stream(source(spark, df, tmp_path, 1), "k", rate=1.0, capacity=2.0)
    got = {r.id: (r.granted, r.wait_s) for r in run(spark, stream, tmp_path, "append", None)}
    assert got == {r.id: (r.granted, r.wait_s) for r in C.token_bucket(df, "k", rate=1.0, capacity=2.0).collect()}


def test_running_counts_and_first_results(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 4, i % 2 + 1, "ok" if i % 3 else "failed", T0 + dt.timedelta(seconds=i)) for i in range(12)], "id long, doc_id long, worker_rank long, status string, timestamp timestamp")
    got = run(spark, LV.progress(source(spark, df, tmp_path)), tmp_path, "complete", None)
    last = {r.worker_rank: r for r in got}
    assert {k: (r.total, r.pages, r.failed) for k, r in last.items()} == {r.worker_rank: (r.total, r.pages, r.failed) for r in LV.progress(df).collect()}
    first = run(spark, LV.first_results_stream(source(spark, df, tmp_path / "b")), tmp_path / "b", "append", None)
    assert sorted(r.doc_id for r in first) == [0, 1, 2, 3] and C.first_results(df).count() == 4


def test_metrics_log_skips_what_is_malformed(spark, tmp_path):
    p = tmp_path / "m"
    p.mkdir()
    (p / "a.jsonl").write_text('{"type":"fetch","domain":"d","duration_ms":1.5,"status":"ok","ts":1.0}\nnot json\n{"type":"queue","depth":3,"ts":2.0}\n')
    rows = TB.metrics(spark, str(p)).collect()
    assert len(rows) == 1 and rows[0].domain == "d"


def test_pages_migrate_and_index_round_trip(spark, tmp_path):
    src = tmp_path / "pages"
    src.mkdir()
    (src / "1.json").write_text('{"doc_id": 1,\n "url": "u", "title": "t", "text": "x", "snippet": "", "links": ["v"]}')
    (src / "2.json").write_text("{broken")
    assert TB.migrate(spark, str(src), str(tmp_path / "t")) == 1 and (src / "1.json").exists()
    post = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], TB.INDEX)
    TB.write_index(post, str(tmp_path / "i"), 2)
    assert TB.index(spark, str(tmp_path / "i")).count() == 2
    front = spark.createDataFrame([("u", 1)], "url string, depth int")
    TB.save_snapshot(front, front.select("url"), str(tmp_path / "s"))
    a, b = TB.load_snapshot(spark, str(tmp_path / "s"))
    assert a.collect() == front.collect() and b.count() == 1


def test_windows_of_queue_depth(spark):
    df = spark.createDataFrame([(T0 + dt.timedelta(seconds=s), s) for s in (1, 5, 12)], "timestamp timestamp, depth long")
    assert [(r.mean_depth, r.most) for r in LV.queue_depth(df).orderBy("start").collect()] == [(3.0, 5), (12.0, 12)]
    assert LV.active_users(df.withColumn("session_id", F.col("depth")), str(T0 + dt.timedelta(seconds=10)), 300).first()[0] == 2


LOG = "id long, doc_id long, worker_rank long, status string, duration_ms double, domain string, depth long, timestamp timestamp"


def crawl(spark, n=24):
    return spark.createDataFrame([(i, i % 5, i % 3 + 1, ("ok", "failed", "ok", "blocked")[i % 4], float(i), f"d{i % 2}", i % 7, T0 + dt.timedelta(seconds=10 * i)) for i in range(n)], LOG)


def test_views_pushed_from_a_stream_end_as_those_of_the_table(spark, tmp_path):
    df = crawl(spark)
    out = str(tmp_path / "out")
    for view in (LV.dashboard, lambda rows: LV.throughput(rows, "1 minute", 2)):
        LV.start(source(spark, df, tmp_path / "a"), LV.push(view, out), f"{out}/cp", "append").awaitTermination()
        want = view(df)
        last = spark.read.schema(want.schema).json(f"{out}/view/epoch=2")
        assert sorted(map(tuple, last.select(want.columns).collect())) == sorted(map(tuple, want.collect()))
        import shutil

        shutil.rmtree(tmp_path)


def test_windows_of_a_stream_are_those_of_the_table(spark, tmp_path):
    df = crawl(spark)
    key = lambda rows, *names: {tuple(r[n] for n in names) for r in rows}
    for k, (stream, table, names) in enumerate((
        (LV.domain_windows(source(spark, df, tmp_path / "a"), "1 minute", "1 hour"), LV.domain_windows(df, "1 minute"), ("domain", "start", "fetches", "errors", "blocked", "avg_ms")),
        (LV.queue_depth(source(spark, df, tmp_path / "b"), "1 minute", "1 hour"), LV.queue_depth(df, "1 minute"), ("start", "mean_depth", "most")),
    )):
        last = {}
        for r in run(spark, stream, tmp_path / f"c{k}", "update", None):
            last[r.start, r[0] if k == 0 else None] = r
        assert key(last.values(), *names) == key(table.collect(), *names)
    users = run(spark, LV.active_users_stream(source(spark, df.withColumn("session_id", F.col("doc_id")), tmp_path / "d"), "1 hour", "1 day"), tmp_path / "d", "update", None)
    assert users[-1].active_users == 5


def test_metrics_come_as_a_stream(spark, tmp_path):
    df = crawl(spark)
    TB.write_metrics(df, df.select("timestamp", "depth", F.col("worker_rank").alias("active_workers")), str(tmp_path / "m"))
    got = run(spark, TB.metrics_stream(spark, str(tmp_path / "m")).where("type = 'fetch'"), tmp_path, "append", None)
    assert sorted(r.duration_ms for r in got) == [float(i) for i in range(24)] and {r.timestamp for r in got} == {r.timestamp for r in df.collect()}


def test_pages_of_a_stream_reach_both_sinks_once(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"u{i}", "t") for i in range(9)], "doc_id long, url string, title string")
    out = str(tmp_path / "db")
    sink = TB.page_sinks(out)

    def twice(batch, epoch):
        sink(batch, epoch)
        sink(batch, epoch)

    LV.start(source(spark, pages, tmp_path), twice, f"{out}/cp", "append").awaitTermination()
    assert spark.read.parquet(f"{out}/documents").count() == spark.read.parquet(f"{out}/crawl_log").count() == 9


def test_activity_of_two_logs(spark):
    q = spark.createDataFrame([(i, f"q{i % 2}", 1, T0 + dt.timedelta(seconds=i), f"s{i % 3}") for i in range(6)], "id long, query string, result_count long, timestamp timestamp, session_id string")
    k = spark.createDataFrame([(9, "q0", 4, 1, T0 + dt.timedelta(seconds=3), "s0")], "id long, query string, doc_id long, position long, timestamp timestamp, session_id string")
    rows = {(r.section, r.place): (r.what, r.value) for r in LV.activity(q, k, str(T0 + dt.timedelta(seconds=5)), newest=2).collect()}
    assert rows["stats", 1] == ("total_queries", "6") and rows["stats", 3] == ("active_users", "3") and rows["trending", 1][0] == "4" and rows["feed", 1] == ("query 5", "q1") and ("feed", 3) not in rows


def test_no_snapshot_is_none_and_log_lines_have_their_fields(spark, tmp_path):
    assert TB.load_snapshot(spark, str(tmp_path / "none")) is None
    lines = spark.createDataFrame([(T0, "INFO", "w", "rank 3 got https://x.example/a b"), (T0, "INFO", "w", None)], "timestamp timestamp, level string, logger string, message string")
    TB.write_log(lines, str(tmp_path / "log"))
    got = {(r.worker_rank, r.url) for r in TB.logs(spark, str(tmp_path / "log")).collect()}
    assert got == {(3, "https://x.example/a"), (None, None)}
