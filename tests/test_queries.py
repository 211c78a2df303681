"""Every registered query against its SQL at the smallest scale; ORRERY_ALL=1 runs all of them, else a cross-section."""

import os

import duckdb
import pandas as pd
import pytest
from conftest import SF

from orrery.plans import registry

SOME = ["src_url_map", "snk_document", "sc_normalise_url", "sc_highlight", "flt_straggler", "join_ring", "agg_domain_stats", "agg_cooc", "agg_job4_zero", "ir_bm25", "ir_tfidf_search", "ir_hybrid", "ir_spell_query", "ir_expand", "ir_click_boost", "gr_pagerank", "pb_bloom_stats", "fd_merge", "st_record_click", "cr_enqueue", "cr_delay", "pb_gossip", "cr_work_steal", "cr_rehome", "snk_page_db", "st_sse_dashboard", "st_collab_stream", "join_hybrid", "exp_bloom_fp"]


def tidy(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].map(lambda v: "null" if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v))
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", sorted(registry.ORACLES) if os.environ.get("ORRERY_ALL") else SOME)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    a, b = tidy(registry.QUERIES[name](spark, SF).toPandas()), tidy(con.execute(registry.ORACLES[name]).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b) and a.equals(b)


def test_the_entry_imports_without_a_session_and_runs(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.parametrize("name", ["src_json_pages", "snk_migrate"])
def test_titles_with_cut_entities_are_those_of_the_sql(spark, tmp_path, name):
    pages = [(1, "https://h.example/a", "<title>Cut &amp</title><p>x"), (2, "https://h.example/b", "<title>A &lt; B</title><p>y"), (3, "https://h.example/c", "<p>none")]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    a, b = tidy(registry.QUERIES[name](spark, str(tmp_path)).toPandas()), tidy(con.execute(registry.ORACLES[name]).df())
    assert "Cut &amp" in set(b["title"]) and a.equals(b)


@pytest.mark.parametrize("name", ["src_url_map", "snk_migrate"])
def test_titles_between_wide_spaces_and_pages_without_an_id_are_those_of_the_sql(spark, tmp_path, name):
    spaces = ["\u00a0", "\u1680", "\u2003", "\u202f", "\u3000", "\t", "\n", "\u2028", "\u200b", "\ufeff"]
    pages = [(i, f"https://h.example/{i}", f"<title>{w} A{w}b{w}</title><p>x") for i, w in enumerate(spaces)] + [(90, "u", "<title> \u00a0 </title>"), (None, None, "<title>Lost</title>")]
    pd.DataFrame(pages, columns=["page_id", "url", "html"]).astype({"page_id": "Int64"}).to_parquet(tmp_path / "pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet'")
    want = con.execute(registry.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = {tuple(r) for r in registry.QUERIES[name](spark, str(tmp_path)).select(columns).collect()}
    assert len(got) == 12 and got == set(want.fetchall())
