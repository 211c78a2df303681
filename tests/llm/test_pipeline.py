import corpus_pipeline
from orrery.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_take_effect_one_after_another(spark):
    docs = table(spark, SF, "documents")
    labels = {r.doc_id: r for r in table(spark, SF, "labels").collect()}
    items = [r.text for r in table(spark, SF, "benchmark").collect()]
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != "bpe":
            assert out.columns == docs.columns, name
        rows = {r.doc_id: r for r in out.collect()}
        assert rows.keys() <= before.keys()
        if name == "quality":
            good = [d for d in before if d in labels and labels[d].quality and not labels[d].toxic]
            assert sum(d in rows for d in good) >= 0.95 * len(good)
        if name == "near_duplicates":
            texts = [t.text for t in rows.values()]
            assert len(set(texts)) == len(texts)
        if name == "decontamination":
            assert set(before) - set(rows) == {d for d, t in before.items() if any(i in t for i in items)}
        if name == "secrets":
            assert rows.keys() == before.keys()
        if name == "bpe":
            assert rows.keys() == before.keys() and all(r.round_trip for r in rows.values())
        docs, before = out, {d: getattr(r, "text", None) for d, r in rows.items()}


def test_every_stage_takes_odd_rows(spark, tmp_path):
    """Nulls, empty, long and repeated texts, clashing names and an empty table, through all stages."""
    secret = "token = \"" + "3f9a1c7e5b2d8046" * 4 + "\""
    real = [r.text for r in table(spark, SF, "documents").where("lang = 'en' and n_chars > 300").limit(6).collect()]
    item = table(spark, SF, "benchmark").first().text
    texts = [*real, None, "", " \n", real[0] + " " + secret, item, "word " * 30_000, real[1], real[1]]
    rows = [(None if i in (8, 9) else 3 if t is real[1] and i > 6 else 100 + i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i}", None if t is None else len(t), "a", 1, b"x", 2) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, text_key string, rep long, bits binary, hub long")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name == "bpe":
            assert out.count() == docs.count() and stage(spark, docs.limit(0), SF).count() == 0
            break
        assert out.columns == docs.columns and stage(spark, docs.limit(0), SF).count() == 0, name
        before, after = docs.collect(), out.collect()
        key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text or "", r.source or "")
        if name == "secrets":
            assert len(after) == len(before) and not any("3f9a1c7e5b2d8046" in (r.text or "") for r in after)
            assert sum("[SECRET]" in (r.text or "") for r in after) == sum(secret in (r.text or "") for r in before)
        else:
            assert {key(r) for r in after} <= {key(r) for r in before}
        if name == "near_duplicates":
            least = min((r.doc_id for r in before if r.text == real[1] and r.doc_id is not None), default=None)
            assert all(r.doc_id == least for r in after if r.text == real[1] and r.doc_id is not None)
            assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before)
        if name == "decontamination":
            assert item not in [r.text for r in after]
        # The next stage sees the odd rows again, whatever this one dropped.
        docs = docs if name != "secrets" else out
