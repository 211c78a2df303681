import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from orrery.llm import kernels as K
from orrery.llm import quality
from orrery.llm.common import table

SF = "/root/testdata/sf0.01"


def test_flattened_trees_score_like_a_walk_through_each():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    m = quality.fit(x, y)
    out = []
    for row in x[:50]:
        total = m.base
        for node in m.roots:
            for _ in range(m.depth):
                node = m.child[node][int(row[m.feature[node]] > m.threshold[node])]
            total += m.value[node]
        out.append(1 / (1 + np.exp(-total)))
    assert np.allclose(out, m.score(x[:50]))
    assert ((m.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_held_out_accuracy(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    train, held = labels.where("doc_id % 4 <> 0"), labels.where("doc_id % 4 = 0")
    scored = quality.score(docs, train).join(held, "doc_id").toPandas()
    assert ((scored.p_quality >= 0.5) == (scored.quality == 1)).mean() > 0.93
    assert ((scored.p_toxic >= 0.5) == (scored.toxic == 1)).mean() > 0.93


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "a b"), (3, "word " * 50_000), (3, "word " * 50_000)], "doc_id long, text string").withColumn("keep", F.lit("clash"))
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, none).collect()
    assert len(rows) == 5 and all(r.keep for r in rows)
    labels = spark.createDataFrame([(1, None, 1), (None, 1, 1), (9, 1, 0), (2, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.filter_documents(docs, labels).columns == docs.columns
    assert quality.score(docs.limit(0), labels).count() == 0
    assert quality.statistics(pa.array([], pa.string()), np.zeros(0, np.uint64)).shape[0] == 0


def test_statistics_are_those_of_a_plain_count():
    from collections import Counter

    texts = ["", "a", "The cat the cat sat, THE END!", "x x x x x", "one\ttwo\nthree|four 12 (y) é", "bad words bad", "z" * 500]
    lexicon = np.sort(K.words(pa.array(["bad"]), "letters")[0])
    got = quality.statistics(pa.array(texts), lexicon)
    for row, t in zip(got, texts):
        raw, w = t.encode(), t.lower().split()
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)] or ([tuple(w)] if w else [])
        letters = re.findall(r"[a-zé]+", t.lower())
        n, share = max(len(w), 1), lambda x: (len(Counter(x)) / max(len(x), 1), max(Counter(x).values(), default=0) / max(len(x), 1))
        lines = t.count("\n")
        want = [np.log1p(len(raw)), np.log1p(len(w)), len(raw) / n, *share(w), *share(grams), sum(a == b for a, b in zip(w, w[1:])) / n, lines / n, letters.count("bad"), letters.count("bad") / max(len(letters), 1), len(letters) / n]
        assert np.allclose(row[:12], want), t
        tail = sum(128 <= b < 192 for b in raw)
        chars = max(len(raw) - tail, 1)
        for k, name in enumerate(quality._KINDS, 1):
            if name != "tail":
                assert np.isclose(row[12 + k], sum(b in bytes(quality._KINDS[name]) for b in raw) / chars), (t, name)


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 4)), 1)
    y = (x[:, 2] + 0.3 * rng.normal(size=200) > 0.2).astype(float)
    m = quality.fit(x, y, trees=1, depth=1, bins=64, least=12, ridge=1.0)
    q = y.mean()
    g, h = q - y, np.full(200, q * (1 - q))
    gain = lambda mask: g[mask].sum() ** 2 / (h[mask].sum() + 1)
    best = max(((gain(x[:, f] <= t) + gain(x[:, f] > t), f, t) for f in range(4) for t in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])) if 12 <= (x[:, f] <= t).sum() <= 188))
    root = m.roots[0]
    left = x[:, m.feature[root]] <= m.threshold[root]
    assert np.isclose(gain(left) + gain(~left), best[0])
    for side, mask in zip(m.child[root], (left, ~left)):
        assert np.isclose(m.value[side], -0.2 * g[mask].sum() / (h[mask].sum() + 1))
