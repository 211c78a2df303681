import itertools

import numpy as np
import pyarrow.parquet as pq

from orrery.llm import langid


def test_marginals_are_those_of_enumeration():
    rng = np.random.default_rng(0)
    k, counts = 3, np.array([4, 0, 6, 1])
    scores, moves = rng.normal(size=(counts.sum(), k)), rng.normal(size=(k, k))
    got = langid.marginals(scores, moves, counts)
    at = 0
    for n in counts:
        want = np.zeros((n, k))
        for path in itertools.product(range(k), repeat=int(n)):
            weight = np.exp(sum(scores[at + i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weight *= sum(np.exp(moves[a, path[0]]) for a in range(k)) if n else 1
            for i, y in enumerate(path):
                want[i, y] += weight
        if n:
            assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_long_sequences_agree_with_a_plain_recursion():
    rng = np.random.default_rng(1)
    k, n = 4, 500
    scores, moves = rng.normal(size=(n, k)), rng.normal(size=(k, k))
    t, e = np.exp(moves), np.exp(scores)
    f = np.zeros((n, k))
    a = np.full(k, 1 / k)
    for i in range(n):
        a = (a @ t) * e[i]
        a /= a.sum()
        f[i] = a
    b = np.ones(k)
    want = np.zeros((n, k))
    for i in range(n - 1, -1, -1):
        want[i] = f[i] * b / (f[i] * b).sum()
        b = t @ (e[i] * b)
        b /= b.sum()
    assert np.allclose(langid.marginals(scores, moves, np.array([n])), want)


def test_held_out_accuracy_and_code_switching():
    rows = pq.read_table("/root/testdata/sf0.01/documents.parquet").select(["text", "lang"]).to_pylist()
    model = langid.fit([r["text"] for r in rows[:300]], [r["lang"] for r in rows[:300]], rounds=30)
    label = langid.Labeller(model)
    import pyarrow as pa

    held = rows[300:600]
    p, counts = label(pa.array([r["text"] for r in held]))
    doc = np.repeat(np.arange(len(held)), counts)
    gold = np.array([model.labels.index(r["lang"]) for r in held])
    assert (p.argmax(axis=1) == gold[doc]).mean() > 0.97
    en, de = (next(" ".join(r["text"].split()[:40]) for r in held if r["lang"] == x and len(r["text"].split()) > 60) for x in ("en", "de"))
    p, _ = label(pa.array([f"{en} {de}"]))
    names = [model.labels[i] for i in p.argmax(axis=1)]
    assert np.mean([x == "en" for x in names[:40]]) > 0.85 and np.mean([x == "de" for x in names[40:]]) > 0.85


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", 1), (2, "", None, 1), (3, "hello the world", "en", 1), (3, "hello the world", "en", 1), (4, "der die das", "de", 1)], "doc_id long, text string, lang string, confidence int")
    rows = {r.doc_id: r for r in langid.identify(df).collect()}
    assert rows[1].lang is None and rows[2].lang is None and rows[2].seg_lang == [] and rows[3].lang == "en" and rows[4].lang == "de"
    assert sum(rows[3].seg_words) == 3
    none = df.withColumn("lang", df.lang.substr(9, 1)).where("doc_id = 1")
    assert langid.identify(none).collect()[0].lang is None
    assert langid.identify(df.limit(0)).count() == 0


def test_expected_moves_are_those_of_enumeration_and_the_slope_of_the_likelihood():
    rng = np.random.default_rng(12)
    k, counts = 3, np.array([1, 5, 0, 7, 2])
    scores, moves = rng.standard_normal((int(counts.sum()), k)), rng.standard_normal((k, k))

    def whole(moves):
        """Log partition over all sequences, by enumeration, and the expected moves."""
        total, expected, at = 0.0, np.zeros((k, k)), 0
        for n in counts:
            if not n:
                continue
            paths = np.array(list(itertools.product(range(k), repeat=n + 1)))
            weight = np.exp(sum(scores[at + i, paths[:, i + 1]] + moves[paths[:, i], paths[:, i + 1]] for i in range(n)))
            total += np.log(weight.sum())
            for i in range(n):
                np.add.at(expected, (paths[:, i], paths[:, i + 1]), weight / weight.sum())
            at += n
        return total, expected

    p, got = langid.marginals(scores, moves, counts, moves=True)
    log, expected = whole(moves)
    assert np.allclose(got, expected) and np.allclose(p, langid.marginals(scores, moves, counts))
    for a in range(k):
        for b in range(k):
            step = np.zeros((k, k))
            step[a, b] = 1e-5
            assert abs((whole(moves + step)[0] - log) / 1e-5 - got[a, b]) < 1e-3
    # Over chunk borders the moves still add up to one a word.
    long = np.array([200, 33])
    assert abs(langid.marginals(rng.standard_normal((233, k)), moves, long, moves=True)[1].sum() - 233) < 1e-6
