import itertools
import random

import numpy as np
import pytest

from orrery.llm import jaccard


def grams(t, n=3):
    w = (t or "").lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(docs, t=0.5):
    sets = {d: grams(x) for d, x in docs}
    out = {}
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= t:
            out[a, b] = round(j, 6)
    return out


def fixture(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    docs = [" ".join(rng.choices(vocabulary, k=rng.choice([2, 8, 40, 90]))) for _ in range(n)]
    for base, copies in ((5, 25), (17, 3), (33, 1)):
        for _ in range(copies):
            w = docs[base].split() + ["tail"]
            for _ in range(rng.randint(0, max(1, len(w) // 8))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            docs.append(" ".join(w))
    docs += [docs[5], docs[5].upper(), docs[40], "one", "one", "two words", "Two  words"]
    return list(enumerate(docs))


def expected(docs, t=0.5):
    """doc_id: (class_id, n_links, max_jaccard), by brute force."""
    pairs, label = brute(docs, t), {d: d for d, _ in docs}
    for a, b in sorted(pairs):
        a, b = label[a], label[b]
        label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    own = {d: [j for p, j in pairs.items() if d in p] for d in label}
    return {d: (label[d], len(own[d]), max(own[d], default=None)) for d in label}


@pytest.mark.parametrize("seed, t", [(1, 0.5), (1, 0.2), (2, 0.3), (2, 0.7)])
def test_links_are_those_of_brute_force(spark, seed, t, monkeypatch):
    # Small tiles and short lists, so that every path is taken.
    monkeypatch.setattr(jaccard, "TILE", 6)
    monkeypatch.setattr(jaccard, "SHORT", 4)
    docs = fixture(seed)
    # Parts of others: pairs of very different sizes.
    docs += [(500 + k, " ".join(docs[k][1].split()[: max(3, len(docs[k][1].split()) // d)])) for k, d in zip(range(40), [2, 3, 4] * 20)]
    more = [(900, None, 0, "x"), (901, "", 0, "x"), (902, " \n", 0, "x"), (None, docs[5][1], 0, "x"), (5, docs[5][1], 0, "y")]
    df = spark.createDataFrame([(d, x, d, "x") for d, x in docs] + more, "doc_id long, text string, size long, bits string")
    rows = jaccard.links(df, threshold=t).collect()
    assert {r.doc_id: (r.class_id, r.n_links, r.max_jaccard) for r in rows} == expected(docs, t) | {d: (d, 0, None) for d in (900, 901, 902)}
    assert len(rows) == len(docs) + 3
    if t == 0.5:
        kept = [r.doc_id for r in jaccard.keep_one(df).collect()]
        least = {c for c, *_ in expected(docs).values()}
        assert sorted(x for x in kept if x is not None) == sorted([*least, 900, 901, 902] + [5] * (5 in least)) and None in kept


def test_overlaps_derived_from_similar_sets_are_exact():
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 5000, 300).astype(np.uint64))
    members = [np.unique(np.concatenate((rng.permutation(base)[: rng.integers(1, len(base))], rng.integers(0, 9000, rng.integers(0, 50)).astype(np.uint64)))) for _ in range(40)]
    got = jaccard.overlaps(members)
    assert all(got[i, j] == len(np.intersect1d(members[i], members[j])) for i in range(40) for j in range(40) if i != j)


def test_bitmaps_never_lose_a_pair():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 53, rng.integers(1, 400)).astype(np.uint64)) for _ in range(30)]
    sets += [np.unique(np.concatenate((s[: rng.integers(1, len(s) + 1)], rng.integers(0, 1 << 53, 5).astype(np.uint64)))) for s in sets]
    sizes = np.array([len(s) for s in sets])
    blobs = jaccard.bitmaps(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), sizes)
    for t in (0.15, 0.3, 0.5, 0.8):
        x, y = jaccard.bounded(blobs, sizes, t)
        found = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
        true = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (o := len(np.intersect1d(sets[i], sets[j]))) / (len(sets[i]) + len(sets[j]) - o) >= t}
        assert true <= found


def test_block_skipping_keeps_every_entry_with_a_partner():
    rng = np.random.default_rng(8)
    n, t = 400, 0.5
    lists = np.sort(rng.integers(0, 20, n))
    size = rng.integers(1, 200, n)
    place = (rng.random(n) * (size - np.ceil(t * size) + 1)).astype(np.int64)
    kept = jaccard.possible(lists, place, size, t)
    x, y = jaccard.close(lists, place, size, t)
    assert kept[x].all() and kept[y].all()


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.links(df).count() == 0 and jaccard.keep_one(df).count() == 0
