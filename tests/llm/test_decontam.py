import random
import re

import numpy as np
import pyarrow as pa

from orrery.llm import decontam
from orrery.llm import kernels as K


def words(rng, n):
    return ["".join(rng.choice(["ba", "ko", "ri", "tu", "sen", "mi"]) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def fixture(spark):
    rng = random.Random(4)
    items = [words(rng, n) for n in (20, 33, 48, 90, 5, 64, 65, 128, 200)]
    docs = [words(rng, 150) for _ in range(60)]
    planted = {}
    for d, i in ((3, 0), (7, 1), (11, 2), (15, 3), (19, 1)):
        leak = list(items[i])
        if d == 19:
            for k in range(4, len(leak), 9):
                leak[k] = "zzz"
        at = rng.randint(0, 150)
        # Neighbours that are a single repeated mark must not drown the passage.
        docs[d][at:at] = ["|"] * 12 + [w + "%" if k % 5 == 0 else w for k, w in enumerate(leak)] + ["|"] * 12
        planted[d] = i
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(90, None), (None, "a b c d e f g h i"), (91, ""), (92, "?!")], "item_id long, text string")
    rows = [(i, " ".join(x), i) for i, x in enumerate(docs)] + [(100, None, 1), (101, "", 1), (3, " ".join(docs[3]), 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, item_id long"), b, planted, docs, items


def test_exact_and_changed_passages_are_found_and_clean_documents_left(spark):
    docs, b, planted, _, _ = fixture(spark)
    found = decontam.leaks(docs, b).collect()
    assert {(r.doc_id, r.item_id) for r in found} == set(planted.items())
    assert sum(r.doc_id == 3 for r in found) == 2
    kept = decontam.decontaminate(docs, b)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == set(range(60)) - set(planted) | {100, 101}


def test_the_bit_parallel_subsequence_is_that_of_the_textbook(spark):
    _, b, _, docs, items = fixture(spark)
    latent = np.random.default_rng(1).standard_normal((1 << decontam.TERM_BITS, 8)).astype(np.float32)
    ready = decontam.prepare(b, latent)
    w, counts = K.words(pa.array([" ".join(d) for d in docs]), "plain")
    starts = np.cumsum(counts) - counts
    docs = [re.findall("[a-z0-9]+", " ".join(d)) for d in docs]
    for table in (ready.table, None):
        ready.table = table
        own = decontam.columns(ready, w) if table is not None else None
        for piece in range(len(ready.ids)):
            item = items[ready.ids[piece]]
            late = item[len(item) - max(1, len(item) // 4) :]
            got, answer = decontam.common(ready, w, own, starts[:20], np.full(20, 140), np.full(20, piece))
            assert np.allclose(got, [lcs(d[:140], item) / len(item) for d in docs[:20]])
            assert np.allclose(answer, [lcs(d[:140], late) / len(late) for d in docs[:20]])


def test_empty_inputs(spark):
    docs, b, *_ = fixture(spark)
    assert decontam.leaks(docs, b.limit(0)).count() == 0
    assert decontam.leaks(docs.limit(0), b).count() == 0
    assert decontam.decontaminate(docs, b.limit(0)).count() == docs.count()


def disturbed(rng, item, how, share):
    out = []
    for word in item:
        hit = rng.random() < share
        if how == "insert" or not hit:
            out.append(word)
        if hit and how != "delete":
            out += words(rng, 1)
    return out


def accepted(doc, item):
    """Whether any window of the document, of the item's length rounded up and a step more on both sides, leaks the item."""
    step, late = decontam.STEP, item[len(item) - max(1, len(item) // 4) :]
    for at in range(0, len(doc), step):
        window = doc[max(0, at - step) : at + (-(-len(item) // step) + 1) * step]
        share = lcs(window, item) / len(item)
        if share >= decontam.STRONG or share >= decontam.WEAK and lcs(window, late) / len(late) >= decontam.ANSWER:
            return True
    return False


def test_strongly_changed_copies_are_found_as_by_a_scan_of_all_windows(spark):
    rng = random.Random(8)
    often = ["the", "of", "and", "to"]
    text = lambda n: [rng.choice(often) if rng.random() < 0.3 else x for x in words(rng, n)]
    items = [text(n) for n in (12, 18, 25, 36, 50, 62, 100, 150)]
    docs = [text(100) for _ in range(10)]
    for how in ("replace", "delete", "insert"):
        for share in (0.25, 0.3, 0.35, 0.4):
            for item in items:
                doc = text(90)
                at = rng.randint(0, 90)
                doc[at:at] = disturbed(rng, item, how, share)
                docs.append(doc)
    expected = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if accepted(doc, item)}
    assert len(expected) > 40
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(docs)], "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()} == expected


def test_short_items_are_found_word_for_word_and_long_ones_as_a_whole(spark, monkeypatch):
    rng = random.Random(9)
    seven, one, long = words(rng, 7), ["unheardof"], words(rng, 128)
    texts = [words(rng, 40) for _ in range(8)]
    texts[0][11:11] = [x.upper() + "," for x in seven]
    texts[1][11:11] = seven[:6]
    texts[2][5:5] = one
    texts[3][7:7] = long[:64]
    texts[4][7:7] = long
    texts[5] = texts[5] * 400 + long[:120] + texts[5] * 400
    texts[6] = seven
    texts[7][2:2] = [*seven[:3], "x", *seven[3:]]
    items = [(1, seven), (2, one), (3, long), (4, seven)]
    b = spark.createDataFrame([(i, " ".join(x)) for i, x in items], "item_id long, text string")
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    expected = {(0, 1), (0, 4), (6, 1), (6, 4), (2, 2), (4, 3), (5, 3)}
    rows = decontam.leaks(d, b).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == expected and len(rows) == len(expected)
    assert {r.first_word for r in rows if r.doc_id == 0} == {11} and all(r.overlap >= 0.9 for r in rows)
    # In parts, a large benchmark gives the same.
    monkeypatch.setattr(decontam, "BENCH_BYTES", 400)
    assert {(r.doc_id, r.item_id) for r in decontam.leaks(d, b).collect()} == expected
    assert {r.doc_id for r in decontam.decontaminate(d, b).collect()} == {1, 3, 7}


def test_weights_and_basis_are_those_of_a_dense_computation(spark):
    docs, *_ = fixture(spark)
    idf = decontam.weigh(docs)
    texts = [r.text for r in docs.collect()]
    passage, term, count = decontam._passages(pa.array(texts, pa.string()))
    x = np.zeros((passage.max() + 1, 1 << decontam.TERM_BITS))
    x[passage, term] = count
    df = (x > 0).sum(axis=0)
    assert np.allclose(idf, np.log((1 + df.max()) / (1 + df)) + 0.1)
    x *= idf
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = decontam.basis(docs, idf).astype(float)
    assert np.allclose(v.T @ v, np.eye(v.shape[1]), atol=1e-4)
    # Most of the energy that the best basis of that rank has, though words at random have a flat spectrum.
    best = (np.linalg.svd(x, compute_uv=False)[: v.shape[1]] ** 2).sum()
    assert np.linalg.norm(x @ v) ** 2 >= 0.75 * best
