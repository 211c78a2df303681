import random

import pytest

from orrery.llm import phrases


def brute(docs, n=50):
    where = {}
    for d, t in docs:
        w = (t or "").lower().split()
        for i in range(len(w) - n + 1):
            where.setdefault(tuple(w[i : i + n]), []).append((d, i))
    starts = {}
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                starts.setdefault(d, []).append(i)
    out = set()
    for d, s in starts.items():
        s.sort()
        first = last = s[0]
        for i in s[1:]:
            if i - last > n:
                out.add((d, first, last - first + n))
                first = i
            last = i
        out.add((d, first, last - first + n))
    return out


def fixture():
    rng = random.Random(2)
    word = lambda: rng.choice("ka lo mi re su ta vi no".split()) + str(rng.randint(0, 400))
    docs = [[word() for _ in range(rng.choice([10, 60, 200, 320]))] for _ in range(40)]
    long, short = [word() for _ in range(75)], [word() for _ in range(49)]
    for d in (1, 4, 9, 12):
        docs[d][5:5] = long
        docs[d][120:120] = short
    docs[15][30:30] = long[:60]
    docs[20] += long + ["x"] + long
    docs[25] = list(docs[26])
    docs[30] = "again and".split() * 60
    return [(i, " ".join(w)) for i, w in enumerate(docs)]


@pytest.mark.parametrize("group", [24 << 20, 800])
def test_spans_are_those_of_brute_force(spark, monkeypatch, group):
    # Small splits, and parts so small that most are taken in pieces.
    monkeypatch.setattr(phrases, "SPLIT_WORDS", 300)
    monkeypatch.setattr(phrases, "GROUP_BYTES", group)
    docs = fixture()
    rows = [(d, t, "clash") for d, t in docs] + [(900, None, "c"), (901, "", "c"), (None, docs[1][1], "c"), (7, docs[7][1], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, anchors string")
    got = [(r.doc_id, r.first_word, r.n_words) for r in phrases.repeated_spans(df).collect()]
    assert set(got) == brute(docs) and len(got) == len(set(got))
    assert phrases.repeated_spans(df.limit(0)).count() == 0


def test_rows_of_one_doc_id_give_one_answer_in_any_order(spark):
    rng = random.Random(6)
    text = lambda n: " ".join(f"w{rng.randint(0, 999)}" for _ in range(n))
    a, b, c = text(90), text(60), text(70)
    rows = [(1, a), (2, b + " " + a), (1, c), (3, "z " + c), (4, None), (4, "")]
    found = []
    for order in (rows, rows[::-1], rows[2:] + rows[:2]):
        df = spark.createDataFrame(order, "doc_id long, text string")
        found.append(sorted(tuple(r) for r in phrases.repeated_spans(df).collect()))
    assert found[0] == found[1] == found[2]
    # The text that counts for 1 is one of the two.
    assert found[0] in ([(1, 0, 90), (2, 60, 90)], [(1, 0, 70), (3, 1, 70)])
