"""Operator 3: benchmark decontamination by latent semantic retrieval.

1. One scan counts in how many passages (32 words) every hashed term occurs,
   over all documents; that gives TF-IDF weights.
2. A second scan applies the Gram matrix of all TF-IDF passages, row by row, to
   a random test matrix.  Tasks send sums per block of terms, so what reaches
   the driver has the size of the term space, whatever the corpus.  The
   Nystroem form of the randomised SVD turns it into a latent basis.
3. A third scan takes windows of every document, at the scales of the items and
   every 8 words.  A common subsequence is at most the item's places of its
   frequent words plus the window's words among its other ones, so a window
   with fewer of those than ``weak`` leaves room for can't leak the item; all
   others are checked word by word: the longest common subsequence with the whole
   item, bit-parallel over all candidates at once (64 words of the item to a
   machine word, with carries between them), and the share of the answer (the
   last quarter of the item's words) that is found in order.  The sieve loses
   nothing that the check would accept.  Leaks get their latent cosine.

A document leaks an item if their subsequence covers ``strong`` of the item, or
``weak`` of it with at least half of the answer.  An item of fewer than 8 words
is leaked by the same words in a row only, found by hash at every word, since
parts of it are common phrases.

Words are runs of letters and digits, so neither punctuation nor table marks hide
a leak.  Results for odd input: null and empty texts leak nothing; items that are null
or without words are ignored; equal items and repeated rows get results of their
own; of rows with the same item_id each counts; with an empty benchmark, or no
documents, the result is empty; further columns are ignored.  A benchmark of more than
``BENCH_BYTES`` is searched for in parts of about that size, a scan each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import size_of

TERM_BITS = 11
RANK, EXTRA = 56, 8
PASSAGE, STEP = 32, 8
LIMB = 64
LEAST_WORDS = 8
BENCH_BYTES = 16 << 20
STRONG, WEAK, ANSWER = 0.75, 0.6, 0.5
ROWS = 512
_BLOCKS = 16
DENSE = 256
CHUNK = 256
#: The share of a text's words that an item's most frequent term is taken to have; only the sieve's speed hangs on it.
FREQUENT = 0.1
TABLE = 1 << 24
SCHEMA = "doc_id long, item_id long, cosine double, overlap double, answer double, first_word long"


def _terms(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(64 - TERM_BITS)).astype(np.int64)


def _passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passage, term and count of every term of every passage of PASSAGE words."""
    w, counts = K.words(texts, "plain")
    per = -(-counts // PASSAGE)
    place = np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
    passage = np.repeat(np.cumsum(per) - per, counts) + place // PASSAGE
    key = np.sort((passage << TERM_BITS) | _terms(w))
    starts, lengths = K.runs(key)
    return key[starts] >> TERM_BITS, key[starts] & ((1 << TERM_BITS) - 1), lengths


def _summed(docs: DataFrame, partial, width: int) -> np.ndarray:
    """The sum over all tasks of partial(batches), an array of 2 ** TERM_BITS rows, added up block by block."""

    def run(batches):
        total = partial(batches)
        yield pa.RecordBatch.from_arrays([pa.array(range(_BLOCKS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, _BLOCKS)], pa.binary())], ["block", "sums"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.float64) for x in group.column("sums"))
        return pa.table({"block": group.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.select("text").mapInArrow(run, "block int, sums binary").groupBy("block").applyInArrow(add, "block int, sums binary").orderBy("block").collect()
    if not rows:
        return np.zeros((1 << TERM_BITS, width))
    return np.concatenate([np.frombuffer(r["sums"], np.float64) for r in rows]).reshape(-1, width)


def weigh(docs: DataFrame) -> np.ndarray:
    """Inverse document frequencies of all terms, over the passages of all documents."""

    def partial(batches):
        total = np.zeros((1 << TERM_BITS, 1), np.float64)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                passage, term, _ = _passages(batch.column("text").slice(at, ROWS))
                total[:, 0] += np.bincount(term, minlength=1 << TERM_BITS)
        return total

    df = _summed(docs, partial, 1)[:, 0]
    # Terms sum over passages; the most frequent bounds how many there are closely enough for weights.
    return np.log((1 + df.max(initial=0)) / (1 + df)) + 0.1


def basis(docs: DataFrame, idf: np.ndarray, seed: int = 11) -> np.ndarray:
    """The leading right singular vectors of the TF-IDF passages: terms by RANK."""
    omega = np.linalg.qr(np.random.default_rng(seed).standard_normal((1 << TERM_BITS, RANK + EXTRA)))[0].astype(np.float32)
    weight = idf.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((omega, weight))

    def partial(batches):
        omega, weight = shared.value
        total = np.zeros(omega.shape)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS // 2):
                passage, term, count = _passages(batch.column("text").slice(at, ROWS // 2))
                if not len(term):
                    continue
                value = weight[term] * count.astype(np.float32)
                starts, lengths = K.runs(passage)
                value /= np.repeat(np.sqrt(np.add.reduceat(value * value, starts)), lengths)
                row = np.repeat(np.arange(len(starts)), lengths)
                # Blocks of rows are multiplied densely: far less traffic than one by one.
                for begin in range(0, len(starts), DENSE):
                    end = min(begin + DENSE, len(starts))
                    s = slice(starts[begin], starts[end] if end < len(starts) else len(term))
                    dense = np.zeros((end - begin, 1 << TERM_BITS), np.float32)
                    dense[row[s] - begin, term[s]] = value[s]
                    total += dense.T @ (dense @ omega)
        return total

    c = _summed(docs, partial, RANK + EXTRA)
    inner = omega.T.astype(np.float64) @ c
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(initial=0) * 1e-7, 1e-12)
    if not good.any():
        return np.zeros((1 << TERM_BITS, RANK), np.float32)
    half = c @ (vectors[:, good] / np.sqrt(values[good]))
    return np.linalg.svd(half, full_matrices=False)[0][:, :RANK].astype(np.float32)


@dataclass
class Items:
    """Benchmark items, ready to be searched for; short: hashes and ids of those below LEAST_WORDS, by number of words."""

    ids: np.ndarray
    words: list[np.ndarray]
    vectors: np.ndarray
    scale: np.ndarray
    least: np.ndarray
    rare: list[np.ndarray]
    vocabulary: np.ndarray
    limbs: np.ndarray
    keys: np.ndarray
    masks: np.ndarray
    table: np.ndarray | None
    short: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]


def _key(word: np.ndarray, item) -> np.ndarray:
    return K.mix(word ^ K.mix(np.atleast_1d(np.asarray(item, np.uint64)) + np.uint64(1)))


def _rare(part: np.ndarray, need: int, idf: np.ndarray) -> tuple[np.ndarray, int]:
    """The item's words that the sieve counts, and how many a window has to have of them.

    The most frequent words are left out as long as that makes chance hits less likely (Chernoff's bound for a Poisson
    count); each of their places counts as matched, so any choice is lossless.
    """
    unique, times = np.unique(part, return_counts=True)
    rate = np.exp(-idf[_terms(unique)])
    order = np.argsort(-rate, kind="stable")
    unique, times, rate = unique[order], times[order], rate[order] * (FREQUENT / rate.max())
    mean = (-(-len(part) // STEP) + 2) * STEP * np.maximum(np.append(np.cumsum(rate[::-1])[::-1], 0), 1e-9)
    least = need - np.append(0, np.cumsum(times))
    able = np.flatnonzero(least > 0)
    mean, least = mean[able], least[able]
    chance = np.where(least > mean, least - mean + least * np.log(mean / least), 0)
    best = int(np.argmin(chance))
    return unique[best:], int(least[best])


def _limbs(part: np.ndarray):
    """For every 64 words of an item: its different words, and at which of these places each is, as bits."""
    for at in range(0, len(part), LIMB):
        unique, where = np.unique(part[at : at + LIMB], return_inverse=True)
        mask = np.zeros(len(unique), np.uint64)
        np.bitwise_or.at(mask, where, np.uint64(1) << np.arange(len(where), dtype=np.uint64))
        yield unique, mask


def _unit(latent: np.ndarray, part: np.ndarray) -> np.ndarray:
    v = latent[_terms(part)].sum(axis=0)
    return v / max(np.linalg.norm(v), 1e-9)


def prepare(benchmark: DataFrame, latent: np.ndarray, share: float = WEAK, idf: np.ndarray | None = None) -> Items:
    """Embeds all items and fits their sieves to leaks of at least share; benchmark, of bounded size, comes to the driver."""
    table = benchmark.where("item_id is not null and text is not null").select("item_id", "text").orderBy("item_id", "text").toArrow()
    w, counts = K.words(table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string()), "plain")
    ids, words, brief = [], [], {}
    for i, n, end in zip(table.column("item_id").to_pylist(), counts.tolist(), np.cumsum(counts)):
        part = w[end - n : end]
        if n >= LEAST_WORDS:
            ids.append(i)
            words.append(part)
        elif n:
            brief.setdefault(n, []).append((K.rolling(part, np.array([0]), np.array([n]))[0], i, _unit(latent, part)))
    short = {}
    for n, rows in brief.items():
        order = np.argsort(np.array([r[0] for r in rows], np.uint64), kind="stable")
        short[n] = (np.array([rows[k][0] for k in order], np.uint64), np.array([rows[k][1] for k in order], np.int64), np.array([rows[k][2] for k in order]))
    idf = np.zeros(1 << TERM_BITS) if idf is None else idf
    rare, least = [], []
    for part in words:
        own, count = _rare(part, max(1, int(np.ceil(share * len(part) - 1e-9))), idf)
        rare.append(own)
        least.append(count)
    # Rows of 64 words each, numbered through; limbs holds each item's first.
    rows = [x for part in words for x in _limbs(part)]
    limbs = np.concatenate(([0], np.cumsum([-(-len(x) // LIMB) for x in words]))).astype(np.int64)
    keys = np.concatenate([_key(u, r) for r, (u, _) in enumerate(rows)] or [np.zeros(0, np.uint64)])
    order = np.argsort(keys)
    vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
    table = None
    if len(rows) * (len(vocabulary) + 1) <= TABLE:
        # A small benchmark has the masks of all its words for all its items in one table.
        table = np.zeros((len(rows), len(vocabulary) + 1), np.uint64)
        for r, (unique, mask) in enumerate(rows):
            table[r, np.searchsorted(vocabulary, unique)] = mask
    return Items(
        np.array(ids, np.int64), words, np.array([_unit(latent, x) for x in words], np.float32).reshape(-1, latent.shape[1]), np.array([-(-len(x) // STEP) for x in words], np.int64),
        np.array(least, np.int64), [np.searchsorted(vocabulary, x) for x in rare], vocabulary, limbs, keys[order],
        np.concatenate([m for _, m in rows] or [np.zeros(0, np.uint64)])[order], table, short,
    )


def columns(items: Items, words: np.ndarray) -> np.ndarray:
    """Each word's column in the vocabulary, and one more entry for no word: the last column, which is empty."""
    last = len(items.vocabulary)
    at = np.minimum(np.searchsorted(items.vocabulary, words), last - 1)
    return np.append(np.where(items.vocabulary[at] == words, at, last), last)


def common(items: Items, words: np.ndarray, own: np.ndarray | None, starts: np.ndarray, lengths: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest common subsequence of words[start : start + length] with each candidate's item, as shares of the item and of its answer.

    own: the words' columns in the items' table, if they have one.
    """
    size = np.array([len(x) for x in items.words], np.int64)
    overlap, answer = np.zeros(len(item)), np.zeros(len(item))
    many = np.diff(items.limbs)[item]
    for n in np.unique(many):
        at = np.flatnonzero(many == n)
        overlap[at], answer[at] = _common(items, words, own, starts[at], lengths[at], item[at], size[item[at]], int(n))
    return overlap, answer


def _common(items: Items, words: np.ndarray, own: np.ndarray | None, starts: np.ndarray, lengths: np.ndarray, item: np.ndarray, m: np.ndarray, limbs: int) -> tuple[np.ndarray, np.ndarray]:
    tail = np.maximum(1, m // 4)
    full = np.full(len(item), 0xFFFFFFFFFFFFFFFF, np.uint64)

    def below(n: np.ndarray) -> np.ndarray:
        """The lowest n bits, n from 0 to 64."""
        n = np.clip(n, 0, LIMB)
        return np.where(n > 0, full >> np.minimum(LIMB - n, LIMB - 1).astype(np.uint64), np.uint64(0))

    mine = [below(m - LIMB * k) for k in range(limbs)]
    late = [mine[k] & ~below(m - tail - LIMB * k) for k in range(limbs)]
    state, state_late = [full.copy() for _ in mine], [full.copy() for _ in mine]
    row = items.limbs[item]
    if items.table is not None:
        width, flat = items.table.shape[1], items.table.ravel()
        base = row * width

    def step(state: list[np.ndarray], masks: list[np.ndarray]) -> None:
        carry = None
        for k in range(limbs):
            u = state[k] & masks[k]
            total = state[k] + u
            if limbs > 1:
                over = total < u
                if carry is not None:
                    total = total + carry
                    over |= (total == 0) & (carry != 0)
                carry = over.astype(np.uint64)
            state[k] = total | (state[k] - u)

    for k in range(int(lengths.max(initial=0))):
        live = k < lengths
        if items.table is not None:
            column = base + own[np.where(live, starts + k, len(words))]
            masks = [flat[column + l * width] for l in range(limbs)]
        else:
            word, masks = words[np.where(live, starts + k, 0)], []
            for l in range(limbs):
                key = _key(word, row + l)
                at = np.minimum(np.searchsorted(items.keys, key), len(items.keys) - 1)
                masks.append(np.where(live & (items.keys[at] == key), items.masks[at], np.uint64(0)))
        step(state, masks)
        step(state_late, [x & y for x, y in zip(masks, late)])
    count = lambda state, mask: sum(np.bitwise_count(~s & x).astype(np.int64) for s, x in zip(state, mask))
    return count(state, mine) / m, count(state_late, late) / tail


def _sieve(items: Items, own: np.ndarray, first: np.ndarray, size: np.ndarray, low: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and items of all windows that have words enough of the item.

    own: the words' columns in the vocabulary. first, size: each block's first word and words. low, stop: the blocks of its text.
    """
    last, order = len(items.vocabulary), np.argsort(items.scale, kind="stable")
    blocks, found = np.arange(len(first)), []
    before = np.maximum(blocks - 1, low)
    for at in range(0, len(order), CHUNK):
        mine = order[at : at + CHUNK]
        word = np.concatenate([items.rare[i] for i in mine])
        used = np.unique(word)
        # A row per word of these items, and a last one for all other words.
        row = np.full(last + 1, len(used))
        row[used] = np.arange(len(used))
        has = np.zeros((len(used) + 1, len(mine)), np.uint8)
        has[row[word], np.repeat(np.arange(len(mine)), [len(items.rare[i]) for i in mine])] = 1
        place = row[own]
        # Sums of a window are small: differences hold though the running sums wrap around.
        kind = np.uint16 if items.scale[mine].max() < 4096 else np.uint32
        total = np.zeros((len(first) + 1, len(mine)), kind)
        block = has[place[first]]
        for k in range(1, STEP):
            block += has[place[np.where(k < size, first + k, len(own) - 1)]]
        np.cumsum(block, axis=0, dtype=kind, out=total[1:])
        scale = items.scale[mine]
        for q in np.unique(scale):
            s = slice(*np.searchsorted(scale, [q, q + 1]))
            count = total[np.minimum(blocks + q + 1, stop), s] - total[before, s]
            b, i = np.nonzero(count >= items.least[mine[s]].astype(kind))
            found.append((b, mine[s][i]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _cosine(latent: np.ndarray, items: Items, term: np.ndarray, start: np.ndarray, end: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The latent cosine of each window term[start:end] with its item."""
    total = np.zeros((len(item), latent.shape[1]))
    for k in range(int((end - start).max(initial=0))):
        live = start + k < end
        total[live] += latent[term[start[live] + k]]
    return np.einsum("ij,ij->i", total, items.vectors[item]) / np.maximum(np.sqrt(np.einsum("ij,ij->i", total, total)), 1e-9)


def _exact(w: np.ndarray, counts: np.ndarray, items: Items, latent: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """doc, item_id, cosine, overlap, answer, place of short items, word for word."""
    out = []
    for n, (keys, ids, vectors) in items.short.items():
        first = K.windows(counts, n)
        if not len(first):
            continue
        h = K.rolling(w, first, first + n)
        lo, hi = np.searchsorted(keys, h, side="left"), np.searchsorted(keys, h, side="right")
        hit = np.flatnonzero(hi > lo)
        which, at = K.spans(lo[hit], (hi - lo)[hit]), np.repeat(first[hit], (hi - lo)[hit])
        doc = np.searchsorted(np.cumsum(counts), at, side="right")
        # The words are the item's own, and so is their sum.
        cosine = np.minimum(1, np.einsum("ij,ij->i", vectors[which], vectors[which]))
        out.append((doc, ids[which], cosine, np.ones(len(at)), np.ones(len(at)), at - (np.cumsum(counts) - counts)[doc]))
    return out


def _long(w: np.ndarray, counts: np.ndarray, items: Items, latent: np.ndarray, strong: float, weak: float) -> list[tuple[np.ndarray, ...]]:
    """The same of all other items, by sieve and subsequence."""
    blocks = -(-counts // STEP)
    doc = np.repeat(np.arange(len(counts)), blocks)
    base = np.cumsum(counts) - counts
    low = np.repeat(np.cumsum(blocks) - blocks, blocks)
    first = base[doc] + (np.arange(len(doc)) - low) * STEP
    if not len(first) or not len(items.ids):
        return []
    own = columns(items, w)
    b, item = _sieve(items, own, first, np.minimum(STEP, base[doc] + counts[doc] - first), low, np.repeat(np.cumsum(blocks), blocks))
    if not len(b):
        return []
    q = items.scale[item]
    start = np.maximum(first[b] - STEP, base[doc[b]])
    end = np.minimum(first[b] + (q + 1) * STEP, base[doc[b]] + counts[doc[b]])
    overlap, answer = np.zeros(len(b)), np.zeros(len(b))
    for at in range(0, len(b), 1 << 13):
        s = slice(at, at + (1 << 13))
        overlap[s], answer[s] = common(items, w, own, start[s], end[s] - start[s], item[s])
    leak = (overlap >= strong) | ((overlap >= weak) & (answer >= ANSWER))
    b, item, q, overlap, answer = (x[leak] for x in (b, item, q, overlap, answer))
    cosine = _cosine(latent, items, _terms(w), first[b], np.minimum(first[b] + q * STEP, base[doc[b]] + counts[doc[b]]), item)
    return [(doc[b], items.ids[item], cosine, overlap, answer, first[b] - base[doc[b]])]


def _search(texts: pa.Array, items: Items, latent: np.ndarray, strong: float, weak: float):
    """doc, item, cosine, overlap, answer, first word of the best leak of every document and item."""
    w, counts = K.words(texts, "plain")
    found = _exact(w, counts, items, latent) + _long(w, counts, items, latent, strong, weak)
    if not found:
        return [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] * 3 + [np.zeros(0, np.int64)]
    d, ids, cosine, overlap, answer, place = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((place, -cosine, -overlap, ids, d))
    d, ids = d[order], ids[order]
    best = np.ones(len(d), bool)
    best[1:] = (d[1:] != d[:-1]) | (ids[1:] != ids[:-1])
    return [d[best], ids[best], *[x[order][best] for x in (cosine, overlap, answer, place)]]


def _model(docs: DataFrame, benchmark: DataFrame, share: float):
    """What to search for, a broadcast for each part of the benchmark, each of bounded size."""
    idf = weigh(docs)
    v = basis(docs, idf)
    latent = v * idf[:, None].astype(np.float32)
    parts = max(1, -(-size_of(benchmark.select("item_id", "text")) // BENCH_BYTES))
    of = F.pmod(F.xxhash64("item_id"), F.lit(parts))
    return [docs.sparkSession.sparkContext.broadcast((prepare(benchmark.where(of == k), latent, share, idf), latent)) for k in range(parts)]


def leaks(docs: DataFrame, benchmark: DataFrame, strong: float = STRONG, weak: float = WEAK) -> DataFrame:
    """A row per document and leaked item: doc_id, item_id, cosine, overlap, answer, first_word."""

    def search(shared) -> DataFrame:
        def run(batches):
            items, latent = shared.value
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    d, ids, cosine, overlap, answer, place = _search(part.column("text"), items, latent, strong, weak)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id").cast(pa.int64()).take(pa.array(d)), pa.array(ids), *[pa.array(np.round(x.astype(np.float64), 4)) for x in (cosine, overlap, answer)], pa.array(place)],
                        ["doc_id", "item_id", "cosine", "overlap", "answer", "first_word"],
                    )

        return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)

    first, *more = map(search, _model(docs, benchmark, min(strong, weak)))
    for x in more:
        first = first.unionByName(x)
    return first


def decontaminate(docs: DataFrame, benchmark: DataFrame, strong: float = STRONG, weak: float = WEAK) -> DataFrame:
    """The rows of docs that leak no item, with all their columns, without a join."""

    def sift(docs: DataFrame, shared) -> DataFrame:
        def run(batches):
            items, latent = shared.value
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                for at in range(0, batch.num_rows, ROWS):
                    keep[at + _search(batch.column("text").slice(at, ROWS), items, latent, strong, weak)[0]] = False
                yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)

    for shared in _model(docs, benchmark, min(strong, weak)):
        docs = sift(docs, shared)
    return docs
