"""Operator 9: language ID of every word by a linear-chain conditional random field.

A word's features are its prefixes and suffixes of 1 to 3 bytes, its bigrams and
trigrams of bytes with boundary marks, and the word itself if it is in the
lexicon of frequent training words; all are hashed into one weight table.
Transitions between neighbouring words are learned with them.  Training uses at
most ``fit_docs`` documents, chosen by a hash of doc_id, with the column
``lang``; since each has one language, their stretches are shuffled into
code-switched sequences.  Inference is exact forward-backward over whole
documents: stretches of 32 words are condensed into transfer matrices all at
once, the matrices of a document are chained, and the stretches filled in.

Results for odd input: a document without words (null, empty, blank) has a null
lang and confidence and no segments; without labelled training documents the
same holds for all; null labels are not trained on; repeated rows are labelled
each; ties go to the language that comes first in the alphabet; further columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

FIT_DOCS = 400
BITS = 16
STEP = 32
ROWS = 512
CACHE = 1_000_000
SCHEMA = "doc_id long, lang string, confidence double, n_words long, n_switches long, seg_lang array<string>, seg_words array<int>"


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features of the words data[start:end], and how many each word has."""
    n, size = len(starts), ends - starts
    # The bytes of each word between two boundary marks on either side.
    wide = size + 4
    at = np.cumsum(wide) - wide
    padded = np.zeros(int(wide.sum()), np.uint64)
    padded[K.spans(at + 2, size)] = data[K.spans(starts, size)].astype(np.uint64) + np.uint64(1)
    codes, owners = [], []

    def add(kind: int, code: np.ndarray, owner: np.ndarray) -> None:
        codes.append(K.mix(code * np.uint64(16) + np.uint64(kind)) >> np.uint64(64 - BITS))
        owners.append(owner)

    every = np.arange(n)
    for width, inner in ((2, size + 1), (3, size)):
        first = K.spans(at + 1, np.maximum(inner, 0))
        code = np.zeros(len(first), np.uint64)
        for k in range(width):
            code = code * np.uint64(512) + padded[first + k]
        add(width, code, np.repeat(every, np.maximum(inner, 0)))
    for width in (1, 2, 3):
        have = np.flatnonzero(size >= width)
        head, tail = np.zeros(len(have), np.uint64), np.zeros(len(have), np.uint64)
        for k in range(width):
            head = head * np.uint64(512) + padded[at[have] + 2 + k]
            tail = tail * np.uint64(512) + padded[at[have] + 2 + size[have] - width + k]
        add(4 + width, head, have)
        add(8 + width, tail, have)
    if len(lexicon):
        known = np.flatnonzero(lexicon[np.minimum(np.searchsorted(lexicon, hashes), len(lexicon) - 1)] == hashes)
        add(12, hashes[known] >> np.uint64(8), known)
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(codes)[order].astype(np.int64), np.bincount(owner, minlength=n)


def emissions(weights: np.ndarray, buckets: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The summed weights of each word's features."""
    total = np.concatenate((np.zeros((1, weights.shape[1])), np.cumsum(weights[buckets], axis=0)))
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


def marginals(scores: np.ndarray, transitions: np.ndarray, counts: np.ndarray, moves: bool = False):
    """Label probabilities of every word, by forward-backward over each sequence.

    scores: words by labels, log scale; a sequence starts from a uniform label.
    moves: also give how often each label is expected to follow each other, the start's label included.
    """
    n, k = scores.shape
    out = np.zeros((n, k))
    if not n:
        return (out, np.zeros((k, k))) if moves else out
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    t = np.exp(transitions - transitions.max())
    chunks = -(-counts // STEP)
    c_doc = np.repeat(np.arange(len(counts)), chunks)
    c_no = np.arange(len(c_doc)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    c_start = np.repeat(np.cumsum(counts) - counts, chunks) + c_no * STEP
    c_len = np.minimum(STEP, counts[c_doc] - c_no * STEP)
    m = len(c_doc)
    power = np.tile(np.eye(k), (m, 1, 1))
    full = np.ones((m, STEP, k))
    inside = np.arange(STEP)[None, :] < c_len[:, None]
    full[inside] = e
    for s in range(STEP):
        step = (power.reshape(m * k, k) @ t).reshape(m, k, k) * full[:, s, None, :]
        step /= step.max(axis=(1, 2), keepdims=True)
        power = np.where(inside[:, s, None, None], step, power)
    ahead, behind = np.full((m, k), 1.0 / k), np.ones((m, k))
    first = np.cumsum(chunks) - chunks
    for c in range(1, int(chunks.max())):
        at = first[chunks > c] + c
        x = np.einsum("ni,nij->nj", ahead[at - 1], power[at - 1])
        ahead[at] = x / x.sum(axis=1, keepdims=True)
    for c in range(int(chunks.max()) - 2, -1, -1):
        at = first[chunks > c + 1] + c
        x = np.einsum("nij,nj->ni", power[at + 1], behind[at + 1])
        behind[at] = x / x.sum(axis=1, keepdims=True)
    alpha = np.empty((m, STEP, k))
    a = ahead
    for s in range(STEP):
        x = (a @ t) * full[:, s]
        a = np.where(inside[:, s, None], x / x.sum(axis=1, keepdims=True), a)
        alpha[:, s] = a
    if moves:
        before = np.concatenate((ahead[:, None], alpha[:, :-1]), axis=1)
        onward = np.empty_like(alpha)
    b = behind
    for s in range(STEP - 1, -1, -1):
        alpha[:, s] *= b
        x = full[:, s] * b
        if moves:
            onward[:, s] = x
        x = x @ t.T
        b = np.where(inside[:, s, None], x / x.sum(axis=1, keepdims=True), b)
    out = alpha[inside]
    out /= out.sum(axis=1, keepdims=True)
    if not moves:
        return out
    # The chance of a pair of labels: what leads to the first, the move, and what the second leads to.
    both = before[inside][:, :, None] * t * onward[inside][:, None, :]
    return out, (both / both.sum(axis=(1, 2), keepdims=True)).sum(axis=0)


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    lexicon: np.ndarray


def _types(texts: pa.Array):
    data, offsets = K.buffers(K.lower(texts))
    starts, ends, counts = K.word_bounds(data, offsets)
    h = K.rolling(data, starts, ends)
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    return data, starts[first], ends[first], unique, inverse, counts


def fit(texts: list[str], langs: list[str], rounds: int = 40, rate: float = 0.25, ridge: float = 1e-5, lexicon: int = 4096, seed: int = 7) -> Model:
    """Maximum likelihood with Adam on code-switched sequences made of the texts' stretches."""
    labels = sorted(set(langs))
    k = len(labels)
    if not k:
        return Model([], np.zeros((1 << BITS, 0)), np.zeros((0, 0)), np.zeros(0, np.uint64))
    data, starts, ends, h, word, counts = _types(pa.array(texts, pa.string()))
    gold = np.repeat(np.array([labels.index(x) for x in langs]), counts)
    often = np.bincount(word, minlength=len(h))
    lex = np.sort(h[np.argsort(-often, kind="stable")[:lexicon]])
    buckets, per = features(data, starts, ends, h, lex)
    # Stretches of 8 to 40 words, each language's share of words alike, in random order: sequences of 256 words.
    rng = np.random.default_rng(seed)
    at, stretches = 0, []
    for n in counts:
        end = at + int(n)
        while at < end:
            step = min(int(rng.integers(8, 41)), end - at)
            stretches.append((at, step))
            at += step
    order = rng.permutation(len(stretches))
    row = np.concatenate([np.arange(s, s + n) for s, n in (stretches[i] for i in order)]) if stretches else np.zeros(0, int)
    word, gold = word[row], gold[row]
    sizes = np.diff(np.concatenate((np.arange(0, len(row), 256), [len(row)]))) if len(row) else np.zeros(0, int)
    weights, moves = np.zeros((1 << BITS, k)), np.zeros((k, k))
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    owner = np.repeat(np.arange(len(h)), per)
    truth = np.zeros((len(word), k))
    truth[np.arange(len(word)), gold] = 1
    joined = np.ones(len(word), bool)
    joined[np.cumsum(sizes) - sizes] = False
    pairs = np.bincount(gold[:-1][joined[1:]] * k + gold[1:][joined[1:]], minlength=k * k).reshape(k, k) if len(gold) else np.zeros((k, k))
    firsts = np.bincount(gold[~joined], minlength=k)
    for r in range(1, rounds + 1 if len(word) else 1):
        score = emissions(weights, buckets, per)[word]
        p, expected = marginals(score, moves, sizes, moves=True)
        gap = p - truth
        by_type = np.column_stack([np.bincount(word, gap[:, j], minlength=len(h)) for j in range(k)])
        g = np.column_stack([np.bincount(buckets, by_type[owner, j], minlength=1 << BITS) for j in range(k)]) / len(word) + ridge * weights
        # The start's label is unknown in the truth too: it has the share that its move to the first label gives it.
        begin = np.exp(moves - moves.max())
        seen = pairs + begin / begin.sum(axis=0) * firsts
        gm = (expected - seen) / len(word) + ridge * moves
        for x, grad, i in ((weights, g, 0), (moves, gm, 2)):
            state[i] = 0.9 * state[i] + 0.1 * grad
            state[i + 1] = 0.99 * state[i + 1] + 0.01 * grad**2
            x -= rate * (state[i] / (1 - 0.9**r)) / (np.sqrt(state[i + 1] / (1 - 0.99**r)) + 1e-8)
    return Model(labels, weights, moves, lex)


def train(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model:
    """Fits on at most fit_docs labelled documents, the only rows that come to the driver."""
    ids = docs.where("lang is not null and doc_id is not null and text is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    rows = docs.join(F.broadcast(ids.distinct()), "doc_id", "left_semi").where("lang is not null and text is not null").select("doc_id", "text", "lang").orderBy("doc_id", "text", "lang").limit(fit_docs).toArrow()
    return fit(rows.column("text").to_pylist(), rows.column("lang").to_pylist())


class Labeller:
    """Marginals of batches, with the emission scores of word types kept between them."""

    def __init__(self, model: Model):
        self.model = model
        self.known = np.zeros(0, np.uint64)
        self.scores = np.zeros((0, len(model.labels)))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, starts, ends, h, inverse, counts = _types(texts)
        spot = np.searchsorted(self.known, h)
        old = self.known[np.minimum(spot, len(self.known) - 1)] == h if len(self.known) else np.zeros(len(h), bool)
        score = np.empty((len(h), len(self.model.labels)))
        score[old] = self.scores[spot[old]]
        new = ~old
        if new.any():
            buckets, per = features(data, starts[new], ends[new], h[new], self.model.lexicon)
            score[new] = emissions(self.model.weights, buckets, per)
            if len(self.known) < CACHE:
                both = np.concatenate((self.known, h[new]))
                order = np.argsort(both, kind="stable")
                self.known, self.scores = both[order], np.concatenate((self.scores, score[new]))[order]
        return marginals(score[inverse], self.model.transitions, counts), counts


def identify(docs: DataFrame, fit_docs: int = FIT_DOCS) -> DataFrame:
    """A row for every row of docs, in one narrow pass after the fit.

    doc_id, lang (the language of most words), confidence (mean probability of
    that language), n_words, n_switches, and the segments of equal language:
    seg_lang and seg_words.
    """
    model = train(docs.select("doc_id", "text", "lang"), fit_docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        label = Labeller(shared.value)
        names = np.array(shared.value.labels, object)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                n = part.num_rows
                ids = part.column("doc_id").cast(pa.int64())
                if not len(names):
                    zero = pa.array(np.zeros(n, np.int64))
                    yield pa.RecordBatch.from_arrays([ids, pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), zero, zero, pa.array([[]] * n, pa.list_(pa.string())), pa.array([[]] * n, pa.list_(pa.int32()))], ["doc_id", "lang", "confidence", "n_words", "n_switches", "seg_lang", "seg_words"])
                    continue
                p, counts = label(part.column("text"))
                doc = np.repeat(np.arange(n), counts)
                mass = np.column_stack([np.bincount(doc, p[:, j], minlength=n) for j in range(p.shape[1])])
                mass = np.round(mass / np.maximum(counts, 1)[:, None], 6)
                best = mass.argmax(axis=1)
                none = counts == 0
                pick = p.argmax(axis=1)
                starts, length = K.runs(doc * p.shape[1] + pick)
                segments = np.bincount(doc[starts], minlength=n) if len(starts) else np.zeros(n, np.int64)
                offsets = pa.array(np.concatenate(([0], np.cumsum(segments))).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(names[best], pa.string(), mask=none), pa.array(mass[np.arange(n), best], mask=none), pa.array(counts), pa.array(np.maximum(segments - 1, 0)),
                     pa.ListArray.from_arrays(offsets, pa.array(names[pick[starts]], pa.string())), pa.ListArray.from_arrays(offsets, pa.array(length.astype(np.int32)))],
                    ["doc_id", "lang", "confidence", "n_words", "n_switches", "seg_lang", "seg_words"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
