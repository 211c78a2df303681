"""Operator 2: quality classifier, gradient-boosted trees over document statistics.

Statistics come from byte and word passes over whole texts.  Two boosted models
(quality, toxicity) are fitted on at most ``fit_rows`` labelled documents, chosen
by a hash of their doc_id; how often documents of either label hold a word is
counted on the same rows and gives the lexicon behind two of the statistics.
Trees grow on histograms of at most 64 bins and are flattened into arrays, so a
batch of documents descends all trees at once with numpy indexing.

Results for odd input: a null text is scored as an empty one; a null doc_id is
kept and scored; repeated rows are scored each, and where rows with one doc_id
differ the greatest text is fitted on; ties of a statistic fall on one side of
every split; labels that are null, repeated
(the greatest counts) or without a document are left out; without labels of
both kinds a model is constant (everything is kept); further columns of
documents pass through ``filter_documents`` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import written

FIT_ROWS = 8192
LEXICON = 512
SCHEMA = "doc_id long, p_quality double, p_toxic double, keep boolean"

_KINDS = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (32, 9, 13), "line": (10,), "stop": b".,;:", "shout": b"!?", "pipe": b"|\\/_=<>", "symbol": b"#$%&*@~^+`", "quote": b"'\"()[]{}-", "lead": range(192, 256), "tail": range(128, 192)}
_KIND = np.zeros(256, np.int64)
for _i, _k in enumerate(_KINDS, 1):
    _KIND[list(_KINDS[_k])] = _i
N_KINDS = len(_KINDS) + 1


def _sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(owner, values, minlength=n)


def statistics(texts: pa.Array, lexicon: np.ndarray) -> np.ndarray:
    """A row of numbers for each text; lexicon: sorted word hashes."""
    n = len(texts)
    data, offsets = K.buffers(texts)
    size = np.diff(offsets)
    kinds = np.bincount(np.repeat(np.arange(n) * N_KINDS, size) + _KIND[data], minlength=n * N_KINDS).reshape(n, N_KINDS).astype(float)
    chars = np.maximum(size - kinds[:, -1], 1)
    w, count = K.words(texts)
    doc = np.repeat(np.arange(n), count)
    words = np.maximum(count, 1)
    grams, have = K.ngrams(w, count, 3)
    gdoc = np.repeat(np.arange(n), have)

    def variety(x: np.ndarray, owner: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = np.sort((owner.astype(np.uint64) << np.uint64(50)) | (x >> np.uint64(14)))
        starts, lengths = K.runs(key)
        of = (key[starts] >> np.uint64(50)).astype(np.int64)
        most = np.zeros(n)
        np.maximum.at(most, of, lengths)
        return np.bincount(of, minlength=n) / np.maximum(total, 1), most / np.maximum(total, 1)

    distinct, top = variety(w, doc, count)
    distinct3, top3 = variety(grams, gdoc, have)
    same = np.zeros(len(w))
    same[1:] = (w[1:] == w[:-1]) & (doc[1:] == doc[:-1])
    letters, lcount = K.words(texts, "letters")
    ldoc = np.repeat(np.arange(n), lcount)
    hit = lexicon[np.minimum(np.searchsorted(lexicon, letters), len(lexicon) - 1)] == letters if len(lexicon) else np.zeros(len(letters), bool)
    hits = _sums(hit.astype(float), ldoc, n)
    return np.column_stack(
        [np.log1p(size), np.log1p(count), size / words, distinct, top, distinct3, top3, _sums(same, doc, n) / words, kinds[:, 5] / words, hits, hits / np.maximum(lcount, 1), lcount / words]
        + [kinds[:, k] / chars for k in range(N_KINDS - 1)]
    )


@dataclass
class Trees:
    """A boosted model as arrays over all nodes of all trees."""

    feature: np.ndarray
    threshold: np.ndarray
    child: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities; a leaf is its own child, so every row takes depth steps in every tree."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = self.child[node, (x[rows, self.feature[node]] > self.threshold[node]).astype(np.int64)]
        return 1 / (1 + np.exp(-(self.base + self.value[node].sum(axis=1))))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 50, depth: int = 4, rate: float = 0.2, bins: int = 64, least: int = 12, ridge: float = 1.0) -> Trees:
    """Histogram gradient boosting for the logistic loss."""
    n = len(y)
    p = y.mean() if n else 0.0
    nodes: list[list] = []
    roots: list[int] = []
    base = float(np.log(p / (1 - p))) if 0 < p < 1 else (20.0 if p == 1 else -20.0)
    if 0 < p < 1:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
        raw = np.full(n, base)
        for _ in range(trees):
            q = 1 / (1 + np.exp(-raw))
            g, h = q - y, q * (1 - q)
            root = len(nodes)
            roots.append(root)
            nodes.append([0, np.inf, root, root, 0.0])
            at = np.full(n, root)
            open_nodes = [root]
            for level in range(depth + 1):
                following = []
                local = {node: i for i, node in enumerate(open_nodes)}
                place = np.full(len(nodes), -1)
                place[open_nodes] = np.arange(len(open_nodes))
                slot = place[at]
                live = slot >= 0
                gs, hs = np.bincount(slot[live], g[live], len(local)), np.bincount(slot[live], h[live], len(local))
                best = np.full(len(local), 1e-6)
                choice = [None] * len(local)
                if level < depth:
                    for f, e in enumerate(edges):
                        if not len(e):
                            continue
                        width = len(e) + 1
                        key = slot[live] * width + binned[live, f]
                        shape = (len(local), width)
                        gl, hl, cl = (np.cumsum(np.bincount(key, v, len(local) * width).reshape(shape), axis=1)[:, :-1] for v in (g[live], h[live], np.ones(live.sum())))
                        total = cl[:, -1:] + np.bincount(key, minlength=len(local) * width).reshape(shape)[:, -1:]
                        gain = gl**2 / (hl + ridge) + (gs[:, None] - gl) ** 2 / (hs[:, None] - hl + ridge) - (gs**2 / (hs + ridge))[:, None]
                        gain[(cl < least) | (total - cl < least)] = 0
                        b = gain.argmax(axis=1)
                        for i in range(len(local)):
                            if gain[i, b[i]] > best[i]:
                                best[i], choice[i] = gain[i, b[i]], (f, b[i])
                for node, i in local.items():
                    if choice[i] is None:
                        nodes[node][4] = -rate * gs[i] / (hs[i] + ridge)
                        continue
                    f, b = choice[i]
                    a = len(nodes)
                    nodes[node][:4] = [f, edges[f][b], a, a + 1]
                    nodes += [[0, np.inf, a, a, 0.0], [0, np.inf, a + 1, a + 1, 0.0]]
                    mine = at == node
                    at[mine] = np.where(binned[mine, f] > b, a + 1, a)
                    following += [a, a + 1]
                open_nodes = following
                if not open_nodes:
                    break
            raw += np.array([v[4] for v in nodes])[at]
    table = nodes or [[0, np.inf, 0, 0, 0.0]]
    return Trees(np.array([v[0] for v in table]), np.array([v[1] for v in table], float), np.array([v[2:4] for v in table]), np.array([v[4] for v in table], float), np.array(roots or [0]), depth, base)


@dataclass
class Model:
    lexicon: np.ndarray
    quality: Trees
    toxic: Trees


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, lexicon: int = LEXICON) -> Model:
    """Fits both models on at most fit_rows labelled documents; what comes to the driver has that bound too."""
    chosen = (
        labels.where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # One text for each doc_id, in a table of at most fit_rows rows: the documents are read once.
    rows = rows.groupBy("doc_id", "quality", "toxic").agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    rows = written(rows.select("doc_id", "text", "quality", "toxic"), "quality-labelled")

    def words(batches):
        for batch in batches:
            w, count = K.words(batch.column("text"), "letters")
            doc = np.repeat(np.arange(batch.num_rows), count)
            toxic = batch.column("toxic").to_numpy(zero_copy_only=False).astype(np.int64)
            order = np.lexsort((w, doc))
            w, doc = w[order], doc[order]
            first = np.ones(len(w), bool)
            first[1:] = (w[1:] != w[:-1]) | (doc[1:] != doc[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(w[first].view(np.int64)), pa.array(toxic[doc[first]])], ["word", "toxic"])

    held = rows.mapInArrow(words, "word long, toxic long").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count("*").alias("all"))
    share = F.col("bad") / F.col("all")
    top = held.where((F.col("bad") >= 5) & (share >= 0.5)).orderBy((share * F.log1p("bad")).desc(), "word").limit(lexicon)
    lex = np.sort(np.array([r[0] for r in top.collect()], np.int64).view(np.uint64))

    def measured(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = statistics(part.column("text"), lex)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), part.column("quality").cast(pa.int64()), part.column("toxic").cast(pa.int64()), pa.array(list(x), pa.list_(pa.float64()))], ["doc_id", "quality", "toxic", "x"])

    table = rows.mapInArrow(measured, "doc_id long, quality long, toxic long, x array<double>").orderBy("doc_id").toArrow()
    if not table.num_rows:
        nothing = fit(np.zeros((0, 1)), np.zeros(0))
        yes = Trees(nothing.feature, nothing.threshold, nothing.child, nothing.value, nothing.roots, nothing.depth, 20.0)
        return Model(lex, yes, nothing)
    x = np.array(table.column("x").to_pylist(), float)
    y = {c: np.array(table.column(c).to_pylist(), float) for c in ("quality", "toxic")}
    return Model(lex, fit(x, y["quality"]), fit(x, y["toxic"]))


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """doc_id, p_quality, p_toxic and keep for every row of docs, in one narrow pass after the fit."""
    model = train(docs, labels, fit_rows)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = statistics(part.column("text"), model.lexicon)
                q, t = model.quality.score(x), model.toxic.score(x)
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(np.round(q, 6)), pa.array(np.round(t, 6)), pa.array((q >= least_quality) & (t < most_toxic))], ["doc_id", "p_quality", "p_toxic", "keep"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def filter_documents(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, least_quality: float = 0.5, most_toxic: float = 0.5) -> DataFrame:
    """The rows of docs that the classifier keeps, with all their columns, without a join."""
    model = train(docs, labels, fit_rows)

    def run(batches):
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 512):
                x = statistics(batch.column("text").slice(at, 512), model.lexicon)
                keep.append((model.quality.score(x) >= least_quality) & (model.toxic.score(x) < most_toxic))
            yield batch.filter(pa.array(np.concatenate(keep) if keep else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)
