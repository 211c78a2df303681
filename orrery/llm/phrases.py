"""Operator 1: substring deduplication with repeated-phrase automata.

A passage recurs if its ``words`` or more words in a row occur again, in
another document or elsewhere in its own.  Steps:

1. One scan chooses anchors by winnowing: of any 26 consecutive 25-word phrases
   of a text the one with the least hash, so that every window of 50 words
   holds an anchor that depends on its words alone.  Anchors are exchanged by
   hash; those of two or more texts (or of two places in one) are confirmed,
   and their least text is their hub.  Whole copies are found by text hash and
   stand for one text.
2. Hubs are spread over shards.  Each text is streamed through the shards of
   its hubs and no others, since winnowing shows that those have no phrase of
   it; large shards are split by text.  A shard compiles its confirmed phrases
   into one Aho-Corasick automaton, which locates every occurrence word by
   word, and hence the 50-word windows that may recur.
3. These windows are counted over the corpus by hash; overlapping and adjoining
   windows that occur twice or more are merged into spans.

Shards and parts are as many as the corpus has text for.  A part that a phrase of
very many texts makes too large is aggregated in pieces first, and what recurs
in it is then looked up piece by piece.

Words are lower-cased and separated by ASCII white space; spans count words
from 0.  Results for odd input: null, empty and short texts have no spans; a
text that occurs as a whole in several documents is one span in each; of rows
with the same doc_id one text counts (the one with the greatest hash), whatever
their order; rows without a doc_id are left out; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import dropped, maybe_broadcast, shuffle_parts, written

WORDS = 50
ROWS = 1024
SPLIT_WORDS = 2_000_000
#: Bytes of text for each part and shard, and of hashes that one task takes.
PART_BYTES = 32 << 20
GROUP_BYTES = 24 << 20
_WORD = re.compile(r"[^ \t\n\r\f\v]+")


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _text_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ends = np.cumsum(counts)
    a = K.rolling(hashes, ends - counts, ends)
    return a, K.mix(K.rolling(K.mix(hashes), ends - counts, ends) ^ counts.astype(np.uint64))


def _by_part(part: np.ndarray, *columns: np.ndarray):
    """(part, bytes of each column) for every part that occurs."""
    order = np.argsort(part, kind="stable")
    columns = [c[order] for c in columns]
    starts, lengths = K.runs(part[order])
    for s, n in zip(starts, lengths):
        yield (int(part[order[s]]), *[c[s : s + n].tobytes() for c in columns])


def _joined(column, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


def choose(docs: DataFrame, words: int, parts: int) -> DataFrame:
    """Rows of two kinds: doc_id, k1, k2, n_words of a text, or part and its packed anchors of a batch."""
    k = words // 2
    names = ["doc_id", "k1", "k2", "n_words", "part", "hashes", "texts"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                w, counts = K.words(part.column("text"))
                a, b = _text_keys(w, counts)
                n = part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _longs(a), _longs(b), pa.array(counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], names)
                first, h = K.anchors(w, counts, k, words - k + 1)
                doc = np.searchsorted(np.cumsum(counts), first, side="right")
                # One entry per text and anchor; its lowest bit says whether the text has it more than once.
                order = np.lexsort((h, doc))
                same = np.zeros(len(h), bool)
                same[1:] = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
                starts = np.flatnonzero(~same)
                more = np.diff(np.concatenate((starts, [len(h)]))) > 1
                h, doc = h[order][starts], doc[order][starts]
                h = (h & ~np.uint64(1)) | more.astype(np.uint64)
                rows = list(_by_part(((h >> np.uint64(1)) % np.uint64(parts)).astype(np.int64), h, a[doc]))
                if rows:
                    p, hs, ts = zip(*rows)
                    none = pa.nulls(len(p), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(p, pa.int32()), pa.array(hs, pa.binary()), pa.array(ts, pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, part int, hashes binary, texts binary")


def _sorted_anchors(rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors by hash and text, each text once, and whether a text has the anchor more than once."""
    h, text = _joined(rows.column("hashes"), np.uint64), _joined(rows.column("texts"), np.uint64)
    more = (h & np.uint64(1)).astype(bool)
    h = h & ~np.uint64(1)
    order = np.lexsort((~more, text, h))
    h, text, more = h[order], text[order], more[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[fresh], text[fresh], more[fresh]


def _hub_rows(text: np.ndarray, hub: np.ndarray, h: np.ndarray) -> pa.Table:
    """text, hub, anchors of entries: each pair once, and with a hub's own row the anchors that it stands for."""
    pairs = np.unique(np.column_stack((text, hub)), axis=0) if len(text) else np.zeros((0, 2), np.uint64)
    own = np.flatnonzero(text == hub)
    own = own[np.argsort(hub[own], kind="stable")]
    hs, hl = K.runs(hub[own])
    lists = {int(hub[own[s]]): h[own[s : s + n]].view(np.int64) for s, n in zip(hs, hl)}
    anchors = [lists[b] if a == b else None for a, b in pairs.tolist()]
    return pa.table([_longs(pairs[:, 0]), _longs(pairs[:, 1]), pa.array(anchors, pa.list_(pa.int64()))], ["text", "hub", "anchors"])


def _in_pieces(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The packed rows of parts that a task can hold, and those of larger ones with the piece that each goes to."""
    sizes = rows.groupBy("part").agg(F.sum(F.octet_length("hashes")).alias("bytes"))
    large = written(sizes.where(F.col("bytes") > GROUP_BYTES).select("part", F.ceil(F.col("bytes") / GROUP_BYTES).cast("int").alias("pieces")), "phrases-large")
    if large.isEmpty():
        return rows, None
    large = maybe_broadcast(large)
    pieces = rows.join(large, "part").withColumn("piece", F.pmod(F.xxhash64("hashes"), F.col("pieces")).cast("int"))
    return rows.join(large, "part", "left_anti"), pieces


def confirm(chosen: DataFrame) -> DataFrame:
    """text, hub, anchors: which hubs a text belongs to; a hub's own row has the anchors that it stands for."""
    schema = "text long, hub long, anchors array<long>"

    def run(group: pa.Table) -> pa.Table:
        h, text, more = _sorted_anchors(group)
        starts, lengths = K.runs(h)
        recurring = (lengths > 1) | (more[starts] if len(starts) else np.zeros(0, bool))
        starts, lengths = starts[recurring], lengths[recurring]
        at = K.spans(starts, lengths)
        return _hub_rows(text[at], np.repeat(text[starts], lengths), h[at])

    def least(group: pa.Table) -> pa.Table:
        """Each anchor of a piece with its least text, and in the last bit whether it recurs."""
        h, text, more = _sorted_anchors(group)
        starts, lengths = K.runs(h)
        again = (lengths > 1) | (more[starts] if len(starts) else np.zeros(0, bool))
        return pa.table({"part": group.column("part").slice(0, 1), "hashes": pa.array([(h[starts] | again.astype(np.uint64)).tobytes()], pa.binary()), "texts": pa.array([text[starts].tobytes()], pa.binary())})

    def hubs(group: pa.Table) -> pa.Table:
        """The recurring anchors of a part in order, and their hubs."""
        h, text, more = _sorted_anchors(group)
        starts, lengths = K.runs(h)
        keep = (lengths > 1) | np.logical_or.reduceat(more, starts) if len(starts) else np.zeros(0, bool)
        return pa.table({"part": group.column("part").slice(0, 1), "known": pa.array([h[starts[keep]].tobytes()], pa.binary()), "owners": pa.array([text[starts[keep]].tobytes()], pa.binary())})

    def look_up(batches):
        for batch in batches:
            for hashes, texts, known, owners in zip(*(batch.column(c) for c in ("hashes", "texts", "known", "owners"))):
                h, text = np.frombuffer(hashes.as_buffer(), np.uint64) & ~np.uint64(1), np.frombuffer(texts.as_buffer(), np.uint64)
                known, owners = np.frombuffer(known.as_buffer(), np.uint64), np.frombuffer(owners.as_buffer(), np.uint64)
                spot = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hit = known[spot] == h if len(known) else np.zeros(len(h), bool)
                yield from _hub_rows(text[hit], owners[spot[hit]], h[hit]).to_batches()

    packed = chosen.where("part is not null").select("part", "hashes", "texts")
    whole, pieces = _in_pieces(packed)
    rows = whole.groupBy("part").applyInArrow(run, schema)
    if pieces is not None:
        firsts = pieces.groupBy("part", "piece").applyInArrow(least, "part int, hashes binary, texts binary")
        table = written(firsts.groupBy("part").applyInArrow(hubs, "part int, known binary, owners binary"), "phrases-hot")
        rows = rows.unionByName(pieces.select("part", "hashes", "texts").join(maybe_broadcast(table), "part").mapInArrow(look_up, schema))
    return rows.groupBy("text", "hub").agg(F.array_distinct(F.flatten(F.collect_list("anchors"))).alias("anchors"))


def locate(sent: DataFrame, words: int, parts: int) -> DataFrame:
    """Packed windows (hash, doc_id, first word) near every occurrence of a shard's phrases."""
    k = words // 2

    def run(group: pa.Table) -> pa.Table:
        machine = ahocorasick.Automaton()
        low = K.lower(pa.chunked_array(group.column("text").chunks, pa.string()).combine_chunks())
        data, offsets = K.buffers(low)
        begins, ends, counts = K.word_bounds(data, offsets)
        h = K.rolling(data, begins, ends)
        del begins, ends
        at = np.cumsum(counts) - counts
        # Of rows with one doc_id only those have a say whose text is the one that counts, and one of them.
        a, b = (x.view(np.int64) for x in _text_keys(h, counts))
        right = np.flatnonzero((a == group.column("k1").to_numpy()) & (b == group.column("k2").to_numpy()))
        ids = group.column("doc_id").to_numpy()
        rows = np.sort(right[np.unique(ids[right], return_index=True)[1]]).tolist()
        anchors, plain = group.column("anchors"), {}

        def blanks(text: str) -> np.ndarray:
            """Where word j begins, less one; the last is the final blank."""
            return np.flatnonzero(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) == 32)

        for i in rows:
            plain[i] = " " + " ".join(_WORD.findall(low[i].as_py())) + " "
            wanted = np.array(anchors[i].as_py() or (), np.int64)
            if len(wanted):
                first, found = K.anchors(h[at[i] : at[i] + counts[i]], counts[i : i + 1], k, words - k + 1)
                place = blanks(plain[i])
                for p in first[np.isin((found & ~np.uint64(1)).view(np.int64), wanted)].tolist():
                    machine.add_word(plain[i][place[p] : place[p + k] + 1], k)
        starts, docs = [], []
        if len(machine):
            machine.make_automaton()
            for i in rows:
                n = int(counts[i])
                last = [e for e, _ in machine.iter(plain[i])] if n >= words else []
                if not last:
                    continue
                # A phrase ends with the blank after its last word.
                p = np.searchsorted(blanks(plain[i]), np.array(last)) - k
                edge = np.zeros(n + 2, np.int64)
                np.add.at(edge, np.maximum(p - (words - k), 0), 1)
                np.add.at(edge, np.minimum(p, n - words) + 1, -1)
                s = np.flatnonzero(np.cumsum(edge)[: n - words + 1] > 0)
                starts.append(s + at[i])
                docs.append(np.full(len(s), ids[i], np.int64))
        del machine, plain
        if not starts:
            return pa.table({"part": pa.array([], pa.int32()), "hashes": pa.array([], pa.binary()), "docs": pa.array([], pa.binary()), "starts": pa.array([], pa.binary())})
        s, d = np.concatenate(starts), np.concatenate(docs)
        x = K.rolling(h, s, s + words)
        rows = list(_by_part((x % np.uint64(parts)).astype(np.int64), x, d, s - at[np.searchsorted(np.cumsum(counts), s, side="right")]))
        return pa.table([pa.array(c, kind) for c, kind in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])], ["part", "hashes", "docs", "starts"])

    return sent.groupBy("shard", "split").applyInArrow(run, "part int, hashes binary, docs binary, starts binary")


def _starts(d: np.ndarray, s: np.ndarray) -> pa.Table:
    order = np.argsort(d, kind="stable")
    begin, length = K.runs(d[order])
    return pa.table({"doc_id": pa.array(d[order[begin]] if len(begin) else np.zeros(0, np.int64)), "starts": pa.array([s[order[b : b + n]].tobytes() for b, n in zip(begin, length)], pa.binary())})


def recurring(windows: DataFrame) -> DataFrame:
    """doc_id and packed first words of the windows that occur at least twice."""
    schema = "doc_id long, starts binary"

    def distinct(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h, d, s = _joined(group.column("hashes"), np.uint64), _joined(group.column("docs"), np.int64), _joined(group.column("starts"), np.int64)
        order = np.lexsort((s, d, h))
        h, d, s = h[order], d[order], s[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        return h[fresh], d[fresh], s[fresh]

    def run(group: pa.Table) -> pa.Table:
        h, d, s = distinct(group)
        _, lengths = K.runs(h)
        twice = np.repeat(lengths > 1, lengths)
        return _starts(d[twice], s[twice])

    def firsts(group: pa.Table) -> pa.Table:
        """Two places at most of each window of a piece: enough to tell whether it recurs, though pieces may hold one place twice."""
        h, d, s = distinct(group)
        starts, lengths = K.runs(h)
        keep = K.spans(starts, np.minimum(lengths, 2))
        return pa.table({"part": group.column("part").slice(0, 1), **{c: pa.array([x[keep].tobytes()], pa.binary()) for c, x in (("hashes", h), ("docs", d), ("starts", s))}})

    def again(group: pa.Table) -> pa.Table:
        h, _, _ = distinct(group)
        starts, lengths = K.runs(h)
        return pa.table({"part": group.column("part").slice(0, 1), "known": pa.array([h[starts[lengths > 1]].tobytes()], pa.binary())})

    def look_up(batches):
        for batch in batches:
            for hashes, docs, starts, known in zip(*(batch.column(c) for c in ("hashes", "docs", "starts", "known"))):
                hit = np.isin(np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(known.as_buffer(), np.uint64))
                yield from _starts(np.frombuffer(docs.as_buffer(), np.int64)[hit], np.frombuffer(starts.as_buffer(), np.int64)[hit]).to_batches()

    whole, pieces = _in_pieces(windows)
    rows = whole.groupBy("part").applyInArrow(run, schema)
    if pieces is not None:
        packed = "part int, hashes binary, docs binary, starts binary"
        table = written(pieces.groupBy("part", "piece").applyInArrow(firsts, packed).groupBy("part").applyInArrow(again, "part int, known binary"), "phrases-hot")
        rows = rows.unionByName(pieces.select("part", "hashes", "docs", "starts").join(maybe_broadcast(table), "part").mapInArrow(look_up, schema))
    return rows


def spans_of(found: DataFrame, words: int) -> DataFrame:
    """doc_id, first_word, n_words: windows merged where they overlap or adjoin."""

    def run(batches):
        for batch in batches:
            ids, firsts, lengths = [], [], []
            for d, blobs in zip(batch.column("doc_id").to_pylist(), batch.column("starts").to_pylist()):
                s = np.unique(np.concatenate([np.frombuffer(x, np.int64) for x in blobs]))
                cut = np.flatnonzero(np.diff(s) > words) + 1
                a, b = s[np.concatenate(([0], cut))], s[np.concatenate((cut - 1, [len(s) - 1]))]
                ids.append(np.full(len(a), d))
                firsts.append(a)
                lengths.append(b - a + words)
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (ids, firsts, lengths)], ["doc_id", "first_word", "n_words"])

    return found.groupBy("doc_id").agg(F.collect_list("starts").alias("starts")).mapInArrow(run, "doc_id long, first_word long, n_words long")


def repeated_spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Every span of at least ``words`` words of which each window of that many occurs elsewhere too.

    doc_id, first_word, n_words.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(shuffle_parts(spark), -(-size // PART_BYTES))
    chosen = written(choose(docs, words, parts), "phrases-anchors")
    texts = chosen.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.struct("k1", "k2", "n_words")).alias("k")).select("doc_id", "k.*").where(F.col("n_words") >= words)
    texts = written(texts, "phrases-texts")
    same = written(texts.groupBy("k1", "k2", "n_words").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "phrases-classes")
    joined = written(confirm(chosen), "phrases-hubs")
    place = F.pmod(F.xxhash64("hub"), F.lit(parts)).cast("int")
    routed = joined.join(same.select(F.col("k1").alias("text"), "k1", "k2", F.col("rep").alias("doc_id"), "n_words"), "text").withColumn("shard", place)
    splits = routed.select("shard", "doc_id", "n_words").distinct().groupBy("shard").agg(F.ceil(F.sum("n_words") / SPLIT_WORDS).cast("int").alias("splits"))
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("splits")).cast("int"))
    # A hub's text goes to all splits of its shard, since the phrases are cut out of it there.
    to = F.when(F.size("anchors") > 0, F.sequence(F.lit(0), F.col("splits") - 1)).otherwise(own)
    targets = routed.join(splits, "shard").withColumn("split", F.explode(to)).groupBy("doc_id", "k1", "k2", "shard", "split").agg(F.flatten(F.collect_list("anchors")).alias("anchors"))
    targets = written(targets.groupBy("doc_id", "k1", "k2").agg(F.collect_list(F.struct("shard", "split", "anchors")).alias("to")), "phrases-targets")
    dropped(chosen, joined)
    sent = docs.join(maybe_broadcast(targets), "doc_id").select("doc_id", "text", "k1", "k2", F.explode("to").alias("to")).select("doc_id", "text", "k1", "k2", "to.*")
    windows = written(locate(sent, words, parts), "phrases-windows")
    spans = spans_of(recurring(windows), words)
    # Documents with one text are spans as a whole; the one of them that took part above has no others.
    copies = same.where("n > 1")
    whole = texts.join(maybe_broadcast(written(copies.select("k1", "k2"), "phrases-copies")), ["k1", "k2"]).select("doc_id", F.lit(0).cast("long").alias("first_word"), "n_words")
    return spans.join(copies.select(F.col("rep").alias("doc_id")), "doc_id", "left_anti").unionByName(whole)


ORACLE = f"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, unnest(range(0, len(w) - {WORDS} + 1)) AS i, w FROM d WHERE len(w) >= {WORDS}),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + {WORDS}], ' ')) AS g FROM s),
c AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS n FROM g) WHERE n > 1),
b AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WORDS} THEN 0 ELSE 1 END AS new FROM c),
r AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b)
SELECT doc_id, min(i) AS first_word, max(i) - min(i) + {WORDS} AS n_words FROM r GROUP BY doc_id, run
"""
