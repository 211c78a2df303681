"""Operator 10: exact n-gram Jaccard join by set-relation skipping.

Every document is the set of its word n-grams (hashed to 53 bits).  All pairs
with Jaccard at least ``threshold`` are found, in these steps:

1. One scan counts all grams in a fixed sketch of buckets, which gives a global
   order from rare to frequent, and a 128-bit key of every set; documents with
   equal keys form one class, which takes part once.
2. A second scan sends each set's prefix (the grams of which two similar sets
   must share one) to the partition of the gram, packed per batch, not per row.
   There each gram's index list is cut into blocks by position in the set, each
   sorted by set size.  A probe skips every block whose first position cannot
   reach the threshold any more, and finds the sizes that can by binary search.
   Sets of a list that have a possible partner go to the list's hub, its least
   set.  Nothing there is enumerated pair by pair, so lists cost their length.
3. The sets named are sent to their hubs (large hubs in tiles) and compared
   there.  Overlaps of a set with all others are derived from those of the most
   similar set already answered: only index lists of the grams in which the two
   differ are read.  A pair that meets at several hubs counts at the least one.

Results for odd input: null and empty texts have no set and no partners; a text
of fewer than n words is one gram of all its words; of rows with the same
doc_id one set counts (the one with the greatest key), so no document is its
own partner; rows without a doc_id are left out; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import dropped, maybe_broadcast, shuffle_parts, small, written

N = 3
THRESHOLD = 0.5
SKETCH_BITS = 24
_BLOCKS = 32
TILE = 1024
ROWS = 1024
PER_BUCKET = 5_000
SHORT = 48
PART_TOKENS = 1_600_000
_EPS = 1e-9


def sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams of up to ROWS texts, sorted within each text; text of each gram; grams of each text."""
    w, count = K.words(texts)
    grams, have = K.ngrams(w, count, n)
    key = np.sort((np.repeat(np.arange(len(have), dtype=np.uint64), have) << np.uint64(53)) | (grams >> np.uint64(11)))
    if len(key):
        key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    doc = (key >> np.uint64(53)).astype(np.int64)
    return key & np.uint64((1 << 53) - 1), doc, np.bincount(doc, minlength=len(have))


def keys(grams: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set that do not depend on order."""
    out = []
    for salt in (0x51A7E5, 0xC0FFEE0DDBA11):
        total = np.concatenate(([np.uint64(0)], np.cumsum(K.mix(grams ^ np.uint64(salt << 8)), dtype=np.uint64)))
        ends = np.cumsum(sizes)
        out.append(K.mix(total[ends] - total[ends - sizes]))
    return out[0], out[1]


def _bucket(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(53 - SKETCH_BITS)).astype(np.int64)


def _longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def bitmaps(grams: np.ndarray, doc: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """For each set the bitmap of its grams' leading bits, of 2 to 4 times as many bits as grams."""
    log = np.maximum(6, np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64) + 1)
    width = np.left_shift(1, log)
    at = np.cumsum(width) - width
    flags = np.zeros(int(width.sum()), bool)
    flags[at[doc] + (grams >> (np.uint64(53) - log[doc].astype(np.uint64))).astype(np.int64)] = True
    packed = np.packbits(flags, bitorder="little").tobytes()
    return [packed[a // 8 : (a + w) // 8] for a, w in zip(at.tolist(), width.tolist())]


def describe(docs: DataFrame, n: int) -> tuple[DataFrame, np.ndarray]:
    """A written table (doc_id, k1, k2, size, bits) of all sets, and the level of each sketch bucket."""
    fields = ["doc_id", "k1", "k2", "size", "bits", "block", "counts"]

    def run(batches):
        total = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                grams, doc, sizes = sets(part.column("text"), n)
                np.add.at(total, _bucket(grams), np.uint32(1))
                a, b = keys(grams, sizes)
                some = pa.array(sizes > 0)
                rows = pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), _longs(a), _longs(b), pa.array(sizes), pa.array(bitmaps(grams, doc, sizes), pa.binary()), pa.nulls(len(sizes), pa.int32()), pa.nulls(len(sizes), pa.binary())], fields)
                yield rows.filter(some)
        codec = pa.Codec("zstd")
        # Only the order matters, and whether a bucket has a single gram: a task's count may stop at 255.
        blobs = [codec.compress(np.minimum(x, 255).astype(np.uint8).tobytes(), asbytes=True) for x in np.split(total, _BLOCKS)]
        none = pa.nulls(_BLOCKS, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(_BLOCKS, pa.binary()), pa.array(range(_BLOCKS), pa.int32()), pa.array(blobs, pa.binary())], fields)

    table = written(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, size long, bits binary, block int, counts binary"), "jaccard-sets")

    def add(group: pa.Table) -> pa.Table:
        codec, width = pa.Codec("zstd"), (1 << SKETCH_BITS) // _BLOCKS
        total = np.zeros(width, np.uint64)
        for x in group.column("counts"):
            total += np.frombuffer(codec.decompress(x.as_py(), decompressed_size=width, asbytes=True), np.uint8)
        level = np.minimum(255, 8 * np.log2(1.0 + total)).astype(np.uint8)
        return pa.table({"block": group.column("block").slice(0, 1), "level": pa.array([level.tobytes()], pa.binary())})

    merged = written(table.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, level binary"), "jaccard-levels")
    levels = merged.orderBy("block").collect()
    dropped(merged)
    level = np.concatenate([np.frombuffer(r["level"], np.uint8) for r in levels]) if levels else np.zeros(1 << SKETCH_BITS, np.uint8)
    described = table.where("doc_id is not null").select("doc_id", "k1", "k2", "size", "bits")
    described.written_to = table.written_to
    return described, level


def members(described: DataFrame) -> DataFrame:
    """doc_id, k1, k2: the one set that counts for each document."""
    return described.groupBy("doc_id").agg(F.max(F.struct("k1", "k2")).alias("k")).select("doc_id", "k.k1", "k.k2")


def classes(of: DataFrame) -> DataFrame:
    """k1, k2, rep, n: each distinct set with its least doc_id and how many documents have it."""
    return of.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))


def _prefix(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - _EPS).astype(np.int64) + 1


def send_prefixes(docs: DataFrame, level: np.ndarray, n: int, t: float, parts: int) -> DataFrame:
    """part, sets, tokens, places: packed prefixes of each batch for each partition of the gram space."""
    shared = docs.sparkSession.sparkContext.broadcast(level)

    def run(batches):
        rank = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                grams, doc, sizes = sets(batch.column("text").slice(at, ROWS), n)
                if not len(grams):
                    continue
                a, b = keys(grams, sizes)
                new = np.zeros(len(sizes), bool)
                new[np.unique(np.column_stack((a, b)), axis=0, return_index=True)[1]] = True
                how = rank[_bucket(grams)].astype(np.uint64)
                key = np.sort((doc.astype(np.uint64) << np.uint64(53)) | (how << np.uint64(45)) | (grams & np.uint64((1 << 45) - 1)))
                starts = np.cumsum(sizes) - sizes
                place = np.arange(len(key)) - np.repeat(starts, sizes)
                # Level 8 is a bucket with a single gram: no other set has it.
                keep = (place < np.repeat(_prefix(sizes, t), sizes)) & np.repeat(new, sizes) & (((key >> np.uint64(45)) & np.uint64(255)) != 8)
                key, place = key[keep], place[keep]
                doc = (key >> np.uint64(53)).astype(np.int64)
                token = K.mix(key & np.uint64((1 << 53) - 1))
                part = (token % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, kind="stable")
                # Places go as 256ths of the size, rounded down: filters by position stay on the safe side.
                token, place, doc, part = (token[order] >> np.uint64(32)).astype(np.uint32), (place[order] * 256 // sizes[doc[order]]).astype(np.uint8), doc[order], part[order]
                heads, many = K.runs(part * ROWS + doc)
                head = np.column_stack((a[doc[heads]], sizes[doc[heads]].astype(np.uint64) | (many.astype(np.uint64) << np.uint64(32))))
                begin, length = K.runs(part)
                cut = np.searchsorted(heads, np.concatenate((begin, [len(part)])))
                rows = [(int(part[s]), head[cut[i] : cut[i + 1]].tobytes(), token[s : s + l].tobytes(), place[s : s + l].tobytes()) for i, (s, l) in enumerate(zip(begin, length))]
                if rows:
                    p, *blobs = zip(*rows)
                    yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], ["part", "sets", "tokens", "places"])

    return docs.select("text").mapInArrow(run, "part int, sets binary, tokens binary, places binary")


def possible(token: np.ndarray, place: np.ndarray, size: np.ndarray, t: float) -> np.ndarray:
    """Which index entries have a possible partner in their token's list.

    token: list number of each entry.  Blocks of a list hold positions of equal
    magnitude (0, 1-2, 3-6, ...); block-skipping leaves a range of sizes each.
    """
    block = np.floor(np.log2(place + 1)).astype(np.int64)
    index = place < size - np.ceil(2 * t / (1 + t) * size - _EPS).astype(np.int64) + 1
    key = (token.astype(np.uint64) << np.uint64(38)) | (block.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)
    order = np.argsort(key[index])
    ordered = key[index][order]
    place_in = np.full(len(token), -1)
    place_in[np.flatnonzero(index)[order]] = np.arange(len(ordered))
    most = np.minimum(size, np.floor((1 + t) / t * (size - place) - size + _EPS)).astype(np.int64)
    partner, edges = np.zeros(len(token), bool), np.zeros(len(ordered) + 1, np.int64)
    for b in np.unique(block[index]):
        first = (1 << int(b)) - 1
        least = np.ceil(t * size + (1 + t) * first - _EPS).astype(np.int64)
        go = np.flatnonzero(least <= most)
        base = (token[go].astype(np.uint64) << np.uint64(38)) | (np.uint64(b) << np.uint64(32))
        lo = np.searchsorted(ordered, base | least[go].astype(np.uint64), side="left")
        hi = np.searchsorted(ordered, base | most[go].astype(np.uint64), side="right")
        own = (place_in[go] >= lo) & (place_in[go] < hi)
        some = hi - lo - own > 0
        partner[go[some]] = True
        np.add.at(edges, lo[some], 1)
        np.add.at(edges, hi[some], -1)
    inside = np.cumsum(edges)[:-1] > 0
    partner[np.flatnonzero(index)[order[inside]]] = True
    return partner


def close(list_no: np.ndarray, place: np.ndarray, size: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of entries of the same list that can reach the threshold by size and position."""
    starts, lengths = K.runs(list_no)
    after = np.repeat(starts + lengths, lengths) - np.arange(len(list_no)) - 1
    x, y = np.repeat(np.arange(len(list_no)), after), K.spans(np.arange(len(list_no)) + 1, after)
    need = t / (1 + t) * (size[x] + size[y]) - _EPS
    ok = (np.minimum(size[x] - place[x], size[y] - place[y]) >= need) & (np.minimum(size[x], size[y]) >= t * np.maximum(size[x], size[y]) - _EPS)
    return x[ok], y[ok]


def star(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pairs as meetings (hub << 32 | member): both go to the least neighbour of the lesser."""
    low, high = np.minimum(x, y), np.maximum(x, y)
    if not len(low):
        return np.zeros(0, np.int64)
    hub = np.arange(int(high.max()) + 1)
    np.minimum.at(hub, high, low)
    return np.unique(np.concatenate(((hub[low] << 32) | low, (hub[low] << 32) | high)))


def hubs(packed: DataFrame, t: float, parts: int) -> DataFrame:
    """hub, k1: each set (by the first half of its key) with a possible partner, and the hub where they meet."""

    def run(group: pa.Table) -> pa.Table:
        head = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in group.column("sets")]).reshape(-1, 2)
        token = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in group.column("tokens")])
        place = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in group.column("places")]).astype(np.int64)
        unique, number = np.unique(head[:, 0], return_inverse=True)
        many = (head[:, 1] >> np.uint64(32)).astype(np.int64)
        of = np.repeat(number, many)
        size = np.repeat((head[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int64), many)
        place = -(-place * size // 256)
        key = (token.astype(np.uint64) << np.uint64(32)) | of.astype(np.uint64)
        order = np.argsort(key)
        key = key[order]
        order = order[np.concatenate(([True], key[1:] != key[:-1]))]
        starts, lengths = K.runs(token[order])
        order = order[np.repeat(lengths > 1, lengths)]
        lengths = lengths[lengths > 1]
        list_no = np.repeat(np.arange(len(lengths)), lengths)
        owner, at, how_many = of[order], place[order].astype(np.int64), size[order]
        short = np.repeat(lengths <= SHORT, lengths)
        x, y = close(list_no[short], at[short], how_many[short], t)
        found = star(owner[short][x], owner[short][y])
        long = np.flatnonzero(~short)
        if len(long):
            long = long[possible(list_no[long], at[long], how_many[long], t)]
            # Entries of a list are in order of set, so its first is the hub.
            starts, lengths = K.runs(list_no[long])
            found = np.concatenate((found, (np.repeat(owner[long[starts]], lengths) << 32) | owner[long]))
        pairs = np.unique(found)
        hub, member = unique[pairs >> 32], unique[pairs & 0xFFFFFFFF]
        return pa.table([_longs(hub), _longs(member)], ["hub", "k1"])

    # A part is a task of its own: parts have like numbers of tokens, and no two of them meet by chance.
    return packed.repartitionById(parts, "part").groupBy("part").applyInArrow(run, "hub long, k1 long").distinct()


def merged(met: DataFrame) -> DataFrame:
    """The same meetings at fewer hubs: all sets of a hub go to the least hub that any of them goes to.

    The lists of a cluster of near copies have a few different hubs, which would
    each get the whole cluster; one step of contraction brings them together.
    """
    least = met.groupBy("k1", "k2").agg(F.min("hub").alias("least"))
    to = met.join(least, ["k1", "k2"]).groupBy("hub").agg(F.min("least").alias("to"))
    return met.join(to, "hub").select(F.col("to").alias("hub"), "k1", "k2").distinct()


def placed(met: DataFrame) -> DataFrame:
    """k1, k2, hub, i, j, b: meetings with their tiles; hubs of one set only compare nothing and go."""
    tiles = met.groupBy("hub").agg(F.count("*").alias("members")).where("members > 1").select("hub", F.ceil(F.col("members") / TILE).cast("int").alias("n"))
    block = F.pmod(F.xxhash64("k1", "k2"), F.col("n")).cast("int")
    rows = met.join(tiles, "hub").withColumn("b", block).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select("k1", "k2", "hub", F.least("b", "c").alias("i"), F.greatest("b", "c").alias("j"), "b")


def _tiles(group: pa.Table):
    """The rows of each tile of a bucket."""
    rows = np.column_stack([group.column(c).to_numpy().astype(np.int64) for c in ("hub", "i", "j")])
    order = np.lexsort(rows.T[::-1])
    tile = rows[order]
    cut = np.flatnonzero(np.concatenate(([True], (tile[1:] != tile[:-1]).any(axis=1), [True])))
    for s, e in zip(cut[:-1], cut[1:]):
        if e - s > 1:
            yield tile[s], order[s:e]


def bounded(blobs: list[bytes], sizes: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose bitmaps allow the threshold."""
    width = np.array([len(b) for b in blobs])
    out = []
    for w in np.unique(width):
        same = np.flatnonzero(width == w)
        rows = np.frombuffer(b"".join(blobs[k] for k in same), np.uint64).reshape(len(same), -1)
        excess = sizes[same] - np.bitwise_count(rows).sum(axis=1, dtype=np.int64)
        sides = [(same, rows, excess, True, rows)]
        folded = rows
        for k in range(1, max(1, math.ceil(-math.log2(t) - _EPS)) + 1):
            # Neighbouring buckets joined, this width's sets compare with those of half of it, and so on down to the least partner.
            if w >> k < 8:
                break
            folded = np.packbits(np.unpackbits(np.ascontiguousarray(folded).view(np.uint8), axis=1, bitorder="little").reshape(len(same), -1, 2).any(axis=2), axis=1, bitorder="little").view(np.uint64)
            less = np.flatnonzero(width == w >> k)
            if len(less):
                other = np.frombuffer(b"".join(blobs[i] for i in less), np.uint64).reshape(len(less), -1)
                sides.append((less, other, sizes[less] - np.bitwise_count(other).sum(axis=1, dtype=np.int64), False, folded))
        for ids, against, spare, own, mine in sides:
            extra = excess if own else sizes[same] - np.bitwise_count(mine).sum(axis=1, dtype=np.int64)
            for k, x in enumerate(same):
                begin = k + 1 if own else 0
                if begin >= len(ids):
                    continue
                both = np.bitwise_count(mine[k] & against[begin:]).sum(axis=1, dtype=np.int64) + np.minimum(extra[k], spare[begin:])
                hit = np.flatnonzero(both >= t / (1 + t) * (sizes[x] + sizes[ids[begin:]]) - _EPS)
                if len(hit):
                    out.append((np.full(len(hit), x), ids[begin:][hit]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def sieve(met: DataFrame, bits: DataFrame, same: DataFrame, t: float, buckets: int) -> DataFrame:
    """The meetings that bitmaps allow: hub, k1, k2."""

    def run(group: pa.Table) -> pa.Table:
        k1, k2, sizes = (group.column(c).to_numpy() for c in ("k1", "k2", "size"))
        blobs = group.column("bits").to_pylist()
        out = [np.zeros((0, 3), np.int64)]
        for _, at in _tiles(group):
            at = at[np.lexsort((k2[at], k1[at]))]
            x, y = bounded([blobs[k] for k in at], sizes[at], t)
            pairs = star(x, y)
            out.append(np.column_stack((k1[at[pairs >> 32]], k1[at[pairs & 0xFFFFFFFF]], k2[at[pairs & 0xFFFFFFFF]])))
        rows = np.concatenate(out)
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in rows.T], ["hub", "k1", "k2"])

    rows = placed(met.join(same.select("k1", "k2"), "k1")).join(bits, ["k1", "k2"]).withColumn("bucket", F.pmod(F.xxhash64("hub", "i", "j"), F.lit(buckets)).cast("int"))
    return rows.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(run, "hub long, k1 long, k2 long").distinct()


def overlaps(members: list[np.ndarray]) -> np.ndarray:
    """How many grams every two sets share, each row derived from a similar set's row where that reads less."""
    k = len(members)
    sizes = np.array([len(x) for x in members])
    owner = np.repeat(np.arange(k), sizes)
    token = np.unique(np.concatenate(members), return_inverse=True)[1]
    often = np.bincount(token)
    keep = often[token] > 1
    token, owner = token[keep], owner[keep]
    used = np.cumsum(often > 1) - 1
    token = used[token]
    by = np.argsort(token, kind="stable")
    lists, length = owner[by], np.bincount(token, minlength=1)
    starts = np.cumsum(length) - length
    own = np.split(token, np.cumsum(np.bincount(owner, minlength=k))[:-1])
    shared = np.array([len(x) for x in own])

    def answers(tokens: np.ndarray) -> np.ndarray:
        return np.bincount(lists[K.spans(starts[tokens], length[tokens])], minlength=k)

    out = np.zeros((k, k), np.int64)
    gap, near = shared.copy(), np.full(k, -1)
    todo = np.ones(k, bool)
    x = 0
    for _ in range(k):
        if near[x] < 0:
            out[x] = answers(own[x])
        else:
            r = near[x]
            out[x] = out[r] - answers(np.setdiff1d(own[r], own[x], assume_unique=True)) + answers(np.setdiff1d(own[x], own[r], assume_unique=True))
        todo[x] = False
        apart = shared + shared[x] - 2 * out[x]
        better = apart < gap
        gap[better], near[better] = apart[better], x
        x = int(np.argmin(np.where(todo, gap - shared, 1 << 60)))
    return out


def compare(sent: DataFrame, t: float, buckets: int) -> DataFrame:
    """doc_a, doc_b, jaccard of the distinct sets that meet at a hub."""

    def run(group: pa.Table) -> pa.Table:
        ids, b = group.column("doc_id").to_numpy(), group.column("b").to_numpy()
        blobs, others = group.column("grams").to_pylist(), group.column("hubs").to_pylist()
        a_out, b_out, j_out = [], [], []
        for tile, at in _tiles(group):
            at = at[np.unique(ids[at], return_index=True)[1]]
            if len(at) < 2:
                continue
            members = [np.frombuffer(blobs[k], np.uint64) for k in at]
            o = overlaps(members)
            sizes = np.array([len(m) for m in members])
            union = sizes[:, None] + sizes[None, :] - o
            x, y = np.nonzero(np.triu(o >= t * union - _EPS, 1))
            if tile[1] != tile[2]:
                cross = b[at[x]] != b[at[y]]
                x, y = x[cross], y[cross]
            hub = int(tile[0])
            less = [frozenset(h for h in others[k] if h < hub) for k in at]
            if any(less):
                once = np.fromiter((less[p].isdisjoint(less[q]) for p, q in zip(x.tolist(), y.tolist())), bool, len(x))
                x, y = x[once], y[once]
            p, q = ids[at[x]], ids[at[y]]
            a_out.append(np.minimum(p, q))
            b_out.append(np.maximum(p, q))
            j_out.append(np.round(o[x, y] / union[x, y], 6))
        if not a_out:
            a_out, b_out, j_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        return pa.table({"doc_a": np.concatenate(a_out).astype(np.int64), "doc_b": np.concatenate(b_out).astype(np.int64), "jaccard": np.concatenate(j_out)})

    return sent.repartitionById(buckets, "bucket").groupBy("bucket").applyInArrow(run, "doc_a long, doc_b long, jaccard double")


def join_sets(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Similar pairs of distinct sets by their least documents (doc_a < doc_b, jaccard), the distinct sets, and the set of each document.

    All three are written tables, so nothing that made them runs again.
    """
    spark = docs.sparkSession
    parts = shuffle_parts(spark)
    docs = docs.select("doc_id", "text")
    described, level = describe(docs, n)
    of = written(members(described), "jaccard-members")
    same = written(classes(of), "jaccard-classes")
    # Every part repeats the set's key and size, so parts are as large as a task's memory allows, not as small as can be.
    tokens = described.agg(F.sum(F.col("size") - F.ceil(F.col("size") * threshold) + 1)).first()[0] or 0
    bits = written(described.groupBy("k1", "k2").agg(F.first("size").alias("size"), F.first("bits").alias("bits")), "jaccard-bits")
    dropped(described)
    pieces = max(1, math.ceil(tokens / PART_TOKENS))
    found = written(hubs(send_prefixes(docs, level, n, threshold, pieces), threshold, pieces), "jaccard-hubs")
    sieved = written(sieve(found, bits, same, threshold, max(parts, math.ceil(found.count() / (4 * PER_BUCKET)))), "jaccard-sieved")
    met = written(merged(sieved), "jaccard-merged")
    dropped(bits, found, sieved)
    to = F.struct("hub", "i", "j", "b")
    sending = placed(met).groupBy("k1", "k2").agg(F.collect_list(to).alias("tiles"), F.collect_set("hub").alias("hubs"))
    sending = written(sending.join(same.select("k1", "k2", F.col("rep").alias("doc_id")), ["k1", "k2"]), "jaccard-sent")
    buckets = max(parts, math.ceil(met.count() / PER_BUCKET))

    def grams(batches):
        names = ["bucket", "hub", "i", "j", "b", "doc_id", "hubs", "grams"]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found, _, sizes = sets(part.column("text"), n)
                a, b = (x.view(np.int64) for x in keys(found, sizes))
                ends = np.cumsum(sizes)
                rows = []
                for r, x in enumerate(part.drop_columns(["text"]).to_pylist()):
                    if (a[r], b[r]) == (x["k1"], x["k2"]):
                        blob = found[ends[r] - sizes[r] : ends[r]].tobytes()
                        rows += [(hash((q["hub"], q["i"], q["j"])) % buckets, q["hub"], q["i"], q["j"], q["b"], x["doc_id"], x["hubs"], blob) for q in x["tiles"]]
                if rows:
                    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    # Many rows: the ids alone thin out the documents first, so texts that nobody is compared with are never shuffled.
    few = small(sending)
    thin = docs if few else docs.join(maybe_broadcast(sending.select("doc_id")), "doc_id", "left_semi")
    sent = thin.join(F.broadcast(sending) if few else sending, "doc_id").select("doc_id", "text", "k1", "k2", "tiles", "hubs").mapInArrow(
        grams, "bucket int, hub long, i int, j int, b int, doc_id long, hubs array<long>, grams binary"
    )
    pairs = written(compare(sent, threshold, buckets), "jaccard-pairs")
    dropped(met, sending)
    return pairs, same, of


def groups(edges: DataFrame) -> DataFrame:
    """v, label: the least node that each node of edges (doc_a, doc_b) is connected with, as a written table."""
    both = edges.select(F.col("doc_a").alias("v"), F.col("doc_b").alias("u")).unionByName(edges.select(F.col("doc_b").alias("v"), F.col("doc_a").alias("u")))
    label = written(both.groupBy("v").agg(F.least(F.min("v"), F.min("u")).alias("label")), "jaccard-label")
    while True:
        # The least label among neighbours, then the label of that label: paths halve each round.
        step = both.join(label.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        step = label.join(step, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        jump = step.select(F.col("v").alias("label"), F.col("label").alias("far"))
        step = written(step.join(jump, "label", "left").select("v", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "jaccard-label")
        dropped(label)
        label = step
        if step.where("label != old").isEmpty():
            return step


def links(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, max_jaccard.

    class_id is the least doc_id of all that the document is connected with by
    pairs of Jaccard at least threshold, n_links how many documents have such a
    pair with it, copies included, and max_jaccard (6 places) the greatest of
    these, null without a link.  No pair of different texts is left out, and no
    copies are written out in pairs.
    """
    pairs, same, of = join_sets(docs, n, threshold)
    ends = pairs.select(F.col("doc_a").alias("rep"), F.col("doc_b").alias("other"), "jaccard").unionByName(pairs.select(F.col("doc_b").alias("rep"), F.col("doc_a").alias("other"), "jaccard"))
    # Most sets belong to one document; only the others are joined.
    several = maybe_broadcast(written(same.where("n > 1").select(F.col("rep").alias("other"), "n"), "jaccard-copies"))
    linked = ends.join(several, "other", "left").groupBy("rep").agg(F.sum(F.coalesce("n", F.lit(1))).alias("linked"), F.max("jaccard").alias("most"))
    sets_ = same.join(linked, "rep", "left").join(groups(pairs).select(F.col("v").alias("rep"), "label"), "rep", "left").select(
        "k1", "k2", F.coalesce("label", "rep").alias("class_id"), (F.col("n") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.when(F.col("n") > 1, 1.0).otherwise(F.col("most")).alias("max_jaccard"),
    )
    rows = of.join(sets_, ["k1", "k2"]).select("doc_id", "class_id", "n_links", "max_jaccard")
    bare = docs.select("doc_id").where("doc_id is not null").distinct().join(of.select("doc_id"), "doc_id", "left_anti")
    return rows.unionByName(bare.select("doc_id", F.col("doc_id").cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(None).cast("double").alias("max_jaccard")))


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """docs without near duplicates: of each connected group of similar documents the least doc_id stays.

    Documents without a set (null or empty text) or without a doc_id stay; all
    rows of a doc_id that stays do.
    """
    pairs, same, of = join_sets(docs, n, threshold)
    # A set's copies go but for the least; of the sets of a group all go but the least.
    copies = of.join(same.where("n > 1"), ["k1", "k2"]).where("doc_id != rep").select("doc_id")
    gone = written(copies.unionByName(groups(pairs).where("v != label").select(F.col("v").alias("doc_id"))), "jaccard-gone")
    return docs.join(maybe_broadcast(gone), "doc_id", "left_anti").select(docs.columns)


ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= {N} THEN list_transform(range(1, len(w) - {N} + 2), lambda i: array_to_string(w[i:i + {N} - 1], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
j AS (SELECT doc_a, doc_b, round(o / CAST(x.n + y.n - o AS DOUBLE), 6) AS jaccard FROM p JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE o >= {THRESHOLD} * (x.n + y.n - o)),
e AS (SELECT doc_a AS v, doc_b AS u, jaccard FROM j UNION ALL SELECT doc_b, doc_a, jaccard FROM j),
r AS (SELECT v, u FROM e UNION SELECT r.v, e.u FROM r JOIN e ON e.v = r.u),
c AS (SELECT v, least(v, min(u)) AS class_id FROM r GROUP BY v),
l AS (SELECT v, count(*) AS n_links, max(jaccard) AS max_jaccard FROM e GROUP BY v)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links, max_jaccard
FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IS NOT NULL) LEFT JOIN c ON c.v = doc_id LEFT JOIN l ON l.v = doc_id
"""
