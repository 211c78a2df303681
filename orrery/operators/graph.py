"""Link graph and PageRank."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..session import written


def link_graph(pages: DataFrame) -> DataFrame:
    """src, dst from pages(doc_id, url, links): links to known URLs, each once, no loops; of equal URLs the last document counts."""
    urls = pages.groupBy("url").agg(F.max("doc_id").alias("dst"))
    out = pages.select(F.col("doc_id").alias("src"), F.explode("links").alias("url"))
    return out.join(urls, "url").where("src <> dst").select("src", "dst").distinct()


#: Nodes that a block has on average, links that are packed into one row, and links that a partition of rows has on average.
BLOCK, PACKED, SHARE = 1 << 16, 1 << 21, 1 << 22


def _combined(ids: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different ids, sorted, and the sum of each."""
    ids, at = np.unique(ids, return_inverse=True)
    return ids, np.bincount(at, sums, len(ids))


def _bytes(x: np.ndarray) -> bytes:
    """All first bytes of the numbers, then all second ones and so on, so that those which are much alike lie together and compress."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(b: pa.Scalar, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(b.as_buffer(), np.uint8).reshape(size, -1).T.copy().view(kind).ravel()


def _steps(ids: np.ndarray) -> bytes:
    """Sorted ids by the distance of each from the one before."""
    return _bytes(np.diff(ids, prepend=ids.dtype.type(0)))


def _ids(b: pa.Scalar, kind: type = np.int64) -> np.ndarray:
    return np.cumsum(_numbers(b, kind), dtype=kind)


def _packed(bounds: np.ndarray):
    """Links (src, dst), sorted by src, as rows of one block of sources: different ids, and the place of each link's in them."""

    def row(block, src, dst):
        (s, s_at), (d, d_at) = np.unique(src, return_inverse=True), np.unique(dst, return_inverse=True)
        # Sources are sorted, and so are their places.
        data = [_steps(s), _steps(s_at.astype(np.int32)), _steps(d), _bytes(d_at.astype(np.int32))]
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], ["block", "src", "src_at", "dst", "dst_at"])

    def run(batches):
        held, n = [], 0

        def rows():
            src, dst = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            block = np.searchsorted(bounds, src, side="right")
            at = [0, *(np.flatnonzero(np.diff(block)) + 1), len(src)]
            for i, j in zip(at, at[1:]):
                yield row(block[i], src[i:j], dst[i:j])

        for batch in batches:
            held.append([batch.column(i).to_numpy() for i in (0, 1)])
            n += batch.num_rows
            if n >= PACKED:
                yield from rows()
                held, n = [], 0
        if n:
            yield from rows()

    return run


def _given(bounds: np.ndarray):
    """What packed links give, with the ranks and degrees of their block: block of the target, ids, sums, one row for each block and task."""

    def run(batches):
        ids, sums = [], []
        for batch in batches:
            for *links, nodes, degree, r in zip(*(batch.column(c) for c in ("src", "src_at", "dst", "dst_at", "ids", "degree", "r"))):
                s, s_at, d, d_at = _ids(links[0]), _ids(links[1], np.int32), _ids(links[2]), _numbers(links[3], np.int32)
                nodes, degree, r = _ids(nodes), _numbers(degree, np.int64), _numbers(r, np.float64)
                at = np.minimum(np.searchsorted(nodes, s), len(nodes) - 1)
                gift = np.where(nodes[at] == s, r[at] / np.maximum(degree[at], 1), 0.0)
                ids.append(d)
                sums.append(np.bincount(d_at, gift[s_at], len(d)))
        if ids:
            ids, sums = _combined(np.concatenate(ids), np.concatenate(sums))
            block = np.searchsorted(bounds, ids, side="right")
            at = [0, *(np.flatnonzero(np.diff(block)) + 1), len(ids)]
            for i, j in zip(at, at[1:]):
                yield pa.RecordBatch.from_arrays([pa.array([block[i]], pa.int32()), pa.array([_steps(ids[i:j])]), pa.array([None], pa.binary()), pa.array([_bytes(sums[i:j])])], ["block", "ids", "degree", "r"])

    return run


def _updated(base: float, damping: float):
    """A block's nodes and what they are given (rows without degree): the nodes with their new ranks."""

    def one(table: pa.Table) -> pa.Table:
        own = table.filter(pc.is_valid(table.column("degree")))
        if not own.num_rows:
            return own
        nodes = _ids(own.column("ids")[0])
        got = np.zeros(len(nodes))
        given = table.filter(pc.is_null(table.column("degree")))
        for ids, sums in zip(given.column("ids"), given.column("r")):
            ids, sums = _ids(ids), _numbers(sums, np.float64)
            at = np.minimum(np.searchsorted(nodes, ids), len(nodes) - 1)
            known = nodes[at] == ids
            got[at[known]] += sums[known]
        return own.set_column(3, "r", pa.array([_bytes(base + damping * got)], pa.binary()))

    return one


def _blocked(bounds: np.ndarray, first: float):
    """Nodes (doc_id, degree), sorted by block, as one row for each block."""

    def one(table: pa.Table) -> pa.Table:
        ids, degree = (table.column(c).to_numpy() for c in ("doc_id", "degree"))
        order = np.argsort(ids)
        block = np.searchsorted(bounds, ids[:1], side="right")
        return pa.table({"block": pa.array(block, pa.int32()), "ids": [_steps(ids[order])], "degree": [_bytes(degree[order])], "r": [_bytes(np.full(len(ids), first))]})

    return one


def _block_of(bounds: np.ndarray):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.searchsorted(bounds, batch.column(0).to_numpy(), side="right"), pa.int32()), *batch.columns], ["block", "doc_id", "degree"])

    return run


def _one_by_one(batches):
    for batch in batches:
        for ids, r in zip(batch.column(0), batch.column(1)):
            yield pa.RecordBatch.from_arrays([pa.array(_ids(ids)), pa.array(_numbers(r, np.float64))], ["doc_id", "r"])


_STATE = "block int, ids binary, degree binary, r binary"


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, damping: float = 0.85, rounds: int = 20, least: float | None = 1e-6, cut_every: int = 5) -> DataFrame:
    """doc_id, score: ranks divided by the greatest (6 places). Pages without links leak their rank.

    Nodes are divided into ranges of ids, some ten thousand each, and links are packed by the range of their source and
    kept so, ids as distances.  A round shuffles ranks and, from each task, one sum for every node that its links lead to; the packed links
    are shuffled once between two written tables at most.  Those tables cut lineage; packed links that are lost are packed again.
    With ``least`` the loop ends when the ranks move by less.
    """
    edges = edges.select("src", "dst")
    kind = edges.schema["src"].dataType
    if nodes is None:
        edges = written(edges, "edges")
        # One pass gives the nodes and their degrees.
        ends = [edges.select(F.col(c).alias("doc_id"), F.lit(n).cast("long").alias("degree")) for c, n in (("src", 1), ("dst", 0))]
        nodes = written(ends[0].unionByName(ends[1]).groupBy("doc_id").agg(F.sum("degree").alias("degree")), "nodes")
    else:
        nodes = written(nodes.select("doc_id").distinct(), "nodes")
    if not isinstance(kind, IntegralType):
        numbers = written(nodes.where("doc_id is not null").select("doc_id", F.monotonically_increasing_id().alias("number")), "numbers")
        number = lambda c: numbers.select(F.col("doc_id").alias(c), F.col("number").alias(f"{c}_number"))
        numbered = edges.join(number("src"), "src", "left").join(number("dst"), "dst", "left").select(F.col("src_number").alias("src"), F.col("dst_number").alias("dst"))
        ranks = pagerank(numbered, nodes.join(numbers, "doc_id", "left").select(F.col("number").alias("doc_id")), damping, rounds, least, cut_every)
        return ranks.join(numbers, ranks["doc_id"].eqNullSafe(numbers["number"]), "left").select(numbers["doc_id"], "score")
    if not hasattr(edges, "written_to"):
        edges = written(edges, "edges")
    n = nodes.count()
    if not n:
        return nodes.select("doc_id", F.lit(0.0).alias("score"))
    base, wide = (1 - damping) / n, lambda c: F.col(c).cast("long")
    blocks = -(-n // BLOCK)
    # A number for each block.
    cuts = nodes.agg(F.percentile_approx(wide("doc_id"), [i / blocks for i in range(1, blocks)] or [0.5], max(10000, 8 * blocks)).alias("p")).first().p or []
    bounds = np.array(sorted(set(cuts)) if blocks > 1 else [], np.int64)
    known = nodes.where("doc_id is not null")
    if "degree" not in nodes.columns:
        known = known.join(edges.where("src is not null").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("degree")), "doc_id", "left")
    known = known.select(wide("doc_id").alias("doc_id"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))
    first = written(known.mapInArrow(_block_of(bounds), "block int, doc_id long, degree long").groupBy("block").applyInArrow(_blocked(bounds, 1.0 / n), _STATE), "ranks")
    links = edges.where("src is not null and dst is not null").select(wide("src").alias("src"), wide("dst").alias("dst"))
    parts = max(1, -(-edges.count() // SHARE))
    sources = links.repartitionByRange(parts, "src").sortWithinPartitions("src")
    packed = sources.mapInArrow(_packed(bounds), "block int, src binary, src_at binary, dst binary, dst_at binary").repartition(parts, "block").persist(StorageLevel.MEMORY_AND_DISK)
    # Every round reads the last ranks once, or a plan of some rounds would double with each.
    ranks, still = first, first.withColumn("r", F.lit(None).cast("binary"))
    for i in range(1, rounds + 1):
        given = packed.join(ranks.hint("shuffle_hash"), "block").drop("block").mapInArrow(_given(bounds), _STATE)
        new = still.unionByName(given).groupBy("block").applyInArrow(_updated(base, damping), _STATE)
        if i % cut_every == 0 or i == rounds:
            old, ranks = ranks, written(new, "ranks")
            # The stop test costs a pass, so it is made where the ranks are at rest anyway.
            if least is not None and i < rounds:
                moved = _rows(ranks).join(_rows(old).withColumnRenamed("r", "o"), "doc_id").agg(F.sum(F.abs(F.col("r") - F.col("o")))).first()[0]
                if moved is not None and moved < least:
                    break
        else:
            ranks = new
    packed.unpersist()
    ranks = _rows(ranks).select(F.col("doc_id").cast(kind).alias("doc_id"), "r").unionByName(nodes.where("doc_id is null").select("doc_id", F.lit(base).alias("r")))
    best = ranks.agg(F.max("r").alias("m"))
    return ranks.crossJoin(F.broadcast(best)).select("doc_id", F.round(F.col("r") / F.col("m"), 6).alias("score"))


def _rows(ranks: DataFrame) -> DataFrame:
    return ranks.select("ids", "r").mapInArrow(_one_by_one, "doc_id long, r double")


def inlink_shares(edges: DataFrame) -> DataFrame:
    """doc_id, share: links to each page over those to the most linked one (6 places)."""
    n = edges.groupBy(F.col("dst").alias("doc_id")).agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.max("n").alias("most")))).select("doc_id", F.round(F.col("n") / F.col("most"), 6).alias("share"))


def subgraph(edges: DataFrame, ranks: DataFrame, n: int = 300, most: int = 800) -> DataFrame:
    """src, dst between the n best pages, the first ``most`` of them, with node sizes from 8 to 58."""
    best = ranks.orderBy(F.col("score").desc(), "doc_id").limit(n)
    top = best.agg(F.max("score").alias("m"))
    size = best.crossJoin(F.broadcast(top)).select("doc_id", F.round(8 + F.col("score") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")) * 50, 3).alias("size"))
    inner = edges.join(size.select(F.col("doc_id").alias("src"), F.col("size").alias("src_size")), "src").join(size.select(F.col("doc_id").alias("dst"), F.col("size").alias("dst_size")), "dst")
    return inner.select("src", "dst", "src_size", "dst_size").orderBy("src", "dst").limit(most)


def nodes_to_draw(ranks: DataFrame, edges: DataFrame, n: int = 300) -> DataFrame:
    """doc_id, size, colour, drawn_links of the n best pages: how they are drawn, and how many of their links lead to others of them."""
    best = ranks.orderBy(F.col("score").desc(), "doc_id").limit(n)
    size = best.crossJoin(F.broadcast(best.agg(F.max("score").alias("m")))).select("doc_id", F.round(8 + F.col("score") / F.when(F.col("m") == 0, 1.0).otherwise(F.col("m")) * 50, 3).alias("size"))
    ids = F.broadcast(best.select("doc_id"))
    inner = edges.join(ids.withColumnRenamed("doc_id", "dst"), "dst").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("k"))
    group = F.pmod("doc_id", F.lit(3))
    colour = F.when(group == 0, "blue").when(group == 1, "green").otherwise("grey")
    return size.join(inner, "doc_id", "left").select("doc_id", "size", colour.alias("colour"), F.coalesce("k", F.lit(0)).alias("drawn_links"))


def neighbours(edges: DataFrame, start: DataFrame, hops: int = 2) -> DataFrame:
    """start, doc_id, hop: nodes within so many hops of each start, by their least distance, in either direction."""
    both = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).unionByName(edges.select(F.col("dst").alias("a"), F.col("src").alias("b"))).distinct()
    found = start.select(F.col("doc_id").alias("start"), "doc_id", F.lit(0).alias("hop"))
    edge = found
    for h in range(1, hops + 1):
        edge = edge.join(both, edge["doc_id"] == both["a"]).select("start", F.col("b").alias("doc_id"), F.lit(h).alias("hop")).distinct()
        found = found.unionByName(edge)
    return found.groupBy("start", "doc_id").agg(F.min("hop").alias("hop"))
