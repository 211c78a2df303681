"""Bloom filters, the hash ring and push-sum, in native expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


def bloom_size(capacity: int, fp: float) -> tuple[int, int]:
    """Bits and hash functions for so many items at a false-positive rate."""
    m = int(-(capacity * math.log(fp)) / math.log(2) ** 2)
    return m, max(1, int(m / capacity * math.log(2)))


def _mod(hexdigits: Column, digits: int, m: int) -> Column:
    """A long hex number modulo m, four digits at a time, exactly."""
    steps = F.sequence(F.lit(1), F.lit(digits), F.lit(4))
    return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, i: (acc * 65536 + F.conv(F.substring(hexdigits, i, F.lit(4)), 16, 10).cast("long")) % m)


def bloom_positions(item: Column, m: int, k: int) -> Column:
    """The k bit positions of an item: (SHA-256 + i * MD5) modulo m."""
    a, b = _mod(F.sha2(item.cast("binary"), 256), 64, m), _mod(F.md5(item.cast("binary")), 32, m)
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: (a + i.cast("long") * b) % m)


def bloom(items: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """A filter as its set bits: pos, each once."""
    return items.select(F.explode(bloom_positions(F.col(column), m, k)).alias("pos")).distinct()


def bloom_contains(items: DataFrame, column: str, bits: DataFrame, m: int, k: int) -> DataFrame:
    """The distinct items with maybe_present: whether all their bits are set."""
    probe = items.select(column).distinct().select(column, F.explode(F.array_distinct(bloom_positions(F.col(column), m, k))).alias("pos"))
    hit = probe.join(bits.select("pos", F.lit(1).alias("hit")), "pos", "left")
    return hit.groupBy(column).agg((F.count("hit") == F.count("*")).alias("maybe_present"))


def bloom_stats(bits: DataFrame, n_items: DataFrame, m: int, k: int) -> DataFrame:
    """n_items, bits_set, load_factor, memory_bytes, fp_rate of a filter; n_items: one row with n."""
    return bits.agg(F.count("*").alias("bits_set")).crossJoin(n_items).select(
        F.col("n").alias("n_items"), "bits_set", F.round(F.col("bits_set") / m, 6).alias("load_factor"), F.lit(m // 8).cast("long").alias("memory_bytes"),
        F.round(F.pow(1 - F.exp(-k * F.col("n") / F.lit(float(m))), F.lit(float(k))), 6).alias("fp_rate"),
    )


def merge_filters(*filters: DataFrame) -> DataFrame:
    whole = filters[0].select("pos")
    for f in filters[1:]:
        whole = whole.unionByName(f.select("pos"))
    return whole.distinct()


def filter_similarity(bits: DataFrame, key: str = "filter_id") -> DataFrame:
    """mean_jaccard over all pairs of filters, and converged (over 0.95). One join on positions."""
    size = bits.groupBy(key).agg(F.count("*").alias("n"))
    a, b = bits.select(F.col(key).alias("a"), "pos"), bits.select(F.col(key).alias("b"), "pos")
    inter = a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.count("*").alias("i"))
    pairs = size.select(F.col(key).alias("a"), F.col("n").alias("na")).join(size.select(F.col(key).alias("b"), F.col("n").alias("nb")), F.col("a") < F.col("b")).join(inter, ["a", "b"], "left")
    j = F.coalesce("i", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("i", F.lit(0)))
    return pairs.agg(F.round(F.avg(j), 6).alias("mean_jaccard"), (F.avg(j) > 0.95).alias("converged"))


def check_and_add(items: DataFrame, column: str, seen: DataFrame) -> DataFrame:
    """Items not seen before, each once: exact, so nothing is lost to false positives."""
    return items.dropDuplicates([column]).join(seen.select(column), column, "left_anti")


def ring(spark, nodes: list, virtual: int = 150) -> DataFrame:
    """pos (MD5 in hex), node: every node at ``virtual`` places of the ring."""
    rows = spark.createDataFrame([(n,) for n in nodes], "node long").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(virtual - 1))))
    return rows.select(F.md5(F.concat(F.col("node").cast("string"), F.lit("-vnode-"), F.col("i").cast("string")).cast("binary")).alias("pos"), "node")


def route(items: DataFrame, key: str | Column, places: DataFrame, name: str = "node", digits: int = 3) -> DataFrame:
    """items with the node whose place is the first at or after the key's hash, around the ring.

    The ring is cut into 16 ** digits ranges of leading hex digits.  Every arc between two places is listed in the
    ranges that it touches, so keys find theirs by equality of the range and compare the few arcs in it.  The arcs'
    number is fixed by the nodes, not by the keys.
    """
    c = F.col(key) if isinstance(key, str) else key
    taken = set(items.columns) | {name}
    h, bucket = (next(x for x in (f"{base}{'_' * k}" for k in range(99)) if x not in taken) for base in ("ring_hash", "ring_range"))
    w = Window.partitionBy(F.lit(0)).orderBy("pos")
    whole = places.groupBy().agg(F.min(F.struct("pos", "node")).alias("a"), F.max("pos").alias("z"))
    arcs = places.select(F.lag("pos").over(w).alias("after"), F.col("pos").alias("until"), "node").where("after is not null")
    # The first place's arc runs from the last one over the ring's end; a place at its start has no arc before it.
    arcs = arcs.unionByName(whole.select(F.lit("").alias("after"), F.col("a.pos").alias("until"), "a.node")).unionByName(whole.select(F.col("z").alias("after"), F.lit("g").alias("until"), "a.node"))
    number = lambda x: F.coalesce(F.conv(F.rpad(F.substring(x, 1, digits), digits, "0"), 16, 10).cast("int"), F.lit(0))
    last = F.when(F.col("until") == "g", F.lit(16**digits - 1)).otherwise(number("until"))
    arcs = arcs.withColumn(bucket, F.explode(F.sequence(F.when(F.col("after") == "", 0).otherwise(number("after")), last)))
    arcs = arcs.select(bucket, F.col("after").alias("ring_after"), F.col("until").alias("ring_until"), F.col("node").alias("ring_node"))
    keyed = items.withColumn(h, F.md5(c.cast("string").cast("binary")))
    keyed = keyed.withColumn(bucket, number(h))
    hit = keyed.join(F.broadcast(arcs), [bucket]).where((F.col(h) > F.col("ring_after")) & (F.col(h) <= F.col("ring_until")))
    return hit.select(*[F.col(f"`{x}`") for x in items.columns if x != name], F.col("ring_node").alias(name))


def push_sum(values: DataFrame, nodes: int, rounds: int | None = None) -> DataFrame:
    """node, mean, sum (6 places): what every node estimates after rounds of gossip by ring doubling.

    values(node, value), nodes numbered from 0.  A round is one join of the nodes with the one so far before them; it
    simulates the protocol, since an exact sum is an aggregate.
    """
    steps = math.ceil(math.log2(max(nodes, 2)))
    state = written(values.select("node", F.col("value").alias("v"), F.lit(1.0).alias("w")), "gossip")
    for r in range(steps + 1 if rounds is None else rounds):
        sent = state.select(F.pmod(F.col("node") + (1 << (r % steps)), F.lit(nodes)).alias("node"), F.col("v").alias("gv"), F.col("w").alias("gw"))
        state = state.join(sent, "node").select("node", (F.col("v") / 2 + F.col("gv") / 2).alias("v"), (F.col("w") / 2 + F.col("gw") / 2).alias("w"))
    mean = F.col("v") / F.greatest(F.col("w"), F.lit(1e-12))
    return state.select("node", F.round(mean, 6).alias("mean"), F.round(mean * nodes, 6).alias("sum"))


def gossip(bits: DataFrame, nodes: int, rounds: int, key: str = "node") -> DataFrame:
    """round, node, n_bits, new_bits: filters (node from 0, pos) that each take in the one 1, 2, 4... places before, round by round."""
    state = written(bits.select(key, "pos").distinct(), "gossip")
    count = lambda x, r: x.groupBy(key).agg(F.count("*").alias("n_bits")).select(F.lit(r).cast("long").alias("round"), key, "n_bits")
    seen = count(state, 0)
    for r in range(1, rounds + 1):
        sent = state.select(F.pmod(F.col(key) + (1 << (r - 1)), F.lit(nodes)).alias(key), "pos")
        state = written(state.unionByName(sent).distinct(), "gossip")
        seen = seen.unionByName(count(state, r))
    w = Window.partitionBy(key).orderBy("round")
    return seen.withColumn("new_bits", F.col("n_bits") - F.coalesce(F.lag("n_bits").over(w), F.lit(0)))


def false_positives(known: DataFrame, unseen: DataFrame, column: str, m: int, k: int) -> DataFrame:
    """tested, found, rate (6 places): how many of the items that were not put in a filter it takes for its own."""
    hit = bloom_contains(unseen, column, bloom(known, column, m, k), m, k)
    return hit.agg(F.count("*").alias("tested"), F.count_if("maybe_present").alias("found")).withColumn("rate", F.round(F.col("found") / F.col("tested"), 6))


def common_bits(bits: DataFrame, key: str = "filter_id") -> DataFrame:
    """a < b, n: how many bits each two filters share."""
    a, b = bits.select(F.col(key).alias("a"), "pos").distinct(), bits.select(F.col(key).alias("b"), "pos").distinct()
    return a.join(b, "pos").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))
