"""From colliding buckets to exact links and components, without writing the pairs of a group.

Nodes are 64-bit class ids, so that equal sets are one node. Within a bucket every member is compared with
one representative first. Buckets whose members are then still in different components form a
*cluster* under their largest component, each node once however many buckets it shares: there the nodes
outside that component are compared with all nodes of the cluster, block by block, by bit sketches whose
Hamming distance is at most the symmetric difference of the sets. Only pairs that sketches
cannot rule out become rows, and are verified on the exact sets. No link between components is
lost: nodes that share a bucket are connected already or stand in a cluster together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from userbaseline.session import cut

#: further rounds with other representatives come first while more sketch comparisons are left
COMPARISONS = 200_000_000
STAR_ROUNDS = 4
#: nodes in a block; two blocks are compared in one step
BLOCK = 256


def bit_sketches(found: np.ndarray, owner: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, ends): for each unit the parities of its hashes over a power of two of at least two
    bits per element, as 64-bit words; units of size 0 have none."""
    bits = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(2 * size, 1))).astype(np.int64))
    ends = np.append(0, np.cumsum(np.where(size > 0, bits >> 6, 0)))
    place = (found & (bits[owner] - 1).astype(np.uint64)).astype(np.int64)
    words = np.zeros(ends[-1], np.uint64)
    np.bitwise_xor.at(words, ends[owner] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return words, ends


def _folded(sketches: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer words: the halves XORed until they fit."""
    while sketches.shape[1] > width:
        half = sketches.shape[1] // 2
        sketches = sketches[:, :half] ^ sketches[:, half:]
    return sketches


def _distances(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    width = min(one.shape[1], two.shape[1])
    one, two = _folded(one, width), _folded(two, width)
    out = np.zeros((len(one), len(two)), np.int32)
    for w in range(width):
        out += np.bitwise_count(one[:, w, None] ^ two[None, :, w])
    return out


class _Block:
    def __init__(self, entries: list[dict]):
        self.node = np.array([e["node"] for e in entries], np.int64)
        self.root = np.array([e["root"] for e in entries], np.int64)
        self.n = np.array([e["n"] for e in entries], np.int64)
        self.widths: dict[int, list[int]] = {}
        for i, e in enumerate(entries):
            self.widths.setdefault(len(e["sketch"]), []).append(i)
        self.sketches = {w: np.array([entries[i]["sketch"] for i in at], np.int64).view(np.uint64) for w, at in self.widths.items()}


def _compare_blocks(share: int, whole: int):
    schema = "a long, b long, na long, nb long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                main = batch.column(0)[row].as_py()
                left, right = (_Block(batch.column(c)[row].as_py()) for c in (1, 2))
                for w, at in left.widths.items():
                    for v, to in right.widths.items():
                        i, j = np.array(at), np.array(to)
                        na, nb = left.n[i][:, None], right.n[j][None, :]
                        fits = (whole * np.minimum(na, nb) >= share * np.maximum(na, nb)) & (left.root[i][:, None] != right.root[j][None, :])
                        # two nodes outside the main component meet twice
                        fits &= (right.root[j][None, :] == main) | (left.node[i][:, None] < right.node[j][None, :])
                        if not fits.any():
                            continue
                        near = (whole + share) * _distances(left.sketches[w], right.sketches[v]) <= (whole - share) * (na + nb)
                        x, y = np.nonzero(fits & near)
                        if len(x):
                            found = [left.node[i[x]], right.node[j[y]], left.n[i[x]], right.n[j[y]]]
                            yield pa.RecordBatch.from_arrays([pa.array(f) for f in found], ["a", "b", "na", "nb"])

    return run, schema


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """Hint a broadcast of a written narrow table only if its row count is small."""
    return F.broadcast(df) if df.count() <= rows else df


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over ``edges`` (a, b), for every node in them.

    Alternating large-star and small-star steps; each round is written to the shared folder, and
    rounds go on until the edges no longer change.
    """

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.max("a")).first())

    def star(both: DataFrame, larger: bool) -> DataFrame:
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        met = both.join(low, "u")
        if larger:
            return met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        # every smaller neighbour, and the node itself, go to the smallest
        moved = met.select(F.col("v").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(met.select(F.col("u").alias("a"), F.col("m").alias("b")))

    edges = cut(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = state(edges)
    while before[0]:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
            edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        )
        large = star(both, True).filter("a <> b").distinct()
        small = star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        edges = cut(small.filter("a <> b").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()


def mixed_buckets(buckets: DataFrame) -> DataFrame:
    """(sig, node, n, rep) of the buckets that hold more than one node, each member once."""
    by_sig = Window.partitionBy("sig")
    held = buckets.select(
        "sig", "node", "n", F.min("node").over(by_sig).alias("rep"), F.max("node").over(by_sig).alias("top")
    )
    return cut(held.filter("rep <> top").drop("top").dropDuplicates(["sig", "node", "n", "rep"]))


def _hamming(one: Column, two: Column) -> Column:
    """Distance of two bit sketches of linkable sizes; the longer one is folded first."""

    def folded(x: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(x) > half, halves).otherwise(x)

    differing = F.zip_with(folded(one, two), folded(two, one), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    return F.aggregate(differing, F.lit(0), lambda a, b: a + b)


def linked_components(
    buckets: DataFrame, sketches: DataFrame, sets_of: Callable[[DataFrame], DataFrame], share: int, whole: int = 100
) -> DataFrame:
    """(node, root) of all nodes linked with another.

    ``buckets`` has (sig, node, n): linked nodes share a ``sig``; ``n`` is a node's set size.
    ``sketches`` has (node, sketch) as `bit_sketches` makes them; ``sets_of`` gives (node, items) for a table
    of nodes. Both may hold other nodes and repeat some. Two nodes link when
    ``whole * |intersection| >= share * |union|``.
    """
    members = mixed_buckets(buckets)
    sizes_fit = whole * F.least("na", "nb") >= share * F.greatest("na", "nb")
    known = members.select("node").distinct()
    sketches = cut(sketches.join(known, "node", "left_semi").dropDuplicates(["node"]))

    def both_ends(pairs: DataFrame, values: DataFrame, column: str) -> DataFrame:
        """``pairs`` with the column of either node, as one and two."""
        met = pairs.join(values.select(F.col("node").alias("a"), F.col(column).alias("one")), "a")
        return met.join(values.select(F.col("node").alias("b"), F.col(column).alias("two")), "b")

    def verified(pairs: DataFrame) -> DataFrame:
        needed = cut(pairs.select("a").union(pairs.select("b")).distinct().withColumnRenamed("a", "node"))
        sets = cut(sets_of(needed).join(needed, "node", "left_semi").dropDuplicates(["node"]))
        met = both_ends(pairs, sets, "items")
        common = F.size(F.array_intersect("one", "two"))
        good = whole * common >= share * (F.size("one") + F.size("two") - common)
        return met.filter(good).select("a", "b")

    def ordered(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b, na, nb) of sizes that fit, each once, the smaller node first."""
        turned = F.col("a") > F.col("b")
        swap = lambda x, y: F.when(turned, F.col(y)).otherwise(F.col(x)).alias(x)
        return pairs.filter(sizes_fit).select(swap("a", "b"), swap("b", "a"), swap("na", "nb"), swap("nb", "na")).distinct()

    def by_sketch(pairs: DataFrame) -> DataFrame:
        met = both_ends(pairs, sketches, "sketch")
        most = (whole - share) * (F.col("na") + F.col("nb"))
        return met.filter((whole + share) * _hamming(F.col("one"), F.col("two")) <= most).select("a", "b")

    rep_size = members.filter("node = rep").select("sig", F.col("n").alias("nb"))
    star = members.filter("node <> rep").join(rep_size, "sig")
    star = star.select(F.col("node").alias("a"), F.col("rep").alias("b"), F.col("n").alias("na"), "nb")
    links = cut(verified(cut(by_sketch(ordered(star)))))
    labels = components(links)

    for step in range(STAR_ROUNDS):
        own = members.select("sig", "node", "n").join(labels, "node", "left")
        own = own.withColumn("root", F.coalesce("root", "node"))
        by_sig = Window.partitionBy("sig")
        low, high = F.min("root").over(by_sig).alias("low"), F.max("root").over(by_sig).alias("high")
        open_ = cut(own.select("*", low, high).filter("low <> high").drop("low", "high"))
        # of each bucket the largest component, and one of its nodes, another in every bucket
        pick = F.min(F.struct(F.xxhash64("node", "sig", F.lit(step)).alias("h"), "node", "n")).alias("pick")
        per_root = open_.groupBy("sig", "root").agg(F.count("*").alias("k"), pick)
        main = per_root.groupBy("sig").agg(F.max(F.struct("k", "root", "pick")).alias("most"))
        main = cut(main.select("sig", F.col("most.root").alias("main"), F.col("most.pick").alias("pick")))
        cluster = open_.join(main, "sig").select("main", "node", "n", "root").distinct()
        cluster = cut(cluster)
        outside = F.col("root") != F.col("main")
        sizes = cluster.groupBy("main").agg(F.count("*").alias("k"), F.sum(outside.cast("long")).alias("out"))
        left = sizes.agg(F.sum(F.col("k") * F.col("out"))).first()[0] or 0
        if not left:
            return labels
        last = left <= COMPARISONS or step == STAR_ROUNDS - 1
        if last:
            pairs = _near_in_clusters(cluster, sizes, sketches, share, whole)
        else:
            met = open_.join(main, "sig").filter(outside)
            pairs = met.select(F.col("node").alias("a"), F.col("pick.node").alias("b"), F.col("n").alias("na"), F.col("pick.n").alias("nb"))
            pairs = by_sketch(ordered(pairs))
        links = cut(links.unionByName(verified(cut(pairs.select("a", "b")))))
        labels = components(links)
        if last:
            break
    return labels


def _near_in_clusters(cluster: DataFrame, sizes: DataFrame, sketches: DataFrame, share: int, whole: int) -> DataFrame:
    """Pairs of different roots in a cluster that their sketches do not rule out."""
    held = cluster.join(sizes, "main").join(sketches, "node")
    entry = F.struct("node", "n", "root", "sketch")

    def blocks(rows: DataFrame, count: str, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("node"), F.ceil(F.col(count) / BLOCK))
        return rows.groupBy("main", block.alias(f"{name}_no")).agg(F.collect_list(entry).alias(name))

    left = blocks(held.filter(F.col("root") != F.col("main")), "out", "left")
    met = left.join(blocks(held, "k", "right"), "main").select("main", "left", "right")
    return met.mapInArrow(*_compare_blocks(share, whole)).distinct()
