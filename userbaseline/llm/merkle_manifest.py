"""Merkle tree over a dataset, with leaf coordinates from ranks in bitmaps.

Every row is a leaf; the leaves of a group (a source) ascend by doc_id; 16 neighbours make a run,
whose node is the digest of their digests, until one node, the subroot, is left. The subroots, ordered by group
with null first, make the upper tree in the same way.

Coordinates. The doc_ids of a group are a bitmap whose non-zero words of 64 bits are kept; words of equal
place are merged by ``bit_or``, in the map tasks first. The directory holds, for each word, how many leaves lie
before it: sums inside a container of 2¹⁰ words, over the containers of a block of 2¹⁰, and over the
blocks of a group. A leaf's coordinate is its word's entry plus the population count of the lower bits, so leaves
are never sorted. Each level then deals nodes to slots by coordinate div 16 and mod 16 and
hashes the slot arrays; 16 members at most meet in a row. Going down again, each run gets
the digests beside it on its way to the root once, and its members take them over.

Odd rows. Null doc_ids come before all others. Rows of one group with the same doc_id ascend by their leaf;
equal rows are leaves of their own next to each other. Their coordinates, and those of null doc_ids, come
from counts by doc_id and the leaf's first digits instead of bits. A null in any column is `-` in the
leaf; empty and long texts are whole; other columns are ignored. A group of one leaf has that leaf as subroot,
a single subroot is the root, an empty table has neither and gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from userbaseline.session import cut

# Fixed value: members of a run.
FANOUT = 16
#: words that lie before the words of all ids
_NULL_WORD = -(1 << 62)
#: copies of one row that are laid out at a time
_COPIES = 65_536


def digest(parts: Column) -> Column:
    return F.sha2(parts, 256)


def leaf_hash(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of the values, each `-` or its bytes' number, a colon and itself."""
    held = [c.cast("string") for c in (doc_id, source, lang, n_chars, text)]
    parts = [F.when(c.isNull(), "-").otherwise(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)) for c in held]
    return digest(F.concat(*parts))


def leaves(docs: DataFrame, carried: Mapping[str, Column]) -> DataFrame:
    """grp (orders as the source does, null first), doc_id, leaf, the word and bit of doc_id, carried columns."""
    doc_id = F.col("doc_id").cast("long")
    leaf = leaf_hash(doc_id, *(F.col(c) for c in ("source", "lang", "n_chars", "text")))
    return docs.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")).alias("grp"),
        doc_id.alias("doc_id"),
        leaf.alias("leaf"),
        F.coalesce(F.shiftright(doc_id, 6), F.lit(_NULL_WORD)).alias("word"),
        F.coalesce(doc_id.bitwiseAND(63), F.lit(0)).cast("int").alias("bit"),
        *(c.alias(name) for name, c in carried.items()),
    )


def _before(sums: Column, keys: list[str], order: list[str]) -> Column:
    window = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(sums.over(window), F.lit(0))


def directory(marked: DataFrame) -> DataFrame:
    """(grp, word, bits, n, base, total): the words of each group's bitmap with the number of leaves before
    them and in the group. ``n`` is the number of leaves of a word, more than its bits if ids repeat."""
    bits = F.bit_or(F.expr("shiftleft(1L, bit)"))
    words = marked.groupBy("grp", "word").agg(bits.alias("bits"), F.count(F.lit(1)).alias("n"))
    words = cut(words).withColumns({"container": F.shiftright("word", 10), "block": F.shiftright("word", 20)})
    within = words.withColumn("in_container", _before(F.sum("n"), ["grp", "container"], ["word"]))
    containers = words.groupBy("grp", "block", "container").agg(F.sum("n").alias("held"))
    blocks = containers.groupBy("grp", "block").agg(F.sum("held").alias("held"))
    containers = containers.withColumn("in_block", _before(F.sum("held"), ["grp", "block"], ["container"])).drop("held")
    blocks = blocks.withColumns(
        {"in_group": _before(F.sum("held"), ["grp"], ["block"]), "total": F.sum("held").over(W.partitionBy("grp"))}
    ).drop("held")
    met = within.join(containers, ["grp", "block", "container"]).join(blocks, ["grp", "block"])
    base = F.col("in_container") + F.col("in_block") + F.col("in_group")
    return met.select("grp", "word", "bits", "n", base.alias("base"), "total")


def coordinates(marked: DataFrame) -> DataFrame:
    """The leaves with ``at``, their coordinate in the group, and ``total``, the group's number of leaves."""
    held = marked.drop("word", "bit").columns
    found = cut(marked.join(directory(marked), ["grp", "word"]))
    alone = F.bit_count("bits") == F.col("n")
    lower = F.col("bits").bitwiseAND(F.bitwise_not(F.expr("shiftleft(-1L, bit)")))
    ranked = found.filter(alone).select(*held, "total", (F.col("base") + F.bit_count(lower)).alias("at"))
    # ids that repeat: equal rows once, with the number of their copies
    key = ["grp", "word", "bit", "digits"]
    told = [c for c in found.columns if c not in ("bits", "n")]
    met = found.filter(~alone).groupBy(*told).agg(F.count(F.lit(1)).alias("copies"))
    met = met.withColumn("digits", F.substring("leaf", 1, 4))
    starts = met.groupBy(*key).agg(F.sum("copies").alias("some"))
    starts = starts.withColumn("start", _before(F.sum("some"), ["grp", "word"], ["bit", "digits"])).drop("some")
    met = met.withColumn("inside", _before(F.sum("copies"), key, ["leaf"])).join(starts, key)
    met = met.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(_COPIES).cast("long"))))
    upto = F.least(F.col("from") + (_COPIES - 1), F.col("copies") - 1)
    met = met.withColumn("copy", F.explode(F.sequence(F.col("from"), upto)))
    at = F.col("base") + F.col("start") + F.col("inside") + F.col("copy")
    return ranked.unionByName(met.select(*held, "total", at.alias("at")))


def _slots(nodes: DataFrame, *members: str) -> DataFrame:
    """Runs of neighbours: (grp, at, total, slots), the members in an array by slot."""
    slot = F.struct((F.col("at") % FANOUT).alias("slot"), *members)
    return (
        nodes.groupBy("grp", F.floor(F.col("at") / FANOUT).alias("run"), "total")
        .agg(F.array_sort(F.collect_list(slot)).alias("slots"))
        .withColumnRenamed("run", "at")
    )


def _nodes(runs: DataFrame) -> DataFrame:
    """The nodes of runs; ``total`` is the number of nodes in the group."""
    return runs.select(
        "grp", "at", digest(F.array_join("slots.h", "")).alias("h"), F.ceil(F.col("total") / FANOUT).alias("total")
    )


def _reduced(nodes: DataFrame, most: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Runs of each level above ``nodes``, and at each level the tops: (grp, h) of groups with one node."""
    levels, tops = [], []
    while True:
        tops.append(nodes.filter("total = 1").select("grp", "h"))
        if most <= 1:
            return levels, tops
        runs = cut(_slots(nodes.filter("total > 1"), "h"))
        levels.append(runs)
        nodes, most = _nodes(runs), -(-most // FANOUT)


def _beside(hashes: str) -> Column:
    """For each slot the digests to its left and right, joined."""
    all_ = F.col(hashes)
    left = lambda i: F.array_join(F.slice(all_, 1, i), "")
    right = lambda i: F.array_join(F.slice(all_, i + 2, FANOUT), "")
    return F.transform(all_, lambda _, i: F.struct(left(i).alias("l"), right(i).alias("r")))


def _descended(levels: list[DataFrame], starts: list[DataFrame]) -> DataFrame:
    """(grp, at, path, …) of the nodes that the lowest level's runs consist of, from the tops' paths."""
    paths = starts[-1]
    for runs, start in zip(reversed(levels), reversed(starts[:-1])):
        met = runs.join(paths, ["grp", "at"]).withColumn("beside", _beside("slots.h"))
        kept = [c for c in paths.columns if c not in ("grp", "at", "path")]
        own = met.select("grp", F.col("at").alias("run"), "path", *kept, F.posexplode("beside").alias("slot", "own"))
        at = F.col("run") * FANOUT + F.col("slot")
        down = own.select("grp", at.alias("at"), F.concat(F.array("own"), "path").alias("path"), *kept)
        paths = down.unionByName(start)
    return paths


_PATH = "array<struct<l:string,r:string>>"


def _numbered(subroots: DataFrame) -> DataFrame:
    """Subroots with their place in the order of groups, by a range partition and counts of its parts."""
    spread = cut(subroots.repartitionByRange("grp").withColumn("part", F.spark_partition_id()))
    counts = spread.groupBy("part").agg(F.count(F.lit(1)).alias("some"))
    counts = counts.withColumn("start", _before(F.sum("some"), [], ["part"])).drop("some")  # a row for each part
    inside = F.row_number().over(W.partitionBy("part").orderBy("grp")) - 1
    return spread.withColumn("inside", inside).join(counts, "part").select("grp", "h", (F.col("start") + F.col("inside")).alias("place"))


def manifest(docs: DataFrame, carried: Mapping[str, Column] | None = None) -> DataFrame:
    """source, doc_id, position (in the source), leaf, subroot, root and path of every row.

    ``path`` has, from the leaf's level up to the root, the digests to the left and right in the
    run, joined. ``carried`` names more columns, made of the row's own, that come along with the leaf.
    """
    carried = dict(carried or {})
    members = ["leaf", "doc_id", *carried]
    placed = coordinates(leaves(docs, carried)).withColumnRenamed("leaf", "h")
    members[0] = "h"
    runs = cut(_slots(placed, *members))
    most = runs.agg(F.max("total")).first()[0] or 0
    levels, tops = _reduced(_nodes(runs.filter("total > 1")), -(-most // FANOUT))
    lone = runs.filter("total = 1").select("grp", F.col("slots")[0]["h"].alias("h"))
    numbered = cut(_numbered(reduce(DataFrame.unionByName, [lone, *tops])))
    n_groups = numbered.count()

    upper = numbered.select(F.lit("").alias("grp"), F.col("place").alias("at"), "h", F.lit(n_groups).cast("long").alias("total"))
    upper_levels, upper_tops = _reduced(upper, n_groups)
    none = F.array().cast(_PATH).alias("path")
    zero = F.lit(0).cast("long").alias("at")
    root = [t.select("grp", zero, none, F.col("h").alias("root")) for t in upper_tops]
    above = _descended(upper_levels, root).select(F.col("at").alias("place"), "path", "root")
    roots = cut(numbered.join(above, "place").select("grp", F.col("h").alias("subroot"), "root", "path"))

    at_top = [t.drop("h").join(roots, "grp").select("grp", zero, "path", "subroot", "root") for t in (lone, *tops)]
    paths = _descended(levels, at_top[1:]).unionByName(at_top[0])
    met = runs.join(paths, ["grp", "at"]).withColumn("beside", _beside("slots.h"))
    each = met.select("grp", "at", "total", "path", "subroot", "root", F.inline(F.arrays_zip("slots", "beside")))
    own = F.when(F.col("total") > 1, F.array("beside")).otherwise(F.array().cast(_PATH))
    return each.select(
        F.when(F.col("grp") != "", F.substr("grp", F.lit(2))).alias("source"),
        "slots.doc_id",
        (F.col("at") * FANOUT + F.col("slots.slot")).alias("position"),
        F.col("slots.h").alias("leaf"),
        "subroot",
        "root",
        F.concat(own, "path").alias("path"),
        *(f"slots.{name}" for name in carried),
    )


def proof(path: Column) -> Column:
    """The digests of the siblings, level by level, left to right, joined."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["l"], p["r"])), "")


def folded_root(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, p: digest(F.concat(p["l"], h, p["r"])))
