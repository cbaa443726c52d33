"""Conversations as prefix trees: turns that conversations begin with in common are emitted once.

Template: ``<turn ROLE>TEXT</turn>`` for each turn, in the order of ``turn``. In texts ``&`` becomes ``&amp;``
and ``<`` becomes ``&lt;`` (in roles ``>`` also ``&gt;``), so no text holds a control string and
`unescaped` gives back every text exactly.

A *node* of a tree is a sequence of first turns, found by a hash over it; its *owner* is the smallest
conversation that passes through it. A conversation owns the tail of its path from some
turn on, its *segment*, or nothing if an equal or longer one owns all. Sorting segments by the turns where
their paths leave other segments (the deeper branch first) is depth-first order, so the place of a
segment in its tree is a sum of lengths over sorted rows. Units are code points of the formatted text, or tokens:
`tokenised` encodes every segment once, mark by mark and text by text, so that a shared turn has the same tokens in all
its conversations and loss spans begin and end with tokens, and gives the same tables in units of tokens.

`packed` gives the segments; each carries its place, the position id of its first character (depth in its
conversation, so that a character's position does not depend on what else is packed), the spans of its
assistant texts (loss mask) and the intervals of the tree it may attend to besides itself: its ancestors.
`paths` gives the intervals that make up each conversation, copies included.

Trees are never collected: common first turns are counted by partial aggregation, joins on owners have
one row per owner on one side, and sums run over range partitions. One conversation is one row.
Null texts and roles are empty, a null ``turn`` comes first, ties of a turn follow role and text, repeated
rows are turns of their own. Rows with a null conv_id make up one conversation, with a null id in the
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from userbaseline.llm import byte_bpe
from userbaseline.session import cut, ship

OPEN, CLOSE = "<turn ", "</turn>"
LEARNT = "assistant"
#: stands for a null conv_id inside
NO_ID = -(1 << 63)


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescaped(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">"))
    return F.replace(text, F.lit("&amp;"), F.lit("&"))


def formatted_turns(conversations: DataFrame) -> DataFrame:
    """conv, depth (from 1), frag (the formatted turn), n (its code points), at (its position id),
    learnt_from and learnt_to (positions of an assistant text, else null), x1 and x2 (hash of the path)."""
    blank = F.lit("")
    rows = conversations.select(
        F.coalesce("conv_id", F.lit(NO_ID)).alias("conv"),
        "turn",
        F.coalesce("role", blank).alias("role"),
        F.coalesce("text", blank).alias("text"),
    )
    ordered = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "text")
    head = F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit(">"), F.lit("&gt;")), F.lit(">"))
    rows = rows.select(
        "conv",
        F.row_number().over(ordered).alias("depth"),
        F.concat(head, escaped(F.col("text")), F.lit(CLOSE)).alias("frag"),
        F.char_length(head).alias("head"),
        (F.col("role") == LEARNT).alias("learnt"),
    )
    sofar = Window.partitionBy("conv").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    code = lambda seed: F.bit_xor(F.xxhash64(F.lit(seed), "depth", "frag")).over(sofar)
    n = F.char_length("frag").cast("long")
    rows = rows.select(
        "*", n.alias("n"), (F.sum(n).over(sofar) - n).alias("at"), code(1).alias("x1"), code(2).alias("x2")
    )
    learnt = F.when(F.col("learnt"), F.col("at") + F.col("head"))
    return rows.select(
        "conv", "depth", "frag", "n", "at", "x1", "x2",
        learnt.alias("learnt_from"),
        F.when(F.col("learnt"), F.col("at") + F.col("n") - len(CLOSE)).alias("learnt_to"),
    )


@dataclass
class ChatTrees:
    """Tables of the shared folder: ``segments`` and ``runs`` (pieces of segments that make a conversation)."""

    segments: DataFrame
    runs: DataFrame

    def packed(self) -> DataFrame:
        """owner, tree, start, length, position_start, text, ids (if tokenised), loss, attends (array of [from, to) in
        the tree)."""
        others = self.runs.filter("conv <> owner").groupBy("conv").agg(F.sort_array(F.collect_list(_interval())).alias("attends"))
        met = self.segments.join(others, self.segments.owner == others.conv, "left")
        none = F.expr("cast(array() AS array<struct<`from`: bigint, `to`: bigint>>)")
        shift = lambda s: F.struct((s["from"] + F.col("start")).alias("from"), (s["to"] + F.col("start")).alias("to"))
        return met.select(
            _shown("owner"), _shown("tree"), "start", "length", "position_start", "text",
            *[c for c in met.columns if c == "ids"],
            F.transform("loss", shift).alias("loss"), F.coalesce("attends", none).alias("attends"),
        )

    def paths(self) -> DataFrame:
        """conv_id, tree and the intervals of the tree that are the conversation, in order."""
        found = self.runs.groupBy("conv", "tree").agg(F.sort_array(F.collect_list(_interval())).alias("intervals"))
        return found.select(_shown("conv").alias("conv_id"), _shown("tree"), "intervals")


def _shown(name: str) -> Column:
    return F.when(F.col(name) != NO_ID, F.col(name)).alias(name)


def _interval() -> Column:
    begin = F.col("start") + F.col("skip")
    return F.struct(begin.alias("from"), (begin + F.col("length")).alias("to"))


def _with_places(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with ``place``, the sum of the lengths of all rows before them: sums inside range partitions, and one
    base for each partition."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    within = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each partition
    bases = ranged.groupBy("part").agg(F.sum("length").alias("total"))
    bases = bases.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base"))
    ahead = ranged.select("*", (F.sum("length").over(within) - F.col("length")).alias("ahead")).join(bases, "part")
    return ahead.select("*", (F.col("base") + F.col("ahead")).alias("place")).drop("part", "ahead", "base")


def chat_trees(conversations: DataFrame) -> ChatTrees:
    """Build the trees of all conversations and write them to the shared folder."""
    turns = cut(formatted_turns(conversations))
    node = ["x1", "x2", "depth"]
    # a table of its own meets the turns in a plain join, whose hot nodes Spark can split
    owners = cut(turns.groupBy(*node).agg(F.min("conv").alias("owner")))
    runs = turns.select("conv", *node, "at", "n").join(owners, node).groupBy("conv", "owner").agg(
        F.min("depth").alias("from_depth"), F.min("at").alias("from_at"), F.sum("n").alias("length"),
        F.count(F.lit(1)).alias("n_turns"),
    )
    runs = cut(runs)

    branch = F.struct((-F.col("from_depth")).alias("up"), F.col("owner").alias("owner"))
    # the first run of a path begins at turn 1; `up` falls from there, so sorting downwards gives path order
    path = runs.groupBy("conv").agg(
        F.sort_array(F.collect_list(branch), asc=False).alias("key"),
        F.max(F.when(F.col("conv") == F.col("owner"), F.struct("from_depth", "from_at", "length"))).alias("own"),
    )
    owned = path.filter("own is not null").select("conv", "key", "own.*", F.get("key", F.lit(0))["owner"].alias("tree"))
    placed = _with_places(owned, ["key"])
    placed = cut(placed.select("conv", "tree", "from_depth", "from_at", "length", "place"))
    roots = placed.groupBy("tree").agg(F.min("place").alias("root"))
    placed = placed.join(roots, "tree").select(
        F.col("conv").alias("owner"), "tree", "from_depth", F.col("from_at").alias("position_start"),
        "length", (F.col("place") - F.col("root")).alias("start"),
    )

    piece = F.struct(
        "depth", "frag",
        (F.col("learnt_from") - F.col("position_start")).alias("from"),
        (F.col("learnt_to") - F.col("position_start")).alias("to"),
    )
    own_turns = turns.join(placed, turns.conv == placed.owner).filter("depth >= from_depth")
    texts = own_turns.groupBy("owner").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))
    spans = F.filter("pieces", lambda p: p["from"].isNotNull())
    texts = texts.select(
        "owner",
        F.array_join(F.col("pieces.frag"), "").alias("text"),
        F.transform(spans, lambda p: F.struct(p["from"].alias("from"), p["to"].alias("to"))).alias("loss"),
    )
    segments = cut(placed.join(texts, "owner"))
    of_owner = segments.select("owner", "tree", "start", "position_start")
    runs = runs.join(of_owner, "owner").select(
        "conv", "owner", "tree", "from_depth", "length", "start", "n_turns", (F.col("from_at") - F.col("position_start")).alias("skip")
    )
    return ChatTrees(segments, cut(runs))


_ENCODED = (
    "owner long, ids array<int>, turns array<bigint>, loss array<struct<`from`: bigint, `to`: bigint>>"
)


def tokenised(trees: ChatTrees, rank_path: str, pattern: str) -> ChatTrees:
    """The trees in tokens: start, length, position_start, skip, loss, attended intervals and paths count
    tokens, and segments have their ``ids``. Each turn is encoded once, where its segment holds it."""
    spark = trees.segments.sparkSession
    ship(spark)
    with open(rank_path, "rb") as file:
        shared = spark.sparkContext.broadcast(byte_bpe.Shared(file.read(), pattern, 1.0))
    mark = regex.compile(f"({OPEN}[^>]*>)([^<]*){CLOSE}").findall  # texts hold neither sign of a mark
    learnt = f"{OPEN}{LEARNT}>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()

        def numbers(text: str) -> list[int]:
            return [int(i) for i in codec.encode(text).split(",")] if text else []

        close = numbers(CLOSE)
        for batch in batches:
            for owner, text in zip(batch.column("owner").to_pylist(), batch.column("text")):
                ids, sizes, loss = [], [], []
                for head, body in mark(text.as_py()):
                    begin = len(ids)
                    ids += numbers(head)
                    first = len(ids)
                    ids += numbers(body)
                    if head == learnt:
                        loss.append({"from": first, "to": len(ids)})
                    ids += close
                    sizes.append(len(ids) - begin)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([owner], pa.int64()), pa.array([ids], pa.list_(pa.int32())), pa.array([sizes], pa.list_(pa.int64())),
                        pa.array([loss], pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))),
                    ],
                    ["owner", "ids", "turns", "loss"],
                )

    encoded = cut(trees.segments.select("owner", "text").mapInArrow(run, _ENCODED))
    sums = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = encoded.select("owner", "turns", F.size("ids").cast("long").alias("length"))
    old = trees.segments.select("owner", "tree", "from_depth", F.col("start").alias("order"))
    placed = cut(_with_places(old.join(sizes, "owner"), ["tree", "order"]))
    roots = placed.groupBy("tree").agg(F.min("place").alias("root"))
    placed = placed.join(roots, "tree").withColumn("start", F.col("place") - F.col("root"))

    of_owner = placed.select("owner", "start", "turns", F.col("from_depth").alias("own_depth"))
    runs = trees.runs.select("conv", "owner", "tree", "from_depth", "n_turns").join(of_owner, "owner")
    ahead = (F.col("from_depth") - F.col("own_depth")).cast("int")
    runs = cut(runs.select(
        "conv", "owner", "tree", "from_depth", "n_turns", "start",
        sums(F.slice("turns", F.lit(1), ahead)).alias("skip"),
        sums(F.slice("turns", ahead + 1, F.col("n_turns").cast("int"))).alias("length"),
    ))
    # a conversation's own segment comes after all others on its path
    before = runs.filter("conv <> owner").groupBy("conv").agg(F.sum("length").alias("before"))
    met = placed.join(before, placed.owner == before.conv, "left")
    met = met.select("owner", "tree", "from_depth", "start", "length", F.coalesce("before", F.lit(0)).alias("position_start"))
    texts = trees.segments.select("owner", "text")
    segments = met.join(encoded.select("owner", "ids", "loss"), "owner").join(texts, "owner")
    return ChatTrees(cut(segments), runs)


def read_back(trees: ChatTrees) -> DataFrame:
    """conv_id, formatted (its text out of the trees), turns (array of role and text), learnt (texts under
    the loss mask, in order); roles and texts unescaped."""
    segments = trees.segments.select("owner", "text", "loss")
    met = trees.runs.select("conv", "owner", "from_depth", "skip", "length").join(segments, "owner")
    end = F.col("skip") + F.col("length")
    inside = F.filter("loss", lambda s: (s["from"] >= F.col("skip")) & (s["to"] <= end))
    cut_out = lambda a, n: F.col("text").substr((a + 1).cast("int"), n.cast("int"))
    met = met.select(
        "conv", "from_depth",
        cut_out(F.col("skip"), F.col("length")).alias("part"),
        F.transform(inside, lambda s: unescaped(cut_out(s["from"], s["to"] - s["from"]))).alias("learnt"),
    )
    whole = met.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("from_depth", "part", "learnt"))).alias("parts"))
    whole = whole.select(
        "conv", F.array_join(F.col("parts.part"), "").alias("formatted"), F.flatten(F.col("parts.learnt")).alias("learnt")
    )
    marked = F.split("formatted", CLOSE, -1)  # what follows the last mark is empty
    pieces = F.slice(marked, 1, F.size(marked) - 1)

    def turn(piece: Column) -> Column:
        mark = F.instr(piece, ">")
        role = piece.substr(F.lit(len(OPEN) + 1), mark - len(OPEN) - 1)
        text = piece.substr(mark + 1, F.char_length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(text).alias("text"))

    return whole.select(_shown("conv").alias("conv_id"), "formatted", F.transform(pieces, turn).alias("turns"), "learnt")
