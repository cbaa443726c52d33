"""Documents that hold passages of a benchmark, found by spaced seeds; DataFrame operations only.

Texts become tokens: A-Z folded, runs of characters other than ASCII punctuation, blanks and
control characters. A *spaced seed* is a fixed mask over a window of tokens: the positions under a 1
are hashed, those under a 0 are ignored, so tokens may be replaced there. All windows of the documents
are joined with all windows of the benchmark on (mask, hash). A hit fixes how item and document lie upon
each other (document position minus item position, the *offset*); there the tokens of
the item are compared. The document is contaminated if at least ``MATCHED`` tokens agree within some
``STRETCH`` tokens of the item, or ``SHARE`` percent of the tokens of an item with fewer than 20. The
stretch keeps chance agreements far from the hit out of the count, however long the item is.

Items of ``LONG_ITEM`` tokens or more are sought by ``MASKS``, shorter ones by ``SHORT_MASKS``, and those of one to
four tokens, of which ``SHARE`` percent are all, as a whole. With 80 percent of its tokens left, wherever the others stood, an item of 5 to 16
tokens always keeps a window of a short mask, and one of 17 tokens or more keeps one of a
long mask in at least 98 percent of the cases. Only masks that some item needs are laid on the documents.

The windows of the benchmark are broadcast only when they have been counted and are few; beyond that the
same join is shuffled. Texts with a hit are made tokens once and cut into blocks of ``BLOCK`` tokens, and each hit meets the
blocks it lies on, so a text's cost grows with its hits and not with hits times its length. An item and a text that
repeat one window have a hit for each offset.

Hits are made distinct before texts are met again by a 128-bit key of id and
text. Null and empty texts have no tokens and match nothing, neither as documents nor as items.
A null id is reported as null; repeated rows are reported once; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.llm.line_dedup import folded
from userbaseline.session import cut

#: fixed masks of six tokens over windows of ten or eleven
MASKS = ["1101100101", "1110010011", "10110011001"]
#: fixed masks of four tokens over windows of four or five, for items below `LONG_ITEM` tokens
SHORT_MASKS = ["1111", "11011", "10111", "11101"]
LONG_ITEM = 17
MATCHED, SHARE, STRETCH = 16, 80, 64
#: tokens of a text that are compared in one row
BLOCK = 512
#: windows of the benchmark that may be broadcast: 24 bytes each
BROADCAST_WINDOWS = 400_000

_EDGE = "".join(chr(c) for c in range(1, 128) if not chr(c).isalnum())
_GAPS = r"[\x00-/:-@\[-`{-\x7f]+"


def tokens(text: Column) -> Column:
    """array<long>: a hash for each token of ``text``."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_EDGE))
    found = F.transform(F.split(folded(inner), _GAPS, -1), lambda w: F.xxhash64(w))
    return F.when(F.length(inner) > 0, found).otherwise(F.array().cast("array<long>"))


def row_key() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(F.lit(seed), "doc_id", text).alias(f"r{seed}") for seed in (1, 2)]


def _seeds(tokens_: str, at: str, shapes: list[tuple[int, str]]) -> Column:
    """array<struct<mask, hash>> of the window of ``tokens_`` at ``at``."""
    held = []
    for number, mask in shapes:
        picked = [F.get(tokens_, F.col(at) + k) for k, bit in enumerate(mask) if bit == "1"]
        held.append(F.struct(F.lit(number).alias("mask"), F.xxhash64(F.lit(number), *picked).alias("hash")))
    return F.array(*held)


def _windows(rows: DataFrame, keys: list[str], shapes: list[tuple[int, str]]) -> DataFrame:
    """keys, at, hash of all windows of the shapes in the column ``t``."""
    least = min(len(mask) for _, mask in shapes)
    starts = F.when(F.size("t") >= least, F.sequence(F.lit(0), F.size("t") - least))
    # the outer form keeps the optimizer from computing the tokens a second time for a filter
    at = rows.select(*keys, "t", F.explode_outer(starts).alias("at")).filter("at is not null")
    each = at.select(*keys, "at", F.inline(_seeds("t", "at", shapes)))
    return each.select(*keys, "at", "hash")


def _shapes(items: DataFrame) -> list[tuple[int, str, int, int]]:
    """(number, mask, least and most tokens of the items it is for) of the masks that some item needs."""
    shortest = len(SHORT_MASKS[0]) + 1
    sought = [("1" * n, n, n) for n in range(1, shortest)]
    sought += [(mask, shortest, LONG_ITEM - 1) for mask in SHORT_MASKS] + [(mask, LONG_ITEM, 2**31 - 1) for mask in MASKS]
    # at most LONG_ITEM numbers
    sizes = [r.n for r in items.select(F.least(F.size("t"), F.lit(LONG_ITEM)).alias("n")).distinct().collect()]
    return [(k, *shape) for k, shape in enumerate(sought) if any(shape[1] <= n <= shape[2] for n in sizes)]


def _item_windows(items: DataFrame, shapes: list[tuple[int, str, int, int]]) -> DataFrame:
    """(item, item_at, hash) of the windows of each item by the masks that are for its size."""
    every = None
    for number, mask, least, most in shapes:
        rows = _windows(items.filter(F.size("t").between(least, most)), ["item"], [(number, mask)])
        every = rows if every is None else every.unionByName(rows)
    return every.select("item", F.col("at").alias("item_at"), "hash").distinct()


def _blocks(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """(r1, r2, doc_id, block, part): the tokens of the texts that have a hit, in blocks."""
    held = docs.select(*row_key(), "doc_id", "text").join(hits.select("r1", "r2").distinct(), ["r1", "r2"], "left_semi")
    held = held.select("r1", "r2", "doc_id", tokens(F.col("text")).alias("t"))
    parts = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("t") - 1) / BLOCK).cast("int")),
        lambda b: F.struct(b.alias("block"), F.slice("t", b * BLOCK + 1, BLOCK).alias("part")),
    )
    return held.select("r1", "r2", "doc_id", F.inline_outer(parts)).filter("block is not null")


def _agreements(docs: DataFrame, items: DataFrame, hits: DataFrame) -> DataFrame:
    """(r1, r2, doc_id, item, offset, n, agree): the places of the item, ascending, that agree there."""
    placed = hits.join(items.select("item", F.col("t").alias("u")), "item").withColumn("n", F.size("u"))
    first, last = F.greatest("offset", F.lit(0)), F.col("offset") + F.col("n") - 1
    span = F.sequence(F.floor(first / BLOCK).cast("int"), F.floor(last / BLOCK).cast("int"))
    placed = placed.select("*", F.explode(span).alias("block"))
    met = _blocks(docs, hits).join(placed, ["r1", "r2", "block"])
    # the two stretches that lie upon each other, cut out before they are compared token by token
    begin, low = F.col("block") * BLOCK, F.greatest(first, F.col("block") * BLOCK)
    high = F.least(last + 1, begin + F.size("part"))
    met = met.select("*", begin.alias("begin"), low.alias("low"), F.greatest(high - low, F.lit(0)).alias("size"))
    ours = F.slice("part", F.col("low") - F.col("begin") + 1, F.col("size"))
    same = F.zip_with(ours, F.slice("u", F.col("low") - F.col("offset") + 1, F.col("size")), lambda x, y: x == y)
    places = F.transform(same, lambda s, k: F.when(s, F.col("low") - F.col("offset") + k))
    met = met.select("r1", "r2", "doc_id", "item", "offset", "n", "block", F.filter(places, lambda x: x.isNotNull()).alias("places"))
    # a set: repeated rows have the same blocks
    of_hit = met.groupBy("r1", "r2", "doc_id", "item", "offset", "n").agg(
        F.sort_array(F.collect_set(F.struct("block", "places"))).alias("parts")
    )
    return of_hit.select("r1", "r2", "doc_id", "item", "offset", "n", F.flatten("parts.places").alias("agree"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and item it holds: r1, r2 (key of the row), doc_id, item_id, n_tokens
    (of the item), n_matched (of the whole item), at (token of the document where the item starts; may be
    below 0)."""
    items = benchmark.select("item_id", tokens(F.col("text")).alias("t")).filter(F.size("t") > 0).distinct()
    items = cut(items.withColumn("item", F.xxhash64("item_id", "t")))
    shapes = _shapes(items)
    if not shapes:
        shapes = [(0, "1", 1, 1)]  # no item has a window
    seeds = cut(_item_windows(items, shapes))
    if seeds.count() <= BROADCAST_WINDOWS:
        seeds = F.broadcast(seeds)

    held = docs.select(*row_key(), tokens(F.col("text")).alias("t"))
    hits = _windows(held, ["r1", "r2"], [shape[:2] for shape in shapes]).join(seeds, "hash")
    hits = cut(hits.select("r1", "r2", "item", (F.col("at") - F.col("item_at")).alias("offset")).distinct())

    need = F.least(F.lit(MATCHED), F.ceil(F.col("n") * SHARE / 100)).cast("int")
    met = _agreements(docs, items, hits).withColumn("need", need).filter(F.size("agree") >= F.col("need"))
    starts = F.slice("agree", F.lit(1), F.size("agree") - F.col("need") + 1)
    ends = F.slice("agree", F.col("need"), F.size("agree") - F.col("need") + 1)
    near = F.exists(F.zip_with(starts, ends, lambda x, y: y - x < STRETCH), lambda x: x)
    met = met.filter(near).join(items.select("item", "item_id"), "item")
    best = met.groupBy("r1", "r2", "doc_id", "item_id").agg(
        F.max(F.struct(F.size("agree").alias("m"), (-F.col("offset")).alias("from"), "n")).alias("best")
    )
    return best.select(
        "r1", "r2", "doc_id", "item_id",
        F.col("best.n").cast("long").alias("n_tokens"),
        F.col("best.m").cast("long").alias("n_matched"),
        (-F.col("best.from")).cast("long").alias("at"),
    )


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all their columns stay."""
    found = contaminated(docs, benchmark).select("r1", "r2").distinct()
    key = row_key()
    packed = docs.select(F.struct("*").alias("doc"), *key)
    return packed.join(found, ["r1", "r2"], "left_anti").select("doc.*")
