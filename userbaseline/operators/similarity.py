"""How much a user's day resembles the user's previous observed day.

Similarity is 1 − edit distance / length of the longer text, over the whole texts of both days.
Pairs of short texts, nearly all pairs, are compared by the built-in function next to a ``lag``.
A pair with a long text is compared exactly too, each by its own size. Leading blocks that are equal are left
out; of the rest only a band along the diagonal of the distance table is worked out first, and a
distance that does not exceed the band is final. The others are done again with a band ``WIDEN`` times
as wide, until it fits or covers the table. The table is cut into tiles of ``block_chars`` a side. The
tiles on one anti-diagonal, of all pairs, are computed side by side in one job, and only their edges
(two bits per character) pass to the next. Each diagonal is a table in the shared folder, so a lost
executor costs at most the diagonal at hand. The number of jobs is that of the longest
pair's diagonals, two for each ``block_chars``, times the logarithm of its distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from userbaseline.functions.edit_distance import pack, tile, unpack
from userbaseline.functions.scalars import similarity_of, text_similarity
from userbaseline.operators import command_text as ct
from userbaseline.operators.features import first_sessions
from userbaseline.operators.tenancy import commands_of_sessions
from userbaseline.session import cut, scratch_path, ship

DAY = ["user_id", "day"]
# beyond this length the block comparison is the faster one as well
INLINE_CHARS = 2_048
#: sides of a tile and of the rectangles it is made of
BLOCK_CHARS, SIDE = 262_144, 8_192
#: the first band, and how many times wider the next one is
BAND, WIDEN = 8_192, 16
#: characters of both texts in a task's tiles, and tiles that are read and given back at a time
_TASK_CHARS, _AT_A_TIME = 2_000_000, 32


def _with_previous(sizes: DataFrame) -> DataFrame:
    w = W.partitionBy("user_id").orderBy("day")
    return sizes.withColumns(
        {"prev_day": F.lag("day").over(w), "prev_chars": F.lag("chars").over(w)}
    )


def _inline(texts: DataFrame) -> DataFrame:
    """Texts against the row before; a user's first day counts as unchanged."""
    w = W.partitionBy("user_id").orderBy("day")
    first = F.row_number().over(w) == 1
    alike = text_similarity(F.col("text"), F.lag("text").over(w))
    return texts.select(*DAY, F.when(first, F.lit(1.0)).otherwise(alike).alias("five_cmd_match"))


def day_similarity(
    commands: DataFrame, inline_chars: int = INLINE_CHARS, block_chars: int = BLOCK_CHARS, band: int = BAND
) -> DataFrame:
    """Feature 6: (user_id, day, five_cmd_match), for days with at least one command.

    A pair goes its own way by its own size: a long day changes nothing for other pairs.
    """
    commands = commands.filter(F.col("user_id").isNotNull() & F.col("day").isNotNull())
    pairs = cut(_with_previous(ct.text_sizes(commands, DAY)))
    long_days = pairs.filter(F.col("chars") > inline_chars).select(*DAY)
    short = ct.short_texts(commands.join(long_days, DAY, "left_anti"), DAY)
    # long days stay in the sequence without their text, so that lag still finds the day before
    near = _inline(pairs.select(*DAY).join(short, DAY, "left"))
    long_pairs = pairs.filter(F.col("prev_day").isNotNull() & (F.greatest("chars", "prev_chars") > inline_chars))
    if long_pairs.isEmpty():  # no rows to exchange
        return near
    far = _blocked(commands, long_pairs, block_chars, band)
    return near.join(long_pairs, DAY, "left_anti").unionByName(far)


def day_similarity_first_session(
    sessions: DataFrame, commands: DataFrame, inline_chars: int = INLINE_CHARS
) -> DataFrame:
    """The same comparison restricted to each day's first session."""
    first = first_sessions(sessions.join(commands, "session_id", "left_semi"))
    return day_similarity(commands_of_sessions(commands, first), inline_chars)


def _blocked(commands: DataFrame, pairs: DataFrame, block_chars: int, band: int) -> DataFrame:
    """Exact similarity of pairs with a long text."""
    ship(commands.sparkSession)
    blocks = lambda chars: F.ceil(F.col(chars) / block_chars)
    # an empty text against any other: the distance is the other's length, similarity 0
    empty = F.least("chars", "prev_chars") == 0
    grid = pairs.filter(~empty).withColumns({"n_rows": blocks("chars"), "n_columns": blocks("prev_chars")})
    wanted = pairs.select(*DAY).union(pairs.select("user_id", "prev_day")).distinct()
    texts = cut(ct.command_text(commands.join(wanted, DAY, "left_semi"), DAY, block_chars))
    rows = texts.select(*DAY, F.col("chunk_no").alias("i"), F.col("text").alias("row_text"))
    columns = texts.select(
        "user_id",
        F.col("day").alias("prev_day"),
        F.col("chunk_no").alias("j"),
        F.col("text").alias("column_text"),
    )
    grid = _without_equal_head(grid, rows, columns, block_chars)
    apart = F.abs(F.col("chars") - F.col("prev_chars"))
    open_ = cut(grid.withColumn("reach", F.greatest(apart, F.lit(band).cast("long"))))
    found = pairs.filter(empty).select(*DAY, F.lit(0.0).alias("five_cmd_match"))
    while not open_.isEmpty():
        corners = _sweep(open_, rows, columns, block_chars)
        met = cut(open_.join(corners, DAY))
        final = (F.col("distance") <= F.col("reach")) | (F.col("reach") >= F.greatest("chars", "prev_chars"))
        alike = similarity_of(F.col("distance"), F.col("chars"), F.col("prev_chars")).alias("five_cmd_match")
        found = found.unionByName(met.filter(final).select(*DAY, alike))
        open_ = cut(met.filter(~final).drop("distance").withColumn("reach", F.col("reach") * WIDEN))
    return found


def _without_equal_head(grid: DataFrame, rows: DataFrame, columns: DataFrame, block_chars: int) -> DataFrame:
    """The pairs with ``head``, the number of equal leading blocks (the last one stays), and n_rows and
    n_columns without those."""
    digest = lambda t, text: t.withColumn("digest", F.sha2(text, 256)).drop(text)
    left = digest(rows, "row_text").withColumnRenamed("digest", "own")
    right = digest(columns, "column_text").withColumnRenamed("j", "i")
    both = grid.select(*DAY, "prev_day").join(left, DAY).join(right, ["user_id", "prev_day", "i"])
    unlike = both.filter(F.col("own") != F.col("digest")).groupBy(*DAY).agg(F.min("i").alias("unlike"))
    fewer = F.least("n_rows", "n_columns") - 1
    met = grid.join(unlike, DAY, "left").withColumn("head", F.least(F.coalesce("unlike", fewer), fewer))
    return met.drop("unlike").withColumns(
        {"n_rows": F.col("n_rows") - F.col("head"), "n_columns": F.col("n_columns") - F.col("head")}
    )


def _sweep(grid: DataFrame, rows: DataFrame, columns: DataFrame, block_chars: int) -> DataFrame:
    """(user_id, day, distance): the last corner of every pair's table, from the tiles inside the pair's band.

    Works through the anti-diagonals of all pairs; one table of edges for each.
    """
    spark = grid.sparkSession
    path = scratch_path(spark, "day-similarity")
    width = 2 * block_chars * F.least("n_rows", "n_columns")
    size = grid.agg(
        F.max(F.col("n_rows") + F.col("n_columns") - 1).alias("diagonals"),
        F.sum(F.least(F.col("chars") + F.col("prev_chars"), width)).alias("work"),
    ).first()
    # dealt out evenly over a set number of tasks: tiles are small data but long work, so they
    # must not be packed together by their size
    partitions = _tasks(size.work, block_chars, spark.sparkContext.defaultParallelism)
    off = F.floor(F.col("reach") / block_chars) + 1
    for d in range(size.diagonals):
        low = F.greatest(F.lit(0).cast("long"), d - F.col("n_columns") + 1, F.ceil((d - off) / 2))
        high = F.least(F.lit(d).cast("long"), F.col("n_rows") - 1, F.floor((d + off) / 2))
        here = (
            grid.withColumns({"low": low, "high": high})
            .filter(F.col("low") <= F.col("high"))
            .withColumn("i", F.explode(F.sequence("low", "high")))
            .withColumn("j", d - F.col("i"))
            .withColumns({"row_no": F.col("i") + F.col("head"), "column_no": F.col("j") + F.col("head")})
            .join(rows.withColumnRenamed("i", "row_no"), [*DAY, "row_no"])
            .join(columns.withColumnRenamed("j", "column_no"), ["user_id", "prev_day", "column_no"])
        )
        if d == 0:
            here = here.withColumns({"right": F.lit(None).cast(_EDGE), "bottom": F.lit(None).cast(_EDGE)})
        else:
            done = spark.read.schema(_EDGES).parquet(f"{path}/d={d - 1}")
            here = here.join(done.select(*DAY, "i", "right"), [*DAY, "i"], "left")
            here = here.join(done.select(*DAY, "j", "bottom"), [*DAY, "j"], "left")
        tiles = here.select(
            *DAY, "i", "j", "reach", F.lit(block_chars).alias("side"), "row_text", "column_text", "right", "bottom"
        )
        tiles.repartition(partitions).mapInArrow(_solve, _EDGES).write.parquet(f"{path}/d={d}")
    solved = spark.read.schema(_EDGES).parquet(*(f"{path}/d={d}" for d in range(size.diagonals)))
    last = solved.join(grid.select(*DAY, "n_rows", "n_columns"), DAY)
    last = last.filter((F.col("i") == F.col("n_rows") - 1) & (F.col("j") == F.col("n_columns") - 1))
    return last.select(*DAY, F.col("corner").alias("distance"))


def _tasks(work: int, block_chars: int, cores: int) -> int:
    """Tasks for so many characters: a character takes about as long in small tiles as in large ones, so small tiles
    only make more tasks until all cores have one."""
    return max(1 + work // _TASK_CHARS, min(cores, 1 + work // (16 * block_chars)))


_EDGE = "array<struct<at:bigint,steps:binary>>"
_EDGES = f"user_id bigint, day date, i bigint, j bigint, corner bigint, right {_EDGE}, bottom {_EDGE}"
_LISTED = pa.list_(pa.struct([("at", pa.int64()), ("steps", pa.binary())]))


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One tile per row; edges that are missing are the border of the whole table."""
    kinds = {"i": pa.int64(), "j": pa.int64(), "corner": pa.int64(), "right": _LISTED, "bottom": _LISTED}
    for batch in batches:
        schema = pa.schema([batch.schema.field("user_id"), batch.schema.field("day"), *kinds.items()])
        for n in range(0, batch.num_rows, _AT_A_TIME):
            solved = [_tile(r) for r in batch.slice(n, _AT_A_TIME).to_pylist()]
            yield pa.RecordBatch.from_pylist(solved, schema)


def _tile(r: dict) -> dict:
    left = r["right"] and [e and (e["at"], unpack(e["steps"])) for e in r["right"]]
    top = r["bottom"] and [e and (e["at"], e["steps"]) for e in r["bottom"]]
    rows, columns, side = r["row_text"], r["column_text"], min(SIDE, r["side"])
    right, bottom, corner = tile(rows, columns, left, top, r["i"] * r["side"], r["j"] * r["side"], r["reach"], side)
    heights = [len(rows[k : k + side]) for k in range(0, len(rows), side)]
    out = {"user_id": r["user_id"], "day": r["day"], "i": r["i"], "j": r["j"], "corner": corner}
    out["right"] = [e and {"at": e[0], "steps": pack(e[1], h)} for e, h in zip(right, heights)]
    out["bottom"] = [e and {"at": e[0], "steps": e[1]} for e in bottom]
    return out
