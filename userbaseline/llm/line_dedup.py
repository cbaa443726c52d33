"""Lines that many documents share are dropped from all of them; DataFrame operations only.

Texts are split at ``\\n``; a line's key is the line without ``\\x20 \\x09-\\x0D`` at its ends and
with A-Z folded. Lines are exploded, their keys hashed to 128 bits and counted by documents;
keys of at least ``min_chars`` code points found in at least ``min_documents`` documents lose
all their lines. The rest is put together again by position.

Only hashes, ids and positions are shuffled for counting and matching, never lines. Rows that share a ``doc_id``
count as one document, and rows without one are not counted, as in SQL's count(DISTINCT doc_id). The key for
matching is a hash of id and text, so a row that is repeated gets the same answer, and groups of equal texts
spread by their ids. A null or empty text is one empty line.
Other columns pass through unchanged, except that n_lines and n_dropped are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from userbaseline.session import cut

BLANKS = " \t\n\x0b\x0c\r"
UPPER, FOLDED = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case and nothing else changed; ``translate`` only where ``lower`` could do more."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).when(~text.rlike("[A-Z]"), text).otherwise(F.translate(text, UPPER, FOLDED))


def line_key(line: Column) -> Column:
    return folded(F.btrim(line, F.lit(BLANKS)))


def _hashes(*columns: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *columns) for seed in (1, 2)]


def _text() -> Column:
    return F.coalesce("text", F.lit(""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _named(hashes: list[Column], prefix: str) -> list[Column]:
    return [h.alias(f"{prefix}{i}") for i, h in enumerate(hashes, 1)]


def frequent_keys(docs: DataFrame, min_documents: int, min_chars: int) -> DataFrame:
    """(k1, k2): hashes of the keys that at least ``min_documents`` documents (distinct ids) hold."""
    # distinct by key and id first: a key of very many documents is spread by their ids
    once = docs.select("doc_id", F.explode(F.array_distinct(F.transform(_lines(_text()), line_key))).alias("key"))
    long = once.filter(F.char_length("key") >= min_chars)
    each = long.filter("doc_id is not null").select("doc_id", *_named(_hashes(F.col("key")), "k")).distinct()
    counted = each.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= min_documents).select("k1", "k2")


def drop_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with ``text`` reduced to the kept lines, plus n_lines (before) and n_dropped.

    A text without dropped lines stays as it is, a null one too.
    """
    row = _hashes(F.col("doc_id"), _text())
    exploded = docs.select(*_named(row, "r"), F.posexplode(_lines(_text())).alias("pos", "line"))
    keyed = exploded.select("r1", "r2", "pos", line_key(F.col("line")).alias("key"))
    keyed = keyed.filter(F.char_length("key") >= min_chars).select("r1", "r2", "pos", *_named(_hashes(F.col("key")), "k"))
    # as a table of its own it meets the lines in a plain join, whose hot keys Spark can split
    frequent = cut(frequent_keys(docs, min_documents, min_chars))
    gone = keyed.join(frequent, ["k1", "k2"], "left_semi").groupBy("r1", "r2").agg(F.collect_set("pos").alias("gone"))

    packed = docs.select(F.struct("*").alias("doc"), *_named(row, "r"))
    # positions are few beside the texts: hashed in their partition, so that no task sorts whole documents
    met = packed.join(gone.hint("shuffle_hash"), ["r1", "r2"], "left").select("doc", "gone", _lines(F.coalesce("doc.text", F.lit(""))).alias("lines"))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone")
    met = met.select("doc", "gone", "lines", left.alias("left"))
    text = F.when(F.col("gone").isNull(), F.col("doc.text")).otherwise(
        F.array_join(F.transform("left", lambda i: F.get("lines", i)), "\n")
    )
    held = [text.alias(c) if c.lower() == "text" else F.col("doc").getField(c).alias(c)
            for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return met.select(
        *held,
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
