"""Removal of paragraphs that other documents (or the same one) hold already, exactly or nearly, and of
passages that repeat word by word inside longer lines or over several short ones.

Paragraphs are the ``\\n``-split lines of a text with at least ``min_words`` words. Their sets of
distinct 5-word shingles (A-Z folded) get MinHash signatures of ``BANDS`` x ``ROWS`` values; paragraphs
that agree in a band are joined, verified by exact Jaccard similarity of at least 0.75 and linked;
of each component the first paragraph (by document, then position) stays and the others are removed.
With 20 bands of 4 rows a pair at similarity 0.75 is missed with probability
(1 - 0.75**4)**20 = 0.0005, one at 0.85 with 1e-6; equal paragraphs are never missed.

Passages are runs of ``PASSAGE`` or more words (A-Z folded, whatever blanks stand between) outside the removed
paragraphs that occur earlier, by document and position, outside them too; the first occurrence stays. All are
found: each window of ``PASSAGE`` words has as its key the least hash of the ``UNIT``-word windows in it, so equal
windows have equal keys. Keys are few, as neighbouring windows share them; only windows whose key occurs twice
are compared, by hashes of 128 bits.

Null and empty texts have no paragraphs. A document is known by its ``doc_id`` and a hash of its text,
``text_hash``: rows that share an id, or have none, with different texts are documents of their own, and
only rows equal in both are one. A null ``doc_id`` sorts last. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from userbaseline.llm import wordhash as wh
from userbaseline.llm.links import bit_sketches, broadcast_if_small, linked_components
from userbaseline.session import cut, ship

BANDS, ROWS = 20, 4
MIN_WORDS = 20
K = 5
#: words of the shortest passage, and of the windows whose least hash is its key
PASSAGE, UNIT = 50, 20
FETCH_BY_BROADCAST = 500_000

DOC = ["doc_id", "text_hash"]


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_hash().alias("text_hash"))


def text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left.doc_id.eqNullSafe(right.doc_id) & (left.text_hash == right.text_hash)


_seeds = wh.mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _paragraphs(batches: Iterator[pa.RecordBatch], min_words: int):
    """For each slice: ids and text hashes, document and line number, first and end byte, words, shingles and owners."""
    for batch in batches:
        for row, end, data, offsets in wh.slices(batch.column(1)):
            bounds, doc = wh.lines(data, offsets)
            word = wh.words(data, bounds, wh.LOWER)
            held = np.bincount(word.unit, minlength=len(doc))
            number = np.arange(len(doc)) - np.searchsorted(doc, doc)
            keep = held >= min_words
            new = np.cumsum(keep) - 1
            chosen = keep[word.unit]
            part = wh.Words(word.hash[chosen], word.start[chosen], word.end[chosen], new[word.unit[chosen]])
            found, owner = wh.distinct(*wh.windows(part, K, int(keep.sum())))
            lines = np.flatnonzero(keep)
            ids = [batch.column(c).slice(row, end - row) for c in (0, 2)]
            yield ids, doc[lines], number[lines], held[lines], found, owner


def minhash_bands(found: np.ndarray, owner: np.ndarray, units: int) -> np.ndarray:
    """The band keys of every unit, one row of ``BANDS`` values for each; every unit has an element."""
    first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, np.int64)
    keys = np.zeros((units, BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(units, b + 1, np.uint64)
        for seed in _seeds[b * ROWS : (b + 1) * ROWS]:
            # a multiply-xorshift family: odd multiplier, then the high half folded in
            h = (found ^ seed) * (seed | np.uint64(1))
            h ^= h >> np.uint64(32)
            key = wh.mix(key * np.uint64(0x9E3779B97F4A7C55) + np.minimum.reduceat(h, first))
        keys[:, b] = key
    return keys


def _occurrences(min_words: int):
    schema = "doc_id long, text_hash long, paragraph long, n_words long, n long, c1 long, c2 long, bands array<long>, sketch array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for ids, doc, number, held, found, owner in _paragraphs(batches, min_words):
            units = len(doc)
            if not units:
                continue
            one, two = wh.set_digests(found, owner, units)
            fresh = np.zeros(units, bool)  # copies give their bands once in a task
            for u, c in enumerate(one.tolist()):
                if c not in seen:
                    seen.add(c)
                    fresh[u] = True
            place = np.cumsum(fresh) - 1
            chosen = fresh[owner]
            few = int(fresh.sum())
            bands = minhash_bands(found[chosen], place[owner[chosen]], few) if few else np.zeros((0, BANDS), np.uint64)
            ends = np.append(0, np.cumsum(fresh) * BANDS).astype(np.int32)
            size = np.bincount(owner, minlength=units).astype(np.int64)
            parity, bounds = bit_sketches(found[chosen], owner[chosen], np.where(fresh, size, 0))
            yield pa.RecordBatch.from_arrays(
                [
                    *(c.take(pa.array(doc)).cast(pa.int64()) for c in ids),
                    pa.array(number.astype(np.int64)),
                    pa.array(held.astype(np.int64)),
                    pa.array(size),
                    wh.signed(one),
                    wh.signed(two),
                    pa.ListArray.from_arrays(pa.array(ends), wh.signed(bands.ravel())),
                    pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), wh.signed(parity)),
                ],
                [*DOC, "paragraph", "n_words", "n", "c1", "c2", "bands", "sketch"],
            )

    return run, schema


def _set_rows(min_words: int):
    schema = "node long, items array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, doc, _, _, found, owner in _paragraphs(batches, min_words):
            units = len(doc)
            one, _ = wh.set_digests(found, owner, units)
            ends = np.searchsorted(owner, np.arange(units + 1)).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), wh.signed(found))
            yield pa.RecordBatch.from_arrays([wh.signed(one), items], ["node", "items"])

    return run, schema


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, share: int = 75) -> DataFrame:
    """One row for each removed paragraph: doc_id, text_hash, paragraph (line number from 0), n_words, and the
    paragraph that stays, kept_doc_id and kept_paragraph, with n_members of its component."""
    ship(docs.sparkSession)
    docs = _documents(docs)
    found = cut(docs.mapInArrow(*_occurrences(min_words)))
    buckets = found.select(F.explode("bands").alias("sig"), F.col("c1").alias("node"), "n")

    def sets_of(needed: DataFrame) -> DataFrame:
        ids = found.join(needed, found.c1 == needed.node, "left_semi").groupBy("c1").agg(F.min("doc_id").alias("first_id"))
        ids = broadcast_if_small(cut(ids.select("first_id").distinct()), FETCH_BY_BROADCAST)
        wanted = docs.join(ids, docs.doc_id.eqNullSafe(ids.first_id), "left_semi")
        return wanted.mapInArrow(*_set_rows(min_words))

    sketches = found.filter(F.size("sketch") > 0).select(F.col("c1").alias("node"), "sketch")
    labels = linked_components(buckets, sketches, sets_of, share)
    # equal sets are one class whether or not they link with another
    placed = F.struct(F.col("doc_id").isNull().alias("last"), *DOC, "paragraph")
    classes = found.groupBy(F.col("c1").alias("node")).agg(F.min(placed).alias("first"), F.count("*").alias("k"))
    labelled = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    labelled = cut(labelled)
    kept = labelled.groupBy("root").agg(F.min("first").alias("kept"), F.sum("k").alias("n_members"))
    kept = labelled.select("node", "root").join(kept.filter("n_members > 1"), "root")
    met = found.select(*DOC, "paragraph", "n_words", F.col("c1").alias("node")).join(kept, "node")
    stays = F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("text_hash") == F.col("kept.text_hash"))
    return met.filter(~(stays & (F.col("paragraph") == F.col("kept.paragraph")))).select(
        *DOC, "paragraph", "n_words",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.paragraph").alias("kept_paragraph"), "n_members",
    ).distinct()


def remove_paragraphs(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """``docs`` with the paragraphs of ``removed`` taken out of their texts; nulls stay null."""
    none = F.lit(None).cast("long")
    return remove_repeats(docs, removed.select(*DOC, "paragraph", none.alias("start"), none.alias("end")))


def _sliding(ufunc: np.ufunc, values: np.ndarray, width: int) -> np.ndarray:
    """``ufunc`` (minimum or maximum) over every ``width`` neighbouring values."""
    if len(values) < width:
        return values[:0]
    size, out = 1, values
    while 2 * size <= width:
        out = ufunc(out[:-size], out[size:])
        size *= 2
    return ufunc(out[: len(values) - width + 1], out[width - size :])


class _Texts:
    """Words of the whole texts of a slice, their lines, and the keys of their windows of ``PASSAGE`` words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.word = word = wh.words(data, offsets, wh.LOWER)
        breaks = np.flatnonzero(data == 0x0A)
        self.line = np.searchsorted(breaks, word.start) - np.searchsorted(breaks, offsets[:-1])[word.unit]
        n, wide = len(word.hash), PASSAGE - UNIT + 1
        none = np.zeros(0, np.uint64)
        factors = wh.powers(UNIT + 1)
        units = sum((word.hash[j : n - UNIT + 1 + j] * factors[j + 1] for j in range(UNIT)), np.uint64(0)) if n >= UNIT else none
        #: hashes of the windows of UNIT words from each word, also over the ends of texts
        self.units = wh.mix(units) if len(units) else none
        self.keys = _sliding(np.minimum, self.units, wide)
        self.inside = word.unit[: len(self.keys)] == word.unit[PASSAGE - 1 :] if len(self.keys) else np.zeros(0, bool)

    def chosen(self) -> np.ndarray:
        """First words of the windows of ``UNIT`` words that are the least of a window of ``PASSAGE``."""
        if not len(self.keys):
            return np.zeros(0, np.int64)
        wide = PASSAGE - UNIT + 1
        # no key is over a hash that it covers: the largest one around equals it if one chose it
        edge = np.zeros(wide - 1, np.uint64)
        held = np.concatenate([edge, np.where(self.inside, self.keys, np.uint64(0)), edge])
        return np.flatnonzero(_sliding(np.maximum, held, wide) == self.units)


def _key_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in wh.slices(batch.column(1)):
            texts = _Texts(data, offsets)
            at = texts.chosen()
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, end - row).take(pa.array(texts.word.unit[at])).cast(pa.int64()),
                        batch.column(2).slice(row, end - row).take(pa.array(texts.word.unit[at])),
                        wh.signed(texts.units[at]),
                        pa.array(texts.line[at].astype(np.int32)),
                        pa.array(texts.line[at + UNIT - 1].astype(np.int32)),
                    ],
                    [*DOC, "key", "line", "to_line"],
                )


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, end, data, offsets in wh.slices(batch.column(1)):
            texts = _Texts(data, offsets)
            if not len(texts.keys):
                continue
            word, wanted = texts.word, texts.inside.copy()
            gone = np.zeros(len(word.hash), bool)
            bounds = np.searchsorted(word.unit, np.arange(end - row + 1))
            for u in range(end - row):
                keys = batch.column(3)[row + u].values.to_numpy(zero_copy_only=False).view(np.uint64)
                here = slice(bounds[u], min(bounds[u + 1], len(wanted)))
                wanted[here] &= np.isin(texts.keys[here], keys)
                lines = batch.column(4)[row + u].values
                if lines is not None and len(lines):
                    here = slice(bounds[u], bounds[u + 1])
                    gone[here] = np.isin(texts.line[here], lines.to_numpy(zero_copy_only=False))
            missing = np.append(0, np.cumsum(gone))
            at = np.flatnonzero(wanted & (missing[PASSAGE:] == missing[:-PASSAGE]))
            if not len(at):
                continue
            hashes, factors = [], wh.powers(PASSAGE + 1)
            for seed in (np.uint64(0), _seeds[0]):
                each = wh.mix(word.hash ^ seed)
                total = np.zeros(len(at), np.uint64)
                for j in range(PASSAGE):
                    total += each[at + j] * factors[j + 1]
                hashes.append(wh.signed(wh.mix(total)))
            unit = word.unit[at]
            points = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(row, end - row).take(pa.array(unit)).cast(pa.int64()),
                    batch.column(2).slice(row, end - row).take(pa.array(unit)),
                    pa.array(at - bounds[unit]),
                    pa.array(points[word.start[at]] - points[offsets[unit]]),
                    pa.array(points[word.end[at + PASSAGE - 1]] - points[offsets[unit]]),
                    *hashes,
                ],
                [*DOC, "at", "start", "end", "h1", "h2"],
            )


def repeated_passages(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """One row for each run of words outside the paragraphs of ``removed`` whose every window of ``PASSAGE``
    words occurs first in one document: doc_id, text_hash, start and end (code points of the text), n_words,
    kept_doc_id and kept_start, where the run's first window stays, and n_members, how often that window occurs."""
    ship(docs.sparkSession)
    docs = _documents(docs)
    gone = cut(removed.groupBy(*DOC).agg(F.collect_set(F.col("paragraph").cast("int")).alias("gone")))
    keys = cut(docs.mapInArrow(_key_rows, "doc_id long, text_hash long, key long, line int, to_line int"))

    def shared(rows: DataFrame) -> DataFrame:
        twice = cut(rows.groupBy("key").agg(F.count("*").alias("k")).filter("k > 1").select("key"))
        return rows.join(twice, "key", "left_semi")

    some = shared(keys)
    met = some.join(gone, _same(some, gone), "left").select(some["*"], "gone")
    touched = F.exists("gone", lambda x: (x >= F.col("line")) & (x <= F.col("to_line")))
    left = cut(met.filter(F.col("gone").isNull() | ~touched).select(*DOC, "key"))
    wanted = shared(left).groupBy(*DOC).agg(F.collect_set("key").alias("keys"))
    wanted = cut(wanted.join(gone, _same(wanted, gone), "left").select(wanted["*"], "gone"))
    ids = broadcast_if_small(cut(wanted.select(*DOC)), FETCH_BY_BROADCAST)
    held = docs.join(ids, _same(docs, ids), "left_semi")
    held = held.join(wanted, _same(held, wanted)).select(held["*"], "keys", "gone")
    schema = "doc_id long, text_hash long, at long, start long, end long, h1 long, h2 long"
    windows = cut(held.mapInArrow(_window_rows, schema))

    place = F.struct(F.col("doc_id").isNull().alias("last"), *DOC, "at", "start")
    first = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n_members"))
    met = windows.join(cut(first.filter("n_members > 1")), ["h1", "h2"])
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    met = met.filter(~(stays & (F.col("at") == F.col("first.at")))).select(
        *DOC, "at", "start", "end", F.col("first.doc_id").alias("kept_doc_id"), F.col("first.text_hash").alias("kept_hash"),
        F.col("first.start").alias("kept_start"), "n_members",
    ).distinct()
    # windows that follow one another, of one document each time
    kept = [*DOC, "kept_doc_id", "kept_hash"]
    order = Window.partitionBy(*kept).orderBy("at")
    runs = met.withColumn("run", F.col("at") - F.dense_rank().over(order))
    begin = F.min(F.struct("at", "kept_start", "n_members")).alias("begin")
    runs = runs.groupBy(*kept, "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"),
        (F.max("at") - F.min("at") + PASSAGE).alias("n_words"), begin,
    )
    return runs.select(
        *DOC, "start", "end", "n_words", "kept_doc_id",
        F.col("begin.kept_start").alias("kept_start"), F.col("begin.n_members").alias("n_members"),
    )


def repeats(docs: DataFrame) -> DataFrame:
    """The rows of `repeated_paragraphs` and `repeated_passages` in one table: paragraph and kept_paragraph are
    null in rows of passages; start, end and kept_start in rows of paragraphs."""
    removed = cut(repeated_paragraphs(docs))
    return removed.unionByName(repeated_passages(docs, removed), allowMissingColumns=True)


def _without(text: str, starts: list[int], ends: list[int], gone: set[int]) -> str:
    """The text without these stretches, except for their line breaks, and then without the lines ``gone``."""
    if len(starts):
        out, at = [], 0
        for begin, end in sorted(zip(starts, ends)):
            begin, end = max(begin, at), max(end, at)
            out += text[at:begin], "\n" * text.count("\n", begin, end)
            at = end
        text = "".join([*out, text[at:]])
    if gone:
        text = "\n".join([line for i, line in enumerate(text.split("\n")) if i not in gone])
    return text


def remove_repeats(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` without the paragraphs and passages of ``found``, as `repeats` gives it. Line breaks inside a
    passage stay, so that lines keep their numbers. Only rows whose id and text are those found
    change; null texts stay null."""
    ship(docs.sparkSession)
    span = F.when(F.col("start").isNotNull(), F.struct("start", "end"))
    gone = found.groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"))
    gone = gone.agg(F.collect_set(span).alias("__spans"), F.collect_set("paragraph").alias("__lines"))

    @F.pandas_udf("string")
    def cut_out(text: pd.Series, starts: pd.Series, ends: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([_without(t, a, b, {*c}) for t, a, b, c in zip(text, starts, ends, lines)], dtype=object)

    met = docs.join(gone, docs.doc_id.eqNullSafe(F.col("__id")) & (text_hash() == F.col("__hash")), "left")
    found_here = F.col("__id").isNotNull() | F.col("__hash").isNotNull()
    none = lambda c: F.coalesce(c, F.array().cast("array<long>"))
    made = cut_out(F.coalesce("text", F.lit("")), none("__spans.start"), none("__spans.end"), none("__lines"))
    return met.withColumn("text", F.when(found_here & F.col("text").isNotNull(), made).otherwise(F.col("text"))).drop("__id", "__hash", "__spans", "__lines")
