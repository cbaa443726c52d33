"""Similarity join of documents by the Jaccard similarity of their word n-grams, with parity sketches.

A document's set is its distinct n-word shingles (A-Z folded; a text of fewer words is one shingle).
Its sketch deals the shingles over ``m`` segments and XORs the 64-bit codes of those that fall into
one, so a shingle in only one of two sets changes one segment at most: the number of segments in
which two sketches differ is a lower bound of the symmetric difference, which for linked sets of
sizes a and b is at most ``(whole - share) * (a + b) / (whole + share)`` =: d. By the pigeonhole
principle two linked sketches agree in ``m - d`` segments.

*Size bands* grow by the factor 4 and overlap so that every pair of linkable sizes stands in one band
together; ``m`` is twice (d + 1) of the band. Segments are put in a common order, segments of frequent
shingles last and empty ones at the very end, and each sketch is joined on its first ``d + 1``:
two lists that agree in m - d of m elements meet there. Frequent shingles are counted over all
documents by bounded counters; they decide the order only, never the result.

Pairs that collide are first compared by a bit sketch of two to four bits per element, into which each
shingle flips one bit: its Hamming distance is at most the symmetric difference, so a larger one
rules the pair out. The rest is verified on the exact sets (`links.linked_components`).

Nulls and texts without words have an empty set and link with nothing. Equal sets are one class, so
groups of copies cost as much as one text per task. A repeated row is a document of its own; a null
``doc_id`` takes part but never names a component unless no other id is there, in which case the
component is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.llm import wordhash as wh
from userbaseline.llm.links import bit_sketches, broadcast_if_small, linked_components
from userbaseline.session import cut, ship

#: shingles whose frequency enters the order of segments: at most this many, the most frequent ones
ORDERED_SHINGLES = 100_000
BAND = 4
FETCH_BY_BROADCAST = 500_000


def _bound(size: int, share: int, whole: int) -> int:
    """Largest symmetric difference of two linked sets with ``size`` elements together."""
    return (whole - share) * size // (whole + share)


def _documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    """(first row, ids, shingles, owners) of every slice of the batches."""
    for batch in batches:
        for row, end, data, offsets in wh.slices(batch.column(1)):
            word = wh.words(data, offsets, wh.LOWER)
            found, owner = wh.distinct(*wh.windows(word, k, end - row))
            yield batch.column(0).slice(row, end - row), found, owner


def _digest_rows(k: int):
    schema = "doc_id long, n long, c1 long, c2 long, sketch array<long>, frequent long, times long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = wh.Tally()
        none = lambda n: pa.nulls(n, pa.int64())

        def told(value, times):
            n = len(value)
            return pa.RecordBatch.from_arrays(
                [none(n), none(n), none(n), none(n), pa.nulls(n, pa.list_(pa.int64())), wh.signed(value),
                 pa.array(times.astype(np.int64))], names
            )

        names = ["doc_id", "n", "c1", "c2", "sketch", "frequent", "times"]
        seen: set[int] = set()
        for ids, found, owner in _sets(batches, k):
            units = len(ids)
            one, two = wh.set_digests(found, owner, units)
            n = np.bincount(owner, minlength=units).astype(np.int64)
            fresh = _first_seen(one, n, seen)
            chosen = fresh[owner]
            words, ends = bit_sketches(found[chosen], owner[chosen], np.where(fresh, n, 0))
            sketch = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), wh.signed(words))
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(n), wh.signed(one), wh.signed(two), sketch, none(units), none(units)],
                names,
            )
            for value, times in tally.add(found):
                yield told(value, times)
        yield told(*tally.flush())

    return run, schema


def _first_seen(digest: np.ndarray, n: np.ndarray, seen: set[int]) -> np.ndarray:
    """Which units hold a set that the task has not met before."""
    fresh = np.zeros(len(n), bool)
    for u in np.flatnonzero(n):
        c = int(digest[u])
        if c not in seen:
            seen.add(c)
            fresh[u] = True
    return fresh


def sketch_keys(
    found: np.ndarray, owner: np.ndarray, units: int, rank: np.ndarray, share: int, whole: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, unit) of the segments each unit's sketch is joined on, band by band.

    ``found`` is ascending within a unit; ``rank`` is how frequent each shingle is (0: not counted).
    """
    size = np.bincount(owner, minlength=units).astype(np.int64)
    band = 0
    while len(size) and (low := -(-share * BAND**band // whole)) <= size.max():
        top = BAND ** (band + 1) - 1
        here = (size >= low) & (size <= top)
        if here.any():
            m = 2 * (_bound(2 * top, share, whole) + 1)
            chosen = here[owner]
            code, unit, often = wh.mix(found[chosen] ^ np.uint64(band + 1)), owner[chosen], rank[chosen]
            segment = ((found[chosen] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
            new = np.append(True, (unit[1:] != unit[:-1]) | (segment[1:] != segment[:-1]))
            first = np.flatnonzero(new)
            value = np.bitwise_xor.reduceat(code, first)
            rarest = np.minimum.reduceat(often, first)
            unit, segment = unit[first], segment[first]
            key = wh.mix(value ^ wh.mix(segment + np.uint64(band) * np.uint64(1 << 40)))
            order = np.lexsort((key, rarest, unit))
            key, unit = key[order], unit[order]
            # a unit's place in the order; those beyond its filled segments are empty segments
            begin = np.searchsorted(unit, np.arange(units))
            place = np.arange(len(unit)) - begin[unit]
            largest = np.minimum(size * whole // share, top)
            need = np.minimum(m, (whole - share) * (size + largest) // (whole + share) + 1)
            kept = place < need[unit]
            yield key[kept], unit[kept]
            filled = np.bincount(unit, minlength=units)
            short = np.flatnonzero(here & (filled < need))
            if len(short):  # empty segments stand last, all in the same order
                for u in short:
                    used = np.zeros(m, bool)
                    used[segment[begin[u] : begin[u] + filled[u]].astype(np.int64)] = True
                    empty = np.flatnonzero(~used)[: need[u] - filled[u]].astype(np.uint64)
                    yield wh.mix(wh.mix(empty + np.uint64(band) * np.uint64(1 << 40)) ^ np.uint64(7)), np.full(len(empty), u)
        band += 1


def _bucket_rows(k: int, frequent, share: int, whole: int):
    schema = "sig long, node long, n long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, times = frequent.value
        seen: set[int] = set()
        for ids, found, owner in _sets(batches, k):
            units = len(ids)
            one, _ = wh.set_digests(found, owner, units)
            n = np.bincount(owner, minlength=units).astype(np.int64)
            # copies of a set give their keys once in a task
            chosen = _first_seen(one, n, seen)[owner]
            found, owner = found[chosen], owner[chosen]
            rank = np.zeros(len(found), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                hit = known[at] == found
                rank[hit] = times[at[hit]]
            for key, unit in sketch_keys(found, owner, units, rank, share, whole):
                yield pa.RecordBatch.from_arrays(
                    [wh.signed(key), wh.signed(one[unit]), pa.array(n[unit])], ["sig", "node", "n"]
                )

    return run, schema


def _set_rows(k: int):
    schema = "node long, items array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, found, owner in _sets(batches, k):
            units = len(ids)
            one, _ = wh.set_digests(found, owner, units)
            ends = np.searchsorted(owner, np.arange(units + 1)).astype(np.int32)
            items = pa.ListArray.from_arrays(pa.array(ends), wh.signed(found))
            yield pa.RecordBatch.from_arrays([wh.signed(one), items], ["node", "items"])

    return run, schema


def jaccard_components(docs: DataFrame, k: int = 5, share: int = 75, whole: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), n_copies (rows with the same set)."""
    if not 0 < share <= whole or BAND * share < whole:
        raise ValueError("share / whole must lie in (1/4, 1]")
    spark = docs.sparkSession
    ship(spark)
    docs = _documents(docs)
    made = cut(docs.mapInArrow(*_digest_rows(k)))
    rows = made.filter("n is not null").select("doc_id", "n", "c1", "c2")
    often = made.filter("n is null").groupBy("frequent").agg(F.sum("times").alias("times"))
    often = often.orderBy(F.desc("times"), "frequent").limit(ORDERED_SHINGLES).toArrow()
    known = often.column(0).to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[order], often.column(1).to_numpy()[order]))

    # c1 names the set; a class's row is found again by its smallest id
    classes = rows.filter("n > 0").groupBy(F.col("c1").alias("node"), "c2", "n").agg(
        F.min("doc_id").alias("first_id"), F.count("*").alias("n_copies")
    )
    classes = cut(classes)

    def sets_of(needed: DataFrame) -> DataFrame:
        ids = cut(classes.join(needed, "node", "left_semi").select("first_id").distinct())
        ids = broadcast_if_small(ids, FETCH_BY_BROADCAST)
        wanted = docs.join(ids, docs.doc_id.eqNullSafe(ids.first_id), "left_semi")
        return wanted.mapInArrow(*_set_rows(k))

    buckets = docs.mapInArrow(*_bucket_rows(k, frequent, share, whole))
    sketches = made.filter(F.size("sketch") > 0).select(F.col("c1").alias("node"), "sketch")
    labels = linked_components(buckets, sketches, sets_of, share, whole)
    grouped = classes.join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = grouped.groupBy("root").agg(F.min("first_id").alias("component_id"))
    class_of = cut(grouped.join(named, "root").select("node", "c2", "component_id", "n_copies"))
    filled = rows.filter("n > 0").join(class_of, (rows.c1 == class_of.node) & (rows.c2 == class_of.c2))
    columns = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "n_copies"]
    empty = rows.filter("n = 0").select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies")
    )
    return filled.select(*columns).unionByName(empty)


def first_of_each(docs: DataFrame, k: int = 5, share: int = 75, whole: int = 100) -> DataFrame:
    """The rows of ``docs`` that stand for their component: those that bear its smallest id.

    Rows without an id stay; so do all rows of an id that names its component.
    """
    joined = jaccard_components(docs, k, share, whole)
    gone = joined.filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")
