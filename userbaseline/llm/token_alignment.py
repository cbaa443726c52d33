"""Alignment of two tokenizers' tokens by coalescing intervals, and counts of linked token pairs.

Tokenizer A is a byte-level BPE file and reads a space and the text, with special tokens as plain text; B is a
sentencepiece model and reads the text, to which it adds the space itself. A token's interval is the bytes it
covers. The tokens of a block of texts, of A and B together, are sorted by start; the running maximum
of their ends shows where a start reaches it, and there a new group begins. Inside a group the
latest A and the latest B token at each start overlap: these are the links. Since both cover the same
bytes without gaps, that gives each overlapping pair once.

Counts over the corpus. A block keeps its distinct pairs, how many of its texts hold each, and for each
pair the texts with their numbers of occurrences; it is written as one row. Pairs and numbers of texts are
summed over all blocks, each A id's highest count is found, both go back to the blocks by (block,
place of the pair), and each block sums up its own texts. So what is shuffled are the blocks' distinct
pairs, and neither texts nor single links.

Texts that are null or empty, or whose joined bytes of A or B differ from space and text (a normalised or
replaced character), have no tokens: zeros, and '' for the groups. Texts are used whole; a longer text is a
block of its own. A block is aligned a few texts at a time, and only their links are kept for the whole of it.
Null ids and repeated rows are rows like others and each counts as a document; other columns are ignored; an
empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.llm.pair_index_bpe import Codec, Vocabulary, portions
from userbaseline.session import cut, ship

#: characters of text in a block, and of the texts that are aligned together
BLOCK, PART = 2_000_000, 100_000


@dataclass
class Alignment:
    """Tokens, groups and links of a block of texts; ``*_doc`` is the place of the text in the block."""

    #: sorted tokens: side (0 is A), id, start and end in the bytes of all texts, group
    side: np.ndarray
    token: np.ndarray
    start: np.ndarray
    end: np.ndarray
    group: np.ndarray
    token_doc: np.ndarray
    #: linked ids, one entry for each pair of overlapping tokens
    link_a: np.ndarray
    link_b: np.ndarray
    link_doc: np.ndarray


def align(
    a_ids: np.ndarray, a_ends: np.ndarray, a_doc: np.ndarray, b_ids: np.ndarray, b_ends: np.ndarray, b_doc: np.ndarray
) -> Alignment:
    """Coalesce two gapless covers of the same bytes, given by the ends of their tokens."""
    side = np.repeat(np.array([0, 1]), [len(a_ids), len(b_ids)])
    end = np.concatenate([a_ends, b_ends])
    start = np.concatenate([np.append(0, a_ends[:-1])[: len(a_ends)], np.append(0, b_ends[:-1])[: len(b_ends)]])
    token, doc = np.concatenate([a_ids, b_ids]), np.concatenate([a_doc, b_doc])
    order = np.lexsort((side, start))
    side, start, end, token, doc = side[order], start[order], end[order], token[order], doc[order]
    reach = np.maximum.accumulate(end)
    opens = np.append(True, start[1:] >= reach[:-1])[: len(start)]
    here = np.arange(len(start))
    latest = [np.maximum.accumulate(np.where(side == s, here, -1)) for s in (0, 1)]
    last = np.append(start[1:] != start[:-1], True)[: len(start)]
    a, b = latest[0][last], latest[1][last]
    return Alignment(side, token, start, end, np.cumsum(opens) - 1, doc, token[a], token[b], doc[a])


class Aligner:
    """Both tokenizers and the tables of their tokens' bytes."""

    def __init__(self, a_file: bytes, b_model: bytes):
        self.a = Codec(Vocabulary(a_file), special=False)
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        self.a_bytes = self.a.v.bytes_of
        pieces = [(i, self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in pieces]
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        # decimal ids with each of the signs that may follow, A's ids first
        self.wide = len(self.a_bytes)
        ids = [*range(self.wide), *range(len(self.b_bytes))]
        self.shown = np.array([f"{i}{sign}" for sign in (",", "|", ";", "") for i in ids], object)
        self.kinds = len(ids)

    def parts(self, texts: Sequence[str]) -> Iterator[tuple[int, Alignment, np.ndarray, np.ndarray]]:
        """Some texts at a time: the place of the first one, their alignment, and how many tokens of A and B each has."""
        a_ids, a_counts = self.a.encode([" " + t for t in texts])
        a_ends = np.append(0, np.cumsum(a_counts))
        first = 0
        while first < len(texts):
            to, held = first + 1, len(texts[first])
            while to < len(texts) and held + len(texts[to]) <= PART:
                held += len(texts[to])
                to += 1
            yield first, *self.aligned(texts[first:to], a_ids[a_ends[first] : a_ends[to]], a_counts[first:to])
            first = to

    def aligned(self, texts: Sequence[str], a_ids: np.ndarray, a_counts: np.ndarray) -> tuple[Alignment, np.ndarray, np.ndarray]:
        """The alignment of some texts, given their tokens of A, and how many tokens of A and B each has."""
        whole = [(" " + t).encode() for t in texts]
        b_lists = self.b.encode(list(texts), num_threads=1)
        b_counts = np.array([len(x) for x in b_lists], np.int64)
        a_ends = np.cumsum(a_counts)
        spelled, table = self.a.token_bytes, self.b_bytes
        same = np.zeros(len(texts), bool)
        for i, data in enumerate(whole):
            if len(data) > 1:
                own = a_ids[a_ends[i] - a_counts[i] : a_ends[i]]
                same[i] = b"".join([table[x] for x in b_lists[i]]) == data and spelled(own) == data
        a_doc, b_doc = (np.repeat(np.arange(len(texts)), n) for n in (a_counts, b_counts))
        b_ids = np.fromiter(chain.from_iterable(b_lists), np.int32, int(b_counts.sum()))
        held_a, held_b = same[a_doc], same[b_doc]
        a_ids, a_doc, b_ids, b_doc = a_ids[held_a], a_doc[held_a], b_ids[held_b], b_doc[held_b]
        made = align(a_ids, np.cumsum(self.a_sizes[a_ids]), a_doc, b_ids, np.cumsum(self.b_sizes[b_ids]), b_doc)
        return made, np.where(same, a_counts, 0), np.where(same, b_counts, 0)

    def shown_groups(self, made: Alignment, n: int) -> list[str]:
        """``a1,a2|b1;a3|b2`` of each text: the ids of each group, A's before B's."""
        order = np.lexsort((made.start, made.side, made.group))
        side, group, doc = made.side[order], made.group[order], made.token_doc[order]
        sign = np.full(len(order), 3)
        if len(order) > 1:
            next_ = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
            sign[:-1] = np.where(doc[1:] != doc[:-1], 3, next_)
        parts = self.shown[sign * self.kinds + side * self.wide + made.token[order]].tolist()
        ends = np.cumsum(np.bincount(doc, minlength=n)).tolist()
        return ["".join(parts[a:b]) for a, b in zip([0, *ends], ends)]


class Shared:
    """Both tokenizer files as they are sent with the job, with the worker's aligner."""

    def __init__(self, a_file: bytes, b_model: bytes):
        self.files, self.made = (a_file, b_model), None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def aligner(self) -> Aligner:
        if self.made is None:
            pa.default_memory_pool().release_unused()
            self.made = Aligner(*self.files)
        return self.made


_BLOCK_ROW = (
    "block long, doc_ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "groups_sha256 array<string>, pairs array<long>, held_by array<int>, holders array<int>, times array<int>"
)


def _shared(docs: DataFrame, a_path: str, b_path: str):
    ship(docs.sparkSession)
    with open(a_path, "rb") as a, open(b_path, "rb") as b:
        return docs.sparkSession.sparkContext.broadcast(Shared(a.read(), b.read()))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))


def blocks(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """One row for each block of texts: what its texts count, its distinct pairs (as A id · 2³² + B id) with
    the number of texts that hold each, and, pair by pair, those texts and how often they hold it."""
    shared = _shared(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, part = shared.value.aligner(), TaskContext.get().partitionId()
        for k, (doc_ids, texts) in enumerate(portions(batches, block)):
            n, kinds = len(texts), len(aligner.b_bytes)
            n_a, n_b, n_groups, n_links = np.zeros((4, n), np.int64)
            hashes, keys = [], []
            for first, made, of_a, of_b in aligner.parts(texts):
                m = len(of_a)
                own = slice(first, first + m)
                opens = np.append(True, made.group[1:] != made.group[:-1])[: len(made.group)]
                n_a[own], n_b[own] = of_a, of_b
                n_groups[own], n_links[own] = (np.bincount(docs, minlength=m) for docs in (made.token_doc[opens], made.link_doc))
                hashes += [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in aligner.shown_groups(made, m)]
                keys.append((made.link_a.astype(np.int64) * kinds + made.link_b) * n + made.link_doc + first)
            # pairs, texts of each pair and occurrences in each text by one sort
            keys = np.concatenate(keys)
            keys.sort()
            at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            times, keys = np.diff(np.append(at, len(keys))), keys[at]
            pair, holder = np.divmod(keys, n)
            at = np.flatnonzero(np.append(True, pair[1:] != pair[:-1])[: len(pair)])
            held_by, pair = np.diff(np.append(at, len(pair))), pair[at]
            columns = [
                doc_ids, n_a, n_b, n_groups, n_links, hashes,
                pair // kinds << 32 | pair % kinds, held_by.astype(np.int32), holder.astype(np.int32), times.astype(np.int32),
            ]
            kinds_of = [pa.int64()] * 5 + [pa.string(), pa.int64()] + [pa.int32()] * 3
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), pa.array(c, t)) for c, t in zip(columns, kinds_of)]
            names = [x.split()[0] for x in _BLOCK_ROW.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([part << 32 | k], pa.int64()), *lists], names)

    return _texts(docs).mapInArrow(run, _BLOCK_ROW)


def pair_counts(written: DataFrame) -> DataFrame:
    """(a, b, n_docs, best): how many documents hold the ids linked, and whether no B id is linked with a in
    more documents."""
    pair = F.explode(F.arrays_zip("pairs", "held_by")).alias("p")
    counted = written.select(pair).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.held_by").alias("n_docs"))
    counted = counted.withColumns({"a": F.shiftright("pair", 32), "b": F.col("pair").bitwiseAND(0xFFFFFFFF)})
    most = counted.groupBy("a").agg(F.max("n_docs").alias("most"))
    return counted.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    written = cut(blocks(docs, a_path, b_path, block))
    counts = cut(pair_counts(written)).withColumn("pair", F.shiftleft("a", 32).bitwiseOR(F.col("b"))).drop("a", "b")
    places = written.select("block", F.posexplode("pairs").alias("place", "pair"))
    # the sign of a count says whether it is its A id's highest
    signed = F.when(F.col("best"), F.col("n_docs")).otherwise(-F.col("n_docs"))
    found = places.join(counts, "pair").select("block", F.struct("place", signed.alias("n")).alias("entry"))
    back = found.groupBy("block").agg(F.array_sort(F.collect_list("entry")).alias("entries"))
    met = written.drop("pairs").join(back.select("block", F.col("entries.n").alias("counts")), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                listed = {name: row.column(name)[0].values for name in row.schema.names if name != "block"}
                n = len(listed["doc_ids"])
                best, sums = np.zeros(n, np.int64), np.zeros(n, np.int64)
                if listed["counts"] is not None:
                    counts = np.repeat(listed["counts"].to_numpy(), listed["held_by"].to_numpy())
                    holders, times = listed["holders"].to_numpy(), listed["times"].to_numpy().astype(np.int64)
                    np.add.at(best, holders, np.where(counts > 0, times, 0))
                    np.add.at(sums, holders, np.abs(counts) * times)
                kept = [listed[c] for c in ("doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")]
                names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(best), pa.array(sums)], names)

    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    names = ["doc_ids", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "held_by", "holders", "times", "counts"]
    return met.select("block", *names).mapInArrow(run, schema)


def groups(docs: DataFrame, a_path: str, b_path: str, block: int = BLOCK) -> DataFrame:
    """(doc_id, groups): the groups themselves, as ``a1,a2|b1;a3|b2``."""
    shared = _shared(docs, a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = shared.value.aligner()
        for doc_ids, texts in portions(batches, block):
            shown = [g for _, made, of_a, _ in aligner.parts(texts) for g in aligner.shown_groups(made, len(of_a))]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(shown, pa.string())], ["doc_id", "groups"])

    return _texts(docs).mapInArrow(run, "doc_id long, groups string")
