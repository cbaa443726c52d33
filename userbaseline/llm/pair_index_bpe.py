"""Byte-level BPE by an index of pair occurrences, with the vocabulary of a tokenizer file.

Encoding. The texts of a partition are taken in portions of bounded size. Special tokens are cut out of a
text first, the rest is cut into pieces by the pattern, and pieces are numbered as they are first met.
The portion's new pieces lie side by side in one array of symbols, linked to their neighbours. An
index maps the rank of each mergeable pair to all positions of it. The active ranks are applied in ascending
order; a rank merges all its positions at once, from left to right where they overlap, and only
the lists of the pairs that touch a merged place change: entries that no longer hold are
passed over when their rank comes up, new neighbours are entered. A pair that a merge makes may have a
rank of any size; the least active one is always next, so each piece goes through the same merges as
if it were encoded alone. Ids of a text are put together from those of its pieces.

Decoding. Bytes of tokens are put together and read as UTF-8; a wrong sequence gives U+FFFD.

Texts are encoded whole. A null text is an empty one, which has no tokens. Repeated rows and null ids are
rows like others, other columns are ignored, an empty table gives an empty one. A portion holds
`PORTION` characters of text or one longer text; memory grows by about 40 bytes for each byte of its new
pieces, so with one very long word. Numbers of pieces are kept up to `PIECES` and then start anew,
which costs time only. Letters and numbers are those of the installed `regex` package; other releases of
Unicode may class a newly assigned character differently. The driver reads the file and sends it with the job.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.session import ship

#: characters of text that are worked on together, and pieces whose ids are kept
PORTION, PIECES = 24_000_000, 600_000
#: Fixed value: the pattern of byte-level tokenizer files; \s has the white space of Unicode
WHITE = r"\t-\r\x20\x85\xa0" + "".join(map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+"
    rf"| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
)
_WIDE = 1 << 20


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: printable ones for themselves, the
    others in order from 256."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the runs that begin at ``starts``, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


class Vocabulary:
    """A byte-level BPE file: merges by rank, bytes of tokens, special tokens."""

    def __init__(self, file: bytes):
        spec = json.loads(file)
        model, before = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or before["type"] != "ByteLevel" or spec["normalizer"] is not None:
            raise ValueError("not a plain byte-level BPE file")
        if before["add_prefix_space"] or model.get("ignore_merges") or model.get("dropout"):
            raise ValueError("prefix spaces, ignored merges and dropout are not provided for")
        byte_of, ids = byte_characters(), model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError("special tokens that reach into the text are not provided for")
        spelled = {i: bytes(byte_of[c] for c in t) for t, i in ids.items()}
        spelled |= {i: t.encode() for t, i in self.special.items()}
        size = max(spelled) + 1
        if size >= _WIDE:
            raise ValueError("too many tokens")
        self.bytes_of = [spelled.get(i, b"") for i in range(size)]
        self.first = np.array([ids[c] for c, _ in sorted(byte_of.items(), key=lambda x: x[1])], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in pairs], np.int64)
        self.right = np.array([ids[b] for _, b in pairs], np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int32)
        keys = self.left * _WIDE + self.right
        # of a pair that is named twice the last rank counts
        keys, last = np.unique(keys[::-1], return_index=True)
        self.keys, self.ranks = keys, (len(pairs) - 1 - last).astype(np.int32)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, −1 where they do not merge."""
        keys = left.astype(np.int64) * _WIDE + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.ranks[at], -1)


class PairIndex:
    """The symbols of some pieces and, by rank, the positions of every pair that can merge."""

    def __init__(self, vocabulary: Vocabulary, pieces: Sequence[bytes]):
        self.v = vocabulary
        data = np.frombuffer(b"".join(pieces), np.uint8)
        self.ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        self.n = n = len(data)
        # one place more at the end: the neighbour of what has none
        self.symbol = np.append(vocabulary.first[data], np.int32(-1))
        self.after = np.arange(1, n + 2, dtype=np.int32)
        self.before = np.arange(-1, n, dtype=np.int32)
        if n:
            ends = self.ends[self.ends > 0]
            self.after[ends - 1] = n
            self.before[np.append(0, ends[:-1])] = n
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []
        self.enter(np.arange(n, dtype=np.int32))

    def enter(self, at: np.ndarray) -> None:
        """Put the pairs that begin at these places, in ascending order, on their ranks' lists."""
        ranks = self.v.ranks_of(self.symbol[at], self.symbol[self.after[at]])
        held = ranks >= 0
        at, ranks = at[held], ranks[held]
        if not len(at):
            return
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        borders = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        starts = [0, *borders.tolist(), len(at)]
        for rank, a, b in zip(ranks[starts[:-1]].tolist(), starts, starts[1:]):
            if rank in self.places:
                self.places[rank].append(at[a:b])
            else:
                self.places[rank] = [at[a:b]]
                heapq.heappush(self.active, rank)

    def merge(self, rank: int) -> None:
        """Merge all places of a rank's pair and enter what stands beside them now."""
        lists = self.places.pop(rank)
        at = lists[0] if len(lists) == 1 else np.sort(np.concatenate(lists))
        left, right, symbol, after = self.v.left[rank], self.v.right[rank], self.symbol, self.after
        second = after[at]
        held = (symbol[at] == left) & (symbol[second] == right)
        at, second = at[held], second[held]
        if not len(at):
            return
        if left == right:  # every other place of a chain, from its left end
            here = np.arange(len(at))
            opens = np.append(True, second[:-1] != at[1:])
            held = (here - np.maximum.accumulate(np.where(opens, here, 0))) % 2 == 0
            at, second = at[held], second[held]
        beyond = after[second]
        symbol[at] = self.v.made[rank]
        symbol[second] = -1
        after[at] = beyond
        self.before[beyond] = at
        ahead = self.before[at]
        apart = ahead != self.n
        apart[1:] &= ahead[1:] != at[:-1]
        self.enter(np.sort(np.concatenate([ahead[apart], at])))

    def run(self) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces one after another, and how many each piece has."""
        while self.active:
            self.merge(heapq.heappop(self.active))
        stays = self.symbol[: self.n] >= 0
        upto = np.append(0, np.cumsum(stays))[self.ends]
        return self.symbol[: self.n][stays], np.diff(upto, prepend=0)


class Numbers(dict):
    """Numbers of pieces, given out as they are met."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class Codec:
    """Encodes and decodes portions of texts; ids of pieces stay from one portion to the next."""

    def __init__(self, vocabulary: Vocabulary, special: bool = True, pieces: int = PIECES):
        self.v, self.most = vocabulary, pieces
        self.special = vocabulary.special if special else {}
        names = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.split = regex.compile(PATTERN).findall
        self.sizes = np.array([len(b) for b in vocabulary.bytes_of], np.int64)
        self.spelled = np.frombuffer(b"".join(vocabulary.bytes_of), np.uint8)
        self.spelled_at = np.cumsum(self.sizes) - self.sizes
        self.clear()

    def clear(self) -> None:
        self.numbers = Numbers()
        for name in self.special:
            self.numbers[name]
        self.ids = np.array(list(self.special.values()), np.int32)
        self.counts = np.ones(len(self.special), np.int64)

    def pieces(self, text: str) -> list[int]:
        """The numbers of a text's pieces."""
        number = self.numbers
        if self.cut is None or not any(name in text for name in self.special):
            return [number[p] for p in self.split(text)]
        out = []
        for i, part in enumerate(self.cut(text)):
            # a piece can't be mistaken for a special token: those are cut out first
            out += [number[part]] if i % 2 else [number[p] for p in self.split(part)]
        return out

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another, and how many each text has."""
        if len(self.numbers) > self.most:
            self.clear()
        known = len(self.numbers)
        lists = [np.array(self.pieces(t), np.int32) for t in texts]
        if len(self.numbers) > known:
            met = list(self.numbers)[known:]
            ids, counts = PairIndex(self.v, [p.encode() for p in met]).run()
            self.ids, self.counts = np.append(self.ids, ids), np.append(self.counts, counts)
        starts = np.cumsum(self.counts) - self.counts
        ids, lengths = [], []
        for numbers in lists:
            ids.append(self.ids[ragged(starts[numbers], self.counts[numbers])])
            lengths.append(len(ids[-1]))
        return np.concatenate([np.zeros(0, np.int32), *ids]), np.array(lengths, np.int64)

    def token_bytes(self, ids: np.ndarray) -> bytes:
        return self.spelled[ragged(self.spelled_at[ids], self.sizes[ids])].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        return self.token_bytes(ids).decode("utf-8", "replace")


class Shared:
    """A tokenizer file as it is sent with the job. A worker's codec hangs on it: it serves all tasks of
    the job that the worker runs."""

    def __init__(self, file: bytes, special: bool = True, pieces: int = PIECES):
        self.file, self.special, self.pieces, self.made = file, special, pieces, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def codec(self) -> Codec:
        if self.made is None:
            pa.default_memory_pool().release_unused()  # what earlier jobs left to this worker
            self.made = Codec(Vocabulary(self.file), self.special, self.pieces)
        return self.made


def portions(batches: Iterator[pa.RecordBatch], size: int = PORTION) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of whole rows, at most ``size`` characters together or one longer text."""
    ids, texts, held = [], [], 0
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if texts and held + len(text) > size:
                yield ids, texts
                ids, texts, held = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            held += len(text)
    if texts:
        yield ids, texts


def encode_rows(docs: DataFrame, tokenizer_path: str, with_ids: bool = True, special: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers), decoded_sha256
    (of the text that decoding the ids gives, in UTF-8) and, if ``with_ids``, the ids.

    With ``special`` the strings of special tokens are those tokens, else they are plain text.
    """
    ship(docs.sparkSession)
    with open(tokenizer_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Shared(file.read(), special))
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for doc_ids, texts in portions(batches):
            ids, lengths = codec.encode(texts)
            del texts
            ends = np.cumsum(lengths)
            hashes, decoded = [], []
            for a, b in zip((ends - lengths).tolist(), ends.tolist()):
                own = ids[a:b]
                hashes.append(hashlib.sha256(own.astype("<u4").tobytes()).hexdigest())
                decoded.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
            whole = pa.array(ids)
            for at in range(0, len(doc_ids), 1024):  # lists go out in small batches
                to = min(at + 1024, len(doc_ids))
                columns = [pa.array(doc_ids[at:to], pa.int64()), pa.array(lengths[at:to]), pa.array(hashes[at:to]), pa.array(decoded[at:to])]
                if with_ids:
                    begin = int(ends[at] - lengths[at])
                    borders = np.append(0, ends[at:to] - begin).astype(np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(borders), whole[begin : int(ends[to - 1])]))
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)


def decode_rows(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null ids are an empty text."""
    ship(encoded.sparkSession)
    with open(tokenizer_path, "rb") as file:
        shared = encoded.sparkSession.sparkContext.broadcast(Shared(file.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        for batch in batches:
            texts = [codec.decode(np.array(ids.as_py() or [], np.int64)) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")
