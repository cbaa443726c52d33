"""Words, shingles and lines of Arrow text batches as 64-bit hashes, without a Python step per word.

A *word* is a run of bytes outside ``\\x20 \\x09-\\x0D``; multi-byte characters never hold those
bytes, so working on UTF-8 bytes is working on code points. A *unit* is what words are grouped
by: a text or a line. Hashes are polynomial sums finished by a 64-bit mixer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: bytes of text hashed at a time; a longer text is one slice of its own
SLICE_BYTES = 1 << 20
CHUNK_BYTES = 1 << 18

#: kinds of bytes: words are runs of one kind, kind 0 stands between words
PLAIN = np.ones(256, np.uint8)
PLAIN[[0x20, *range(0x09, 0x0E)]] = 0
#: letters and digits (and all beyond ASCII) apart from signs
SIGNS = PLAIN.copy()
SIGNS[[c for c in range(0x21, 0x7F) if not chr(c).isalnum()]] = 2
SAME = np.arange(256, dtype=np.uint8)
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20

_FACTOR = np.uint64(0x9E3779B97F4A7C55)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_powers = np.ones(1, np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _MIX[0]
    h ^= h >> np.uint64(27)
    h *= _MIX[1]
    h ^= h >> np.uint64(31)
    return h


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        size = 1 << (n - 1).bit_length()
        steps = np.full(size, _FACTOR, np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(h, np.uint64).view(np.int64))


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of row ranges of at most ``limit`` bytes or one row."""
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, held[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


@dataclass
class Words:
    hash: np.ndarray  # uint64 for each word
    start: np.ndarray  # its first byte
    end: np.ndarray  # the byte after it
    unit: np.ndarray  # the unit it stands in, ascending


def words(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = SAME, kinds: np.ndarray = PLAIN) -> Words:
    """All words of the units that ``offsets`` bound; ``fold`` maps bytes before hashing."""
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    at, size = 0, len(data)
    heads = np.zeros(size + 1, bool)
    heads[offsets] = True
    while at < size:
        end = min(at + CHUNK_BYTES, size)
        while end < size and kinds[data[end]]:  # never through a word
            gap = np.flatnonzero(kinds[data[end : end + 4096]] == 0)
            end = min(end + (int(gap[0]) if len(gap) else 4096), size)
        piece = data[at:end]
        kind = kinds[piece]
        inside = kind != 0
        border = (kind[1:] != kind[:-1]) | heads[at + 1 : end]
        first = inside.copy()
        first[1:] &= border
        last = inside.copy()
        last[:-1] &= border
        start = np.flatnonzero(first)
        if len(start):
            number = np.cumsum(first, dtype=np.int32)
            number -= 1
            np.maximum(number, 0, out=number)
            local = np.arange(len(piece), dtype=np.int64) - start[number]
            local[~inside] = 0
            value = fold[piece].astype(np.uint64)
            value += np.uint64(1)
            value[~inside] = 0
            value *= powers(int(local.max()) + 1)[local]
            h = mix(np.add.reduceat(value, start))
            parts.append((h, start + at, np.flatnonzero(last) + 1 + at))
        at = end
    if not parts:
        none = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), none, none, none)
    h, start, end = (np.concatenate(x) for x in zip(*parts))
    return Words(h, start, end, np.searchsorted(offsets, start, "right") - 1)


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines of all units, split at ``\\n``, and the unit of each line.

    A line's range ends with its ``\\n`` where it has one, so ranges stay contiguous.
    """
    breaks = np.flatnonzero(data == 0x0A) + 1
    starts = np.sort(np.concatenate([offsets[:-1], breaks]), kind="stable")
    # a break at the very end of a unit opens a last, empty line of that unit
    owner_of_break = np.searchsorted(offsets, breaks - 1, "right") - 1
    owner = np.sort(np.concatenate([np.arange(len(offsets) - 1), owner_of_break]), kind="stable")
    return np.append(starts, len(data)), owner


def windows(word: Words, k: int, units: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash, unit) of every run of ``k`` words inside a unit; a unit of fewer words gives, if
    ``short``, its whole sequence as one."""
    n = len(word.hash)
    factors = powers(2 * k + 2)
    if n >= k:
        count = n - k + 1
        total = np.zeros(count, np.uint64)
        for j in range(k):
            total += word.hash[j : j + count] * factors[j + 1]
        same = word.unit[:count] == word.unit[k - 1 :]
        found, owner = mix(total[same]), word.unit[:count][same]
    else:
        found, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if short:
        held = np.bincount(word.unit, minlength=units)
        few = np.flatnonzero((held > 0) & (held < k))
        if len(few):
            begin = np.searchsorted(word.unit, few)
            total = held[few].astype(np.uint64) * factors[k + 2]
            for j in range(k - 1):
                has = held[few] > j
                total[has] += word.hash[begin[has] + j] * factors[j + 1]
            found, owner = np.concatenate([found, mix(total)]), np.concatenate([owner, few])
    return found, owner


def distinct(found: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (hash, unit) pairs, by unit and then by hash."""
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        new = np.ones(len(found), bool)
        new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[new], owner[new]
    return found, owner


def per_unit(ufunc: np.ufunc, values: np.ndarray, owner: np.ndarray, units: int, empty: int = 0) -> np.ndarray:
    """``ufunc`` over the values of each unit, which stand together."""
    out = np.full(units, empty, values.dtype)
    if len(values):
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first]] = ufunc.reduceat(values, first)
    return out


def set_digests(found: np.ndarray, owner: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each unit's set of hashes, whatever its order."""
    one = per_unit(np.add, mix(found ^ _MIX[0]), owner, units)
    two = per_unit(np.add, mix(found ^ _MIX[1]), owner, units)
    return one, two


class Tally:
    """Frequent hashes of a stream in bounded memory.

    Hashes are counted in windows of ``size``; a window gives those seen at least ``least`` times
    in it (fewer in a window that ends early). Nothing that is frequent throughout is missed.
    """

    def __init__(self, size: int = 1 << 20, least: int = 3):
        self.size, self.least = size, least
        self.held: list[np.ndarray] = []
        self.count = 0

    def add(self, found: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.held.append(found)
        self.count += len(found)
        if self.count >= self.size:
            yield self.flush()

    def flush(self) -> tuple[np.ndarray, np.ndarray]:
        every = np.concatenate(self.held) if self.held else np.zeros(0, np.uint64)
        least = max(2, self.least * len(every) // self.size)
        self.held, self.count = [], 0
        value, times = np.unique(every, return_counts=True)
        return value[times >= least], times[times >= least]
