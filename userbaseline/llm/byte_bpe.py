"""Byte-level BPE by a lazily determinised transducer, and streaming decoding by a UTF-8 machine.

Encoding. A text is cut into pieces by a pattern; each piece runs through a transducer over bytes. The
BPE encoding of a prefix ends in exactly one token t whose left neighbour, the last token of the
prefix before t, forms with t a pair that merging leaves apart; so the last tokens of all prefixes
follow from left to right. A state holds the last token that is settled and the bytes read since, with
the last token at each of them. A byte may still grow into several tokens; the tokens that all of those
share on their way back are settled and emitted, so the lookahead is bounded by the vocabulary and not
by the text. States and transitions are made when first met and kept up to a bounded number;
then the tables start anew, which costs time only. Whether a pair stays apart is found from the ranks.

Decoding. Token bytes go through a UTF-8 machine whose state is the started character; its
steps are kept per (state, token). A wrong byte gives U+FFFD and starts anew.

Texts are encoded whole. A null text is an empty one, which has no tokens. Repeated rows and null ids are
rows like others; other columns are ignored by `encode_rows`. The rank file is read by the driver and
sent with the job.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from userbaseline.session import ship

#: entries of the tables that are filled while running; pieces are kept in two halves, the older goes first
TRANSITIONS, PIECES, PAIRS = 900_000, 400_000, 400_000
#: white space as Unicode has it, wherever a pattern says \s
WHITE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


class Vocabulary:
    def __init__(self, rank_lines: bytes, tables: float = 1.0):
        self.tables = tables
        self.rank = {base64.b64decode(a): int(b) for a, b in (x.split() for x in rank_lines.splitlines() if x)}
        self.token = {i: t for t, i in self.rank.items()}
        self.beyond = max(self.token) + 1
        self.opening = {t[:n] for t in self.rank for n in range(1, len(t))}
        self._apart: dict[tuple[int, int], bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}

    def merged(self, data: bytes, stop: int = 1) -> list[bytes]:
        """The plain merging of a short byte string, lowest rank first, leftmost among equals, until
        ``stop`` parts are left."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > stop:
            found = [(r, i) for i in range(len(parts) - 1) if (r := self.rank.get(parts[i] + parts[i + 1])) is not None]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge joins into ``token``; None for a single byte, and for a
        token that merging its own bytes does not give."""
        if token not in self._halves:
            data, found = self.token[token], None
            if len(data) > 1 and len(self.merged(data)) == 1:
                found = tuple(self.rank[part] for part in self.merged(data, stop=2))
            self._halves[token] = found
        return self._halves[token]

    def stands(self, token: int) -> bool:
        """Merging the token's own bytes gives the token."""
        return len(self.token[token]) == 1 or self.halves(token) is not None

    def apart(self, left: int, right: int) -> bool:
        """The two tokens stay as they are when they stand side by side.

        A merge across the border can only happen before the tokens at it have grown further. So time
        is run backwards: the later made of the two tokens at the border is taken apart, down to
        its half at the border, and what joins over the border must come before that merge.
        """
        key = (left, right)
        known = self._apart.get(key)
        if known is None:
            if len(self._apart) >= PAIRS * self.tables:
                self._apart.clear()
            known = self._apart[key] = self._stay(left, right)
        return known

    def _stay(self, left: int, right: int) -> bool:
        before = self.beyond
        while True:
            across = self.rank.get(self.token[left] + self.token[right])
            if across is not None and across < before:
                return False
            parts = (self.halves(left), self.halves(right))
            if parts[0] is None and parts[1] is None:
                return True
            if parts[1] is None or parts[0] is not None and left > right:
                before, left = left, parts[0][1]
            else:  # of equal ranks the left pair is merged first
                before, right = right + 1, parts[1][0]


class State:
    """What the transducer knows after some bytes: the bytes since the last settled token, for each
    place in them (the first is where that token ends) the last token there, and the places where
    a token may begin that reaches beyond what has been read."""

    __slots__ = ("held", "last", "open", "next")

    def __init__(self, held: bytes, last: tuple, open_: tuple):
        self.held, self.last, self.open = held, last, open_
        #: by byte, the same table of the next state and the tokens emitted; -1 is the state itself
        self.next: dict = {-1: self}


class Encoder:
    """The transducer; `piece` gives the ids of one piece."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.size = {i: len(t) for i, t in vocabulary.token.items()}
        self.states: dict[bytes, State] = {}
        self.clear()

    def clear(self) -> None:
        """Start anew. States point at each other, so they are taken apart by hand."""
        for state in self.states.values():
            state.next.clear()
        self.start = State(b"", (None,), (0,))
        self.states = {}
        self.transitions = 0

    def way(self, last: tuple, at: int) -> tuple[int, ...]:
        """The tokens from the settled one up to place ``at``."""
        out = []
        while at:
            out.append(last[at])
            at -= self.size[last[at]]
        return tuple(reversed(out))

    def step(self, state: State, byte: int) -> tuple[dict, tuple[int, ...]]:
        v, size, held = self.v, self.size, state.held + bytes((byte,))
        last, place = state.last, len(held)
        open_, found = [], None
        for j in state.open:
            since = held[j:]
            if found is None:
                token = v.rank.get(since)
                if token is not None and v.stands(token) and (last[j] is None or v.apart(last[j], token)):
                    found = token
            if since in v.opening:
                open_.append(j)
        if found is None:
            raise ValueError("the ranks lack a single byte")
        last = (*last, found)
        open_.append(place)
        # where the ways to all open places part is settled
        ends = set(open_)
        while len(ends) > 1:
            far = max(ends)
            ends.remove(far)
            ends.add(far - size[last[far]])
        (keep,) = ends
        # states are the same if their ways are; the settled token counts where a token may follow it
        ways = set()
        for at in open_:
            while at > keep and at not in ways:
                ways.add(at)
                at -= size[last[at]]
        parts = [len(ways), last[keep] if keep in open_ and last[keep] is not None else -1]
        for p in sorted(ways):
            parts += p - keep, last[p]
        key = array("i", parts).tobytes() + held[keep:]
        to = self.states.get(key)
        if to is None:
            to = self.states[key] = State(held[keep:], last[keep:], tuple([j - keep for j in open_]))
        emitted = self.way(last, keep) if keep else ()
        self.transitions += 1
        result = state.next[byte] = (to.next, emitted)
        return result

    def piece(self, data: bytes) -> tuple[int, ...]:
        if (whole := self.v.rank.get(data)) is not None:
            return (whole,)
        if self.transitions >= TRANSITIONS * self.v.tables:
            self.clear()
        table, out = self.start.next, []
        for byte in data:
            try:
                table, emitted = table[byte]
            except KeyError:
                table, emitted = self.step(table[-1], byte)
            if emitted:
                out += emitted
        state = table[-1]
        out += self.way(state.last, len(state.held))
        return tuple(out)


def _first_byte(byte: int) -> tuple[int, int, int] | None:
    """(continuations, least and most of the next byte) after a first byte of a character."""
    if 0xC2 <= byte <= 0xDF:
        return 1, 0x80, 0xBF
    if 0xE0 <= byte <= 0xEF:
        return 2, 0xA0 if byte == 0xE0 else 0x80, 0x9F if byte == 0xED else 0xBF
    if 0xF0 <= byte <= 0xF4:
        return 3, 0x90 if byte == 0xF0 else 0x80, 0x8F if byte == 0xF4 else 0xBF
    return None


def utf8_steps(started: bytes, data: bytes) -> tuple[str, bytes]:
    """The characters that ``data`` completes after ``started``, and what it leaves started."""
    out = []
    for byte in data:
        if started:
            need, low, high = _first_byte(started[0])
            if len(started) > 1:
                low, high = 0x80, 0xBF
            if low <= byte <= high:
                started += bytes((byte,))
                if len(started) == need + 1:
                    out.append(started.decode())
                    started = b""
                continue
            out.append("�")
            started = b""
        if byte < 0x80:
            out.append(chr(byte))
        elif _first_byte(byte):
            started = bytes((byte,))
        else:
            out.append("�")
    return "".join(out), started


class Decoder:
    """Streaming decoding: `feed` ids (numbers, or their decimal texts) as they come, `finish` at the end."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.known: dict[int | str, tuple[str, bytes]] = {}
        self.later: dict[tuple[bytes, int | str], tuple[str, bytes]] = {}
        self.started = b""

    def feed(self, ids: Iterable[int | str]) -> list[str]:
        out, started, known = [], self.started, self.known
        for i in ids:
            if not started:
                found = known.get(i)
                if found is None:
                    found = known[i] = utf8_steps(b"", self.v.token[int(i)])
            else:
                found = self.later.get((started, i))
                if found is None:
                    if len(self.later) >= PAIRS:
                        self.later.clear()
                    found = self.later[started, i] = utf8_steps(started, self.v.token[int(i)])
            text, started = found
            out.append(text)
        self.started = started
        return out

    def finish(self) -> str:
        rest, self.started = ("�" if self.started else ""), b""
        return rest


class Pieces(dict):
    """The ids, in decimal joined by commas, of pieces met before; a missing piece is encoded and kept
    if it is short."""

    def __init__(self, encoder: Encoder):
        self.encoder = encoder
        self.older: dict[str, str] = {}
        self.shown = {i: str(i) for i in encoder.v.token}

    def __missing__(self, piece: str) -> str:
        if len(self) >= PIECES * self.encoder.v.tables:
            self.older = dict(self)
            self.clear()
        found = self.older.get(piece)
        if found is None:
            shown = self.shown
            found = ",".join([shown[i] for i in self.encoder.piece(piece.encode())])
        if len(piece) <= 64:
            self[piece] = found
        return found


class Codec:
    """Encoder and decoder of one rank file and pattern; ``tables`` scales the bounds of the tables
    that fill while running, which changes time and memory and nothing else."""

    def __init__(self, rank_lines: bytes, pattern: str, tables: float = 1.0):
        vocabulary = Vocabulary(rank_lines, tables)
        self.encoder, self.decoder = Encoder(vocabulary), Decoder(vocabulary)
        spelled = pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")
        self.split = regex.compile(spelled).findall
        self.met = Pieces(self.encoder)

    def encode(self, text: str) -> str:
        """The ids in decimal, joined by commas."""
        met = self.met
        return ",".join([met[p] for p in self.split(text)])

    def decode(self, ids: Iterable[int | str]) -> str:
        return "".join(self.decoder.feed(ids)) + self.decoder.finish()


class Shared:
    """A rank file as it is sent with the job. A worker's codec hangs on it: it serves all tasks of the
    job that the worker runs, and goes when the worker turns to another job."""

    def __init__(self, rank_lines: bytes, pattern: str, tables: float):
        self.rank_lines, self.pattern, self.tables, self.made = rank_lines, pattern, tables, None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def codec(self) -> Codec:
        if self.made is None:
            pa.default_memory_pool().release_unused()  # what earlier jobs left to this worker
            self.made = Codec(self.rank_lines, self.pattern, self.tables)
            # the tables are large and free of garbage: walk them less often while they serve
            self.thresholds = gc.get_threshold()
            gc.set_threshold(100_000, 50)
        return self.made

    def __del__(self):
        if self.made is not None:
            self.made.encoder.clear()
            gc.set_threshold(*self.thresholds)


def encode_rows(
    docs: DataFrame, rank_path: str, pattern: str, with_ids: bool = True, tables: float = 1.0
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the bytes
    that decoding the ids gives) and, if ``with_ids``, the ids.

    A Python worker grows to some 600 MB with ``tables`` at 1 and 350 MB at a quarter.
    """
    ship(docs.sparkSession)
    with open(rank_path, "rb") as file:
        shared = docs.sparkSession.sparkContext.broadcast(Shared(file.read(), pattern, tables))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.codec()
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                counts, hashes, decoded, lists = [], [], [], []
                for value in part.column(1):
                    shown = codec.encode(value.as_py())
                    ids = shown.split(",") if shown else []
                    counts.append(len(ids))
                    hashes.append(sha(shown.encode()))
                    decoded.append(sha(codec.decode(ids).encode()))
                    if with_ids:
                        lists.append(pa.array([int(i) for i in ids], pa.int32()))
                columns = [part.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)]
                if with_ids:
                    ends = [0]
                    for x in lists:
                        ends.append(ends[-1] + len(x))
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(lists)))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
