"""Byte-level BPE encoding and decoding by a finite-state transducer.

Compilation. For every token its split (the two parts of its last merge) is
found with the ranks alone. Two tokens may stand side by side in an encoding
exactly if no merge across their border would have happened before the merges
that built the edges: ``Merges.fits`` walks the right edge of one and the left
edge of the other. A sequence is the encoding of its bytes exactly if all its
neighbours fit (the known characterisation of BPE by adjacent pairs).

Transducer. The nondeterministic machine guesses tokens along a byte trie, each
fitting the one before, and emits them. It is determinised lazily: a state is
the set of live guesses, each with its tokens not yet emitted, its last token
and its trie node; what all guesses agree on is emitted at once. Tokens have
bounded length, so the set is bounded and a token leaves after bounded
lookahead. States and transitions are made when a text first asks for them and
kept while the worker lives (up to ``max_states``; then the table starts anew).

Decoding maps ids to bytes and runs an incremental UTF-8 state machine, so ids
can arrive in any portions.

Null text is an empty text (no token). Any Unicode text is valid input. Rows are
independent: repeated ones have equal results, a null doc_id is kept, and there are no ties
to break (of equal merges the leftmost is first). A very long text is encoded piece by
piece, its ids are held at once. An empty table gives no rows; columns other than doc_id,
text and those of ``carry`` are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

NEVER = 1 << 62
#: Bytes of text whose ids are held at once.
SLICE = 1 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """Splits of tokens and the relation of tokens that may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.right: dict[int, list[tuple[bytes, int]] | None] = {}
        self.left: dict[int, list[tuple[bytes, int]] | None] = {}
        self._fits: dict[int, bool] = {}

    def split(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts that the merges below the token's own rank leave, or
        None if they leave more (the token cannot be reached by merging)."""
        parts = [token[i : i + 1] for i in range(len(token))]
        own = self.ranks[token]
        while len(parts) > 2:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], NEVER), i) for i in range(len(parts) - 1))
            if rank >= own:
                return None
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts[0], parts[1]

    def edge(self, t: int, side: int) -> list[tuple[bytes, int]] | None:
        """Tokens on the left (0) or right (1) edge of t, each with the rank of the
        merge that takes it in; None for a token that merging cannot reach."""
        known = self.right if side else self.left
        if t not in known:
            whole = self.token[t]
            found, at, taken = [], whole, NEVER
            while True:
                found.append((at, taken))
                if len(at) == 1:
                    break
                parts = self.split(at)
                if parts is None:
                    found = None
                    break
                taken, at = self.ranks[at], parts[side]
            known[t] = found
        return known[t]

    def reachable(self, t: int) -> bool:
        return self.edge(t, 0) is not None and self.edge(t, 1) is not None

    def fits(self, a: int, b: int) -> bool:
        """Whether b may follow a. A merge across the border wins if it comes before
        the merge that takes its right part in, and strictly before the one that
        takes its left part in (of equal merges the leftmost is done first)."""
        key = a << 32 | b
        if key not in self._fits:
            if len(self._fits) > 500_000:
                self._fits.clear()
            ranks = self.ranks
            starts = self.edge(b, 0)
            self._fits[key] = True
            for x, taken_x in self.edge(a, 1):
                for y, taken_y in starts:
                    m = ranks.get(x + y)
                    if m is not None and m < taken_x and m <= taken_y:
                        self._fits[key] = False
        return self._fits[key]


class Transducer:
    """Lazily determinised. A state is a tuple of guesses (pending tokens, last
    token or -1, trie node); the order of guesses is the order of their starts."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = 300_000):
        self.merges = Merges(ranks)
        self.max_states = max_states
        self.next: dict[int, int] = {}  # trie: 256 * node + byte -> node
        self.ends: list[int] = [-1]  # trie: node -> token
        self.inner: list[bool] = [True]  # trie: node has children
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                step = self.next.get(node << 8 | byte)
                if step is None:
                    step = self.next[node << 8 | byte] = len(self.ends)
                    self.inner[node] = True
                    self.ends.append(-1)
                    self.inner.append(False)
                node = step
            self.ends[node] = rank
        self.reset()

    def reset(self) -> None:
        self.names: dict[tuple, int] = {}
        self.guesses: list[tuple] = []
        self.moves: dict[int, tuple[tuple[int, ...], int]] = {}  # state + byte -> output, state
        self.final: list[tuple[int, ...] | None] = []
        self.start = self.state((((), -1, 0),))

    def state(self, guesses: tuple) -> int:
        """The state's number, times 256."""
        k = self.names.get(guesses)
        if k is None:
            k = self.names[guesses] = len(self.guesses) << 8
            self.guesses.append(guesses)
            ended = None
            for pending, _, node in guesses:
                if not node:
                    ended = pending
            self.final.append(ended)
        return k

    def move(self, k: int, byte: int) -> tuple[tuple[int, ...], int]:
        """The transition of state k on a byte, made and kept."""
        live = []
        fits, reachable, step_of, ends, inner = self.merges.fits, self.merges.reachable, self.next.get, self.ends, self.inner
        for pending, last, node in self.guesses[k >> 8]:
            step = step_of(node << 8 | byte)
            if step is None:
                continue
            if inner[step]:
                live.append((pending, last, step))
            token = ends[step]
            if token >= 0 and reachable(token) and (last < 0 or fits(last, token)):
                live.append(((*pending, token), token, 0))
        first = live[0][0]
        common = len(first)
        for pending, _, _ in live:
            while pending[:common] != first[:common]:
                common -= 1
        move = self.moves[k | byte] = (first[:common], self.state(tuple([(p[common:], t, n) for p, t, n in live]) if common else tuple(live)))
        return move

    def encode(self, piece: bytes) -> list[int]:
        if len(self.guesses) > self.max_states:
            self.reset()
        out: list[int] = []
        k, moves = self.start, self.moves
        for byte in piece:
            got = moves.get(k | byte) or self.move(k, byte)
            k = got[1]
            if got[0]:
                out += got[0]
        out += self.final[k >> 8]
        return out


class Utf8Machine:
    """Incremental UTF-8 decoder. Its state is (continuation bytes still due, least
    and greatest value of the next one); malformed bytes become U+FFFD, one for
    each maximal valid prefix, as Unicode recommends."""

    def __init__(self):
        self.due, self.low, self.high = 0, 0x80, 0xBF
        self.held = b""

    @staticmethod
    def lead(b: int) -> tuple[int, int, int] | None:
        """Follow-up of a lead byte: bytes due, range of the first of them."""
        if 0xC2 <= b <= 0xDF:
            return 1, 0x80, 0xBF
        if 0xE0 <= b <= 0xEF:
            return 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        if 0xF0 <= b <= 0xF4:
            return 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        return None

    def step(self, b: int) -> str:
        if self.due:
            if self.low <= b <= self.high:
                self.held += bytes([b])
                self.due, self.low, self.high = self.due - 1, 0x80, 0xBF
                if self.due:
                    return ""
                done, self.held = self.held.decode(), b""
                return done
            self.due, self.held = 0, b""
            return "�" + self.step(b)
        if b < 0x80:
            return chr(b)
        found = self.lead(b)
        if found is None:
            return "�"
        self.due, self.low, self.high = found
        self.held = bytes([b])
        return ""

    def feed(self, data: bytes) -> str:
        """Text that is complete now. Valid runs are decoded whole; the machine walks
        where a portion begins or ends inside a character, or bytes are bad."""
        out, at = [], 0
        while at < len(data):
            if not self.due:
                end = len(data)
                for back in range(1, min(3, end - at) + 1):  # an open character at the end
                    if data[end - back] >= 0xC0:
                        due = self.lead(data[end - back])
                        if due and due[0] >= back:
                            end -= back
                        break
                    if data[end - back] < 0x80:
                        break
                try:
                    out.append(data[at:end].decode())
                    at = end
                except UnicodeDecodeError as e:
                    out.append(data[at : at + e.start].decode())
                    at += e.start
            if at < len(data):
                out.append(self.step(data[at]))
                at += 1
        return "".join(out)

    def close(self) -> str:
        rest, self.due, self.held = "�" if self.due else "", 0, b""
        return rest


class Pieces(dict):
    """Results by piece in two generations: when the young one is full it becomes the
    old one, from which pieces still in use come back. Bounded by 2 * ``most``."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, piece: str) -> str:
        got = self.old.get(piece)
        if got is None:
            got = self.make(piece)
        self[piece] = got
        return got

    def age(self) -> None:
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()


class Codec:
    """Encoder and decoder for one rank file and split pattern. Ids of a piece are
    kept as the text of their decimals, which is what digests and files need."""

    def __init__(self, ranks_path: str, pattern: str, max_pieces: int = 200_000, max_states: int = 300_000):
        self.ranks = read_ranks(ranks_path)
        self.machine = Transducer(self.ranks, max_states)
        self.find = regex.compile(pattern).findall
        self.known = Pieces(self.piece, max_pieces)
        self.bytes_of = {str(r): t for t, r in self.ranks.items()}

    def piece(self, piece: str) -> str:
        data = piece.encode()
        whole = self.ranks.get(data)
        return str(whole) if whole is not None else " ".join(map(str, self.machine.encode(data)))

    def encode(self, text: str) -> str:
        """Ids in decimal, joined by one space."""
        self.known.age()
        return " ".join(map(self.known.__getitem__, self.find(text)))

    def decode(self, ids: Iterable[str]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def decode_stream(self, portions: Iterable[Iterable[str]]) -> Iterator[str]:
        """Text of portions of ids as soon as it is complete."""
        machine = Utf8Machine()
        for ids in portions:
            yield machine.feed(self.decode(ids))
        yield machine.close()


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str, max_states: int = 300_000) -> Codec:
    """One per Python worker."""
    return Codec(ranks_path, pattern, max_states=max_states)


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = True, portion: int = 4096, keep_warm: bool = True, carry: tuple[str, ...] = (), max_states: int = 300_000) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked, ``ids`` (array of
    int). Every text is encoded, then decoded from its ids in portions; the digest
    is of the decoded text's UTF-8 bytes. ``keep_warm``: a worker keeps its states and
    pieces for its next task; where workers go on to other stages, they should not, and
    fewer states (``max_states``) leave memory to those.
    ``carry``: columns of ``docs`` that go along behind the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks_path, pattern, max_states)
        for whole in batches:
            for i, j in slices(whole.column(1), SLICE):
                b = whole.slice(i, j - i)
                n, ids_hex, text_hex, all_ids = [], [], [], []
                for text in b.column(1):
                    joined = c.encode(text.as_py() or "")
                    ids = joined.split(" ") if joined else []
                    digest = hashlib.sha256()
                    for part in c.decode_stream(ids[k : k + portion] for k in range(0, len(ids), portion)):
                        digest.update(part.encode())
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(joined.encode()).hexdigest())
                    text_hex.append(digest.hexdigest())
                    if with_ids:
                        all_ids.append(np.fromstring(joined, np.int32, sep=" ") if joined else np.zeros(0, np.int32))
                columns = [b.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(n)]).astype(np.int32), np.concatenate(all_ids)))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns + b.columns[2:], names + list(carry))
        if not keep_warm:
            codec.cache_clear()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    schema += "".join(f", `{c}` {docs.schema[c].dataType.simpleString()}" for c in carry)
    return docs.select("doc_id", "text", *[F.col(f"`{c}`") for c in carry]).mapInArrow(run, schema)
