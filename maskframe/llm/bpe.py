"""Byte-level BPE without regex: code-point classes, associative scans of transition functions, cached pair merging, decoding.

A text's code points become classes, and classes with a look at the next two code points become symbols. A small automaton reads
the symbols; whether a piece starts at a place depends on its state there. The states of all places come from a scan: the
transition functions of a block's symbols are composed in all blocks at once, the blocks' functions are composed with each other
in log steps, and then every block is read from its own first state. Pieces are slices of the UTF-8 bytes; each distinct one is
merged once. The ids keep the byte offset of every token, so that any stretch of them can be decoded to its place in the text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of

#: Code points that are read at once; longer texts are read in so large parts, with the state and the open piece carried on.
WINDOW = 1 << 18
#: Symbols a block of the scan.
BLOCK = 512
#: Merged pieces that a worker remembers, and the longest of them in bytes.
CACHED, CACHED_BYTES = 400_000, 64
#: Pieces from this length on are merged with a heap.
HEAP_BYTES = 128

#: The white space of the pattern (the property White_Space).
WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: What follows an apostrophe in the pieces that the pattern names, all in lower case.
AFTER_ONE, AFTER_TWO = "stmd", ["re", "ve", "ll"]

LETTER, NUMBER, OTHER, SPACE, END = range(5)
#: The code point that stands behind each text.
STOP = 0x110000

# Symbols: what a code point means to the automaton, given what follows.
_L, _N, _O, _SHORT, _LONG, _INNER, _LEADS, _LONE, _END, _SAME = range(10)
# States: what the last code point left open.
_FRESH, _IN_L, _IN_N, _IN_O, _ONE_MORE, _TWO_MORE, _IN_SPACE, _LED = range(8)


def automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a piece starts here) of every state and symbol, flat: state * 10 + symbol."""
    to, starts = np.zeros((8, 10), np.uint8), np.ones((8, 10), bool)
    # By default a symbol starts a piece of its own kind.
    to[:] = [_IN_L, _IN_N, _IN_O, _ONE_MORE, _TWO_MORE, _IN_SPACE, _LED, _FRESH, _FRESH, _FRESH]
    # A piece of one kind goes on, and a leading blank takes any of them; an apostrophe within other signs is one of them.
    for state, symbols in ((_IN_L, [_L]), (_IN_N, [_N]), (_IN_O, [_O, _SHORT, _LONG]), (_IN_SPACE, [_INNER]), (_LED, [_L, _N, _O, _SHORT, _LONG]), (_ONE_MORE, [_L]), (_TWO_MORE, [_L])):
        starts[state, symbols] = False
    for state in (_IN_O, _LED):
        to[state, [_SHORT, _LONG]] = _IN_O
    to[_ONE_MORE, _L], to[_TWO_MORE, _L] = _FRESH, _ONE_MORE
    to[:, _SAME], starts[:, _SAME] = np.arange(8), False
    return to.ravel(), starts.ravel()


TO, STARTS = automaton()
#: Next states as places in the two tables: state * 10, to which a symbol is added.
ROW = TO.astype(np.int32) * 10


@lru_cache(1)
def classes() -> np.ndarray:
    """The class of every code point. Those that Python's Unicode tables don't know yet are asked of the tokenizer library."""
    import tiktoken

    kind = [unicodedata.category(chr(c)) for c in range(STOP)]
    out = np.array([LETTER if k[0] == "L" else NUMBER if k[0] == "N" else OTHER for k in kind] + [END], np.uint8)
    out[WHITE] = SPACE
    new = [c for c in range(0x40000) if kind[c] == "Cn"]
    # A piece that holds "a" (or "1") and a code point's first byte makes a token of both; pieces of their own don't.
    firsts = sorted({chr(c).encode()[0] for c in new})
    for sign, pattern, it in (("a", r"\p{L}+|[^\p{L}]", LETTER), ("1", r"\p{N}+|[^\p{N}]", NUMBER)):
        ranks = {bytes([b]): b for b in range(256)} | {sign.encode() + bytes([b]): 256 + b for b in firsts}
        ids = np.array(tiktoken.Encoding("classes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}, explicit_n_vocab=None).encode_ordinary("\n".join(sign + chr(c) for c in new)))
        line = np.cumsum(ids == 10)
        out[np.array(new)[np.unique(line[ids >= 256])]] = it
    return out


def symbols(codes: np.ndarray, n: int) -> np.ndarray:
    """Symbols of the first ``n`` code points; what lies beyond ``codes`` is the end of the text."""
    ahead = np.full(n + 2, STOP, np.uint32)
    ahead[: len(codes[: n + 2])] = codes[: n + 2]
    kind = classes()[ahead]
    out = np.array([_L, _N, _O, _INNER, _END], np.uint8)[kind]
    last = (kind[:n] == SPACE) & (kind[1 : n + 1] != SPACE) & (kind[1 : n + 1] != END)
    now, one, two = ahead[:n], ahead[1 : n + 1], ahead[2 : n + 2]
    out = out[:n]
    out[last] = np.where(now[last] == 0x20, _LEADS, _LONE)
    at = np.flatnonzero(now == 0x27)
    if len(at):
        a, b = one[at], two[at]
        out[at[np.isin(a, [ord(c) for c in AFTER_ONE])]] = _SHORT
        for x, y in AFTER_TWO:
            out[at[(a == ord(x)) & (b == ord(y))]] = _LONG
    return out


def scan(symbol: np.ndarray, state: int) -> tuple[np.ndarray, int]:
    """(where pieces start, the last state) of a stretch of symbols read from ``state``."""
    n = len(symbol)
    blocks = max(1, -(-n // BLOCK))
    grid = np.full(blocks * BLOCK, _SAME, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T).astype(np.int32)
    # Every block's transition function: where each of the eight states would end.
    whole = np.tile(np.arange(0, 80, 10, dtype=np.int32)[:, None], (1, blocks))
    for column in grid:
        whole = ROW[whole + column]
    whole //= 10
    # Composition is associative: prefixes of all blocks in log steps.
    step = 1
    while step < blocks:
        whole[:, step:] = np.take_along_axis(whole[:, step:], whole[:, :-step], 0)
        step *= 2
    first = np.r_[state, whole[state, :-1]].astype(np.int32) * 10
    places = np.empty(grid.shape, np.int32)
    for i, column in enumerate(grid):
        np.add(first, column, out=places[i])
        first = ROW[places[i]]
    return STARTS[places.T.ravel()[:n]], int(whole[state, -1])


def cut_up(raw: bytes, at: list[int]) -> list[bytes]:
    return [raw[a:b] for a, b in zip(at, at[1:])]


class Memory(dict):
    """Pieces that were merged, each with its place in one table of ids; those not met before are merged on the way."""

    def __init__(self, codec: Codec):
        self.codec, self.n, self.size = codec, 0, 0
        self.first, self.count, self.ids = (np.zeros(1 << 16, np.int64) for _ in range(3))

    def __missing__(self, piece: bytes) -> int:
        out = self.codec.piece(piece) if piece else ()
        at, self.n = self.n, self.n + 1
        if at >= len(self.count):
            self.first, self.count = np.r_[self.first, self.first * 0], np.r_[self.count, self.count * 0]
        while self.size + len(out) > len(self.ids):
            self.ids = np.r_[self.ids, self.ids * 0]
        self.first[at], self.count[at] = self.size, len(out)
        self.ids[self.size : self.size + len(out)] = out
        self.size += len(out)
        if len(piece) <= CACHED_BYTES:
            self[piece] = at
        return at


class Codec:
    """Ranks of a file, merging with memory, and tables for decoding."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        by_id = sorted((i, t) for t, i in self.ranks.items())
        self.length = np.full(by_id[-1][0] + 1, -1, np.int64)
        ids = np.array([i for i, _ in by_id])
        self.length[ids] = [len(t) for _, t in by_id]
        self.start = np.zeros(len(self.length), np.int64)
        self.start[ids] = np.cumsum(self.length[ids]) - self.length[ids]
        self.bytes = np.frombuffer(b"".join(t for _, t in by_id), np.uint8)
        self.digits = [str(i) for i in range(len(self.length))]
        self.memory = Memory(self)

    def piece(self, piece: bytes) -> tuple[int, ...]:
        """A piece's ids: itself if it is a token, else pairs of the lowest rank are joined, the leftmost first."""
        if piece in self.ranks:
            return (self.ranks[piece],)
        return self.merged(piece) if len(piece) < HEAP_BYTES else self.merged_by_heap(piece)

    def ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids of the pieces, where each piece's ids end)."""
        if len(self.memory) > CACHED or self.memory.size > 16 * CACHED:
            self.memory = Memory(self)
        at = np.fromiter(map(self.memory.__getitem__, pieces), np.int64, len(pieces))
        n = self.memory.count[at]
        upto = np.cumsum(n)
        return self.memory.ids[np.repeat(self.memory.first[at] - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)], upto

    def merged(self, piece: bytes) -> tuple[int, ...]:
        parts, none = [piece[i : i + 1] for i in range(len(piece))], len(self.length)
        rank = self.ranks.get
        pairs = [rank(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], none)
        return tuple(self.ranks[p] for p in parts)

    def merged_by_heap(self, piece: bytes) -> tuple[int, ...]:
        """The same for long pieces: parts are a linked list by their first byte, pairs that may be stale wait in a heap."""
        n, rank = len(piece), self.ranks.get
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := rank(piece[i : end[j]])) is not None:
                heapq.heappush(heap, (r, i))

        while heap:
            r, i = heapq.heappop(heap)
            j = end[i]
            if gone[i] or j >= n or rank(piece[i : end[j]]) != r:
                continue
            gone[j], end[i] = 1, end[j]
            if end[i] < n:
                before[end[i]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return tuple(out)

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Where each token's bytes start in the text."""
        n = self.length[ids]
        return np.cumsum(n) - n

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of a run of ids, a million ids at a time. Ids that the file hasn't are an error."""
        out = []
        for a in range(0, len(ids), 1 << 20):
            part = ids[a : a + (1 << 20)]
            if len(part) and (part.min() < 0 or part.max() >= len(self.length) or self.length[part].min() < 0):
                raise ValueError("ids hold one that the vocabulary hasn't")
            n = self.length[part]
            upto = np.cumsum(n)
            out.append(self.bytes[np.repeat(self.start[part] - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)].tobytes())
        return b"".join(out)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of every text, in order."""
        group, size = [], 0
        for t in texts:
            if size + len(t) + 1 > WINDOW:
                if group:
                    yield from self.encode_short(group)
                group, size = [], 0
            if len(t) + 1 > WINDOW:
                yield self.encode_long(t)
            else:
                group.append(t)
                size += len(t) + 1
        if group:
            yield from self.encode_short(group)

    def pieces(self, codes: np.ndarray, n: int, state: int) -> tuple[np.ndarray, int]:
        """Byte offsets at which pieces start within the first ``n`` code points, and the last state."""
        starts, state = scan(symbols(codes, n), state)
        c = codes[:n]
        wide = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000).astype(np.int64)
        wide[c == STOP] = 0
        return (np.cumsum(wide) - wide)[starts], state

    def encode_short(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Texts that fit one window together: a stop behind each, which is a piece of no bytes."""
        whole = "".join(texts)
        ends = np.cumsum([len(t) for t in texts])
        codes = np.insert(np.frombuffer(whole.encode("utf-32-le"), "<u4"), ends, STOP)
        at, _ = self.pieces(codes, len(codes), _FRESH)
        raw = whole.encode()
        ids, upto = self.ids(cut_up(raw, np.r_[at, len(raw)].tolist()))
        yield from np.split(ids, upto[np.diff(at, append=len(raw)) == 0])[:-1]

    def encode_long(self, text: str) -> np.ndarray:
        """A text of many windows: the state and the bytes of the piece that is open are carried on."""
        state, carried, out = _FRESH, [], []
        for a in range(0, len(text), WINDOW):
            raw = text[a : a + WINDOW]
            codes = np.frombuffer(text[a : a + WINDOW + 2].encode("utf-32-le"), "<u4")
            at, state = self.pieces(codes, len(raw), state)
            b = raw.encode()
            if not len(at):
                carried.append(b)
                continue
            out.append(self.ids([b"".join([*carried, b[: at[0]]]), *cut_up(b, at.tolist())])[0])
            carried = [b[at[-1] :]]
        return np.concatenate([*out, self.ids([b"".join(carried)])[0]])


@lru_cache(2)
def codec(path: str) -> Codec:
    return Codec(path)


def _encoded(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """Keys and ids, some texts at a time."""
    for b in slices(batches, "_t", 4 << 20):
        yield b.column("_k"), list(codec(path).encode(texts_of(b.column("_t"))))


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rows])], pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *rows]), pa.int32()))


def _keyed(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")), docs.select(F.col(key)).dtypes[0][1]


def encode(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, ids, offsets``: the ids of every whole text and the byte at which each token starts.

    ``ranks`` is a file of ranks (base64 token, rank) that holds all single bytes; text that spells a special token is ordinary.
    A null or empty text has no ids; repeated rows are encoded each; texts of any length are read window by window (a single
    piece, such as a run of letters without a blank, is merged in memory, about 100 bytes a byte); an empty table gives
    none; other columns are ignored.
    """
    rows, kind = _keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _encoded(ranks, batches):
            yield pa.RecordBatch.from_arrays([keys, _lists(ids), _lists([codec(ranks).offsets(x) for x in ids])], names=["doc_id", "ids", "offsets"])

    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, offsets array<int>")


def decode(encoded: DataFrame, ranks: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, decoded``: the bytes of every list of ids, null for null. Ids that the file hasn't are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [codec(ranks).decode(x.values.to_numpy(zero_copy_only=False).astype(np.int64)) if x.is_valid else None for x in b.column("_i")]
            yield pa.RecordBatch.from_arrays([b.column("_k"), pa.array(out, pa.binary())], names=["doc_id", "decoded"])

    rows = encoded.select(F.col(key).alias("_k"), F.col(ids).cast("array<int>").alias("_i"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, decoded binary")


def digests(docs: DataFrame, ranks: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: every text encoded, its ids decoded again, and both hashed; see :func:`encode`."""
    rows, kind = _keyed(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, ids in _encoded(ranks, batches):
            c = codec(ranks)
            cols = [keys, pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(",".join(map(c.digits.__getitem__, x.tolist())).encode()).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(c.decode(x)).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
