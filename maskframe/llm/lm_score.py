"""LM scoring with a probabilistic suffix tree over all words.

A context is the last one, two or three words (the place before a text included). It is kept if it was met at least twice in
training, if the context that it extends was kept and has more than one next word, and if its next-word distribution diverges from that of its suffix: its left-out
log likelihood ratio against the suffix must be positive by a margin. Distributions are smoothed by absolute discounting with
that of the suffix, down to the words' own shares; the longest kept suffix of what came before predicts the next word. So
the tree grows with the corpus: no share, rank or number bounds it.

The tree is never gathered. Texts are read once into chunk files in the shared folder. For each depth a chunk sends the distinct
(context, next word) pairs that it needs, with its own training counts, to buckets of the contexts' hashes; a bucket merges the
counts of all chunks, decides which contexts stay, and answers every chunk in the order of its request. The answers are grouped by
chunk and laid beside its file in the job that makes them, so that they travel once and are kept once. A context met more
than ``HOT`` times is dealt over several buckets, which test their parts; the parts' sums, a bounded table, decide. Words are
counted by 64-bit hashes, whose lower 48 bits make the contexts' 48-bit hashes; next words within a context are sent as 16, 24 or
32 bits, in their order.
"""

from __future__ import annotations

import gc
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER_AZ, bytes_of, cut, held_out, shared_dir, slices

#: Longest context; what absolute discounting takes from each count; left-out gain (nats) that keeps a context; least count.
DEPTH, DISCOUNT, MARGIN, SUPPORT = 3, 0.75, 1.0, 2
#: Bytes of text of a chunk, and of text that one bucket answers for.
CHUNK_BYTES, BUCKET_BYTES = 12 << 20, 12 << 20
#: A context met more often than this is dealt over several buckets; there are at most ``HOT_ROWS`` such contexts a depth.
HOT, HOT_ROWS = 1 << 18, 1 << 20
#: Groups in which the parts of hot contexts are summed up.
SUMS = 64
#: Contexts met up to so often tell their next words apart by 16 and by 24 bits, others by 32: half a collision is to be expected at most.
NARROW, MIDDLE = 256, 4096
_U = np.uint64
_P, _Q, _START = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
_48, _24 = _U((1 << 48) - 1), _U((1 << 24) - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(29))


# ---- arrays on the wire: byte planes, compressed


def packed(*arrays: np.ndarray) -> bytes:
    out = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        body = zstandard.ZstdCompressor(level=1).compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes()) if len(a) else b""
        out.append(f"{a.dtype.str},{len(a)},{len(body)};".encode() + body)
    return b"".join(out)


def unpacked(raw: bytes) -> list[np.ndarray]:
    out, p = [], 0
    while p < len(raw):
        z = raw.index(b";", p)
        kind, n, size = raw[p:z].decode().split(",")
        body = raw[z + 1 : z + 1 + int(size)]
        planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if int(n) else np.zeros(0, np.uint8)
        out.append(np.ascontiguousarray(planes.reshape(-1, int(n)).T).view(np.dtype(kind)).reshape(-1) if int(n) else np.zeros(0, np.dtype(kind)))
        p = z + 1 + int(size)
    return out


# ---- chunks


def file_system(folder: str):
    """The file system of a folder, and its path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def chunked(docs: DataFrame, key: str, text: str, folder: str) -> DataFrame:
    """Writes the texts as chunk files; (chunk, path, tokens, train_tokens, train_docs). Only files of finished tasks are listed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        ctx = TaskContext.get()
        chunk = (ctx.partitionId() if ctx else 0) << 32
        local: dict = {}
        texts, ids, held, known, size = [], [], [], [], 0

        def closed() -> pa.RecordBatch:
            words = np.fromiter((xxhash.xxh64_intdigest(w) for w in local), np.uint64, len(local))
            ends = np.array([len(s) for s in texts], np.int64)
            out, index = np.array(held, bool), np.concatenate(texts)
            # Frequent words get small numbers, whose upper bytes take no room.
            n = np.bincount(index, minlength=len(words))
            order = np.argsort(-n, kind="stable")
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            blob = packed(np.array([0 if i is None else i for i in ids], np.int64), np.array([i is not None for i in ids], bool), out, ends, shortened(rank[index], int((n > 1).sum())), words[order] & _48)
            path = f"{base}/chunk-{chunk:016d}-{uuid.uuid4().hex[:12]}"
            system.create_dir(base, recursive=True)
            # Only the counts of words need their upper bits, which are deleted then.
            for at, what in ((path, blob), (f"{path}-upper", packed((words[order] >> _U(48)).astype(np.uint16)))):
                with system.open_output_stream(at) as f:
                    f.write(what)
            cols = [[chunk], [path], [int(ends.sum())], [int(ends[~out].sum())], [int((~out).sum())]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["chunk", "path", "tokens", "train_tokens", "train_docs"])

        for b in slices(batches, "_t"):
            for doc, out, raw in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), bytes_of(b.column("_t"))):
                words = raw.translate(LOWER_AZ).split()
                words.append(b"")
                texts.append(np.fromiter((local.setdefault(w, len(local)) for w in words), np.uint32, len(words)))
                ids.append(doc), held.append(out)
                size += len(raw)
                if size >= CHUNK_BYTES:
                    yield closed()
                    local, texts, ids, held, size = {}, [], [], [], 0
                    chunk += 1
        if ids:
            yield closed()

    schema = "chunk long, path string, tokens long, train_tokens long, train_docs long"
    return cut(docs.select(F.col(key).cast("long").alias("doc_id"), held_out(key, 7).alias("held_out"), F.col(text).alias("_t")).mapInArrow(run, schema))


def shortened(index: np.ndarray, repeated: int) -> np.ndarray:
    """Numbers of words as they are kept: words met once come last and stand in the order of their numbers, so 0 is enough for them."""
    return np.where(index >= repeated, 0, index + 1).astype(np.uint32)


def lengthened(index: np.ndarray, words: int) -> np.ndarray:
    once = np.flatnonzero(index == 0)
    out = index - np.uint32(1)
    out[once] = np.arange(words - len(once), words, dtype=np.uint32)
    return out


class Request:
    """What a chunk asks at one depth: its distinct (context, next word) pairs, sorted by bucket and context."""

    def __init__(self, some: np.ndarray, code: np.ndarray, bucket: np.ndarray, ctx: np.ndarray, gram: np.ndarray | None, count: np.ndarray | None, whole: np.ndarray | None, logp: np.ndarray | None):
        self.some, self.code, self.bucket, self.ctx, self.gram, self.count, self.whole, self.logp = some, code, bucket, ctx, gram, count, whole, logp
        self.edges = np.flatnonzero(np.diff(np.r_[-1, bucket])) if len(bucket) else np.zeros(0, np.int64)
        #: Where another context, or another part of a hot one, begins.
        self.starts = np.flatnonzero(np.r_[True, (np.diff(bucket) != 0) | (np.diff(ctx) != 0)]) if len(bucket) else np.zeros(0, np.int64)

    def payloads(self, buckets: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, arrays): words as gaps and upper bits, and counts; or contexts as gaps, their numbers of pairs, which of them are rare, the next words of rare and other ones as gaps,
        counts, probabilities by the suffix in eighths of a nat (0 without a count, then another chunk knows it or none need)."""
        gaps = lambda v: np.diff(v, prepend=v.dtype.type(0))
        for a, z in zip(self.edges, [*self.edges[1:], len(self.bucket)]):
            bucket = int(self.bucket[a])
            if self.gram is None:
                yield bucket, packed(gaps(self.ctx[a:z] & _48), (self.ctx[a:z] >> _U(48)).astype(np.uint16), self.count[a:z])
                continue
            starts = self.starts[np.searchsorted(self.starts, a) : np.searchsorted(self.starts, z)]
            low = np.where(self.count[a:z], np.clip(np.rint(self.logp[a:z] * -8), 0, 255), 0).astype(np.uint8)
            runs, gram, narrow = np.diff(np.r_[starts, z]).astype(np.uint32), self.gram[a:z], self.whole[a:z] <= NARROW
            wide = (gram[~narrow] >> np.where(self.whole[a:z][~narrow] <= MIDDLE, _U(8), _U(0))).astype(np.uint32)
            arrays = [gaps(self.ctx[starts]), runs, np.packbits(self.whole[starts] <= NARROW), gaps((gram[narrow] >> _U(16)).astype(np.uint16)), gaps(wide), self.count[a:z], low]
            yield bucket, packed(*arrays, *([self.whole[starts]] if bucket >= buckets else []))


def range_of(h48: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets as ranges of hashes, so that rows sorted by hash are sorted by bucket."""
    return (((h48 >> _U(16)) * _U(buckets)) >> _U(32)).astype(np.int64)


def order_of(spot: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
    """The order of numbers, equal ones by the upper of ``then``'s 32 bits and as they stand. Places are sorted along in the lower
    bits, which is faster than an indirect sort and the same on every machine. Of 49-bit numbers the lowest bits (at most 16) may
    have no room and don't count, so that the order of buckets always holds and a context may rarely be dealt in two stretches."""
    bits = max(1, (len(spot) - 1).bit_length())
    free = 64 - bits - int(spot.max(initial=0)).bit_length()
    key = spot >> _U(max(0, -free))
    if then is not None and free > 0:
        key = key << _U(min(32, free)) | then >> _U(max(0, 32 - free))
    key = key << _U(bits) | np.arange(len(spot), dtype=np.uint64)
    key.sort()
    return (key & _U((1 << bits) - 1)).astype(np.int64)


def numbered(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of equal keys, and the first place of each number. Sorted with their places in the lower bits where these have room."""
    n = len(key)
    bits = max(1, (n - 1).bit_length())
    if int(key.max(initial=0)) >> (64 - bits):
        code, _ = pd.factorize(key)
        return code, np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0)
    key = (key << _U(bits)) | np.arange(n, dtype=np.uint64)
    key.sort()
    place = (key & _U((1 << bits) - 1)).astype(np.int64)
    key >>= _U(bits)
    first = np.ones(n, bool)
    np.not_equal(key[1:], key[:-1], out=first[1:])
    code = np.empty(n, np.int32)
    code[place] = np.cumsum(first, dtype=np.int32) - 1
    return code, place[first]


class Chunk:
    """One chunk's tokens, and what the answers so far say of each of them."""

    def __init__(self, raw: bytes, tokens: int, types: int, train_docs: int, upper: bytes | None = None):
        self.ids, self.real, self.held, self.ends, self.index, self.words = unpacked(raw)
        self.index = lengthened(self.index, len(self.words))
        if upper is not None:
            self.words = self.words | unpacked(upper)[0].astype(np.uint64) << _U(48)
        self.tokens, self.types, self.train_docs = tokens, types, train_docs
        self.start = np.cumsum(self.ends) - self.ends
        self.at = np.arange(len(self.index), dtype=np.int32) - np.repeat(self.start.astype(np.int32), self.ends)
        self.train = np.repeat(~self.held, self.ends)
        #: Per token: natural log probability; number and training count of the pair of the last depth (number -1: not asked),
        #: and the number of next words of its context if that is kept, else 0.
        self.logp = self.code = self.seen = self.kinds = None

    def contexts(self, places: np.ndarray, depth: int) -> np.ndarray:
        """48-bit hashes of the last ``depth`` words before places; ``_START`` stands before a text."""
        out = np.full(len(places), _U(depth), np.uint64)
        for k in range(1, depth + 1):
            far = self.at[places] >= k
            out = mix(out * _P + np.where(far, self.words[self.index[np.where(far, places - k, 0)]], _START))
        return out & _48

    def request(self, depth: int, buckets: int, hot: int, sent: bool = True) -> Request:
        """What is asked; without counts, which the answers don't need, if it has been ``sent`` before."""
        n = len(self.index)
        if not depth:
            key = self.words & _48
            order = order_of(key)
            rank = np.empty(len(order), np.int32)
            rank[order] = np.arange(len(order), dtype=np.int32)
            count = np.bincount(self.index[self.train], minlength=len(self.words)).astype(np.uint32)
            return Request(np.arange(n), rank[self.index], range_of(key[order], buckets), self.words[order], None, count[order], None, None)
        # A context is the pair of the depth before that ends right before the token.
        before, whole = np.empty(n, np.int32), np.empty(n, np.int64)
        before[1:], whole[1:] = self.code[:-1], self.seen[:-1]
        before[self.start], whole[self.start] = (len(self.words), self.train_docs) if depth == 1 else (-1, 0)
        known = (before >= 0) & (whole >= SUPPORT)
        some = np.flatnonzero((self.kinds > 1) & known)
        # What always follows a context's suffix always follows the context: the longer pair is as frequent as the context itself.
        sure = np.flatnonzero((self.kinds == 1) & known & (self.seen > 0))
        self.sure = sure, before[sure], whole[sure]
        code, new = numbered(before[some].astype(np.uint64) * _U(len(self.words)) + self.index[some])
        places = some[new]
        # Pairs of a context mostly stand together, so that contexts are hashed and sorted rather than pairs.
        head = np.flatnonzero(np.diff(before[places], prepend=-1))
        spot, length, whole = self.contexts(places[head], depth), np.diff(head, append=len(places)), whole[places]
        ctx, over = np.repeat(spot, length), whole > hot
        gram = mix(ctx * _Q + self.words[self.index[places]])
        parted = over.any()
        if parted:
            parts = -(-whole // hot)
            piece = np.where(over, (gram & _24) % np.maximum(parts, 1).astype(np.uint64), 0).astype(np.uint64)
            spot, length = np.where(over, mix(ctx + piece * _P) & _48, ctx) | (over.astype(np.uint64) << _U(48)), 1
        gram >>= _U(32)
        order, stretch = order_of(spot), np.empty(len(spot), np.uint64)
        stretch[order] = np.cumsum(np.diff(spot[order], prepend=_U(0)) != 0)
        # Next words of a context by their hashes, so that small gaps are sent.
        order = order_of(np.repeat(stretch, length), gram)
        spot = np.repeat(spot, length)[order]
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        bucket = range_of(spot & _48, buckets)
        if parted:
            bucket += np.where(over[order], buckets, 0)
        count = np.bincount(code[self.train[some]], minlength=len(new)).astype(np.uint32)[order] if sent else None
        return Request(some, rank[code], bucket, ctx[order], gram[order], count, whole[order], self.logp[places[order]])

    def told(self, depth: int, buckets: int, hot: int, answers: dict[int, list], hot_kept: dict) -> None:
        """Takes in the answers of a depth: ``answers`` maps a bucket to its arrays."""
        r = self.request(depth, buckets, hot, sent=False)
        join = lambda i: np.concatenate([answers[int(r.bucket[a])][i] for a in r.edges]).astype(np.int64) if len(r.edges) else np.zeros(0, np.int64)
        count, n = join(0), len(self.index)
        if not depth:
            logp = np.log((count + 1) / (self.tokens + self.types + 1))
            self.code, self.seen, self.kinds, self.logp = self.index.astype(np.int32), count[r.code], np.full(n, 2, np.int32), logp[r.code]
            self.known, self.base = self.seen > 0, self.logp / np.log(10)
            return
        kinds = join(1)
        for i in np.flatnonzero(r.bucket[r.starts] >= buckets):  # hot contexts: the sums of their parts decide
            kinds[i] = hot_kept.get(int(r.ctx[r.starts[i]]), 0)
        kinds = np.repeat(kinds, np.diff(np.r_[r.starts, len(r.bucket)])).astype(np.int32)
        # The number of next words of a context that is kept; 0 if it is not. A pair has one probability, wherever it stands.
        ok, logp = np.flatnonzero(kinds), r.logp
        whole = np.maximum(r.whole[ok], 1)
        logp[ok] = np.log(np.maximum(count[ok] - DISCOUNT, 0) / whole + DISCOUNT * kinds[ok] / whole * np.exp(logp[ok]))
        self.logp[r.some] = logp[r.code]
        sure, before, whole = self.sure
        self.code, self.seen, self.kinds = np.full(n, -1, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int32)
        self.code[sure], self.seen[sure] = len(r.bucket) + before, whole
        self.code[r.some], self.seen[r.some], self.kinds[r.some] = r.code, count[r.code], kinds[r.code]


def merged(payloads: list[bytes], depth: int, parted: bool, hot: int) -> tuple[list[bytes], list[tuple[int, float, int]]]:
    """The answers to a bucket's requests in their order, and of hot contexts (context, gain, next words) in this bucket."""
    parts = [unpacked(p) for p in payloads]
    column = lambda i: np.concatenate([p[i] for p in parts])
    if not depth:
        code, words = pd.factorize(np.concatenate([np.cumsum(p[0], dtype=np.uint64) | p[1].astype(np.uint64) << _U(48) for p in parts]))
        total = np.bincount(code, column(2), len(words)).astype(np.int64)
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        return [packed(total[code[a:z]]) for a, z in zip(cuts, cuts[1:])], [(0, 0.0, int((total > 0).sum()))]
    for p in parts:
        narrow = np.repeat(np.unpackbits(p[2], count=len(p[0])).astype(bool), p[1])
        gram = np.empty(len(narrow), np.uint32)
        gram[narrow], gram[~narrow] = np.cumsum(p[3], dtype=np.uint16), np.cumsum(p[4], dtype=np.uint32)
        p[0], p[2:5] = np.cumsum(p[0], dtype=np.uint64), [gram]
    at, ctx = pd.factorize(column(0))
    row = np.repeat(at, column(1))
    code, keys = pd.factorize(row.astype(np.uint64) << _U(32) | column(2).astype(np.uint64))
    new = np.flatnonzero(np.diff(np.maximum.accumulate(code), prepend=-1) > 0)
    row, low, count = row[new], np.zeros(len(keys)), column(3)
    low[code[count > 0]] = column(4)[count > 0]
    low, total = np.exp(low / -8.0), np.bincount(code, count, len(keys))
    whole, kinds = np.bincount(row, total, len(ctx)), np.bincount(row, total > 0, len(ctx))
    whole_all, kinds_all = whole, kinds
    if parted:  # next words are dealt by hash, so each part has about as many
        whole_all = np.zeros(len(ctx))
        whole_all[at] = column(5)
        kinds_all = kinds * np.ceil(whole_all / hot)
    # Each occurrence is predicted from the others of its context, and compared with the suffix.
    left = np.maximum(whole_all[row] - 1, 1)
    p = np.maximum(total - 1 - DISCOUNT, 0) / left + DISCOUNT * kinds_all[row] / left * low
    gain = np.bincount(row, total * np.log(np.maximum(p, 1e-300) / low), len(ctx))
    kept = np.where((whole_all >= SUPPORT) & (gain > MARGIN), kinds, 0).astype(np.uint32)
    total, out, a, g = total.astype(np.uint32 if total.max(initial=0) < 2**32 else np.uint64), [], 0, 0
    for p in parts:
        n = int(p[1].sum())
        out.append(packed(total[code[a : a + n]], kept[at[g : g + len(p[0])]]))
        a, g = a + n, g + len(p[0])
    return out, [(int(c), float(x), int(k)) for c, x, k in zip(ctx, gain, kinds)] if parted else []


# ---- exchanges


def laid(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """(bucket, answer) of a file beside a chunk."""
    at = 0
    while at < len(raw):
        b, n = struct.unpack_from("<qq", raw, at)
        yield b, raw[at + 16 : at + 16 + n]
        at += 16 + n


def let_go(spark: SparkSession) -> None:
    """Has the driver collect what nothing refers to, upon which Spark removes the files of finished exchanges. Disk is freed earlier
    by it, nothing else depends on it."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, hot: int = HOT) -> DataFrame:
    """One row a document: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    A null or empty text is the end alone; repeated rows are scored each (and counted each, in training); a null id stays
    null; an empty table gives none; other columns are ignored. Ids are integers. White space carries no probability.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark).rstrip('/')}/lm-{uuid.uuid4().hex}"
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    buckets = max(8, -(-int(size) // BUCKET_BYTES))
    chunks = chunked(docs, key, text, folder)
    tokens, train_docs, n_chunks = chunks.agg(F.coalesce(F.sum("train_tokens"), F.lit(0)), F.coalesce(F.sum("train_docs"), F.lit(0)), F.count("*")).first()
    # So many occurrences a part that there are never more than HOT_ROWS hot contexts.
    hot = max(hot, int(tokens) // HOT_ROWS)
    facts = {"tokens": int(tokens), "train_docs": int(train_docs), "types": 0}
    kept_hot: list = []

    def loaded(path: str, upto: int, facts: dict, tables: list) -> Chunk:
        """A chunk with the answers of the depths before ``upto``, which lie beside it, taken in."""
        system, _ = file_system(folder)

        def read(at: str) -> bytes:
            with system.open_input_file(at) as f:
                return f.read()

        c = Chunk(read(path), **facts, upper=None if upto else read(f"{path}-upper"))
        for d in range(upto):
            c.told(d, buckets, hot, {b: unpacked(p) for b, p in laid(read(f"{path}-{d}"))}, tables[d].value if d else {})
        return c

    def forgotten(rows) -> None:
        system, _ = file_system(folder)
        for r in rows:
            if system.get_file_info(f"{r['path']}-upper").is_file:
                system.delete_file(f"{r['path']}-upper")

    def by_chunk(f, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for chunk, path in zip(b.column("chunk").to_pylist(), b.column("path").to_pylist()):
                    yield from f(chunk, path).to_batches()

        return chunks.select("chunk", "path").repartition(max(1, n_chunks), "chunk").mapInArrow(run, schema)

    def asking(d: int, now: dict, tables: list):
        def ask(chunk: int, path: str) -> pa.Table:
            cols = list(zip(*loaded(path, d, now, tables).request(d, buckets, hot).payloads(buckets))) or [[], []]
            return pa.table({"chunk": pa.array([chunk] * len(cols[0]), pa.int64()), "bucket": pa.array(cols[0], pa.int32()), "payload": pa.array(cols[1], pa.binary())})

        return ask

    def answering(d: int):
        def answer(t: pa.Table) -> pa.Table:
            t = t.sort_by("chunk")  # floating sums don't depend on the order of arrival
            bucket = t.column("bucket")[0].as_py()
            out, told = merged(t.column("payload").to_pylist(), d, bucket >= buckets, hot)
            n, m = len(out), len(told)
            # Parts of hot contexts meet under numbers that no chunk has.
            to = [*t.column("chunk").to_pylist(), *[-1 - x[0] % SUMS for x in told]]
            return pa.table({"chunk": pa.array(to, pa.int64()), "bucket": pa.array([bucket] * (n + m), pa.int32()), "payload": pa.array([*out, *[None] * m], pa.binary()), "ctx": pa.array([None] * n + [x[0] for x in told], pa.int64()), "gain": pa.array([None] * n + [x[1] for x in told], pa.float64()), "kinds": pa.array([None] * n + [x[2] for x in told], pa.int64())})

        return answer

    def laying(d: int):
        def lay(left: pa.Table, right: pa.Table) -> pa.Table:
            """Lays a chunk's answers beside its file (the same bytes whenever a task is repeated), or sums up parts of hot contexts."""
            if not left.num_rows:
                t = right.select(["ctx", "gain", "kinds"]).sort_by([("ctx", "ascending"), ("gain", "ascending"), ("kinds", "ascending")])
                sums = t.group_by("ctx", use_threads=False).aggregate([("gain", "sum"), ("kinds", "sum")])
                return pa.table({"ctx": sums.column("ctx"), "gain": sums.column("gain_sum"), "kinds": sums.column("kinds_sum")})
            system, _ = file_system(folder)
            at = f"{left.column('path')[0].as_py()}-{d}"
            part = f"{at}.{uuid.uuid4().hex[:8]}"
            with system.open_output_stream(part) as f:
                for b, p in sorted(zip(right.column("bucket").to_pylist(), right.column("payload").to_pylist())):
                    f.write(struct.pack("<qq", b, len(p)) + p)
            system.move(part, at)
            return pa.table({"ctx": pa.array([], pa.int64()), "gain": pa.array([], pa.float64()), "kinds": pa.array([], pa.int64())})

        return lay

    for d in range(depth + 1):
        asked = by_chunk(asking(d, dict(facts), list(kept_hot)), "chunk long, bucket int, payload binary")
        answers = asked.groupBy("bucket").applyInArrow(answering(d), "chunk long, bucket int, payload binary, ctx long, gain double, kinds long")
        # Written rather than collected: a frame that is collected holds on to its exchanges, a command lets them go.
        chunks.select("chunk", "path").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(laying(d), "ctx long, gain double, kinds long").write.parquet(f"{folder}/told-{d}")
        sums = spark.read.parquet(f"{folder}/told-{d}")
        if d == 0:
            facts["types"] = sum(r["kinds"] for r in sums.collect())  # one row
            chunks.select("path").foreachPartition(forgotten)
            kept_hot.append(None)
        else:
            # At most HOT_ROWS contexts are hot, 16 bytes each.
            kept_hot.append(spark.sparkContext.broadcast({r["ctx"]: r["kinds"] for r in sums.where(F.col("gain") > MARGIN).select("ctx", "kinds").collect()}))
        # Every chunk has its answers by now, and the exchanges of this depth are done with.
        del asked, answers, sums
        let_go(spark)

    now, tables = dict(facts), list(kept_hot)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def scored(_chunk: int, path: str) -> pa.Table:
        c = loaded(path, depth + 1, now, tables)
        known, base, p = (np.add.reduceat(v, c.start) for v in (c.known.astype(np.int64), c.base, c.logp / np.log(10)))
        return pa.table({"doc_id": pa.array(c.ids, mask=~c.real), "held_out": pa.array(c.held), "n_tokens": pa.array(c.ends), "n_known": pa.array(known), "train_tokens": pa.array(np.full(len(c.ids), now["tokens"], np.int64)), "base_score": pa.array(base), "score": pa.array(p)})

    return by_chunk(scored, schema)
