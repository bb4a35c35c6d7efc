"""Best-fit packing of token sequences by a grouping genetic algorithm on islands.

Pieces are dealt by hash into blocks of bounded size. Each block evolves on several islands, each a task of its own: crossover
injects whole well-filled bins of one parent into another, drops the bins that share a piece with them, and best-fits the
displaced pieces. After an epoch every island's elite migrates to the next island of its block, and evolution goes on. Fewer bins
are fitter, then fuller ones, so that what room is left gathers in few bins. Bins that are not well filled are taken apart and
dealt into new blocks, over which the same is done, until one block holds all of them.
"""

from __future__ import annotations

import bisect
import itertools
import math
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts_of

CAPACITY = 2048
#: Pieces a block; the islands of a block and how long they evolve.
BLOCK, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 3000, 2, 2, 4, 4
#: Bins filled less than this are packed again in a next round; rounds end when one block holds all, or when one has settled so
#: small a share of its pieces that dealing them anew frees next to none.
WELL_FILLED, SETTLED = 0.97, 0.02
#: White space from this length on goes to the slower encoder, which has no recursion in its patterns.
LONG_SPACE = 4096


@lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a tokenizers file with its added tokens as an encoder: the same ids, several times as fast."""
    import json

    import tiktoken
    from tokenizers.pre_tokenizers import ByteLevel

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    vocab, added = whole["model"]["vocab"], {x["content"]: x for x in whole.get("added_tokens") or []}
    # Others would take white space or stand only between words, which the encoder can't say.
    assert not any(x.get(k) for x in added.values() for k in ("lstrip", "rstrip", "single_word"))
    # Byte-level vocabularies write byte b as its own character if that is printable, else as the next free one from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    byte = {chr(b if b in set(printable) else next(rest)): b for b in range(256)}
    assert set(byte) == set(ByteLevel.alphabet())
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items() if all(c in byte for c in t) and t not in added}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={t: x["id"] for t, x in added.items()})


@lru_cache(2)
def plain_encoder(path: str):
    """The tokenizers file read by its own library."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


_SPACE = re.compile(r"\s{%d}" % LONG_SPACE)


def ids_of(path: str, text: str) -> list[int]:
    """A text's ids; those of very long runs of white space, on which the fast encoder's patterns overflow, by the library itself."""
    if _SPACE.search(text):
        return plain_encoder(path).encode(text, add_special_tokens=False).ids
    return encoder(path).encode(text, allowed_special="all")


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids: all full but for a shorter first one."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def best_fit(lengths: list[int], order: list[int], bins: list[list[int]], room: list[int], capacity: int) -> None:
    """Puts the pieces in ``order`` each into the fullest bin that has room, opening bins as needed."""
    free = sorted((r, i) for i, r in enumerate(room) if r > 0)
    for x in order:
        n = lengths[x]
        at = bisect.bisect_left(free, (n, -1))
        if at < len(free):
            r, i = free.pop(at)
            bins[i].append(x)
        else:
            i, r = len(bins), capacity
            bins.append([x])
            room.append(capacity)
        room[i] = r - n
        if r > n:
            bisect.insort(free, (r - n, i))


def fitness(bins: list[list[int]], lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the mean square of how full they are, negated: smaller is fitter."""
    fill = [sum(lengths[x] for x in b) / capacity for b in bins]
    return len(bins), -sum(f * f for f in fill)


def crossover(a: list[list[int]], b: list[list[int]], lengths: list[int], capacity: int, rng: np.random.Generator) -> list[list[int]]:
    """A child: ``a`` with whole well-filled bins of ``b`` in place of those that share a piece with them."""
    full = [x for x in b if sum(lengths[i] for i in x) >= WELL_FILLED * capacity]
    if not full:
        full = b
    want = [full[i] for i in rng.permutation(len(full))[: max(1, len(full) // 3)]]
    given = {x for w in want for x in w}
    kept, loose = [], []
    for x in a:
        if given.isdisjoint(x):
            kept.append(list(x))
        else:
            loose += [i for i in x if i not in given]
    # Bins that are far from full are opened as well, as a mutation: their pieces may close others' gaps.
    slack = [capacity - sum(lengths[i] for i in x) for x in kept]
    drop = {i for i, s in enumerate(slack) if s > 0.05 * capacity and rng.random() < 0.3}
    loose += [x for i in drop for x in kept[i]]
    bins = [x for i, x in enumerate(kept) if i not in drop] + [list(w) for w in want]
    room = [capacity - sum(lengths[i] for i in x) for x in bins]
    best_fit(lengths, sorted(loose, key=lambda i: (-lengths[i], i)), bins, room, capacity)
    return bins


def seedling(lengths: list[int], capacity: int, rng: np.random.Generator, plain: bool) -> list[list[int]]:
    jitter = np.array(lengths, float) * (1 if plain else rng.uniform(0.9, 1.1, len(lengths)))
    bins: list[list[int]] = []
    best_fit(lengths, np.argsort(-jitter, kind="stable").tolist(), bins, [], capacity)
    return bins


def evolve(lengths: list[int], migrants: list[list[list[int]]], seed: int, capacity: int = CAPACITY, generations: int = GENERATIONS, population: int = POPULATION) -> list[list[int]]:
    rng = np.random.default_rng(seed)
    lower = -(-sum(lengths) // capacity)
    key = lambda b: fitness(b, lengths, capacity)
    people = [*migrants]
    while len(people) < population:
        people.append(seedling(lengths, capacity, rng, plain=not people))
    people.sort(key=key)
    for _ in range(generations):
        # Nothing is left to gain when all bins but one are full.
        if len(people[0]) <= lower and sum(sum(lengths[x] for x in b) < capacity for b in people[0]) <= 1:
            break
        i, j = 0, int(rng.integers(1, len(people)))
        children = [crossover(people[i], people[j], lengths, capacity, rng), crossover(people[j], people[i], lengths, capacity, rng)]
        people = sorted(people + children, key=key)[:population]
    return people[0]


def labels(bins: list[list[int]], n: int) -> list[int]:
    out = [0] * n
    for i, b in enumerate(bins):
        for x in b:
            out[x] = i
    return out


def grouped(label: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(label, default=-1) + 1)]
    for x, i in enumerate(label):
        bins[i].append(x)
    return [b for b in bins if b]


def tokenized(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        for b in slices(batches, "_t"):
            at, out = [], []
            for row, t in enumerate(texts_of(b.column("_t"))):
                ids = np.array(ids_of(tokenizer, t), "<u4").tobytes() + end
                for piece, (start, n) in enumerate(cuts(len(ids) // 4, capacity)):
                    at.append(row)
                    out.append((piece, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(cols[0], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.select(F.col(key)).dtypes[0][1]
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("_t")).mapInArrow(pieces, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS, seed: int = 11) -> DataFrame:
    """One row a piece: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null or empty text is one piece of the end id alone; repeated rows are packed each; equal lengths fall in the order
    of their block; an empty table gives none; other columns are ignored. ``tokenizer`` is a file of byte-level BPE.
    """
    every = cut(tokenized(docs, tokenizer, key, text, capacity).withColumn("row", F.monotonically_increasing_id()))
    done = every.where(F.col("length") >= capacity).select("doc_id", "piece", "start", "length", "ids_crc32", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    some, left = every.where(F.col("length") < capacity), math.inf
    for turn in itertools.count():
        n = some.count()
        blocks = -(-n // block)
        if not n:
            break
        placed = cut(packed(some.select("row", "doc_id", "piece", "start", "length", "ids_crc32"), blocks, capacity, islands, epochs, seed, turn))
        # The last round keeps all its bins. Each other one leaves fewer pieces by a share, so there are at most log(n) of them.
        last = blocks == 1 or n > left * (1 - SETTLED)
        well = F.lit(last) | (F.col("fill") >= int(WELL_FILLED * capacity))
        done = done.unionByName(placed.where(well).drop("row", "fill"))
        if last:
            break
        some, left = placed.where(~well), n
    return done


def packed(some: DataFrame, blocks: int, capacity: int, islands: int, epochs: int, seed: int, turn: int) -> DataFrame:
    """The pieces with ``sequence_id``, ``offset`` and the ``fill`` of their bin, dealt into ``blocks`` and evolved."""
    spark = some.sparkSession
    item = F.struct("row", "doc_id", "piece", "start", "length", "ids_crc32")
    # The hash deals pieces evenly, so a block's array stays near its size at every input size.
    dealt = cut(some.withColumn("block", F.pmod(F.xxhash64(F.lit(seed + turn), "row"), F.lit(blocks))).groupBy("block").agg(F.array_sort(F.collect_list(item)).alias("items")))
    lengths = F.transform("items", lambda x: x["length"].cast("int")).alias("lengths")
    on_islands = dealt.select("block", lengths, F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast("array<array<int>>").alias("migrants"))
    schema = "block long, island int, label array<int>, n int, fit double"
    spread = max(1, min(blocks * islands, max(12, int(spark.conf.get("spark.sql.shuffle.partitions")))))

    def epoch(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for r in b.to_pylist():
                    n = r["lengths"]
                    bins = evolve(n, [grouped(m) for m in r["migrants"] or []], zlib.crc32(f"{seed}|{turn}|{k}|{r['block']}|{r['island']}".encode()), capacity)
                    size, fit = fitness(bins, n, capacity)
                    yield pa.RecordBatch.from_arrays([pa.array([r["block"]], pa.int64()), pa.array([r["island"]], pa.int32()), pa.array([labels(bins, len(n))], pa.list_(pa.int32())), pa.array([size], pa.int32()), pa.array([fit])], names=["block", "island", "label", "n", "fit"])

        return run

    for k in range(epochs):
        elite = cut(on_islands.repartition(spread, "block", "island").select("block", "island", "lengths", "migrants").mapInArrow(epoch(k), schema))
        if k + 1 < epochs:
            came = elite.select("block", F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"), "label").groupBy("block", "island").agg(F.array_sort(F.collect_list("label")).alias("migrants"))
            on_islands = dealt.select("block", lengths).join(came, "block")
    best = elite.groupBy("block").agg(F.min(F.struct("n", "fit", "island", "label")).alias("b")).select("block", "b.label")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for blk, items, lab in zip(*(b.column(c) for c in ("block", "items", "label"))):
                v, label = items.values, np.array(lab.values)
                n = v.field("length").to_numpy()
                order = np.argsort(label, kind="stable")
                ends = np.cumsum(n[order])
                first = np.r_[True, np.diff(label[order]) != 0] if len(order) else np.zeros(0, bool)
                base = np.maximum.accumulate(np.where(first, ends - n[order], 0))
                offset = np.empty(len(n), np.int64)
                offset[order] = ends - n[order] - base
                seq = (np.int64(turn) << np.int64(56)) + (np.int64(blk.as_py()) << np.int64(24)) + label.astype(np.int64)
                fill = np.bincount(label, n).astype(np.int64)[label]
                names = ["row", "doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays([*(v.field(x) for x in names), pa.array(seq), pa.array(offset), pa.array(fill)], names=[*names, "sequence_id", "offset", "fill"])

    kind = dict(some.dtypes)["doc_id"]
    return dealt.join(best, "block").select("block", "items", "label").mapInArrow(place, f"row long, doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long")
