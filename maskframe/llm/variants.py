"""Spelling variants: words at one inserted, deleted or replaced code point, grouped under their most frequent form.

Words are counted where they stand, a task at a time, and meet by keys: polynomial hashes of the word, of the word without one of its
code points, and of the word with one of them left open, all made at once by numpy from prefix and suffix hashes. Keys are dealt to
small radix buckets, sorted, and equal ones are verified on the strings. Nothing is paired: a group of words that differ in one
place only needs its size and its two most frequent words, and a word that others are without one code point stands in a star
with them.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, cut, n_parts, slices, texts_of

#: The letters of words.
LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One in so many occurrences loses a code point.
THINNED = 31
#: Distinct words that a task gathers before it hands them on, and code points that are read at once.
GATHERED, WINDOW = 200_000, 1 << 20
#: Keys a radix bucket, and code points whose keys are made at once.
BUCKET_KEYS, CODES = 1 << 16, 1 << 18

_BASE = np.uint64(0x9E3779B97F4A7C15)  # any odd number; its inverse undoes a shift
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over all of them, so that the first bits can deal buckets."""
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(k)
    return x ^ (x >> np.uint64(32))


#: Every Latin-1 code point as a number of 64 random bits.
CODE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def counted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: distinct words of the length and the count asked for."""
    run, other = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}"), re.compile(f"[^{LETTERS}]")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        for b in slices(batches, "_t"):
            for k, t in zip(b.column("_s").to_pylist(), texts_of(b.column("_t"))):
                start, at = zlib.crc32(f"{k or ''}:".encode()), 0
                while at < len(t):
                    # A window ends where no run of letters does.
                    m = other.search(t, at + WINDOW)
                    upto = m.start() if m else len(t)
                    for raw, n in Counter(run.findall(t, at, upto)).items():
                        low = raw.encode().translate(LOWER_AZ)
                        h, word = zlib.crc32(low, start), low.decode()
                        if h % THINNED == 0:
                            i = h % len(word)
                            word = word[:i] + word[i + 1 :]
                        if len(word) >= LEAST_LENGTH:
                            found[word] += n
                    at = upto
                if len(found) >= GATHERED:
                    yield handed(found)
                    found.clear()
        yield handed(found)

    def handed(found: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(F.col(key).cast("string").alias("_s"), F.col(text).alias("_t"))
    return rows.mapInArrow(words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)


def keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the word, key, place) of all keys of the words.

    Place -1: the word itself. Place i >= 0: the word without its i-th code point, of equal neighbours only the first,
    so that each shorter word comes up once. Place -2 - i: the word with its i-th code point left open.
    """
    codes = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    n = np.array([len(w) for w in words])
    end = np.cumsum(n)
    start = end - n
    up, back = powers(_BASE, len(codes)), powers(_BACK, len(codes) + 1)
    upto = np.r_[np.uint64(0), np.cumsum(CODE[codes] * up[:-1], dtype=np.uint64)]
    word = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(codes))
    s, e = start[word], end[word]
    # What stands before the code point, and what stands behind it moved up by one place.
    without = (upto[at] - upto[s]) * back[s] + (upto[e] - upto[at + 1]) * back[s + 1]
    itself = (upto[end] - upto[start]) * back[start]
    place = at - s
    length = lambda k: np.asarray(k).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    open_at = mixed(without ^ length(n[word]) ^ mixed(place.astype(np.uint64) + np.uint64(1)))
    first = (place == 0) | (codes != np.r_[np.uint8(0), codes[:-1]])
    return (
        np.r_[np.arange(len(words)), word[first], word],
        np.r_[mixed(itself ^ length(n)), mixed(without ^ length(n[word] - 1))[first], open_at],
        np.r_[np.full(len(words), -1), place[first], -2 - place],
    )


def keyed(words: DataFrame, bits: int) -> DataFrame:
    """``bucket, word, n, keys, places``: every word once for each radix bucket that one of its keys falls into."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "word", CODES):
            if not b.num_rows:
                continue
            word, key, place = keys(b.column("word").to_pylist())
            bucket = (key >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(key), np.int64)
            order = np.lexsort((bucket, word))
            word, key, place, bucket = word[order], key[order], place[order], bucket[order]
            new = np.r_[True, (np.diff(word) != 0) | (np.diff(bucket) != 0)]
            at = pa.array(np.r_[np.flatnonzero(new), len(key)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[new]), *(b.column(c).take(pa.array(word[new])) for c in ("word", "n")), pa.ListArray.from_arrays(at, pa.array(key.view(np.int64))), pa.ListArray.from_arrays(at, pa.array(place, pa.int32()))], names=["bucket", "word", "n", "keys", "places"])

    return words.select("word", "n").mapInArrow(run, "bucket long, word string, n long, keys array<long>, places array<int>")


def met(words: list[str], counts: list[int], owner: np.ndarray, key: np.ndarray, place: np.ndarray) -> dict[int, list]:
    """Near words of one bucket's words: index to [how many, count of the most frequent, that word]."""
    out: dict[int, list] = {}

    def add(i: int, n: int, best: int) -> None:
        it = out.setdefault(i, [0, 0, None])
        it[0] += n
        if (-counts[best], words[best]) < (-it[1], it[2] or ""):
            it[1:] = counts[best], words[best]

    order = np.argsort(key, kind="stable")
    ordered = key[order]
    bounds = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1], True])
    for a, b in zip(bounds[:-1][np.diff(bounds) > 1].tolist(), bounds[1:][np.diff(bounds) > 1].tolist()):
        # Equal keys are verified: groups are of equal strings and places.
        rest: dict[tuple, list[int]] = {}
        for x in order[a:b].tolist():
            w, p = words[owner[x]], int(place[x])
            i = p if p >= 0 else -2 - p
            pattern = (w,) if p == -1 else (w[:i] + w[i + 1 :],) if p >= 0 else (w[:i], w[i + 1 :])
            rest.setdefault(pattern, []).append(x)
        for pattern, group in rest.items():
            if len(group) < 2:
                continue
            if len(pattern) == 2:
                top = sorted((int(owner[x]) for x in group), key=lambda i: (-counts[i], words[i]))
                for i in top:
                    add(i, len(top) - 1, top[0] if i != top[0] else top[1])
            else:
                whole = [int(owner[x]) for x in group if place[x] == -1]
                for x in group if whole else []:
                    if place[x] >= 0:
                        add(whole[0], 1, int(owner[x]))
                        add(int(owner[x]), 1, whole[0])
    return out


def links(words: DataFrame) -> DataFrame:
    """``word, n_near, best``: near words of all that have any; ``best`` is the most frequent, as (minus its count, word)."""
    size = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(0, int(size // BUCKET_KEYS).bit_length())
    parts = max(n_parts(words.sparkSession), -(-size // (16 * BUCKET_KEYS)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in by_bucket(batches):
            keys_, n = rows.column("keys").combine_chunks(), rows.num_rows
            owner = np.repeat(np.arange(n), np.diff(keys_.offsets.to_numpy()))
            found = met(rows.column("word").to_pylist(), rows.column("n").to_pylist(), owner, keys_.flatten().to_numpy(), rows.column("places").combine_chunks().flatten().to_numpy())
            at = list(found)
            near, best_n, best = zip(*found.values()) if found else ((),) * 3
            yield pa.RecordBatch.from_arrays([rows.column("word").combine_chunks().take(pa.array(at, pa.int64())), pa.array(near, pa.int64()), pa.array(best_n, pa.int64()), pa.array(best, pa.string())], names=["word", "near", "best_n", "best"])

    dealt = keyed(words, bits).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "word string, near long, best_n long, best string").groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best").alias("word"))).alias("best"))


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each bucket, of batches sorted by it; only one bucket is held."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        ids = b.column("bucket").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), b.num_rows]
        for x, y in zip(cuts, cuts[1:]):
            if held and x < y and held[-1].column("bucket")[0].as_py() != int(ids[x]):
                yield pa.Table.from_batches(held)
                held = []
            if x < y:
                held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def rooted(forms: DataFrame) -> DataFrame:
    """``word, root`` of (word, form): forms are followed to the last, twice as far each round.

    A form has at least :data:`TIMES` times its word's count, so that no chain of counts below 2^63 is longer than 18.
    """
    step = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        # A word whose root has itself a form goes on to that one's root.
        there = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        ahead = cut(step.join(there, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("_moved")))
        step = ahead.select("word", "root")
        if ahead.where("_moved").isEmpty():
            return step


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a word: ``word, form, root, n, n_near, form_n``.

    Words are runs of Latin letters in which only A-Z is lowered; one occurrence in 31, by a hash of key and run, loses a code
    point. Null texts have none, a null key counts as the empty text, repeated rows count each, runs may be of any length;
    the smallest word in code-point order wins ties; tables without words give none; other columns are ignored.
    """
    words = cut(counted(docs, key, text))
    near = cut(words.join(links(words), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.less") >= TIMES * F.col("n"), F.col("best")).alias("_f")).select("word", "n", "n_near", F.col("_f.word").alias("form"), (-F.col("_f.less")).alias("form_n")))
    roots = rooted(near.where("form is not null"))
    return near.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
