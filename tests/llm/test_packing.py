import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskframe.llm import packing
from maskframe.llm.queries import tokenizer_path

from .cases import EDGES, frame, rows


def ids_of(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]


def test_ids_are_those_of_the_file():
    texts = ["", "Hello, world!  It's 12 o'clock\n\n", "Über 漢字 🙂 <|endoftext|> x", " \t lead", "a" * 3000, " " * 20_000 + "x", "x\n" + "\n \t" * 9000, "\u3000" * 5000]
    r = np.random.default_rng(0)
    texts += ["".join(map(chr, r.integers(32, 0x2FFF, 40))) for _ in range(200)]
    assert [packing.ids_of(tokenizer_path(), t) + [0] for t in texts] == ids_of(texts)


@pytest.mark.parametrize("blank", [" ", "\n", "\r\n"])
def test_a_million_blanks_are_encoded(blank):
    text = "a" + blank * 1_000_000 + "b"
    assert packing.ids_of(tokenizer_path(), text) + [0] == ids_of([text])[0]


def test_crossover_beats_best_fit():
    """Sizes of a third of a bin or so: best fit leaves room that the evolved packings don't."""
    better = 0
    for seed in range(10):
        n = np.random.default_rng(seed).integers(30, 52, 120).tolist()
        plain = packing.seedling(n, 100, np.random.default_rng(seed), True)
        bins = packing.evolve(n, [], seed, 100, generations=30, population=10)
        assert len(bins) <= len(plain)
        better += len(bins) < len(plain)
    assert better >= 6


def test_underfilled_bins_of_all_blocks_are_packed_together(spark):
    data = [(i, "w " * (200 + 37 * (i % 11)), "en", "s", 1) for i in range(400)]
    got = packing.pack(frame(spark, data), tokenizer_path(), block=40).collect()
    total = sum(r["length"] for r in got)
    alone = packing.pack(frame(spark, data), tokenizer_path(), block=10**6).collect()
    n = lambda rows: len({r["sequence_id"] for r in rows})
    assert -(-total // packing.CAPACITY) <= n(got) <= n(alone) + 2
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in got) == Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in alone)


def test_every_id_is_placed_once(spark):
    data = rows(200) + EDGES + [(5000, "word " * 5000, "en", "s", 1)]
    got = packing.pack(frame(spark, data, clash=True), tokenizer_path(), block=64).collect()
    want = Counter()
    for x, ids in zip(data, ids_of([x[1] or "" for x in data])):
        for k, (start, n) in enumerate(packing.cuts(len(ids))):
            want[x[0], k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= packing.CAPACITY
    total = sum(r["length"] for r in got)
    assert len(bins) <= -(-total // packing.CAPACITY) + 2


def test_cuts():
    assert packing.cuts(5) == [(0, 5)] and packing.cuts(2048) == [(0, 2048)]
    assert packing.cuts(4100) == [(0, 4), (4, 2048), (2052, 2048)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]


@pytest.mark.parametrize("seed", range(5))
def test_evolution_never_loses_a_piece_nor_gets_worse(seed):
    rng = np.random.default_rng(seed)
    n = rng.integers(1, 2048, 200).tolist()
    plain = packing.seedling(n, 2048, rng, True)
    bins = packing.evolve(n, [plain], seed, generations=8)
    assert sorted(x for b in bins for x in b) == list(range(200))
    assert all(sum(n[x] for x in b) <= 2048 for b in bins)
    assert packing.fitness(bins, n, 2048) <= packing.fitness(plain, n, 2048)
    child = packing.crossover(bins, plain, n, 2048, rng)
    assert sorted(x for b in child for x in b) == list(range(200))
    assert packing.grouped(packing.labels(bins, 200)) == [sorted(b) for b in bins]


def test_empty_table(spark):
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_added_tokens_get_the_ids_of_the_unchanged_tokenizer(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n\n y", "<|endoftext", "plain  text"]
    want = [e.ids + [0] for e in t.encode_batch(texts, add_special_tokens=False)]
    assert want[0] == [64, 220, 50256, 275, 0]
    got = packing.pack(frame(spark, [(i, x, "en", "s", 1) for i, x in enumerate(texts)]), tokenizer_path()).collect()
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in got} == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(want)}
