import base64
import hashlib
import random
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from maskframe.llm import bpe, queries

from . import cases

SF = "/root/testdata/sf0.01"


@lru_cache(1)
def library():
    with open(queries.ranks_path(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


SIGNS = ["a", "b", "'", "s", "t", "re", "ll", "'ve", " ", "  ", "\n", "\t", "　", "\x85", "\x1c", "1", "٣", "!", "é", "中", "😀", "Ᲊ", "ɤ", "'S", "d", "́", "\x00", "<|endoftext|>"]


def made(n, size, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(SIGNS) for _ in range(r.randrange(0, size))) for _ in range(n)]


def test_ids_as_the_library():
    c = bpe.codec(queries.ranks_path())
    texts = [*made(5000, 60), "", " ", "  ", "x" * 5000, "\n" * 300, " " * 9000 + "a", "ab" * 4000]
    got = list(c.encode(texts))
    assert [g.tolist() for g in got] == [library().encode_ordinary(t) for t in texts]
    assert [c.decode(g) for g in got] == [t.encode() for t in texts]


def test_every_code_point_has_its_class():
    c = bpe.codec(queries.ranks_path())
    for start in range(0, bpe.STOP, 1 << 17):
        text = "".join(f"a{chr(i)}1{chr(i)}!{chr(i)}" for i in range(start, min(bpe.STOP, start + (1 << 17))) if not 0xD800 <= i < 0xE000)
        assert next(c.encode([text])).tolist() == library().encode_ordinary(text)


@pytest.mark.parametrize("window", [3, 10, 64])
def test_long_texts_window_by_window(monkeypatch, window):
    monkeypatch.setattr(bpe, "WINDOW", window)
    c = bpe.codec(queries.ranks_path())
    texts = [*made(10 * window, 120, seed=window), "x" * 400, "it's  's 're'" * 20]
    assert [g.tolist() for g in c.encode(texts)] == [library().encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("block", [1, 4, 512])
def test_scan_equals_reading_in_order(monkeypatch, block):
    monkeypatch.setattr(bpe, "BLOCK", block)
    r = np.random.default_rng(block)
    for n in (0, 1, 7, 3000):
        symbol = r.integers(0, 9, n).astype(np.uint8)
        for state in range(8):
            s, want = state, []
            for x in symbol.tolist():
                want.append(bool(bpe.STARTS[s * 10 + x]))
                s = int(bpe.TO[s * 10 + x])
            got, last = bpe.scan(symbol, state)
            assert got.tolist() == want and last == s


def test_heap_merges_as_the_short_way():
    c, r = bpe.codec(queries.ranks_path()), random.Random(3)
    for _ in range(300):
        piece = bytes(r.choice(b"aabcdeinorst") for _ in range(r.randrange(2, 120)))
        assert c.merged(piece) == c.merged_by_heap(piece)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED", 5)
    c = bpe.Codec(queries.ranks_path())
    texts = made(400, 60, seed=9)
    for t in texts:
        assert next(c.encode([t])).tolist() == library().encode_ordinary(t)


@pytest.mark.parametrize("clash", [False, True])
def test_frames(spark, clash):
    data = cases.EDGES + cases.rows(40) + [(3000 + i, t, None, None, None) for i, t in enumerate(made(200, 80))]
    df = cases.frame(spark, data, clash)
    want = sorted(((d[0], library().encode_ordinary(d[1] or "")) for d in data), key=str)
    enc = bpe.encode(df, queries.ranks_path())
    rows = enc.collect()
    assert sorted(((r.doc_id, r.ids) for r in rows), key=str) == want
    for r in rows:
        at = np.cumsum([0, *(len(library().decode_single_token_bytes(i)) for i in r.ids)])
        assert r.offsets == at[:-1].tolist()
    back = bpe.decode(enc, queries.ranks_path()).collect()
    assert sorted(((r.doc_id, bytes(r.decoded).decode()) for r in back), key=str) == sorted(((d[0], d[1] or "") for d in data), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    got = sorted((tuple(r) for r in bpe.digests(df, queries.ranks_path()).collect()), key=str)
    assert got == sorted(((d[0], len(i), sha(",".join(map(str, i))), sha(d[1] or "")) for d, i in ((d, library().encode_ordinary(d[1] or "")) for d in data)), key=str)


def test_unknown_ids_and_empty_tables(spark):
    c = bpe.codec(queries.ranks_path())
    with pytest.raises(ValueError):
        c.decode(np.array([60_000]))
    df = cases.frame(spark, [])
    assert bpe.digests(df, queries.ranks_path()).count() == bpe.decode(bpe.encode(df, queries.ranks_path()), queries.ranks_path()).count() == 0


def test_query_over_the_whole_table(spark):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = []
    for d in docs:
        ids = library().encode_ordinary(d.text or "")
        want.append((d.doc_id, len(ids), sha(",".join(map(str, ids))), sha(d.text or "")))
    assert sorted(tuple(r) for r in queries.op11_byte_bpe(spark, SF).collect()) == sorted(want)
