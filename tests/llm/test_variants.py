import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from maskframe.llm import queries, variants

from . import cases

SF = "/root/testdata/sf0.01"


def near_words(word, have):
    """All known words at one edit, by trying every edit."""
    letters = sorted({c for w in have for c in w})
    out = set()
    for i in range(len(word) + 1):
        out.add(word[:i] + word[i + 1 :])
        for c in letters:
            out.add(word[:i] + c + word[i:])
            if i < len(word):
                out.add(word[:i] + c + word[i + 1 :])
    return (out & have) - {word}


def all_near(have):
    """The same for all words of a large table: words meet by what is left without a code point, and are compared."""
    left = {}
    for w in have:
        for rest in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            left.setdefault(rest, []).append(w)
    near = {w: set() for w in have}
    for group in left.values():
        for v in group:
            near[v].update(w for w in group if w != v and one_edit(v, w))
    return near


def plain(docs, many=False):
    """The contract without hashes or keys."""
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = all_near(set(n)) if many else {w: near_words(w, set(n)) if len(w) < 1000 else {v for v in n if len(v) >= 1000 and v != w and one_edit(v, w)} for w in n}
    best = {w: min(near[w], key=lambda v: (-n[v], v), default=None) for w in n}
    form = {w: b if b is not None and n[b] >= 10 * n[w] else None for w, b in best.items()}
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out, key=str)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return len(b) - len(a) <= 1 and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def crowd(seed=2):
    """Few letters and many edits, so that words have many near ones, and counts that make chains of forms."""
    r = random.Random(seed)
    out = []
    for i in range(300):
        w = r.choice(["aaaaaaaab", "abababab", "Élégante", "spelling", "aabbaabb×"])
        for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
            p, c = r.randrange(len(w)), r.choice("abÉx")
            w = r.choice([w[:p] + w[p + 1 :], w[:p] + c + w[p:], w[:p] + c + w[p + 1 :]])
        out.append((i, " ".join([w] * r.choice([1, 2, 3, 30, 400])) + ", ", None, None, None))
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_against_every_edit_tried(spark, clash):
    long = "y" * 3000
    data = cases.EDGES + cases.rows(40) + crowd() + [(5000 + i, t, None, None, None) for i, t in enumerate([long, long, long[1:], long[1:], long[:-1] + "z", long[:-1] + "z"])]
    want = plain([(d[0], d[1]) for d in data])
    assert got(variants.variants(cases.frame(spark, data, clash))) == want
    assert any(w[1] for w in want) and any(w[2] not in (w[0], w[1]) for w in want) and max(w[4] for w in want) > 10


def test_both_plain_ways_agree():
    have = {w for _, t, *_ in crowd() for w in t.rstrip(", ").split()}
    assert all_near(have) == {w: near_words(w, have) for w in have}


def test_many_small_buckets_and_windows(spark, monkeypatch):
    monkeypatch.setattr(variants, "BUCKET_KEYS", 64)
    monkeypatch.setattr(variants, "WINDOW", 50)
    monkeypatch.setattr(variants, "GATHERED", 3)
    data = crowd(seed=4)
    assert got(variants.variants(cases.frame(spark, data))) == plain([(d[0], d[1]) for d in data])


def test_equal_keys_of_different_strings_are_told_apart():
    """With all keys equal, only the strings decide."""
    words = ["spelling", "speling", "spellinh", "speelling", "different", "spellimg", "spellin"]
    counts = [9, 8, 7, 6, 5, 4, 3]
    owner, _, place = variants.keys(words)
    found = variants.met(words, counts, owner, np.zeros(len(owner), np.int64), place)
    for i, w in enumerate(words):
        near = near_words(w, set(words))
        best = min(near, key=lambda v: (-counts[words.index(v)], v), default=None)
        assert (found[i][0], found[i][2]) == (len(near), best) if near else i not in found


def test_keys_are_those_of_the_shortened_words():
    words = ["aabbcc", "abcdefgh", "é" * 9]
    owner, key, place = variants.keys(words)
    shorter = [w[:i] + w[i + 1 :] for w in words for i in range(len(w))]
    o, k, p = variants.keys(shorter)
    itself = {shorter[i]: x for i, x in zip(o[p == -1], k[p == -1])}
    for o, k, p in zip(owner, key, place):
        if p >= 0:
            assert itself[words[o][:p] + words[o][p + 1 :]] == k
    assert (np.bincount(owner[place >= 0]) == [3, 8, 1]).all()


def test_roots_of_long_chains(spark):
    chain = [(f"w{i:02d}", f"w{i + 1:02d}") for i in range(18)]
    assert {tuple(r) for r in variants.rooted(spark.createDataFrame(chain, "word string, form string")).collect()} == {(w, "w18") for w, _ in chain}


def test_empty_tables(spark):
    assert got(variants.variants(cases.frame(spark, []))) == []
    assert got(variants.variants(cases.frame(spark, [(1, None, None, None, None), (2, "", None, None, None)]))) == []


def test_query_over_the_whole_table(spark):
    docs = [(d.doc_id, d.text) for d in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got(queries.op12_spelling_variants(spark, SF).select("word", "form", "root", "n", "n_near", "form_n")) == plain(docs, many=True)
