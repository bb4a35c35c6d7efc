import random
import re

import numpy as np
import pytest

from maskframe.llm import neardup

from .cases import EDGES, frame, rows, words


def brute(data, width, percent):
    def shingles(t):
        t = (t or "").translate({i: i + 32 for i in range(65, 91)})
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())

    sets = [(r[0], shingles(r[1])) for r in data]
    ids = sorted({k for k, _ in sets if k is not None})
    root = {k: k for k in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if a is None or b is None or not x or not y:
                continue
            inter = len(x & y)
            if 100 * inter >= percent * (len(x) + len(y) - inter):
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    return sorted([(k, len(s), None if k is None else top(k), k is None or top(k) == k) for k, s in sets], key=repr)


def copies(seed=1):
    """A base, near copies with a few words changed (some linked through others only), exact copies, and a star."""
    r, out, at = random.Random(seed), [], 100
    for g in range(6):
        base = words(500 + g, 120)
        for k in range(12):
            w = list(base)
            for _ in range(k if g % 2 else r.randrange(0, 14)):
                w[r.randrange(len(w))] = f"v{r.randrange(10_000)}"
            out.append((at, " ".join(w), "en", "s0", 1))
            at += 1
        out.append((at, " ".join(base).upper().replace("W", "w"), "en", "s1", 1))
        at += 1
    return out


@pytest.mark.parametrize("width", [2, 5])
def test_same_as_brute_force(spark, width):
    data = rows(30) + EDGES + copies()
    got = neardup.near_duplicates(frame(spark, data, clash=True), width=width, percent=80).collect()
    assert sorted([tuple(r) for r in got], key=repr) == brute(data, width, 80)


def test_a_large_group_is_one_component_and_costs_few_pairs(spark):
    base, r = words(7, 150), random.Random(3)
    data = []
    for i in range(700):
        w = list(base)
        for _ in range(4):
            w[r.randrange(len(w))] = f"v{r.randrange(100_000)}"
        data.append((i, " ".join(w), "en", "s0", 1))
    got = neardup.near_duplicates(frame(spark, data), width=2, percent=80).collect()
    assert {r["component_id"] for r in got} == {0}
    assert [r["doc_id"] for r in got if r["kept"]] == [0]


def test_empty_table(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    assert neardup.keep_first(frame(spark, [], clash=True)).count() == 0


def test_keep_first_keeps_all_columns(spark):
    data = copies() + EDGES
    df = frame(spark, data, clash=True)
    kept = neardup.keep_first(df, width=5)
    assert kept.columns == df.columns
    want = sorted([r[0] for r in brute(data, 5, 80) if r[3]], key=repr)
    assert sorted([r["doc_id"] for r in kept.collect()], key=repr) == want


def test_regions_are_as_deep_as_they_must():
    keys = np.array([[1, 1], [1, 2], [2, 1], [2, 1]], ">u2")
    assert list(neardup.regions(np.zeros(4, np.int64), keys)) in ([(2, 4, False), (0, 2, False)], [(0, 2, False), (2, 4, False)])
    many = np.zeros((neardup.REGION + 1, 2), ">u2")
    assert list(neardup.regions(np.zeros(len(many), np.int64), many)) == [(0, len(many), True)]


def test_pairs_in_a_crowd_are_not_lost_with_depth(spark):
    """600 documents share a passage (similarity 0.75); each has one partner at just over 0.8."""
    assert (1 - 0.8**neardup.DEPTH) ** neardup.TREES <= 1e-4
    passage = [f"p{i}" for i in range(300)]
    data = []
    for i in range(600):
        own = [f"pair{i // 2}_{k}" for k in range(12)] + [f"own{i}_{k}" for k in range(38)]
        data.append((i, " ".join(passage + own), "en", "s0", 1))
    got = neardup.near_duplicates(frame(spark, data), width=1, percent=80).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i - i % 2 for i in range(600)}


def test_a_crowded_region_is_compared_in_full():
    import pyarrow as pa

    n = neardup.SIDE + 200
    cols = {"tree": np.zeros(n, np.int64), "rep": np.arange(n), "n": np.full(n, 9), "comp": np.arange(n)}
    sketch = np.random.default_rng(5).integers(0, 256, (n, neardup.SKETCH), np.uint8)
    sketch[n - 1] = sketch[0]
    batch = pa.RecordBatch.from_pydict({**cols, "key": [bytes(2 * neardup.DEPTH)] * n, "sketch": [x.tobytes() for x in sketch]})
    (got,) = neardup.near(iter([batch]), 0.8, False)
    assert got.column("b").to_pylist() == [0, n - 1]
