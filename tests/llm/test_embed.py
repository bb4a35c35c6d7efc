import math

import numpy as np
import pytest

from maskframe.llm import embed_dedup as E


def brute(data, least):
    ok = [(k, np.array(v, float)) for k, v in data if v and all(x is not None and math.isfinite(x) for x in v) and any(v) and k is not None]
    n, root = [0] * len(ok), {k: k for k, _ in ok}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, x) in enumerate(ok):
        for j in range(i):
            b, y = ok[j]
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                n[i], n[j] = n[i] + 1, n[j] + 1
                p, q = top(a), top(b)
                root[max(p, q)] = min(p, q)
    out = [(k, n[i], top(k), top(k) == k) for i, (k, _) in enumerate(ok)]
    good = [id(v) for k, v in data]
    rest = [(k, 0, k, True) for k, v in data if not (v and all(x is not None and math.isfinite(x) for x in v) and any(v) and k is not None)]
    return sorted(out + rest, key=repr)


def vectors(seed=0, d=16):
    r = np.random.default_rng(seed)
    base = r.normal(size=(40, d))
    out = [(i, v.tolist()) for i, v in enumerate(base)]
    for i in range(300):
        v = base[i % 12] * r.uniform(0.5, 3) + r.normal(size=d) * r.choice([0.02, 0.1, 0.25])
        out.append((100 + i, v.tolist()))
    f = lambda v: [None if x is None else float(np.float32(x)) for x in v]
    out = [(k, f(v)) for k, v in out]
    out += [(900 + i, out[3][1]) for i in range(30)] + [(960, None), (961, []), (962, [0.0] * d), (963, [None] + [1.0] * (d - 1)), (964, [float("nan")] * d), (965, [float("inf")] + [1.0] * (d - 1)), (966, [1.0, 2.0]), (967, [2.0, 4.0]), (None, out[3][1]), (900, out[3][1])]
    return out


@pytest.mark.parametrize("kind", ["float", "double"])
def test_same_as_brute_force(spark, kind):
    data = vectors()
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as label", "2 as d", "3 as m", "4 as rep", "5 as keys")
    got = sorted([tuple(r) for r in E.near_duplicates(df).collect()], key=repr)
    want = brute(data, 0.95)
    assert got == want


def test_crowded_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 20)
    data = vectors(3)
    got = sorted([tuple(r) for r in E.near_duplicates(spark.createDataFrame(data, "vec_id long, embedding array<float>")).collect()], key=repr)
    assert got == brute(data, 0.95)


def test_estimates_are_unbiased_and_bounded():
    r = np.random.default_rng(1)
    d, turn = 64, E.rotation(64, 0)
    assert np.allclose(turn @ turn.T, np.eye(d))
    o = r.normal(size=(4000, d))
    o /= np.linalg.norm(o, axis=1)[:, None]
    q = 0.95 * o + math.sqrt(1 - 0.95**2) * (lambda e: e / np.linalg.norm(e, axis=1)[:, None])(r.normal(size=o.shape))
    q /= np.linalg.norm(q, axis=1)[:, None]
    x, y = o @ turn, q @ turn
    f = np.abs(x).sum(1) / math.sqrt(d)
    est = (np.where(x > 0, 1, -1) * y).sum(1) / math.sqrt(d) / f
    true = (o * q).sum(1)
    assert abs((est - true).mean()) < 0.005
    bound = E.SIGMAS * np.sqrt(1 - true**2) * np.sqrt(1 - f**2) / f / math.sqrt(d - 1)
    assert (np.abs(est - true) <= bound).all()


def test_hamming_distances_stay_within_the_bound():
    r, d, least = np.random.default_rng(2), 64, 0.95
    bits, tables = E.layout(500_000, least)
    n = bits * tables
    o = r.normal(size=(5000, d))
    o /= np.linalg.norm(o, axis=1)[:, None]
    e = r.normal(size=o.shape)
    e -= (e * o).sum(1)[:, None] * o
    q = least * o + math.sqrt(1 - least**2) * e / np.linalg.norm(e, axis=1)[:, None]
    turn = np.hstack([E.rotation(d, s) for s in range(-(-n // d))])[:, :n]
    far, p = ((o @ turn > 0) != (q @ turn > 0)).sum(1), math.acos(least) / math.pi
    spread = math.sqrt(n * p * (1 - p))
    assert abs(far.mean() - n * p) < 0.1 * spread and far.std() < 1.05 * spread
    assert far.max() <= n * p + E.SIGMAS * spread


def test_layout_misses_next_to_nothing():
    for n in (2, 100, 10_000, 10**7, 10**9):
        bits, tables = E.layout(n, 0.95)
        meet = (1 - math.acos(0.95) / math.pi) ** bits
        assert (1 - meet) ** tables <= E.MISS and n / 2**bits <= max(E.PER_BUCKET, n)


def test_empty_table(spark):
    assert E.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
