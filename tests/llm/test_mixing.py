import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskframe.llm import mixing

from .cases import EDGES, frame, rows


def test_fit_is_exact_where_brute_force_is():
    from itertools import product

    r = random.Random(4)
    for _ in range(200):
        sizes = np.array(sorted(r.sample(range(1, 12), 3)))
        counts = np.array([r.randrange(1, 4) for _ in sizes])
        budget = r.randrange(0, int((sizes * counts).sum()) + 3)
        take = mixing.fit(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        assert int((take * sizes).sum()) <= budget
        best = max(s for t in product(*[range(c + 1) for c in counts]) if (s := int((np.array(t) * sizes).sum())) <= budget)
        # The proportional part comes first, so the sum may fall short of the best by less than the largest size.
        assert best - int((take * sizes).sum()) < sizes.max()


def test_large_budgets_stay_near():
    sizes, counts = np.array([1, 7, 1000, 250_000]), np.array([5, 100, 1000, 3])
    take = mixing.fit(sizes, counts, 900_001)
    assert (take <= counts).all() and 0 <= 900_001 - int((take * sizes).sum()) < 1000


def test_large_remainders_are_fitted_exactly():
    """Beyond any small budget: the remainder after the proportional part against all sums that its spare documents reach."""
    r = np.random.default_rng(6)
    for _ in range(5):
        sizes = np.unique(r.integers(5_000, 60_000, 40)) * 2
        counts = r.integers(1, 3, len(sizes))
        budget = int((sizes * counts).sum() * 0.45) | 1
        take = mixing.fit(sizes, counts, budget)
        base = np.array([int(c) * budget // int((sizes * counts).sum()) for c in counts])
        left, sums = budget - int((base * sizes).sum()), {0}
        for s, c in zip(sizes.tolist(), (counts - base).tolist()):
            for _ in range(c):
                sums |= {x + s for x in sums if x + s <= left}
                if len(sums) > 400_000:
                    break
        got = int(((take - base) * sizes).sum())
        assert (take >= base).all() and (take <= counts).all() and got <= left and got >= max(sums)


def test_remainders_stay_below_the_longest_document():
    """Many lengths: shares by rounding with a carry, then a programme over less than the longest document, exact to the word."""
    import tracemalloc

    r = np.random.default_rng(8)
    sizes = np.unique(r.integers(1, 1_000_000, 30_000))
    counts = r.integers(1, 4, len(sizes))
    total = int((sizes * counts).sum())
    tracemalloc.start()
    take = mixing.fit(sizes, counts, int(total * 0.37))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (take >= 0).all() and (take <= counts).all() and int((take * sizes).sum()) == int(total * 0.37)
    assert peak < 200 << 20
    # Lengths stay in proportion: each gives its share, but for one document and what the programme adds.
    share = counts * 0.37
    assert (np.abs(take - share) < 1.01).mean() > 0.99


def test_sizes_with_a_common_unit_stop_at_it():
    sizes, counts = np.arange(1, 400) * 6, np.full(399, 2)
    take = mixing.fit(sizes, counts, 100_003)
    assert (take <= counts).all() and 100_003 - int((take * sizes).sum()) == 100_003 % 6


def test_targets_share_all_and_stop_at_the_cap():
    t = mixing.targets([10, 1, 100], [1, 2, 3], 3)
    assert t[1] == 3 and abs(sum(t) - 111) < 1e-9 and abs(t[2] / t[0] - 3) < 1e-9 or t[0] == 30


def check(got, data, most=3):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((x[0], size(x[1])) for x in data)
    totals, source = defaultdict(int), sorted({x[3] for x in data}, key=lambda s: (s is None, s or ""))
    for x in data:
        totals[x[3]] += size(x[1])
    want = dict(zip(source, mixing.targets([totals[s] for s in source], [(1, 2, 3)[i % 3] for i in range(len(source))], most)))
    taken = defaultdict(int)
    for r in got:
        assert r["source_size"] == totals[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]])
        assert 0 <= r["taken"] <= most * r["size"] and (not r["size"] or r["taken"] % r["size"] == 0)
        taken[r["source"]] += r["taken"]
    return taken, want


def test_mix_meets_targets(spark):
    data = rows(120) + EDGES
    got = mixing.mix(frame(spark, data, clash=True)).collect()
    taken, want = check(got, data)
    for s, t in want.items():
        assert t - 12 <= taken[s] <= t
    again = mixing.mix(frame(spark, list(reversed(data))).repartition(7)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in again) == Counter((r["doc_id"], r["taken"]) for r in got)


def test_one_length_takes_the_seeded_part(spark):
    data = [(i, "a b c", "en", "big", 1) for i in range(900)] + [(1000 + i, "a b c d", "en", "tiny", 1) for i in range(30)]
    got = mixing.mix(frame(spark, data)).collect()
    taken, want = check(got, data)
    assert all(abs(taken[s] - want[s]) < 5 for s in want)


def test_rows_are_repeated_as_taken(spark):
    data = rows(60) + EDGES
    df = frame(spark, data, clash=True)
    out = mixing.apply_mix(df)
    assert out.columns == df.columns
    want = Counter()
    for r in mixing.mix(frame(spark, data)).collect():
        want[r["doc_id"]] += r["copies"]
    assert Counter(r["doc_id"] for r in out.collect()) == +want


@pytest.mark.parametrize("data", [[], [(1, None, None, None, None)]])
def test_nothing_to_mix(spark, data):
    assert [r["taken"] for r in mixing.mix(frame(spark, data)).collect()] == [0] * len(data)
