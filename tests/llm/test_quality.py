import random
from collections import Counter

import numpy as np

from maskframe.llm import quality

from .cases import EDGES, frame, rows


def brute(t):
    raw = t or ""
    ws = " \t\n\x0b\x0c\r"
    for c in ws:
        raw = raw.replace(c, " ") if c != "\n" else raw
    w = raw.replace("\n", " ").split(" ")
    w = [x for x in w if x]
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if line.strip(ws):
            dup += line in seen
            seen.add(line)
    win = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = set()
    for i in range(len(w) - 4):
        if win[tuple(w[i : i + 5])] > 1:
            hit |= set(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), dup, len(hit)


def data():
    r = random.Random(5)
    out = rows(40) + EDGES
    for i in range(40):
        line = " ".join(r.choice("a b c d é".split()) for _ in range(r.randrange(1, 9)))
        out.append((200 + i, "\n".join(r.choice([line, line + " #x", "", "  ", "z | y q"]) for _ in range(r.randrange(1, 12))), "en", "s0", 1))
    return out


def labels(spark, pairs):
    return spark.createDataFrame(pairs, "doc_id long, quality int, toxic int")


def test_statistics_are_those_of_brute_force(spark):
    d = data()
    got = quality.quality(frame(spark, d, clash=True), labels(spark, [])).collect()
    assert Counter((r["doc_id"], *(r[c] for c in quality.STATS)) for r in got) == Counter((x[0], *brute(x[1])) for x in d)
    for r in got:
        failed = r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed)  # without labels the forest rejects nothing


def test_forest_rejects_junk_and_spares_clean(spark):
    good = [(i, t, "en", "s0", 1) for i, t, *_ in rows(300, 1) if len(t.split()) >= 10]
    junk = [(1000 + i, " ".join(w + "###$$$" for w in t.split()), "en", "s0", 1) for i, t, *_ in rows(60, 2) if len(t.split()) >= 10]
    lab = [(x[0], 1, 0) for x in good] + [(x[0], 0, 0) for x in junk[:30]] + [(None, 1, 0), (good[0][0], 1, 0)]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality(frame(spark, good + junk), labels(spark, lab)).collect() if not r["base_failed"]}
    assert all(kept.get(x[0], True) for x in good)
    assert not any(kept.get(x[0], False) for x in junk)
    df = frame(spark, good + junk, clash=True)
    rows_kept = quality.keep_good(df, labels(spark, lab))
    assert rows_kept.columns == df.columns and {r["doc_id"] for r in rows_kept.collect()} == {k for k, v in kept.items() if v}


def test_thresholds():
    s, good = np.array([0.9, 0.8, 0.8, 0.3, 0.2]), np.array([False, False, False, True, True])
    t = quality.calibrate(s, good)
    assert 0.3 < t < 0.8
    assert quality.calibrate(s, ~good) == 2.0
    assert quality.calibrate(np.zeros(0), np.zeros(0, bool)) == 2.0


def test_few_labels_never_judge_rows_that_the_trees_have_seen():
    """One bad row among a few good ones in one fold only: no pair has two forests that were judged apart, so nothing is rejected."""
    x = np.r_[np.zeros((9, 2)), np.full((1, 2), 50.0)]
    forests = quality.Forests(x, np.r_[np.ones(9, bool), False], np.zeros(10, np.int64))
    assert not forests.judged(x)[1].any()


def test_every_labelled_row_counts(spark):
    """Forests of the table are those of all its labelled rows, which a fit on the rows of the lowest hashes would not give."""
    import pandas as pd
    from pyspark.sql import functions as F

    good = [(i, t, "en", "s0", 1) for i, t, *_ in rows(250, 1) if len(t.split()) >= 10]
    junk = [(1000 + i, " ".join(w + "#$" * (i % 5) for w in t.split()), "en", "s0", 1) for i, t, *_ in rows(60, 2) if len(t.split()) >= 10]
    docs = frame(spark, [*good, *junk, good[0]])
    got = quality.fit(quality.counted(docs.repartition(3)), labels(spark, [(x[0], int(x[0] < 1000), 0) for x in good + junk]), rows=16)
    table = pd.DataFrame(quality.counted(docs).distinct().select("*", F.xxhash64("doc_id").alias("h"), F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(2)).alias("fold")).toPandas())
    x = quality.features(table[list(quality.STATS)].to_numpy(), table[list(quality.MORE)].to_numpy())
    want = quality.Forests(x, (table.doc_id < 1000).to_numpy(), table.fold.to_numpy(), table.h.to_numpy(), rows=16)
    assert min(Counter(table.fold).values()) > 16
    for (cols, a), (same, b) in zip(got.parts, want.parts, strict=True):
        assert cols == same
        for f, g in zip(a, b):
            assert f.threshold == g.threshold and len(f.trees) == len(g.trees) > 0
            assert all(np.array_equal(u, v) for s, t in zip(f.trees, g.trees) for u, v in zip(s, t))


def test_leaves_hold_all_rows():
    """Rows that a tree didn't draw still make their leaf a common one."""
    x = np.r_[np.zeros((5000, 1)), np.linspace(1, 2, 200)[:, None]]
    tree = quality.grow(np.array([[0.0], [2.0]]), 2, np.random.default_rng(0))
    f = quality.Forest.of([tree], [np.bincount(quality.leaves(tree, x), minlength=3)], len(x), 256)
    s = f.score(np.array([[0.0], [2.0]]))
    assert s[0] < s[1]


def test_mean_path():
    assert np.allclose(quality.mean_path([0, 1, 2, 3, 256]), [-2, 0, 1, 5 / 3, 2 * sum(1 / i for i in range(1, 257)) - 2])


def test_isolated_points_score_higher():
    x = np.concatenate([np.random.default_rng(0).normal(0, 1, (500, 2)), [[9.0, 9.0]]])
    s = quality.Forest.grown(x).score(x)
    assert s[-1] == s.max()


def test_empty_table(spark):
    assert quality.quality(frame(spark, []), labels(spark, [(1, 1, 0)])).count() == 0
