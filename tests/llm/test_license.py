import random
import re

from maskframe.llm import license_scan as L

from .cases import EDGES, frame, rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(t):
    w = WORD.findall((t or "").translate({i: i + 32 for i in range(65, 91)}))
    at, labels = [], set()
    for p, label in L.BASE.items():
        p = p.split()
        for i in range(len(w) - len(p) + 1):
            if w[i : i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def data():
    r, out = random.Random(2), rows(20) + EDGES
    lines = ["Released under the MIT License.", "licensed: Apache-LICENSE, Version 2.0", "GNU General Public  License, version 3", "mit mit license license", "Ünder the mIt\tlicense", "Licensed under CC BY-NC 4.0."]
    for i in range(40):
        out.append((300 + i, " ".join(r.choice([*lines, "of the and", "wort café 漢字 x1"]) for _ in range(r.randrange(1, 6))), "en", "s", 1))
    return out


def test_base_is_that_of_brute_force(spark):
    d = data()
    got = sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in L.scan(frame(spark, d, clash=True)).collect()], key=repr)
    assert got == sorted([(x[0], *brute(x[1])) for x in d], key=repr)


def test_labels_spans_and_scores(spark):
    text = "Intro words. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in our Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so. Licensed under CC BY-NC 4.0."
    (r,) = L.scan(frame(spark, [(1, text, "en", "s", 1)])).collect()
    assert r["labels"] == "cc-by-nc,mit" and r["base_labels"] == "" and r["score"] == 1.0
    assert {s["label"] for s in r["spans"]} == {"cc-by-nc", "mit"}
    for r in L.scan(frame(spark, rows(30))).collect():
        assert r["labels"] == "" and r["score"] == 0.0


def test_automaton_gives_longest_matches():
    r = random.Random(0)
    for _ in range(30):
        seqs = [[r.randrange(4) for _ in range(r.randrange(3, 12))] for _ in range(3)]
        a = L.Automaton(seqs)
        text = [r.randrange(5) for _ in range(20)]
        inside = lambda s: any(s == q[i : i + len(s)] for q in seqs for i in range(len(q)))
        best = []
        for i in range(len(text)):
            for z in range(len(text), i, -1):
                if inside(text[i:z]):
                    if z - i >= L.LEAST and (not best or best[-1][1] < z):
                        best.append((i, z))
                    break
        assert sorted({(s, s + n) for s, n, _ in a.matches(text, 0)}) == sorted(set(best))
        for s, n, state in a.matches(text, 0):
            for t, end in a.ends[state].items():
                assert seqs[t][end - n + 1 : end + 1] == text[s : s + n]


def test_empty_table(spark):
    assert L.scan(frame(spark, [])).count() == 0
