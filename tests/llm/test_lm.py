import math
import random
import re
import zlib
from collections import Counter

import pytest

from maskframe.llm import lm_score as M

from .cases import EDGES, frame


def tokens(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) + [""]


def out_of(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


def data(n=150):
    r, out = random.Random(3), []
    for i in range(n):
        w = []
        for _ in range(r.randrange(5, 60)):
            w += r.choice([["the", "Cat"], ["of", "a"], [f"x{r.randrange(500)}"], ["the", "cat", "sat"], ["é漢"], ["u", "v", "w", "then"], ["t", "v", "w", "else"]])
        out.append((i, " ".join(w), "en", "s", 1))
    return out + EDGES


def test_base_and_score(spark):
    d = data()
    got = M.score(frame(spark, d, clash=True)).collect()
    assert len(got) == len(d)
    c = Counter(t for x in d if not out_of(x[0]) for t in tokens(x[1]))
    n, v = sum(c.values()), len(c)
    want = Counter()
    for x in d:
        t = tokens(x[1])
        want[x[0], out_of(x[0]), len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 6)] += 1
    assert Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in got)
    # The model beats the base on documents it hasn't seen.
    held = [r for r in got if r["held_out"] and r["n_tokens"] > 5 and r["doc_id"] < 1000]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


START = object()


def contexts(t, i, depth):
    """The last ``depth`` words before place ``i``, the start among them at most once; None if there aren't so many."""
    before = [START, *t[:i]]
    return tuple(before[-depth:]) if len(before) >= depth else None


class Plain:
    """The tree by dictionaries: counts of all training texts, contexts kept by their left-out gain over the suffix."""

    def __init__(self, texts):
        self.words = Counter(w for t in texts for w in t)
        self.n, self.types = sum(self.words.values()), len(self.words)
        self.next = {}
        for t in texts:
            for i, w in enumerate(t):
                for k in range(1, M.DEPTH + 1):
                    if c := contexts(t, i, k):
                        self.next.setdefault(c, Counter())[w] += 1
        self.kept = {}
        for k in range(1, M.DEPTH + 1):
            for c in [c for c in self.next if len(c) == k]:
                self.kept[c] = (k == 1 or self.kept.get(c[1:], False) and len(self.next[c[1:]]) > 1) and self.gain(c) > M.MARGIN

    def p(self, w, context):
        if not context:
            return (self.words[w] + 1) / (self.n + self.types + 1)
        low = self.p(w, context[1:])
        if not self.kept.get(context):
            return low
        c = self.next[context]
        whole = sum(c.values())
        return max(c[w] - M.DISCOUNT, 0) / whole + M.DISCOUNT * len(c) / whole * low

    def gain(self, context):
        c = self.next[context]
        whole, out = sum(c.values()), 0.0
        if whole < M.SUPPORT:
            return -1.0
        for w, n in c.items():
            # The suffix's probability travels in eighths of a nat.
            low = math.exp(-round(-math.log(self.p(w, context[1:])) * 8) / 8)
            out += n * math.log((max(n - 1 - M.DISCOUNT, 0) / (whole - 1) + M.DISCOUNT * len(c) / (whole - 1) * low) / low)
        return out

    def score(self, t):
        return sum(math.log10(self.p(w, next((c for k in range(M.DEPTH, 0, -1) if (c := contexts(t, i, k)) and self.kept.get(c)), ()))) for i, w in enumerate(t))


@pytest.mark.parametrize("hot", [1 << 18, 40])
def test_same_as_dictionaries(spark, monkeypatch, hot):
    monkeypatch.setattr(M, "BUCKET_BYTES", 4000)
    d = data()
    tree = Plain([tokens(x[1]) for x in d if not out_of(x[0])])
    assert max(map(len, [c for c, ok in tree.kept.items() if ok])) == M.DEPTH
    got = sorted((r["doc_id"] or 0, r["score"]) for r in M.score(frame(spark, d), hot=hot).collect())
    want = sorted((x[0] or 0, tree.score(tokens(x[1]))) for x in d)
    assert [k for k, _ in got] == [k for k, _ in want]
    far = [abs(a - b) for (_, a), (_, b) in zip(got, want)]
    if hot > 1000:
        assert max(far) < 1e-6
    else:  # a hot context's next words are counted per part, so a test near its margin may turn
        assert sum(far) < 0.02 * abs(sum(s for _, s in want))


def test_places_are_sorted_along():
    import numpy as np

    r = np.random.default_rng(1)
    for n in (0, 1, 2, 70_000):
        spot = r.integers(0, 1 << 49, n, dtype=np.uint64) >> np.uint64(20) << np.uint64(20)
        spot[n // 2 :] = spot[: n - n // 2]
        assert (M.order_of(spot) == np.argsort(spot, kind="stable")).all()
        low = r.integers(0, 1 << 49, n, dtype=np.uint64)
        order = M.order_of(low)
        assert sorted(order.tolist()) == list(range(n)) and (np.diff(low[order] >> np.uint64(16)).astype(np.int64) >= 0).all()
        few, then = r.integers(0, 9, n).astype(np.uint64), r.integers(0, 1 << 32, n, dtype=np.uint64)
        order = M.order_of(few, then)
        assert (order == np.lexsort([then, few])).all()
        small = r.integers(0, max(1, n // 3), n).astype(np.uint64)
        for key in (small, small << np.uint64(45)):  # with and without room for places
            code, first = M.numbered(key)
            assert (key[first][code] == key).all() and len(first) == len(set(key.tolist()))
            assert first.tolist() == [key.tolist().index(k) for k in key[first].tolist()] if n < 100 else len(set(first.tolist())) == len(first)


def test_words_met_once_take_no_number():
    import numpy as np

    for index in ([0, 1, 0, 2, 1, 3], [0, 1, 2], [0, 0], [0]):
        index = np.array(index, np.uint32)
        n = np.bincount(index)
        kept = M.shortened(index, int((n > 1).sum()))
        assert (M.lengthened(kept, len(n)) == index).all() and (kept == 0).sum() == (n == 1).sum()


def test_answers_are_taken_in_without_counting_again(spark, tmp_path):
    """Counts are made for what is sent only, what places the answers is the same; upper bits of words are for their counts only."""
    import numpy as np

    (row,) = M.chunked(frame(spark, data()).coalesce(1), "doc_id", "text", f"file://{tmp_path}").collect()
    read = lambda p: open(p.removeprefix("file://"), "rb").read()
    raw, upper = read(row["path"]), read(row["path"] + "-upper")
    facts = {"tokens": row["train_tokens"], "types": 500, "train_docs": row["train_docs"]}
    for hot in (M.HOT, 40):
        c, whole = M.Chunk(raw, **facts), M.Chunk(raw, **facts, upper=upper)
        assert (c.words >> np.uint64(48) == 0).all() and (whole.words & np.uint64((1 << 48) - 1) == c.words).all() and (whole.words != c.words).any()
        for d in range(M.DEPTH + 1):
            sent, again = (c if d else whole).request(d, 8, hot), c.request(d, 8, hot, sent=False)
            assert d == 0 or again.count is None
            assert all(np.array_equal(getattr(sent, a), getattr(again, a)) for a in ("some", "code", "bucket", "edges", "starts"))
            answers = {b: M.unpacked(M.merged([p], d, b >= 8, hot)[0][0]) for b, p in sent.payloads(8)}
            if not d:
                n = np.bincount(c.index[c.train], minlength=len(c.words))
                assert (np.concatenate([answers[b][0] for b in sorted(answers)])[sent.code] == n[c.index]).all()
            c.told(d, 8, hot, answers, {})


def test_kept_contexts_predict_distributions():
    tree = Plain([tokens(x[1]) for x in data() if not out_of(x[0])])
    some = [c for c, ok in tree.kept.items() if ok]
    for c in some[:5] + some[-5:]:
        assert abs(sum(tree.p(w, c) for w in tree.words) + tree.p("never met", c) - 1) < 1e-9


def test_rows_do_not_depend_on_partitions(spark):
    d = data(80)
    rows = lambda n: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in M.score(frame(spark, d).repartition(n)).collect())
    assert rows(1) == rows(7)


def test_tables_without_training(spark):
    assert M.score(frame(spark, [])).count() == 0
    key = next(i for i in range(100) if out_of(i))
    (r,) = M.score(frame(spark, [(key, "a b", None, None, 1)])).collect()
    assert r["train_tokens"] == 0 and r["n_known"] == 0 and r["n_tokens"] == 3 and math.isfinite(r["score"])
    assert abs(r["base_score"] - 0.0) < 1e-12
