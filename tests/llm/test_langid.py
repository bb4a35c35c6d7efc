import random
import zlib

import numpy as np

from maskframe.llm import langid

from .cases import EDGES, frame

PARTS = {"aa": "ka ti ro mu ne la".split(), "bb": "sch ung ver eit zug ost".split(), "cc": "да ни ро лу ме ть".split()}


def text(lang, seed, n=40):
    r = random.Random(f"{lang}{seed}")
    return " ".join("".join(r.choice(PARTS[lang]) for _ in range(r.randrange(2, 4))) for _ in range(n))


def data():
    return [(i, text(lg, i), lg, f"s{i}", 1) for i, lg in enumerate(sorted(PARTS) * 40)]


def test_held_out_documents_get_their_language(spark):
    d = data() + EDGES
    got = langid.identify(frame(spark, d, clash=True)).collect()
    assert len(got) == len(d)
    want = {r[0]: r[2] for r in data()}
    for r in got:
        key = "" if r["doc_id"] is None else str(r["doc_id"])
        assert r["held_out"] == (zlib.crc32(key.encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in want:
            assert r["lang_pred"] == want[r["doc_id"]]
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[1000] == by[1001] == by[1002] == "und"


def test_spans_of_mixed_text(spark):
    m = langid.fit(frame(spark, data()))
    spans = langid.Labeller(m).spans(f"{text('aa', 999, 20)} {text('cc', 998, 15)} {text('bb', 997, 25)}")
    assert [s[2] for s in spans] == ["aa", "cc", "bb"]
    assert spans[0][:2] == (0, 20) and spans[1][:2] == (20, 35) and spans[2][1] == 60


def test_viterbi_is_the_best_labelling():
    from itertools import product

    r = np.random.default_rng(1)
    for _ in range(60):
        s = r.normal(0, 3, (5, 3))
        path = langid.viterbi(s, 2.0)
        score = lambda p: sum(s[i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))
        assert abs(score(path) - max(map(score, product(range(3), repeat=5)))) < 1e-9


def test_scripts():
    assert [langid.script(c) for c in "aд漢1"] == ["latin", "cyrillic", "han", ""]


def test_rejects_and_empties(spark):
    df = frame(spark, data() + EDGES, clash=True)
    kept = langid.keep_known(df)
    assert kept.columns == df.columns
    assert {r[0] for r in data()} <= {r["doc_id"] for r in kept.collect()}
    assert not {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()}
    assert langid.identify(frame(spark, [])).count() == 0
    assert {r["lang_pred"] for r in langid.identify(frame(spark, [(1, "abc", None, None, 1)])).collect()} == {"und"}


def test_runs_without_spaces_are_learned_and_scored_to_their_end(spark):
    """Two languages of one script whose documents are single runs; what tells them apart comes after 64 and 256 letters."""
    shared, own = "一丁七万丈三上下", {"p": "木本札术朱朴机杀", "q": "水永求汁汗江池汝"}

    def run(alphabet, seed, n):
        r = random.Random(seed)
        return "".join(r.choice(alphabet) for _ in range(n))

    train = [(i, run(shared, i, 64) + run(own[lg], f"{lg}{i}", 300), lg, "s", 1) for i, lg in enumerate("pq" * 20)]
    train += [(100 + i, text("aa", i), "aa", "s", 1) for i in range(20)]
    lab = langid.Labeller(langid.fit(frame(spark, train)))
    ((lang, share),) = lab.label([run(own["p"], 1, 320) + run(own["q"], 2, 1280)])
    assert lang == "q" and abs(share - 0.8) < 0.02
    assert [s[2] for s in lab.spans(run(own["p"], 3, 320) + text("aa", 9, 1) + run(own["q"], 4, 320))] in (["p", "aa", "q"], ["p", "q"])


def test_pieces_leave_nothing_out():
    assert langid.pieces("") == [] and langid.pieces("straße") == ["straße"] and langid.pieces("a" * 45) == ["a" * 45]
    for w in ("a" * 1000, "漢" * 700 + "abc" + "ก" * 30, "人々" * 9, "да" + "x" * 80):
        got = langid.pieces(w)
        assert "".join(got) == w and max(map(len, got)) <= langid.PIECE
        assert all(len({langid.script(c) for c in p} - {"", "other"}) == 1 for p in got)


class Plain:
    """The model by dictionaries: back-off over the last characters, smoothed as the module says, and Viterbi over words."""

    def __init__(self, docs):
        from collections import Counter, defaultdict

        count = defaultdict(Counter)
        scripts = defaultdict(Counter)
        for _, t, lg in docs:
            for w in t.split():
                for p in langid.pieces(langid.letters(w)):
                    scripts[lg][langid.script_of(p)] += 1
                    padded = f"^{p}$"
                    for i in range(1, len(padded)):
                        for k in range(1, langid.ORDER + 1):
                            if i - k + 1 >= 0:
                                count[padded[i - k + 1 : i + 1]][lg] += 1
        # Grams that a language has once are no evidence.
        self.langs = sorted(count and {lg for c in count.values() for lg, n in c.items() if n > 1})
        self.count = {g: {lg: n for lg, n in c.items() if n > 1} for g, c in count.items() if any(n > 1 for n in c.values())}
        self.uses = {(s, lg): n > 0.01 * sum(m for m in c.values() if m > 1) for lg, c in scripts.items() for s, n in c.items() if n > 1}
        self.scripts = {s for s, _ in self.uses}
        self.letters = sum(len(g) == 1 for g in self.count)
        self.one = {lg: sum(c.get(lg, 0) for g, c in self.count.items() if len(g) == 1) for lg in self.langs}
        self.context = defaultdict(Counter)
        for g, c in self.count.items():
            for lg, n in c.items():
                self.context[g[:-1]][lg] += n

    def p(self, g, lg):
        if g not in self.count:
            return 1e-6
        n = self.count[g].get(lg, 0)
        if len(g) == 1:
            return (n + 0.5) / (self.one[lg] + 0.5 * (self.letters + 1))
        return (n + 3.0 * self.p(g[1:], lg)) / (self.context[g[:-1]][lg] + 3.0)

    def word(self, w, lg):
        import math

        padded, out = f"^{w}$", 0.0
        for i in range(1, len(padded)):
            top = min(i + 1, langid.ORDER)
            k = next((k for k in range(top, 0, -1) if padded[i - k + 1 : i + 1] in self.count), 0)
            out += math.log(max(self.p(padded[i - k + 1 : i + 1], lg), 1e-9)) - (top - k) if k else math.log(1e-7)
        s = langid.script_of(w)
        some = [self.uses.get((s, x), False) for x in self.langs]
        return out - 50.0 * (s in self.scripts and any(some) and not self.uses.get((s, lg), False))

    def predict(self, t):
        words = [p for w in (t or "").split() for p in langid.pieces(langid.letters(w))]
        if not words:
            return "und"
        rows = [[self.word(w, lg) for lg in self.langs] for w in words]
        best = [(x, [i]) for i, x in enumerate(rows[0])]
        for row in rows[1:]:
            top = max(best, key=lambda b: b[0])
            best = [max([(s, path), (top[0] - langid.PENALTY, top[1])], key=lambda b: b[0]) for s, path in best]
            best = [(s + x, path + [i]) for i, ((s, path), x) in enumerate(zip(best, row))]
        path = max(best, key=lambda b: b[0])[1]
        return self.langs[max(range(len(self.langs)), key=lambda i: (path.count(i), sum(r[i] for r in rows)))]


def test_predictions_are_those_of_dictionaries(spark):
    mixed = [(500 + i, f"{text('aa', i, 5 + i)} {text('bb', i, 12)} {text('cc', i, i)}", None, "s", 1) for i in range(15)]
    d = data() + mixed + EDGES
    plain = Plain([(x[0], x[1], x[2]) for x in d if x[1] and x[2] and zlib.crc32(str(x[0]).encode()) % 4 != 2])
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(frame(spark, d)).collect()}
    for x in mixed + data()[::5]:
        assert got[x[0]] == plain.predict(x[1]), x


def test_a_rare_language_keeps_its_script(spark):
    """Two documents in a hundred: its share of the Latin words is small, but all of its own words are Latin."""
    common = [(i, text("aa", i), "aa", "s", 1) for i in range(1200)]
    rare = [(5000 + i, text("bb", i), "bb", "s", 1) for i in range(12)]
    m = langid.fit(frame(spark, common + rare))
    assert m.scripts["latin"].all()
    got = {r["doc_id"]: r for r in langid.identify(frame(spark, common[:50] + rare), model=m).collect()}
    assert all(got[x[0]]["lang_pred"] == x[2] for x in common[:50] + rare)
    assert got[5000]["spans"] == [(0, 40, "bb")]
