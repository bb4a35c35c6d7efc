"""Language identification: script ranges narrow the candidates, then Viterbi over per-word scores labels spans.

A word's score in a language is its log probability under a character model of that language (four-character windows backed
off to shorter ones). Runs of letters without white space are cut at changes of script and into bounded pieces, each a word of its
own, so that texts of scripts without spaces are learned and scored to their end. Switching between languages within a text costs a fixed penalty, so stray words don't break a span.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, slices, texts_of

#: Labelled training documents of which the model is fitted: the bound of the one sample this module takes.
FIT_ROWS = 12_000
ORDER = 4
PENALTY = 8.0
#: Letters of a word at most, and in scripts that put no spaces between words; longer runs are several words.
PIECE, UNSPACED_PIECE, UNSPACED = 64, 8, frozenset({"han", "kana", "thai", "lao"})
#: Words scored at once, and words of a language held at once while counting.
SCORED, COUNTED = 50_000, 200_000
_EDGES = ".,;:!?\"'()[]{}<>|#*$%&-_/\\"
_BASE = np.int64(1_000_003)
#: First code points of blocks that tell scripts apart (Unicode block ranges), by name.
SCRIPTS = [(0x0041, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "indic"), (0x0E00, "thai"), (0x0E80, "lao"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other")]


@lru_cache(4096)
def script(ch: str) -> str:
    """The script of a letter, by range; empty for what is not a letter."""
    if not ch.isalpha():
        return ""
    at = ord(ch)
    name = "latin"
    for first, label in SCRIPTS:
        if at < first:
            break
        name = label
    return name


def letters(word: str) -> str:
    """The word in lower case, other characters than letters and combining marks left out."""
    word = word.strip(_EDGES)
    if word.isalpha():
        return word.lower()
    return "".join(c for c in word.lower() if c.isalpha() or unicodedata.category(c)[0] == "M")


def script_of(word: str) -> str:
    """The script of the first letter that has a known one."""
    first = script(word[0])
    return first if first not in ("", "other") else next((s for s in map(script, word) if s not in ("", "other")), first)


def pieces(plain: str) -> list[str]:
    """What ``letters`` gave as consecutive words of one script and bounded length; nothing is left out."""
    if len(plain) <= PIECE and plain.isascii():
        return [plain] if plain else []
    runs, start, now = [], 0, ""
    for i, c in enumerate(plain):
        s = script(c)
        # Marks and letters of unlisted scripts stay with what is before them.
        if s and s != "other" and s != now:
            if now:
                runs.append((start, i, now))
                start = i
            now = s
    runs.append((start, len(plain), now))
    out = []
    for a, z, name in runs:
        step = UNSPACED_PIECE if name in UNSPACED else PIECE
        out += [plain[i : min(i + step, z)] for i in range(a, z, step)]
    return out


def grams(word: str) -> list[str]:
    padded = f"^{word}$"
    return [padded[max(0, i - k + 1) : i + 1] for i in range(1, len(padded)) for k in range(1, ORDER + 1) if i - k + 1 >= 0]


def folded(padded: str) -> list[np.ndarray]:
    """For k from 1 to ORDER, a number of the k characters that end at each place."""
    c = np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    out = [c]
    for _ in range(1, ORDER):
        up = c.copy()
        up[1:] += out[-1][:-1] * _BASE
        out.append(up)
    return out


@dataclass
class Model:
    """Per length of gram the sorted numbers of the grams met and, by language, the log probability of their last character."""

    langs: list[str]
    codes: list = field(default_factory=list)
    rows: list = field(default_factory=list)
    least: float = math.log(1e-7)
    scripts: dict = field(default_factory=dict)  # script -> languages (bool) that use it

    def words(self, plain: list[str]) -> np.ndarray:
        """Log scores of words, by language; languages that don't use a word's script fall behind."""
        if not plain:
            return np.zeros((0, len(self.langs)))
        lengths = np.fromiter(map(len, plain), np.int64, len(plain)) + 2
        starts = np.cumsum(lengths) - lengths
        at = np.arange(lengths.sum()) - np.repeat(starts, lengths)
        found, out = at == 0, np.zeros((len(at), len(self.langs)))
        grams = folded("^" + "$^".join(plain) + "$")
        for k in range(ORDER, 0, -1):
            todo = np.flatnonzero(~found & (at >= k - 1))
            if not len(todo) or not len(self.codes[k - 1]):
                continue
            g = grams[k - 1][todo]
            i = np.minimum(np.searchsorted(self.codes[k - 1], g), len(self.codes[k - 1]) - 1)
            hit = self.codes[k - 1][i] == g
            # Each step to a shorter gram costs a nat, as in simple back-off.
            out[todo[hit]] = self.rows[k - 1][i[hit]] - (np.minimum(at[todo[hit]] + 1, ORDER) - k)[:, None]
            found[todo[hit]] = True
        out[~found] = self.least
        total = np.add.reduceat(out, starts, axis=0)
        for i, s in enumerate(map(script_of, plain) if any(not ok.all() for ok in self.scripts.values()) else []):
            ok = self.scripts.get(s)
            if ok is not None and not ok.all() and ok.any():
                total[i][~ok] -= 50.0
        return total


def counted(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n) over the labelled sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, Counter] = {}
        totals: dict[str, Counter] = {}

        def settle(lg: str) -> None:
            total = totals.setdefault(lg, Counter())
            for w, n in found.pop(lg).items():
                for g in grams(w):
                    total[g] += n
                total["@" + script_of(w)] += n

        for b in slices(batches, text):
            for t, lg in zip(texts_of(b.column(text)), b.column(lang).to_pylist()):
                c = found.setdefault(lg, Counter())
                for w, n in Counter(t.split()).items():
                    for piece in pieces(letters(w)):
                        c[piece] += n
                if len(c) > COUNTED:
                    settle(lg)
        for lg in list(found):
            settle(lg)
        for lg, total in totals.items():
            keys = list(total)
            for i in range(0, len(keys), 50_000):
                part = keys[i : i + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array([lg] * len(part)), pa.array(part), pa.array([total[k] for k in part], pa.int64())], names=["lang", "gram", "n"])

    return docs.select(text, lang).mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows: int = FIT_ROWS) -> Model:
    """Learns from at most about ``rows`` labelled documents outside the held-out fold, those whose keys hash lowest."""
    train = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t"), F.col(lang).alias("_l")).where(F.col("_l").isNotNull() & F.col("_t").isNotNull()).where(~held_out("_k", 4))
    n = train.select("_k").count()
    if n > rows:
        train = train.where(F.pmod(F.xxhash64(F.lit("langid"), "_k"), F.lit(1 << 30)) < int((1 << 30) * rows / n))
    # Rare grams carry no evidence; the sample bounds how many there are.
    got = counted(train, "_t", "_l").where("n >= 2").collect()
    langs = sorted({r["lang"] for r in got})
    m = Model(langs)
    if not langs:
        return m
    where = {x: i for i, x in enumerate(langs)}
    counts: dict[str, np.ndarray] = {}
    for r in got:
        counts.setdefault(r["gram"], np.zeros(len(langs)))[where[r["lang"]]] += r["n"]
    scripts = {g[1:]: counts.pop(g) for g in [g for g in counts if g[0] == "@"]}
    words = np.sum(list(scripts.values()), axis=0)
    for name, c in scripts.items():
        m.scripts[name] = c > 0.01 * words  # of the language's own words, however few they are
    uni = np.sum([c for g, c in counts.items() if len(g) == 1], axis=0)
    chars = sum(len(g) == 1 for g in counts)
    context: dict[str, np.ndarray] = {}
    for g, c in counts.items():
        context[g[:-1]] = context.get(g[:-1], 0) + c
    prob: dict[str, np.ndarray] = {}
    for k in range(1, ORDER + 1):
        keys = [g for g in counts if len(g) == k]
        for g in keys:
            if k == 1:
                prob[g] = (counts[g] + 0.5) / (uni + 0.5 * (chars + 1))
            else:
                prob[g] = (counts[g] + 3.0 * prob.get(g[1:], 1e-6)) / (context[g[:-1]] + 3.0)
        code = np.array([folded(g)[k - 1][-1] for g in keys], np.int64)
        order = np.argsort(code)
        m.codes.append(code[order])
        m.rows.append(np.log(np.maximum(np.array([prob[g] for g in keys]).reshape(len(keys), len(langs)), 1e-9))[order])
    return m


def viterbi(s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best label of each word: the sum of its scores less ``penalty`` for each change of label."""
    n, k = s.shape
    if k == 1 or not n:
        return np.zeros(n, np.int64)
    total = s.sum(0)
    best = int(total.argmax())
    # One label throughout is best if no stretch gains half a penalty in another language.
    gain = np.cumsum(s - s[:, best : best + 1], axis=0)
    low = np.minimum.accumulate(np.vstack([np.zeros(k), gain[:-1]]), axis=0)
    if (gain - low).max() <= penalty / 2:
        return np.full(n, best, np.int64)
    back, delta, rows = np.empty((n, k), np.int64), s[0].tolist(), s.tolist()
    back[0] = range(k)
    stay = list(range(k))
    for t in range(1, n):
        top = max(delta)
        j = delta.index(top)
        top -= penalty
        if min(delta) >= top:
            back[t] = stay
            delta = [d + x for d, x in zip(delta, rows[t])]
        else:
            back[t] = [i if d >= top else j for i, d in enumerate(delta)]
            delta = [(d if d >= top else top) + x for d, x in zip(delta, rows[t])]
    out = np.empty(n, np.int64)
    out[-1] = delta.index(max(delta))
    for t in range(n - 1, 0, -1):
        out[t - 1] = back[t, out[t]]
    return out


class Labeller:
    """Labels whole texts, the words of a batch scored together."""

    def __init__(self, model: Model):
        self.model = model

    def labelled(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per text the scores and the labels of its words (``pieces``) that have a letter."""
        index: dict[str, int] = {}
        places = [np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words)) for words in map(str.split, texts)]
        split = [pieces(letters(w)) for w in index]
        count = np.fromiter(map(len, split), np.int64, len(split))
        start = np.cumsum(count) - count
        plain = [p for ps in split for p in ps]
        table = np.concatenate([self.model.words(plain[i : i + SCORED]) for i in range(0, max(1, len(plain)), SCORED)])
        for at in places:
            n = count[at]
            s = table[np.repeat(start[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            yield s, viterbi(s)

    def stretches(self, labels: np.ndarray) -> list[tuple[int, int, str]]:
        """(first word, end, language) of the stretches of one label; words without a letter are not counted."""
        edges = [0, *(np.flatnonzero(np.diff(labels)) + 1).tolist(), len(labels)]
        return [(a, b, self.model.langs[labels[a]]) for a, b in zip(edges, edges[1:]) if b > a]

    def told(self, texts: list[str]) -> Iterator[tuple[str, float, np.ndarray]]:
        """The language of most words of each text, their share, and the words' labels; ``und`` without a letter or without a model."""
        if not self.model.langs:
            yield from [("und", 0.0, np.zeros(0, np.int64))] * len(texts)
            return
        for s, labels in self.labelled(texts):
            if not len(s):
                yield "und", 0.0, labels
                continue
            n = np.bincount(labels, minlength=len(self.model.langs))
            total = s.sum(0)
            best = max(range(len(n)), key=lambda i: (n[i], total[i]))
            yield self.model.langs[best], float(n[best] / n.sum()), labels

    def label(self, texts: list[str]) -> list[tuple[str, float]]:
        return [t[:2] for t in self.told(texts)]

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        ((_, _, labels),) = self.told([text])
        return self.stretches(labels)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", model: Model | None = None, spans: bool = True) -> DataFrame:
    """One row a document: ``doc_id, held_out, lang_pred, score``, and ``spans`` (first word, end, language) unless they aren't wanted.

    ``lang`` is read only to fit; null texts and texts without a letter are ``und`` with score 0; ties fall to the higher
    total score; repeated rows are labelled each; an empty table gives none; other columns are ignored.
    """
    spread = docs.sparkSession.sparkContext.broadcast(model or fit(docs, key, text, lang))
    span = pa.list_(pa.struct([("first_word", pa.int64()), ("end_word", pa.int64()), ("lang", pa.string())]))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(spread.value)
        for b in slices(batches, "_t"):
            got = list(lab.told(texts_of(b.column("_t"))))
            cols = [b.column("doc_id"), b.column("held_out"), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())]
            names = ["doc_id", "held_out", "lang_pred", "score"]
            if spans:
                cols.append(pa.array([[dict(zip(("first_word", "end_word", "lang"), x)) for x in lab.stretches(g[2])] for g in got], span))
                names.append("spans")
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kind = docs.select(F.col(key)).dtypes[0][1]
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double" + ", spans array<struct<first_word:long,end_word:long,lang:string>>" * spans
    return docs.select(F.col(key).alias("doc_id"), held_out(key, 4).alias("held_out"), F.col(text).alias("_t")).mapInArrow(label, schema)


def keep_known(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, in which one language labels at least ``least`` of the words."""
    spread = docs.sparkSession.sparkContext.broadcast(fit(docs, key, text, lang))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lab = Labeller(spread.value)
        for b in slices(batches, text):
            got = lab.label(texts_of(b.column(text)))
            yield b.filter(pa.array([g[0] != "und" and g[1] >= least for g in got], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
