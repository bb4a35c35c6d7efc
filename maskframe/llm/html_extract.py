"""HTML extraction by wrapper induction.

A host's pages are aligned with a few of its own pages, its models, by simple tree matching: the trees are matched from their
roots, children in order, so that the most nodes (and among them the most equal texts) correspond. Over all pages of the
host it is counted how often each text node of a model has a counterpart and how often an equal one. Nodes that stay the same
on most pages are template; what varies is content, and the smallest element of the model that holds nearly all of the
varying text and the headings before it is the host's content region. A page's text is what lies in its counterpart of that region and is not template.

The HTML standard decides before: scripts, styles, forms, navigation, asides, footers and hidden elements hold no article. Where
a host has too few pages to compare, and for page kinds without a counterpart, explicit article and main elements hold the
article if they have most of the page's text. Class names only tell comments, adverts and the like, which vary as the article
does, and only by whole names.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, slices, texts_of

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
STOP = re.compile(r"""[>"']""")
ATTR = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
# Element names of the HTML standard by their kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data dfn em font i ins kbd label mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
OWN_END = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table tbody thead tfoot"), "td": ("td th", "tr"), "th": ("td th", "tr"), "option": ("option", "select")}
DROP = frozenset("head nav aside form button select option input label menu dialog svg canvas object embed audio video footer".split()) | RAW
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAF = HEADINGS | frozenset("# p li dt dd td th tr pre blockquote figcaption caption address summary".split())
# Class names of what is not the article though it varies, and words that may stand beside them in a name.
NAMES = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay sidebar sidebars widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar toolbar comment comments commentlist disqus replies respond related recommended share sharing social subscribe subscription newsletter signup login pagination pager skip copyright disclaimer".split())
BESIDE = frozenset("list item box area wrapper wrap container block section main left right top bottom inner outer bar post posts site page links link buttons button panel unit slot zone region primary secondary header form thread row col column group text title body content ul li div".split())
#: A text node is template if this share of at least this many pages of its host has the same text there.
CONSTANT, PAGES = 0.6, 3
#: Models a host; the share of varying text that the content region holds; the share of text that makes an article element the article.
MODELS, REGION, MAJORITY = 2, 0.8, 0.5
#: Elements deeper than this are laid out flat in their ancestor at that depth. Longer sibling lists are matched by equality first,
#: and what is between equal ones by place, so many at a time.
DEEPEST, WIDEST, STEP = 150, 60, 10
#: Models and statistics together up to this many bytes may be broadcast; hosts held at once by a worker.
BROADCAST_BYTES, HOSTS = 4 << 20, 500


# ---- pages as trees


class Tree:
    """A page's block elements and texts in document order; node 0 is the page. Texts have the label ``#``."""

    def __init__(self):
        self.parent, self.label, self.text, self.kids, self.main, self.named = [-1], ["page"], [""], [[]], [False], [False]
        self._digests: list[int] | None = None

    def add(self, parent: int, label: str, text: str, main: bool, named: bool) -> int:
        self.parent.append(parent), self.label.append(label), self.text.append(text), self.kids.append([]), self.main.append(main), self.named.append(named)
        self.kids[parent].append(len(self.label) - 1)
        return len(self.label) - 1

    def digests(self) -> list[int]:
        """Hashes of the subtrees: labels and texts."""
        if self._digests is None:
            out = [0] * len(self.label)
            for i in range(len(out) - 1, -1, -1):
                kids = self.kids[i]
                out[i] = hash((self.label[i], self.text[i], *[out[k] for k in kids])) if kids else hash((self.label[i], self.text[i]))
            self._digests = out
        return self._digests

    def chars(self) -> np.ndarray:
        """Characters of text in each subtree that no name excludes."""
        out = np.array([0 if no else len(x) for no, x in zip(self.named, self.text)], np.int64)
        for i in range(len(out) - 1, 0, -1):
            out[self.parent[i]] += out[i]
        return out


def names_no_article(names: str) -> bool:
    """Whether a class or id says that an element isn't part of the article: a listed word, beside structural words only."""
    for name in names.split():
        words = [w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if w and not w.isdigit()]
        if words and not NAMES.isdisjoint(words) and all(w in NAMES or w in BESIDE for w in words):
            return True
    return False


def tokens(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) with kind ``text``, ``start`` or ``end``, in one pass; what is never closed is text."""
    at, end, last = 0, len(html), html.rfind(">")
    # Quotes from which no bare > can be reached: every quote is walked through at most once in vain.
    dead: set[int] = set()
    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            yield "text", "", html[at:]
            return
        if lt > at:
            yield "text", "", html[at:lt]
        nxt = html[lt + 1 : lt + 2]
        if html.startswith("<!--", lt):
            z = html.find("-->", lt + 4)
            at = end if z < 0 else z + 3
        elif html.startswith("<![CDATA[", lt):
            z = html.find("]]>", lt + 9)
            yield "text", "", html[lt + 9 : end if z < 0 else z].replace("&", "&amp;")
            at = end if z < 0 else z + 3
        elif lt > last:  # no tag can end any more
            yield "text", "", html[lt:]
            return
        elif nxt in ("!", "?"):
            at = html.find(">", lt) + 1
        elif m := NAME.match(html, lt + (2 if nxt == "/" else 1)):
            p, walked = m.end(), []
            while True:  # the first > outside of quotes; a quote that never closes is no quote
                s = STOP.search(html, p)
                if s is not None and s[0] == ">":
                    p = s.start()
                    break
                z = -1 if s is None or s.start() in dead else html.find(s[0], s.end())
                if z < 0:
                    dead.update(walked if s is None else [*walked, s.start()])
                    p = html.find(">", m.end())
                    break
                walked.append(s.start())
                p = z + 1
            name = m[0].lower()
            yield "end" if nxt == "/" else "start", name, html[m.end() : p]
            at = p + 1
            if nxt != "/" and name in RAW:
                z = RAW_END[name].search(html, at)
                at = end if z is None else html.find(">", z.end() - 1) + 1 or end
        else:
            yield "text", "", "<"
            at = lt + 1


RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.I) for name in RAW}


def parse(html: str) -> Tree:
    """The tree of a page. End tags without a start are ignored, missing ones implied; what holds no article is left out."""
    t = Tree()
    # Open elements: tag, its block's node, left out, within an article, named as none, place of the nearest element that isn't inline.
    stack: list[tuple[str, int, bool, bool, bool, int]] = [("", 0, False, False, False, 0)]
    where: dict[str, list[int]] = {}
    loose: list[str] = []

    def settle() -> None:
        if loose:
            text = " ".join(unescape("".join(loose)).split())
            loose.clear()
            if text:
                t.add(stack[-1][1], "#", text, stack[-1][3], stack[-1][4])

    def close(i: int) -> None:
        if stack[-1][5] >= i or stack[-1][4] != stack[i - 1][4]:
            settle()
        for tag, *_ in stack[i:]:
            where[tag].pop()
        del stack[i:]

    def nearest(tags: str) -> int:
        return max((where[x][-1] for x in tags.split() if where.get(x)), default=0)

    for kind, tag, rest in tokens(html):
        if kind == "text":
            if not stack[-1][2]:
                loose.append(rest)
            continue
        if kind == "end":
            i = nearest(tag)
            if i and not (tag in INLINE and stack[-1][5] > i):
                close(i)
            continue
        if tag in CLOSES_P and stack[stack[-1][5]][0] == "p":
            close(stack[-1][5])
        if tag in OWN_END:
            own, stop = map(nearest, OWN_END[tag])
            if own > stop:
                close(own)
        _, block, out, inside, named, outer = stack[-1]
        main, label = tag in ("article", "main"), tag
        drop = tag in DROP or (tag == "header" and not inside)
        if rest and not rest.isspace():
            a = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTR.findall(rest)}
            role = a.get("role", "").lower()
            main = main or role == "main"
            drop = drop or role in ROLES or "hidden" in a or a.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", a.get("style", ""), re.I))
            if tag not in ("html", "body"):
                named = named or names_no_article(f"{a.get('class', '')} {a.get('id', '')}")
            # Classes with digits number a page, not its kind.
            label = ".".join([tag, *sorted(x for x in a.get("class", "").lower().split() if not re.search(r"\d", x))])
        inline = tag in INLINE
        if not inline or named != stack[-1][4]:
            settle()
        if tag in ("br", "hr"):
            loose.append(" ")
        if tag in RAW or tag in VOID or rest.endswith("/"):
            continue
        where.setdefault(tag, []).append(len(stack))
        if not inline and not (out or drop) and len(stack) <= DEEPEST:
            block = t.add(block, label, "", inside or main, named)
        stack.append((tag, block, out or drop, inside or main, named, outer if inline else len(stack)))
    settle()
    return t


# ---- simple tree matching


def matched(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: nodes of ``a`` to nodes of ``b`` with equal labels and matched parents, children in order, as many as
    can be; an equal text counts as one node more. Children that are whole equal subtrees at either end match first, and in
    sibling lists longer than ``WIDEST`` those in between that are equal too, in order."""
    da, db = a.digests(), b.digests()
    memo: dict[tuple[int, int], int] = {}
    pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}
    size: dict[int, int] = {}

    def nodes(x: int) -> int:
        if x not in size:
            size[x] = 1 + (a.label[x] == "#") + sum(map(nodes, a.kids[x]))
        return size[x]

    def weight(x: int, y: int) -> int:
        if a.label[x] != b.label[y]:
            return 0
        if da[x] == db[y]:
            return nodes(x)
        if a.label[x] == "#":
            return 1
        p, q = a.kids[x], b.kids[y]
        if len(p) == 1 == len(q) and a.label[p[0]] == "#" == b.label[q[0]]:
            return 2
        if (x, y) not in memo:
            memo[x, y] = 1 + best(x, y)
        return memo[x, y]

    def best(x: int, y: int) -> int:
        """The weight of the best matching of the children, which is noted."""
        p, q, out, total = a.kids[x], b.kids[y], [], 0
        lo, hp, hq = 0, len(p), len(q)
        while lo < min(hp, hq) and da[p[lo]] == db[q[lo]]:
            out.append((p[lo], q[lo]))
            total += nodes(p[lo])
            lo += 1
        while hp > lo and hq > lo and da[p[hp - 1]] == db[q[hq - 1]]:
            hp, hq = hp - 1, hq - 1
            out.append((p[hp], q[hq]))
            total += nodes(p[hp])
        for ps, qs in stretches(p[lo:hp], q[lo:hq]):
            if len(ps) == len(qs) == 1 and da[ps[0]] == db[qs[0]]:
                out.append((ps[0], qs[0]))
                total += nodes(ps[0])
                continue
            rows = [[0] * (len(qs) + 1)]
            for u in ps:
                up, row = rows[-1], [0]
                for j, v in enumerate(qs):
                    row.append(max(row[j], up[j + 1], up[j] + w if (w := weight(u, v)) else 0))
                rows.append(row)
            total += rows[-1][-1]
            i, j = len(ps), len(qs)
            while i and j:
                w = weight(ps[i - 1], qs[j - 1])
                if w and rows[i][j] == rows[i - 1][j - 1] + w:
                    out.append((ps[i - 1], qs[j - 1]))
                    i, j = i - 1, j - 1
                elif rows[i][j] == rows[i - 1][j]:
                    i -= 1
                else:
                    j -= 1
        pairs[x, y] = out
        return total

    def stretches(p: list[int], q: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        if len(p) <= WIDEST and len(q) <= WIDEST:
            yield p, q
            return
        # Subtrees that occur once on each side and are equal cut long lists, in order; what is between them is matched by place.
        once = Counter(da[x] for x in p)
        where = {db[y]: j for j, y in enumerate(q)}
        single = Counter(db[y] for y in q)
        i0 = j0 = 0
        for i, x in enumerate(p):
            j = where.get(da[x], -1)
            if j >= j0 and once[da[x]] == 1 and single[da[x]] == 1:
                yield from in_place(p[i0:i], q[j0:j])
                yield [x], [q[j]]
                i0, j0 = i + 1, j + 1
        yield from in_place(p[i0:], q[j0:])

    def in_place(p: list[int], q: list[int]) -> Iterator[tuple[list[int], list[int]]]:
        step = WIDEST if max(len(p), len(q)) <= WIDEST else STEP
        for s in range(0, max(len(p), len(q)), step):
            yield p[s : s + step], q[s : s + step]

    out, todo = {0: 0}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        if da[x] == db[y] and (x, y) not in pairs:
            some = list(zip(a.kids[x], b.kids[y]))
        else:
            if (x, y) not in pairs:
                best(x, y)
            some = pairs[x, y]
        for u, v in some:
            out[u] = v
            todo.append((u, v))
    return out


# ---- what a host's pages say


class Model:
    """One of a host's pages with what all pages say of its nodes: template texts and the content region."""

    def __init__(self, html: str, stats: list[tuple[int, int, int, int]]):
        """``stats``: (node, pages with a counterpart, pages with an equal text, characters that vary there)."""
        self.tree = t = parse(html)
        n = len(t.label)
        self.constant, varying = np.zeros(n, bool), np.zeros(n, np.int64)
        self.pages = 0
        for node, seen, same, chars in stats:
            # The model itself is one of the pages that have the node; what is template is told by the others.
            if node == 0:
                self.pages = seen + 1
            if t.label[node] == "#":
                kept = seen + 1 >= PAGES and same >= CONSTANT * seen
                self.constant[node] = kept and not (t.main[node] and t.label[t.parent[node]].partition(".")[0] in HEADINGS)
            if not self.constant[node]:
                varying[node] += chars
        for i in range(n - 1, 0, -1):
            varying[t.parent[i]] += varying[i]
        self.region = 0
        if self.pages >= PAGES and varying[0]:
            heads = [i for i in range(n) if varying[i] and t.label[i].partition(".")[0] in HEADINGS]
            at = 0
            while not t.main[at]:
                inner = [k for k in t.kids[at] if varying[k] >= REGION * varying[0] and t.label[k].partition(".")[0] not in LEAF]
                # A heading that varies belongs to what follows it.
                if not inner or any(at < h < inner[0] for h in heads):
                    break
                at = inner[0]
            self.region = at


def compare(page: Tree, model: Tree) -> list[tuple[int, int, int, int]] | None:
    """(model node, 1, equal text, varying characters) of one page; None for a copy of the model."""
    to = matched(page, model)
    out: dict[int, list[int]] = {}
    varies = False
    for i in range(len(page.label)):
        j = to.get(i)
        if page.label[i] != "#":
            if j == 0:
                out[0] = [1, 0, 0]
            continue
        if page.named[i]:
            continue
        if j is not None:
            same = page.text[i] == model.text[j]
            # A node that turns out to be template holds nothing that varies, so its characters count in any case.
            out[j] = [1, int(same), len(page.text[i])]
            varies |= not same
        else:
            p = page.parent[i]
            while p not in to:
                p = page.parent[p]
            row = out.setdefault(to[p], [0, 0, 0])
            row[2] += len(page.text[i])
            varies = True
    return [(j, *row) for j, row in out.items()] if varies else None


def by_standard(t: Tree, chars: np.ndarray) -> set[int]:
    """Where no template tells: the outermost article and main elements if they have most of the text, else the page."""
    mains = [i for i in range(1, len(t.label)) if t.main[i] and not t.main[t.parent[i]] and t.label[i] != "#"]
    return set(mains) if mains and sum(chars[i] for i in mains) >= MAJORITY * max(1, chars[0]) else {0}


def extract(html: str, models: list[Model] = ()) -> tuple[str, bool]:
    """The main text of a page, and whether its host's template decided about it."""
    if not html:
        return "", False
    t = parse(html)
    chars = t.chars()
    constant, roots, told = set(), None, False
    some = [m for m in models if m.pages >= PAGES]
    if some:
        fits = [(matched(t, m.tree), m) for m in some]
        to, m = max(fits, key=lambda f: sum(1 for i, j in f[0].items() if t.label[i] == "#") + len(f[0]))
        constant = {i for i, j in to.items() if m.constant[j]}
        found = {i for i, j in to.items() if j == m.region}
        if found and m.region:
            own = np.array([0 if t.named[i] or i in constant else len(t.text[i]) for i in range(len(t.label))])
            held = np.zeros(len(own), bool)
            for i in range(len(own)):
                held[i] = i in found or (i > 0 and held[t.parent[i]])
            # A page of another kind may have its story elsewhere.
            if own[held].sum() >= MAJORITY * own.sum():
                roots, told = found, True
    if roots is None:
        roots = by_standard(t, chars)
    inside = np.zeros(len(t.label), bool)
    texts = []
    for i in range(len(t.label)):
        inside[i] = i in roots or (i > 0 and inside[t.parent[i]])
        if inside[i] and t.text[i] and not t.named[i]:
            texts.append((t.text[i], i in constant))
    kept = [x for x, same in texts if not same]
    # A page of which nothing varies is a copy of others: then nothing tells template from content.
    if not kept:
        kept = [x for x, _ in texts]
    return " ".join(kept), told or any(same for _, same in texts)


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", 1))


def induced(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(host, models, stats): the models are the host's pages of the lowest hashes by several seeds; the statistics cover all pages."""
    rows = pages.select(host_of(url).alias("host"), F.col(html).alias("_h")).where(F.length("_h") > 0)
    least = [F.min(F.struct(F.xxhash64(F.lit(k), "_h").alias("x"), F.col("_h").alias("html"))).alias(f"m{k}") for k in range(MODELS)]
    models = cut(rows.groupBy("host").agg(*least).select("host", F.array_distinct(F.array(*[F.col(f"m{k}.html") for k in range(MODELS)])).alias("models")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        total: dict = {}

        def told() -> pa.RecordBatch:
            keys = list(total)
            cols = list(zip(*[(*k, *total[k]) for k in keys])) or [[]] * 6
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), *(pa.array(c, pa.int64()) for c in cols[1:])], names=["host", "model", "node", "seen", "same", "chars"])

        for b in slices(batches, "_h"):
            for host, text, known in zip(*(b.column(c).to_pylist() for c in ("host", "_h", "models"))):
                if host not in held:
                    if len(held) > HOSTS:
                        held.clear()
                    held[host] = [parse(m) for m in known]
                page = parse(text)
                for k, model in enumerate(held[host]):
                    for node, *row in compare(page, model) or ():
                        at = total.setdefault((host, k, node), [0, 0, 0])
                        for i in range(3):
                            at[i] += row[i]
            if len(total) > 100_000:
                yield told()
        yield told()

    size = models.agg(F.sum(F.aggregate("models", F.lit(0), lambda a, m: a + F.length(m)))).first()[0] or 0
    at = rows.join(F.broadcast(models) if size <= BROADCAST_BYTES else models, "host")
    sums = at.select("host", "_h", "models").mapInArrow(count, "host string, model long, node long, seen long, same long, chars long")
    sums = sums.groupBy("host", "model", "node").agg(*[F.sum(c).alias(c) for c in ("seen", "same", "chars")])
    # As many rows a host as its models have text nodes, whatever the number of its pages.
    stats = sums.groupBy("host").agg(F.array_sort(F.collect_list(F.struct("model", "node", "seen", "same", "chars"))).alias("stats"))
    return cut(models.join(stats, "host", "left"))


def extracted(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row a page: ``page_id, url, text, n_chars, by_template``.

    A null or empty page has empty text; a null url is a host of its own name; repeated rows are extracted each (and each
    count for their host's statistics, but for copies of a model); an empty table gives none; other columns are ignored.
    ``by_template`` says whether the host's template decided what of the page is content.
    """
    known = induced(pages, url, html)
    size = known.agg(F.sum(F.aggregate("models", F.lit(0), lambda a, m: a + F.length(m)) + 40 * F.coalesce(F.size("stats"), F.lit(0)))).first()[0] or 0
    at = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), host_of(url).alias("host"), F.col(html).alias("_h")).join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def models(host: str, b: pa.RecordBatch, i: int) -> list[Model]:
            if host not in held:
                if len(held) > HOSTS:
                    held.clear()
                stats = b.column("stats")[i].as_py() or []
                held[host] = [Model(m, [(r["node"], r["seen"], r["same"], r["chars"]) for r in stats if r["model"] == k]) for k, m in enumerate(b.column("models")[i].as_py() or [])]
            return held[host]

        for b in slices(batches, "_h"):
            out = [extract(text, models(host, b, i)) if text else ("", False) for i, (text, host) in enumerate(zip(texts_of(b.column("_h")), b.column("host").to_pylist()))]
            text = [x for x, _ in out]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(text, pa.string()), pa.array(map(len, text), pa.int64()), pa.array([x for _, x in out], pa.bool_())], names=["page_id", "url", "text", "n_chars", "by_template"])

    kind = dict(pages.dtypes)[key]
    return at.select("page_id", "url", "host", "_h", "models", "stats").mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long, by_template boolean")
