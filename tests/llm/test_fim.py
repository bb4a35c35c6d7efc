import hashlib
import random
import re

import duckdb
import pytest

from maskframe.llm import fim, queries

from . import cases

SF = "/root/testdata/sf0.01"


def plain(doc_id, text):
    """The contract by a regular expression over code points."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(d[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not t or any(m in t for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, t
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def texts():
    r = random.Random(5)
    marks = [(2000 + i, t, None, None, None) for i, t in enumerate(["<", "a<S", "<S<S", "P>a<P", ">x<", "<P>", "a<M>b", "<P", "é" * 9, "\x00a\x00", "a", "ab", "1", "😀a😀", "abc " * 30_000, "x" * 300_000 + "é" + "y" * 300_000])]
    return marks + [(i, "".join(r.choice("aZ é中\n<>PSM1😀") for _ in range(r.randrange(0, 80))), "en", "s", 1) for i in range(400)]


@pytest.mark.parametrize("clash", [False, True])
def test_cuts_forms_and_restoring(spark, clash):
    data = cases.EDGES + texts()
    df = cases.frame(spark, data, clash)
    got = [tuple(r) for r in fim.fill_in_middle(df).collect()]
    want = [(d[0], *plain(d[0], d[1])) for d in data]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    back = fim.restored(fim.fill_in_middle(df)).collect()
    assert sorted(((r[0], r[1]) for r in back), key=str) == sorted(((d[0], d[1] or "") for d in data), key=str)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    hashed = [tuple(r) for r in fim.digests(df).collect()]
    assert sorted(hashed, key=str) == sorted(((w[0], *w[1:5], sha(w[5]), sha(d[1] or "")) for d, w in zip(data, want)), key=str)


@pytest.mark.parametrize("every,window", [(1, 7), (3, 1), (4, 50), (512, 1 << 18)])
def test_every_cut_by_checkpoints(every, window):
    r = random.Random(every)
    for size in (0, 1, 5, 200):
        text = "".join(r.choice(["a", "bc", " ", "é", "中", "😀", "x" * 30]) for _ in range(size))
        units, raw = re.findall(r"[A-Za-z]+|[^A-Za-z]", text), text.encode()
        at = fim.index(raw, every, window)
        assert (at.units, at.points) == (len(units), len(text))
        assert at.unit.tolist() == list(range(0, len(units), every))
        for i in range(len(units) + 1):
            head = "".join(units[:i])
            assert fim.locate(raw, at, i) == (len(head.encode()), len(head))


def test_cuts_in_units_longer_than_a_stride():
    text = ("x" * 5000 + "é" * 3) * 4
    raw, units = text.encode(), re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    at = fim.index(raw)
    for i in range(len(units) + 1):
        assert fim.locate(raw, at, i)[0] == len("".join(units[:i]).encode())


def test_empty_table(spark):
    df = cases.frame(spark, [])
    assert fim.digests(df).count() == fim.restored(fim.fill_in_middle(df)).count() == 0


def test_query_against_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = queries.op13_fill_in_middle(spark, SF)
    want = db.execute(fim.SQL)
    assert got.columns == [c[0] for c in want.description]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want.fetchall())
