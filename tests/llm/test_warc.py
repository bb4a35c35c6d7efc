import hashlib
import io
import os
import zipfile

import pytest

from maskframe.llm import warc

SCHEMA = "page_id long, url string, html string"


def rows():
    long = "<p>" + "wörd " * 400
    out = [(i, f"http://h{i % 3}.example.org/{i}", f"<html>{i}" + "x" * i * 40) for i in range(60)]
    out += [(100 + i, "http://a/\r\nInjected: yes", long) for i in range(5)] + [(200, None, None), (201, "u", ""), (202, "u", ""), (203, "u", "s" * 999), (204, "u", "s" * 999), (None, "n", long), (104, "http://a/again", long)]
    return out


def expected(data):
    best = {}
    for k, _, h in data:
        if k is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, k), k)
    out = []
    for k, _, h in data:
        b = (h or "").encode()
        first = best.get(h)
        many = sum(x[2] == h for x in data) > 1
        revisit = many and first is not None and first != k
        out.append((k, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=repr)


def test_round_trip(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame(data, SCHEMA).selectExpr("*", "1 as digest", "'p' as payload", "2 as first").repartition(3)
    packages = warc.write(df, f"file://{tmp_path}/w")
    got = warc.read(packages, f"file://{tmp_path}/w").collect()
    assert sorted([(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got], key=repr) == expected(data)
    by = {(r["page_id"], r["url"]): r for r in got}
    assert bytes(by[59, "http://h2.example.org/59"]["payload"]).decode() == data[59][2]
    assert by[200, None]["payload"] == b"" and by[100, "http://a/%0D%0AInjected: yes"]["payload"] is None
    assert not [f for f in os.listdir(tmp_path / "w") if f.endswith(".part")]
    assert warc.read(warc.write(df.limit(0), f"file://{tmp_path}/e"), f"file://{tmp_path}/e").count() == 0


def package(n=50, comment=b""):
    out = io.BytesIO()
    p = warc.Package(out)
    for i in range(n):
        body = f"body {i}".encode() * i
        p.add(i, warc.record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None, False))
    p.zip.comment = comment
    p.close()
    return out.getvalue()


class Counting:
    def __init__(self, data):
        self.data, self.most = data, 0

    def __call__(self, at, n):
        self.most = max(self.most, n)
        return self.data[at : at + n]


@pytest.mark.parametrize("zip64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"PK\x05\x06 not the end"])
def test_directories(monkeypatch, zip64, comment):
    if zip64:  # as if the package were beyond the old format's limits
        monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 100)
        monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    data = package(comment=comment)
    assert (b"PK\x06\x06" in data) == zip64
    got = list(warc.records(Counting(data), len(data)))
    assert [r[0] for r in got] == list(range(50)) and got[7][2] == b"body 7" * 7
    if comment:  # zipfile itself is misled by this one
        return
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX]


def test_reads_by_range(monkeypatch):
    data = package(400)
    monkeypatch.setattr(warc, "FETCH", 2000)
    read = Counting(data)
    assert len(list(warc.records(read, len(data)))) == 400
    assert read.most < 70_000


def test_damage_is_found():
    data = package(5)
    found = warc.members(Counting(data), len(data))
    at, n = warc.place(Counting(data), found[warc.DATA])
    bad = bytearray(data)
    bad[at + n - 40] ^= 0xFF
    with pytest.raises(Exception):
        list(warc.records(Counting(bytes(bad)), len(bad)))
    with pytest.raises(ValueError):
        warc.members(Counting(b"no archive"), 10)


@pytest.mark.parametrize("index", ["none", "plain", "json"])
def test_members_of_any_name(index):
    raws = []
    for i in range(30):
        body = f"body {i}".encode() * (i + 1)
        raws.append(warc.record(i, f"http://x/{i}", body, hashlib.sha1(body).hexdigest(), None, False))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr("datapackage.json", "{}")
        for k, part in enumerate((raws[:20], raws[20:])):
            z.writestr(f"some/where/rec-{k}.warc.gz", b"".join(part))
        if index == "json":
            lines = []
            for k, part in enumerate((raws[:20], raws[20:])):
                at = 0
                for r in part:
                    lines.append(f'x) 2020 {{"offset": "{at}", "length": {len(r)}, "filename": "rec-{k}.warc.gz"}}')
                    at += len(r)
            z.writestr("indexes/main.cdxj", "\n".join(lines))
        if index == "plain":
            z.writestr("a.cdx", "")
    data = out.getvalue()
    assert sorted(r[0] for r in warc.records(Counting(data), len(data))) == list(range(30))
