"""Fill-in-middle: texts cut at units into prefix, middle and suffix, found by a sparse index of checkpoints.

One pass over a text's bytes counts its units and notes, at every so many of them, where they start in bytes and in code points. A
cut between two units is then found by binary search among the checkpoints and a short rescan from there, so that neither the
places of all units nor a second pass over the text are needed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices

#: Units between two checkpoints, and bytes that are counted at once.
EVERY, WINDOW = 512, 1 << 18
#: The marks of the parts.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Out of a hundred: documents that are transformed, and those of them that have the suffix first.
RATE, SUFFIX_FIRST = 90, 20

_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True


class Index(NamedTuple):
    """Units and code points of a text, and its checkpoints: unit, byte and code point at which each starts."""

    units: int
    points: int
    unit: np.ndarray
    byte: np.ndarray
    point: np.ndarray


def heads(raw: np.ndarray, before: bool) -> tuple[np.ndarray, np.ndarray]:
    """(first bytes of code points, first bytes of units) among ``raw``; ``before``: whether a letter stands just before it."""
    point = (raw & 0xC0) != 0x80
    alpha = _ALPHA[raw]
    goes_on = alpha & np.r_[before, alpha[:-1]]
    return point, point & ~goes_on


def index(text: bytes, every: int = EVERY, window: int = WINDOW) -> Index:
    """Counts the units of a text (runs of A-Z and a-z, or any other single code point) and notes each ``every``-th of them."""
    whole, units, points, before = np.frombuffer(text, np.uint8), 0, 0, False
    noted: list[tuple[np.ndarray, ...]] = []
    for a in range(0, len(whole), window):
        raw = whole[a : a + window]
        point, unit = heads(raw, before)
        starts = np.flatnonzero(unit)
        mine = starts[-units % every :: every]
        if len(mine):
            noted.append((units + np.arange(-units % every, len(starts), every), a + mine, points + np.cumsum(point)[mine] - 1))
        units, points, before = units + len(starts), points + int(np.count_nonzero(point)), bool(_ALPHA[raw[-1]])
    return Index(units, points, *(np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*noted) if noted else ((), (), ()))))


def locate(text: bytes, at: Index, unit: int) -> tuple[int, int]:
    """(byte, code point) at which the unit starts; the end of the text for the number of units."""
    if unit >= at.units:
        return len(text), at.points
    i = int(np.searchsorted(at.unit, unit, "right")) - 1
    byte, point, left = int(at.byte[i]), int(at.point[i]), unit - int(at.unit[i])
    if not left:
        return byte, point
    # The checkpoint's own unit starts at the first byte. Units can be of any length, so the rescan goes on in growing strides.
    left, stride, before = left + 1, 2048, False
    while True:
        raw = np.frombuffer(text, np.uint8, min(stride, len(text) - byte), byte)
        points, units = heads(raw, before)
        starts = np.flatnonzero(units)
        if len(starts) >= left:
            end = int(starts[left - 1])
            return byte + end, point + int(np.count_nonzero(points[:end]))
        left, before = left - len(starts), bool(_ALPHA[raw[-1]])
        byte, point, stride = byte + len(raw), point + int(np.count_nonzero(points)), stride * 2


class Parts(NamedTuple):
    """A document's units, its form, the parts' code points (None if plain), and what it becomes."""

    units: int
    form: str
    prefix: int | None
    middle: int | None
    output: bytes


def transform(key: str, text: bytes, seed: int = 1) -> Parts:
    at = index(text)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i : i + 8], 16) for i in (0, 8, 16, 24))
    if not text or h3 % 100 >= RATE or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return Parts(at.units, "plain", None, None, text)
    a, b = sorted((h1 % (at.units + 1), h2 % (at.units + 1)))
    (a, p), (b, q) = locate(text, at, a), locate(text, at, b)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return Parts(at.units, "spm", p, q - p, b"".join([SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle]))
    return Parts(at.units, "psm", p, q - p, b"".join([PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle]))


def restore(output: bytes, form: str) -> bytes:
    """The text itself, from the output and its form: no text that was transformed holds a mark."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    a, b = output.index(second), output.index(MIDDLE)
    one, two, middle = output[len(first) : a], output[a + len(second) : b], output[b + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def _parts(batches: Iterator[pa.RecordBatch], seed: int) -> Iterator[tuple[pa.Array, list[Parts]]]:
    for b in slices(batches, "_t"):
        keys = b.column("_s").to_pylist()
        yield b.column("_k"), [transform(k or "", t, seed) for k, t in zip(keys, bytes_of(b.column("_t")))]


def _rows(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, str]:
    return docs.select(F.col(key).alias("_k"), F.col(key).cast("string").alias("_s"), F.col(text).alias("_t")), docs.select(F.col(key)).dtypes[0][1]


_COLS = "n long, form string, prefix_chars long, middle_chars long"


def _columns(parts: list[Parts]) -> list[pa.Array]:
    n, form, prefix, middle, _ = zip(*parts) if parts else ((),) * 5
    return [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64())]


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: every whole text cut and put together anew.

    Cuts and form come from a hash of the key, a null key counting as the empty text. A null or empty text is plain, as is one
    that holds a mark; a text of one unit has it in one of the parts; repeated rows get the same; an empty table gives none;
    other columns are ignored. Texts are read in windows; a batch of them holds about 8 MB or one text.
    """
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, parts in _parts(batches, seed):
            yield pa.RecordBatch.from_arrays([keys, *_columns(parts), pa.array([p.output for p in parts], pa.binary()).cast(pa.string())], names=["doc_id", *(c.split()[0] for c in _COLS.split(", ")), "output"])

    return rows.mapInArrow(run, f"doc_id {kind}, {_COLS}, output string")


def restored(cut: DataFrame) -> DataFrame:
    """``doc_id, text`` from the ``output`` and ``form`` of :func:`fill_in_middle`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "output"):
            out = [restore(o, f) for o, f in zip(bytes_of(b.column("output")), b.column("form").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.binary()).cast(pa.string())], names=["doc_id", "text"])

    rows = cut.select("doc_id", "form", "output")
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, text string")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256``: the same without carrying the outputs."""
    rows, kind = _rows(docs, key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, parts in _parts(batches, seed):
            hashed = [[hashlib.sha256(x).hexdigest() for x in xs] for xs in ((p.output for p in parts), (restore(p.output, p.form) for p in parts))]
            yield pa.RecordBatch.from_arrays([keys, *_columns(parts), *(pa.array(x, pa.string()) for x in hashed)], names=["doc_id", *(c.split()[0] for c in _COLS.split(", ")), "output_sha256", "restored_sha256"])

    return rows.mapInArrow(run, f"doc_id {kind}, {_COLS}, output_sha256 string, restored_sha256 string")


#: The contract in DuckDB's SQL.
SQL = r"""
WITH cut AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
h AS (SELECT doc_id, t, u, len(u)::BIGINT AS n, ('0x' || d[1:8])::UBIGINT AS h1, ('0x' || d[9:16])::UBIGINT AS h2, ('0x' || d[17:24])::UBIGINT AS h3, ('0x' || d[25:32])::UBIGINT AS h4 FROM cut),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS a, greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:n], '') AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(coalesce(pre, ''))::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(coalesce(mid, ''))::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || coalesce(pre, '') || '<S>' || coalesce(suf, '') || '<M>' || coalesce(mid, '') ELSE '<S>' || coalesce(suf, '') || '<P>' || coalesce(pre, '') || '<M>' || coalesce(mid, '') END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p
"""
