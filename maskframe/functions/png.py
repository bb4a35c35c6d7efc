"""PNG pictures as arrays, by numpy: every colour type, depth and filter, also interlaced."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Fixed values of the format: signature, channels of each colour type, and the passes of interlaced pictures (y, x, steps).
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
PASSES = [(0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)]


def encode(planes: np.ndarray, level: int = 6) -> bytes:
    """One (grey) or three (colours) planes of bytes. The same planes give the same bytes."""
    ch, h, w = planes.shape
    kind = {n: k for k, n in CHANNELS.items() if k != 3}[ch]
    rows = np.ascontiguousarray(planes.transpose(1, 2, 0), np.uint8).reshape(h, w * ch)
    # Every line is the difference to the one above it.
    up = np.diff(rows, axis=0, prepend=np.zeros((1, w * ch), np.uint8))
    raw = np.hstack([np.full((h, 1), 2, np.uint8), up]).tobytes()
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw, level)) + chunk(b"IEND", b"")


def chunk(name: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def chunks(raw: bytes) -> list[tuple[bytes, bytes]]:
    """(name, data) of a file's chunks; a wrong signature, length or checksum is an error."""
    if raw[:8] != SIGNATURE:
        raise ValueError("no PNG picture")
    out, at = [], 8
    while at < len(raw) and (not out or out[-1][0] != b"IEND"):
        if at + 12 > len(raw):
            raise ValueError("the picture is cut off")
        (n,) = struct.unpack(">I", raw[at : at + 4])
        name, data, crc = raw[at + 4 : at + 8], raw[at + 8 : at + 8 + n], raw[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or struct.unpack(">I", crc)[0] != zlib.crc32(name + data):
            raise ValueError("the picture is damaged")
        out.append((name, data))
        at += 12 + n
    if not out or out[0][0] != b"IHDR" or out[-1][0] != b"IEND":
        raise ValueError("the picture is cut off")
    return out


def unfiltered(lines: np.ndarray, bpp: int) -> np.ndarray:
    """Lines of bytes, each with its filter in front, as they were. A byte depends on those to its left, above, and above left,
    so that all pixels of one diagonal are found at once."""
    kind, rows = lines[:, 0], lines[:, 1:]
    h, n = rows.shape
    if kind.max(initial=0) > 4:
        raise ValueError("an unknown filter")
    if not n or not kind.any():
        return rows
    if (kind == 2).all():
        return np.cumsum(rows, axis=0, dtype=np.uint8)
    w = -(-n // bpp)
    # One pixel of zeros to the left and one line of them above.
    out = np.zeros((h + 1, w + 1, bpp), np.int16)
    flat = np.zeros((h, w * bpp), np.uint8)
    flat[:, :n] = rows
    raw = flat.reshape(h, w, bpp).astype(np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        k = kind[y][:, None]
        p = left + up - corner
        a, b, c = abs(p - left), abs(p - up), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.select([k == 1, k == 2, k == 3, k == 4], [left, up, (left + up) >> 1, paeth], 0)
        out[y + 1, x + 1] = (raw[y, x] + guess) & 255
    return out[1:, 1:].reshape(h, w * bpp)[:, :n].astype(np.uint8)


def samples(data: bytes, h: int, w: int, ch: int, depth: int) -> tuple[np.ndarray, int]:
    """(values of h by w by ch, bytes used) of one pass."""
    n = -(-w * ch * depth // 8)
    need = h * (n + 1)
    if len(data) < need:
        raise ValueError("the picture is cut off")
    rows = unfiltered(np.frombuffer(data, np.uint8, need).reshape(h, n + 1), max(1, ch * depth // 8))
    if depth == 16:
        value = np.ascontiguousarray(rows).view(">u2").astype(np.uint16)
    elif depth == 8:
        value = rows
    else:
        bit = np.unpackbits(np.ascontiguousarray(rows), axis=1)[:, : w * ch * depth].reshape(h, w * ch, depth)
        value = (bit << np.arange(depth - 1, -1, -1, dtype=np.uint8)).sum(-1, dtype=np.uint8)
    return value.reshape(h, w, ch), need


def decode(raw: bytes) -> np.ndarray:
    """(3, h, w) bytes of a picture: grey ones in all three planes, palettes looked up, alpha left out, sixteen bits cut to eight."""
    every = chunks(raw)
    w, h, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", every[0][1])
    if kind not in CHANNELS or depth not in (1, 2, 4, 8, 16) or not w or not h:
        raise ValueError("no such kind of PNG picture")
    ch = CHANNELS[kind]
    data = zlib.decompress(b"".join(d for name, d in every if name == b"IDAT"))
    if interlaced:
        value, at = np.zeros((h, w, ch), np.uint16 if depth == 16 else np.uint8), 0
        for y, x, dy, dx in PASSES:
            hh, ww = -(-(h - y) // dy), -(-(w - x) // dx)
            if hh > 0 and ww > 0:
                value[y::dy, x::dx], used = samples(data[at:], hh, ww, ch, depth)
                at += used
    else:
        value, _ = samples(data, h, w, ch, depth)
    if kind == 3:
        palette = next((np.frombuffer(d, np.uint8).reshape(-1, 3) for name, d in every if name == b"PLTE"), None)
        if palette is None or value.max() >= len(palette):
            raise ValueError("a colour that the palette hasn't")
        value = palette[value[..., 0]]
    else:
        value = value >> 8 if depth == 16 else value if depth == 8 else value * (255 // ((1 << depth) - 1))
        value = value[..., :3] if ch >= 3 else value[..., [0, 0, 0]]
    return np.ascontiguousarray(value.transpose(2, 0, 1), np.uint8)
