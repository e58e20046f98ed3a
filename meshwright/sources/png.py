"""A PNG writer; Spark reads images but has no writer for them."""

from __future__ import annotations

import struct
import zlib

import numpy as np


def encode_png(pixels: np.ndarray) -> bytes:
    """8-bit grey (h, w) or RGB (h, w, 3) pixels as a PNG file."""
    pixels = np.ascontiguousarray(pixels, np.uint8)
    h, w = pixels.shape[:2]
    colour = 2 if pixels.ndim == 3 else 0
    rows = b"".join(b"\0" + pixels[y].tobytes() for y in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def decode_png(content: bytes) -> np.ndarray:
    """Pixels (h, w, 3) of an 8-bit, non-interlaced PNG in grey or RGB, with or without alpha (which is dropped)."""
    if content[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, packed, shape = 8, b"", None
    while at < len(content):
        size, kind = struct.unpack(">I4s", content[at : at + 8])
        body = content[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            w, h, depth, colour, _, _, laced = struct.unpack(">IIBBBBB", body)
            bands = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
            if depth != 8 or laced or bands is None:
                raise ValueError("unsupported PNG")
            shape = (h, w, bands)
        elif kind == b"IDAT":
            packed += body
        at += size + 12
    h, w, bands = shape
    rows = np.frombuffer(zlib.decompress(packed), np.uint8).reshape(h, 1 + w * bands)
    out = np.zeros((h + 1, (w + 1) * bands), np.int64)  # a row above and a pixel to the left, both 0
    for y in range(h):
        line, above, rule = rows[y, 1:].astype(np.int64), out[y], int(rows[y, 0])
        here = out[y + 1]
        if rule in (0, 2):
            here[bands:] = (line + (above[bands:] if rule == 2 else 0)) % 256
            continue
        for i in range(w * bands):  # each byte leans on the one to its left
            a, b, c = here[i], above[i + bands], above[i]
            if rule == 1:
                guess = a
            elif rule == 3:
                guess = (a + b) // 2
            else:
                far = [abs(b - c), abs(a - c), abs(a + b - 2 * c)]
                guess = (a, b, c)[far.index(min(far))]
            here[i + bands] = (line[i] + guess) % 256
    pixels = out[1:, bands:].reshape(h, w, bands).astype(np.uint8)
    return np.repeat(pixels[:, :, :1], 3, axis=2) if bands < 3 else pixels[:, :, :3]
