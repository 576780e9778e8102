"""Streams whose rows are coded in pieces by many tasks and put together without being held anywhere.

Deflated data may be a chain of parts that refer to nothing before them. So each task deflates the byte planes of its
rows by themselves, in plain and in difference mode, and what is known of the pieces (lengths, checksums, first and last
bins) is enough to choose a stream's mode and width and to write its head; the planes are copied as they are.
"""

from __future__ import annotations

import functools
import struct
import zlib

import numpy as np

from driftfield.sources.container import CONST, DEFLATE, DELTA, RAW, STREAM, Fault, coded

#: Rows of a piece, about.
PIECE = 131_072


def zigzag(v: np.ndarray) -> np.ndarray:
    return ((v << 1) ^ (v >> 63)).astype(np.uint64)


def flushed(data: bytes, level: int = 6) -> bytes:
    """Deflated to whole bytes, not ended, referring to nothing before."""
    d = zlib.compressobj(level, zlib.DEFLATED, -15)
    return d.compress(data) + d.flush(zlib.Z_FULL_FLUSH)


def _planes(v: np.ndarray) -> tuple[int, list[tuple[bytes, int]]] | None:
    """Width, and each plane deflated with its checksum; None where a symbol has more than 32 bits."""
    z = zigzag(v).ravel()
    top = int(z.max()) if z.size else 0
    if top >= 1 << 32:
        return None
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    planes = z.astype(f"<u{width}").view(np.uint8).reshape(-1, width)
    data = [np.ascontiguousarray(planes[:, p]).tobytes() for p in range(width)]
    return width, [(flushed(x), zlib.adler32(x)) for x in data]


def piece(bins: np.ndarray) -> tuple[dict, bytes]:
    """What is told of the rows of one stream, and their planes in both modes; differences are those after the first row."""
    v = bins.astype(np.int64).reshape(len(bins), -1)
    plain, steps = _planes(v), _planes(np.diff(v, axis=0))
    if plain is None:
        raise Fault("bin-out-of-range")
    told = {"n": v.shape[0], "channels": v.shape[1], "first": v[0].tolist(), "last": v[-1].tolist(), "same": bool((v == v[0]).all()), "zero": not v.any()}
    out = b""
    for mode, found in ((RAW, plain), (DELTA, steps)):
        if found:
            told[str(mode)] = {"width": found[0], "planes": [(len(x), a) for x, a in found[1]]}
            out += b"".join(x for x, _ in found[1])
    return told, out


def constant(n: int, values: list[int]) -> dict:
    """What ``piece`` would tell of rows that are all the same, where nothing is kept of them."""
    return {"n": n, "channels": len(values), "first": list(values), "last": list(values), "same": True, "zero": not any(values)}


def sums_joined(first: int, second: int, length: int) -> int:
    """Adler-32 of two parts one after the other, from those of each and the second's length."""
    base = 65521
    a1, b1, a2, b2 = first & 0xFFFF, first >> 16, second & 0xFFFF, second >> 16
    return ((b1 + b2 + length % base * (a1 + base - 1)) % base) << 16 | (a1 + a2 + base - 1) % base


@functools.lru_cache(maxsize=1024)
def _zeros(n: int) -> tuple[bytes, int]:
    return flushed(bytes(n)), zlib.adler32(bytes(n))


def joined(attribute: int, found: list[tuple[str, int, dict]]) -> list:
    """The parts of one stream (bytes, and ranges of files) from its pieces (URI, offset, told), in order."""
    told = [t for _, _, t in found]
    n, channels = sum(t["n"] for t in told), told[0]["channels"]
    if all(t["same"] and t["first"] == told[0]["first"] for t in told) or "0" not in told[0]:
        body = coded(attribute, np.array([told[0]["first"]] * min(n, 2), dtype=np.int64))
        if n < 2:
            return [body]
        return [struct.pack(STREAM, attribute, body[1], CONST, DEFLATE, channels, n, len(body) - struct.calcsize(STREAM)), body[struct.calcsize(STREAM) :]]
    size = lambda mode: sum(k for t in told for k, _ in t[str(mode)]["planes"])
    before = [[0] * channels, *[t["last"] for t in told[:-1]]]
    starts = [zigzag(np.array(t["first"], dtype=np.int64) - np.array(b, dtype=np.int64)) for t, b in zip(told, before)]
    steps = all(str(DELTA) in t for t in told) and max(int(s.max()) for s in starts) < 1 << 32
    mode = DELTA if n > 1 and steps and size(DELTA) < size(RAW) else RAW
    widths = [t[str(mode)]["width"] for t in told]
    if mode == DELTA:
        widths += [1 if x < 1 << 8 else 2 if x < 1 << 16 else 4 for s in starts for x in [int(s.max())]]
    width, parts, check = max(widths), [b"\x78\x9c"], 1
    for p in range(width):
        for (uri, at, t), start in zip(found, starts):
            rows = t["n"]
            if mode == DELTA:
                one = bytes(((start >> np.uint64(8 * p)) & np.uint64(255)).astype(np.uint8))
                parts.append(b"\0" + struct.pack("<HH", len(one), len(one) ^ 0xFFFF) + one)
                check, rows = sums_joined(check, zlib.adler32(one), len(one)), rows - 1
                at += sum(k for k, _ in t[str(RAW)]["planes"])
            own = t[str(mode)]["planes"]
            if not rows:
                continue
            if p < len(own):
                parts.append((uri, at + sum(k for k, _ in own[:p]), own[p][0]))
                check = sums_joined(check, own[p][1], rows * channels)
            else:
                data, zero = _zeros(rows * channels)
                parts.append(data)
                check = sums_joined(check, zero, rows * channels)
    parts.append(b"\x03\0" + struct.pack(">I", check))
    return [struct.pack(STREAM, attribute, width, mode, DEFLATE, channels, n, length(parts)), *parts]


def length(parts: list) -> int:
    return sum(p[2] if isinstance(p, tuple) else len(p) for p in parts)


def streams(attributes: dict[int, np.ndarray]) -> tuple[list, bytes]:
    """Pieces of several streams of the same rows: (attribute, offset, told) of each, and all their planes."""
    out, told = [], []
    at = 0
    for attribute, bins in attributes.items():
        t, data = piece(bins)
        told.append((attribute, at, t))
        out.append(data)
        at += len(data)
    return told, b"".join(out)
