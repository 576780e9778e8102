"""Secret scans: plain patterns find candidates, and structure confirms what they hold.

Base kinds (``assign``, ``access``, ``hex``) are reported as matched. Candidates in base64 or hexadecimal are decoded
and parsed before a confirmed kind is added: armoured and bare private keys by their nested DER lengths or the
length-prefixed fields of their own container, signed tokens by their JSON header. A bare key may begin anywhere in a run
of digits and be wrapped over lines; its own lengths say where it ends. A candidate whose inner lengths don't add up is
not reported.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftfield.llm.shared import arrow_mapped, byte_sizes, slices, texts_of

#: The patterns of the base kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
#: Kinds in the order that ties at one start are listed in; those from ``pem`` on are confirmed by structure.
KINDS = ["assign", "access", "hex", "pem", "der", "openssh", "jwt"]
LEAST = {"assign": 12, "access": 18, "hex": 16}

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"[0-9a-f]{16,}")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*?PRIVATE KEY)-----((?:[^-]|-(?!----))*+)-----END \1-----")
#: Three runs with dots between, taken whole, so that a run is read once; a token may begin at any of these inside the first.
_JWT = re.compile(r"(?<![A-Za-z0-9_-])([A-Za-z0-9_-]++)\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]*+")
_JWT_START = re.compile("eyJ")
#: Headers of an armour whose body is encrypted: the cipher's name and start value say what the body must be.
_ENCRYPTED = re.compile(r"Proc-Type:\s*4,\s*ENCRYPTED\s+DEK-Info:\s*[A-Z0-9-]+,((?:[0-9A-Fa-f]{16}){1,2})\s")
#: Object identifiers (encoded) that password-based algorithms begin with.
PASSWORD_BASED = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
#: Line ends, as they are or escaped in a string, and escapes of a slash.
_BREAK = r"(?:\r?\n[\x20\t]*|(?:\\+r)?\\+n|\\+(?=/))"
_BREAKS = re.compile(_BREAK)
_BASE64 = re.compile(rf"[A-Za-z0-9+/_-]{{16,}}(?:{_BREAK}[A-Za-z0-9+/_-]+)*")
_HEXES = re.compile(rf"[0-9A-Fa-f]{{16,}}(?:{_BREAK}[0-9A-Fa-f]+)*")
#: Where a key can begin: a SEQUENCE tag or the container's magic.
_BASE64_STARTS = re.compile(r"M(?=[A-P])|b3BlbnNzaC1rZXkt")
_HEX_STARTS = re.compile(r"3(?=0)|6f70656e7373682d6b65792d", re.IGNORECASE)

SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])


def _unbase64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the elements that fill ``data`` exactly; None if their lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n, at = data[at], data[at + 1], at + 2
        if n & 0x80:
            k = n & 0x7F
            if not 0 < k <= 4 or at + k > len(data):
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _nested(elements: list[tuple[int, bytes]], depth: int = 0) -> bool:
    """Whether the lengths in all constructed elements add up, at every level."""
    for tag, content in elements:
        if tag & 0x20 and (depth > 16 or (inner := der_elements(content)) is None or not _nested(inner, depth + 1)):
            return False
    return True


def is_der_key(data: bytes) -> bool:
    """A DER SEQUENCE that fills the data, all lengths nested exactly, in a shape that private keys have.

    A version and then numbers alone; a version, an algorithm's SEQUENCE with its identifier, and an OCTET STRING; a version
    and an OCTET STRING; or a password-based algorithm and the encrypted OCTET STRING. Public keys and certificates, which
    begin with another SEQUENCE, are none of these.
    """
    if len(data) < 16 or data[0] != 0x30:
        return False
    outer = der_elements(data)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30:
        return False
    inner = der_elements(outer[0][1])
    if not inner or len(inner) < 2 or not _nested(inner):
        return False
    (first, content), (second, algorithm), *rest = inner
    if first == 0x30:
        return second == 0x04 and not rest and content[:1] == b"\x06" and content[2:].startswith(PASSWORD_BASED)
    if first != 0x02 or len(content) != 1 or content[0] > 2:
        return False
    if second == 0x02:
        return all(tag == 0x02 for tag, _ in rest)
    if second == 0x30:
        return algorithm[:1] == b"\x06" and rest[:1] != [] and rest[0][0] == 0x04
    return second == 0x04 and all(tag in (0xA0, 0xA1) for tag, _ in rest)


def is_openssh_key(data: bytes) -> bool:
    """Magic, then cipher, kdf and options as length-prefixed strings, the number of keys, and as many public keys."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return False
    at = len(magic)

    def string(at: int) -> int | None:
        return at + 4 + n if at + 4 <= len(data) and at + 4 + (n := int.from_bytes(data[at : at + 4], "big")) <= len(data) else None

    for _ in range(3):
        if (at := string(at)) is None:
            return False
    if at + 4 > len(data) or not 0 < (keys := int.from_bytes(data[at : at + 4], "big")) <= 16:
        return False
    at += 4
    for _ in range(keys + 1):
        if (at := string(at)) is None:
            return False
    return True


def is_token_header(part: str) -> bool:
    """The first part of a signed token: base64 of a JSON object that names its algorithm."""
    data = _unbase64(part)
    try:
        head = json.loads(data) if data else None
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str)


def _confirmed(data: bytes | None) -> str | None:
    if not data:
        return None
    return "openssh" if is_openssh_key(data) else "der" if is_der_key(data) else None


def _der_size(head: bytes) -> int | None:
    """Bytes that the SEQUENCE beginning here says it has, if it begins as ``is_der_key`` wants it."""
    if len(head) < 4 or head[0] != 0x30:
        return None
    n, at = head[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 0 < k <= 4:
            return None
        n, at = int.from_bytes(head[2 : 2 + k], "big"), 2 + k
    if head[at : at + 1] == b"\x30" or head[at : at + 2] == b"\x02\x01":
        return at + n
    return None


def _unbase64_any(digits: str) -> bytes:
    digits = digits[: len(digits) - (len(digits) % 4 == 1)].replace("-", "+").replace("_", "/")
    return base64.b64decode(digits + "=" * (-len(digits) % 4))


def _unhex_any(digits: str) -> bytes:
    return bytes.fromhex(digits[: len(digits) // 2 * 2])


def _keys(text: str, runs: re.Pattern, starts: re.Pattern, bits: int, decode) -> Iterator[tuple[str, int, int]]:
    """Bare keys in runs of digits of so many bits; runs go on over line ends."""
    for m in runs.finditer(text):
        digits = _BREAKS.sub("", m[0])
        found, least = [], 0
        for start in starts.finditer(digits):
            if (i := start.start()) < least:
                continue
            head = decode(digits[i : i + 32])
            if head.startswith(b"openssh"):
                if is_openssh_key(decode(digits[i:])):
                    found.append(("openssh", i, least := len(digits)))
            elif n := _der_size(head):
                upto = i + -(-8 * n // bits)
                if upto <= len(digits) and is_der_key(decode(digits[i:upto])):
                    found.append(("der", i, least := upto))
        if found:
            inside = {k for x in _BREAKS.finditer(m[0]) for k in range(*x.span())}
            at = [m.start() + k for k in range(len(m[0])) if k not in inside]
            for kind, i, upto in found:
                end = at[upto - 1] + 1
                yield kind, at[i], end + (len(text[end : end + 2]) - len(text[end : end + 2].lstrip("=")) if bits == 6 else 0)


def spans_of(text: str) -> list[tuple[str, int, int]]:
    """All spans of a text as (kind, start, end), by start, then kind as listed, then end; code points, end exclusive.

    Base kinds are leftmost and don't overlap within a kind. A confirmed kind is reported once for the candidate that
    holds it; a key found inside an armour is reported as ``pem`` only.
    """
    out = [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    armoured = []
    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            whole = re.sub(r"\\+n", "\n", re.sub(r"\\+r|\r", "", m[2]))  # line ends may be escaped
            body = _unbase64("".join(re.sub(r"""[\\"',]""", "", whole).split("\n\n")[-1].split()))
            sealed = _ENCRYPTED.search(whole)
            if _confirmed(body) or sealed and body and len(body) % (len(sealed[1]) // 2) == 0:
                armoured.append(m.span())
                out.append(("pem", *m.span()))
    free = lambda a, b: not any(x <= a and b <= y for x, y in armoured)
    if "eyJ" in text:
        for m in _JWT.finditer(text):
            # A header ends with a brace or white space, so most places need no decoding; the first that is one counts.
            part = m[1]
            ends = {k: k != 1 and _unbase64_any(part[-(k or 4) :])[-1:] in (b"}", b" ", b"\t", b"\r", b"\n") for k in range(4)}
            for at in _JWT_START.finditer(part):
                if ends[(len(part) - at.start()) % 4] and is_token_header(part[at.start() :]):
                    out.append(("jwt", m.start() + at.start(), m.end()))
                    break
    out += [x for x in _keys(text, _HEXES, _HEX_STARTS, 4, _unhex_any) if free(*x[1:])]
    out += [x for x in _keys(text, _BASE64, _BASE64_STARTS, 6, _unbase64_any) if free(*x[1:])]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def scan(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``docs`` with the array ``spans`` of (kind, start, end) over every whole text; a null or empty text has none.

    One row for every input row, repeated ones included; an empty table gives an empty result; an input column called
    like the made one is replaced. A row is scanned on its own, so texts of any length and any skew need no exchange.
    """

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b in slices(byte_sizes(columns[0]), 4 << 20):
            found = [spans_of(x) if x else [] for x in texts_of(columns[0].slice(a, b - a))]
            kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
            yield a, b, [pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in found], pa.list_(kind))]

    return arrow_mapped(docs, [text], [T.StructField(spans, T.ArrayType(SPAN))], make)


def redact(docs: DataFrame, text: str = "text", mark: str = "<secret>") -> DataFrame:
    """``docs`` with every span of a secret replaced by ``mark`` (overlapping ones together); other texts, and nulls, stay as they are."""

    def cleaned(x: str) -> str:
        out, at = [], 0
        for _, a, b in spans_of(x):
            if a >= at:
                out += [x[at:a], mark]
            at = max(at, b)
        return "".join([*out, x[at:]])

    def make(columns: list[pa.Array]) -> Iterator[tuple[int, int, list[pa.Array]]]:
        for a, b in slices(byte_sizes(columns[0]), 4 << 20):
            yield a, b, [pa.array([x and cleaned(x) for x in texts_of(columns[0].slice(a, b - a))], pa.string())]

    return arrow_mapped(docs, [text], [T.StructField(text, T.StringType())], make).select(*[F.col(f"`{c}`") for c in docs.columns])
