"""Secrets, with structural confirmation of encoded candidates.

Three plain patterns (assignments, access keys, long hex) are reported as they match.
Encoded candidates are reported only when their structure is confirmed: the candidate is
decoded and

- a signed token needs a JSON header that names its algorithm, and a JSON body;
- a base64, hex or PEM candidate needs a private key inside: DER whose nested lengths add up
  to the last byte and whose fields are those of PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1, or
  the length-prefixed fields of the OpenSSH format.

One pass over the documents without a shuffle.  Whole texts are read; substring tests skip a
pattern only where it cannot match.

Edge cases: a null or empty text has no spans; a null id is kept; repeated rows are scanned
each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from modlens.llm.base import id_text, map_batches, span_list

KINDS = ("assign", "access", "hex", "token", "key")
BASE = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ASSIGN_WORDS = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_SIGNED = re.compile(r"(?<![A-Za-z0-9_-])(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.[A-Za-z0-9_-]*")
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([^-]*)-----END \1-----")
_LONG = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){32,}(?![0-9A-Fa-f])")
_MAGIC = b"openssh-key-v1\0"


def _decode64(s: str) -> bytes:
    s = s.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(s + "=" * (-len(s) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


# fixed values: the object identifiers below PKCS#5 and the PKCS#12 encryptions, as encoded
_PBE_ARCS = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _json_object(part: str) -> dict | None:
    try:
        got = json.loads(_decode64(part).decode("utf-8"))
    except (ValueError, RecursionError):
        return None
    return got if isinstance(got, dict) else None


def signed_token(header: str, body: str) -> bool:
    """Whether the first two parts of a compact token decode to a header with an algorithm and a body."""
    head = _json_object(header)
    return head is not None and isinstance(head.get("alg"), str) and _json_object(body) is not None


def _fields(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tag and content of the DER values that fill ``data`` exactly; None if the lengths do not add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n & 0x80:
            width = n & 0x7F
            if not 1 <= width <= 4 or at + width > len(data):
                return None
            n = int.from_bytes(data[at:at + width], "big")
            at += width
        if at + n > len(data):
            return None
        out.append((tag, data[at:at + n]))
        at += n
    return out


def _is_key_info(fields: list[tuple[int, bytes]]) -> bool:
    """An algorithm sequence that starts with an object identifier, then an octet string."""
    if len(fields) < 2 or fields[0][0] != 0x30 or fields[1][0] != 0x04:
        return False
    algorithm = _fields(fields[0][1])
    return bool(algorithm) and algorithm[0][0] == 0x06


def _is_encrypted(fields: list[tuple[int, bytes]]) -> bool:
    """Key info whose algorithm is a password-based encryption; a digest has the same shape."""
    return _is_key_info(fields) and len(fields) == 2 and _fields(fields[0][1])[0][1].startswith(_PBE_ARCS)


def der_private_key(data: bytes) -> bool:
    """PKCS#1, PKCS#8, encrypted PKCS#8 or SEC1 by their nested lengths and field types."""
    top = _fields(data)
    if not top or len(top) != 1 or top[0][0] != 0x30:
        return False
    inner = _fields(top[0][1])
    if not inner:
        return False
    if _is_encrypted(inner):                              # encrypted PKCS#8
        return True
    if inner[0][0] != 0x02 or len(inner[0][1]) != 1:      # a version comes first
        return False
    if _is_key_info(inner[1:]):                           # PKCS#8
        return True
    if len(inner) >= 9 and all(t == 0x02 for t, _ in inner[:9]):                     # PKCS#1
        return True
    return inner[0][1] == b"\x01" and len(inner) >= 3 and inner[1][0] == 0x04 and inner[2][0] in (0xA0, 0xA1)   # SEC1


def openssh_private_key(data: bytes) -> bool:
    """Magic, then cipher, kdf, options, number of keys, public and private part by their lengths."""
    if not data.startswith(_MAGIC):
        return False
    at = len(_MAGIC)
    for field in range(6):
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at:at + 4], "big")
        at += 4
        if field != 3:                                    # the fourth is the count itself
            if at + n > len(data):
                return False
            at += n
    return at <= len(data)


def private_key(data: bytes) -> bool:
    return len(data) >= 32 and (der_private_key(data) or openssh_private_key(data))


def _longest_word(text: str) -> int:
    return max(map(len, text.split()), default=0)


def find_secrets(text: str) -> list[tuple[int, int, int, str]]:
    """(start, rank of kind, end, kind) of every secret of a text, in code points."""
    out: list[tuple[int, int, int, str]] = []

    def add(kind: str, start: int, end: int) -> None:
        out.append((start, KINDS.index(kind), end, kind))

    low = text.lower()
    if any(w in low for w in _ASSIGN_WORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= 8:
                add("assign", *m.span())
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if len(m[0]) >= 16:
                add("access", *m.span())
    taken: list[tuple[int, int]] = []

    def confirm(kind: str, span: tuple[int, int], confirmed: bool) -> None:
        if confirmed:
            add(kind, *span)
            taken.append(span)

    if "PRIVATE KEY-----" in text:
        for m in _PEM.finditer(text):
            confirm("key", m.span(), private_key(_decode64("".join(m[2].split()))))
    if _longest_word(text) >= 32:
        for m in _HEX.finditer(text):
            add("hex", *m.span())
        if "eyJ" in text:
            for m in _SIGNED.finditer(text):
                confirm("token", m.span(), signed_token(m[1], m[2]))
        for pattern, decode in ((_LONG, _decode64), (_LONG_HEX, bytes.fromhex)):
            for m in pattern.finditer(text):
                if not any(a < m.end() and m.start() < b for a, b in taken):
                    confirm("key", m.span(), private_key(decode(m[0])))
    return sorted(out)


def redact(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """The text with every span, overlapping ones joined, replaced by the kind of its first."""
    out, at = [], 0
    for start, _, end, kind in sorted(spans):
        if start >= at:
            out += (text[at:start], f"[{kind}]")
        at = max(at, end)
    return "".join(out) + text[at:] if spans else text


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, number of spans of each base kind, all spans as text, and the redacted text.

    ``redacted`` is null where the text holds no secret."""

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [find_secrets(t) for t in batch.column(1).to_pylist()]
        texts = batch.column(1)
        count = [[sum(s[3] == k for s in f) for f in found] for k in BASE]
        base = [span_list([s for s in f if s[3] in BASE]) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in count), pa.array(base, pa.string()),
             pa.array([span_list(f) for f in found], pa.string()),
             pa.array([redact(texts[i].as_py(), f) if f else None for i, f in enumerate(found)], pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", "redacted"])

    return map_batches(
        id_text(docs, id_col, text_col), one,
        "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string, redacted string")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns, each text with its secrets replaced; nothing is shuffled."""
    at = docs.columns.index(text_col)

    def one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = [t and redact(t, find_secrets(t)) for t in batch.column(at).to_pylist()]
        yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return map_batches(docs, one, docs.schema)
