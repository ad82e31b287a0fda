"""Secret scans: patterns, and structure.

Base patterns report by form alone. Beside them, base64 and hex candidates are decoded, and reported only if what they
hold parses as a key encoding (DER with exactly nested lengths, OpenSSH's length-prefixed layout) or a signed token's
header and payload.
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

#: Kinds in the order that breaks ties of spans with one start; the first three are the base kinds.
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "pem", "der", "openssh", "jwt")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
WORDS = ("passw", "secret", "token", "apikey", "api_key")
#: Lower-case hex digits as h, everything else as a dot: a run is then found by a plain search.
HEX_CLASS = bytes(104 if chr(c) in "0123456789abcdef" else 46 for c in range(256))
HEX_RUN = re.compile(r"[0-9a-f]{24,}")

PEM_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]{0,64}PRIVATE KEY)-----")
PEM_BODY = re.compile(r"[A-Za-z0-9+/=\s\\:,-]*")
#: Where base64 of a DER sequence (30 ..) or of OpenSSH's magic may begin, and hex of a DER sequence.
B64_DER = re.compile(r"M[A-Za-z0-9+/_-]{31,}={0,2}")
B64_AT = re.compile(r"M")
B64_SSH = re.compile(r"b3BlbnNzaC1rZXktdjE[A-Za-z0-9+/_-]*={0,2}")
HEX_DER = re.compile(r"30[0-9A-Fa-f]{46,}")
JSON_AT = re.compile(rb"\{[ \t\r\n]*(\"|$)")
#: Three parts of a run: what stands before a dot, between dots and behind; and where a head may begin in the first.
TOKEN_PART = re.compile(r"[A-Za-z0-9_-]+")
HEAD_AT = re.compile(r"e[wy]")
#: Characters of a head that are looked at before all of it is, a multiple of 4; how near their end an error may be its doing.
AHEAD, CUT = 256, 16
SSH_MAGIC = b"openssh-key-v1\x00"


def _b64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _tlv(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(tag, start and end of the content) of the DER element at a position, if its length fits and is minimal."""
    if at + 2 > end:
        return None
    tag, n, at = data[at], data[at + 1], at + 2
    if n >= 128:
        k = n & 127
        if not 1 <= k <= 4 or at + k > end:
            return None
        n, at = int.from_bytes(data[at : at + k]), at + k
        if n < 128 or k > 1 and n < 1 << 8 * (k - 1):
            return None
    return (tag, at, at + n) if at + n <= end else None


def _children(data: bytes, at: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill a content exactly."""
    out = []
    while at < end:
        if (x := _tlv(data, at, end)) is None:
            return None
        out.append(x)
        at = x[2]
    return out


def der_key(data: bytes) -> int:
    """Bytes that a private key in DER takes at the start of data; 0 if there is none.

    RSA, DSA and EC keys, PKCS #8 and encrypted PKCS #8 are known; public keys and certificates are no secrets.
    """
    top = _tlv(data, 0, len(data))
    if not top or top[0] != 0x30 or not (parts := _children(data, top[1], top[2])):
        return 0
    tags = [p[0] for p in parts]
    oid = lambda p: bool(x := _children(data, p[1], p[2])) and x[0][0] == 6 and x[0][2] > x[0][1]
    version = tags[0] == 2 and data[parts[0][1] : parts[0][2]] in (b"\x00", b"\x01")
    if any(p[0] == 2 and p[1] == p[2] for p in parts):
        return 0
    rsa = version and len(tags) in (9, 10) and tags[:9] == [2] * 9 and tags[9:] in ([], [0x30]) and parts[1][2] - parts[1][1] >= 32
    dsa = version and tags == [2] * 6 and parts[1][2] - parts[1][1] >= 32
    sec1 = version and len(tags) >= 2 and tags[1] == 4 and parts[1][2] - parts[1][1] >= 16 and all(t in (0xA0, 0xA1) for t in tags[2:])
    pkcs8 = version and len(tags) >= 3 and tags[1:3] == [0x30, 4] and oid(parts[1]) and parts[2][2] - parts[2][1] >= 16
    locked = tags == [0x30, 4] and oid(parts[0]) and parts[1][2] - parts[1][1] >= 16
    return top[2] if rsa or dsa or sec1 or pkcs8 or locked else 0


def openssh_key(data: bytes) -> int:
    """Bytes that an OpenSSH private key takes at the start of data; 0 if its nested lengths do not fit."""
    if not data.startswith(SSH_MAGIC):
        return 0
    at = len(SSH_MAGIC)

    def string() -> bytes | None:
        nonlocal at
        n = int.from_bytes(data[at : at + 4])
        if at + 4 > len(data) or at + 4 + n > len(data):
            return None
        at += 4 + n
        return data[at - n : at]

    if None in [string() for _ in range(3)] or at + 4 > len(data):
        return 0
    keys, at = int.from_bytes(data[at : at + 4]), at + 4
    if not 1 <= keys <= 16:
        return 0
    for _ in range(keys):
        public = string()
        if not public or int.from_bytes(public[:4]) + 4 > len(public):
            return 0
    return at if string() else 0


def signed_token(text: str) -> bool:
    """Three base64url parts: a JSON header naming an algorithm, a JSON object, and a signature."""
    head, body, signature = text.split(".")
    try:
        header, claims = (json.loads(_b64(x) or b"") for x in (head, body))
    except (ValueError, RecursionError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(claims, dict) and (header["alg"].lower() == "none" or bool(_b64(signature)))


def _der_in(run: str) -> tuple[int, int] | None:
    """The first private key in a base64 run as (start, end); decodes no more than an outer length asks for."""
    for m in B64_AT.finditer(run):
        at = m.start()
        head = _b64(run[at : at + 8])
        if not head or head[0] != 0x30 or len(head) < 6:
            continue
        n = head[1]
        total = 2 + n if n < 128 else 2 + (k := n & 127) + int.from_bytes(head[2 : 2 + k]) if 1 <= (n & 127) <= 3 else 0
        chars = -(-total * 4 // 3)
        if not 24 <= total or at + chars > len(run.rstrip("=")):
            continue
        data = _b64(run[at : at + chars])
        if data and der_key(data) == total:
            end = at + chars
            while end < len(run) and run[end] == "=" and (end - at) % 4:
                end += 1
            return at, end
    return None


def _hex_der_in(run: str) -> tuple[int, int] | None:
    """The first private key in a hex run as (start, end), as _der_in."""
    at = run.find("30")
    while 0 <= at <= len(run) - 48:
        head = binascii.unhexlify(run[at : at + 12])
        n = head[1]
        total = 2 + n if n < 128 else 2 + (k := n & 127) + int.from_bytes(head[2 : 2 + k]) if 1 <= (n & 127) <= 4 else 0
        if 24 <= total and at + 2 * total <= len(run) and der_key(binascii.unhexlify(run[at : at + 2 * total])) == total:
            return at, at + 2 * total
        at = run.find("30", at + 1)
    return None


def _no_head(text: str, at: int, end: int) -> bool:
    """Whether the beginning of a long head tells that it is no JSON, so that the rest need not be decoded."""
    if not JSON_AT.match(_b64(text[at : at + 8]) or b""):
        return True
    if end - at <= AHEAD or (data := _b64(text[at : at + AHEAD])) is None:
        return False
    begin = data.decode("utf-8", "replace")
    try:
        json.JSONDecoder().raw_decode(begin)
    except json.JSONDecodeError as e:
        return not e.msg.startswith("Unterminated") and e.pos < len(begin) - CUT
    except RecursionError:
        return False
    return False


def _tokens_in(text: str) -> Iterator[tuple[int, int]]:
    """Signed tokens; where one does not parse, the next start may be inside of it. Runs are taken apart at their dots once,
    and starts are tried only before a dot, another part and a dot."""
    parts, end = list(TOKEN_PART.finditer(text)) if "." in text else [], 0
    for i, first in enumerate(parts[:-1]):
        second = parts[i + 1]
        if second.start() != first.end() + 1 or text[first.end()] != "." or text[second.end() : second.end() + 1] != ".":
            continue
        third = parts[i + 2] if i + 2 < len(parts) and parts[i + 2].start() == second.end() + 1 else None
        stop, begin = third.end() if third else second.end() + 1, max(end, first.start())
        for m in HEAD_AT.finditer(text, begin, max(begin, first.end() - 6)):
            if not _no_head(text, m.start(), first.end()) and signed_token(text[m.start() : stop]):
                yield m.start(), stop
                end = stop
                break


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base kinds, leftmost and non-overlapping per kind."""
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if b"h" * 24 in text.encode("utf-8", "surrogatepass").translate(HEX_CLASS):
        out += [("hex", m.start(), m.end()) for m in HEX_RUN.finditer(text)]  # maximal runs, as HEX with a length of 24
    return out


def structural_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans whose decoded content parses."""
    out = []
    if "PRIVATE KEY-----" in text:
        marks = list(PEM_MARK.finditer(text))
        for m, n in zip(marks, marks[1:], strict=False):
            if m[1] == "BEGIN" and n[1] == "END" and m[2] == n[2] and PEM_BODY.fullmatch(text, m.end(), n.start()):
                body = re.sub(r"\\[nr]|\s", "", re.sub(r"(?m)^[A-Za-z-]+:.*$", "", text[m.end() : n.start()]))
                data = _b64(body) or b""
                if der_key(data) == len(data) > 0 or openssh_key(data):
                    out.append(("pem", m.start(), n.end()))
    for m in B64_DER.finditer(text):
        at = 0
        while found := _der_in(m[0][at:]):
            out.append(("der", m.start() + at + found[0], m.start() + at + found[1]))
            at += found[1]
    for m in HEX_DER.finditer(text):
        at = 0
        while found := _hex_der_in(m[0][at:]):
            out.append(("der", m.start() + at + found[0], m.start() + at + found[1]))
            at += found[1]
    for m in B64_SSH.finditer(text):
        run = m[0].rstrip("=")
        # what does not fill a group of four may be of the text behind a key: without it, groups decode by themselves
        if used := openssh_key(_b64(run) or _b64(run[: len(run) // 4 * 4]) or b""):
            end = -(-used * 4 // 3)
            while end < len(m[0]) and m[0][end] == "=" and end % 4:
                end += 1
            out.append(("openssh", m.start(), m.start() + end))
    out += [("jwt", a, b) for a, b in _tokens_in(text)]
    return out


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """All spans of a text (null: none), by start and then kind."""
    text = text or ""
    return sorted(base_spans(text) + structural_spans(text), key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


SCHEMA = "id long, spans array<struct<kind: string, start: int, end: int>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans) of every row's whole text: code points, end exclusive, by start and then kind.

    Null and empty texts have no spans; rows that repeat are all returned; a null id is returned as it is.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in spans(x.as_py())] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
