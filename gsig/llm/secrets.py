"""Secret scans with structural confirmation: decoded candidates are parsed before they are reported."""

from __future__ import annotations

import base64
import binascii
import bisect
import hashlib
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: Base kinds in the order that breaks ties of position. Letters of the first may be in either ASCII case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: A run that fails for its length holds no later start that could pass, so the least length can stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"[0-9a-f]{32,}")
BASE64 = re.compile(r"[A-Za-z0-9+/]{40,}={0,2}")
#: Places in such a run where a key can start: the first byte of DER (0x30), a length below 256, the name of a key file.
STARTS = re.compile(r"(?=M[A-P]|AAAA|b3BlbnNzaC1rZXk)")
LEAST = 40
ANY_HEX = re.compile(r"(?:[0-9a-f]{64,}|[0-9A-F]{64,})")
#: A token begins its run, so that a run without dots is read once.
TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
PEM = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+?)-----END \1-----")
KINDS = ("assign", "access", "hex", "pem", "signed", "der64", "derhex")


def value_of(data: bytes, at: int) -> tuple[int, int] | None:
    """Start and end of the value whose tag is at `at`."""
    if at + 2 > len(data):
        return None
    n, start = data[at + 1], at + 2
    if n >= 0x80:
        more = n & 0x7F
        if not 1 <= more <= 4 or start + more > len(data):
            return None
        n, start = int.from_bytes(data[start : start + more], "big"), start + more
    return start, start + n


def decoded(text: str, url: bool = False) -> bytes | None:
    try:
        bare = text.rstrip("=")
        bare = bare.replace("-", "+").replace("_", "/") if url else bare
        return base64.b64decode(bare + "=" * (-len(bare) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def signed(token: str) -> bool:
    """Whether the head of a three-part token is a JSON object that names its algorithm, and its body is JSON."""
    try:
        head, body, _ = (decoded(x, url=True) for x in token.split("."))
        head, body = json.loads(head or b""), json.loads(body or b"")
        return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)
    except (ValueError, RecursionError):
        return False


class Der:
    """Reads ASN.1 DER sequences that end where the data does. What is known of a place is kept, so that however many starts are tried,
    each place is read once."""

    def __init__(self, data: bytes):
        self.data, self.end = data, len(data)
        #: Of places at the level of such a sequence: the first three tags from there on, how many there are, and whether all are numbers.
        self.rest: dict[int, tuple[tuple, int, bool] | None] = {self.end: ((), 0, True)}
        self.closed: dict[int, bool] = {}

    def closes(self, at: int) -> bool:
        """Whether the lengths in the sequence at `at`, which ends earlier than the data, close at any depth."""
        ends, starts = [], []
        while True:
            inner = value_of(self.data, at) if self.data[at : at + 1] else None
            fits = inner is not None and inner[1] <= (ends[-1] if ends else self.end)
            known = self.closed.get(at) if self.data[at : at + 1] == b"\x30" else True
            if not fits or known is False:
                self.closed |= dict.fromkeys(starts, False)
                return False
            if known is None:
                ends.append(inner[1])
                starts.append(at)
                at = inner[0]
            else:
                at = inner[1]
            while ends and at == ends[-1]:
                ends.pop()
                self.closed[starts.pop()] = True
            if not ends:
                return True

    def level(self, at: int) -> tuple[tuple, int, bool] | None:
        """What stands from `at` to the end of the data, as elements of one sequence; None unless all lengths close."""
        path = []
        while at not in self.rest:
            self.rest[at] = None  # unless it proves to close
            inner = value_of(self.data, at)
            if inner is None or inner[1] > self.end:
                break
            tag = self.data[at]
            if tag == 0x30 and inner[1] < self.end and not self.closes(at):
                break
            deeper = tag == 0x30 and inner[1] == self.end
            path.append((at, tag, deeper))
            at = inner[0] if deeper else inner[1]
        below = self.rest.get(at)
        for at, tag, deeper in reversed(path):
            if below is not None:
                tags, n, numbers = ((), 0, True) if deeper else below
                below = ((tag, *tags[:2]), n + 1, numbers and tag == 0x02)
            self.rest[at] = below
        return below

    def key(self, at: int = 0) -> bool:
        """Whether a key fills the data from `at`: numbers only (RSA, DSA), a version and an octet string (elliptic curves), PKCS#8
        plain or encrypted, or a public key with its algorithm. Certificates and signatures are other sequences."""
        whole = value_of(self.data, at) if self.data[at : at + 1] == b"\x30" else None
        found = self.level(whole[0]) if whole is not None and whole[1] == self.end else None
        if not found or not found[1]:
            return False
        tags, n, numbers = found
        if tags[0] == 0x02:
            return tags[1:3] == (0x30, 0x04) or tags[1:2] == (0x04,) or (n >= 6 and numbers)
        first = value_of(self.data, whole[0])[0]
        return tags[0] == 0x30 and self.data[first : first + 1] == b"\x06" and n == 2 and tags[1] in (0x04, 0x03)


MAGIC = b"openssh-key-v1\0"


class Fields:
    """Reads chains of length-prefixed fields that end where the data does; the number of fields from a place on is kept, so each is read once."""

    def __init__(self, data: bytes):
        self.data, self.end = data, len(data)
        self.left: dict[int, int | None] = {self.end: 0}

    def field(self, at: int) -> int | None:
        """Where the field at `at` ends."""
        end = at + 4 + int.from_bytes(self.data[at : at + 4], "big")
        return end if at + 4 <= self.end and end <= self.end else None

    def count(self, at: int) -> int | None:
        """How many fields lie from `at` to the end; None if they don't close there."""
        path = []
        while at is not None and at not in self.left:
            path.append(at)
            at = self.field(at)
        n = None if at is None else self.left[at]
        for at in reversed(path):
            n = None if n is None else n + 1
            self.left[at] = n
        return n

    def key(self, at: int = 0) -> bool:
        """Whether a key blob fills the data from `at`: fields, the first of them an algorithm's name, or a key file, which
        names its cipher and holds as many public keys as it says and one private part."""
        if not self.data.startswith(MAGIC, at):
            return self.data.startswith((b"ssh-", b"ecdsa-", b"sk-"), at + 4) and (self.count(at) or 0) >= 2
        at += len(MAGIC)
        for _ in range(3):
            at = None if at is None else self.field(at)
        return at is not None and at + 4 <= self.end and self.count(at + 4) == int.from_bytes(self.data[at : at + 4], "big") + 1


def key_start(run: str) -> int | None:
    """Where the key begins that a run of base64 ends with; other characters of the alphabet may stand right before it.

    Each of the four alignments is decoded and read once, however many starts there are. Of a key inside a key the outer one counts.
    """
    bare = run.rstrip("=")
    whole: dict[int, tuple[bytes, Der, Fields]] = {}
    for m in STARTS.finditer(bare):
        start = m.start()
        shift, rest = start % 4, len(bare) - start
        if rest < LEAST or rest % 4 == 1:
            continue
        if shift not in whole:
            data = decoded(bare[shift:]) or b""
            whole[shift] = data, Der(data), Fields(data)
        (data, der, fields), at = whole[shift], (start - shift) // 4 * 3
        if der.key(at) if data[at : at + 1] == b"\x30" else fields.key(at):
            return start
    return None


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base kinds."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    return out + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of candidates whose decoded bytes parse: key files, signed tokens, keys in base64 and in hex."""
    out = []
    if "PRIVATE KEY-----" in text:
        for m in PEM.finditer(text):
            body = re.sub(r"\\[nr]|[\s\\]", "", m[2])
            data = decoded(body) or b""
            if Der(data).key() or Fields(data).key():
                out.append((m.start(), 3, m.end()))
    if "eyJ" in text:
        out += [(m.start(), 4, m.end()) for m in TOKEN.finditer(text) if signed(m[0])]
    files = [(s, e) for s, k, e in out if k == 3]
    inside = lambda s, e: (i := bisect.bisect(files, (s, math.inf))) and e <= files[i - 1][1]
    for m in BASE64.finditer(text):
        start = key_start(m[0])
        if start is not None and not inside(m.start() + start, m.end()):
            out.append((m.start() + start, 5, m.end()))
    out += [(m.start(), 6, m.end()) for m in ANY_HEX.finditer(text) if m[0].startswith("30") and len(m[0]) % 2 == 0 and Der(bytes.fromhex(m[0])).key()]
    return out


def said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans for every row.

    Offsets are code points, ends exclusive. Base spans are reported as their patterns say; the structural step adds spans of
    decoded and parsed candidates and takes none away. A bare key in base64 may follow other characters of the alphabet directly,
    but has to end its run; a signed token has to begin its run. Null texts count as empty: no spans, and the digest of the empty string. Whole texts are
    scanned whatever their length; repeated rows are scanned alike; an empty table gives no rows; extra columns are not read.
    """

    def find(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                text = text or ""
                base = base_spans(text)
                kinds = [k for _, k, _ in base]
                rows.append((doc_id, *(kinds.count(k) for k in range(3)), hashlib.sha256(said(base).encode()).hexdigest(), said(base + confirmed_spans(text))))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(find, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
