"""Secret scans: patterns propose, structure confirms.

Base spans come from three patterns (assignments, access keys, long hex). Besides them,
base64 and hex candidates are decoded and their structure is parsed before anything is
reported: signed-token headers (jwt), DER keys whose nested lengths add up to the last
byte (der), OpenSSH private keys (openssh) and SSH public blobs and certificates (sshkey),
whose strings are length-prefixed. A body may be wrapped over lines, which may be indented,
quoted or written out, and hex may have colons or spaces between its bytes. A key ends where
its structure says, whatever follows it.

Bytes are decoded where the structure asks for them: contents are passed over by their
lengths, and parsing stops at the first misfit. Lines of a text are indexed once for all of
its candidates. What counts as a key: at most ELEMENTS elements, DEPTH deep, or strings; a
private OpenSSH file of at most KEYS keys; and the public types of SSH_TYPES.

Every text is scanned whole, in one pass per pattern; a task holds one batch of rows.
Spans are [start, end) in code points. Defined results: a null text counts as empty; an
empty text has no spans; repeated rows give the same spans; extra columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

KINDS = ("assign", "access", "hex", "jwt", "der", "openssh", "sshkey")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORD = re.compile(r"(?i:pass|secret|token|api)", re.ASCII)
#: Runs are maximal, so a minimum in the pattern keeps just the runs that are long enough.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Candidates to decode: first lines of base64 or base64url, which may go on over line ends, longer hex in either case.
#: A header begins with a brace, perhaps white space, and a quotation mark: eyJ, or eyA, eyI, ew... with white space.
JWT = re.compile(r"(?<![A-Za-z0-9])(?:ey[AIJ]|ew)[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
BASE64 = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\[nrt]))(?:M[A-I]|AAAA|b3Bl)[A-Za-z0-9+/_-]{22,}")
#: A line of a body with the line end before it, which may be written out (\\n as in JSON), indented and quoted.
_LINE_END = r"[ \t]*(?:(?:\\+r)?\\+n|\\*(?:\r\n?|\n))[ \t>]*"
LETTERS = re.compile(r"[A-Za-z0-9+/_-]+")
NEXT_LINE = re.compile(_LINE_END + r"((?!--)[A-Za-z0-9+/_-]+)")
#: The beginning of a key in hex, at a byte; bytes may stand apart by colons or spaces.
HEX_KEY = re.compile(r"(?<![0-9A-Fa-f])(?=(?:30|00[: ]?00|6[Ff][: ]?70)(?:[: ]?[0-9A-Fa-f]{2}){10})")
DIGITS = re.compile(r"[0-9A-Fa-f]+")
NEXT_DIGITS = re.compile(r"(?::?" + _LINE_END + r"|[ \t]*:[ \t]*| (?=[0-9A-Fa-f]{2}(?![0-9A-Fa-f])))([0-9A-Fa-f]+)")
#: What a key has at most: levels of nesting, elements or strings, and keys of a private file.
DEPTH, ELEMENTS, KEYS = 32, 256, 16
OPENSSH = b"openssh-key-v1\0"
#: Strings of a public blob by its type, behind the type's name: fixed values.
SSH_TYPES = {
    b"ssh-rsa": 2, b"ssh-dss": 4, b"ssh-ed25519": 1, b"ecdsa-sha2-nistp256": 2, b"ecdsa-sha2-nistp384": 2, b"ecdsa-sha2-nistp521": 2,
    b"sk-ssh-ed25519@openssh.com": 2, b"sk-ecdsa-sha2-nistp256@openssh.com": 3,
}
#: A certificate has a nonce before these strings, and behind them a serial number, a kind, two strings, two times and five strings.
CERTIFICATE, _BEHIND = b"-cert-v01@openssh.com", (8, 4, 0, 0, 8, 8, 0, 0, 0, 0, 0)


class _Lines:
    """The letters of a run of lines, numbered from its first one; lines are looked for as far as they are asked for."""

    def __init__(self, text: str, at: int, first: re.Pattern, following: re.Pattern):
        self.text, self.at, self.following, self.over = text, at, following, False
        self.starts: list[int] = []  # each line's place in the text
        self.firsts: list[int] = []  # and the number of its first letter
        self.n = 0
        self._take(first)

    def _take(self, pattern: re.Pattern) -> None:
        m = pattern.match(self.text, self.at)
        if m is None:
            self.over = True
            return
        line = m[m.lastindex or 0]
        self.starts.append(m.end() - len(line))
        self.firsts.append(self.n)
        self.n, self.at = self.n + len(line), m.end()

    def reach(self, n: int) -> bool:
        """Whether there are ``n`` letters; more than the text can hold aren't looked for."""
        return n <= self.n + len(self.text) - self.at and self.extended(n) >= n

    def extended(self, n: int) -> int:
        while self.n < n and not self.over:
            self._take(self.following)
        return self.n

    def number(self, place: int) -> int | None:
        """The number of the letter at a place of the text, if it is in these lines."""
        while self.at <= place and not self.over:
            self._take(self.following)
        i = bisect.bisect_right(self.starts, place) - 1
        size = (self.firsts[i + 1] if i + 1 < len(self.firsts) else self.n) - self.firsts[i] if i >= 0 else 0
        return self.firsts[i] + place - self.starts[i] if i >= 0 and place < self.starts[i] + size else None

    def place(self, number: int) -> int:
        i = bisect.bisect_right(self.firsts, number) - 1
        return self.starts[i] + number - self.firsts[i]

    def letters(self, a: int, b: int) -> str:
        b, out = min(b, self.n), []
        i = bisect.bisect_right(self.firsts, a) - 1
        while a < b:
            end = self.firsts[i + 1] if i + 1 < len(self.firsts) else self.n
            start = self.starts[i] + a - self.firsts[i]
            out.append(self.text[start : start + min(b, end) - a])
            a, i = min(b, end), i + 1
        return "".join(out)


class _Body:
    """The bytes of a base64 or hex body from a letter of some lines on, decoded where they are asked for."""

    def __init__(self, lines: _Lines, first: int, bits: int):
        self.lines, self.first, self.bits = lines, first, bits
        self.near, self.data = 0, b""  # bytes decoded last, and where they begin

    def has(self, n: int) -> bool:
        return self.lines.reach(self.first - (-n * 8 // self.bits))

    def read(self, a: int, b: int) -> bytes:
        """Bytes a to b, fewer if the body ends before."""
        if a < self.near or b > self.near + len(self.data):
            self.near, self.data = a, self._decoded(a, max(b, a + 96))
        return self.data[a - self.near : b - self.near]

    def _decoded(self, a: int, b: int) -> bytes:
        self.lines.extended(self.first - (-b * 8 // self.bits))
        if self.bits == 4:
            digits = self.lines.letters(self.first + 2 * a, self.first + 2 * b)
            return bytes.fromhex(digits[: len(digits) // 2 * 2])
        group = a // 3
        letters = self.lines.letters(self.first + 4 * group, self.first + 4 * -(-b // 3))
        return _decode64(letters[: len(letters) - (len(letters) % 4 == 1)])[a - 3 * group : b - 3 * group]

    def number(self, at: int, size: int = 4) -> int | None:
        data = self.read(at, at + size)
        return int.from_bytes(data, "big") if len(data) == size else None

    def skip(self, at: int) -> int | None:
        """The end of the length-prefixed string at ``at``."""
        n = self.number(at)
        return at + 4 + n if n is not None and self.has(at + 4 + n) else None

    def end(self, n: int) -> int | None:
        """Where the text of the first ``n`` bytes ends, padding included; in base64 None amid other letters."""
        at = self.lines.place(self.first - (-n * 8 // self.bits) - 1) + 1
        if self.bits == 4:
            return at
        text = self.lines.text
        if LETTERS.match(text, at) and not text.startswith("--", at):
            return None
        for _ in range(-n % 3):
            at += text.startswith("=", at)
        return at


def _decode64(letters: str) -> bytes:
    return base64.b64decode(letters.replace("-", "+").replace("_", "/") + "=" * (-len(letters) % 4))


def _element(body: _Body, at: int) -> tuple[int, int, int] | None:
    """(tag, start of the content, its end) of the DER element at ``at``, if its length is well formed."""
    head = body.read(at, at + 6)
    if len(head) < 2:
        return None
    n, start = head[1], at + 2
    if n & 0x80:
        size = n & 0x7F
        if not 1 <= size <= 4 or len(head) < 2 + size or head[2] == 0:
            return None
        n, start = int.from_bytes(head[2 : 2 + size], "big"), start + size
        if n < 0x80:
            return None
    return head[0], start, start + n


def der_end(body: _Body) -> int | None:
    """The length of a key: a SEQUENCE whose elements fill it in turn, with an INTEGER or an
    algorithm identifier in front, as keys of PKCS #1, PKCS #8 and SEC 1 have."""
    outer = _element(body, 0)
    if outer is None or outer[0] != 0x30 or outer[2] < 24:
        return None
    _, at, whole = outer
    ends, elements, first = [whole], 0, None
    while ends:
        if at == ends[-1]:
            ends.pop()
            continue
        inner = _element(body, at)
        if inner is None or inner[2] > ends[-1] or elements >= ELEMENTS:
            return None
        tag, start, end = inner
        if first is None:
            first = tag
            if tag not in (0x02, 0x30) or not body.has(whole):
                return None
        elements += 1
        if tag & 0x20:
            if len(ends) > DEPTH:
                return None
            ends.append(end)
            at = start
        elif tag in (0x02, 0x03, 0x04, 0x05, 0x06) or tag & 0xC0 == 0x80:
            at = end
        else:
            return None
    return whole if elements >= 2 else None


def openssh_end(body: _Body) -> int | None:
    """The length of a private OpenSSH file: cipher, derivation, its options, public blobs, the private part."""
    at: int | None = len(OPENSSH)
    for _ in range(3):
        if (at := body.skip(at)) is None:
            return None
    keys, at = body.number(at), at + 4
    if keys is None or keys > KEYS:
        return None
    for _ in range(keys + 1):
        if (at := body.skip(at)) is None:
            return None
    return at


def ssh_end(body: _Body) -> int | None:
    """The length of a public blob or certificate of a known type."""
    size = body.number(0) or 0
    name = body.read(4, 4 + size) if size <= 64 else b""
    strings = SSH_TYPES.get(name.removesuffix(CERTIFICATE))
    if strings is None and name.endswith(b"-cert-v01" + b"@openssh.com"):  # names of security keys end so themselves
        strings = SSH_TYPES.get(name.removesuffix(CERTIFICATE) + b"@openssh.com")
    if strings is None:
        return None
    sizes = (0,) * (1 + strings) + _BEHIND if name.endswith(CERTIFICATE) else (0,) * strings
    at: int | None = 4 + size
    for n in sizes:
        if (at := at + n if n and body.has(at + n) else None if n else body.skip(at)) is None:
            return None
    for _ in range(ELEMENTS):  # comments and more strings may follow in one body
        if body.end(at) is not None:
            return at
        if (at := body.skip(at)) is None:
            return None
    return None


def structure_of(body: _Body) -> tuple[str, int] | None:
    """(kind, end in the text) of the key at the body's start."""
    head = body.read(0, 18)
    if head[:1] == b"\x30":
        kind, n = "der", der_end(body)
    elif head.startswith(OPENSSH):
        kind, n = "openssh", openssh_end(body)
    else:
        kind, n = "sshkey", ssh_end(body)
    end = body.end(n) if n is not None else None
    return (kind, end) if end is not None else None


def is_jwt(text: str) -> bool:
    """Three parts: the header and the claims are JSON objects, and the header names its algorithm."""
    try:
        header, claims, signature = text.split(".")
        head = json.loads(base64.urlsafe_b64decode(header + "=" * (-len(header) % 4)))
        body = json.loads(base64.urlsafe_b64decode(claims + "=" * (-len(claims) % 4)))
        base64.urlsafe_b64decode(signature + "=" * (-len(signature) % 4))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(head.get("alg"), str) and isinstance(body, dict)


def confirmed(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans whose decoded content has the structure of a key or token."""
    if "eyJ" in text or "eyA" in text or "eyI" in text or "ew" in text:
        for m in JWT.finditer(text):
            if is_jwt(m[0]):
                yield "jwt", m.start(), m.end()
    for candidates, first, following, bits in ((BASE64, LETTERS, NEXT_LINE, 6), (HEX_KEY, DIGITS, NEXT_DIGITS, 4)):
        done, lines = 0, None
        for m in candidates.finditer(text):
            # inner lines of a key that is found are no candidates; after a failure the next line is one
            if m.start() < done:
                continue
            number = lines.number(m.start()) if lines else None
            if number is None:
                lines, number = _Lines(text, m.start(), first, following), 0
            if found := structure_of(_Body(lines, number, bits)):
                kind, done = found
                yield kind, m.start(), done


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns, leftmost and not overlapping within a kind."""
    out = []
    if ASSIGN_WORD.search(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        base, every, counts = [], [], []
        for value in batch.column(1):
            text = value.as_py() or ""
            spans = base_spans(text)
            base.append(_joined(spans))
            every.append(_joined(spans + list(confirmed(text))))
            counts.append([sum(s[0] == kind for s in spans) for kind in KINDS[:3]])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(3)), pa.array(base, pa.string()), pa.array(every, pa.string())],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans"],
        )


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_spans, spans), spans as kind:start:end joined by commas."""
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_spans string, spans string")
