"""Secret scanning with structural confirmation.

Candidates come from three patterns (assignments, access key ids, hexadecimal runs), which are
reported as they stand, and from encoded runs, which are reported only when decoding confirms them:

* ``key``: base64 or hexadecimal that decodes to a private key: DER whose nested lengths add up
  exactly, the wrapped key included (PKCS#1, PKCS#8, plain or encrypted, SEC1), or the OpenSSH container
  with all its length-prefixed fields; PEM bodies sealed as a whole say so in their header lines;
* ``token``: a signed token whose header decodes to a JSON object naming an algorithm and whose
  payload is a JSON object;
* ``encoded``: base64 or hexadecimal of text (white space included) that itself holds an assignment or
  an access key id.

Runs wrapped over lines of one length, by line breaks or by the escapes of JSON, are joined first.

Work is one pass over the texts; nothing is shuffled.  A text without a word of 16 characters and
without a keyword costs a split and a few substring searches.

Defined results: null text counts as empty; offsets are code points, ends exclusive; rows are
answered one by one, so repeated or null ids give a row each; other columns are ignored by the
scan and kept by ``redact_secrets``; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_batches, spread

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "key", "token", "encoded")

_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
# Both classes match maximal runs, so a least length inside the pattern drops what is too short.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
# Every pattern reads a text in linear time: no repetition holds another that can match the same characters.
_BEGIN = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY)-----")
_MARK = re.compile(r"-----(?:BEGIN|END) ")
_SEALED = re.compile(r"\s*Proc-Type: 4,ENCRYPTED\s+DEK-Info: [A-Z0-9-]+,[0-9A-Fa-f]{16,}(?=\s)")
_HEADER = re.compile(r"[A-Za-z-]+: ")
_BASE64 = re.compile(r"[A-Za-z0-9+/=]+")
_JWT = re.compile(r"(?:(?<![A-Za-z0-9_.-])|(?<=\\[nrt]))(eyJ[A-Za-z0-9_-]+)\.([A-Za-z0-9_-]+)\.([A-Za-z0-9_-]*)")
# The letter of an escape is not part of the run that follows it.
_START = r"(?:(?<=\\[nrt])|(?<![A-Za-z0-9+/_-])(?!(?<=\\)[nrt]))"
_RUN = re.compile(_START + r"[A-Za-z0-9+/_-]{24,}={0,2}")
_LINES = re.compile(_START + r"[A-Za-z0-9+/_-]{16,}(?:(?:\r?\n|(?:\\+r)?\\+n)[ \t>]*[A-Za-z0-9+/_-]+={0,2})+")
_BREAK = re.compile(r"(?:\r?\n|(?:\\+r)?\\+n)[ \t>]*")
_ESCAPE = re.compile(r"(?<!\\)\\+[nr]")
_HEXED = re.compile(r"(?:[0-9a-f]{2}){12,}|(?:[0-9A-F]{2}){12,}")

Span = tuple[str, int, int]


def base_spans(text: str) -> list[Span]:
    """The spans of the three base patterns."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in _KEYWORDS):
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return out


def _items(data: bytes) -> list[tuple[int, bytes]] | None:
    """The DER items that fill ``data`` exactly, or None where lengths don't add up."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, n = data[at], data[at + 1]
        at += 2
        if n >= 128:
            more = n - 128
            if not 1 <= more <= 4 or at + more > len(data) or data[at] == 0:
                return None
            n = int.from_bytes(data[at : at + more], "big")
            at += more
            if n < 128:
                return None
        if at + n > len(data):
            return None
        out.append((tag, data[at : at + n]))
        at += n
    return out


def _positive(data: bytes) -> bool:
    """Whether an INTEGER's content is a positive number in its shortest form."""
    return bool(data) and data[0] < 128 and any(data) and not (len(data) > 1 and data[0] == 0 and data[1] < 128)


def _rsa(inner) -> bool:
    """PKCS#1: version, then modulus, exponents, primes and the rest as positive numbers."""
    tags = [t for t, _ in inner]
    others = tags[9:] == ([] if inner[0][1] == b"\0" else [0x30])
    return tags[:9] == [0x02] * 9 and others and all(_positive(v) for _, v in inner[1:9])


def _sec1(inner) -> bool:
    """SEC1: version 1, the number's bytes, then the curve and the public point, each in its own wrapper."""
    if inner[0][1] != b"\1" or len(inner) < 2 or inner[1][0] != 0x04 or not 16 <= len(inner[1][1]) <= 66:
        return False
    for tag, data in inner[2:]:
        held = _items(data)
        if not held or len(held) != 1 or (tag, held[0][0]) not in ((0xA0, 0x06), (0xA0, 0x30), (0xA1, 0x03)):
            return False
        if tag == 0xA1 and held[0][1][:2] not in (b"\0\2", b"\0\3", b"\0\4"):
            return False
    return len(inner) <= 4


def _sequence(data: bytes):
    """The items of the one SEQUENCE that fills ``data``, if it is one."""
    outer = _items(data)
    return _items(outer[0][1]) if outer and len(outer) == 1 and outer[0][0] == 0x30 else None


# Object identifiers of key algorithms, as DER holds them, and what they wrap.
_RSA, _EC = bytes.fromhex("2a864886f70d010101"), bytes.fromhex("2a8648ce3d0201")
_EDWARDS = {bytes.fromhex("2b656e"): 32, bytes.fromhex("2b656f"): 56, bytes.fromhex("2b6570"): 32, bytes.fromhex("2b6571"): 57}
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _pkcs8(inner) -> bool:
    """PKCS#8: version, algorithm, a wrapped key of that algorithm, attributes."""
    algorithm, wrapped = _items(inner[1][1]), inner[2][1]
    if not algorithm or algorithm[0][0] != 0x06 or len(algorithm) > 2 or not all(t in (0xA0, 0xA1, 0x81) for t, _ in inner[3:]):
        return False
    name, held = algorithm[0][1], _items(wrapped)
    if not held or len(held) != 1:
        return False
    if name in _EDWARDS:
        return held[0][0] == 0x04 and len(held[0][1]) == _EDWARDS[name]
    if name in (_RSA, _EC):
        key = _sequence(wrapped)
        return bool(key) and key[0][0] == 0x02 and len(key[0][1]) == 1 and (_rsa if name == _RSA else _sec1)(key)
    return held[0][0] == 0x02 and _positive(held[0][1])  # DSA, DH: one number


def _strings(data: bytes, count: int, at: int = 0):
    """(``count`` length-prefixed strings, where they end), or None where they do not fit."""
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4 + n
        if at > len(data):
            return None
        out.append(data[at - n : at])
    return out, at


# How many strings the private part of an OpenSSH key of a type holds.
_SSH_FIELDS = {b"ssh-rsa": 6, b"ssh-dss": 5, b"ssh-ed25519": 2, b"ecdsa-sha2-nistp256": 3, b"ecdsa-sha2-nistp384": 3, b"ecdsa-sha2-nistp521": 3}


def _openssh(data: bytes) -> bool:
    """All fields of an OpenSSH container, to its last byte of padding."""
    head = _strings(data, 3, 15)
    if not head or head[1] + 4 > len(data):
        return False
    (cipher, derivation, options), at = head
    keys = int.from_bytes(data[at : at + 4], "big")
    rest = _strings(data, keys + 1, at + 4) if 1 <= keys <= 64 else None
    if not rest or rest[1] != len(data) or (cipher == b"none") != (derivation == b"none"):
        return False
    *public, private = rest[0]
    names = [(_strings(k, 1) or ([b""], 0))[0][0] for k in public]
    if not all(n in _SSH_FIELDS for n in names) or len(private) < 16 or len(private) % 8:
        return False
    if cipher != b"none":
        salt = _strings(options, 1)
        return bool(cipher and salt) and len(salt[0][0]) >= 8 and salt[1] + 4 == len(options)
    if options or private[:4] != private[4:8]:
        return False
    at = 8
    for name in names:
        found = _strings(private, 2 + _SSH_FIELDS[name], at)  # type, fields, comment
        if not found or found[0][0] != name or not all(found[0][1:-1]):
            return False
        at = found[1]
    return private[at:] == bytes(range(1, len(private) - at + 1)) and len(private) - at < 16


def is_private_key(data: bytes) -> bool:
    """Whether bytes are a private key by their structure, parsed to the end."""
    if data.startswith(b"openssh-key-v1\0"):
        return _openssh(data)
    inner = _sequence(data)
    if not inner:
        return False
    tags = [t for t, _ in inner]
    if tags == [0x30, 0x04]:  # an encrypted PKCS#8 key: how, and the cipher's blocks
        how = _items(inner[0][1])
        return bool(how) and len(how) == 2 and [t for t, _ in how] == [0x06, 0x30] and how[0][1].startswith(_PASSWORD_BASED) and bool(_items(how[1][1])) and len(inner[1][1]) >= 16 and len(inner[1][1]) % 8 == 0
    if tags[0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    if tags[1:3] == [0x30, 0x04]:
        return _pkcs8(inner)
    return _rsa(inner) or _sec1(inner)


def _decoded(run: str) -> bytes | None:
    body = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(body) % 4 == 1:
        return None
    try:
        return base64.b64decode(body + "=" * (-len(body) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _is_key_body(inside: str) -> bool:
    """Whether what stands between the marks of a PEM block is a key: header lines, then base64 over lines, whose
    breaks may be the escapes of JSON.  A body sealed as a whole says so in its first two headers."""
    inside = _ESCAPE.sub("\n", inside)
    sealed = _SEALED.match(inside)
    lines = inside[sealed.end() if sealed else 0 :].split("\n")
    first = next((i for i, line in enumerate(lines) if line.strip() and not _HEADER.match(line.lstrip())), len(lines))
    body = "".join("".join(lines[first:]).split())
    if not _BASE64.fullmatch(body):
        return False
    data = _decoded(body) or b""
    return is_private_key(data) or (bool(sealed) and len(data) >= 16 and len(data) % 8 == 0)


def _pem_spans(text: str) -> list[Span]:
    """Blocks from a BEGIN to the END of the same label with no other mark between them."""
    out = []
    for m in _BEGIN.finditer(text):
        mark, end = _MARK.search(text, m.end()), f"-----END {m[1]}-----"
        if mark and text.startswith(end, mark.start()) and _is_key_body(text[m.end() : mark.start()]):
            out.append(("key", m.start(), mark.start() + len(end)))
    return out


class _Taken:
    """Which stretches lie inside a span that is already reported."""

    def __init__(self, found: list[Span]):
        self.starts = sorted(s for _, s, _ in found)
        self.reach = list(accumulate((e for _, _, e in sorted(found, key=lambda x: x[1])), max))

    def free(self, start: int, end: int) -> bool:
        k = bisect_right(self.starts, start)
        return not k or self.reach[k - 1] < end


def _is_token(m: re.Match) -> bool:
    parts = []
    for k in (1, 2):
        try:
            parts.append(json.loads(_decoded(m[k]) or b""))
        except (ValueError, RecursionError):
            return False
    return all(isinstance(p, dict) for p in parts) and isinstance(parts[0].get("alg"), str) and bool(m[3] or parts[0]["alg"].lower() == "none")


def _meaning(data: bytes | None) -> str | None:
    """The kind that decoded bytes confirm, if any."""
    if not data:
        return None
    if is_private_key(data):
        return "key"
    try:
        inner = data.decode()
    except UnicodeDecodeError:
        return None
    readable = "".join(inner.split()).replace(" ", "").isprintable()
    return "encoded" if readable and any(k in BASE_KINDS[:2] for k, _, _ in base_spans(inner)) else None


def _run_meaning(run: str) -> str | None:
    """The kind of a run as base64 or, where it is all of hexadecimal digits, as those."""
    return _meaning(_decoded(run)) or (_meaning(bytes.fromhex(run)) if _HEXED.fullmatch(run) else None)


def _wrapped(text: str, start: int, end: int) -> list[Span]:
    """Confirmed blocks of a stretch of lines: lines of one length, of which the first may be cut by
    what stands before it and the last may be shorter."""
    lines, at = [], start
    for m in _BREAK.finditer(text, start, end):
        lines.append((at, m.start()))
        at = m.end()
    lines.append((at, end))
    size = [e - s for s, e in lines]
    out, i = [], 0
    while i < len(lines) - 1:
        width = max(size[i], size[i + 1]) if i == 0 else size[i]
        j = i + 1
        while j < len(lines) and size[j] == width:
            j += 1
        for stop in (j + 1, j) if j < len(lines) and size[j] < width else (j,):
            if stop - i > 1 and (kind := _run_meaning("".join(text[s:e] for s, e in lines[i:stop]))):
                out.append((kind, lines[i][0], lines[stop - 1][1]))
                i = stop
                break
        else:
            # A cut first line may be no part of the block after it.
            i = i + 1 if i == 0 and size[0] != width else j
    return out


def confirmed_spans(text: str) -> list[Span]:
    """Encoded candidates that decoding and parsing confirm."""
    out: list[Span] = []
    if "-----BEGIN" in text:
        out += _pem_spans(text)
    if "eyJ" in text:
        out += [("token", *m.span()) for m in _JWT.finditer(text) if _is_token(m)]
    free = _Taken(out).free
    # Stretches of lines don't overlap, so one is never inside another's blocks.
    out += [x for m in _LINES.finditer(text) for x in _wrapped(text, *m.span()) if free(*x[1:])]
    free = _Taken(out).free
    for m in _RUN.finditer(text):
        s, e = m.span()
        if not free(s, e):
            continue
        kind = _meaning(_decoded(m[0]))
        if not kind and s > 1 and text[s - 2] == "\\":  # no escape, but a letter of the run
            s -= 1
            kind = _meaning(_decoded(text[s:e]))
        if kind:
            out.append((kind, s, e))
    out += [(kind, *m.span()) for m in _HEXED.finditer(text) if free(*m.span()) and (kind := _meaning(bytes.fromhex(m[0])))]
    return out


def spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), each by start and then kind."""
    long_word = any(len(w) >= 16 for w in text.split()) or "-----BEGIN" in text
    if not long_word:
        low = text.lower()
        if not any(k in low for k in _KEYWORDS):
            return [], []
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    more = confirmed_spans(text) if long_word else []
    return base, sorted(base + more, key=order) if more else base


def joined(found: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


def secret_spans(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed."""
    names = ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        for b in batches:
            out = [b.column(0).to_pylist(), *([] for _ in names[1:])]
            for text in b.column(1):
                base, every = spans(text.as_py() or "")
                counts = [sum(k == kind for k, _, _ in base) for kind in BASE_KINDS]
                said = joined(base)
                for column, value in zip(out[1:], (*counts, hashlib.sha256(said.encode()).hexdigest(), joined(every), len(every) - len(base))):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], list(names))

    return in_batches(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))).mapInArrow(
        run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long"
    )


def redacted(text: str) -> str:
    """The text with each run of overlapping spans replaced by its first kind."""
    _, every = spans(text)
    out, at, i = [], 0, 0
    while i < len(every):
        kind, s, e = every[i]
        while i + 1 < len(every) and every[i + 1][1] < e:
            i += 1
            e = max(e, every[i][2])
        out += [text[at:s], f"[{kind.upper()}]"]
        at, i = e, i + 1
    return "".join([*out, text[at:]])


def redact_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` replaced by their kinds; ``n_chars`` follows where present."""

    def clean(texts):
        said = (t.as_py() for t in texts)
        return pa.array([t if t is None else redacted(t) for t in said], pa.string())

    clean.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    out = in_batches(docs).withColumn("text", F.arrow_udf(clean, "string")(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"]))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
