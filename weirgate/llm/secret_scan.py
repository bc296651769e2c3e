"""Operator 12: secret scans.

One pass of an Aho-Corasick automaton over each text finds the places of all keywords; only there, regular expressions are tried, anchored
at the hit. Bare hexadecimal keys have no keyword: long runs of their characters are found over the bytes of a whole batch at once.
Formats that carry a checksum are found as spans of their own, if it is right. All patterns match ASCII only,
so texts are scanned as bytes, and places are turned to code points at the end. Nothing is shuffled.
"""

from __future__ import annotations

import base64
import binascii
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import packed, table, with_columns

#: Digits of base 62, as the checksums of access tokens have them.
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
HEX = np.zeros(256, bool)
HEX[[*b"0123456789abcdef"]] = True


@dataclass(frozen=True)
class Format:
    """What a kind of secret looks like. keywords: in lower case, every match begins with one of them in some case. least: length of
    group `part` from which a match counts. Matches that don't count still use up their text. valid: a check of the match."""

    kind: str
    keywords: tuple[bytes, ...]
    pattern: bytes
    least: int
    part: int = 0
    valid: str = ""


# The base formats, which the contract of the query states.
ASSIGN = Format("assign", (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key"), rb"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 8, 2)
ACCESS = Format("access", (b"akia",), rb"AKIA[A-Z0-9]+", 16)
HEX_RUN = 32
BASE_KINDS = ("assign", "access", "hex")
# Public formats with a checksum. Access tokens of code and package registries end in six base-62 digits of the CRC-32 of what stands
# between prefix and checksum; a payment card's digits add up by Luhn's rule, an account number gives 1 modulo 97; a signed web token
# has a header and a payload of JSON in base 64.
CHECKED = (
    Format("forge", tuple(b"gh%c_" % c for c in b"pousr"), rb"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", 40, valid="crc"),
    Format("registry", (b"npm_",), rb"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9_])", 40, valid="crc"),
    Format("card", (b"card",), rb"(?i:card[_\x20]?(?:number|no\.?)?)[\"']?\x20*[:=#]?\x20*[\"']?((?:[0-9][\x20-]?){12,18}[0-9])(?![0-9])", 13, 1, "luhn"),
    Format("account", (b"iban",), rb"(?i:iban)[\"']?\x20*[:=]?\x20*[\"']?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])", 15, 1, "mod97"),
    Format("webtoken", (b"eyj",), rb"eyJ[A-Za-z0-9_-]{8,2000}\.eyJ[A-Za-z0-9_-]{8,8000}\.[A-Za-z0-9_-]+", 32, valid="json"),
)
FORMATS = (ASSIGN, ACCESS, *CHECKED)
KINDS = (*BASE_KINDS, *(f.kind for f in CHECKED))


def crc_base62(body: bytes, digits: int = 6) -> bytes:
    """The CRC-32 of body in base 62, with leading zeros."""
    n, out = zlib.crc32(body), bytearray()
    for _ in range(digits):
        n, d = divmod(n, 62)
        out.append(BASE62[d])
    return bytes(reversed(out))


def _crc(match: bytes) -> bool:
    body = match.partition(b"_")[2]
    return crc_base62(body[:-6]) == body[-6:]


def _luhn(match: bytes) -> bool:
    digits = [c - 48 for c in match if 48 <= c < 58]
    twice = [d for x in digits[-2::-2] for d in divmod(2 * x, 10)]
    return len(set(digits)) > 1 and (sum(digits[::-2]) + sum(twice)) % 10 == 0


def _mod97(match: bytes) -> bool:
    plain = match.replace(b" ", b"").decode()
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _json(match: bytes) -> bool:
    try:
        return all(base64.urlsafe_b64decode(x + b"=" * (-len(x) % 4)).strip().endswith(b"}") for x in match.split(b".")[:2])
    except (binascii.Error, ValueError):
        return False


VALID = {"": lambda _: True, "crc": _crc, "luhn": _luhn, "mod97": _mod97, "json": _json}


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    """keyword -> (its length, indexes of the formats that begin with it)."""
    found: dict[str, list[int]] = {}
    for i, f in enumerate(FORMATS):
        for k in f.keywords:
            found.setdefault(k.decode("latin-1"), []).append(i)
    out = ahocorasick.Automaton()
    for k, formats in found.items():
        out.add_word(k, (len(k), tuple(formats)))
    out.make_automaton()
    return out


_PATTERNS = tuple(re.compile(f.pattern) for f in FORMATS)


def _near_hits(data: bytes, ends: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """text, kind, start, end in bytes of data, of the formats with keywords. ends: where each text of data ends."""
    places: dict[tuple[int, int], set[int]] = {}
    lowered = data.lower().decode("latin-1")  # A-Z as a-z; a character is a byte
    for last, (size, formats) in _automaton().iter(lowered):
        t = int(np.searchsorted(ends, last, "right"))
        if t == 0 or last + 1 - size >= ends[t - 1]:  # else it begins in a text before
            for i in formats:
                places.setdefault((t, i), set()).add(last + 1 - size)
    for (t, i), starts in places.items():
        f, done = FORMATS[i], -1
        for at in sorted(starts):
            m = _PATTERNS[i].match(data, at, int(ends[t])) if at >= done else None  # or it is within the match before
            if m:
                done = m.end()
                if m.end(f.part) - m.start(f.part) >= f.least and VALID[f.valid](m[f.part]):
                    yield t, f.kind, m.start(), m.end()


def _hex_runs(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, str, int, int]]:
    """As _near_hits, of each run of HEX_RUN or more hexadecimal characters in lower case."""
    inside = np.concatenate([[False], HEX[data], [False]])
    step = np.flatnonzero(inside[1:] != inside[:-1])  # begins and ends in turn, over the borders of texts
    long = np.flatnonzero(step[1::2] - step[::2] >= HEX_RUN)
    for a, b in zip(step[::2][long].tolist(), step[1::2][long].tolist(), strict=True):
        t = int(np.searchsorted(ends, a, "right"))
        while a < b:
            e = min(b, int(ends[t]))
            if e - a >= HEX_RUN:
                yield t, "hex", a, e
            a, t = max(a, e), t + 1


def _scanned(batches: Iterator[pa.RecordBatch], text: int, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
    """row and found of batches of row. text: number of the field of row that is scanned."""
    order = {k: i for i, k in enumerate(KINDS)}
    for batch in batches:
        row = batch.column("row")
        for part in tokens.batches(pa.RecordBatch.from_arrays([row, row.field(text)], ["row", "text"]), "text"):
            data, offsets = tokens._bytes_of(part.column("text"))
            data, ends = data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]
            found: list[list[tuple[int, str, int]]] = [[] for _ in range(part.num_rows)]
            for spans in (_near_hits(data.tobytes(), ends), _hex_runs(data, ends)):
                for t, k, s, e in spans:
                    found[t].append((s, k, e))
            for t, spans in enumerate(found):
                if spans:
                    begin = int(ends[t - 1]) if t else 0
                    before = np.concatenate([[0], np.cumsum((data[begin : ends[t]] & 0xC0) != 0x80)])  # characters that begin before a byte
                    spans.sort(key=lambda x: (x[0], order[x[1]], x[2]))
                    found[t] = [{"kind": k, "start": int(before[s - begin]), "end": int(before[e - begin])} for s, k, e in spans]
            yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(found, kind)], ["row", "found"])


SPAN = "struct<kind:string,start:long,end:long>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """docs' columns and spans, array of (kind, start, end) in code points, end exclusive, by start, then kind as in KINDS.

    Base kinds (assign, access, hex) are the leftmost matches of their patterns that don't overlap within a kind; kinds with a checksum are
    added where it is right, also over base ones. A null or empty text has no spans. Rows are kept one for one; repeated rows get
    the same result. A column spans is replaced. Texts are scanned whole, whatever their length.
    """
    rows = docs.select(packed(docs).alias("row"))
    text, struct = [c.lower() for c in docs.columns].index("text"), rows.schema["row"].dataType.simpleString()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    out = rows.mapInArrow(lambda b: _scanned(b, text, kind), f"row {struct}, found array<{SPAN}>")
    return with_columns(out, "row", spans=F.col("found"))


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return x.select("doc_id", *[of(k) for k in BASE_KINDS], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
