"""Secret scan: keyword prefilter, anchored patterns, checksum validation.

One pass of an Aho-Corasick automaton over the ASCII-lower-cased text finds
where a keyword begins; only there are the patterns tried, anchored.  Runs
of hex digits have no keyword: a run of 16 or more must cover a character
at a multiple of 16, so only those positions are looked at.  Token formats
that embed a checksum are reported only if the checksum holds.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitepulse.llm.text import slices

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "xprv")

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_NPM = re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])")
_RUN = re.compile(r"[A-Za-z0-9_-]*")
_XPRV = re.compile(r"xprv[1-9A-HJ-NP-Za-km-z]{107}(?![1-9A-HJ-NP-Za-km-z])")
#: keyword in lower case -> kind
KEYWORDS = {
    "password": "assign",
    "passwd": "assign",
    "secret": "assign",
    "token": "assign",
    "apikey": "assign",
    "api_key": "assign",
    "akia": "access",
    "ghp_": "github",
    "gho_": "github",
    "ghu_": "github",
    "ghs_": "github",
    "ghr_": "github",
    "npm_": "npm",
    "eyj": "jwt",
    "xprv": "xprv",
}
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: str) -> str:
    """The six base-62 digits of CRC-32 that end a token of 30 + 6 characters."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, r = divmod(n, 62)
        out = _BASE62[r] + out
    return out


def _crc_holds(m: re.Match) -> bool:
    return crc_suffix(m[1][:30]) == m[1][30:]


_BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def _base58_holds(m: re.Match) -> bool:
    """Base58Check: the last 4 of 82 bytes start the double SHA-256 of the others."""
    n = 0
    for c in m[0]:
        n = n * 58 + _BASE58.index(c)
    if n >> 8 * 82:
        return False
    raw = n.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(raw[:78]).digest()).digest()[:4] == raw[78:]


def _jwt_holds(m) -> bool:
    """Both parts are base64url JSON objects and the header names an algorithm.

    A part nested deeper than the parser goes is no token.
    """
    try:
        head, body = (json.loads(base64.urlsafe_b64decode(x + "=" * (-len(x) % 4))) for x in (m[1], m[2]))
    except (ValueError, RecursionError):
        return False
    return isinstance(head, dict) and isinstance(body, dict) and "alg" in head


class _Jwt:
    """Matches ``eyJ..., eyJ..., ...`` joined by dots, anchored, in time linear in the text.

    A part ends where its run of token characters ends, whatever place in
    the run it starts at.  So the ends of the last two runs are remembered,
    and a start in a run that nothing fitting follows costs nothing.
    """

    def __init__(self):
        self._text, self._runs = None, []

    def _end(self, text: str, at: int) -> int:
        if text is not self._text:
            self._text, self._runs = text, []
        for a, b in self._runs:
            if a <= at < b:
                return b
        end = _RUN.match(text, at).end()
        if end > at:
            self._runs = [*self._runs[-1:], (at, end)]
        return end

    def match(self, text: str, start: int):
        if not text.startswith("eyJ", start):
            return None
        first = self._end(text, start)
        if first - start < 4 or not text.startswith(".eyJ", first):
            return None
        second = self._end(text, first + 1)
        if second - first < 5 or not text.startswith(".", second):
            return None
        third = self._end(text, second + 1)
        if third == second + 1:
            return None
        return _Found(text, start, first, second, third)


class _Found:
    """The parts of a match, as ``re.Match`` gives them."""

    def __init__(self, text, start, first, second, third):
        self._parts = (text[start:third], text[start:first], text[first + 1 : second], text[second + 1 : third])
        self._end = third

    def __getitem__(self, i: int) -> str:
        return self._parts[i]

    def end(self) -> int:
        return self._end


RULES = {
    "assign": (_ASSIGN, lambda m: len(m[2]) >= 12),
    "access": (_ACCESS, lambda m: len(m[0]) >= 18),
    "github": (_GITHUB, _crc_holds),
    "npm": (_NPM, _crc_holds),
    "jwt": (_Jwt(), _jwt_holds),
    "xprv": (_XPRV, _base58_holds),
}
_HEX_DIGIT = frozenset("0123456789abcdef")
MIN_HEX = 16


def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (len(word), kind))
    found.make_automaton()
    return found


def scan(text: str, keywords) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, ordered by start and then as in KINDS.

    Per kind, matches are leftmost and do not overlap; a match that fails its
    test has still used up its characters.
    """
    if text.isascii():
        low = text.lower()
    else:
        low = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    out, free = [], dict.fromkeys(RULES, 0)
    for last, (n, kind) in keywords.iter(low):
        start = last + 1 - n
        if start >= free[kind]:
            pattern, holds = RULES[kind]
            if m := pattern.match(text, start):
                free[kind] = m.end()
                if holds(m):
                    out.append((start, m.end(), kind))
    end = 0
    for i, c in enumerate(text[MIN_HEX - 1 :: MIN_HEX]):
        if c in _HEX_DIGIT:
            at = i * MIN_HEX + MIN_HEX - 1
            if at >= end:
                start = at
                while start > end and text[start - 1] in _HEX_DIGIT:
                    start -= 1
                end = _HEX.match(text, at).end()
                if end - start >= MIN_HEX:
                    out.append((start, end, "hex"))
    out.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return out


def _scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keywords = automaton()
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in slices(batches):
        spans = [
            [{"kind": k, "start": a, "end": b} for a, b, k in scan(text or "", keywords)]
            for text in batch.column("text").to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans (array of kind, start, end) for every row of ``docs``.

    Offsets count code points of the text, the end is exclusive.  Null and
    empty texts have no spans; repeated rows each get a row; other columns
    are not read.  Each text is scanned whole and on its own, so the result
    needs no exchange.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan_batches, f"doc_id {kind}, spans array<struct<kind: string, start: bigint, end: bigint>>"
    )


def _mask(text: str, spans: list[dict], mark: str) -> str:
    out, last = [], 0
    for s in spans:
        if s["end"] > last:
            out.append(text[last : max(last, s["start"])])
            out.append(mark)
            last = s["end"]
    return "".join([*out, text[last:]])


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of its texts replaced by ``mark``; null stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keywords = automaton()
        for batch in slices(batches):
            at = batch.schema.get_field_index(text_col)
            texts = [
                None if t is None else _mask(t, [{"start": a, "end": b} for a, b, _ in scan(t, keywords)], mark)
                for t in batch.column(at).to_pylist()
            ]
            yield batch.set_column(at, text_col, pa.array(texts, pa.string()))

    return docs.mapInArrow(run, docs.schema)
