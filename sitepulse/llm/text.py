"""Byte-level text helpers shared by the Python stages.

All rules of the operators are ASCII rules on code points, and UTF-8 keeps
ASCII bytes apart from all others, so they are applied to bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def utf8(value) -> bytes:
    """UTF-8 bytes of a text; null is empty."""
    return b"" if value is None else value.encode("utf-8", "surrogatepass")


def words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of anything but space and \\t\\n\\v\\f\\r."""
    return raw.lower().split()


#: Maps A-Z to a-z, keeps 0-9, a-z and all bytes from 0x80, blanks the rest.
ALNUM = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def alnum_words(raw: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) runs of digits, ASCII letters and non-ASCII characters."""
    return raw.translate(ALNUM).split()


#: Rows that the Python stages turn into Python objects at a time.
ROWS = 256


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows: Arrow batches hold thousands of
    texts, and the words of all of them would be many times their size."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
