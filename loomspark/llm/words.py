"""Word splitting and small Arrow helpers that the text operators share.

Everything works on UTF-8 bytes: ``bytes.lower`` folds A-Z only and ``bytes.split``
cuts at exactly 0x20 and 0x09-0x0D, so no locale or Unicode table is involved.
A null text has no words, like an empty one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A-Z folded, ASCII letters, digits and all non-ASCII bytes kept, the rest turned into blanks.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def alnum_words(text: bytes) -> list[bytes]:
    """Words of ASCII letters, digits and non-ASCII characters, A-Z folded."""
    return text.translate(ALNUM).split()


def blank_words(text: bytes) -> list[bytes]:
    """Words between blanks and control white space, A-Z folded."""
    return text.lower().split()


def text_bytes(column: pa.Array) -> list[bytes]:
    """The column's texts as UTF-8; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 2048, text_bytes: int | None = None, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that Python objects of few rows live at once.

    ``text_bytes``: how many bytes the column ``column`` of a batch has at most, unless one row has more.
    """
    for batch in batches:
        ends = None if text_bytes is None else np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            n = rows
            if ends is not None:
                before = int(ends[at - 1]) if at else 0
                n = min(rows, max(1, int(np.searchsorted(ends, before + text_bytes, "right")) - at))
            yield batch.slice(at, n)
            at += n


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of the splitmix generator, over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
