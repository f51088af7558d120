"""Words, hashes and minimisers of whole Arrow batches of texts, as numpy arrays.

All functions work on the UTF-8 bytes of many texts at once: `pieces` cuts a batch into runs of texts of bounded size, `Words` finds
the words of such a run and hashes them. A hash is 64 bits; no text is cut and no Python string is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

U = np.uint64
#: Bytes of text that one numpy pass takes; a longer text is taken alone.
PIECE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD1342543DE82EF95
_MASK = (1 << 64) - 1
_TABLE = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_POWERS: list[np.ndarray] = []

#: Space and the five other ASCII white-space bytes.
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
#: All ASCII but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[:128] = [not chr(c).isalnum() for c in range(128)]
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Bound the Arrow batches of this session by rows and, where Spark can, by bytes: a batch of long texts must fit a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits."""
    x = x ^ (x >> U(31))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(29)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets into them; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts: first row, row after the last, their bytes, their offsets."""
    data, offsets = text_bytes(column)
    first, rows = 0, len(offsets) - 1
    while first < rows:
        after = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        after = min(after, rows)
        yield first, after, data[offsets[first]:offsets[after]], offsets[first:after + 1] - offsets[first]
        first = after


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2^64 and their inverses."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, PIECE_BYTES + 1024)
        _POWERS[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size - 1, b & _MASK, U))]) for b in (_BASE, pow(_BASE, -1, 1 << 64))]
        if size > 4 * PIECE_BYTES:
            kept = list(_POWERS)
            _POWERS.clear()
            return kept[0], kept[1]
    return _POWERS[0], _POWERS[1]


class Words:
    """The words of a run of texts.

    starts, ends: byte places; first: n + 1 word offsets by text; hashes: 64 bits a word; left: words from each word to its text's end,
    itself included.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = WHITE, lower: bool = False) -> None:
        if lower:
            data = LOWER[data]
        self.data, self.offsets = data, offsets
        inside = ~breaks[data]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[:-1] < offsets[1:]
        at, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[at], end[last] = inside[at], inside[last]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)
        self.n = len(self.starts)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.left = self.first[1:][self.doc] - np.arange(self.n)
        self._hashes: np.ndarray | None = None

    @property
    def hashes(self) -> np.ndarray:
        if self._hashes is None:
            up, down = _powers(len(self.data) + 1)
            total = np.zeros(len(self.data) + 1, U)
            np.cumsum(_TABLE[self.data] * up[:len(self.data)], out=total[1:])
            self._hashes = mix((total[self.ends] - total[self.starts]) * down[self.starts])
        return self._hashes

    def grams(self, n: int) -> np.ndarray:
        """Hash of the n words from each word; of no meaning where left < n."""
        return grams(self.hashes, n)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    out, factor = hashes.copy(), 1
    for j in range(1, min(n, len(hashes))):
        factor = factor * _STEP & _MASK
        out[:-j] += hashes[j:] * U(factor)
    return mix(out)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best over values[i : i + width] for each i; what lies past the end doesn't count."""
    out, have = values.copy(), 1
    while have < width:
        step = min(have, width - have)
        if step < len(out):
            out[:-step] = best(out[:-step], out[step:])
        have += step
    return out


def window_minima(words: Words, gram: int, window: int) -> np.ndarray:
    """For each word the least gram hash in the window of words that starts there; of no meaning where left < window."""
    return _sliding(words.grams(gram), window - gram + 1, np.minimum)


def minimisers(words: Words, gram: int, window: int, minima: np.ndarray | None = None) -> np.ndarray:
    """Places of the grams that are least in some window of words within a text. Equal grams in a window all count."""
    minima = window_minima(words, gram, window) if minima is None else minima
    width = window - gram + 1
    allowed = np.where(words.left >= window, minima, U(0))
    reached = _sliding(allowed[::-1], width, np.maximum)[::-1]  # the largest minimum of the windows that hold a gram
    return np.flatnonzero((reached == words.grams(gram)) & (words.left >= gram) & (reached > 0))


def packed(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def by_bucket(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple]:
    """Each bucket with its share of the columns as bytes; none where there are no rows."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    kept = bucket[order]
    cuts = np.flatnonzero(np.r_[True, kept[1:] != kept[:-1]])
    columns = [c[order] for c in columns]
    for a, b in zip(cuts, [*cuts[1:], len(kept)], strict=True):
        yield int(kept[a]), *(packed(c[a:b]) for c in columns)
