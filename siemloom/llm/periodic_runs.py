"""Stretches of words that repeat with a period, found by string synchronising sets.

A run is a maximal stretch of words with smallest period q (words q apart are equal) and a length of at least LEAST and FOLD * q. Periods below 4 are
read off directly. Longer ones are found at dyadic scales t = 4, 8, 16 ..., each for the periods from t to 2t - 1:

- a place is synchronising if, of the hashes of the t words from each of the t + 1 places that start there, the least stands first or last. That
  depends on the 2t words from the place alone, so equal contexts are synchronising together, and any t places in a row hold one,
- places inside a run of period t / 4 or less have no hash at this scale. Without them a region of small period would be all synchronising; its runs are
  known already, as all smaller scales were searched before, and no run of a period from t on lies in such a region,
- a run of period q >= t and length 4q holds a synchronising place in its first t words whose context of 2t words stands again q words on, and, q being
  the smallest period, not before. So neighbouring places of equal contexts propose the period,
- a proposal is compared word by word to both sides. Hashes only propose; a run is decided on the words.

Words are runs of bytes other than ASCII white space. Documents are searched many at a time, with a word of its own behind each. Null and empty
texts have no words and no runs; rows without an id and repeated rows are rows like others; an empty table gives an empty one.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siemloom.llm.words import PIECE_BYTES, U, _sliding, mix, small_batches

LEAST, FOLD = 6, 4
#: Periods below it are compared at every place.
DIRECT = 4
_NONE = U((1 << 64) - 1)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _doubled(h: np.ndarray, half: int) -> np.ndarray:
    """Hash of twice as many words from each place; of no meaning in the last places."""
    out = h * U(0x9E3779B97F4A7C15)
    out[:len(h) - half] += h[half:]
    return mix(out)


def _stretch(w: np.ndarray, at: int, period: int) -> tuple[int, int]:
    """First place and place after the last of the longest stretch around `at` in which words `period` apart are equal."""
    right, step = at, 64
    while True:
        far = w[right + period:right + period + step]
        differ = np.flatnonzero(w[right:right + len(far)] != far)
        right += int(differ[0]) if len(differ) else len(far)
        if len(differ) or len(far) < step:
            break
        step *= 2
    left, step = at, 64
    while left:
        low = max(0, left - step)
        differ = np.flatnonzero(w[low:left] != w[low + period:left + period])
        if len(differ):
            left = low + int(differ[-1]) + 1
            break
        left, step = low, step * 2
    return left, right + period


def _has_smaller(w: np.ndarray, start: int, period: int) -> bool:
    """Whether the stretch's smallest period divides this one properly; as it is 4 periods long, no other can be smaller."""
    root, rest, r = w[start:start + period], period, 2
    while rest > 1:
        if rest % r == 0:
            q = period // r
            if np.array_equal(root[q:], root[:-q]):
                return True
            while rest % r == 0:
                rest //= r
        r = r + 1 if r * r <= rest else rest
    return False


def _direct(w: np.ndarray) -> list[tuple[int, int, int]]:
    found = []
    for q in range(1, DIRECT):
        if len(w) <= q:
            break
        edge = np.flatnonzero(np.diff(np.r_[False, w[:-q] == w[q:], False].astype(np.int8)))
        for a, b in edge.reshape(-1, 2)[np.diff(edge)[::2] + q >= max(LEAST, FOLD * q)]:
            if not _has_smaller(w, a, q):
                found.append((int(a), int(b - a + q), q))
    return found


def _proposals(h: np.ndarray, context: np.ndarray, scale: int, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Synchronising places whose context stands again at a distance of this scale, and the distances."""
    g = np.where(hidden, _NONE, h)
    least = _sliding(g, scale + 1, np.minimum)[:len(g) - 2 * scale + 1]
    first, last = g[:len(least)], g[scale:scale + len(least)]
    at = np.flatnonzero(((least == first) | (least == last)) & (least != _NONE))
    order = np.argsort(context[at], kind="stable")
    at = at[order]
    far = np.diff(at)
    pair = np.flatnonzero((context[at[1:]] == context[at[:-1]]) & (far >= scale) & (far < 2 * scale))
    return at[pair], far[pair]


def find_runs(w: np.ndarray, counts: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) by start, then period. w: numbers of words; documents of `counts` words, each followed by a number that
    stands nowhere else."""
    found = _direct(w)
    h, place, scale = mix(w.astype(U) + U(0x51ED270B)), np.arange(len(w)), 1
    doc = np.repeat(np.arange(len(counts)), counts + 1)
    while True:
        h, scale = _doubled(h, scale), 2 * scale
        if scale < DIRECT:
            continue
        long = counts >= FOLD * scale
        if not long.any():
            return sorted(found)
        keep = long[doc[place]]
        if not keep.all():  # hashes that reach into the next text differ by its word of its own before and after
            h, place = h[keep], place[keep]
        cover = np.zeros(len(w) + 1, np.int64)
        for a, length, q in found:
            if FOLD * q <= scale <= length:
                cover[a] += 1
                cover[a + length - scale + 1] -= 1
        hidden = (np.cumsum(cover) > 0)[place]
        at, far = _proposals(h, _doubled(h, scale), scale, hidden)
        order = np.lexsort((at, far))
        period, done = 0, 0
        for a, q in zip(place[at[order]].tolist(), far[order].tolist(), strict=True):
            if q == period and a < done:
                continue
            left, right = _stretch(w, a, q)
            period, done = q, right - q
            if right - left >= max(LEAST, FOLD * q) and not _has_smaller(w, left, q):
                found.append((left, right - left, q))


def _pieces(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    piece, size = [], 0
    for text in texts:
        data = (text.as_py() or "").encode()
        if piece and size + len(data) > PIECE_BYTES:
            yield piece
            piece, size = [], 0
        piece.append(data.split())
        size += len(data)
    if piece:
        yield piece


def _of_piece(piece: list[list[bytes]]) -> tuple[list, list[list[tuple[int, int, int]]], list[str]]:
    """Word counts, runs and kept texts of the documents."""
    number: defaultdict = defaultdict()
    number.default_factory = number.__len__
    counts = np.array([len(words) for words in piece], np.int64)
    starts = np.cumsum(counts + 1) - counts - 1
    w = np.empty(int(counts.sum()) + len(counts), np.int64)
    for k, (words, at) in enumerate(zip(piece, starts, strict=True)):
        w[at:at + len(words)] = [number[x] for x in words]
        w[at + len(words)] = -1 - k
    runs: list[list[tuple[int, int, int]]] = [[] for _ in piece]
    for start, length, period in find_runs(w, counts):
        k = int(np.searchsorted(starts, start, "right")) - 1
        runs[k].append((start - int(starts[k]), length, period))
    kept = []
    for words, own in zip(piece, runs, strict=True):
        if own:
            drop = np.zeros(len(words) + 1, np.int64)
            for start, length, period in own:
                drop[start + period] += 1
                drop[start + length] -= 1
            words = [words[j] for j in np.flatnonzero(np.cumsum(drop[:-1]) == 0)]
        kept.append(b" ".join(words).decode())
    return counts.tolist(), runs, kept


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period), kept (words that no run holds after its first period, joined by a space)."""
    small_batches(docs.sparkSession, 1500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, kept = [], [], []
            for piece in _pieces(batch.column("text")):
                for out, more in zip((n_words, found, kept), _of_piece(piece), strict=True):
                    out += more
            rows = [dict(zip(("start", "length", "period"), r, strict=True)) for own in found for r in own]
            ends = np.cumsum([0, *(len(own) for own in found)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rows, _RUN))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n_words, pa.int64()), lists, pa.array(kept, pa.string())], ["doc_id", "n_words", "runs", "kept"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, kept string")


def digests(out: DataFrame) -> DataFrame:
    """n_runs, the run of greatest exponent (ties: smallest start, then period), and digests of the runs and of the kept words."""

    def higher(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    best = F.reduce("runs", F.lit(None).cast("struct<start:long,length:long,period:long>"), higher)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n")))
    return out.withColumn("best", best).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("kept").cast("binary"), 256).alias("collapsed_sha256"))


def with_planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents, chosen by a checksum of the id, the words from some place on repeat with a period."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.col("text").isNotNull() & F.coalesce(h % 10 == 0, F.lit(False))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    docs = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), F.when(chosen, words).alias("words")).withColumn("n", F.size("words").cast("long"))
    a = F.col("g") % F.greatest("n", F.lit(1))
    docs = docs.select("doc_id", "text", "g", "words", "n", a.alias("a")).withColumn("p", F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)) + 1)
    root = F.slice("words", (F.col("a") + 1).cast("int"), F.col("p").cast("int"))
    tail = F.flatten(F.array_repeat(root, F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    whole = F.concat(F.slice("words", F.lit(1), F.col("a").cast("int")), F.slice(tail, F.lit(1), (F.col("n") - F.col("a")).cast("int")))
    return docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(whole, " ")).otherwise(F.col("text")).alias("text"))
