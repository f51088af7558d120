"""Byte-level BPE: encoding by longest matches with backtracking, and decoding.

A vocabulary file has a line for each token: its bytes in base 64 and its rank. Every text is split by a pattern; each match becomes
tokens by itself. Bytes are mapped to the 256 Latin-1 characters, over which an Aho-Corasick automaton finds the tokens at every
place. From the longest token on, a token is taken if merging the bytes of its predecessor and its own gives just those two tokens
again (memoised); else the next shorter one is tried, and where none fits the last token is given up. Places that failed once are
never tried again, so the work is linear in the match's length, and the result is that of the exact merges.

Empty and null texts give no tokens. Extra columns are ignored, rows are kept as they are, repeated ones too.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.words import small_batches

#: Matches that a worker remembers (up to about 250 bytes each), and twice as many token pairs; then it starts anew.
REMEMBERED = 400_000

#: The pattern for texts in which re's classes mean the same as the Unicode ones of the general pattern.
_COMMON = r"""'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"""
_GENERAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters for which that holds: no separators of 0x1c to 0x1f, no superscripts and fractions, nothing after Latin letters.
_PLAIN = re.compile("[\\x00-\\x1b\\x20-\\x7e\\xa0-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u024f]*")


class Vocabulary:
    def __init__(self, ranks: bytes, pattern: str) -> None:
        self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, ranks.splitlines()))}
        self.token = {i: t for t, i in self.rank.items()}
        self.split = regex.compile(pattern).findall
        self.split_plain = re.compile(_COMMON).findall if pattern == _GENERAL else self.split
        self.pairs: dict[tuple[int, int], bool] = {}
        self.known: dict[str, tuple[int, ...]] = {}
        #: Tokens by their Latin-1 text; a token that merging never makes is no match.
        self.by_text = {t.decode("latin-1"): i for t, i in self.rank.items() if len(t) == 1 or self.merged(t) == [i]}
        self.widest = max(map(len, self.by_text))
        self.find = ahocorasick.Automaton()
        for text, i in self.by_text.items():
            self.find.add_word(text, i)
        self.find.make_automaton()
        self.width = {i: len(t) for i, t in self.token.items()}
        self.shorter = {i: self._shorter(t.decode("latin-1")) for i, t in self.token.items()}

    def merged(self, piece: bytes) -> list[int]:
        """The merges themselves, lowest rank first; for short pieces only."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = min((self.rank.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if best == 1 << 60:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def fits(self, before: int, after: int) -> bool:
        pair = before, after
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= 2 * REMEMBERED:
                self.pairs.clear()
            known = self.pairs[pair] = self.merged(self.token[before] + self.token[after]) == [before, after]
        return known

    def _shorter(self, word: str) -> int:
        """The longest token that is a true prefix of this one, or -1."""
        for n in range(len(word) - 1, 0, -1):
            if (known := self.by_text.get(word[:n])) is not None:
                return known
        return -1

    def longest(self, text: str, at: int) -> int:
        """The longest token at a place of a text of Latin-1 characters, or -1."""
        part = text[at:at + self.widest]
        n, get = self.find.longest_prefix(part), self.by_text.get
        while n:
            token = get(part[:n])
            if token is not None:
                return token
            n -= 1
        return -1

    def encode_match(self, match: str) -> tuple[int, ...]:
        piece = match.encode()
        whole = self.rank.get(piece)
        if whole is not None:
            return (whole,)
        n, width, shorter, pairs = len(piece), self.width, self.shorter, self.pairs
        text = piece.decode("latin-1")
        longest = self.longest
        taken: list[int] = []
        failed, at, last, token = bytearray(n), 0, -1, longest(text, 0)
        while True:
            while token >= 0:
                end = at + width[token]
                if end == n or not failed[end]:
                    if last < 0:
                        break
                    fits = pairs.get((last, token))
                    if self.fits(last, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                taken.append(token)
                if end == n:
                    return tuple(taken)
                at, last, token = end, token, longest(text, end)
            elif taken:
                failed[at] = 1
                token = taken.pop()
                at -= width[token]
                last = taken[-1] if taken else -1
                token = shorter[token]
            else:
                raise ValueError("the vocabulary lacks a byte of this text")

    def _remember(self, match: str) -> tuple[int, ...]:
        ids = self.encode_match(match)
        if len(match) <= 64:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[match] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        matches = (self.split_plain if _PLAIN.fullmatch(text) else self.split)(text)
        known, add = self.known.get, self._remember
        return list(chain.from_iterable([known(m) or add(m) for m in matches]))

    def decode(self, ids) -> bytes:
        return b"".join([self.token[i] for i in ids])


_OPEN: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    key = hash(ranks), pattern
    if key not in _OPEN:
        _OPEN.clear()
        _OPEN[key] = Vocabulary(ranks, pattern)
    return _OPEN[key]


def encode_decode(docs: DataFrame, ranks: bytes, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Id, ids array<int> and decoded binary (the bytes that the ids stand for) of every row.

    ranks: the content of a vocabulary file, about a megabyte, sent with the tasks.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value, pattern)
        for batch in batches:
            ids, cuts, decoded = [], [0], []
            for text in batch.column("text"):
                found = vocabulary.encode(text.as_py())
                decoded.append(vocabulary.decode(found))
                ids.append(np.array(found, np.int32))
                cuts.append(cuts[-1] + len(found))
            flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), flat), pa.array(decoded, pa.binary())],
                ["doc_id", "ids", "decoded"])

    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, further columns, and SHA-256 of the decimal ids joined by a space and of the decoded bytes."""
    return encoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), *more,
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
