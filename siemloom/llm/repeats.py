"""Removal of word passages that occur earlier, by prefix-partitioned suffix trees; `suffix_array` shares its frame.

A window is `window` consecutive words of one document. A window is repeated if its word sequence also starts earlier (smaller id, or same document and
earlier start); every word in a repeated window is removed. Windows are judged on the input.

1. A document whose whole text stands under a smaller id is repeated as a whole; only the first of such copies goes on.
2. Minimisers (least gram hash in each window) tell which windows can be repeated at all: the hashes are counted over all documents, in buckets, each
   hash once for a batch of documents. A window whose minimiser is unique can't have a partner.
3. The other windows' suffixes are compared. Within a batch of documents, of equal windows only the first goes on, so no passage, however common,
   brings more than one suffix a batch to any group. A suffix is a string of letters of window / 5 words, cut after one window, which is known by its hash.
   Groups are prefixes of one letter, and of more letters where, over the whole corpus, a prefix has more than its share of suffixes. A group's suffixes are
   sorted into the order of its tree's leaves; neighbours whose common prefix is as deep as a window are the repeats. Nodes below that depth are not built.
4. All but the first of equal windows are removed, in a pass over the documents.

The documents' texts are shuffled by id once; the passes share that exchange. Words are runs of bytes other than ASCII white space, unchanged.
Null and empty texts have no words. Rows without an id are left out. Rows that share an id
but not the text are told apart by a tag, a digest of the text (0 where an id has one text); none of them starts earlier than another. Equal rows are one
document and lose the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from siemloom.llm.words import U, Words, by_bucket, minimisers, mix, pieces, signed, small_batches, window_minima

LETTERS = 5
#: Bins of the counts of prefixes, and the share of all suffixes above which a prefix is made longer.
BINS, SHARE = 4096, 1 / 1024
#: Bytes of text for each group of a shuffle.
GROUP_BYTES = 4 << 20


def _prefixes(words: Words, window: int, at: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Letters of the suffixes at these places, and the hash of the prefix of each depth."""
    step = window // LETTERS
    first, last = words.grams(step), words.grams(window - step * (LETTERS - 1))
    letters = [first[at + d * step] for d in range(LETTERS - 1)] + [last[at + (LETTERS - 1) * step]]
    hashes, so_far = [], np.zeros(len(at), U)
    for letter in letters:
        so_far = mix(so_far * U(3) + letter)
        hashes.append(so_far)
    return letters, hashes


def _groups(docs: DataFrame) -> int:
    """Groups for the shuffles: by the size of the texts, and no fewer than the session's partitions."""
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    return int(max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // GROUP_BYTES + 1))


def _counts(docs: DataFrame, window: int) -> np.ndarray:
    """Suffixes of the corpus by depth and bin of the prefix: LETTERS x BINS numbers, whatever the corpus' size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((LETTERS, BINS), np.int64)
        for batch in batches:
            for _, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                _, hashes = _prefixes(words, window, np.flatnonzero(words.left >= window))
                for depth, h in enumerate(hashes):
                    total[depth] += np.bincount((h >> U(52)).astype(np.int64), minlength=BINS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["slot", "n"])

    out = np.zeros(LETTERS * BINS, np.int64)
    for slot, n in docs.select("text").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n")).collect():
        out[slot] = n
    return out.reshape(LETTERS, BINS)


_KIND = {"bucket": pa.int64(), "keys": pa.binary(), "docs": pa.binary(), "starts": pa.binary(), "tags": pa.binary(), "known": pa.int32()}
_ENTRIES = "bucket long, keys binary, docs binary, starts binary, tags binary, known int"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_KIND)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _KIND.values(), strict=True)], list(_KIND))


def _joined(rows: pd.DataFrame, column: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(rows[column]), dtype)


def _repeated_hashes(texts: DataFrame, window: int, gram: int, groups: int) -> DataFrame:
    """doc_id and hash of every minimiser that stands at two places or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, docs = batch.column("doc_id").to_numpy(), [np.zeros(0, U)], [np.zeros(0, np.int64)]
            for first, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                at = minimisers(words, gram, window)
                keys.append(words.grams(gram)[at])
                docs.append(ids[first + words.doc[at]])
            key, doc = np.concatenate(keys), np.concatenate(docs)
            order = np.lexsort((doc, key))
            key, doc = key[order], doc[order]
            new = np.r_[True, key[1:] != key[:-1]][:len(key)]
            number = np.cumsum(new) - 1
            often = np.bincount(number, minlength=1)[number] > 1 if len(key) else np.zeros(0, bool)
            alike = np.r_[False, ~new[1:] & (doc[1:] == doc[:-1])][:len(key)]
            # A hash goes once a batch. Where it stands twice in it, its documents are known, and only the hash (marked as often) is compared.
            rows = [(b, k, d, b"", o, 0) for b, k, d, o in by_bucket((key % U(groups)).astype(np.int64)[new], key[new], doc[new], often[new])]
            known = often & ~alike
            yield _batch(rows + [(b, k, d, b"", b"", 1) for b, k, d in by_bucket(doc[known] % groups, key[known], doc[known])])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        some, rest = rows[rows.known == 0], rows[rows.known == 1]
        key, doc, often = _joined(some, "keys", U), _joined(some, "docs", np.int64), _joined(some, "tags", bool)
        order = np.argsort(key, kind="stable")
        key, doc, often = key[order], doc[order], often[order]
        same = key[1:] == key[:-1]
        twice = (np.r_[same, False] | np.r_[False, same])[:len(key)] & ~often
        return pd.DataFrame({"doc_id": np.r_[doc[twice], _joined(rest, "docs", np.int64)],
                             "hash": np.r_[signed(key[twice]), _joined(rest, "keys", np.int64)]})

    return texts.mapInArrow(run, _ENTRIES).groupBy("bucket").applyInPandas(meet, "doc_id long, hash long")


class Route:
    """How suffix trees group the candidate windows: keys (rows of 32-bit letters, equal for equal windows) and bucket."""

    def __init__(self, window: int, groups: int, heavy: np.ndarray) -> None:
        self.window, self.groups, self.heavy = window, groups, heavy

    def __call__(self, words: Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        whole = words.grams(self.window)[at]
        letters, hashes = _prefixes(words, self.window, at)
        prefix, left = hashes[-1].copy(), np.ones(len(at), bool)
        for depth, h in enumerate(hashes[:-1]):  # the shortest prefix that isn't heavy
            fits = left & ~self.heavy[depth][(h >> U(52)).astype(np.int64)]
            prefix[fits] = h[fits]
            left &= ~fits
        key = np.stack([*((x >> U(32)).astype(np.uint32) for x in letters[:-1]), (whole >> U(32)).astype(np.uint32), whole.astype(np.uint32)], 1)
        return key, (prefix % U(self.groups)).astype(np.int64)


def _compare(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes in the order of their letters, equal ones by place; which of them have an earlier place among their equals; which are the place before again."""
    order = np.lexsort((start, tag, doc, *key.T[::-1]))
    kept, doc, tag, start = key[order], doc[order], tag[order], start[order]
    depth = np.cumprod(kept[1:] == kept[:-1], axis=1, dtype=np.int8).sum(1)  # longest common prefix of neighbours, in letters
    alike = np.r_[False, depth == key.shape[1]][:len(order)]
    if not len(order):
        return order, alike, alike
    at = np.arange(len(order))
    leader = np.maximum.accumulate(np.where(alike, 0, at))
    own = alike & np.r_[False, (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1])]
    first = np.maximum.accumulate(np.where(own, 0, at))
    again = (doc > doc[leader]) | (start > start[first])
    return order, again, own & np.r_[False, start[1:] == start[:-1]]


def digest(md5: Column) -> Column:
    """60 bits of a hexadecimal digest."""
    return F.conv(F.substring(md5, 1, 15), 16, 10).cast("long")


def candidate_texts(docs: DataFrame, window: int, gram: int, groups: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents (all columns), dealt by id, with their tag; those with a minimiser that stands twice, with its hashes; doc_id and tag of whole copies."""
    sums = docs.where("text IS NOT NULL").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("sum"))
    firsts = sums.groupBy("sum").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("sum", "first")
    copies = sums.join(firsts, "sum").where("doc_id > first").select("doc_id", digest(F.hex("sum")).alias("copied"))
    several = docs.where("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    several = several.where("low < high").select("doc_id", F.lit(True).alias("several"))
    tag = F.when(F.col("several") & F.col("text").isNotNull(), digest(F.md5(F.col("text").cast("binary")))).otherwise(0)
    texts = docs.repartition("doc_id").join(several.hint("shuffle_hash"), "doc_id", "left").withColumn("tag", tag).drop("several")
    # An id alone is the key of these joins, so that the texts stay where they are.
    gone = copies.join(several.hint("shuffle_hash"), "doc_id", "left").select("doc_id", F.when(F.col("several"), F.col("copied")).otherwise(0).alias("tag"))
    other = gone.select(F.col("doc_id").alias("id"), F.col("tag").alias("copied")).hint("shuffle_hash")
    alone = texts.select("doc_id", "tag", "text").join(other, (F.col("doc_id") == F.col("id")) & (F.col("tag") - F.col("copied") == 0), "left_anti")
    hashes = _repeated_hashes(alone, window, gram, groups).groupBy("doc_id").agg(F.collect_set("hash").alias("hashes"))
    return texts, alone.join(hashes.hint("shuffle_hash"), "doc_id").select("doc_id", "tag", "text", "hashes"), gone


def with_ids(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession, 1500)
    return docs.where(F.col("doc_id").isNotNull()).withColumn("doc_id", F.col("doc_id").cast("long"))


def repeated_windows(docs: DataFrame, window: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """The documents (all columns), dealt by id, with their tag, and doc_id, tag and start of every repeated window; start -1: the whole document."""
    docs = with_ids(docs)
    groups = _groups(docs)
    counts = _counts(docs, window)
    heavy = counts > max(64, counts[0].sum() * SHARE)
    texts, candidates, gone = candidate_texts(docs, window, gram, groups)
    route, width = Route(window, groups, heavy), LETTERS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
            found = [(np.zeros((0, width), np.uint32), *(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32)))]
            wanted = np.unique(batch.column("hashes").flatten().to_numpy().view(U))
            for first, _, data, offsets in pieces(batch.column("text")):
                words = Words(data, offsets)
                minima = window_minima(words, gram, window)
                at = np.flatnonzero(words.left >= window)
                if not len(at):
                    continue
                at = at[wanted[np.minimum(np.searchsorted(wanted, minima[at]), len(wanted) - 1)] == minima[at]]
                row = first + words.doc[at]
                found.append((*route(words, at), ids[row], tags[row], (at - words.first[words.doc[at]]).astype(np.int32)))
            key, bucket, doc, tag, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order, again, same = _compare(key, doc, tag, start)
            rest, known = np.sort(order[~again & ~same]), np.sort(order[again & ~same])
            rows = [(b, *columns, 0) for b, *columns in by_bucket(bucket[rest], key[rest], doc[rest], start[rest], tag[rest])]
            yield _batch(rows + [(b, b"", *columns, 1) for b, *columns in by_bucket(doc[known] % groups, doc[known], start[known], tag[known])])

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        some, rest = rows[rows.known == 0], rows[rows.known == 1]
        key = _joined(some, "keys", np.uint32).reshape(-1, width)
        places = [(c, t, _joined(some, f"{c}s", t)) for c, t in (("doc", np.int64), ("tag", np.int64), ("start", np.int32))]
        order, again, _ = _compare(key, *(x for *_, x in places))
        later = order[again]
        return pd.DataFrame({"doc_id" if c == "doc" else c: np.r_[x[later], _joined(rest, f"{c}s", t)] for c, t, x in places})

    found = candidates.mapInArrow(run, _ENTRIES).groupBy("bucket").applyInPandas(meet, "doc_id long, tag long, start int")
    return texts, found.unionByName(gone.withColumn("start", F.lit(-1)))


Repeated = Callable[[DataFrame, int, int], tuple[DataFrame, DataFrame]]


def remove_repeats(docs: DataFrame, window: int, gram: int, repeated: Repeated, keep: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, spans (first word and word after the last of each removed run), kept (the words left, joined by a space).

    keep: rest has the other columns of the documents, as a struct, and the kept text of a document that loses nothing is its own.
    """
    other = [c for c in docs.columns if c not in ("doc_id", "text")] if keep else []
    docs = docs.select("doc_id", "text", (F.struct(*other) if other else F.struct(F.lit(0).alias("none"))).alias("rest"))
    rest = docs.schema["rest"]
    texts, found = repeated(docs if keep else docs.select("doc_id", "text"), window, gram)
    tagged = F.col("tag") != 0
    starts = found.groupBy("doc_id").agg(
        F.collect_list(F.when(~tagged, F.col("start"))).alias("starts"), F.collect_list(F.when(tagged, F.struct("tag", "start"))).alias("own"))
    rows = texts.join(starts.hint("shuffle_hash"), "doc_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, lists, own, tags = (batch.column(c) for c in ("text", "starts", "own", "tag"))
            n_words, n_removed, spans, kept = [], [], [], []
            for i in range(batch.num_rows):
                words = (text[i].as_py() or "").encode().split()
                n_words.append(len(words))
                gone, value = np.zeros(len(words) + 1, bool), lists[i].values
                if value is not None:
                    at, tag = value.to_numpy(), tags[i].as_py()
                    if tag:
                        pairs = own[i].values
                        at = pairs.field("start").to_numpy()[pairs.field("tag").to_numpy() == tag]
                    if (at < 0).any():
                        at = np.arange(0, max(0, len(words) - window + 1))
                    at = at[at + window <= len(words)]
                    gone[:-1] = np.cumsum(np.bincount(at, minlength=len(words) + 1) - np.bincount(at + window, minlength=len(words) + 1))[:-1] > 0
                if gone.any():
                    edges = np.flatnonzero(np.diff(np.r_[False, gone].astype(np.int8)))
                    spans.append([{"start": int(a), "stop": int(b)} for a, b in edges.reshape(-1, 2)])
                    words = [words[j] for j in np.flatnonzero(~gone[:-1])]
                else:
                    spans.append([])
                n_removed.append(n_words[-1] - len(words))
                kept.append(text[i].as_py() if keep and not n_removed[-1] else b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([
                *([batch.column("rest")] if keep else []), batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.string())],
                [*(["rest"] if keep else []), "doc_id", "n_words", "n_removed", "spans", "kept"])

    schema = StructType.fromDDL("doc_id long, n_words long, n_removed long, spans array<struct<start:long,stop:long>>, kept string")
    return rows.mapInArrow(run, StructType([*([rest] if keep else []), *schema.fields]))


def suffix_trees(docs: DataFrame, window: int = 20, keep: bool = False) -> DataFrame:
    return remove_repeats(docs, window, max(1, window * 3 // 5), repeated_windows, keep)
