"""Self-join of documents by the Jaccard similarity of their word n-grams, with adaptive multi-match prefixes.

A document's shingles are put in one order for all documents, rare ones first (by counts of all shingles of the corpus in a fixed number of cells).
Two documents of n and m shingles that are similar enough share ceil(t n) and ceil(t m) of them, so for any l their first n - ceil(t n) + l and
m - ceil(t m) + l shingles share at least l. Each document chooses the l, of up to MOST, for which the estimated cost of its candidates is least: the
documents that its prefix meets, and the part of them that can share l of it. A pair must share the smaller l of the two in prefixes of
that l before it is verified by the whole sets.

1. Documents of equal sets form classes, known by a 64-bit sum of the set; a class takes part once.
2. Prefix shingles meet in buckets; those that only one class has are dropped. Classes left are dealt into blocks of about BLOCK by the
   shingle they share with the most others, so that near copies stand together.
3. A class visits each block that holds enough of its prefix shingles; the pairs within the block are counted by shared prefix shingles, then
   verified. A visit brings a set once, not once for each pair, and no pairs are ever rows: a visit returns a forest of the links it found.
4. Components of the links give each document the least id reachable.

Words are runs of bytes other than ASCII white space, A-Z in lower case. A text of fewer words than a shingle has is one shingle; without words
the set is empty and linked with nothing. Null texts are empty. Rows without an id are left out; repeated rows are one class and each returned.
Rows that share an id but not the text are documents of their own; the id alone links nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siemloom.llm.components import components, cut
from siemloom.llm.words import U, Words, by_bucket, mix, pieces, signed, small_batches

CELLS_BITS, SEGMENTS = 20, 32
MOST, VERIFY = 4, 20
BLOCK, VISITORS = 256, 256
GROUP_BYTES = 4 << 20


class Sets:
    """Sorted distinct shingles of a run of texts: doc, value (by text), first (n + 1 offsets), counts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, n: int) -> None:
        words = Words(data, offsets, lower=True)
        value, fits = words.grams(n), words.left >= n
        at = np.flatnonzero(fits)
        parts, docs = [value[at]], [words.doc[at]]
        for k in range(1, n):  # shorter texts are one shingle
            at = np.flatnonzero((words.counts[words.doc] == k) & (words.left == k))
            parts.append(mix(words.grams(k)[at] + U(k)))
            docs.append(words.doc[at])
        value, doc = np.concatenate(parts), np.concatenate(docs)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])][:len(value)]
        self.value, self.doc = value[new], doc[new]
        self.first = np.searchsorted(self.doc, np.arange(len(words.counts) + 1))
        self.counts = np.diff(self.first)

    def sums(self) -> np.ndarray:
        total = np.r_[np.zeros(1, U), np.cumsum(mix(self.value ^ U(0x5851F42D4C957F2D)))]
        return mix(total[self.first[1:]] - total[self.first[:-1]] + self.counts.astype(U))


def _rows(table: list[tuple], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*table, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def _survey(docs: DataFrame, n: int, tasks: int) -> tuple[DataFrame, np.ndarray]:
    """doc_id, n_shingles and class of every document; counts of all shingles by cell."""
    kinds = {"doc_id": pa.int64(), "n": pa.int64(), "class": pa.int64(), "segment": pa.int32(), "cells": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(1 << CELLS_BITS, np.uint32)
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for first, after, data, offsets in pieces(batch.column("text")):
                sets = Sets(data, offsets, n)
                cells += np.bincount((sets.value >> U(64 - CELLS_BITS)).astype(np.int64), minlength=len(cells)).astype(np.uint32)
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids[first:after]), pa.array(sets.counts.astype(np.int64)), pa.array(signed(sets.sums())),
                    pa.nulls(after - first, pa.int32()), pa.nulls(after - first, pa.binary())], list(kinds))
        parts = cells.reshape(SEGMENTS, -1)
        yield _rows([(None, None, None, k, zlib.compress(p.tobytes(), 1)) for k, p in enumerate(parts) if p.any()], kinds)

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((1 << CELLS_BITS) // SEGMENTS, np.uint64)
        for c in rows.cells:
            c = zlib.decompress(c)
            total += np.frombuffer(c, np.uint32) if len(c) == 4 * len(total) else np.frombuffer(c, np.uint64)
        return pd.DataFrame({"segment": [rows.segment.iloc[0]], "cells": [zlib.compress(total.tobytes(), 1)]})

    surveyed = cut(docs.mapInArrow(run, "doc_id long, n long, class long, segment int, cells binary"), tasks)
    cells = surveyed.where("segment IS NOT NULL").select("segment", "cells", F.expr("uuid()").alias("u"))
    cells = cells.withColumn("salt", F.pmod(F.xxhash64("cells"), F.lit(16)))
    partly = cells.groupBy("segment", "salt").applyInPandas(add, "segment int, cells binary")
    whole = np.zeros((SEGMENTS, (1 << CELLS_BITS) // SEGMENTS), np.uint64)
    for row in partly.groupBy("segment").applyInPandas(add, "segment int, cells binary").toLocalIterator():
        whole[row.segment] = np.frombuffer(zlib.decompress(row.cells), np.uint64)
    return surveyed.where("segment IS NULL").select("doc_id", "n", "class"), np.minimum(whole, (1 << 32) - 1).astype(np.uint32).ravel()


def prefixes(sets: Sets, cells: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places (in sets) of the chosen prefixes' shingles, their level (the least l whose prefix has them), and l by text."""
    estimate = cells[(sets.value >> U(64 - CELLS_BITS)).astype(np.int64)].astype(np.int64)
    order = np.lexsort((sets.value, estimate, sets.doc))
    size = sets.counts[sets.doc]
    rank = np.arange(len(order)) - sets.first[sets.doc]
    need = -(-percent * size // 100)
    level = np.maximum(1, rank - (size - need) + 1)
    near = level <= np.minimum(MOST, need)
    place, level, doc = order[near], level[near], sets.doc[near]
    # what of a cell's count is more than its share of all shingles
    usual = int(cells.mean()) if len(cells) else 0
    meets = np.maximum(1, estimate[place] - usual).astype(np.float64)
    cost = np.full((MOST, len(sets.counts)), np.inf)
    so_far = np.zeros(len(sets.counts))
    for l in range(1, MOST + 1):
        now = level == l
        so_far = so_far + np.bincount(doc[now], meets[now], len(sets.counts))
        can = -(-percent * sets.counts // 100) >= l
        cost[l - 1] = np.where(can, so_far * (1 + VERIFY / l), np.inf)
    chosen = cost.argmin(0) + 1
    keep = level <= chosen[doc]
    return place[keep], level[keep], chosen


def _meetings(docs: DataFrame, cells, n: int, percent: int, groups: int) -> DataFrame:
    """class, the shingle it shares with the most others (near), size, l and the shingles of its prefix that another class has too, with their levels."""
    kinds = {"bucket": pa.int64(), "values": pa.binary(), "classes": pa.binary(), "marks": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            seen: set[int] = set()
            for _, _, data, offsets in pieces(batch.column("text")):
                sets = Sets(data, offsets, n)
                place, level, chosen = prefixes(sets, cells.value, percent)
                sums, doc = signed(sets.sums()), sets.doc[place]
                fresh = np.array([not (s in seen or seen.add(s)) for s in sums.tolist()], bool)  # a class goes once a batch
                keep = fresh[doc] if len(doc) else np.zeros(0, bool)
                place, level, doc = place[keep], level[keep], doc[keep]
                found.append((sets.value[place], sums[doc], sets.counts[doc] << 16 | chosen[doc] << 8 | level))
            value, own, mark = (np.concatenate(x) for x in zip(*found, strict=True))
            yield _rows(list(by_bucket((value % U(groups)).astype(np.int64), value, own, mark)), kinds)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        value, own, mark = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("values", U), ("classes", np.int64), ("marks", np.int64)))
        size = mark >> 16
        order = np.lexsort((own, size, value))
        value, own, mark, size = value[order], own[order], mark[order], size[order]
        new = np.r_[True, (value[1:] != value[:-1]) | (own[1:] != own[:-1])][:len(value)]
        value, own, mark, size = value[new], own[new], mark[new], size[new]
        # a partner's size differs by the threshold at most, so the next in order of size must be near enough
        near = (value[1:] == value[:-1]) & (100 * size[:-1] >= percent * size[1:])
        keep = np.r_[False, near] | np.r_[near, False] if len(value) else np.zeros(0, bool)
        value = value[keep]
        many = np.searchsorted(value, value, "right") - np.searchsorted(value, value, "left")
        return pd.DataFrame({"class": own[keep], "value": signed(value), "mark": mark[keep], "many": many})

    met = docs.select("text").mapInArrow(run, "bucket long, values binary, classes binary, marks binary").groupBy("bucket").applyInPandas(
        meet, "class long, value long, mark long, many long")
    return met.groupBy("class").agg(
        F.max(F.struct("many", "value"))["value"].alias("near"),
        F.first(F.shiftright("mark", 16)).alias("size"), F.first(F.shiftright("mark", 8).bitwiseAND(255)).alias("l"),
        F.array_sort(F.collect_list(F.struct("value", F.col("mark").bitwiseAND(255).cast("int").alias("level")))).alias("shared"))


def _gather(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Incidence:
    """Which of a block's members have a value."""

    def __init__(self, values: list[np.ndarray]) -> None:
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(values)), [len(v) for v in values])
        self.order = np.argsort(flat, kind="stable")
        self.owner = owner[self.order]
        self.known, self.first, self.count = np.unique(flat[self.order], return_index=True, return_counts=True)

    def meet(self, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Visitor, member, and the places (in the visitors' and the members' flat values) of every common value."""
        flat = np.concatenate(values) if values else np.zeros(0, np.int64)
        visitor = np.repeat(np.arange(len(values)), [len(v) for v in values])
        at = np.minimum(np.searchsorted(self.known, flat), max(0, len(self.known) - 1))
        hit = np.flatnonzero(self.known[at] == flat) if len(self.known) else np.zeros(0, np.int64)
        sizes = self.count[at[hit]] if len(hit) else np.zeros(0, np.int64)
        places = _gather(self.first[at[hit]], sizes) if len(hit) else np.zeros(0, np.int64)
        return np.repeat(visitor[hit], sizes), self.owner[places], np.repeat(hit, sizes), self.order[places]


def links(visitors: pd.DataFrame, members: pd.DataFrame, percent: int, within: bool) -> list[tuple[int, int]]:
    """A forest (pairs of classes) of the links between visitors and members, and among members if within."""
    reps = np.r_[members["class"].to_numpy(np.int64), visitors["class"].to_numpy(np.int64)]
    parent = list(range(len(reps)))

    def top(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    n_members, out = len(members), []
    arrays = lambda frame, c, t: [np.frombuffer(b, t) for b in frame[c]]
    m_set, m_val, m_lev = arrays(members, "set", np.int64), arrays(members, "values", np.int64), arrays(members, "levels", np.uint8)
    m_size, m_l = members["size"].to_numpy(np.int64), members["l"].to_numpy(np.int64)
    sets, prefix = Incidence(m_set), Incidence(m_val)
    flat_levels = np.concatenate(m_lev) if m_lev else np.zeros(0, np.uint8)
    jobs = [(visitors.iloc[a:a + 32], n_members + a, False) for a in range(0, len(visitors), 32)]
    if within:
        jobs += [(members.iloc[a:a + 32], a, True) for a in range(0, n_members, 32)]
    for some, base, own in jobs:
        size, l = some["size"].to_numpy(np.int64), some["l"].to_numpy(np.int64)
        levels = np.concatenate(arrays(some, "levels", np.uint8))
        v, m, a, b = prefix.meet(arrays(some, "values", np.int64))
        least = np.minimum(l[v], m_l[m])
        fits = (levels[a] <= least) & (flat_levels[b] <= least)
        n = np.bincount(v[fits] * n_members + m[fits], minlength=len(some) * n_members).reshape(len(some), n_members)
        open_ = (n >= np.minimum(l[:, None], m_l)) & (n > 0) & (100 * np.minimum(size[:, None], m_size) >= percent * np.maximum(size[:, None], m_size))
        if own:
            open_ &= np.arange(base, base + len(some))[:, None] < np.arange(n_members)
        wanted = np.flatnonzero(open_.any(1))
        if not len(wanted):
            continue
        v, m, _, _ = sets.meet([np.frombuffer(s, np.int64) for s in some["set"].iloc[wanted]])
        both = np.bincount(v * n_members + m, minlength=len(wanted) * n_members).reshape(len(wanted), n_members)
        union = size[wanted][:, None] + m_size - both
        for i, j in zip(*np.nonzero(open_[wanted] & (100 * both >= percent * union)), strict=True):
            x, y = top(base + int(wanted[i])), top(int(j))
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((int(reps[base + wanted[i]]), int(reps[j])))
    return out


def similar(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """doc_id, n_shingles, component_id of every document: links at percent or more."""
    spark = docs.sparkSession
    small_batches(spark, 1500)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    size = docs.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    tasks = int(size // GROUP_BYTES + 1)
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), tasks)
    surveyed, counts = _survey(docs, n, tasks)
    cells = spark.sparkContext.broadcast(counts)
    reps = surveyed.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("rep"))
    active = _meetings(docs, cells, n, percent, groups).join(reps, "class")
    active = cut(active, tasks)
    # blocks: classes by the shingle that they share with the most, dealt by hash where there are many
    many = active.groupBy("near").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    placed = active.join(many, "near").withColumn("block", F.xxhash64("near", F.pmod(F.xxhash64("class"), "parts"))).drop("near", "parts")
    placed = cut(placed, tasks)
    at = placed.select("class", "block", "l", F.explode("shared.value").alias("value"))
    held = at.groupBy("value", F.col("block").alias("other")).agg(F.min("l").alias("other_l"))
    visits = at.join(held, "value").where("block > other").groupBy("class", "other").agg(
        F.count(F.lit(1)).alias("n"), F.min("l").alias("l"), F.min("other_l").alias("other_l")).where("n >= least(l, other_l)").select("class", F.col("other").alias("block"))
    visits = cut(visits, tasks)
    parts = visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / VISITORS).alias("parts"))
    alone = placed.groupBy("block").agg(F.count(F.lit(1)).alias("members"))
    own = placed.select("class", "block").join(alone, "block").join(parts, "block", "left").where("members > 1 OR parts IS NOT NULL")
    own = own.select("class", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(False).alias("guest"))
    guests = visits.join(parts, "block").select("class", "block", F.pmod(F.xxhash64("class"), "parts").alias("part"), F.lit(True).alias("guest"))
    ways = own.unionByName(guests).groupBy("class").agg(F.collect_list(F.struct("block", "part", "guest")).alias("ways"))

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["class", "guest"])
        members, visitors = rows[~rows.guest], rows[rows.guest]
        found = links(visitors, members, percent, int(rows.part.iloc[0]) == 0) if len(members) else []
        return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)

    sent = _sets_on_their_ways(docs, placed.drop("block").join(ways, "class"), n)
    edges = cut(sent.groupBy("block", "part").applyInPandas(meet, "a long, b long"), tasks)
    roots = components(edges, tasks).withColumnRenamed("node", "class")
    least = roots.join(reps, "class").groupBy("root").agg(F.min("rep").alias("least"))
    classes = reps.join(roots.join(least, "root"), "class", "left").select("class", F.coalesce("least", "rep").alias("component_id"))
    full = surveyed.where("n > 0").join(classes, "class").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.unionByName(surveyed.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


_SENT = {"block": pa.int64(), "part": pa.int64(), "guest": pa.bool_(), "class": pa.int64(), "size": pa.int64(), "l": pa.int64(), "set": pa.binary(), "values": pa.binary(), "levels": pa.binary()}


def _sets_on_their_ways(docs: DataFrame, chosen: DataFrame, n: int) -> DataFrame:
    """A row for each block and part that a class lives in or visits, with its prefix and its whole set."""
    info = chosen.select(F.col("rep").alias("doc_id"), "class", "size", "l", F.col("shared.value").alias("values"), F.col("shared.level").alias("levels"), "ways")
    rows = docs.join(info.hint("shuffle_hash"), "doc_id").select("class", "text", "size", "l", "values", "levels", "ways")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, size, l = (batch.column(c).to_pylist() for c in ("class", "size", "l"))
            values, levels, ways = (batch.column(c) for c in ("values", "levels", "ways"))
            for first, after, data, offsets in pieces(batch.column("text")):
                sets, out = Sets(data, offsets, n), []
                of_class = signed(sets.sums()).tolist()
                for i in range(first, after):
                    if of_class[i - first] != own[i]:  # another text under the same id
                        continue
                    whole = sets.value[sets.first[i - first]:sets.first[i - first + 1]].tobytes()
                    value, level = values[i].values.to_numpy().tobytes(), levels[i].values.to_numpy().astype(np.uint8).tobytes()
                    out += [(w["block"], w["part"], w["guest"], own[i], size[i], l[i], whole, value, level) for w in ways[i].as_py()]
                    if len(out) >= 1000:
                        yield _rows(out, _SENT)
                        out = []
                yield _rows(out, _SENT)

    return rows.mapInArrow(run, "block long, part long, guest boolean, class long, size long, l long, set binary, values binary, levels binary")
