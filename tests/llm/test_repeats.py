import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siemloom.llm import repeats, suffix_array
from tests.llm.cases import frame, odd_rows


def brute(rows, n):
    seen, out = set(), {}
    for i, t, *_ in sorted(rows):
        w, gone = (t or "").encode().split(), set()
        for a in range(len(w) - n + 1):
            k = tuple(w[a:a + n])
            if k in seen:
                gone.update(range(a, a + n))
            seen.add(k)
        out[i] = len(w), len(gone), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone)).hexdigest()
    return out


@pytest.mark.parametrize("trees,window", [(True, 20), (True, 7), (False, 50), (False, 12)])
def test_equals_brute_force(spark, trees, window):
    rows = odd_rows()
    docs = frame(spark, [*rows, (None, "no id", *rows[0][2:])])
    out = (repeats.suffix_trees if trees else suffix_array.suffix_arrays)(docs, window)
    got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in out.collect()}
    assert got == brute(rows, window)


def test_long_prefixes(spark, monkeypatch):
    monkeypatch.setattr(repeats, "SHARE", 0)  # every prefix is heavy, so all have full depth
    rows = odd_rows(3)
    got = {r.doc_id: r.n_removed for r in repeats.suffix_trees(frame(spark, rows)).collect()}
    assert got == {k: v[1] for k, v in brute(rows, 20).items()}


def test_empty_and_repeated_rows(spark):
    rows = odd_rows()
    assert repeats.suffix_trees(frame(spark, [])).count() == 0
    twice = repeats.suffix_trees(frame(spark, rows + rows))
    assert twice.count() == 2 * len(rows)
    assert twice.where(F.size("spans") > 0).count() > 0


@pytest.mark.parametrize("trees,window", [(True, 20), (False, 12)])
def test_rows_that_share_an_id(spark, trees, window):
    r = random.Random(6)
    text = lambda n: " ".join(f"v{r.randrange(10**6)}" for _ in range(n))
    a, b, c, d = (text(60) for _ in range(4))
    texts = [(-9, d), (-8, f"new {d}"), (-1, text(40)), (-1, f"{c} {text(9)}"), (1, a), (5, a), (5, b), (5, f"{b} {text(5)}"), (5, f"{text(3)} {c}"),
             (6, f"{text(30)} {b}"), (7, f"{d[:400]} {d[:400]}"), (8, f"{a} {a}"), (8, None), (8, "")]
    texts += [(5, f"{e} {text(2)} {e}") for e in (text(25), text(30))] + [(9, f"{text(30)} {text(30)}")]
    for rows in (texts, texts + texts):
        first = {}
        for i, t in rows:
            w = (t or "").encode().split()
            for j in range(len(w) - window + 1):
                first[tuple(w[j:j + window])] = min(i, first.get(tuple(w[j:j + window]), i))
        want = []
        for i, t in rows:
            w, seen, gone = (t or "").encode().split(), set(), set()
            for j in range(len(w) - window + 1):
                k = tuple(w[j:j + window])
                if first[k] < i or k in seen:
                    gone.update(range(j, j + window))
                seen.add(k)
            want.append((i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone).decode()))
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        out = (repeats.suffix_trees if trees else suffix_array.suffix_arrays)(docs, window)
        assert sorted((x.doc_id, x.n_words, x.n_removed, x.kept) for x in out.collect()) == sorted(want)


def test_kept_columns(spark):
    rows = odd_rows()
    out = repeats.suffix_trees(frame(spark, rows), keep=True)
    same = {r.doc_id: r for r in out.collect()}
    assert same[4].kept == "one" and same[4].rest.stays == 3 and same[7].n_removed > 0


def test_suffix_array_with_frequent_grams(spark, monkeypatch):
    """Some or all grams go by whole windows; the result is the same."""
    rows = odd_rows(4, 90)
    want = {k: v[1] for k, v in brute(rows, 50).items()}
    for least in (-10**6, 3):
        monkeypatch.setattr(suffix_array, "LEAST", least)
        monkeypatch.setattr(suffix_array, "BINS", 4096 if least < 0 else 16)
        assert {r.doc_id: r.n_removed for r in suffix_array.suffix_arrays(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("text", ["a b c d", "", "w " * 30, "w " * 60])
def test_tables_of_one_row_and_partitions_without_words(spark, text):
    for rows in ([(1, text)], [(1, text), (2, ""), (3, None), (4, "x y")], [(1, text), (2, text)]):
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4, "doc_id")
        for f, window in ((repeats.suffix_trees, 20), (suffix_array.suffix_arrays, 50)):
            got = {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept.encode()).hexdigest()) for r in f(docs, window).collect()}
            assert got == brute(rows, window)
