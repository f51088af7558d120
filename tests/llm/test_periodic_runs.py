import hashlib
import random
import zlib

import numpy as np

from siemloom.llm import periodic_runs as R
from siemloom.llm import queries
from tests.llm.cases import frame, odd_rows

WORDS = b" \t\n\x0b\x0c\r"


def brute(words):
    """Every run by its definition."""
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j + q - i
            if length >= max(6, 4 * q) and not any(words[i:i + length - p] == words[i + p:i + length] for p in range(1, q)):
                found.append((i, length, q))
            i = j
    return sorted(found)


def planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if text is None or doc_id is None:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def row(doc_id, words):
    runs = brute(words)
    drop = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return (doc_id, len(words), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()), sha(b" ".join(w for i, w in enumerate(words) if i not in drop)))


def random_words(r, n):
    """Random words of a few kinds, stretches of all periods, periods within periods."""
    out = []
    while len(out) < n:
        kind, size = r.random(), r.choice([1, 2, 3, 50])
        root = [r.randrange(size) for _ in range(r.randint(1, r.choice([3, 9, 40])))]
        if kind < 0.3:
            out += root * r.randint(2, 8) + root[:r.randrange(len(root))]
        elif kind < 0.5:
            inner = root[:3] * r.randint(3, 7) + [r.randrange(99)]
            out += inner * r.randint(2, 6)
        else:
            out += root
    return out[:n]


def test_runs_against_brute_force():
    for seed in range(150):
        r = random.Random(seed)
        docs = [random_words(r, r.choice([0, 1, 5, 7, 40, 200, 500])) for _ in range(r.randint(1, 6))]
        w, want, at = [], [], 0
        for k, words in enumerate(docs):
            want += [(at + a, b, c) for a, b, c in brute(words)]
            w += [*words, -1 - k]
            at += len(words) + 1
        got = R.find_runs(np.array(w, np.int64), np.array([len(d) for d in docs], np.int64))
        assert got == want, seed


def test_few_places_are_proposed_in_text_of_one_word():
    w = np.r_[np.zeros(100_000, np.int64), -1]
    assert R.find_runs(w, np.array([100_000])) == [(0, 100_000, 1)]


def test_query_on_odd_rows(spark):
    r = random.Random(5)
    docs = [(t[0], t[1]) for t in odd_rows()] * 2 + [(None, "a " * 9), (None, None)]
    docs += [(1000 + k, " ".join(f"v{x}" for x in random_words(r, r.randint(1, 300)))) for k in range(120)]
    wide = frame(spark, [(i, t, "x", "y", 1, 5, "kept", 2, 0.5) for i, t in docs])
    out = R.digests(R.runs(R.with_planted(wide)))
    assert out.columns == ["doc_id", "n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, out.collect()))) == sorted(repr(row(i, planted(i, t))) for i, t in docs)
    assert R.digests(R.runs(R.with_planted(wide.limit(0)))).count() == 0


def test_query_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    got = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(row(i, planted(i, t))) for i, t in docs)
