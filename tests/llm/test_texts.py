import base64
import random
import re

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken

from siemloom.llm import byte_bpe, decontaminate, licences
from siemloom.llm.licences import BASE, TEMPLATES
from siemloom.llm.words import NON_ALNUM, Words, text_bytes
from tests.llm.cases import frame, odd_rows

ALPHABET = "ab   e'tsél²́x\x1c\x85　\n\t日本1２_-!?\U0001f600"


@pytest.mark.parametrize("name", ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def test_bpe_equals_tiktoken(spark, name):
    with open(P.path(name), "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(3)
    texts = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 40))) for _ in range(2000)] + ["aab" * 9000, "<|endoftext|>"]
    rows = odd_rows() + [(1000 + i, t, *[None] * 7) for i, t in enumerate(texts)]
    got = {x.doc_id: x for x in byte_bpe.encode_decode(frame(spark, rows), raw, P.PATTERN).collect()}
    for i, t, *_ in rows:
        assert list(got[i].ids) == enc.encode_ordinary(t or ""), t
        assert bytes(got[i].decoded) == (t or "").encode()


def words(t):
    return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(b + 32 if 65 <= b <= 90 else b for b in t.encode()))


def test_licences(spark):
    rows = odd_rows()
    phrases = list(BASE) + list(TEMPLATES.values())
    for k, p in enumerate(phrases):
        rows.append((100 + k, f"é foo. {p.upper()}! bar {p} under the the mit license", *[None] * 7))
    rows.append((200, " ".join(random.Random(5).choice("under the mit license apache version 2 cc by nc by".split()) for _ in range(5000)), *[None] * 7))
    got = {r.doc_id: r for r in licences.report(licences.scan(frame(spark, rows))).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        w = words(t or "")
        places = [(a, label) for p, label in BASE.items() for a in range(len(w)) if w[a:a + len(p.split())] == p.encode().split()]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min(places, default=(None,))[0], max(places, default=(None,))[0])
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and 0 <= r.score <= 1
    for k, label in enumerate([*BASE.values(), *TEMPLATES]):
        assert label in got[100 + k].labels.split(",")
    assert got[4].labels == "" and got[4].score == 0


def test_decontaminate(spark):
    r = random.Random(2)
    text = lambda n: " ".join(f"t{r.randrange(3000)}" for _ in range(n))
    items = [(k, text(r.randint(14, 50))) for k in range(20)] + [(50, None), (51, ""), (52, "only three words")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = odd_rows()
    for k, t in items[:20]:
        w = t.split()
        w[len(w) // 2] = "changed"
        rows += [(100 + k, f"{text(30)} {t.upper()} {text(30)}", *[None] * 7), (200 + k, f"{text(9)}, {' '.join(w)}; {text(300)}", *[None] * 7)]
        rows.append((300 + k, f"{text(50)} {' '.join(t.split()[:8])} {text(50)}", *[None] * 7))
    docs = frame(spark, rows)
    found = {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()}
    assert found == {(100 + k, k) for k in range(20)} | {(200 + k, k) for k in range(20)}
    left = decontaminate.without_overlaps(docs, bench)
    assert {x.doc_id for x in left.collect()} == {x[0] for x in rows} - {d for d, _ in found} and left.columns == docs.columns
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


def overlapping(a, b):
    """Runs of every alignment by trying all spans; a's words from and to, equal words."""
    least, out = min(decontaminate.LEAST, len(b)), set()
    for shift in range(-len(b) + 1, len(a)):
        lo, hi = max(0, shift), min(len(a), shift + len(b))
        equal = [a[j] == b[j - shift] for j in range(lo, hi)]
        spans = []
        for i in range(len(equal)):
            total, best = 0, 0
            for j in range(i, len(equal)):
                total += 1 if equal[j] else -decontaminate.COST
                if total < 0:
                    break
                best = max(best, total)
                if best == total:  # no tail is below 0: none of the sums before is above the last
                    spans.append((i, j + 1))
        for i, j in spans:
            if not any((x, y) != (i, j) and x <= i and j <= y for x, y in spans) and sum(equal[i:j]) >= least:
                out.add((lo + i, lo + j, sum(equal[i:j])))
    return out


def test_every_overlap_has_a_seed():
    patterns = []

    def extend(pattern, total, equal):
        if equal == decontaminate.LEAST:
            patterns.append(pattern)
        elif total >= 0:
            extend(pattern + "1", total + 1, equal + 1)
            extend(pattern + "0", total - decontaminate.COST, equal)

    extend("", 0, 0)
    masks = [re.compile(m.replace("0", ".")) for m in decontaminate.MASKS]
    assert len(patterns) == 3876 and all(any(m.search(p) for m in masks) for p in patterns)


def test_decontaminate_equals_all_alignments(spark):
    r = random.Random(9)
    word = iter(range(10**6))
    items = [(k, " ".join(f"i{next(word)}" for _ in range(n))) for k, n in enumerate([5, 6, 9, 12, 13, 14, 15, 16, 20, 25, 32, 40, 60])]
    items.append((20, " ".join(r.choice("abc") for _ in range(24))))
    rows = [(9000 + k, " ".join(r.choice("abcd") for _ in range(60)), *[None] * 7) for k in range(10)]
    for k, t in items[:-1]:
        for trial in range(40):
            w = t.split()
            every = (None, 5, 4, 3)[trial] if trial < 4 else None
            changed = range(every - 1, len(w), every) if every else r.sample(range(len(w)), min(len(w), r.randint(0, len(w) // 3)))
            for j in changed:
                w[j] = "changed"
            rows.append((100 * k + trial, " ".join(["before"] * r.randint(0, 3) + w + ["after"] * r.randint(0, 3)), *[None] * 7))
    w = items[11][1].split()[:34]  # the exact run gains more than the one that is long enough
    w[12:18], w[22], w[27] = ["changed"] * 6, "x", "x"
    rows.append((5000, " ".join(w), *[None] * 7))
    want = {(i, k, *x) for i, t, *_ in rows for k, u in items for x in overlapping(t.split(), u.split())}
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(x) for x in decontaminate.overlaps(frame(spark, rows), bench).collect()]
    assert set(got) == want and len(got) == len(want) and (5000, 11, 18, 34, 14) in want
    left = {x.doc_id for x in decontaminate.without_overlaps(frame(spark, rows), bench).collect()}
    assert left == {i for i, *_ in rows} - {x[0] for x in want}


def test_repetitive_texts_meet_every_alignment_once(monkeypatch):
    r = random.Random(4)
    periods = ["x", "x y", "a b c", "x x y", "x x x x x x x x z"]
    items = [" ".join((p.split() * 60)[:n]) for p in periods for n in (1, 5, 6, 13, 14, 31)] + [" ".join(r.choice("xy") for _ in range(n)) for n in (13, 25, 40)]
    texts = [" ".join((p.split() * 60)[:n]) for p in periods for n in (4, 12, 13, 50)] + [" ".join(r.choice("xy") for _ in range(60)) for _ in range(4)]
    texts += ["", "x " * 20 + "y x " * 12 + "a b c " * 9 + "x " * 15]
    want = {(d, k, *o) for d, t in enumerate(texts) for k, u in enumerate(items) for o in overlapping(t.split(), u.split())}
    index = decontaminate.Index(np.arange(len(items)), items)
    data, offsets = text_bytes(pa.array(texts))
    words = Words(data, offsets, NON_ALNUM, lower=True)
    for cells in (7, 1 << 20):
        monkeypatch.setattr(decontaminate, "CELLS", cells)
        got = index.overlaps(words)
        assert set(got) == want and len(got) == len(want)


def test_long_repetitive_texts_stay_small():
    """One word 20,000 times and an item of it 200 times: 28 million pairs of places, but only an alignment for each shift."""
    index = decontaminate.Index(np.arange(2), ["x " * 200, "a b c " * 70])
    data, offsets = text_bytes(pa.array(["x " * 20_000, "a b c " * 5_000]))
    words = Words(data, offsets, NON_ALNUM, lower=True)
    keys = [len(k) for seed in decontaminate.seeds(words) for k in index._alignments(words, *seed)]
    assert sum(keys) < len(decontaminate.MASKS) * 30_000
    got = index.overlaps(words)
    assert sum(d == 0 and k == 0 for d, k, *_ in got) == 20_000 + 200 - 1 - 2 * (decontaminate.LEAST - 1)


def test_blocks_of_the_benchmark(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 30)
    bench = spark.createDataFrame([(k, " ".join(f"u{k}x{j}" for j in range(20))) for k in range(5)], "item_id long, text string")
    docs = frame(spark, [(k, " ".join(f"u{k}x{j}" for j in range(20)), *[None] * 7) for k in range(5)] + odd_rows()[10:12])
    assert {(x.doc_id, x.item_id) for x in decontaminate.overlaps(docs, bench).collect()} == {(k, k) for k in range(5)}
    assert decontaminate.without_overlaps(docs, bench).count() == 2


def test_pieces_cover_all():
    from siemloom.llm.words import WHITE, Words, pieces

    rows = [t for _, t, *_ in odd_rows()]
    for limit in (1, 50, 1 << 20):
        got = []
        for first, after, data, offsets in pieces(pa.array(rows), limit):
            w = Words(data, offsets, WHITE)
            got += w.counts.tolist()
        assert got == [len((t or "").encode().split()) for t in rows]
