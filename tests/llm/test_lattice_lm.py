import itertools
import math
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest

from siemloom.llm import lattice_lm as L
from siemloom.llm import queries
from siemloom.llm.training import remainder
from tests.llm.cases import frame, odd_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return L.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def every_segmentation(text, model):
    """Sum over all ways to cut the bytes, one by one."""
    pieces, byte, _ = model
    total = 0.0
    for cuts in itertools.product([0, 1], repeat=len(text) - 1):
        part, p = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)], 1.0
        for a, b in zip(part, part[1:]):
            q = 10 ** pieces[text[a:b]] if text[a:b] in pieces else 0.0
            p *= q + (10 ** byte if b - a == 1 else 0.0)
        total += p
    return math.log10(total)


def test_vocabulary_is_a_distribution(model):
    pieces, byte, end = model
    assert abs(math.fsum(10 ** s for s in pieces.values()) + 256 * 10 ** byte + 10 ** end - 1) < 1e-9
    assert len(pieces) > 31_000 and all("▁".encode() not in p[1:] for p in pieces)


def test_word_against_every_segmentation(model):
    lattice = L.Lattice(model)
    for word in ("the", "a", "Żół", "w17", "information", "\x00", "▁x"):
        want = every_segmentation(("▁" + word).encode(), model)
        assert abs(lattice.words([word.encode()])[0] - want) < 1e-9 and abs(lattice._long(("▁" + word).encode()) - want) < 1e-9


def test_words_together_and_alone(model):
    lattice, r = L.Lattice(model), random.Random(4)
    words = [" ".join(r.choice(["the", "tion", "é", "q", "—", "in", "ный", "\x01"]) for _ in range(r.randint(1, 14))).replace(" ", "").encode() for _ in range(500)]
    got = lattice.words(words)
    assert all(abs(g - lattice._long("▁".encode() + w)) < 1e-9 for g, w in zip(got, words))
    assert len(lattice.words([])) == 0


def test_long_word(model):
    lattice = L.Lattice(model)
    score = lattice.words([b"ab" * 50_000])[0]
    assert math.isfinite(score) and score < -10_000


def want(rows, model):
    counts, n = Counter(), 0
    kinds = sorted({w for _, t in rows for w in (t or "").encode().lower().split()})
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 1
    cut = lambda t: (t or "").encode().lower().split() + [None]
    for i, t in rows:
        if held(i) is False:
            counts.update(cut(t))
    n = sum(counts.values())
    learned = L.fitted(model, {w for i, t in rows if held(i) is False for w in (t or "")[:L.SAMPLE_CHARS].encode().lower().split()})
    word = dict(zip(kinds, L.Lattice(learned).words(kinds))) | {None: model[2]}
    new = (sum(c == 1 for w, c in counts.items() if w) + 1) / (n + 2)
    spelled = lambda w: word[w] + math.log10(new)
    token = lambda w: max(spelled(w), math.log10((1 - new) * counts[w] / n + 10 ** spelled(w))) if counts[w] else spelled(w)
    out = []
    for i, t in rows:
        words = cut(t)
        base = math.fsum(math.log10((counts[w] + 0.5) / (n + 0.5 * (len(counts) + 1))) for w in words)
        score = math.fsum(token(w) for w in words)
        out.append((i, held(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6), round(score, 6)))
    return sorted(map(repr, out))


def rounded(out):
    return sorted(repr((*r[:5], round(r[5], 6), round(r[6], 6))) for r in map(tuple, out.collect()))


def test_query_against_brute_force(spark, model):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rounded(queries.op11_lattice_lm(spark, SF)) == want(rows, model)


def test_odd_rows_in_many_blocks(spark, model, monkeypatch):
    r = random.Random(1)
    rows = [(t[0], t[1]) for t in odd_rows()] + [(t[0], t[1]) for t in odd_rows()[:9]]
    rows += [(None, "a b"), (None, None), (900, "A" * 3000), (901, "a" * 3000), (902, "the \x0b" * r.randint(2, 9))]
    docs = frame(spark, [(i, t, "x", "y", 1, 5, "kept", 2, 0.5) for i, t in rows]).repartition(3)
    held = remainder(5) == 1
    monkeypatch.setattr(L, "BLOCK_WORDS", 200)
    assert rounded(L.score(docs, model, held)) == want(rows, model)
    assert L.score(docs.limit(0), model, held).count() == 0
    only = [(900, None), (901, "")]
    got = L.score(frame(spark, [(i, t, *[None] * 7) for i, t in only]), model, held)
    assert rounded(got) == want(only, model)


def test_expected_pieces_against_every_segmentation(model):
    lattice = L.Lattice(model)
    words, times, want = ["the", "a", "Żół", "ation"], [3, 1, 2, 5], Counter()
    for w, n in zip(words, times):
        text, paths = ("▁" + w).encode(), []
        for cuts in itertools.product([0, 1], repeat=len(text) - 1):
            part = [0, *(i + 1 for i, c in enumerate(cuts) if c), len(text)]
            paths.append([text[a:b] for a, b in zip(part, part[1:])])
        one = lambda p: (10 ** model[0][p] if p in model[0] else 0) + (10 ** model[1] if len(p) == 1 else 0)
        total = sum(math.prod(map(one, path)) for path in paths)
        for path in paths:
            for p in path:
                if p in model[0]:
                    want[p] += n * math.prod(map(one, path)) / total * 10 ** model[0][p] / one(p)
    got = lattice._forward([("▁" + w).encode() for w in words], times=L.np.array(times, float))
    assert all(abs(got[lattice.number[p]] - want[p]) < 1e-9 for p in model[0])
    pieces, byte, end = L.fitted(model, {w.encode() for w in words})
    assert abs(math.fsum(10 ** s for s in pieces.values()) + 256 * 10 ** byte + 10 ** end - 1) < 1e-9
    assert sum(L.Lattice((pieces, byte, end)).words([w.encode() for w in words])) > sum(lattice.words([w.encode() for w in words]))


def test_held_out_scores_are_near_the_base(spark, model):
    r = random.Random(8)
    syllables = ["th", "er", "on", "ti", "ing", "ble", "ha", "re"]
    kinds = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(300)]
    rows = [(i, " ".join(r.choices(kinds, k=60) + r.choices(syllables, k=2) + ["x" + "".join(r.choices(syllables, k=3))])) for i in range(200)]
    got = L.score(frame(spark, [(i, t, *[None] * 7) for i, t in rows]), model, remainder(5) == 1).collect()
    held = [x for x in got if x.held_out]
    assert len(got) == 200 and 20 < len(held) and all(math.isfinite(x.score) for x in got)
    assert all(x.score > 1.1 * x.base_score for x in held)


def test_blocks_stay_where_they_were_written(spark, model):
    """Counts go to the blocks; the blocks' texts are not shuffled to meet them."""
    rows = [(i, f"a b{i} c{i % 3}", *[None] * 7) for i in range(30)]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = L.score(frame(spark, rows), model, remainder(5) == 1)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert len(out.collect()) == 30
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert plan.count("Exchange hashpartitioning(block") == 1 and "Bucketed: true" in plan


def test_small_partitions_are_few_blocks(spark, model, monkeypatch):
    """A table dealt over many small partitions is written by few tasks, a block each, with the same scores."""
    written = []
    keep = L.bucketed
    monkeypatch.setattr(L, "bucketed", lambda df, *more: written.append(df.rdd.getNumPartitions()) or keep(df, *more))
    docs = frame(spark, [(i, f"a b{i} c{i % 3}", *[None] * 7) for i in range(200)])
    many, one = (sorted(map(tuple, L.score(x, model, remainder(5) == 1).collect())) for x in (docs.repartition(100), docs.coalesce(1)))
    assert len(many) == 200 and max(written) <= 3 * spark.sparkContext.defaultParallelism
    for a, b in zip(many, one, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_every_word_of_every_text_teaches(spark, model):
    """More texts than were taken once, words behind a text's first 20,000 characters, and words of any length."""
    r = random.Random(5)
    syllables = ["th", "er", "on", "ti", "ing", "ble", "ha", "re", "Ż", "漢"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 5)))
    rows = [(i, f"{word()} {word()}") for i in range(2700)]
    rows += [(3000 + i, " ".join(["the"] * 7000 + [word() + word() for _ in range(300)])) for i in range(4)]
    rows += [(4000 + i, " ".join("".join(r.choices(syllables, k=r.randint(40, 90))) for _ in range(20))) for i in range(4)]
    docs = frame(spark, [(i, t, *[None] * 7) for i, t in rows]).repartition(5)
    assert rounded(L.score(docs, model, remainder(5) == 1)) == want(rows, model)


def test_expected_pieces_of_long_words(model):
    """Read together, by logarithms, or alone; what is expected of the pieces is as long as the words, but for the bytes' own share."""
    lattice, r = L.Lattice(model), random.Random(6)
    words = [b"".join(r.choices([b"the", b"tion", "é".encode(), b"q", "漢字".encode(), b"in", b"\xff"], k=r.randint(30, 120))) for _ in range(60)]
    alone = L.np.zeros(len(lattice.scores))
    whole = [lattice._long("▁".encode() + w, alone) for w in words]
    assert sum(len(w) > L.TOGETHER for w in words) > L.FEW and lattice.words(words) == pytest.approx(whole)
    assert lattice.expected(words) == pytest.approx(alone, abs=1e-7)
    assert lattice.expected(words[:1] + [b"the"]) == pytest.approx(lattice.expected(words[:1]) + lattice.expected([b"the"]))
    size = dict.fromkeys(range(len(alone)), 0) | {i: len(p) for p, i in lattice.number.items()}
    covered = sum(n * size[i] for i, n in enumerate(alone))
    assert 0 < covered < sum(len(w) + 3 for w in words)


def test_trie_finds_every_piece(model):
    lattice = L.Lattice(model)
    for piece in list(model[0])[::50]:
        ends = {j: node for j, _, node in lattice._edges(piece + b"\x00", 0)[1:]}
        assert ends == {k: lattice.number[piece[:k]] for k in range(1, len(piece) + 1) if piece[:k] in model[0]} | {
            j: n for j, n in ends.items() if j > len(piece)}
