import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from siemloom.llm import block_topk, line_crf, preferences, toxicity
from siemloom.llm.training import remainder
from siemloom.llm.words import NON_ALNUM, Words, text_bytes
from tests.compare import connect, difference
from tests.llm.cases import frame, odd_rows

SF = "/root/testdata/sf0.001"


def test_sql(spark):
    for name in ("op9_preference_format", "op10_block_topk"):
        assert difference(spark, connect(SF), entry.queries()[name], entry.oracle_sql()[name], SF) is None


def test_topk_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "CHUNK", 100)
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 6) / 4]) for i in range(400)] + [(i, [1.0] * 6) for i in range(400, 460)]
    bad = [(460, None), (461, []), (462, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (480, [float("nan")] * 6), (463, [float("inf")] * 6), (None, [1.0] * 6), (500, [1.0, 2.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>")
    got = block_topk.top_k(block_topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 20 == 0, 7)
    v = {i: np.floor(64 * np.array(x)).astype(int) for i, x in rows}
    want = {(q, k + 1, c, s) for q in v if q % 20 == 0 for k, (s, c) in enumerate(
        (-a, b) for a, b in sorted((-int(v[q] @ v[c]), c) for c in v if c != q)[:7])}
    assert {(x.query_id, x.rank, x.vec_id, x.score) for x in got.collect()} == want
    assert block_topk.top_k(block_topk.integer_vectors(df.limit(0), "vec_id", "embedding"), F.col("id") % 20 == 0, 7).count() == 0


def test_preferences_odd_rows(spark):
    t = "array<struct<role:string,text:string>>"
    rows = [(1, None, None), (2, [("user", "a"), ("assistant", "b")], [("user", "a"), (None, None)]), (3, [("user", "a")], [("user", "a")]),
            (None, [("user", "a")], [("user", "b"), ("assistant", "c")])]
    got = preferences.format_pairs(spark.createDataFrame(rows, f"id long, chosen {t}, rejected {t}"), "id").collect()
    assert [r.n_shared for r in got] == [0, 1, 1, 0]
    assert got[1].prompt == "<|start|>user\na<|end|>\n" and got[1].chosen == "<|start|>assistant\nb<|end|>\n"
    span = got[1].chosen_spans[0]
    assert got[1].chosen[span.start:span.stop] == "b<|end|>\n" and got[1].rejected_spans == [] and got[2].chosen == ""
    talk = spark.createDataFrame([(None, 0, "user", "x"), (1, 0, None, None), (1, 1, "assistant", "abcd"), (1, 1, "assistant", "abcd")], "conv_id long, turn long, role string, text string")
    assert preferences.pairs_of_conversations(talk).count() == 1 and preferences.pairs_of_conversations(talk.limit(0)).count() == 0


def labelled(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    return docs, labels


def test_quality_held_out(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    out = entry.queries()["op8_quality"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    right = out.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right")).collect()
    assert all(r.right > 0.95 for r in right) and len(right) == 2


def test_toxicity_held_out(spark):
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    out = entry.queries()["op7_toxicity"](spark, "/root/testdata/sf0.1").join(labels, "doc_id").where("held_out")
    right = {r.toxic: r.right for r in out.groupBy("toxic").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")).alias("right")).collect()}
    assert right[0] > 0.95 and right[1] > 0.9  # one in twelve of the texts marked toxic holds none of the insults


def test_toxic_passage_at_every_offset(spark):
    """A toxic document's best window is found wherever it stands in a long clean text."""
    docs, labels = labelled(spark, "/root/testdata/sf0.1")
    net = toxicity.train(docs, labels, remainder(5) == 0)
    rows = docs.join(labels, "doc_id").where("n_chars > 200").orderBy("doc_id").select("text", "toxic").collect()
    clean = " ".join(r.text for r in rows if r.toxic == 0).split()
    score = lambda texts: net.score(*text_bytes(pa.array(texts)))
    clean = [" ".join(clean[a:a + 200]) for a in range(0, 20_000, 200)]
    clean = [t.split() for t, x in zip(clean, score(clean), strict=True) if x < 0.5]
    assert len(clean) > 80
    found, all_ = 0, 0
    for r in [r for r in rows if r.toxic == 1][:20]:
        data, offsets = text_bytes(pa.array([r.text]))
        t = toxicity.Texts(data, offsets, net.vocabulary)
        words = Words(data, offsets, NON_ALNUM, lower=True)
        best = t.begin[net.windows(t).argmax()]
        passage = bytes(words.data[words.starts[best]:words.ends[min(best + toxicity.WINDOW, words.n) - 1]]).decode().split()
        texts = [" ".join(clean[k][:100 + k] + passage + clean[k][100 + k:]) for k in range(32)]
        scores = score(texts)
        alone = score([" ".join(passage)])[0]
        assert (scores >= alone - 1e-4).all()  # the passage stands whole in a window at any offset
        found, all_ = found + (scores >= 0.5).sum(), all_ + len(scores)
    assert found > 0.95 * all_


def test_toxicity_equals_windows_one_by_one():
    """Scores by scalar loops over every window of every text."""
    r = np.random.default_rng(8)
    lexicon = ["you", "are", "bad", "mean", "é", "a1", "of", "日本", "zoo", "nothing"]
    texts = [" ".join(r.choice(lexicon, n)) for n in (0, 1, 2, 15, 16, 17, 18, 40, 3, 16, 90)] + [None, "  ", "Bad, BAD! bad"]
    data, offsets = text_bytes(pa.array(texts))
    words = Words(data, offsets, NON_ALNUM, lower=True)
    net = toxicity.Network(np.unique(words.hashes)[::2])
    net.p["b"][:], net.p["bo"][:] = r.normal(size=net.p["b"].shape) / 3, 0.25
    p, n = net.p, toxicity.HIDDEN
    every = toxicity.Texts(data, offsets, net.vocabulary)
    x, sigmoid = net.inputs(every).astype(float), lambda u: 1 / (1 + np.exp(-u))

    def window(own):
        states = np.zeros((len(own), 2 * n))
        for d in (0, 1):
            h = np.zeros(n)
            for at in (range(len(own)) if d == 0 else reversed(range(len(own)))):
                g = x[own[at]] @ p["wx"][d] + p["b"][d]
                z, f = sigmoid(g[:n] + h @ p["wh"][d][:, :n]), sigmoid(g[n:2 * n] + h @ p["wh"][d][:, n:2 * n])
                h = (1 - z) * h + z * np.tanh(g[2 * n:] + (f * h) @ p["wh"][d][:, 2 * n:])
                states[at, d * n:(d + 1) * n] = h
        a = np.exp(states @ p["wa"])
        return (a / a.sum()) @ states @ p["wo"] + p["bo"][0]

    want = []
    for k in range(len(texts)):
        own = every.word[words.first[k]:words.first[k + 1]]
        want.append([window(own[a:a + toxicity.WINDOW]) for a in range(max(1, len(own) - toxicity.WINDOW + 1))] if len(own) else [])
    flat = np.array([s for w in want for s in w])
    for at_once in (5, 4096):
        assert np.allclose(net.windows(every, at_once), flat, atol=1e-4)
    best = np.array([max(w, default=-12) for w in want])
    assert np.allclose(net.score(data, offsets), sigmoid(best), atol=1e-4)


def test_models_without_labels_and_odd_rows(spark):
    _, labels = labelled(spark, SF)
    docs = frame(spark, odd_rows())
    for rows in (docs, docs.limit(0), docs.unionByName(docs)):
        assert line_crf.train(rows, labels.limit(0), F.lit(False)) is None and toxicity.train(rows, labels.limit(0), F.lit(False)) is None
        assert line_crf.with_score(rows, None).count() == toxicity.with_score(rows, None).count() == rows.count()
    docs0, _ = labelled(spark, SF)
    model = line_crf.train(docs0, labels, remainder(4) == 2)
    net = toxicity.train(docs0, labels, remainder(5) == 0)
    scored = line_crf.with_score(docs, model).join(toxicity.with_score(docs, net).withColumnRenamed("score", "t"), "doc_id").collect()
    assert len(scored) == 60 and all(0 <= r.quality_score <= 1 and 0 <= r.t <= 1 for r in scored)
    assert len({r.t for r in scored if r.doc_id < 4}) == 1


def test_gradients():
    """Backpropagation against differences."""
    texts = ["you are bad and mean", "a fine day in the sun with you", "bad bad"]
    data, offsets = text_bytes(pa.array(texts))
    net = toxicity.Network(np.unique(Words(data, offsets, NON_ALNUM, lower=True).hashes))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    t, y, w = toxicity.Texts(data, offsets, net.vocabulary), np.array([1.0, 0, 1]), np.array([1.0, 2, 0.5])
    chosen = t.part(np.arange(3))

    def loss():
        s = net.windows(t).astype(np.float64)
        return float((w * (np.logaddexp(0, s) - y * s)).sum())

    g = net.gradients(chosen, y, w)
    for k, v in net.p.items():
        at = np.unravel_index(np.abs(g[k]).argmax(), v.shape)
        old, step = v[at], 1e-2
        v[at] = old + step
        up = loss()
        v[at] = old - step
        down = loss()
        v[at] = old
        assert abs((up - down) / 2 / step - g[k][at]) < 0.02 * max(0.05, abs(g[k][at])), k


def test_marginals():
    r = np.random.default_rng(4)
    scores, counts, move = r.normal(size=7), np.array([3, 1, 3]), r.normal(size=(2, 2))
    got, pairs = line_crf.marginals(scores, counts, move)
    want, expected, first = [], np.zeros((2, 2)), 0
    for n in counts:
        total, one = 0.0, np.zeros(n)
        for code in range(2**n):
            s = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(scores[first + i] * s[i] for i in range(n)) + sum(move[s[i], s[i + 1]] for i in range(n - 1)))
            total += p
            one += p * np.array(s)
        for code in range(2**n):
            s = [code >> i & 1 for i in range(n)]
            p = np.exp(sum(scores[first + i] * s[i] for i in range(n)) + sum(move[s[i], s[i + 1]] for i in range(n - 1))) / total
            for i in range(n - 1):
                expected[s[i], s[i + 1]] += p
        want += (one / total).tolist()
        first += n
    assert np.allclose(got, want) and np.allclose(pairs, expected)


def test_topk_large_components_and_repeated_queries(spark):
    rows = [(20, [1e9, 1.0]), (20, [1e9, 1.0]), (1, [1e9, 2.0]), (2, [1e9, 3.0]), (3, [-1e300, 0.0]), (40, [0.5, 0.25]), (4, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = block_topk.top_k(block_topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 20 == 0, 3).collect()
    big = (1 << 63) - 1
    lists = {q: [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] for q in (20, 40)}
    assert lists[20] == [(1, 1, big), (2, 2, big), (3, 4, 64 * 10**9 * 64 + 64 * 64)]
    assert lists[40] == [(1, 2, 64 * 10**9 * 32 + 192 * 16), (2, 1, 64 * 10**9 * 32 + 128 * 16), (3, 20, 64 * 10**9 * 32 + 64 * 16)]


def test_topk_repeated_rows_in_many_parts(spark, monkeypatch):
    monkeypatch.setattr(block_topk, "CHUNK", 40)
    monkeypatch.setattr(block_topk, "MEET", 3)
    r = np.random.default_rng(2)
    rows = [(i, [float(x) for x in r.integers(-8, 9, 4) / 4]) for i in range(160)]
    rows += [rows[7]] * 9 + [rows[33]] * 2  # more and fewer than k
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = block_topk.top_k(block_topk.integer_vectors(df, "vec_id", "embedding"), F.col("id") % 20 == 0, 5).collect()
    v = [(i, np.floor(64 * np.array(x)).astype(int)) for i, x in rows]
    want = [(q, k + 1, c, -s) for q, x in v if q % 20 == 0 for k, (s, c) in enumerate(sorted((-int(x @ y), c) for c, y in v if c != q)[:5])]
    assert sorted((x.query_id, x.rank, x.vec_id, x.score) for x in got) == sorted(want)
