import corpus_pipeline as C
from tests.llm.cases import frame, odd_rows

SF = "/root/testdata/sf0.001"


def test_run(spark):
    out = C.run(spark, SF)
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and 0 < out.count() < 200


def test_stages_on_odd_rows(spark):
    docs = frame(spark, odd_rows() + odd_rows()[:9])
    for rows in (docs, docs.limit(0)):
        for _, stage in C.STAGES:
            out = stage(spark, rows, SF)
            assert stage is C.tokens or out.columns == rows.columns
            assert out.count() <= rows.count()


def test_rows_without_an_id_and_of_one_id(spark):
    text = lambda k: " ".join(f"p{k}x{j}" for j in range(40))
    rows = [(None, text(0)), (None, text(1)), (5, text(2)), (5, text(3)), (6, text(4)), (6, text(4))]
    docs = frame(spark, [(i, t, "b" if k == 4 else "a", *[None] * 6) for k, (i, t) in enumerate(rows)])
    want = sorted(map(repr, rows[:5]))
    for stage in (C.near_duplicates, C.substrings):
        docs = stage(spark, docs, SF)
        kept = docs.collect()
        assert sorted(repr((r.doc_id, r.text)) for r in kept) == want and all(r.lang == "a" for r in kept)
