import itertools

import pytest

from siemloom.llm import components, jaccard_join
from siemloom.llm.jaccard_join import similar
from tests.llm.cases import frame, odd_rows

LOW = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def brute(rows, n, percent):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().translate(LOW).split()
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    for _ in sets:
        for a, b in itertools.combinations(sets, 2):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                root[a] = root[b] = min(root[a], root[b])
    return {i: (len(sets[i]), root[i]) for i in sets}


@pytest.mark.parametrize("n,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 60, 4)])
def test_equals_brute_force(spark, n, percent, seed):
    rows = odd_rows(seed, 120)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar(frame(spark, [*rows, (None, "no id", *rows[0][2:])]), n, percent).collect()}
    assert got == brute(rows, n, percent)


def test_chain_of_many(spark):
    """Neighbours are similar, ends are not: one component."""
    words = [f"v{i}" for i in range(700)]
    rows = [(i, " ".join(words[i:i + 100]), None, None, None, None, None, None, None) for i in range(600)]
    assert {r.component_id for r in similar(frame(spark, rows), 3, 90).collect()} == {0}


def test_empty_and_repeated_rows(spark):
    rows = odd_rows()
    assert similar(frame(spark, []), 3, 90).count() == 0
    assert similar(frame(spark, rows + rows), 3, 90).count() == 2 * len(rows)


def test_texts_that_share_an_id(spark):
    """Each row is a document; row order doesn't matter, nor do partitions whose texts have no words."""
    a, b = " ".join(f"a{i}" for i in range(300)), " ".join(f"b{i}" for i in range(300))
    rows = [(5, a), (5, b), (9, b + " more"), (9, ""), (12, a + " x"), (12, None), (14, "one two")]
    want = sorted([(5, 298, 5), (5, 298, 5), (9, 299, 5), (9, 0, 9), (12, 299, 5), (12, 0, 12), (14, 1, 14)])
    for order in (rows, rows[::-1], [rows[1], rows[0], *rows[2:]]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(5, "text")
        assert sorted(map(tuple, similar(docs, 3, 90).collect())) == want
    alone = spark.createDataFrame([(1, "")], "doc_id long, text string")
    assert [tuple(r) for r in similar(alone, 3, 90).collect()] == [(1, 0, 1)]


def test_few_rows_in_many_partitions(spark, monkeypatch):
    """Checkpoints of few rows are few files, whatever the partitions; the rows are the same."""
    files = []

    class Frame:
        def __init__(self, partitions):
            self.sparkSession, self.partitions = spark, partitions

        def coalesce(self, n):
            return Frame(min(n, self.partitions))

        def checkpoint(self):
            files.append(self.partitions)

    for tasks in (None, 1, 100):
        components.cut(Frame(211), tasks)
    least = components.TASKS * spark.sparkContext.defaultParallelism
    assert files == [211, least, max(100, least)]
    asked, cut = [], components.cut

    def counted(df, tasks=None):
        asked.append(tasks)
        return cut(df, tasks)

    monkeypatch.setattr(components, "TASKS", 1)
    monkeypatch.setattr(components, "cut", counted)
    monkeypatch.setattr(jaccard_join, "cut", counted)
    rows = odd_rows(3, 40)
    got = similar(frame(spark, rows).repartition(9), 3, 90).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 90)
    assert len(asked) > 5 and set(asked) == {1}
