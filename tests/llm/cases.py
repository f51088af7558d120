"""Small documents with the odd cases: nulls, empty and long texts, copies, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, start long, kept string, stays long, score double"


def odd_rows(seed: int = 1, n: int = 60) -> list[tuple]:
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Żół", "x", "zz,", "A1"] + [f"w{i}" for i in range(400)])
    texts: list[str | None] = [None, "", " ", "\n\t", "one", "Two words", "a b c", "x " * 3000]
    passage = " ".join(word() for _ in range(70))
    texts += [passage, passage]
    while len(texts) < n:
        t = [word() for _ in range(r.randint(1, 150))]
        kind = r.random()
        if kind < 0.3:
            t[len(t) // 2:len(t) // 2] = passage.split()
        elif kind < 0.6:
            old = (r.choice([x for x in texts if x]) or "x").split() or ["x"]
            t = old[:]
            if r.random() < 0.7:
                t[r.randrange(len(t))] = word()
        texts.append(r.choice([" ", "\n"]).join(t))
    return [(i, t, None, "s", None, 7, "clash", 3, 0.5) for i, t in enumerate(texts)]


def frame(spark, rows: list[tuple]):
    return spark.createDataFrame(rows, SCHEMA)
