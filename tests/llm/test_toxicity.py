"""What the toxicity chain learns beyond its seed words."""

import random

import numpy as np

from tests.llm.test_operators import frame


def test_words_that_are_no_seeds(spark):
    from tidemark.llm import toxicity

    rng, planted = random.Random(8), ["zorbax", "quiltnik", "vembly"]
    assert not {w for own in toxicity.SEEDS.values() for w in own} & set(planted)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9)))
    rows, toxic = [], set()
    for i in range(600):
        words = [word() for _ in range(rng.randint(20, 120))]
        if i % 6 == 0:
            words[rng.randrange(len(words))] = rng.choice(planted) + rng.choice(["", "!", ",", "s"])
            toxic.add(i)
        rows.append((i, " ".join(words)))
    df = frame(spark, rows)
    chain = toxicity.fit(df, spark.createDataFrame([(i, int(i in toxic)) for i in range(300)], "doc_id long, toxic int"))
    said = {r.doc_id: r for r in toxicity.scored(df, chain).collect()}
    held = set(range(300, 600))
    assert len({i for i in held & toxic if said[i].toxic}) >= 0.9 * len(held & toxic) and not any(said[i].toxic for i in held - toxic)
    assert all(said[i].p_veiled > 0.5 for i in held & toxic if said[i].toxic)  # no seed word is there, so they are veiled


def test_a_link_is_the_plain_minimum():
    from tidemark.llm._linear import Rows, logistic

    rng = np.random.default_rng(4)
    dense = (rng.random((300, 12)) < 0.2).astype(float)
    y = (rng.random(300) < 1 / (1 + np.exp(1 - 2 * dense[:, 0] - dense[:, 1]))).astype(float)
    row, column = np.nonzero(dense)
    w = logistic(Rows(row, column, np.ones(len(row)), 12, np.ones((300, 1))), y, l2=1e-2, steps=5000, still=1e-9)
    x, v = np.append(dense, np.ones((300, 1)), axis=1), np.zeros(13)
    for _ in range(50):  # Newton's method on the mean loss
        p = 1 / (1 + np.exp(-x @ v))
        v -= np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) / 300 + 1e-2 * np.eye(13), x.T @ (p - y) / 300 + 1e-2 * v)
    assert np.abs(w - v).max() < 1e-4
