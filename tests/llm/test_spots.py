"""Fingerprints against spot signatures built in Python."""

import hashlib
import random
import re

import pytest

from tests.llm.test_operators import documents, frame


def signatures(text):
    from tidemark.llm.spots import ANCHORS

    words = [w for w in re.split(r"[\W_]+", text.lower()) if w]
    out = set()
    for i, w in enumerate(words):
        if w in ANCHORS:
            chain = [x for x in words[i:] if x not in ANCHORS][:2]
            if len(chain) == 2:
                out.add((w, *chain))
    return out or set(words)


def jaccard(a, b):
    return 1.0 if a == b else 0.0 if not a or not b else len(a & b) / len(a | b)


def check(spark, rows, blocks):
    from tidemark.llm.spots import fingerprints

    got = fingerprints(frame(spark, rows), blocks).collect()
    assert len(got) == len(rows)
    mark = {r[0]: r[1] for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").selectExpr("t", "xxhash64(t)").distinct().collect()}
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, mark[r[1]]))
    want = []
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(jaccard(signatures(t), signatures(edited)), 9), round(jaccard(signatures(t), signatures(after)), 9)))
    assert sorted(map(repr, ((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in got))) == sorted(map(repr, want))
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, r.n_signatures)
        assert len(r.fingerprint) == 8 * r.n_signatures


@pytest.mark.parametrize("blocks", [1, 4, 64])
def test_fingerprints_are_spot_signatures(spark, blocks):
    rng = random.Random(blocks)
    hot = [(7, " ".join(rng.choice(["the", "of", "and", "été", "漢字", "a1", *map(str, range(30))]) for _ in range(rng.randint(0, 40)))) for _ in range(60)]
    check(spark, documents() + hot, blocks)
    check(spark, hot + [(None, t + " x") for _, t in hot] + [(None, None), (-5, "the last one"), (-5, "the last one")], blocks)


@pytest.mark.parametrize("rows", [[], [(3, "the only one here")], [(None, "the only one here")], [(None, "a b"), (1, "c d"), (2, "the e f")], [(None, None), (None, "")]])
def test_small_tables(spark, rows):
    check(spark, rows, 8)
