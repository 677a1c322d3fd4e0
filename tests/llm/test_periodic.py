"""Runs of repeated words against brute force."""

import hashlib
import random
import re
from fractions import Fraction
from zlib import crc32

import numpy as np

from tests.llm.test_operators import documents, frame


def brute(w, least, times):
    """(start, length, period) of all maximal stretches, by trying every period at every place."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                out.setdefault((i, j + q - i), q)  # periods rise, so the first is the smallest
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def sequences():
    rng = random.Random(3)
    fib = ["a", "ab"]
    while len(fib[-1]) < 150:
        fib.append(fib[-1] + fib[-2])
    yield from (list(x) for x in ("", "a", "aaaaa", "aaaaaa", "a" * 300, fib[-1], "abcabcabcabc", "abababab", "abaababaabaababaababa" * 5))
    for _ in range(400):
        n, k = rng.randint(1, 90), rng.choice([1, 2, 2, 3, 5, 40])
        w = [str(rng.randrange(k)) for _ in range(n)]
        for _ in range(rng.randint(0, 2)):
            a, p = rng.randrange(n), rng.randint(1, 12)
            w[a:] = [w[a + i % min(p, n - a)] for i in range(n - a)]
            w += [str(rng.randrange(k)) for _ in range(rng.randint(0, 9))]
        yield w


def test_runs_are_all_there_are():
    from tidemark.llm.periodic import document_runs, runs_of

    every = list(sequences())
    for w in every:
        names = {x: i for i, x in enumerate(dict.fromkeys(w))}
        codes = np.array([names[x] for x in w] + [len(names)])
        assert sorted(map(tuple, runs_of(codes, np.full(len(codes), len(codes))).tolist())) == brute(w, 2, 2)
    for least, times in ((6, 4), (6, 2), (9, 3)):
        names = {x: i for i, x in enumerate(dict.fromkeys(x for w in every for x in w))}
        got = document_runs(np.array([names[x] for w in every for x in w]), [len(w) for w in every], least, times)
        assert got == [(i, *r) for i, w in enumerate(every) for r in brute(w, least, times)]


def test_query_against_brute_force(spark, tmp_path):
    from tidemark.llm.queries import op12_runs

    rows = documents() + [(200 + i, " ".join(w)) for i, w in enumerate(sequences())] + [(205, "a b"), (None, "y " * 9), (None, None)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    want = []
    for i, text in rows:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
        h, n = crc32(str(i).encode()), len(w)
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[x] if x < a else w[a + (x - a) % p] for x in range(n)]
        runs = brute(w, 6, 4)
        gone = {x for s, length, q in runs for x in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((
            i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest(),
        ))
    got = [tuple(r) for r in op12_runs(spark, str(tmp_path)).select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 100


def test_empty_table_and_long_text(spark):
    from tidemark.llm.periodic import periodic_runs

    assert periodic_runs(frame(spark, [])).count() == 0
    rng = random.Random(5)
    phrase = [str(rng.random()) for _ in range(9000)]
    row = periodic_runs(frame(spark, [(1, " ".join(["start", *phrase * 5, "end"]))])).first()
    assert [tuple(r) for r in row.runs] == [(1, 45000, 9000)] and row.collapsed == " ".join(["start", *phrase, "end"])
