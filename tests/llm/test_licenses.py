"""License scans against a plain search of every template at every word."""

import random
import re

from tests.llm.test_operators import documents, frame

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    from tidemark.llm.licenses import WORDINGS

    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    at = [(i, label) for phrase, label in PHRASES.items() for p in [phrase.split()] for i in range(len(w)) if w[i : i + len(p)] == p]
    labels, score = {label for _, label in at}, 1.0 if at else 0.0
    for label, wording in WORDINGS:
        own, must, inside = [], [], False
        for x in wording.replace("[", "[ ").replace("]", " ]").split():
            if x in "[]":
                inside = x == "["
            else:
                must.append(inside)
                own.append(x)
        for i in range(-len(own), len(w)):
            same = [0 <= i + j < len(w) and w[i + j] == x for j, x in enumerate(own)]
            if all(s for s, m in zip(same, must) if m):
                labels.add(label)
                score = max(score, sum(same) / len(own))
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})), ",".join(sorted(labels)), round(score, 12)


def rows():
    from tidemark.llm.licenses import BASE, WORDINGS

    rng = random.Random(11)
    lines = ["Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "under the mit\x00license", "under the Mİt license", "CC  BY\nNC", "cc by nc cc by nc", "license license under the license"]
    lines += [w.translate({91: "", 93: ""}).title() for _, w in [*BASE, *WORDINGS]]
    out = []
    for i in range(150):
        words = [rng.choice(["the", "license", "under", "gnu", "été", "x1", "2", "漢字", "İ", "public"]) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            line = rng.choice(lines).split(" ")
            if rng.random() < 0.4:
                line[rng.randrange(len(line))] = "other"
            k = rng.randint(0, len(words))
            words[k:k] = line
        out.append((i, rng.choice([" ", "-", "\t"]).join(words)))
    return out + documents() + [(500 + i, x) for i, x in enumerate(lines)] + [(600, "by " * 5000 + "cc by nc"), (3, "cc by nc"), (3, "cc by nc"), (None, "cc by nc"), (None, None)]


COLUMNS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]


def test_scan_is_the_plain_search(spark):
    from tidemark.llm.licenses import scan

    some = rows()
    got = [(r.doc_id, *[r[c] for c in COLUMNS[:-1]], round(r.score, 12)) for r in scan(frame(spark, some)).collect()]
    assert sorted(map(repr, got)) == sorted(repr((i, *plain(t))) for i, t in some)
    assert sum(r[2] > 0 for r in got) > 30 and sum(bool(r[6]) and not r[5] for r in got) > 20


def test_rare_words_only_steer_the_search(spark, monkeypatch):
    from tidemark.llm import licenses

    some = rows()
    want = sorted(map(repr, licenses.scan(frame(spark, some)).drop("places").collect()))
    monkeypatch.setattr(licenses, "document_frequencies", lambda docs, vocabulary: {w: -len(w) for w in vocabulary})
    assert sorted(map(repr, licenses.scan(frame(spark, some)).drop("places").collect())) == want


def test_empty_table_and_plan(spark):
    from tidemark.llm.licenses import scan

    assert scan(frame(spark, [])).count() == 0
    plan = scan(frame(spark, rows()))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
