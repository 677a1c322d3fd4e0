"""The stages of corpus_pipeline on rows with nulls, repeats, long texts and clashing columns, against plain versions."""

import random
import re
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from tidemark.llm import packing, quality, toxicity
from tidemark.llm._shared import new_path

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
#: Names that stages use for columns of their own, and one that must be quoted.
CLASHING = ["lang", "source", "kept", "n_words", "n_removed", "_", "_row", "_kept", "rest", "flags", "a.b", "digest", "whole"]
SCHEMA = "doc_id long, text string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHING)
SCHEMA_LABELS = "doc_id long, quality int, toxic int"


def row(i, text):
    return (i, text, None if text is None else len(text), *(f"{c}{i}" for c in CLASHING))


def corpus():
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(3000)]
    words = lambda n: [rng.choice(vocabulary) + rng.choice(["", "", "", ".", ","]) for _ in range(n)]
    passage, rows = words(55), []
    for i in range(220):
        own = words(rng.randint(30, 120))
        if i % 9 == 0:
            own = [w.upper() + "!!" for w in own]
        elif i % 7 == 0:
            own[rng.randrange(len(own))] = rng.choice(["idiot", "scum", "moron", "trash"])
        elif i % 5 == 0:
            own[len(own) // 2 : len(own) // 2] = passage
        rows.append((i, " ".join(own)))
    rows += [(300, rows[1][1]), (301, rows[2][1].replace(" ", "\n")), (302, rows[3][1] + " more"), rows[4], rows[4], (None, rows[6][1]), (None, "Only here " + " ".join(words(40))), (8, " ".join(words(50)))]
    return rows + [(400, None), (401, ""), (402, " \n"), (None, None), (403, " " * 1_000_000), (404, "\n" * 1_000_000), (405, "a" * 1_000_000), (406, " ".join(words(30000)))]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [row(*r) for r in corpus()]
    folder = new_path(spark, "tables")
    toxic = [(i, 1, int(bool(re.search("idiot|scum|moron|trash", t)))) for i, t in corpus() if i is not None and t and i < 220 and i % 4]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(toxic, SCHEMA_LABELS).write.parquet(f"{folder}/labels.parquet")
    return spark.read.parquet(f"{folder}/documents.parquet"), folder


def values(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def shingles(text):
    words = [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in WORD.findall((text or "").encode())]
    return frozenset(tuple(words[k : k + 5]) for k in range(len(words) - 4)) or (frozenset([tuple(words)]) if words else frozenset())


def plain_near(rows):
    """One row for each class of rows, classes as lists of rows."""
    sets = [shingles(r[1]) for r in rows]
    head = list(range(len(rows)))

    def find(k):
        while head[k] != k:
            k = head[k]
        return k

    for a, b in combinations([k for k in range(len(rows)) if sets[k]], 2):
        if sets[a] == sets[b] or (min(len(sets[a]), len(sets[b])) * 5 >= 4 * max(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])):
            x, y = sorted((find(a), find(b)))
            head[y] = x
    classes = {}
    for k, r in enumerate(rows):
        classes.setdefault(find(k) if sets[k] else -1 - k, []).append(r)
    return [min(c, key=lambda r: (r[0] is None, r[0] or 0)) for c in classes.values()]


def plain_substring(rows):
    from xxhash import xxh64_intdigest

    signed = lambda t: (x := xxh64_intdigest(t.encode(), 42)) - (1 << 64 if x >> 63 else 0)
    seen, texts = {}, {(i, t) for i, t, *_ in rows if t is not None}
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0, signed(r[1]))):
        words = WORD.findall(t.encode())
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen[w] = True
        texts_left = b" ".join(w for w, g in zip(words, gone) if not g).decode()
        seen[i, t] = texts_left if any(gone) else t
    out = []
    for i, t, n, *rest in rows:
        left = None if t is None else seen[i, t]
        out.append((i, left, n if left == t else len(left), *rest))
    return out


def test_filters(spark, tables):
    docs, folder = tables
    rows = values(docs)
    model = quality.fit(docs)
    kept = corpus_pipeline.quality_stage(spark, docs, folder)
    assert kept.columns == docs.columns
    scores, _ = model.score([r[1] for r in rows])
    assert values(kept) == [r for r, s in zip(rows, scores) if s >= 0.5]
    left = {r[0] for r in values(kept)}
    assert not left & {i for i in range(220) if i % 9 == 0 and i != 0} and not left & {400, 401, 402, 403, 404} and None in left
    assert len([i for i in range(220) if i % 9 and i not in left]) == 0
    clean = corpus_pipeline.toxicity_stage(spark, docs, folder)
    chain = toxicity.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    said = chain.score([r[1] for r in rows])[:, -1]
    assert values(clean) == [r for r, p in zip(rows, said) if p < chain.cut]
    gone = {r[0] for r in rows} - {r[0] for r in values(clean)}
    planted = {i for i, t in corpus() if t and re.search("idiot|scum|moron|trash", t) and i is not None}
    assert len(gone & planted) >= 0.9 * len(planted) and not gone - planted and {400, 401, 402} <= {r[0] for r in values(clean)}


def test_near_dedup(spark, tables):
    docs, folder = tables
    out = corpus_pipeline.near_dedup_stage(spark, docs, folder)
    assert out.columns == docs.columns
    got, want = values(out), plain_near(values(docs))
    key = lambda rows: sorted((r[0] is None, r[0] or 0) for r in rows)
    assert key(got) == key(want)
    assert set(got) <= set(values(docs))


def test_substring(spark, tables):
    docs, folder = tables
    out = corpus_pipeline.substring_stage(spark, docs, folder)
    assert out.columns == docs.columns and out.schema == docs.schema
    assert values(out) == sorted(plain_substring(values(docs)), key=str)


def test_packing_whole(spark, tables):
    """Ids, cuts, places and number of sequences against a plain version."""
    import zlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs, folder = tables
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    want = []
    for r in values(docs):
        ids = np.array([*encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        head = (len(ids) - 1) % 2048 + 1
        cuts = [0, *range(head, len(ids) + 1, 2048)]
        want += [(r[0], k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    got = corpus_pipeline.packing_stage(spark, docs, folder).collect()
    assert sorted([tuple(r)[:5] for r in got], key=str) == sorted(want, key=str)
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [sum(n for _, n in found[:k]) for k in range(len(found))] and sum(n for _, n in found) <= 2048
    assert len(places) <= 1.03 * sum(w[3] for w in want) / 2048 + 1


def test_reduction_keeps_the_optimum():
    """Sequences of the plan against exhaustive packing of small cases."""

    def fewest(pieces, room):
        best = len(pieces)

        def go(k, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if k == len(pieces):
                best = len(bins)
                return
            for b in {x: j for j, x in enumerate(bins)}.values():
                if bins[b] + pieces[k] <= room:
                    bins[b] += pieces[k]
                    go(k + 1, bins)
                    bins[b] -= pieces[k]
            go(k + 1, [*bins, pieces[k]])

        go(0, [])
        return best

    rng, more = random.Random(5), 0
    for _ in range(150):
        room = rng.choice([10, 17, 30])
        pieces = sorted((rng.randint(1, room) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = packing.Plan({n: pieces.count(n) for n in set(pieces)}, room)
        lower = fewest(pieces, room)
        left = list(pieces)
        for length, _, each, _, n, _ in [r for r in plan.runs if r[3] < plan.fixed]:
            for _ in range(each * n):
                left.remove(length)
        assert plan.fixed + (fewest(left, room) if left else 0) == lower  # what is fixed never costs a sequence
        more += plan.sequences - lower
    assert more <= 5  # best fit of the rest


def test_near_dedup_recall(spark):
    """Exact links of five-word shingles at sf0.01, found by an inverted index: all are in one class."""
    from tidemark.llm.minhash import Near, near_duplicates

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    index = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    pairs = {p for group in index.values() for p in combinations(sorted(group), 2)}
    links = [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, Near(words=5)).collect()}
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)


def test_whole_chain(spark, tables):
    docs, folder = tables
    out = corpus_pipeline.run(spark, folder)
    assert set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 100
    step = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        step = spark.createDataFrame(values(stage(spark, step, folder)), SCHEMA)
    want = corpus_pipeline.packing_stage(spark, step, folder)
    assert values(out.select("doc_id", "piece", "start", "length", "ids_crc32")) == values(want.select("doc_id", "piece", "start", "length", "ids_crc32"))


def test_empty_tables(spark, tables):
    docs, folder = tables
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), folder).count() == 0, name
