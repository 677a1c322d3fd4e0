"""The operators on small tables with nulls, empty and long texts, ties, repeated rows and extra columns."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, key string, start int, n int"


def documents(seed=1):
    rng = random.Random(seed)
    vocab = ["the", "of", "and", "is", "le", "der"] + [f"w{i}" for i in range(300)]
    passage = [rng.choice(vocab) for _ in range(45)]
    rows = []
    for i in range(60):
        words = [rng.choice(vocab) for _ in range(rng.choice([0, 1, 5, 19, 20, 21, 90, 400]))]
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = passage[: rng.choice([19, 20, 45])]
        rows.append((i * 7 % 61, rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(100, None), (101, ""), (102, " \n"), (103, "x " * 3000), (104, rows[0][1]), (105, "été ñ 漢字 <|endoftext|> \U0001f600"), (None, rows[3][1])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1, 2) for i, t in rows], SCHEMA)


def test_substring_brute_force(spark):
    from tidemark.llm.substring import repeats_removed

    rows = [r for r in documents() if r[0] is not None]
    seen, want = set(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        words = WORD.findall((t or "").encode())
        gone = [False] * len(words)
        for s in range(len(words) - 19):
            w = tuple(words[s : s + 20])
            if w in seen:
                gone[s : s + 20] = [True] * 20
            seen.add(w)
        want[i] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone) if not g).decode())
    for bucket in (1000, 1):  # 1: every repeated bucket is dealt out window by window
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in repeats_removed(frame(spark, rows), bucket=bucket).collect()}
        assert got == want
    twice = repeats_removed(frame(spark, documents() + [rows[0]])).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in twice}[rows[0][0]] == 2
    assert repeats_removed(frame(spark, [])).count() == 0


def test_top_k_brute_force(spark):
    from tidemark.llm.topk import top_k

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[3]
    rows = [(i, [float(v) for v in x[i]], 0) for i in range(300)]
    rows += [(400, None, 0), (401, [float("nan")] * 16, 0), (402, [None] + [1.0] * 15, 0), (500, [1.0, 2.0], 0), (501, [1.0, 3.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 100 == 0).collect()}
    v = np.floor(x.astype(np.float64) * 1024).astype(np.int64)
    for q in (0, 100, 200):
        best = sorted((-int(v[i] @ v[q]), i) for i in range(300) if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert got[500, 1] == (501, 1024 * 1024 + 2048 * 3072) and (500, 2) not in got and (400, 1) not in got
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_fingerprints(spark):
    from tidemark.llm.spots import fingerprints, similar

    rows = [r for r in documents() if r[0] is not None]
    got = {r.doc_id: r for r in fingerprints(frame(spark, rows), blocks=5).collect()}
    order = sorted(rows)
    for (i, t), (j, n) in zip(order, order[1:] + order[:1]):
        t, n = t or "", n or ""
        edited = t[: len(t) - len(t) // 2] + n[: len(t) // 2]
        assert got[i].n_chars == len(t) and got[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b = (set(re.findall("........", x)) for x in (got[i].fingerprint, got[j].fingerprint))
        assert got[i].near_next == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[104].fingerprint == got[rows[0][0]].fingerprint and got[100].fingerprint == ""
    pairs, members = similar(frame(spark, rows), 0.5)
    prints = {i: set(re.findall("........", g.fingerprint)) for i, g in got.items() if g.fingerprint}
    heads = {}
    for i in sorted(prints):
        heads.setdefault(got[i].fingerprint, i)
    reps = sorted(heads.values())
    want = {(a, b) for a in reps for b in reps if a < b and len(prints[a] & prints[b]) >= 0.5 * len(prints[a] | prints[b])}
    assert {(r.a, r.b) for r in pairs.collect()} == want
    assert {r.doc_id: r.a for r in members.collect()} == {i: heads[got[i].fingerprint] for i in prints}
    one, two = ("the " + " ".join(f"{w}{i} the" for i in range(30)) for w in ("red", "blue"))
    pairs, members = similar(frame(spark, [(7, one), (7, two), (8, one + " red30"), (None, two + " blue30 blue31")]), 0.8)
    assert {(r.a, r.b) for r in pairs.collect()} == {(7, 8), (7, None)}
    assert similar(frame(spark, []))[0].count() == 0
    assert fingerprints(frame(spark, [])).count() == 0


def test_packing(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    from tidemark.llm.packing import Plan, pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = documents() + [documents()[1]]
    out = pack(frame(spark, rows), path, capacity=256).collect()
    encode = Tokenizer.from_file(path)
    want = sorted(zlib.crc32(np.array(encode.encode(t or "", add_special_tokens=False).ids + [0], "<u4").tobytes()) for _, t in rows if t is None or len(t) < 200)
    got = sorted(r.ids_crc32 for r in out)
    assert all(x in got for x in want)
    places = {}
    for r in out:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for found in places.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 256
    rng = random.Random(4)
    for _ in range(60):
        cap = rng.choice([10, 30, 100])
        counts = {rng.randint(1, cap): rng.randint(1, 9) for _ in range(rng.randint(0, 14))}
        plan = Plan(dict(counts), cap)
        fill, seats = {}, {n: [] for n in counts}
        for length, rank, each, first, n, offset in plan.runs:
            for i in range(each * n):
                seats[length].append(rank + i)
                fill.setdefault(first + i // each, []).append((offset + i % each * length, length))
        assert all(sorted(seats[n]) == list(range(c)) for n, c in counts.items())
        for found in fill.values():
            found.sort()
            assert [o for o, _ in found] == [sum(x for _, x in found[:i]) for i in range(len(found))] and sum(x for _, x in found) <= cap


def test_bpe_round_trip(spark):
    import public_tokenizers as p
    import tiktoken

    from tidemark.llm.bpe import Merges, digests, encode_decode, read_ranks

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = documents() + [(200, "aaaaaaaaaaaaaaaaaaaaaaa" * 40 + " ababababab zzzzz...... \x00\x01"), (201, "".join(chr(i) for i in range(1, 3000)))]
    for chunk, keep in ((1, 3), (1 << 20, 1000)):  # 1: a chunk for every few texts
        got = encode_decode(frame(spark, rows), path, p.PATTERN, chunk=chunk, keep=keep).collect()
        assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
        for r in got:
            text = next(t for i, t in rows if i == r.doc_id) or ""
            assert list(r.ids) == real.encode_ordinary(text) and bytes(r.decoded).decode() == text
    short = {r.doc_id: r for r in digests(frame(spark, rows), path, p.PATTERN).collect()}
    for i, text in rows:
        ids = real.encode_ordinary(text or "")
        assert short[i].n_tokens == len(ids) and short[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert short[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert digests(frame(spark, []), path, p.PATTERN).count() == 0
    # a vocabulary out of training order, in which merges make pairs of lower rank
    odd = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 9, b"abc": 2, b"bc": 10, b"cab": 1, b"ca": 12}
    merges = Merges(odd)
    words = ["".join(random.Random(i).choice("abc") for _ in range(40)).encode() for i in range(50)]
    assert merges.replay(words) == [merges.alone(w) for w in words] and merges.replay([]) == []
    assert read_ranks(path) == ranks


def test_quality_and_toxicity(spark):
    from tidemark.llm import quality, toxicity

    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abdeilnorst") for _ in range(rng.randint(2, 9)))
    rows, bad, toxic = [], set(), set()
    for i in range(400):
        words = [word() + rng.choice(["", "", "", ".", ","]) for _ in range(rng.randint(20, 120))]
        if i % 7 == 0:
            words, _ = [w.upper() + "!!" for w in words], bad.add(i)
        elif i % 9 == 0:
            words, _ = [w + "$$$" for w in words], bad.add(i)
        elif i % 5 == 0:
            words[rng.randrange(len(words))] = rng.choice(["idiot", "Scum,", "trash.", "moron", "loser"])
            toxic.add(i)
        rows.append((i, " ".join(words)))
    rows += [(1000, None), (1001, ""), (None, rows[1][1]), rows[2]]
    df = frame(spark, rows)
    model = quality.fit(df)
    kept = {r.doc_id: r.kept for r in quality.scored(df, model).collect()}
    assert {i for i in range(400) if not kept[i]} == bad and not kept[1000] and kept[None]
    assert quality.kept_quality(df, model).columns == df.columns and quality.kept_quality(df, model).count() == 400 - len(bad) + 2
    assert quality.scored(df.limit(0), quality.fit(df.limit(0))).count() == 0
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(0, 400, 2)] + [(None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    chain = toxicity.fit(df, labels)
    said = {r.doc_id: r.toxic for r in toxicity.scored(df, chain).collect()}
    held = set(range(1, 400, 2))  # not labelled
    assert len(held & toxic & {i for i in said if said[i]}) >= 0.9 * len(held & toxic) and not any(said[i] for i in held - toxic) and not said[1000]
    assert not any(r.toxic for r in toxicity.scored(df, toxicity.fit(df, labels.limit(0))).collect())


def test_warc_round_trip(spark):
    from tidemark.llm._shared import new_path
    from tidemark.llm.warc import read_warc, round_trip, write_warc

    html = ["<p>été</p>", "", None, "x" * 200000, "<p>été</p>", "a\r\n\r\nb", ""]
    rows = [(i + 10, None if i == 1 else f"http://e/{i}", h, "x") for i, h in enumerate(html)] + [(10, "http://e/0", "<p>été</p>", "x"), (None, "u", "n", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, digest string")
    first = {}
    for i, _, h, _ in sorted(rows[:7]):
        first.setdefault(h or "", i)
    got = round_trip(df).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(h for i, _, h, _ in rows if i == r.page_id) or ""
        data = text.encode()
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        head = first.get(text)
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id in (head, None) else ("revisit", head))
    folder = new_path(spark, "w")
    some = write_warc(df, folder, least=5).where("page_id in (11, 13)")
    assert {(r.page_id, r.record_type, len(r.payload)) for r in read_warc(some, folder).collect()} == {(11, "response", 0), (13, "response", 200000)}
    assert round_trip(df.limit(0)).count() == 0


def test_token_counts(spark):
    import public_tokenizers as p
    import tiktoken

    from tidemark.llm.tokencount import token_counts

    path = p.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    real = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = documents()
    for block in (7, 1 << 20):
        got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens) for r in token_counts(frame(spark, rows), path, p.PATTERN, block=block).collect())
        assert got == sorted((i is None, i or 0, len(real.encode_ordinary(t or ""))) for i, t in rows)
    assert token_counts(frame(spark, []), path, p.PATTERN).count() == 0
