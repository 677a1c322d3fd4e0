import random

import corpus_pipeline
from tidemark.llm.minhash import Near, near_duplicates

SCHEMA = "doc_id long, text string, lang string, id long, component string, u int"


def shingles(text, w):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return {tuple(words[i : i + w]) for i in range(len(words) - w + 1)} if len(words) >= w else {tuple(words)} if words else set()


def brute(rows, w):
    sets = {i: shingles(t, w) for i, t in rows}
    head = {i: i for i in sets}

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                head[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(40):
        base = [rng.choice(vocab) for _ in range(rng.choice([1, 3, 6, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 5, 12])):
            words = list(base)
            for _ in range(rng.randint(0, 1 + len(words) // 30)):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((len(rows), rng.choice([" ", "\n", "  "]).join(words)))
    rows += [(len(rows), None), (len(rows) + 1, ""), (len(rows) + 2, " \t"), (len(rows) + 3, "x " * 30000), (len(rows) + 4, "X " * 30000)]
    return rows


def run(spark, rows, near):
    df = spark.createDataFrame([(i, t, "en", 1, "z", 2) for i, t in rows], SCHEMA)
    return {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, near).collect()}


def test_against_brute_force(spark):
    rows = corpus(3)
    assert run(spark, rows, Near(words=4)) == brute(rows, 4)


def forms(n, changed, seed):
    rng = random.Random(seed)
    form = [f"f{i}" for i in range(400)]
    rows = []
    for i in range(n):
        words = list(form)
        for at in rng.sample(range(400), changed):
            words[at] = f"x{rng.randrange(100000)}"
        rows.append((i, " ".join(words)))
    return rows


def test_dense_buckets(spark):
    rows = corpus(7) + [(1000 + i, t) for i, t in forms(60, 7, 1)]
    want = brute(rows, 5)
    assert run(spark, rows, Near(words=5, sparse=0)) == want
    assert run(spark, rows, Near(words=5, sparse=0, shingles=5000)) == want


def test_forms_tell_no_more_pairs_than_rows_allow(spark, monkeypatch):
    """Hundreds of texts of one form, their likeness about the threshold: pairs told in the last round stay below `sparse` a row and bucket."""
    from tidemark.llm import minhash

    told, candidates = [], minhash._candidates

    def counting(*args):
        pairs = candidates(*args)
        told.append((args[-1], pairs.count()))
        return pairs

    monkeypatch.setattr(minhash, "_candidates", counting)
    rows = forms(300, 7, 2)
    assert run(spark, rows, Near(words=5)) == brute(rows, 5)
    assert sum(n for nearest, n in told if not nearest) <= 4 * len(rows) * 64
    assert sum(n for nearest, n in told if not nearest) < 300 * 299 // 8


def test_split_buckets(spark):
    rows = corpus(5)
    assert run(spark, rows, Near(words=5, block=3)) == brute(rows, 5)


def test_empty(spark):
    assert run(spark, [], Near()) == {}


def test_null_and_repeated_ids(spark):
    long = " ".join(f"w{i}" for i in range(80))
    near, other, third = long.replace("w40", "x"), long.upper().replace("W", "y"), " ".join(f"z{i}" for i in range(30))
    rows = [(None, long), (9, near), (4, other), (4, third), (4, other), (None, third + " end"), (None, "only null ids"), (None, "only null ids"), (None, "alone"), (None, None), (None, ""), (7, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, f"tag{k}", k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, id string, n int")
    sort = lambda x: sorted(x, key=str)
    got = [(r.doc_id, r.component_id, r.kept) for r in near_duplicates(docs, Near(words=4)).collect()]
    want = [(None, 9, False), (9, 9, True), (4, 4, True), (4, 4, True), (4, 4, False), (None, 4, False), (None, None, True), (None, None, False), (None, None, True)]
    assert sort(got) == sort(want + [(None, None, True)] * 2 + [(7, 7, True)] * 2)

    out = corpus_pipeline.near_dedup_stage(spark, docs, "")
    assert out.columns == docs.columns
    texts = [(9, near), (4, other), (4, third), (None, "only null ids"), (None, "alone"), (None, None), (None, ""), (7, ""), (7, "")]
    left = out.collect()
    assert sort((r.doc_id, r.text) for r in left) == sort(texts)
    assert all((r.doc_id, r.text, r.id) == (*rows[r.n], f"tag{r.n}") for r in left)
