"""Fits of the scorers are one task each, so their memory is held to what their entries need."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa


def peak(run, batch: pa.RecordBatch) -> tuple[list[pa.RecordBatch], float]:
    """What the task yields, and the most MB that it held."""
    tracemalloc.start()
    try:
        out = list(run(iter([batch])))
        return out, tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def texts(n: int, words: int) -> list[str]:
    rng = random.Random(5)
    known = ["".join(rng.choice("abdeilnorst") for _ in range(rng.randint(3, 9))) for _ in range(3000)]
    return [" ".join(rng.choices(known, k=words)) for _ in range(n)]


def test_a_toxicity_fit_holds_two_narrow_numbers_an_entry():
    from tidemark.llm import toxicity

    toxic = np.arange(1500) < 300
    said = [f"{t} idiot" if bad else t for t, bad in zip(texts(1500, 300), toxic)]
    batch = pa.RecordBatch.from_arrays([pa.array(said), pa.array(toxic.astype(np.int32)), pa.array(np.arange(1500))], names=["text", "toxic", "mark"])
    out, mb = peak(toxicity._train(0.003), batch)
    chain = toxicity.Chain([(np.array(r["words"], np.int64).view(np.uint64), np.array(r["weights"])) for r in out[0].to_pylist()], out[0].column("cut")[0].as_py())
    assert ((chain.score(said)[:, -1] >= chain.cut) == toxic).all()
    assert mb < 130  # 84 as it is, 194 with whole batches and entries of three wide numbers


def test_a_quality_fit_holds_no_entry_twice():
    from tidemark.llm import quality

    batch = pa.RecordBatch.from_arrays([pa.array(texts(2000, 300))], names=["text"])
    out, mb = peak(quality._train({}, 3), batch)
    assert len(out[0].column("weights")[0]) == quality.SIZE + quality.FIGURES
    assert mb < 120  # 72 as it is, 195 before


def test_entries_without_values_are_ones():
    from tidemark.llm._linear import Rows

    rng = np.random.default_rng(3)
    dense = rng.random((40, 7)) < 0.3
    row, column = (x.astype(np.int32) for x in np.nonzero(dense))
    mixed = rng.permutation(len(row))
    keep, columns, y = rng.random(40) < 0.5, rng.random(7) < 0.6, (rng.random(40) < 0.4).astype(float)
    for order in (np.arange(len(row)), mixed):
        x = Rows(row[order], column[order], None, 7, np.ones((40, 1)))
        part = x.of(keep, columns)
        plain = np.append(dense[keep][:, columns], np.ones((keep.sum(), 1)), axis=1)
        assert np.allclose(part.dot(np.arange(1.0, plain.shape[1] + 1)), plain @ np.arange(1.0, plain.shape[1] + 1))
        assert np.allclose(part.back(np.arange(keep.sum()) + 1.0), plain.T @ (np.arange(keep.sum()) + 1.0))
        assert np.allclose(x.scaled(np.arange(8.0)).dot(np.ones(8)), dense @ np.arange(7.0) + 7) and np.allclose(x.squares(), np.append(dense.mean(0), 1))
        times, sums = x.counts(keep, y)
        assert (times == dense[keep].sum(0)).all() and (sums == y[keep] @ dense[keep]).all()


def test_texts_of_one_arrow_batch_are_read_by_parts():
    from tidemark.llm import minhash, substring

    n = 2500
    said = pa.RecordBatch.from_arrays([pa.array(range(n)), pa.array(range(n)), pa.array(texts(n, 300))], names=["doc", "digest", "text"])
    for task in (substring._occurrences(20), minhash._describe(minhash.Near(words=5, percent=80))):
        out, mb = peak(task, said)
        assert sum(b.num_rows for b in out) >= n
        assert mb < 110  # 56 as it is, 195 and 199 with whole batches
