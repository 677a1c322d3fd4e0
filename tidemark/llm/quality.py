"""Quality filter by a weak-label model and a hashed linear scorer.

Overlapping heuristics vote good, bad or nothing on each text.  Expectation-maximisation over the counts
of vote patterns of all documents, at most 3 ** 9 of them, estimates how
accurate each heuristic is without any label; a pattern's posterior is the weak label of its documents.  A
logistic scorer on hashed word shapes and text figures is trained on posteriors of at most `sample`
documents, chosen by the hash of their id and text, and scores every document.

Null and blank texts get score 0 and are not kept. Rows may repeat; null ids are kept. Extra columns
pass through `kept_quality` unchanged. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import Rows, joined, logistic, sigmoid
from ._shared import BATCH, rows_where, small, written
from ._words import Words, mix64

SIZE = 8192
FIGURES = 11
SAMPLE = 8000
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#$%&*+<=>@\\^_`{|}~")] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LETTER = _UPPER.copy()
_LETTER[97:123] = True
_LETTER[128:] = True


def figures(words: Words) -> np.ndarray:
    """Of each text: words, and shares of words that have symbols, are bars, are in capitals, shout, are plain, end a sentence, repeat the word before, are distinct."""
    data, n = words.data, len(words.first) - 1
    counts = np.diff(words.first)
    text = np.repeat(np.arange(n), counts)
    per = lambda flag: np.bincount(text[flag], minlength=n)
    run = lambda table: np.append(0, np.cumsum(table[data]))
    letters, upper, symbols = run(_LETTER), run(_UPPER), run(_SYMBOL)
    own = lambda r: r[words.ends] - r[words.starts]
    size = words.ends - words.starts
    last = data[words.ends - 1] if len(size) else np.empty(0, np.uint8)
    bars = (size == 1) & (last == ord("|"))
    bangs = (size > 2) & (last == ord("!"))
    bangs[bangs] &= data[words.ends[bangs] - 2] == ord("!")
    plain = own(letters) >= size - np.isin(last, list(b".,;:!?"))
    some = np.maximum(counts, 1)
    capital = own(upper) > 1
    distinct = np.array([len(np.unique(words.of(i))) for i in range(n)])
    again = np.zeros(len(size), dtype=bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (text[1:] == text[:-1])
    return np.stack([counts, per(own(symbols) > 0) / some, per(bars) / some, per(capital) / some, per(bangs) / some, per(plain & ~bangs & (own(letters) > 0)) / some, per(np.isin(last, list(b".?!"))) / some, per(again) / some, distinct / some], axis=1)


def repeated_lines(texts: list) -> np.ndarray:
    out = []
    for t in texts:
        lines = [x for x in (t or "").split("\n") if x.strip()]
        out.append(1 - len(set(lines)) / len(lines) if lines else 0.0)
    return np.array(out)


def votes(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """1 good, 0 bad, 2 no vote, for each text and heuristic."""

    def pick(bad: np.ndarray, good: np.ndarray) -> np.ndarray:
        return np.where(bad, 0, np.where(good, 1, 2))

    n, symbols, bars, capitals, bangs, plain, ends, again, distinct = f.T
    never = np.zeros(len(n), dtype=bool)
    return np.stack([
        pick(symbols > 0.25, never),
        pick(bars > 0.1, never),
        pick(capitals > 0.3, never),
        pick(bangs > 0.1, never),
        pick(plain < 0.75, plain > 0.9),
        pick((ends > 0.6) & (n > 20), (ends > 0.02) & (ends < 0.4)),
        pick(lines > 0.5, never),
        pick(again > 0.2, never),
        pick((distinct < 0.2) & (n >= 20) & (again > 0.05), distinct > 0.4),
    ], axis=1)


_KIND = np.full(256, 4, dtype=np.uint64)  # letters, capitals, digits, symbols, other signs
_KIND[_LETTER], _KIND[_UPPER], _KIND[48:58], _KIND[_SYMBOL] = 0, 1, 2, 3


def _slots(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, slot) of words, of pairs of words, and of runs of three words' kinds of first and last two signs."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    if not len(text):
        return
    data, two = words.data, words.ends - words.starts > 1
    ends = (_KIND[data[words.starts]] * np.uint64(5) + np.where(two, _KIND[data[words.ends - 2]], 4)) * np.uint64(256) + np.where(_KIND[data[words.ends - 1]] < 3, _KIND[data[words.ends - 1]], data[words.ends - 1].astype(np.uint64))
    slot = lambda key, salt: (mix64(key + np.uint64(salt << 40)) % np.uint64(SIZE)).astype(np.int64)
    yield text, slot(words.hashes, 1)
    inner = text[1:] == text[:-1]
    yield text[1:][inner], slot(words.hashes[:-1] * np.uint64(31) + words.hashes[1:], 2)[inner]
    yield text, slot(ends, 3)
    inner = text[2:] == text[:-2]
    yield text[2:][inner], slot((ends[:-2] << np.uint64(26)) + (ends[1:-1] << np.uint64(13)) + ends[2:], 4)[inner]


def _dense(f: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The figures of each text, and the constant."""
    return np.column_stack([f[:, 1:], lines, np.log1p(f[:, 0]) / 10, np.ones(len(f))])


def _shares(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, slot, share of the text's tokens of that sort), each text and slot once."""
    n = len(words.first) - 1
    found = [(text, slot, np.maximum(np.bincount(text, minlength=n), 1)) for text, slot in _slots(words)]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
    key = np.concatenate([text * SIZE + slot for text, slot, _ in found])
    key, place = np.unique(key, return_inverse=True)
    return key // SIZE, key % SIZE, np.bincount(place, np.concatenate([1 / total[text] for text, _, total in found]))


@dataclass(frozen=True)
class Estimate:
    """posterior of good for each pattern; for each heuristic its accuracy, the share of its votes that agree with the class, and the share of texts it votes on."""

    posterior: dict[tuple[int, ...], float]
    accuracy: list[float]
    coverage: list[float]


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 500) -> Estimate:
    """Expectation-maximisation over how many documents have each pattern of votes.

    Every heuristic has a free probability of each vote, none included, in either class. The start is the share
    of a pattern's votes that are good, with one vote for good; the class that more votes for good come from is the good one.
    """
    if not patterns:
        return Estimate({}, [], [])
    v = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], dtype=np.float64)
    good, bad = (v == 1).sum(1), (v == 0).sum(1)
    post = (good + 1) / (good + 3 * bad + 1)
    for _ in range(rounds):
        prior = np.clip((post * weight).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        odds = np.full(len(v), np.log(prior / (1 - prior)))
        for j in range(v.shape[1]):
            one, none = (np.bincount(v[:, j], p * weight, minlength=3) + 0.1 for p in (post, 1 - post))
            odds += (np.log(one / one.sum()) - np.log(none / none.sum()))[v[:, j]]
        new = sigmoid(odds)
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    if (post * good * weight).sum() * ((1 - post) * weight).sum() < ((1 - post) * good * weight).sum() * (post * weight).sum():
        post = 1 - post
    agree = ((v == 1) * post[:, None] + (v == 0) * (1 - post)[:, None]) * weight[:, None]
    votes_ = ((v < 2) * weight[:, None]).sum(0)
    return Estimate({p: float(x) for (p, _), x in zip(patterns, post)}, (agree.sum(0) / np.maximum(votes_, 1)).tolist(), (votes_ / weight.sum()).tolist())


def _voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small(batches, "text", BATCH):
        texts = batch.column("text").to_pylist()
        f = figures(Words(texts))
        v = votes(f, repeated_lines(texts))
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, row)) if n else None for row, n in zip(v.tolist(), f[:, 0])], pa.string())], names=["votes"])


def _train(posterior: dict[tuple[int, ...], float], steps: int = 150):
    """Weights from the texts of a bounded sample, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns, values, dense, ys = [], [], [], [np.zeros((0, FIGURES))], [np.zeros(0)]
        n = 0
        for batch in small(batches, "text", BATCH):
            texts = batch.column("text").to_pylist()
            words = Words(texts)
            f, lines = figures(words), repeated_lines(texts)
            text, slot, share = _shares(words)
            rows.append((text + n).astype(np.int32))
            columns.append(slot.astype(np.int32))
            values.append(share)
            dense.append(_dense(f, lines))
            ys.append(np.where(f[:, 0] > 0, [posterior.get(tuple(row), 0.5) for row in votes(f, lines).tolist()], 0.0))
            n += len(texts)
        x, y = Rows(joined(rows, np.int32), joined(columns, np.int32), joined(values, float), SIZE, np.concatenate(dense)), np.concatenate(ys)
        scale = 1 / (np.sqrt(x.squares()) + 1e-2)
        x = x.scaled(scale)
        w = logistic(x, y, l2=1e-3, steps=steps) * scale
        yield pa.RecordBatch.from_arrays([pa.array([w.tolist()], pa.list_(pa.float64()))], names=["weights"])

    return run


class Model:
    """estimate: of the heuristics; weights: SIZE of hashed slots, then those of the figures."""

    def __init__(self, found: Estimate, weights: np.ndarray):
        self.estimate, self.weights = found, weights

    def score(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and posteriors of the weak labels."""
        words = Words(texts)
        f, lines = figures(words), repeated_lines(texts)
        post = np.array([self.estimate.posterior.get(tuple(v), 0.5) for v in votes(f, lines).tolist()])
        said = _dense(f, lines) @ self.weights[SIZE:]
        for text, slot in _slots(words):
            said += np.bincount(text, self.weights[slot], minlength=len(texts)) / np.maximum(np.bincount(text, minlength=len(texts)), 1)
        none = f[:, 0] == 0
        return np.where(none, 0.0, sigmoid(said)), np.where(none, 0.0, post)


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """EM over the vote patterns of all docs; the scorer is fit on at most `sample` of them."""
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    seen = texts.select("text").mapInArrow(_voted, "votes string").where("votes is not null").groupBy("votes").agg(F.count(F.lit(1)).alias("n")).collect()  # 3**9 at most
    found = estimate(sorted((tuple(map(int, r.votes)), r.n) for r in seen))
    mark = F.xxhash64("doc_id", "text")
    cut = texts.select(mark.alias("mark")).distinct().orderBy("mark").limit(sample).agg(F.max("mark")).first()[0]
    few = written(texts.where(mark <= F.lit(cut)).dropDuplicates(["doc_id", "text"]), "quality-sample") if cut is not None else texts.limit(0)
    row = few.coalesce(1).mapInArrow(_train(found.posterior), "weights array<double>").first()
    return Model(found, np.array(row.weights if row else [0.0] * (SIZE + FIGURES)))


def scored(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, score, posterior, kept) for every row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            score, post = model.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(post), pa.array(score >= least)], names=["doc_id", "score", "posterior", "kept"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, score double, posterior double, kept boolean")


def kept_quality(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, that the model keeps."""
    return rows_where(docs, lambda texts: model.score(texts)[0] >= least)
