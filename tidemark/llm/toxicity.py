"""Toxicity categories by a chain of linear models.

Categories are predicted one after the other: each model sees the words of a text, the beginnings of its words,
and the probabilities of all earlier categories.  In training these are out of fold, so later models meet earlier
ones as they behave on unseen texts; a fold chooses its features without the rows it leaves out, and equal texts lie in one fold.
The last category is `toxic` itself.  Earlier ones are weak: a labelled toxic text is an insult or contempt if it has
one of their seed words, and veiled if it has none of any.

Models are fit on at most `sample` labelled documents, chosen by the hash of their id; every document is scored.
Words are lower-cased runs of letters and digits, so that signs around a word do not hide it; beginnings of three to
eight bytes stand for stems.  Features are all those significantly tied to a category.  A text is rejected above the
probability that at most a share `spare` of the labelled clean texts reach out of fold.

Null and empty texts have probability 0. Labels that are null count as not labelled; an id with several labels has the
highest, one with several texts the smallest. Without labels of both kinds nothing is toxic. Texts of any length are read
whole. Rows may repeat, ids may be null; extra columns of any name pass through `kept_clean`. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._linear import Rows, joined, logistic, sigmoid
from ._shared import BATCH, rows_where, small, written
from ._words import Words, _span_hash, mix64

# Seed words of the weak categories.
SEEDS = {
    "insult": ("idiot", "moron", "clown", "loser", "stupid"),
    "contempt": ("trash", "scum", "worthless", "pathetic", "disgusting"),
}
CHAIN = [*SEEDS, "veiled", "toxic"]
SAMPLE = 12000
FOLDS = 5
STEMS = range(3, 9)
_BREAK = np.ones(256, dtype=bool)
_BREAK[48:58] = _BREAK[65:91] = _BREAK[97:123] = _BREAK[128:] = False


def _read(texts: list) -> Words:
    return Words(texts, lower=True, space=_BREAK)


_SEED_HASHES = {name: np.sort(np.concatenate([_read([w]).hashes for w in words])) for name, words in SEEDS.items()}


def _features(words: Words) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of whole words, then of the beginnings of longer ones, length by length."""
    text = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    yield text, words.hashes
    for k in STEMS:
        long = words.ends - words.starts > k
        yield text[long], mix64(_span_hash(words.data, words.starts[long], words.starts[long] + k) + np.uint64(k))


def _among(model: np.ndarray, text: np.ndarray, feature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, place in model) of features that model, which is sorted, has."""
    if not len(model) or not len(feature):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(model, feature), len(model) - 1)
    hit = model[at] == feature
    pair = np.unique(text[hit] * len(model) + at[hit])
    return pair // len(model), pair % len(model)


def _presence(words: Words, model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = [_among(model, *x) for x in _features(words)]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


class Chain:
    """links: for each category its model features, and weights of these, earlier categories and the constant; cut: least probability of toxic texts."""

    def __init__(self, links: list[tuple[np.ndarray, np.ndarray]], cut: float):
        self.links, self.cut = links, cut

    def score(self, texts: list) -> np.ndarray:
        words = _read(texts)
        n = len(texts)
        every = np.unique(np.concatenate([m for m, _ in self.links]))
        text, at = _presence(words, every)
        out = np.zeros((n, 0))
        for model, weights in self.links:
            own = np.zeros(len(every))
            own[np.searchsorted(every, model)] = weights[: len(model)]
            said = np.bincount(text, own[at], minlength=n) + np.append(out, np.ones((n, 1)), axis=1) @ weights[len(model) :]
            out = np.append(out, sigmoid(said)[:, None], axis=1)
        out[np.diff(words.first) == 0] = 0
        return out


def _tied(x: Rows, y: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """Mask of the features that are more frequent where y, among the rows in the mask `keep`, by four deviations and on three texts at least."""
    n, p = keep.sum(), max(y[keep].sum(), 1)
    all_, a = x.counts(keep, y)
    share = all_ / n
    z = (a / p - (all_ - a) / max(n - p, 1)) / np.sqrt(share * (1 - share) * (1 / p + 1 / max(n - p, 1)) + 1e-12)
    return (a >= 3) & (z > 4)


def _link(x: Rows, y: np.ndarray, steps: int, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mask of features, and weights, from the rows in the mask `keep`; both classes weigh the same. Only entries of those rows and features are copied."""
    pick = _tied(x, y, keep)
    y = y[keep]
    n, p = len(y), max(y.sum(), 1)
    return pick, logistic(x.of(keep, pick), y, l1=0.007 / max(n, 1) ** 0.5, l2=1e-4, steps=steps, weight=1 + y * ((n - y.sum()) / p - 1), still=1e-5)


def train(features: np.ndarray, row: np.ndarray, column: np.ndarray, labels: np.ndarray, groups: np.ndarray, spare: float) -> tuple[list[tuple[np.ndarray, np.ndarray]], float]:
    """Links and cut from (row, column) of the features of each text, its toxic label, and a number that equal texts share."""
    n = len(labels)
    if not n or labels.min() == labels.max():
        return [(np.empty(0, np.uint64), np.append(np.zeros(k), -30.0)) for k in range(len(CHAIN))], 0.5
    seeded = {name: np.bincount(row[np.isin(features, own)[column]], minlength=n) > 0 for name, own in _SEED_HASHES.items()}
    seeded["veiled"] = ~np.logical_or.reduce(list(seeded.values()))
    fold = (mix64(groups) % np.uint64(FOLDS)).astype(int)
    links, earlier = [], np.zeros((n, 0))
    for name in CHAIN:
        y = labels * seeded.get(name, True)
        x = Rows(row, column, None, len(features), np.append(earlier, np.ones((n, 1)), axis=1))
        pick, weights = _link(x, y, 400, np.ones(n, bool))
        links.append((features[pick], weights))
        unseen = np.zeros(n)
        for k in range(FOLDS):
            out = fold == k
            if out.any() and not out.all():
                pick, weights = _link(x, y, 200, ~out)
                unseen[out] = sigmoid(x.of(out, pick).dot(weights))
        earlier = np.append(earlier, unseen[:, None], axis=1)
    clean = np.sort(earlier[labels == 0, -1])
    return links, float(min(max(clean[math.ceil((1 - spare) * (len(clean) - 1))] + 1e-6, 0.5), 0.99))


def _train(spare: float):
    """From rows of the sample, toxic ones first: only features of three toxic texts can be tied to a category.

    The fit is one task beside others of its executor, so texts are read in small batches and an entry is two narrow numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, []
        rows, columns, labels, groups = [], [], [], []
        n = 0

        def candidates() -> np.ndarray:
            found, times = np.unique(np.concatenate([f for _, f in held]), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
            found = found[times >= 3]
            for t, f in held:
                at = np.searchsorted(found, f)
                some = (at < len(found)) & (found[np.minimum(at, max(len(found) - 1, 0))] == f) if len(found) else np.zeros(len(f), bool)
                rows.append(t[some])
                columns.append(at[some].astype(np.int32))
            held.clear()
            return found

        for batch in small(batches, "text", BATCH):
            words, toxic = _read(batch.column("text").to_pylist()), batch.column("toxic").to_numpy()
            clean = np.flatnonzero(toxic == 0)
            if known is None:
                text, feature = (np.concatenate(x) for x in zip(*_features(words)))
                some = toxic[text] != 0
                order = np.lexsort((feature[some], text[some]))
                text, feature = text[some][order], feature[some][order]
                new = np.append(True, (text[1:] != text[:-1]) | (feature[1:] != feature[:-1])) if len(text) else np.empty(0, bool)
                held.append(((text[new] + n).astype(np.int32), feature[new]))
                if len(clean):
                    known = candidates()
            if len(clean):
                text, at = _presence(words, known)
                some = toxic[text] == 0
                rows.append((text[some] + n).astype(np.int32))
                columns.append(at[some].astype(np.int32))
            labels.append(toxic.astype(float))
            groups.append(batch.column("mark").to_numpy().view(np.uint64))
            n += batch.num_rows
        known = candidates() if known is None else known
        links, cut = train(known, joined(rows, np.int32), joined(columns, np.int32), joined(labels, float), joined(groups, np.uint64), spare)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(links)), pa.int32()), pa.array([m.view(np.int64).tolist() for m, _ in links], pa.list_(pa.int64())), pa.array([w.tolist() for _, w in links], pa.list_(pa.float64())), pa.array([cut] * len(links))], names=["link", "words", "weights", "cut"])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, spare: float = 0.003) -> Chain:
    """A chain fit on at most `sample` labelled rows of docs."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    present = known.select("doc_id").join(texts.select("doc_id").distinct(), "doc_id")
    chosen = written(known.join(present.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample), "doc_id"), "toxic-labels")
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))  # at most `sample` small rows
    rows = written(rows.withColumn("mark", F.xxhash64("text")), "toxic-sample")
    few = rows.coalesce(1).sortWithinPartitions(F.desc("toxic"), F.xxhash64("doc_id"), "doc_id").select("text", "toxic", "mark")
    got = sorted(few.mapInArrow(_train(spare), "link int, words array<long>, weights array<double>, cut double").collect(), key=lambda r: r.link)
    return Chain([(np.array(r.words, dtype=np.int64).view(np.uint64), np.array(r.weights)) for r in got], got[0].cut)


def scored(docs: DataFrame, chain: Chain) -> DataFrame:
    """(doc_id, p_<category> for each category, toxic) for every row of docs."""
    names = ["doc_id", *(f"p_{c}" for c in CHAIN), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            p = chain.score(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= chain.cut)], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} double" for c in names[1:-1]), "toxic boolean"]))


def kept_clean(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs, all columns, that are not toxic."""
    return rows_where(docs, lambda texts: chain.score(texts)[:, -1] < chain.cut)
