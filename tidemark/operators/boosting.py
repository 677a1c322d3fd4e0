"""Gradient-boosted regression trees by histograms, grown leaf by leaf, for all folds side by side.

Rows are cut into quantile bins once; bins of narrow columns are packed into one code, whose sums give the histograms of all of their features.
Rows of a fold with the same bins always get the same score, so they are one entry, with their number and the sum of their outcomes.

A fold of at most `alone` entries is grown by one task, all trees in one job. A larger one is dealt into blocks, and a job is a round: each task
routes its rows down the tree in growth and adds up residuals and counts by node, feature and bin; tasks' sums are merged, by a tree
where there are many.  A node's histogram is only counted for the smaller child, the other one is its parent's rest.

The next leaf to split is always that of the greatest gain. To know it in few rounds, every leaf that the remaining leaves could reach is split for a
trial in one round; the order of gains then decides which splits stay, and the rest is dropped, so the tree is the one that
splitting a leaf at a time gives. A node of at most `local` entries sends them instead of a histogram, and what grows below it needs no
further round. What the driver holds are trees, histograms and the entries of such nodes, whose size follows from the parameters alone. Residuals
are carried by blocks, kept after each tree and checkpointed every few trees, so a lost executor costs a few trees' routing; older checkpoints are deleted.

Left are bins up to the cut. Gains are G^2 / (n + shrink) of both sides less that of the whole, and have to be above 0; ties go to the
first leaf, feature and bin. Rows may be drawn anew every few trees by a hash of the id; with `every` 0 all rows are used.
"""

from __future__ import annotations

import functools
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import RDD, StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import deleted, written

MERGED_BY_DRIVER = 64
SHARED, NARROW = 4096, 64  # codes that columns share, bins of such a column
DEALT = 64  # blocks of a task at most
RARE = 0.6  # share of codes
AT_ONCE = 65_536  # rows, for arrays that stay in a processor's cache
TIE = 1e-10  # gains this close, as sums in another order give, are equal


@dataclass(frozen=True)
class Boosting:
    """The reference settings of the model."""

    trees: int = 600
    step: float = 0.05
    leaves: int = 31
    least: int = 20
    shrink: float = 1.0
    columns: float = 0.9
    rows: float = 0.9
    every: int = 0
    bins: int = 255
    seed: int = 42
    keep: int = 5  # trees that each round routes rows down again, in folds of one block
    checkpoint: int = 20  # trees between checkpoints
    local: int = 8192  # entries, by node; 31 nodes of 13 features in 5 folds are 27 MB
    alone: int = 8_388_608  # entries of a fold that one task grows; 15 to 23 bytes each, and as many for rows of nodes

    @property
    def drawing(self) -> bool:
        return bool(self.every) and self.rows < 1


Entries = tuple  # (codes of each group, residual sums, numbers of rows or None where all are 1, ids or None)


class Layout:
    """Bins of a fold's columns as few codes: narrow columns share one. Features are the numbers, then whether a category has a value."""

    def __init__(self, numbers: list[str], edges: dict[int, list[np.ndarray]], categories: list[tuple[str, str]], width: int):
        self.numbers, self.edges, self.width = numbers, edges, width
        self.values = {c: [v for of, v in categories if of == c] for c, _ in categories}
        widths = [1 + max(len(own[i]) for own in edges.values()) for i in range(len(numbers))] + [1 + len(v) for v in self.values.values()]
        self.groups: list[list[tuple[int, int, int]]] = []  # (column, width, stride)
        self.sizes: list[int] = []
        for column in sorted(range(len(widths)), key=lambda c: (widths[c], c)):
            if not self.groups or widths[column] > NARROW or self.sizes[-1] * widths[column] > SHARED:
                self.groups.append([])
                self.sizes.append(1)
            self.groups[-1].append((column, widths[column], self.sizes[-1]))
            self.sizes[-1] *= widths[column]
        place = {column: (g, w, stride) for g, group in enumerate(self.groups) for column, w, stride in group}
        of = {c: len(numbers) + k for k, c in enumerate(self.values)}
        asked = [(i, None) for i in range(len(numbers))] + [(of[c], self.values[c].index(v)) for c, v in categories]
        self.asked = [(column, value, *place[column]) for column, value in asked]
        self.bins = []  # of each feature, by code of its group
        for _, value, g, w, stride in self.asked:
            bins = np.arange(self.sizes[g]) // stride % w
            self.bins.append((g, bins if value is None else (bins == value).astype(np.int64)))
        self.plain = [len(group) == 1 and group[0][0] < len(numbers) for group in self.groups]  # a number's bins are the codes
        filled = [j * width + b for j, (_, value, _, w, _) in enumerate(self.asked) for b in range(w if value is None else 2)]
        self.filled = np.array(filled)  # bins that can hold rows

    def codes(self, rows: pa.RecordBatch, fold: int) -> list[np.ndarray]:
        columns = [np.searchsorted(e, rows.column(c).to_numpy(zero_copy_only=False).astype(np.float64)) for c, e in zip(self.numbers, self.edges[fold])]
        for c, values in self.values.items():
            columns.append(pc.fill_null(pc.index_in(rows.column(c), pa.array(values, rows.column(c).type)), len(values)).to_numpy(zero_copy_only=False).astype(np.int64))
        return [sum(columns[c] * stride for c, _, stride in group).astype(np.min_scalar_type(size - 1)) for group, size in zip(self.groups, self.sizes)]

    def low(self, feature: int, cut: int, codes: list[np.ndarray], rows: np.ndarray | None) -> np.ndarray:
        """Whether rows go left."""
        g, bins = self.bins[feature]
        own = codes[g] if rows is None else codes[g][rows]
        return own <= cut if self.plain[g] else (bins <= cut)[own]

    def histograms(self, sums: list[np.ndarray]) -> np.ndarray:
        """(node, feature, bin, (sum, count, entries)) of sums by code, (node, code, ...) for each group."""
        nodes = len(sums[0])
        out = np.zeros((nodes, len(self.asked), self.width, 3))
        by = {}
        for g, group in enumerate(self.groups):
            for column, w, stride in group:
                by[column] = sums[g] if len(group) == 1 else sums[g].reshape(nodes, -1, w, stride, 3).sum(axis=(1, 3))
        for j, (column, value, _, w, _) in enumerate(self.asked):
            if value is None:
                out[:, j, :w] = by[column]
            else:
                out[:, j, 1] = by[column][:, value]
                out[:, j, 0] = by[column].sum(axis=1) - by[column][:, value]
        return out


def sums(layout: Layout, entries: Entries, rows: np.ndarray | None = None, at: np.ndarray | None = None, nodes: int = 1) -> list[np.ndarray]:
    """(node, code, (sum, count, entries)) of each group, over some rows; `at` are these rows' nodes."""
    codes, residual, n, _ = entries
    out = [np.zeros((nodes, size, 3)) for size in layout.sizes]
    for first in range(0, len(residual if rows is None else rows), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        own = part if rows is None else rows[part]
        sums_of, count = residual[own], None if n is None else n[own]
        for c, to, size in zip(codes, out, layout.sizes):
            key = c[own].astype(np.intp)
            if at is not None:
                key += at[part].astype(np.intp) * size
            found = np.bincount(key, minlength=nodes * size).reshape(nodes, size)
            to[..., 0] += np.bincount(key, sums_of, nodes * size).reshape(nodes, size)
            to[..., 1] += found if n is None else np.bincount(key, count, nodes * size).reshape(nodes, size)
            to[..., 2] += found
    return out


def chosen(entries: Entries, some: np.ndarray) -> Entries:
    codes, residual, n, _ = entries
    return [c[some] for c in codes], residual[some], None if n is None else n[some], None


def joined(parts: list[Entries]) -> Entries:
    """Entries one after the other."""
    codes, residual, n, ids = zip(*parts)
    n = None if all(x is None for x in n) else np.concatenate([np.ones(len(r)) if x is None else x for x, r in zip(n, residual)])
    return [np.concatenate(c) for c in zip(*codes)], np.concatenate(residual), n, None if ids[0] is None else np.concatenate(ids)


class Tree:
    """Nodes with feature, cut and children (-1 for leaves) and the value of leaves."""

    def __init__(self) -> None:
        self.feature, self.cut, self.left, self.right, self.value = [-1], [0], [-1], [-1], [0.0]

    def split(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        n = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, n, n + 1
        for x, v in ((self.feature, -1), (self.cut, 0), (self.left, -1), (self.right, -1), (self.value, 0.0)):
            x += [v, v]
        return n, n + 1


class Places:
    """Which of some leaves rows come to: for each code a word of bits, one for each leaf that the code doesn't rule out."""

    def __init__(self, tree: Tree, nodes: list[int], layout: Layout):
        self.count, self.words = len(nodes), []  # of each 64 leaves: (group, bits by code, whether most codes have none)
        for first in range(0, len(nodes), 64):
            bits = {v: 1 << i for i, v in enumerate(nodes[first : first + 64])}
            tables: list[np.ndarray | None] = [None] * len(layout.sizes)
            self._below(tree, 0, bits, tables, layout)
            share = {g: np.count_nonzero(t) / len(t) for g, t in enumerate(tables) if t is not None}
            self.words.append([(g, tables[g], share[g] < RARE) for g in sorted(share, key=share.get)])

    def _below(self, tree: Tree, node: int, bits: dict[int, int], tables: list, layout: Layout) -> int:
        if node in bits or tree.feature[node] < 0:
            return bits.get(node, 0)
        left, right = (self._below(tree, v, bits, tables, layout) for v in (tree.left[node], tree.right[node]))
        if left or right:
            g, bins = layout.bins[tree.feature[node]]
            if tables[g] is None:
                tables[g] = np.full(layout.sizes[g], (1 << len(bits)) - 1, np.uint64)
            tables[g] &= ~np.where(bins <= tree.cut[node], np.uint64(right), np.uint64(left))
        return left | right

    def __call__(self, codes: list[np.ndarray]) -> np.ndarray:
        """Positions among the leaves, their number for rows that come to none."""
        out = np.full(len(codes[0]), self.count, np.min_scalar_type(self.count))
        for first, tables in enumerate(self.words):
            if not tables:  # the root
                out[:] = 0
            rows, hit = slice(None), None
            for g, table, rare in tables:
                more = np.take(table, codes[g][rows], mode="clip")
                hit = more if hit is None else np.bitwise_and(hit, more, out=hit)
                if rare:  # only rows that a leaf is left for are looked at further
                    left = np.flatnonzero(hit)
                    rows, hit = left if isinstance(rows, slice) else rows[left], hit[left]
            if hit is not None:
                at = np.bitwise_count(hit - np.uint64(1))
                if len(self.words) > 1:
                    at = np.where(at < 64, at.astype(out.dtype) + out.dtype.type(64 * first), out[rows])
                out[rows] = np.minimum(at, self.count)
        return out


class Steps:
    """What a tree adds to the scores of rows."""

    def __init__(self, tree: Tree, layout: Layout):
        leaves = [v for v, f in enumerate(tree.feature) if f < 0]
        self.places, self.values = Places(tree, leaves, layout), np.array([tree.value[v] for v in leaves])

    def __call__(self, codes: list[np.ndarray]) -> np.ndarray:
        return self.values[self.places(codes)]


def drawn(ids: np.ndarray, settings: Boosting, tree: int) -> np.ndarray | None:
    """Whether a row is among those of a tree; None where all are."""
    if not settings.drawing:
        return None
    x = ids.astype(np.uint64) + np.uint64((settings.seed << 32) + tree // settings.every)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x >> np.uint64(11)).astype(np.float64) / 2**53 < settings.rows


def allowed(features: int, settings: Boosting, tree: int) -> np.ndarray:
    """Which features a tree may use."""
    out = np.zeros(features, dtype=bool)
    out[np.random.default_rng([settings.seed, tree]).permutation(features)[: max(1, round(settings.columns * features))]] = True
    return out


def best_split(hist: np.ndarray, use: np.ndarray, settings: Boosting) -> tuple[float, int, int] | None:
    """(gain, feature, cut) of a histogram (feature, bin, (sum, count, ...))."""
    left = np.cumsum(hist, axis=1)[:, :-1]
    whole = hist[0].sum(axis=0)
    right = whole - left
    score = lambda x: x[..., 0] ** 2 / (x[..., 1] + settings.shrink)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 1] < settings.least - 0.5) | (right[..., 1] < settings.least - 0.5) | ~use[:, None]] = -np.inf
    top = gain.max()
    if not top > 1e-12:
        return None
    at = int(np.argmax(gain >= top * (1 - TIE)))
    feature, cut = divmod(at, gain.shape[1])
    return float(gain.flat[at]), feature, cut


class Growth:
    """One tree in growth: trial splits, their histograms or entries, and the order in which they would be made."""

    def __init__(self, settings: Boosting, use: np.ndarray, size: int, layout: Layout):
        self.settings, self.use, self.layout, self.tree = settings, use, layout, Tree()
        self.hist: dict[int, np.ndarray] = {}
        self.best: dict[int, tuple[float, int, int] | None] = {}
        self.rows: dict[int, tuple[Entries, np.ndarray | None]] = {}  # entries, and which of them lie in the node if not all do
        self.counting, self.sending, self.split = ([], [0], []) if size <= settings.local else ([0], [], [])
        self.done = False

    def take(self, counted: dict[int, np.ndarray], sent: dict[int, tuple[Entries, np.ndarray | None]]) -> None:
        """Histograms and entries of the nodes asked for; then the next trial splits, or the finished tree."""
        for node, own in sent.items():
            self.rows[node] = own
            self.hist[node] = self._counted(own)
        self.hist.update(counted)
        for node in self.split:
            children = self.tree.left[node], self.tree.right[node]
            for a, b in (children, children[::-1]):
                if a not in self.hist:
                    self.hist[a] = self.hist[node] - self.hist[b]
            del self.hist[node]
        for node in self.hist:
            if node not in self.best:
                self.best[node] = best_split(self.hist[node], self.use, self.settings)
        order, made = [], []
        self._push(order, 0)
        while order and len(made) + 1 < self.settings.leaves:
            _, node = order[0]
            if self.tree.feature[node] < 0:
                if node not in self.rows:
                    break
                self._split_here(node)
            heapq.heappop(order)
            made.append(node)
            for child in (self.tree.left[node], self.tree.right[node]):
                self._push(order, child)
        if not order or len(made) + 1 >= self.settings.leaves:
            return self._finish(set(made))
        missing = [node for _, node in order if self.tree.feature[node] < 0 and node not in self.rows]
        self.counting, self.sending, self.split = [], [], sorted(missing, key=lambda v: (-self.best[v][0], v))[: self.settings.leaves - 1 - len(made)]
        for node in self.split:
            _, feature, cut = self.best[node]
            count = self.hist[node][feature, :, 2]
            sizes = count[: cut + 1].sum(), count[cut + 1 :].sum()
            children = self.tree.split(node, feature, cut)
            self.sending += [v for v, n in zip(children, sizes) if n <= self.settings.local]
            if min(sizes) > self.settings.local:
                self.counting.append(children[0] if sizes[0] <= sizes[1] else children[1])

    def _counted(self, own: tuple[Entries, np.ndarray | None]) -> np.ndarray:
        return self.layout.histograms(sums(self.layout, *own))[0]

    def _split_here(self, node: int) -> None:
        entries, rows = self.rows.pop(node)
        _, feature, cut = self.best[node]
        low = self.layout.low(feature, cut, entries[0], rows)
        of = [np.flatnonzero(side) if rows is None else rows[side] for side in (low, ~low)]
        sides = sorted(zip(self.tree.split(node, feature, cut), of), key=lambda side: len(side[1]))
        whole = self.hist.pop(node)
        for child, some in sides:
            self.rows[child] = entries, some
        small, large = (child for child, _ in sides)
        self.hist[small] = self._counted(self.rows[small])
        self.hist[large] = whole - self.hist[small]
        for child in (small, large):
            self.best[child] = best_split(self.hist[child], self.use, self.settings)

    def _push(self, order: list, node: int) -> None:
        if self.best.get(node):
            heapq.heappush(order, (-self.best[node][0], node))

    def _finish(self, made: set[int]) -> None:
        """The tree without the trial splits that weren't made."""
        out = Tree()

        def copy(source: int, target: int) -> tuple[float, float]:
            if source not in made:
                sums = self.sums(source)
                out.value[target] = -self.settings.step * float(sums[0] / (sums[1] + self.settings.shrink))
                return
            for child, to in zip((self.tree.left[source], self.tree.right[source]), out.split(target, self.tree.feature[source], self.tree.cut[source])):
                copy(child, to)

        copy(0, 0)
        self.tree, self.done = out, True
        self.hist, self.rows = {}, {}  # copy() refers to itself, so a finished growth stays until garbage is collected

    def sums(self, node: int) -> np.ndarray:
        """Sum and count of a node; of a split one, from its children."""
        if node in self.hist:
            return self.hist[node][0].sum(axis=0)
        return self.sums(self.tree.left[node]) + self.sums(self.tree.right[node])


def quantile_edges(train: DataFrame, numbers: list[str], bins: int) -> dict[int, list[np.ndarray]]:
    """Upper edges of about equal bins of each number, by fold."""
    at = [i / bins for i in range(1, bins)]
    found = train.groupBy("fold").agg(*[F.percentile_approx(F.col(c).cast("double"), at, 20 * bins).alias(c) for c in numbers]).collect()  # folds x numbers x bins
    return {r["fold"]: [np.unique(np.array(r[c], dtype=np.float64)) for c in numbers] for r in found}


def _coded(layout: Layout, names: list[str], carried: list[str]):
    """Rows (fold, carried columns, numbers, categories) with codes in place of bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = batch.filter(pa.array(fold == f))
                codes = [pa.array(c.astype(np.int32)) for c in layout.codes(own, f)]
                yield pa.RecordBatch.from_arrays([own.column("fold"), *(own.column(c) for c in carried), *codes], names=["fold", *carried, *names])

    return run


def _blocks(base: float, names: list[str], sizes: list[int], block: int, drawing: bool):
    """A fold's cells as pickled entries, about `block` at a time."""

    def packed(parts: list[Entries]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(joined(parts))], pa.binary())], names=["block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            codes = [batch.column(c).to_numpy().astype(np.min_scalar_type(size - 1)) for c, size in zip(names, sizes)]
            n = batch.column("n").to_numpy().astype(np.float64)
            ids = batch.column("event_id").to_numpy() if drawing else None
            parts.append((codes, n * base - batch.column("y").to_numpy(), None if (n == 1).all() else n, ids))
            held += batch.num_rows
            if held >= block:
                yield packed(parts)
                parts, held = [], 0
        if held:
            yield packed(parts)

    return run


def fit_folds(train: DataFrame, numbers: list[str], categorical: list[str], settings: Boosting, block: int) -> tuple[dict[int, tuple[float, list[Tree]]], Layout | None]:
    """A model for each fold of train (fold, event_id, y, numbers, categorical): (base, trees) by fold, and how bins are coded."""
    spark = train.sparkSession
    edges = quantile_edges(train, numbers, settings.bins)
    if not edges:
        return {}, None
    categories = sorted({(c, v) for c in categorical for (v,) in train.select(c).distinct().collect() if v is not None})  # forms and session buckets
    layout = Layout(numbers, edges, categories, settings.bins + 1)
    names, carried = [f"code{g}" for g in range(len(layout.sizes))], ["y", *(["event_id"] if settings.drawing else [])]
    rows = train.select("fold", F.col("event_id").cast("long").alias("event_id"), F.col("y").cast("double").alias("y"), *numbers, *categorical)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    coded = rows.mapInArrow(_coded(layout, names, carried), ", ".join([f"{c} {kinds[c]}" for c in ("fold", *carried)] + [f"{c} int" for c in names]))
    one = F.lit(1).cast("long").alias("n")
    cells = coded.select("fold", *carried, *names, one) if settings.drawing else coded.groupBy("fold", *names).agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"))
    cells = written(cells, "boosting")
    found = {r["fold"]: r for r in cells.groupBy("fold").agg(F.sum("y").alias("y"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("entries")).collect()}
    everything, at_once = sum(r["entries"] for r in found.values()), spark.sparkContext.defaultParallelism

    def fit(fold: int) -> tuple[float, list[Tree]]:
        base, entries = found[fold]["y"] / found[fold]["n"], found[fold]["entries"]
        blocks = -(-entries // block)
        tasks = 1 if entries <= settings.alone else min(blocks, max(1, round(at_once * entries / everything), -(-blocks // DEALT)))  # folds' tasks run side by side
        dealt = cells.where(F.col("fold") == fold).repartition(tasks).mapInArrow(_blocks(base, names, layout.sizes, block, settings.drawing), "block binary")
        state = dealt.rdd.map(lambda r: pickle.loads(r["block"]))
        if entries <= settings.alone:
            return base, state.mapPartitions(functools.partial(_grown, layout, settings)).collect()
        return base, _grown_by_rounds(state, layout, settings, entries, blocks > 1)

    with ThreadPool(len(found)) as pool:  # folds wait for each other's jobs no more than cores make them
        return dict(zip(found, pool.map(inheritable_thread_target(spark)(fit), found))), layout


def _grown(layout: Layout, settings: Boosting, blocks: Iterator[Entries]) -> Iterator[Tree]:
    """All trees of one task's entries."""
    parts = list(blocks)
    if not parts:
        return
    entries = joined(parts)
    del parts
    codes, residual, n, ids = entries
    for nth in range(settings.trees):
        some = drawn(ids, settings, nth)
        growth = Growth(settings, allowed(len(layout.asked), settings, nth), len(residual), layout)
        growth.take({}, {0: (entries, None if some is None else np.flatnonzero(some))})
        _add([Steps(growth.tree, layout)], codes, residual, n)
        yield growth.tree


def _add(steps: list[Steps], codes: list[np.ndarray], residual: np.ndarray, n: np.ndarray | None) -> None:
    """Trees' steps added to residuals in place."""
    for first in range(0, len(residual), AT_ONCE):
        part = slice(first, first + AT_ONCE)
        for step in steps:
            more = step([c[part] for c in codes])
            residual[part] += more if n is None else more * n[part]


def _grown_by_rounds(state: RDD, layout: Layout, settings: Boosting, entries: int, many: bool) -> list[Tree]:
    """All trees of a fold whose entries lie in blocks."""
    spark_context = state.context
    state, before = state.persist(StorageLevel.MEMORY_AND_DISK), None
    trees: list[Tree] = []
    since: list[Tree] = []
    saved, saved_at, marked = None, 0, False
    for nth in range(settings.trees):
        growth = Growth(settings, allowed(len(layout.asked), settings, nth), entries, layout)
        while not growth.done:
            job = state.mapPartitions(_round(layout, growth.tree, growth.counting, growth.sending, since, settings, nth))
            counted, sent = functools.reduce(_merged, job.collect()) if state.getNumPartitions() <= MERGED_BY_DRIVER else job.treeReduce(_merged)
            if before is not None:  # this round has kept the new state
                before, _ = None, before.unpersist()
            if marked:
                older, saved, marked = saved, state.getCheckpointFile(), False
                deleted(spark_context, older)
            histograms = np.zeros((len(growth.counting), len(layout.asked) * layout.width, 3))
            if counted is not None:
                histograms[:, layout.filled] = counted
            none = [np.zeros(0, np.int64)] * len(layout.sizes), np.zeros(0), None, None
            shape = len(layout.asked), layout.width, 3
            growth.take({v: h.reshape(shape) for v, h in zip(growth.counting, histograms)}, {v: (joined(sent.get(v, [none])), None) for v in growth.sending})
        trees.append(growth.tree)
        since.append(growth.tree)
        if nth + 1 < settings.trees and (many or (nth + 1) % settings.keep == 0):
            before, state = state, state.map(functools.partial(_stepped, layout, since)).persist(StorageLevel.MEMORY_AND_DISK)
            since = []
            if nth + 1 - saved_at >= settings.checkpoint:
                state.checkpoint()
                saved_at, marked = nth + 1, True
    state.unpersist()
    deleted(spark_context, saved)
    return trees


def _stepped(layout: Layout, trees: list[Tree], entries: Entries) -> Entries:
    """Entries with the steps of further trees added."""
    codes, residual, n, ids = entries
    residual = residual.copy()
    _add([Steps(t, layout) for t in trees], codes, residual, n)
    return codes, residual, n, ids


def _round(layout: Layout, tree: Tree, counting: list[int], sending: list[int], since: list[Tree], settings: Boosting, nth: int):
    """Filled bins of histograms, by node, and entries by node, of one task's blocks."""

    def run(blocks: Iterator[Entries]) -> Iterator[tuple[np.ndarray | None, dict]]:
        nodes = [*counting, *sending]
        places, steps = Places(tree, nodes, layout), [Steps(t, layout) for t in since]
        whole, sent = None, {}
        for codes, residual, n, ids in blocks:
            if steps:
                residual = residual.copy()
                _add(steps, codes, residual, n)
            at, some = places(codes), drawn(ids, settings, nth)
            if some is not None:
                at[~some] = len(nodes)
            entries = codes, residual, n, None
            if counting:
                rows = np.flatnonzero(at < len(counting))
                part = sums(layout, entries, None if len(rows) == len(at) else rows, at[rows] if len(counting) > 1 else None, len(counting))
                whole = part if whole is None else [a + b for a, b in zip(whole, part)]
            rows = np.flatnonzero((at >= len(counting)) & (at < len(nodes)))
            for v in np.unique(at[rows]).tolist():
                sent.setdefault(nodes[v], []).append(chosen(entries, rows[at[rows] == v]))
        yield None if whole is None else layout.histograms(whole).reshape(len(counting), -1, 3)[:, layout.filled], sent

    return run


def _merged(a: tuple[np.ndarray | None, dict], b: tuple[np.ndarray | None, dict]) -> tuple[np.ndarray | None, dict]:
    counted = b[0] if a[0] is None else a[0] if b[0] is None else a[0] + b[0]
    return counted, {k: a[1].get(k, []) + b[1].get(k, []) for k in {*a[1], *b[1]}}


def scored(test: DataFrame, models: dict[int, tuple[float, list[Tree]]], layout: Layout, carry: list[str]) -> DataFrame:
    """test (fold, event_id, ...) as (fold, event_id, carried columns, pred)."""
    shared = test.sparkSession.sparkContext.broadcast((models, layout))  # folds x trees x leaves
    test = test.select("fold", F.col("event_id").cast("long").alias("event_id"), *carry, *layout.numbers, *layout.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, layout = shared.value
        steps: dict[int, list[Steps]] = {}
        for batch in batches:
            fold = batch.column("fold").to_numpy()
            for f in np.unique(fold).tolist():
                own = batch.filter(pa.array(fold == f))
                base, trees = models[f]
                if f not in steps:
                    steps[f] = [Steps(tree, layout) for tree in trees]
                codes, pred = layout.codes(own, f), np.full(own.num_rows, base)
                for step in steps[f]:
                    pred += step(codes)
                yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("fold", "event_id", *carry)), pa.array(pred)], names=["fold", "event_id", *carry, "pred"])

    kinds = {f.name: f.dataType.simpleString() for f in test.schema.fields}
    return test.mapInArrow(run, ", ".join([f"{c} {kinds[c]}" for c in ("fold", "event_id", *carry)] + ["pred double"]))
