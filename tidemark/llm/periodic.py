"""Runs of repeated words: maximal stretches with a smallest period that they hold several times.

Runs are found by the linear tandem-repeat method.  Blocks of an LZ factorisation give a set of squares that covers the leftmost place of every
square there is; walks along suffix links of the suffix tree, a word further each time, complete it to the vocabulary of
all squares.  A square's places are the leaves below its end in the tree, and neighbouring places of one period merge into a run.
Squares whose half is itself a power are left out, so a run's period is its smallest.

The suffix tree is built from names of stretches of 1, 2, 4, ... words, which also answer how far two places agree, forwards and
backwards, for whole arrays of places. It is only built for segments that can hold a run: in a run of length L and period q all of its
first L - q - 2 triples of words stand again within q words, so stretches of such triples, whose distances their length allows, are
found first, with numpy over whole batches. No run lies outside of them.

Words are what lies between the bytes 0x20 and 0x09 to 0x0D. Null and empty texts have no words and no runs. Texts of any length are read whole.
Rows may repeat, each is answered; ids may be null; extra columns are ignored, whatever their names; an empty table gives an empty
result. Nothing is shuffled, and a task holds a batch of texts, bounded in bytes, or one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import small
from .bpe import _Places, _runs


class _Text:
    """Names of stretches of a sequence, its suffix array and how far places agree. The last code must occur once."""

    def __init__(self, codes: np.ndarray):
        self.n = n = len(codes)
        rank = np.unique(codes, return_inverse=True)[1].astype(np.int64)
        self.names, width = [rank.astype(np.int32)], 1
        while width < n and rank.max() < n - 1:
            key = rank * (n + 1)
            key[:-width] += rank[width:] + 1
            rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
            self.names.append(rank.astype(np.int32))
            width *= 2
        self.rank = rank
        self.places = np.empty(n, dtype=np.int64)
        self.places[rank] = np.arange(n)
        self.shared = np.append(0, self.forward(self.places[:-1], self.places[1:]))  # with the suffix before in order

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i and j on are the same; i differs from j, and n is the end."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name = self.names[level]
            same = np.flatnonzero((i < self.n) & (j < self.n))
            same = same[name[i[same]] == name[j[same]]]
            for x in (i, j, out):
                x[same] += 1 << level
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words that end at i and j are the same."""
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            same = np.flatnonzero((i >= width - 1) & (j >= width - 1))
            same = same[name[i[same] - width + 1] == name[j[same] - width + 1]]
            i[same] -= width
            j[same] -= width
            out[same] += width
        return out


def _earlier(text: _Text) -> np.ndarray:
    """Length of the longest stretch from each place on that also starts at an earlier one."""
    places, n = text.places.tolist(), text.n
    lower, upper, stack = [-1] * n, [-1] * n, []
    for p in places:  # nearest suffixes in order that start earlier
        while stack and stack[-1] > p:
            upper[stack.pop()] = p
        lower[p] = stack[-1] if stack else -1
        stack.append(p)
    out = np.zeros(n, dtype=np.int64)
    for near in (np.array(lower), np.array(upper)):
        some = np.flatnonzero(near >= 0)
        out[some] = np.maximum(out[some], text.forward(some, near[some]))
    return out


def _covering(text: _Text, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half) of squares around block borders, halves up to `longest` at the border; they cover the leftmost place of every square."""
    earlier, starts, at = _earlier(text).tolist(), [], 0
    while at < text.n:
        starts.append(at)
        at += max(1, earlier[at])
    h = np.array([*starts, text.n, text.n])
    here, after, far = h[:-2], h[1:-1], h[2:]
    # from the next block's start backwards: squares whose second half reaches into it
    inner = np.flatnonzero(after < text.n)
    most = np.minimum((after - here)[inner], longest[after[inner] - 1])
    k, border = _runs(most, np.ones(len(most), np.int64)), np.repeat(after[inner], most)
    q = border - k
    k, border, q = (x[q >= 0] for x in (k, border, q))
    ahead, back = text.forward(border, q), text.backward(border - 1, q - 1)
    ok = (ahead + back >= k) & (ahead > 0)
    found = [(np.maximum(q - back, q - k + 1)[ok], k[ok])]
    # from the block's own start forwards
    most = np.minimum(far - here, longest[here])
    k, border, stop = _runs(most, np.ones(len(most), np.int64)), np.repeat(here, most), np.repeat(after, most)
    q = border + k
    k, border, stop, q = (x[(q < text.n) & (border > 0)] for x in (k, border, stop, q))
    ahead, back = text.forward(border, q), text.backward(border - 1, q - 1)
    start = np.maximum(border - back, border - k + 1)
    ok = (ahead + back >= k) & (ahead > 0) & (back > 0) & (start + k <= stop)
    found.append((start[ok], k[ok]))
    return tuple(map(np.concatenate, zip(*found)))


def _prime_factors(most: int) -> np.ndarray:
    """The smallest prime factor of each number up to `most`."""
    out = np.arange(most + 1)
    for p in range(2, int(most**0.5) + 1):
        if out[p] == p:
            part = out[p * p :: p]
            part[part > p] = np.minimum(part[part > p], p)
    return out


def _primitive(text: _Text, start: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether a square's half is no power of a shorter stretch."""
    ok, rest = np.ones(len(start), dtype=bool), half.copy()
    factor = _prime_factors(int(half.max(initial=1)))
    while (rest > 1).any():
        p = factor[rest]
        at = np.flatnonzero(rest > 1)
        step = half[at] // p[at]
        ok[at] &= text.forward(start[at], start[at] + step) < half[at] - step
        while len(at):
            rest[at] //= p[at]
            at = at[rest[at] % p[at] == 0]
            at = at[rest[at] > 1]
    return ok


class _Tree:
    """Suffix tree: leaves 0 to n - 1 in the order of suffixes, then inner nodes; the last one is the root."""

    def __init__(self, text: _Text, codes: np.ndarray):
        n, shared = text.n, text.shared.tolist()
        depth, lo, hi, parent = [], [], [], [-1] * n
        owner = np.zeros(n, dtype=np.int64)  # the inner node of each entry of shared
        stack: list[tuple[int, int, list[int], list[int]]] = [(0, 0, [0], [])]  # depth, first leaf, children, entries
        for i in range(1, n + 1):
            d = shared[i] if i < n else 0
            if stack[-1][0] < d:
                stack.append((d, i - 1, [stack[-1][2].pop()], []))
            while stack[-1][0] > d:
                own, first, children, entries = stack.pop()
                node = n + len(depth)
                depth.append(own)
                lo.append(first)
                hi.append(i - 1)
                parent.append(-1)
                for c in children:
                    parent[c] = node
                for e in entries:
                    owner[e] = node
                if stack[-1][0] < d:
                    stack.append((d, first, [node], []))
                else:
                    stack[-1][2].append(node)
            if i < n:
                stack[-1][3].append(i)
                stack[-1][2].append(i)
        _, _, children, entries = stack.pop()
        self.root = root = n + len(depth)
        for c in children:
            parent[c] = root
        parent.append(-1)
        for e in entries:
            owner[e] = root
        self.owner, self.text = owner, text
        leaf = np.arange(n)
        self.lo, self.hi = np.append(np.append(leaf, np.array(lo, np.int64)), 0), np.append(np.append(leaf, np.array(hi, np.int64)), n - 1)
        self.depth = np.append(np.append(n - text.places, np.array(depth, np.int64)), 0)
        self.parent = np.array(parent)
        self.witness = text.places[self.lo]
        nodes = np.flatnonzero(self.parent >= 0)
        self.width = int(codes.max()) + 1
        keys = self.parent[nodes] * self.width + codes[self.witness[nodes] + self.depth[self.parent[nodes]]]
        self.child = dict(zip(keys.tolist(), nodes.tolist()))
        # the least entry of shared over stretches of 1, 2, 4, ... entries, by place
        self.least = [np.arange(n)]
        while 2 << len(self.least) - 1 <= n:
            a = self.least[-1]
            a, b = a[: len(a) - (1 << len(self.least) - 1)], a[1 << len(self.least) - 1 :]
            self.least.append(np.where(text.shared[b] < text.shared[a], b, a))
        inner = np.arange(n, root)
        self.link = np.full(root + 1, root)
        self.link[inner] = self.above(text.rank[text.places[self.lo[inner]] + 1], text.rank[text.places[self.hi[inner]] + 1])

    def above(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The lowest node above leaves a < b, which differ."""
        level = (np.frexp((b - a).astype(np.float64))[1] - 1).astype(np.int64)
        out = np.empty(len(a), dtype=np.int64)
        for k in np.unique(level).tolist():
            own = np.flatnonzero(level == k)
            x, y = self.least[k][a[own] + 1], self.least[k][b[own] - (1 << k) + 1]
            out[own] = self.owner[np.where(self.text.shared[y] < self.text.shared[x], y, x)]
        return out

    def ends(self, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The highest node at or below the end of each stretch."""
        lo = self.text.rank[start]
        hi = lo.copy()
        shared = self.text.shared
        for k in range(len(self.least) - 1, -1, -1):
            width = 1 << k
            can = np.flatnonzero(lo - width >= 0)
            can = can[shared[self.least[k][lo[can] - width + 1]] >= length[can]]
            lo[can] -= width
            can = np.flatnonzero(hi + width < self.text.n)
            can = can[shared[self.least[k][hi[can] + 1]] >= length[can]]
            hi[can] += width
        out = lo.copy()
        wide = np.flatnonzero(lo < hi)
        out[wide] = self.above(lo[wide], hi[wide])
        return out


def squares(codes: np.ndarray, longest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of all squares with primitive halves of at most `longest`; the last code must occur once."""
    text = _Text(codes)
    start, half = _covering(text, longest)
    some = _primitive(text, start, half)
    start, half = start[some], half[some]
    if not len(start):
        return start, half
    tree = _Tree(text, codes)
    depth, parent, link, witness, child, width, root = tree.depth.tolist(), tree.parent.tolist(), tree.link.tolist(), tree.witness.tolist(), tree.child, tree.width, tree.root
    word, top = codes.tolist(), text.n + 1
    known: set[int] = set()
    for i, k, v in zip(start.tolist(), half.tolist(), tree.ends(start, 2 * half).tolist()):
        rest = 2 * k - 1
        while v * top + k not in known:
            known.add(v * top + k)
            w = link[parent[v]] if parent[v] != root else root
            while depth[w] < rest:
                w = child[w * width + word[i + 1 + depth[w]]]
            if depth[w] > rest:
                if word[witness[w] + rest] != word[i]:
                    break
                v = w
            else:
                v = child.get(w * width + word[i], -1)
                if v < 0:
                    break
            i = witness[v]
    marks = np.fromiter(known, np.int64, len(known))
    node, half = marks // top, marks % top
    times = tree.hi[node] - tree.lo[node] + 1
    return text.places[_runs(times, tree.lo[node])], np.repeat(half, times)


def runs_of(codes: np.ndarray, longest: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) of all runs of squares() that hold their period twice or more."""
    place, half = squares(codes, longest)
    order = np.lexsort((place, half))
    place, half = place[order], half[order]
    if not len(place):
        return np.zeros((0, 3), dtype=np.int64)
    new = np.append(True, (np.diff(place) != 1) | (np.diff(half) != 0))
    last = np.append(new[1:], True)
    return np.stack([place[new], place[last] + 2 * half[last] - place[new], half[new]], axis=1)


def candidates(codes: np.ndarray, doc: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(first, end, longest period) of segments of documents laid end to end, outside of which no run of `least` words holds its period `times` times."""
    n, fewest = len(codes), min(max(least, times * q) - q - 2 for q in range(1, least + 1))
    if n < 4:
        return []
    size = int(codes.max()) + 1
    pairs = codes[:-1] * size + codes[1:]
    if size >= 1 << 21:
        pairs = np.unique(pairs, return_inverse=True)[1]
    triple = pairs[:-1] * size + codes[2:]
    within = doc[2:] == doc[:-2]
    at = np.flatnonzero(within)
    order = at[np.argsort(triple[at], kind="stable")]
    again = (triple[order[1:]] == triple[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    far = np.full(n, n, dtype=np.int64)
    far[order[:-1][again]] = (order[1:] - order[:-1])[again]
    live = np.flatnonzero(far < n)
    while len(live):
        new = np.append(True, (np.diff(live) != 1) | (doc[live[1:]] != doc[live[:-1]]))
        first = np.flatnonzero(new)
        lengths = np.diff(np.append(first, len(live)))
        most = np.repeat((lengths + 2) // (times - 1), lengths)
        ok = (far[live] <= most) & np.repeat(lengths >= fewest, lengths)
        if ok.all():
            q = (lengths + 2) // (times - 1)
            return list(zip(live[first].tolist(), (live[first] + lengths + q + 2).tolist(), q.tolist()))
        live = live[ok]
    return []


def document_runs(codes: np.ndarray, sizes: list[int], least: int, times: int) -> list[tuple[int, int, int, int]]:
    """(document, start, length, period), sorted, of the runs in documents laid end to end that are `least` words long and hold their period `times` times."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    ends = np.cumsum(sizes)
    parts, longest, origin, closing = [], [], [], int(codes.max(initial=0)) + 1
    for first, end, q in candidates(codes, doc, least, times):
        end = min(end, int(ends[doc[first]]))
        parts += [codes[first:end], np.array([closing + len(origin)])]  # a sign of its own ends each segment
        longest += [np.full(end - first, q), np.zeros(1, np.int64)]
        origin.append((first, end - first + 1))
    if not parts:
        return []
    starts, spans = map(np.array, zip(*origin))
    offsets = np.cumsum(spans) - spans
    found = runs_of(np.concatenate(parts), np.concatenate(longest))
    found = found[(found[:, 1] >= least) & (found[:, 1] >= times * found[:, 2])]
    segment = np.searchsorted(offsets, found[:, 0], side="right") - 1
    start = found[:, 0] - offsets[segment] + starts[segment]
    length, period, own = found[:, 1], found[:, 2], doc[start]
    # a segment may cut a run that is whole in another one
    stop, low, high = start + length, (ends - np.array(sizes))[own], ends[own]
    left = (start > low) & (codes[np.maximum(start - 1, 0)] == codes[start - 1 + period])
    right = (stop < high) & (codes[np.minimum(stop, len(codes) - 1)] == codes[stop - period])
    keep = ~left & ~right
    return sorted(set(zip(own[keep].tolist(), (start - low)[keep].tolist(), length[keep].tolist(), period[keep].tolist())))


def periodic_runs(docs: DataFrame, least: int = 6, times: int = 4, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of docs.

    runs are (start, length, period) by start and period, of at least `least` words, 6 or more, that hold their period `times` times, 2 or more.
    collapsed is the words, one space between them, without those that a run holds after its first period. change(doc_id, words) may
    give other words for a document.
    """
    if least < 6 or times < 2:
        raise ValueError("runs need six words and two periods at least")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text"):
            ids = batch.column("doc_id").to_pylist()
            words = [(t or "").encode().split() for t in batch.column("text").to_pylist()]  # splits at these bytes and no other ones
            if change is not None:
                words = [change(i, w) for i, w in zip(ids, words)]
            index, sizes = _Places(), [len(w) for w in words]
            codes = np.fromiter((index[w] for own in words for w in own), np.int64, sum(sizes))
            runs: list[list[dict]] = [[] for _ in ids]
            for i, start, length, period in document_runs(codes, sizes, least, times):
                runs[i].append({"start": start, "length": length, "period": period})
            collapsed = []
            for own, found in zip(words, runs):
                if found:
                    kept = np.ones(len(own), dtype=bool)
                    for r in found:
                        kept[r["start"] + r["period"] : r["start"] + r["length"]] = False
                    own = [own[i] for i in np.flatnonzero(kept).tolist()]
                collapsed.append(b" ".join(own))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(runs, _RUNS), pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def described(rows: DataFrame) -> DataFrame:
    """periodic_runs() with their number, the one of greatest length by period, and digests.

    Lengths by period are compared as doubles, which tell all fractions of documents below 2^26 words apart.
    """
    best = F.get(F.sort_array(F.transform("runs", lambda r: F.struct((-(r["length"] / r["period"])).alias("e"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))), "")
    return rows.withColumn("_b", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_b.start", "_b.length", "_b.period", F.expr("1000 * _b.length div _b.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """One document in ten, by its id's checksum, becomes periodic from some word on; null ids never do."""
    from zlib import crc32

    if doc_id is None or not words:
        return words
    h, n = crc32(b"%d" % doc_id), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]
