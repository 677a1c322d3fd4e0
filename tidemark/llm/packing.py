"""Packing of documents into training sequences: dominance reduction, then best fit.

Texts are tokenised in tasks.  How many pieces there are of each length, at most `capacity` numbers, is all
that planning needs: the plan is made on these counts and grows with the capacity and not with the
corpus.  First the reduction by Martello and Toth fixes sets that dominate any other set with the same
largest piece: a piece that nothing fits beside, a perfect pair, the best partner where only one
fits, or a partner no smaller than the best two others.  Best fit by falling length packs the rest, equal sequences at a time.
Each piece then finds its place by its rank among the pieces of its length; ranks are counted by
input partition, so no length is gathered in one task.

Only documents above the capacity are cut, into pieces of full capacity after a first, perhaps shorter, one. Null
and empty texts are one piece of the closing id. Rows may repeat; each is packed. Null ids are kept. Texts of any length,
runs of a million spaces included, are encoded whole. Pieces of one length are interchangeable, so ties go by input order.
Extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._encode import encoder, has_long_run
from ._shared import small, written


def _encoder(vocabulary: str):
    """Token ids of a text as the vocabulary's own tokenizer gives them.

    The rank file beside the vocabulary holds the same tokens and encodes four times as fast; texts that name a
    special token or hold a very long run of white space go through the vocabulary's own tokenizer.
    """
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary)
    special = [t.content for t in own.get_added_tokens_decoder().values()]
    fast = encoder(vocabulary.rsplit(".", 1)[0] + ".tiktoken", public_tokenizers.PATTERN)

    def ids(text: str) -> list[int]:
        if has_long_run(text) or any(s in text for s in special):
            return own.encode(text, add_special_tokens=False).ids
        return fast(text)

    return ids


def _pieces(vocabulary: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = _encoder(vocabulary), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in small(batches, "text"):
            rows = []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array(encode(text or "") + [end], dtype="<u4")
                head = (len(ids) - 1) % capacity + 1
                for piece, start in enumerate([0, *range(head, len(ids), capacity)]):
                    own = ids[start : head if piece == 0 else start + capacity]
                    rows.append((i, piece, start, len(own), zlib.crc32(own.tobytes()), seen[len(own)]))
                    seen[len(own)] += 1
            row, piece, start, length, crc, nth = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(nth, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


class Plan:
    """Places for counts[n] pieces of each length n, as runs of ranks.

    A run is (length, first rank, pieces per sequence, first sequence, sequences, offset).
    """

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.left = capacity, {n: c for n, c in counts.items() if c}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int, int]] = []
        self.sequences = self.fixed = 0
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _place(self, length: int, each: int, first: int, sequences: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], each, first, sequences, offset))
        self.rank[length] += each * sequences
        self.left[length] -= each * sequences
        if not self.left[length]:
            del self.left[length]

    def _fix(self, lengths: list[int]) -> None:
        """As many sequences of these lengths as there are pieces for."""
        n = min(self.left[x] // lengths.count(x) for x in lengths)
        offset = 0
        for x in lengths:
            self._place(x, 1, self.sequences, n, offset)
            offset += x
        self.sequences += n

    def _dominant(self, n: int, sizes: list[int]) -> list[int] | None:
        """A set with n that is at least as good as any other set in which n is the largest piece."""
        room = self.capacity - n
        take = lambda x, k: self.left.get(x, 0) - (x == n) >= k
        fit = [x for x in sizes[: bisect_left(sizes, room + 1)] if take(x, 1)]
        if not fit:
            return [n]
        best = fit[-1]
        if best == room:
            return [n, best]
        low = fit[0]
        second = low if take(low, 2) else fit[1] if len(fit) > 1 else None
        if second is None or low + second > room:
            return [n, best]
        third = low if take(low, 3) else second if second != low and take(second, 2) else next((x for x in fit if x > second), None)
        if third is not None and low + second + third <= room:
            return None
        i, j, pair = 0, len(fit) - 1, 0
        while i <= j:
            if fit[i] + fit[j] > room or (i == j and not take(fit[i], 2)):
                j -= 1
            else:
                pair = max(pair, fit[i] + fit[j])
                i += 1
        return [n, best] if best >= pair else None

    def _reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for n in sorted(self.left, reverse=True):
                while n in self.left and (found := self._dominant(n, sorted(self.left))):
                    self._fix(found)
                    changed = True

    def _best_fit(self) -> None:
        """Sequences with the same room left are filled together."""
        open_: dict[int, list[tuple[int, int]]] = {}  # room: (first sequence, sequences)
        rooms: list[int] = []

        def add(room: int, first: int, n: int) -> None:
            if n and room:
                if room not in open_:
                    rooms.insert(bisect_left(rooms, room), room)
                open_.setdefault(room, []).append((first, n))

        for length in sorted(self.left, reverse=True):
            while length in self.left:
                at = bisect_left(rooms, length)
                if at == len(rooms):
                    each = min(self.capacity // length, self.left[length])
                    n = self.left[length] // each
                    first, room = self.sequences, self.capacity
                    self.sequences += n
                else:
                    room = rooms[at]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[at]
                    each = min(room // length, self.left[length])
                    used = min(n, self.left[length] // each)
                    add(room, first + used, n - used)
                    n = used
                self._place(length, each, first, n, self.capacity - room)
                add(room - each * length, first, n)


def _seated(runs: list[tuple], capacity: int):
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, 6)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            behind = rank - at[:, 1]
            sequence = at[:, 3] + behind // at[:, 2]
            offset = at[:, 5] + behind % at[:, 2] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs (doc_id, text, ...)."""
    run, schema = _pieces(vocabulary, capacity, end)
    pieces = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, schema), "pieces")
    parts = written(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "pieces-counts")
    counts = {r.length: r.n for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranked = pieces.join(written(parts.withColumn("before", before).select("part", "length", "before"), "pieces-ranks").hint("merge"), ["part", "length"])
    run, schema = _seated(Plan(counts, capacity).runs, capacity)
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank")).mapInArrow(run, schema)
