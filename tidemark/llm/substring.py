"""Removal of word windows that occur earlier in the corpus, by super-k-mer partitioning.

A window is `window` consecutive words.  Every window has a minimiser, the smallest hash of its
word trigrams; consecutive windows with one minimiser form a super-k-mer.  A first pass counts
minimisers, for a window can only repeat if its minimiser does.  Super-k-mers of repeated minimisers
then travel as one packed string to the minimiser's bucket.  Equal strings are merged on the way
and sorting the windows of a bucket tells each window's first place; words are compared byte by
byte, so hashes never decide.  A bucket above `bucket` strings (a common phrase in many contexts) is
dealt out window by window instead, with the same result.

Words are `[^\\x20\\x09-\\x0D]+`, unchanged.  Null texts have no words.  The first place of a window is the
one with the smallest (doc_id, digest of the text, start); null ids come first.  Rows that repeat both id
and text count as one document and get the same result.  Texts of any length are read whole. Columns to carry travel in a
struct, so no name clashes; other extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ._shared import BATCH, forget, quoted, small, sorted_groups, written
from ._words import Words, chain

GRAM = 3
RUN = 256


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by doubling."""
    have = 1
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _runs(words: Words, window: int) -> tuple[np.ndarray, ...]:
    """Of the super-k-mers of a batch: text, first word in the batch, windows, minimiser, places of the minimiser."""
    none = np.empty(0, np.int64)
    n = len(words.hashes)
    if n < window:
        return none, none, none, none, none
    grams = chain(words.hashes, GRAM)
    low = _sliding_min(grams, window - GRAM + 1)
    counts = np.diff(words.first)
    text = np.repeat(np.arange(len(counts)), counts)
    ends = np.repeat(words.first[1:], counts)
    at = np.arange(len(low))
    valid = at + window <= ends[: len(low)]
    new = valid.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~valid[:-1]
    starts = np.flatnonzero(new)
    if not len(starts):
        return none, none, none, none, none
    lengths = np.add.reduceat(valid.astype(np.int64), starts)
    parts = -(-lengths // RUN)  # a run in text that repeats itself may be very long
    if parts.max() > 1:
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        lengths = np.minimum(np.repeat(lengths, parts) - inner * RUN, RUN)
        starts = np.repeat(starts, parts) + inner * RUN
    key = low[starts]
    spans = lengths + window - GRAM
    place = np.cumsum(spans) - spans
    source = np.repeat(starts - place, spans) + np.arange(spans.sum())
    hits = np.add.reduceat((grams[source] == np.repeat(key, spans)).astype(np.int64), place)
    return text[starts], starts, lengths, key.view(np.int64), hits


def _occurrences(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist())
            text, starts, lengths, key, hits = _runs(words, window)
            pick = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").take(pick), batch.column("digest").take(pick), pa.array((starts - words.first[text]).astype(np.int32)), pa.array(lengths.astype(np.int32)), pa.array(key), pa.array(hits)],
                names=["doc", "digest", "start", "n", "key", "hits"],
            )

    return run


def _packed(window: int):
    """The flagged super-k-mers of each document as packed strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist())
            joined, places = words.joined()
            flags = batch.column("flags")
            rows = np.repeat(np.arange(batch.num_rows), np.diff(flags.offsets.to_numpy()))
            inner = flags.flatten()
            start, n, key = (inner.field(c).to_numpy() for c in ("start", "n", "key"))
            first = words.first[rows] + start
            cut = [joined[a:b] for a, b in zip(places[first].tolist(), (places[first + n + window - 1] - 1).tolist())]
            pick = pa.array(rows)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(cut, pa.binary()), batch.column("doc").take(pick), batch.column("digest").take(pick), pa.array(start)], names=["key", "packed", "doc", "digest", "start"])

    return run


def _windows(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and first word of every window of rows of packed strings."""
    n = np.diff(words.first) - window + 1
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, offset, words.first[row] + offset


def _first_places(window: int):
    """Runs of windows that occur first, from buckets sorted by key and place."""

    def starts(table: pa.Table) -> np.ndarray:
        key = table.column("key").to_numpy()
        return np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in sorted_groups(small(batches, "packed", 2 << 20), starts):
            words = Words(table.column("packed").to_pylist())
            row, offset, at = _windows(words, window)
            prints = chain(words.hashes, window)[at]
            order = np.lexsort((prints, table.column("key").to_numpy()[row]))  # stable: equal windows stay in order of place
            same = prints[order[1:]] == prints[order[:-1]]
            first = np.ones(len(order), dtype=bool)
            joined, places = words.joined()
            seen: dict[bytes, None] = {}
            for i in np.flatnonzero(same).tolist():  # windows with one hash: their bytes decide
                a, b = (joined[places[at[k]] : places[at[k] + window]] for k in (order[i], order[i + 1]))
                if i == 0 or not same[i - 1]:
                    seen = {a: None}
                first[order[i + 1]] = b not in seen
                seen[b] = None
            place = np.flatnonzero(first)
            new = np.ones(len(place), dtype=bool)
            new[1:] = (row[place[1:]] != row[place[:-1]]) | (place[1:] != place[:-1] + 1)
            head = np.flatnonzero(new)
            n = np.diff(np.append(head, len(place)))
            pick = pa.array(row[place[head]])
            start = table.column("start").to_numpy()[row[place[head]]] + offset[place[head]]
            got = pa.table({"doc": table.column("doc").take(pick), "digest": table.column("digest").take(pick), "start": start.astype(np.int32), "n": n.astype(np.int32)})
            yield from got.to_batches()

    return run


def _single(window: int):
    """Every window of packed strings by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "packed", 1 << 20):
            words = Words(batch.column("packed").to_pylist())
            row, offset, at = _windows(words, window)
            joined, places = words.joined()
            cut = [joined[a:b] for a, b in zip(places[at].tolist(), (places[at + window] - 1).tolist())]
            pick = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary()), batch.column("doc").take(pick), batch.column("digest").take(pick), pa.array((batch.column("start").to_numpy()[row] + offset).astype(np.int32))], names=["packed", "doc", "digest", "start"])

    return run


def _kept(window: int):
    """The words left in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist())
            joined, places = words.joined()
            change = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            for name, sign in (("flags", 1), ("firsts", -1)):
                runs = batch.column(name)
                rows = np.repeat(np.arange(batch.num_rows), np.diff(runs.offsets.to_numpy()))
                inner = runs.flatten()
                start, n = inner.field("start").to_numpy(), inner.field("n").to_numpy()
                np.add.at(change, words.first[rows] + start, sign)
                np.add.at(change, words.first[rows] + start + n, -sign)
            repeats = np.flatnonzero(np.cumsum(change)[:-1] > 0)
            cover = np.zeros(len(words.hashes) + 1, dtype=np.int64)
            np.add.at(cover, repeats, 1)
            np.add.at(cover, repeats + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept, removed = [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                out = gone[a:b]
                removed.append(int(out.sum()))
                if not removed[-1]:
                    kept.append(joined[places[a] : places[b]][:-1])
                    continue
                edge = np.flatnonzero(np.diff(np.concatenate([[True], out, [True]]).astype(np.int8)))
                kept.append(b"".join(joined[places[a + s] : places[a + e]] for s, e in zip(edge[0::2].tolist(), edge[1::2].tolist()))[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc", "text", "rest")), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(np.diff(words.first)), pa.array(removed, pa.int64())], names=["doc_id", "text", "rest", "kept", "n_words", "n_removed"])

    return run


def _with(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on doc (null equals null) and digest."""
    right = right.withColumnsRenamed({"doc": "_doc", "digest": "_digest"})
    return left.join(right, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("digest") == F.col("_digest")), how).drop("_doc", "_digest")


def repeats_removed(docs: DataFrame, window: int = 20, bucket: int = 1000, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, kept, n_words, n_removed and, in the struct `rest`, the columns in carry) for every row of docs (doc_id, text, ...)."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64("text").alias("digest"), F.col("text").cast("string").alias("text"), F.struct(*[F.col(quoted(c)) for c in carry] or [F.lit(0).alias("_")]).alias("rest"))
    texts = whole.drop("rest")
    occ = written(texts.mapInArrow(_occurrences(window), "doc long, digest long, start int, n int, key long, hits long"), "kmers")
    again = written(occ.groupBy("key").agg(F.sum("hits").alias("hits")).where("hits > 1").select("key"), "kmers-again")
    flags = written(occ.join(again, "key").groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "n", "key")).alias("flags")), "kmers-flags")
    forget(occ, again)
    strings = _with(texts, flags, "inner").mapInArrow(_packed(window), "key long, packed binary, doc long, digest long, start int")
    strings = strings.groupBy("key", "packed").agg(F.min(F.struct("doc", "digest", "start")).alias("at")).select("key", "packed", "at.*")
    strings = written(strings, "kmers-packed")
    hot = written(strings.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > bucket).select("key"), "kmers-hot")
    calm = strings.join(hot, "key", "left_anti").repartition("key").sortWithinPartitions("key", "doc", "digest", "start")
    calm = calm.mapInArrow(_first_places(window), "doc long, digest long, start int, n int")
    single = strings.join(hot, "key", "left_semi").mapInArrow(_single(window), "packed binary, doc long, digest long, start int")
    single = single.groupBy("packed").agg(F.min(F.struct("doc", "digest", "start")).alias("at")).select("at.*", F.lit(1).alias("n"))
    firsts = calm.unionByName(single).groupBy("doc", "digest").agg(F.collect_list(F.struct("start", "n")).alias("firsts"))
    none = F.array().cast("array<struct<start:int,n:int>>")
    marks = _with(flags, firsts, "left").select("doc", "digest", F.expr("transform(flags, x -> struct(x.start AS start, x.n AS n))").alias("flags"), F.coalesce("firsts", none).alias("firsts"))
    marks = written(marks, "kmers-marks")
    forget(strings, hot, flags)
    marked = _with(whole, marks, "left").select("doc", "text", "rest", F.coalesce("flags", none).alias("flags"), F.coalesce("firsts", none).alias("firsts"))
    schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), whole.schema["rest"], StructField("kept", StringType()), StructField("n_words", LongType()), StructField("n_removed", LongType())])
    out = marked.mapInArrow(_kept(window), schema)
    return out if carry else out.drop("rest")
