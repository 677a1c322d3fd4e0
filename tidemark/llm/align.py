"""Alignment of two tokenizers' tokens over the corpus.

A is a byte-level vocabulary by ranks, B a piece vocabulary with byte fallback; both encode a space and the text. Ends of tokens are running sums
of their bytes; ends that A and B share cut a text into groups, and tokens are labelled with their group by binary search. Every A token is
linked with the B tokens whose bytes it overlaps, by repeating it as often as there are such. Links are counted by id pair over the whole
corpus in two shuffles, the first one salted, so that a frequent pair meets in no task.

No token of either vocabulary holds the place where white space follows a word: A's pattern never does, and B is asked, so that without such a
promise texts stay whole. Texts are cut there, and a chunk of texts aligns each distinct unit once. Only a chunk's distinct pairs
travel; a chunk is bounded by bytes, or is one text. Files carry the attempt's number, and only those that Spark's committed table names are read.

Null and empty texts, and those whose joined tokens of A or B differ from space and text (B reads its own sign for a space as one) have no
tokens: zeros and empty groups. Special tokens' strings are plain text. Whole texts of any length are aligned. Rows may repeat, each counts;
ids may be null; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._encode import encoder, read_ranks
from ._shared import file_system, new_path, small, written
from .bpe import _Places, _runs

CHUNK = 8 << 20  # bytes of text, at least
SALTS = 16
TOKENS = 1 << 19  # bytes of groups that one batch of results holds, at least
_ODD = re.compile(r"[^\S \t\n]")
_PLACES = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(pa.uint32()))])
_UNITS = pa.schema([("groups", pa.binary()), ("n_a", pa.int32()), ("n_b", pa.int32()), ("n_groups", pa.int32()), ("pairs", pa.list_(pa.uint32()))])


class Pair:
    """Both vocabularies."""

    def __init__(self, ranks_path: str, pattern: str, pieces_path: str):
        import sentencepiece

        self.encode_a = encoder(ranks_path, pattern)
        ranks = read_ranks(ranks_path)
        bytes_a = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            bytes_a[i] = token
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        size = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(size)]
        bytes_b = [bytes([int(p[3:-1], 16)]) if self.pieces.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(names)]
        self.space = self.pieces.piece_to_id("▁")
        self.cuts = all(self.pieces.is_byte(i) or not re.search(r"[\t\n]|[^▁]▁", p) for i, p in enumerate(names))
        self.bytes_a, self.bytes_b = pa.array(bytes_a, pa.binary()), pa.array(bytes_b, pa.binary())
        self.size_a, self.size_b = (np.array([len(x) for x in t], dtype=np.int64) for t in (bytes_a, bytes_b))
        said = [b"%d%c" % (i, end) for n, ends in ((len(bytes_a), b",|"), (size, b",;")) for i in range(n) for end in ends]
        self.said = pa.array(said, pa.binary())

    def units(self, text: str) -> list[str]:
        """space and text, cut where white space follows a word."""
        if not self.cuts:
            return [text]
        return re.split(r"(?<=\S)(?=[ \t\n])", text) if _ODD.search(text) else re.findall(r"\s+\S*", text)

    def encode_b(self, units: list[str]) -> list[list[int]]:
        """B adds a space, which stands for a unit's first one, or is dropped before other white space."""
        bare = [u[1:] if u[0] == " " else u for u in units]
        ids = self.pieces.encode(bare, num_threads=1)
        return [[self.space] if u == " " else own if u[0] == " " or own[:1] != [self.space] else own[1:] for u, own in zip(units, ids)]


class Aligned:
    """Units aligned in one pass: their groups in decimal, numbers of tokens and groups, links; ok tells those that both vocabularies give back."""

    def __init__(self, pair: Pair, units: list[str]):
        (a, count_a), (b, count_b) = _flat(lambda some: map(pair.encode_a, some), units), _flat(pair.encode_b, units)
        raw = [u.encode() for u in units]
        self.ok = np.ones(len(units), dtype=bool)
        parts = [(_joined(table, ids), count) for table, ids, count in ((pair.bytes_a, a, count_a), (pair.bytes_b, b, count_b))]
        if any(bytes(data) != b"".join(raw) for (data, _), _ in parts):
            for (data, ends), count in parts:
                stops = ends[np.append(0, np.cumsum(count))].tolist()
                self.ok &= np.fromiter((bytes(data[x:y]) == u for x, y, u in zip(stops, stops[1:], raw)), bool, len(raw))
            a, b, raw = a[np.repeat(self.ok, count_a)], b[np.repeat(self.ok, count_b)], [u if ok else b"" for u, ok in zip(raw, self.ok)]
        del parts
        n = len(units)
        ends_a, ends_b = np.cumsum(pair.size_a[a]), np.cumsum(pair.size_b[b])
        unit_ends = np.cumsum(np.fromiter(map(len, raw), np.int64, n))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
        of_a, of_b, of_group = (np.searchsorted(unit_ends, ends) for ends in (ends_a, ends_b, cuts))
        self.n_a, self.n_b, self.n_groups = (np.bincount(x, minlength=n) for x in (of_a, of_b, of_group))
        # links: the B tokens that end after an A token's start and start before its end
        start_a, start_b = ends_a - pair.size_a[a], ends_b - pair.size_b[b]
        first = np.searchsorted(ends_b, start_a, side="right")
        times = np.searchsorted(start_b, ends_a, side="left") - first
        self.links = np.repeat(a, times) << 20 | b[_runs(times, first)]
        self.n_links = np.bincount(of_a, weights=times, minlength=n).astype(np.int64)
        # groups in decimal: A's tokens, then B's, the last one of each closed by another sign
        before_a, before_b = np.append(0, np.cumsum(np.bincount(group_a, minlength=len(cuts)))), np.append(0, np.cumsum(np.bincount(group_b, minlength=len(cuts))))
        last = lambda g: np.append(g[1:] != g[:-1], True) if len(g) else np.zeros(0, bool)
        order = np.empty(len(a) + len(b), dtype=np.int64)
        order[np.arange(len(a)) + before_b[group_a]] = 2 * a + last(group_a)
        order[np.arange(len(b)) + before_a[group_b + 1]] = 2 * (len(pair.size_a) + b) + last(group_b)
        data, ends = _joined(pair.said, order)
        stops = ends[np.append(0, np.cumsum(self.n_a + self.n_b))].tolist()
        self.groups = [bytes(data[x:y]) for x, y in zip(stops, stops[1:])]


def _flat(encode, units: list[str], most: int = 20_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all units, one after the other, and their numbers."""
    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for at in range(0, len(units), most):
        own = list(encode(units[at : at + most]))
        counts.append(np.fromiter(map(len, own), np.int64, len(own)))
        ids.append(np.fromiter(chain.from_iterable(own), np.int64, int(counts[-1].sum())))
    return np.concatenate(ids), np.concatenate(counts)


def _joined(table: pa.Array, ids: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """What ids stand for, one after the other, and where each begins; one more place ends the last."""
    found = pc.take(table, pa.array(ids))
    ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, 4 * found.offset) if len(found) else np.zeros(1, np.int32)
    return memoryview(found.buffers()[2] or b"")[: ends[-1]], ends


def _name(root: str, number: int, what: str) -> str:
    return f"{root}/{what}-{number}.arrow"


def _chunks(folder: str, vocabularies: tuple[str, str, str], least: int):
    """Files of units and of the units that texts consist of; the chunk's distinct pairs with their links' number, and a row -1 that names the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = Pair(*vocabularies)
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        number = TaskContext.get().taskAttemptId() << 20

        def closed(ids: list[pa.Array], texts: list[np.ndarray], index: _Places) -> pa.RecordBatch:
            units = list(index)
            got = Aligned(pair, units)
            texts = whole(texts, units, got) if not got.ok.all() else texts
            keys, at = np.unique(got.links, return_inverse=True)
            count = np.bincount(np.concatenate([*texts, np.zeros(0, np.uint32)]).astype(np.int64), minlength=len(units))
            links = np.bincount(at, weights=np.repeat(count, got.n_links), minlength=len(keys)).astype(np.int64)
            write("units", _UNITS, [pa.RecordBatch.from_arrays([
                pa.array(got.groups, pa.binary()), *(pa.array(x, pa.int32()) for x in (got.n_a, got.n_b, got.n_groups)),
                pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(got.n_links)), pa.int32()), pa.array(at, pa.uint32())),
            ], schema=_UNITS)])
            ends = np.append(0, np.cumsum([len(t) for t in texts]))
            edges = [0, *np.cumsum([len(x) for x in ids]).tolist()]
            write("places", _PLACES, [
                pa.RecordBatch.from_arrays([x, pa.ListArray.from_arrays(pa.array(ends[i : j + 1] - ends[i], pa.int32()), pa.array(np.concatenate([*texts[i:j], np.zeros(0, np.uint32)]), pa.uint32()))], schema=_PLACES)
                for x, i, j in zip(ids, edges, edges[1:])
            ])
            some = links > 0
            keys, links, own = keys[some], links[some], np.flatnonzero(some)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(keys) + 1, number)), *(pa.array(np.append(-1, x), pa.int32()) for x in (own, keys >> 20, keys & 0xFFFFF)), pa.array(np.append(0, links), pa.int64())],
                names=["chunk", "i", "a", "b", "n"],
            )

        def whole(texts: list[np.ndarray], units: list[str], got: Aligned) -> list[np.ndarray]:
            """Texts with a unit that isn't given back have no tokens: B's normal form only ever shortens, so the whole differs too."""
            return [t if got.ok[t].all() else t[:0] for t in texts]

        def write(what: str, schema: pa.Schema, rows: list[pa.RecordBatch]) -> None:
            with store.open_output_stream(_name(root, number, what), compression=None) as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                for batch in rows:
                    writer.write_batch(batch)

        size, ids, texts, index = 0, [], [], _Places()
        for batch in small(batches, "text"):
            ids.append(batch.column("doc_id"))
            for text in batch.column("text").to_pylist():
                own = pair.units(" " + text) if text else []
                texts.append(np.fromiter(map(index.__getitem__, own), np.uint32, len(own)))
            size += batch.column("text").nbytes
            if size >= least:
                yield closed(ids, texts, index)
                number, size, ids, texts, index = number + 1, 0, [], [], _Places()
        if ids:
            yield closed(ids, texts, index)

    return run


def _results(folder: str):
    """A row for each text, from its chunk's files and the counts of the chunk's pairs, sorted by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)

        def chunk(number: int, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            i, n, best = map(np.concatenate, zip(*parts))
            counts, bests = np.zeros(i.max() + 2, np.int64), np.zeros(i.max() + 2, np.int64)
            counts[i + 1], bests[i + 1] = n, best
            with store.open_input_file(_name(root, number, "units")) as source:
                units = pa.ipc.open_file(source).read_all().combine_chunks()
            links = units.column("pairs").combine_chunks() if units.num_rows else pa.array([], pa.list_(pa.uint32()))
            stops, pairs = links.offsets.to_numpy().astype(np.int64), links.values.to_numpy().astype(np.int64) + 1
            pairs = np.where(pairs < len(counts), pairs, 0)  # pairs of units that no text has
            of_unit = lambda x: np.diff(np.append(0, np.cumsum(x[pairs]))[stops])
            groups = units.column("groups").to_pylist()
            numbers = [*(units.column(c).to_numpy().astype(np.int64) for c in ("n_a", "n_b", "n_groups")), np.diff(stops), of_unit(bests), of_unit(counts)]
            sizes = np.fromiter(map(len, groups), np.int64, len(groups))
            with store.open_input_file(_name(root, number, "places")) as source:
                reader = pa.ipc.open_file(source)
                for k in range(reader.num_record_batches):
                    batch = reader.get_batch(k)
                    ends, places = batch.column("places").offsets.to_numpy().astype(np.int64), batch.column("places").values.to_numpy()
                    bytes_to = np.append(0, np.cumsum(sizes[places]))[ends]
                    at = 0
                    while at < batch.num_rows:
                        to = max(at + 1, int(np.searchsorted(bytes_to, bytes_to[at] + TOKENS, side="right")) - 1)
                        own = places[ends[at] : ends[to]]
                        cut = ends[at : to + 1] - ends[at]
                        sums = [np.diff(np.append(0, np.cumsum(x[own]))[cut]) for x in numbers]
                        said = [groups[u] for u in own.tolist()]
                        texts = [b"".join(said[x:y])[:-1] for x, y in zip(cut.tolist(), cut[1:].tolist())]
                        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, to - at), *map(pa.array, sums), pa.array(texts, pa.binary()).cast(pa.string())], names=_COLUMNS)
                        at = to

        now, held = None, []
        for batch in batches:
            numbers = batch.column("chunk").to_numpy()
            edges = [0, *(np.flatnonzero(numbers[1:] != numbers[:-1]) + 1).tolist(), len(numbers)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                if held and numbers[lo] != now:
                    yield from chunk(now, held)
                    held = []
                now = int(numbers[lo])
                held.append(tuple(batch.column(c).slice(lo, hi - lo).to_numpy(zero_copy_only=False) for c in ("i", "n", "best")))
        if held:
            yield from chunk(now, held)

    return run


_COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]


def pair_counts(pairs: DataFrame, salts: int = SALTS) -> DataFrame:
    """(a, b, links, best) of every id pair that is linked, best for the most frequent of its B id, ties included."""
    salted = pairs.groupBy("a", "b", (F.col("chunk") % salts).alias("salt")).agg(F.sum("n").alias("n"))
    counts = written(salted.groupBy("a", "b").agg(F.sum("n").alias("links")), "aligned-pairs")
    top = counts.groupBy("b").agg(F.max("links").alias("top"))  # a row for each id of B's vocabulary at most
    return counts.join(F.broadcast(top), "b").select("a", "b", "links", (F.col("links") == F.col("top")).alias("best"))


def aligned(docs: DataFrame, ranks_path: str, pattern: str, pieces_path: str, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of docs, and pair_counts() of the corpus.

    groups is `a1,a2|b1;a3|b2,b3`: decimal ids of A and of B, group by group. n_best counts links whose pair is the most frequent of its B id,
    count_sum adds up how often each link's pair is linked in the corpus.
    """
    folder = new_path(docs.sparkSession, "align")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pairs = written(texts.mapInArrow(_chunks(folder, (ranks_path, pattern, pieces_path), chunk), "chunk long, i int, a int, b int, n long"), "aligned-chunks")
    counts = pair_counts(pairs)
    entries = pairs.drop("n").join(counts.hint("merge"), ["a", "b"]).select("chunk", "i", F.col("links").alias("n"), F.col("best").cast("int").alias("best"))
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # in so many words, for rows are few beside the files that they stand for
    rows = entries.repartition(tasks, "chunk").sortWithinPartitions("chunk").mapInArrow(_results(folder), "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return rows, counts.where("links > 0")
