"""Byte-level BPE encoding by merge replay over the corpus, and decoding.

Every distinct word of the corpus is encoded once.  Texts are first split into words; a chunk of texts becomes a file of
numbers in a dictionary of its own, and only the dictionaries travel.  Their entries are dealt out by the words' hash, packed by
bucket, so that a word meets itself in one task, whatever number of chunks have it.  There all words lie in one array of tokens, an inverted index
leads from each pair's rank to the places where it stands, and ranks are applied in rising order to all their
places at once.  A merge only touches its two neighbours, whose new pairs enter the index.  Overlapping places are taken from
the left.  Should a merge make a pair of lower rank than its own, which vocabularies out of training
order allow, that word is encoded by itself, smallest rank first.  Encoded dictionaries then go back to their chunks,
whose files are read again and turned into ids.

A chunk lists a word once, so no word is a hot key; texts are never shuffled. A task keeps encoded words, `keep` at most, and replays one
again if it comes back after that. Each attempt of a task has files of its own, and only
those in the table that Spark commits are read. Whole texts are encoded, of any length. Null and empty texts have no ids.
Rows may repeat, each is encoded; ids may be null; extra columns are ignored, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._encode import read_ranks
from ._shared import file_system, new_path, small, written

_NONE = 1 << 30
_FEW = 24
CHUNK = 32 << 20  # bytes of text, at least
BUCKETS = 2048  # at least
REPLAY = 1000  # packed buckets
DOCUMENTS = 1 << 20  # words


def _distinct(parts: list) -> np.ndarray:
    x = np.sort(np.concatenate(parts))
    return x[np.append(True, x[1:] != x[:-1])] if len(x) else x


class Merges:
    """The vocabulary as pairs of ids."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.bytes_of = {v: k for k, v in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 20 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, or _NONE."""
        key = a << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at], _NONE)

    def alone(self, word: bytes) -> list[int]:
        """One word, always its leftmost smallest rank."""
        parts = [int(self.single[b]) for b in word]
        while len(parts) > 1:
            best = min((self.pairs.get(a << 20 | b, _NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if best[0] == _NONE:
                break
            parts[best[1] : best[1] + 2] = [best[0]]
        return parts

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        data = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        ends = np.cumsum(sizes)
        token = self.single[data]
        n = len(token)
        word = np.repeat(np.arange(len(words)), sizes)
        after = np.arange(1, n + 1)
        after[ends - 1] = n  # n: no neighbour
        before = np.arange(-1, n - 1)
        before[ends - sizes] = n
        current = np.full(n + 1, _NONE, dtype=np.int64)  # rank of the pair that starts here
        inner = np.flatnonzero(after < n)
        current[inner] = self.rank(token[inner], token[after[inner]])
        odd: set[int] = set()
        index: dict[int, list] = defaultdict(list)
        live = inner[current[inner] < _NONE]
        live = live[np.argsort(current[live], kind="stable")]
        first = np.append(0, np.flatnonzero(np.diff(current[live])) + 1) if len(live) else []
        for part in np.split(live, first[1:]) if len(live) else []:
            index[int(current[part[0]])].append(part)
        heap = list(index)
        heapify(heap)
        while heap:
            rank = heappop(heap)
            places = index.pop(rank)
            if sum(map(len, places)) <= _FEW:
                self._few(rank, sorted({int(i) for p in places for i in p}), token, after, before, current, index, heap, word, odd)
                continue
            at = _distinct(places)
            at = at[current[at] == rank]
            nxt = after[at]
            if len(at) > 1:  # of places that overlap, every second one from the left
                joined = np.append(False, nxt[:-1] == at[1:])
                if joined.any():
                    head = np.maximum.accumulate(np.where(joined, 0, np.arange(len(at))))
                    at = at[(np.arange(len(at)) - head) % 2 == 0]
                    nxt = after[at]
            if not len(at):
                continue
            token[at] = rank
            current[nxt] = _NONE
            far = after[nxt]
            after[at] = far
            some = far < n
            before[far[some]] = at[some]
            current[at] = _NONE
            left = before[at]
            left = left[left < n]
            fresh = _distinct([left, at[some]])
            value = self.rank(token[fresh], token[after[fresh]])
            current[fresh] = value
            odd.update(word[fresh[value < rank]].tolist())
            ok = value < _NONE
            fresh, value = fresh[ok], value[ok]
            order = np.argsort(value, kind="stable")
            fresh, value = fresh[order], value[order]
            if len(fresh):
                for part in np.split(fresh, np.flatnonzero(np.diff(value)) + 1):
                    r = int(current[part[0]])
                    if r not in index:
                        heappush(heap, r)
                    index[r].append(part)
        out: list[list[int]] = []
        tokens, following = token.tolist(), after.tolist()
        for i, (start, size) in enumerate(zip((ends - sizes).tolist(), sizes.tolist())):
            if i in odd:
                out.append(self.alone(words[i]))
                continue
            ids = []
            while start < n:
                ids.append(tokens[start])
                start = following[start]
            out.append(ids)
        return out

    def _few(self, rank, places, token, after, before, current, index, heap, word, odd) -> None:
        """The same step for few places."""
        n, pairs = len(token), self.pairs
        for i in places:
            if current[i] != rank:
                continue
            j = after[i]
            far = after[j]
            token[i] = rank
            current[i] = current[j] = _NONE
            after[i] = far
            if far < n:
                before[far] = i
            for a in (before[i], i):
                if a < n and after[a] < n:
                    value = pairs.get(int(token[a]) << 20 | int(token[after[a]]), _NONE)
                    current[a] = value
                    if value < rank:
                        odd.add(int(word[a]))
                    if value < _NONE:
                        if value not in index:
                            heappush(heap, value)
                        index[value].append((a,))


class _Places(dict):
    """Numbers of words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _file(root: str, number: int) -> str:
    return f"{root}/chunk-{number}.arrow"


_CHUNK = pa.schema([("doc_id", pa.int64()), ("places", pa.list_(pa.uint32()))])


def _blob(sizes: np.ndarray, pos: np.ndarray, data: bytes) -> bytes:
    import zstandard

    return zstandard.compress(sizes.astype("<u4").tobytes() + np.diff(pos, prepend=0).astype("<i4").tobytes() + data, 1)


def _unblob(blob: bytes, n: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    import zstandard

    raw = zstandard.decompress(blob)
    return np.frombuffer(raw, "<u4", n), np.cumsum(np.frombuffer(raw, "<i4", n, 4 * n)), raw[8 * n :]


def _split(folder: str, pattern: str, least: int, buckets: int):
    """Files of places, and the words that they stand for, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        split = regex.compile(pattern).findall
        store, root = file_system(folder)
        store.create_dir(root, recursive=True)
        number, size = TaskContext.get().taskAttemptId() << 20, 0
        index, writer, sink = _Places(), None, None

        def closed() -> pa.RecordBatch:
            writer.close()
            sink.close()
            words = [w.encode("utf-8", "surrogatepass") for w in index]
            bucket = np.fromiter(map(crc32, words), np.int64, len(words)) % buckets
            order = np.argsort(bucket, kind="stable")
            runs = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)  # one empty run where there are no words
            packed = [[words[i] for i in run] for run in runs]
            blobs = [_blob(np.fromiter(map(len, own), np.int64, len(own)), run, b"".join(own)) for run, own in zip(runs, packed)]
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(runs), number)), pa.array([int(bucket[run[0]]) if len(run) else 0 for run in runs], pa.int32()), pa.array([len(run) for run in runs], pa.int32()), pa.array(blobs, pa.binary())],
                names=["chunk", "bucket", "n", "packed"],
            )

        for batch in small(batches, "text"):
            if writer is None:
                sink = store.open_output_stream(_file(root, number), compression=None)
                writer = pa.ipc.new_file(sink, _CHUNK, options=pa.ipc.IpcWriteOptions(compression="zstd"))
            found = [split(t) if t else [] for t in batch.column("text").to_pylist()]
            ends = np.zeros(len(found) + 1, dtype=np.int32)
            np.cumsum([len(words) for words in found], out=ends[1:])
            places = np.fromiter(map(index.__getitem__, chain.from_iterable(found)), np.uint32, int(ends[-1]))
            writer.write_batch(pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), pa.array(places))], schema=_CHUNK))
            size += batch.column("text").nbytes
            if size >= least:
                yield closed()
                number, size, index, writer = number + 1, 0, _Places(), None
        if writer is not None:
            yield closed()

    return run


def _replayed(ranks_path: str, keep: int):
    """The ids of each packed word; a word is replayed when it is first met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = Merges(read_ranks(ranks_path))
        known: dict[bytes, list[int]] = {}
        for whole in batches:
            for at in range(0, whole.num_rows, REPLAY):
                batch = whole.slice(at, REPLAY)
                rows = []
                for n, blob in zip(batch.column("n").to_pylist(), batch.column("packed").to_pylist()):
                    sizes, pos, data = _unblob(blob, n)
                    ends = np.cumsum(sizes).tolist()
                    rows.append((pos, [data[a:b] for a, b in zip([0, *ends], ends)]))
                every = set().union(*(words for _, words in rows))
                if len(known) + len(every) > keep:
                    known.clear()
                new = list(every.difference(known))
                known.update(zip(new, merges.replay(new)))
                out = []
                for pos, words in rows:
                    ids = [known[w] for w in words]
                    out.append(_blob(np.fromiter(map(len, ids), np.int64, len(ids)), pos, np.fromiter(chain.from_iterable(ids), "<u4").tobytes()))
                yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("n"), pa.array(out, pa.binary())], names=["chunk", "n", "ids"])

    return run


def _runs(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _documents(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_id, first token of each document and the end, ids) of bounded runs of documents, from encoded dictionaries sorted by chunk."""
    store, root = file_system(folder)

    def chunk(number: int, parts: list[tuple[int, bytes]]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
        sizes, pos, data = zip(*(_unblob(blob, n) for n, blob in parts))
        sizes, order, ids = np.concatenate(sizes).astype(np.int64), np.argsort(np.concatenate(pos)), np.frombuffer(b"".join(data), "<u4")
        ids = ids[_runs(sizes[order], (np.cumsum(sizes) - sizes)[order])]
        sizes = sizes[order]
        first = np.cumsum(sizes) - sizes
        with store.open_input_file(_file(root, number)) as source:
            reader = pa.ipc.open_file(source)
            for i in range(reader.num_record_batches):
                batch = reader.get_batch(i)
                ends, places = batch.column("places").offsets.to_numpy().astype(np.int64), batch.column("places").values.to_numpy()
                at = 0
                while at < batch.num_rows:
                    to = max(at + 1, int(np.searchsorted(ends, ends[at] + DOCUMENTS, side="right")) - 1)
                    own = places[ends[at] : ends[to]]
                    n = sizes[own]
                    total = np.append(0, np.cumsum(n))
                    yield batch.column("doc_id").slice(at, to - at), total[ends[at : to + 1] - ends[at]], ids[_runs(n, first[own])]
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
            part = batch.slice(lo, hi - lo)
            held += zip(part.column("n").to_pylist(), part.column("ids").to_pylist())
    if held:
        yield from chunk(now, held)


class _Vocabulary:
    """Bytes and decimal digits of ids, for whole arrays of them."""

    def __init__(self, ranks_path: str):
        ranks = read_ranks(ranks_path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.tokens, self.numbers = pa.array(tokens, pa.binary()), pa.array([b"%d " % i for i in range(len(tokens))], pa.binary())

    @staticmethod
    def joined(kind: pa.Array, ids: np.ndarray, first: np.ndarray) -> tuple[memoryview, list[int]]:
        """What ids stand for, one after the other, and where the documents that begin at `first` do."""
        found = pc.take(kind, pa.array(ids))
        ends = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1, 4 * found.offset) if len(found) else np.zeros(1, np.int32)
        return memoryview(found.buffers()[2] or b""), ends[first].tolist()


def _entries(docs: DataFrame, folder: str, ranks_path: str, pattern: str, least: int, keep: int) -> DataFrame:
    """(chunk, n, ids) of the dictionaries of all chunks, in the order in which _documents() reads them."""
    buckets = max(BUCKETS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = written(texts.mapInArrow(_split(folder, pattern, least, buckets), "chunk long, bucket int, n int, packed binary"), "bpe-words")
    ids = words.repartition("bucket").mapInArrow(_replayed(ranks_path, keep), "chunk long, n int, ids binary")
    return ids.repartition("chunk").sortWithinPartitions("chunk")


def encode_decode(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, keep: int = 1_000_000) -> DataFrame:
    """(doc_id, ids, decoded) for every row of docs (doc_id, text, ...)."""
    folder = new_path(docs.sparkSession, "bpe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(ranks_path)
        for doc_id, first, ids in _documents(folder, batches):
            text, ends = known.joined(known.tokens, ids, first)
            decoded = pa.array([bytes(text[a:b]) for a, b in zip(ends, ends[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([doc_id, pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids, pa.int32())), decoded], names=["doc_id", "ids", "decoded"])

    return _entries(docs, folder, ranks_path, pattern, chunk, keep).mapInArrow(run, "doc_id long, ids array<int>, decoded binary")


def digests(docs: DataFrame, ranks_path: str, pattern: str, chunk: int = CHUNK, keep: int = 1_000_000) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): what encode_decode returns, in short."""
    folder = new_path(docs.sparkSession, "bpe")
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Vocabulary(ranks_path)
        for doc_id, first, ids in _documents(folder, batches):
            text, ends = known.joined(known.tokens, ids, first)
            said, stops = known.joined(known.numbers, ids, first)
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(np.diff(first)), pa.array([sha(said[a : max(a, b - 1)]) for a, b in zip(stops, stops[1:])]), pa.array([sha(text[a:b]) for a, b in zip(ends, ends[1:])])],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return _entries(docs, folder, ranks_path, pattern, chunk, keep).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
