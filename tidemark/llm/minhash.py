"""Near-duplicate classes by a multi-index Hamming join of b-bit minwise signatures.

Every text's set of word shingles gets INDEXED minwise values of sixteen bits, split into
CHUNKS runs; two signatures that differ in at most INDEXED // 2 places agree in some chunk
up to one error, so each chunk is entered once for every place left out (the enumerated
error) and all such pairs meet in a bucket.  Texts that meet another get one bit of each of
HASHES minwise values.  A pair goes on if these bits differ in at most `far` places, and is
linked only after its full shingle sets are compared.

At Jaccard 0.8 a place differs with probability 0.2: more than 32 of 64 has probability
below 1e-8. A bit differs with probability 0.1, and the distance limit lies four and a half
deviations beyond the mean, which rules out most pairs below 0.74.

Pairs already joined through others are not compared again: each text is compared with its nearest neighbour in
another class, again and again until few such pairs are linked, and at last all pairs across the classes left
are. Buckets above `block` rows are split into block pairs, so no group is collected whole. A bucket that would tell more
than `sparse` pairs a row there (form letters, most of them just below the threshold) tells none: its rows come again with
their sets, once a block pair, and a task counts what sets have in common itself and tells one link for each two classes
it joins. So what is written stays linear in the rows of a bucket; what is compared there does not.

Every row gets a number as the table is written once with its sets; sets, buckets, links and classes go by these numbers,
never by doc_id, which may be null or repeated. A set has the number of its first row: the smallest doc_id, nulls
last, then the smallest number. A class keeps the first row of its sets, so one row whatever its ids, and component_id is
that row's doc_id: null where all ids of the class are. Null and empty texts have an empty set, n_shingles 0, and each of
their rows is its own class and kept. Repeated texts fall together before the join. Texts of any length are read whole. Other
columns travel in one struct, so no name clashes. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from ._shared import BATCH, beside_text, forget, small, sorted_groups, unpacked, written
from ._words import Words, mix64, shingle_set
from .components import merged

HASHES = 2048
INDEXED = 64
CHUNKS = 17
_EDGES = np.linspace(0, INDEXED, CHUNKS + 1).astype(int)
_MULTIPLIERS = np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP, _ROWS = 1024, 64
DENSE = -1  # in place of a distance


@dataclass(frozen=True)
class Near:
    """words: of a shingle; percent: least 100 * intersection / union of a link."""

    words: int = 5
    percent: int = 80
    block: int = 4096
    sparse: int = 4  # pairs a row that a bucket may tell one by one
    shingles: int = 1 << 20  # of a block where sets travel

    @property
    def far(self) -> int:
        """Most bits in which linked signatures may differ, matches by chance counted."""
        differ = (1 - self.percent / 100) / 2
        return int(HASHES * differ + 4.5 * (HASHES * differ * (1 - differ)) ** 0.5) + 1


def signature(shingles: np.ndarray, hashes: int) -> np.ndarray:
    """The first `hashes` minwise values of a non-empty set."""
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(hashes, 0xFFFFFFFF, dtype=np.uint32)
    for row in range(0, hashes, _ROWS):
        part, by = low[row : row + _ROWS], _MULTIPLIERS[row : min(row + _ROWS, hashes), None]
        for at in range(0, len(short), _STEP):
            np.minimum(part, (by * short[None, at : at + _STEP]).min(axis=1), out=part)
    return mix64(low.astype(np.uint64) + np.uint64(1))


def _describe(near: Near):
    """Adds the size and hash of each text's set and its indexed minwise values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist(), lower=True)
            rows = []
            for i in range(batch.num_rows):
                s = shingle_set(words.of(i), near.words)
                rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), (signature(s, INDEXED) >> np.uint64(40)).astype(np.uint16).tobytes()) if len(s) else (0, None, None))
            n, ids, idx = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(idx, pa.binary())], names=[*batch.schema.names, "_n", "_set", "_idx"])

    return run


def _numbered(docs: DataFrame, near: Near, carry: bool = False) -> DataFrame:
    """doc_id, text and, with carry, the other columns in the struct `rest`, written with _row, which no other row has, and _n, _set and _idx of their sets."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *([beside_text(docs).alias("rest")] if carry else []), F.monotonically_increasing_id().alias("_row"))
    schema = StructType([*(StructField(f.name, f.dataType) for f in rows.schema), StructField("_n", LongType()), StructField("_set", BinaryType()), StructField("_idx", BinaryType())])
    return written(rows.mapInArrow(_describe(near), schema), "minhash")


def _bits(near: Near):
    """Adds one bit of each minwise value to rows (id, n, idx, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist(), lower=True)
            sig = [np.packbits((signature(shingle_set(words.of(i), near.words), HASHES) >> np.uint64(63)).astype(np.uint8)).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sig, pa.binary())], names=[*batch.schema.names, "sig"])

    return run, "id long, n long, idx binary, text string, sig binary"


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, INDEXED).astype(np.uint64)
        out = []
        for c in range(CHUNKS):
            places = range(_EDGES[c], _EDGES[c + 1])
            for left_out in places:
                key = np.full(len(ids), left_out + 1, np.uint64)
                for p in places:
                    if p != left_out:
                        key = mix64(key * np.uint64(0x10001) + sig[:, p])
                out.append(key)
        slots = np.repeat(np.arange(len(out), dtype=np.int32), len(ids))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out).view(np.int64)), pa.array(np.tile(ids, len(out))), pa.array(slots)], names=["key", "id", "slot"])


def _starts(*names: str):
    def at(table: pa.Table) -> np.ndarray:
        change = np.zeros(table.num_rows, dtype=bool)
        change[0] = True
        for name in names:
            x = table.column(name).to_numpy()
            change[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(change)

    return at


def _shared_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key those whose key another row has too; one row alone waits for the next batch."""
    held: pa.RecordBatch | None = None
    before: int | None = None  # the key of the row before the one held
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([held, batch] if held is not None else [batch])
        key = rows.column("key").to_numpy()
        like = key[1:] == key[:-1]
        shared = np.append(False, like) | np.append(like, False)
        shared[0] |= key[0] == before
        yield from rows.slice(0, len(key) - 1).filter(pa.array(shared[:-1])).to_batches()
        held = rows.slice(len(key) - 1).combine_chunks().to_batches()[0]
        before = int(key[-2]) if len(key) > 1 else before
    if held is not None and before == held.column("key")[0].as_py():
        yield held


def _first_shared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first key that each pair of indexed values shares: the place left out."""
    unlike = (a != b).astype(np.int8)
    per_chunk = np.add.reduceat(unlike, _EDGES[:-1], axis=1)
    return (np.repeat(per_chunk, np.diff(_EDGES), axis=1) == unlike).argmax(axis=1)


def _comparable(near: Near, n: np.ndarray, group: np.ndarray, side: np.ndarray | None) -> np.ndarray:
    """Places of the rows before the last one that lie in another class (and side, if given) and are near it in size."""
    small, large = np.minimum(n[:-1], n[-1]), np.maximum(n[:-1], n[-1])
    keep = (group[:-1] != group[-1]) & (100 * small >= near.percent * large)
    return np.flatnonzero(keep if side is None else keep & (side[:-1] != side[-1]))


def _pairs_in(near: Near, nearest: bool):
    """Pairs (u, v, distance) of a bucket's block pair that may be linked and aren't in one class yet.

    Where all pairs are asked for, distances are 0, and a bucket of too many gives (key, key, DENSE) instead.
    """
    far = near.far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts("key", "bi", "bj")
        for table in sorted_groups(batches, starts):
            first = np.append(starts(table), table.num_rows)
            ids, n, side, group = (table.column(c).to_numpy() for c in ("id", "n", "side", "component"))
            sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint64).reshape(-1, HASHES // 64)
            slot = table.column("slot").to_numpy()
            if not nearest:
                idx = np.frombuffer(b"".join(table.column("idx").to_pylist()), np.uint16).reshape(-1, INDEXED)
            out: list[tuple] = []
            dense: list[int] = []  # keys of buckets that would tell too many pairs
            best, other = np.full(len(ids), far + 1), np.zeros(len(ids), dtype=np.int64)
            for lo, hi in zip(first[:-1], first[1:]):
                split = table.column("bi")[int(lo)].as_py() != table.column("bj")[int(lo)].as_py()
                told_here: list[tuple] = []
                told_rows = 0
                for v in range(lo + 1, hi):
                    u = lo + _comparable(near, n[lo : v + 1], group[lo : v + 1], side[lo : v + 1] if split else None)
                    if not len(u):
                        continue
                    d = np.bitwise_count(sig[u] ^ sig[v]).sum(axis=1, dtype=np.int64)
                    if not nearest:  # a pair is told by the first of the buckets that it shares
                        u = u[d <= far]
                        u = u[_first_shared(idx[u], idx[v]) == slot[v]]
                        if len(u):
                            told_here.append((ids[u], np.full(len(u), ids[v])))
                            told_rows += len(u)
                        if told_rows > near.sparse * (hi - lo):
                            break
                        continue
                    if d.min() < best[v]:
                        best[v], other[v] = d.min(), u[d.argmin()]
                    closer = u[d < best[u]]
                    other[closer] = v
                    best[u] = np.minimum(best[u], d)
                if told_rows > near.sparse * (hi - lo):
                    dense.append(table.column("key")[int(lo)].as_py())
                else:
                    out += told_here
            if nearest:
                v = np.flatnonzero(best <= far)
                yield pa.RecordBatch.from_arrays([pa.array(ids[other[v]]), pa.array(ids[v]), pa.array(best[v].astype(np.int64))], names=["u", "v", "d"])
            if out:
                a, b = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(np.zeros(len(a), np.int64))], names=["u", "v", "d"])
            if dense:
                keys = pa.array(dense, pa.int64())
                yield pa.RecordBatch.from_arrays([keys, keys, pa.array(np.full(len(dense), DENSE))], names=["u", "v", "d"])

    return run


def _linked_in(near: Near):
    """Links (a, b) of a dense bucket's block pair, one for each two classes that are joined."""
    far = near.far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts("key", "bi", "bj")
        for groups in sorted_groups(batches, starts):
            first = np.append(starts(groups), groups.num_rows)
            for lo, hi in zip(first[:-1], first[1:]):
                rows = groups.slice(int(lo), int(hi - lo))
                ids, n, side, slot, group = (rows.column(c).to_numpy() for c in ("id", "n", "side", "slot", "component"))
                side = side if rows.column("bi")[0].as_py() != rows.column("bj")[0].as_py() else None
                sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint64).reshape(-1, HASHES // 64)
                idx = np.frombuffer(b"".join(rows.column("idx").to_pylist()), np.uint16).reshape(-1, INDEXED)
                distinct, flat = np.unique(np.frombuffer(b"".join(rows.column("shingles").to_pylist()), np.uint64), return_inverse=True)
                mine, group = np.split(flat, np.cumsum(n)[:-1]), group.copy()
                mark, out = np.zeros(len(distinct), dtype=np.int32), []
                for v in range(1, len(ids)):
                    u = _comparable(near, n[: v + 1], group[: v + 1], side[: v + 1] if side is not None else None)
                    u = u[np.bitwise_count(sig[u] ^ sig[v]).sum(axis=1, dtype=np.int64) <= far]
                    u = u[_first_shared(idx[u], idx[v]) == slot[v]]
                    if not len(u):
                        continue
                    mark[mine[v]] = 1
                    common = np.add.reduceat(mark[np.concatenate([mine[x] for x in u])], np.cumsum(n[u]) - n[u])
                    mark[mine[v]] = 0
                    u = u[100 * common.astype(np.int64) >= near.percent * (n[u] + n[v] - common)]
                    joined, at = np.unique(group[u], return_index=True)
                    out += [(ids[x], ids[v]) for x in u[at]]
                    group[np.isin(group, joined)] = group[v]
                if out:
                    a, b = (np.array(x, dtype=np.int64) for x in zip(*out))
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _with_sets(near: Near):
    """Puts the set of a text in its place, in rows (id, n, idx, sig, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches, "text", BATCH):
            words = Words(batch.column("text").to_pylist(), lower=True)
            sets = [shingle_set(words.of(i), near.words).tobytes() for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.binary())], names=[*batch.schema.names[:-1], "shingles"])

    return run, "id long, n long, idx binary, sig binary, shingles binary"


def _confirm(near: Near):
    """Pairs whose full shingle sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(small(batches, "text_u", BATCH), "text_v", BATCH):
            left, right = (Words(batch.column(c).to_pylist(), lower=True) for c in ("text_u", "text_v"))
            keep = np.zeros(batch.num_rows, dtype=bool)
            for i in range(batch.num_rows):
                a, b = shingle_set(left.of(i), near.words), shingle_set(right.of(i), near.words)
                common = len(np.intersect1d(a, b, assume_unique=True))
                keep[i] = 100 * common >= near.percent * (len(a) + len(b) - common)
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], names=["a", "b"]).filter(pa.array(keep))

    return run


def _links(pairs: DataFrame, texts: DataFrame, near: Near) -> DataFrame:
    one = texts.select(F.col("id").alias("u"), F.col("text").alias("text_u"))
    two = texts.select(F.col("id").alias("v"), F.col("text").alias("text_v"))
    return pairs.select("u", "v").join(one, "u").join(two, "v").select("u", "v", "text_u", "text_v").mapInArrow(_confirm(near), "a long, b long")


def _in_classes(shared: DataFrame, classes: DataFrame | None) -> DataFrame:
    """Rows of the buckets with the class of their text."""
    if classes is None:
        return shared.withColumn("component", F.col("id"))
    return shared.join(classes.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))


def _dealt(rows: DataFrame, blocks: DataFrame, pairs: bool) -> DataFrame:
    """rows with their side, one of `blocks` of their bucket, and the block (bi = bj) or all block pairs that they belong to."""
    rows = rows.join(blocks, "key").withColumn("side", F.pmod(F.xxhash64("id", "key"), F.col("blocks")).cast("int"))
    if not pairs:
        return rows.withColumns({"bi": F.col("side"), "bj": F.col("side")})
    return rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"bi": F.least("side", "other"), "bj": F.greatest("side", "other")})


def _candidates(shared: DataFrame, texts: DataFrame, near: Near, classes: DataFrame | None, nearest: bool) -> DataFrame:
    """Pairs (u, v, d) of one round: of each text the nearest in another class, or all pairs across classes and dense buckets."""
    rows = _in_classes(shared, classes)
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min("component").alias("low"), F.max("component").alias("high"))
    rows = _dealt(rows, sizes.where("low < high").select("key", F.ceil(F.col("rows") / near.block).cast("int").alias("blocks")), not nearest)
    about = ["n", "sig"] if nearest else ["n", "sig", "idx"]
    rows = rows.join(texts.select("id", *about), "id").select("key", "bi", "bj", "id", "slot", "side", "component", *about)
    found = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id").mapInArrow(_pairs_in(near, nearest), "u long, v long, d long")
    if nearest:  # of each text's offers, the nearest
        return found.groupBy("v").agg(F.min_by(F.struct("u", "d"), F.struct("d", "u")).alias("to")).select("to.u", "v", "to.d")
    return found.distinct()


def _dense_links(keys: DataFrame, shared: DataFrame, texts: DataFrame, near: Near, classes: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(a, b) of links in the buckets `keys`, and the written table of sets that they come from."""
    rows = _in_classes(shared, classes).join(keys, "key", "left_semi")
    run, schema = _with_sets(near)
    asked = texts.join(rows.select("id").distinct(), "id", "left_semi")
    sets = written(asked.select("id", "n", "idx", "sig", "text").mapInArrow(run, schema), "minhash-sets")
    size = rows.join(sets.select("id", "n"), "id").groupBy("key").agg(F.sum("n").alias("n"))
    rows = _dealt(rows, size.select("key", F.ceil(F.col("n") / near.shingles).cast("int").alias("blocks")), True)
    rows = rows.join(sets, "id").select("key", "bi", "bj", "id", "slot", "side", "component", "n", "sig", "idx", "shingles")
    found = rows.repartition("key", "bi", "bj").sortWithinPartitions("key", "bi", "bj", "id").mapInArrow(_linked_in(near), "a long, b long")
    return found, sets


def _found(shared: DataFrame, texts: DataFrame, near: Near, classes: DataFrame | None, nearest: bool) -> DataFrame:
    """The written links (a, b) of one round."""
    pairs = _candidates(shared, texts, near, classes, nearest)
    if nearest:
        return written(_links(pairs, texts, near), "minhash-links")
    pairs = written(pairs, "minhash-pairs")
    links, sets = _links(pairs.where(F.col("d") != DENSE), texts, near), None
    dense = pairs.where(F.col("d") == DENSE).select(F.col("u").alias("key")).distinct()
    if not dense.isEmpty():
        more, sets = _dense_links(dense, shared, texts, near, classes)
        links = links.unionByName(more)
    links = written(links, "minhash-links")
    forget(pairs, *([sets] if sets is not None else []))
    return links


def _classes(rows: DataFrame, near: Near) -> DataFrame:
    """(_row, doc_id, n_shingles, component_id, kept) for every row of _numbered()."""
    first = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "_row")
    reps = rows.where("_n > 0").groupBy("_set").agg(F.min(first).alias("first"), F.first("_n").alias("n"), F.first("_idx").alias("idx"))
    reps = written(reps.withColumn("id", F.col("first._row")), "minhash-reps")
    keys = reps.select("id", "idx").mapInArrow(_keys, "key long, id long, slot int")
    shared = written(keys.repartition("key").sortWithinPartitions("key", "id").mapInArrow(_shared_only, "key long, id long, slot int"), "minhash-keys")
    met = reps.select("id", "n", "idx").join(shared.select("id").distinct(), "id", "left_semi")
    texts = rows.select(F.col("_row").alias("id"), "text").join(met, "id")
    run, schema = _bits(near)
    texts = written(texts.select("id", "n", "idx", "text").mapInArrow(run, schema), "minhash-texts")
    classes, nearest, last = None, True, 0
    while True:
        found = _found(shared, texts, near, classes, nearest)
        n = found.count()
        if n or classes is None:
            old, classes = classes, merged(classes, found)
            forget(*([old] if old is not None else []))
        forget(found)
        if not nearest:
            break
        nearest, last = n > last // 20, n  # all pairs come last, whenever nearest ones have become few
    forget(shared, texts)
    members = classes.withColumnRenamed("node", "id").join(reps.select("id", "first"), "id")
    heads = classes.join(members.groupBy("component").agg(F.min("first").alias("head")), "component").select(F.col("node").alias("id"), "head")
    heads = reps.select("_set", "id", "first").join(heads, "id", "left").select("_set", F.coalesce("head", "first").alias("head"))
    out = rows.select("_row", "doc_id", F.col("_n").alias("n_shingles"), "_set").join(heads, "_set", "left")
    alone = F.col("head").isNull()
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("_row", "doc_id", "n_shingles", component.alias("component_id"), (alone | (F.col("_row") == F.col("head._row"))).alias("kept"))


def near_duplicates(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs (doc_id, text, ...); ids may be null or repeated."""
    return _classes(_numbered(docs, near), near).drop("_row")


def deduplicated(docs: DataFrame, near: Near = Near()) -> DataFrame:
    """The rows of docs that near_duplicates() keeps, with all their columns."""
    rows = _numbered(docs, near, carry=True)
    kept = written(_classes(rows, near).where("kept").select("_row"), "kept")
    out = rows.select("_row", "text", "rest").join(kept.hint("merge"), "_row", "left_semi")
    return out.select(*unpacked(docs.columns))
