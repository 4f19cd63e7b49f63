"""MinHash near-duplicates by an LSH forest.

A document's set are its distinct 5-word shingles. Documents with one set are one node, named by
their smallest id. A node has 128 minimum hashes; tree t of the forest sorts all
nodes by the hashes from 5t on. Nodes whose order begins alike for at least five
hashes lie in one region. A region of few nodes pairs all of them; a crowded one goes deeper, hash by hash, until its
parts are small, and a node also meets those beside it in the order, which share its longest prefix. Regions are runs of a range-partitioned sort, so
a crowd is spread over tasks, and runs across a partition border are met by a second pass over the border rows.

Candidates pass a size test and an estimate from the signatures, then the exact test on full
sets. Nodes of crowded regions that are in different components after that are met once more, by a
prefix-filter join on their full sets: none of their pairs of the similarity is left out as a candidate.

Defined cases: no words (null, empty, blank): an empty set, linked with nothing; fewer words than
five: the whole sequence is the one shingle; rows that repeat a doc_id are one document of the
smallest set key; a null doc_id is linked with nothing, has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.shared import components, dropped, durable, known_to, let_go, split_words, stored, unknown_to

SHINGLE = 5
HASHES = 128
#: Slots in which shingles are counted, and holders of a shingle that are compared at once.
SLOTS, BLOCK = 1 << 20, 256
#: Rows of sorted nodes that are compared at once.
WALK_ROWS = 1 << 14
#: Characters of lines that are signed together.
PORTION = 1 << 19


@dataclass(frozen=True)
class Forest:
    """Trees of ``step`` own hashes each; regions start at depth ``step`` and go down to ``depth``."""

    trees: int = 25
    step: int = 5
    depth: int = 16
    region: int = 8
    hashes: int = HASHES

    def __post_init__(self):
        if self.trees * self.step > self.hashes or self.hashes > HASHES or self.step > self.depth:
            raise ValueError("a forest needs trees * step <= hashes <= 128 and step <= depth")


DEFAULT = Forest()

_rng = np.random.default_rng(20)
FACTORS = _rng.integers(1 << 62, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _rng.integers(1 << 62, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    words = split_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    size = min(SHINGLE, len(codes))
    n = len(codes) - size + 1
    total = np.full(n, size, dtype=np.uint64) * PLACES[SHINGLE]
    for i in range(size):
        total += codes[i: i + n] * PLACES[i]
    return np.unique(mixed(total))


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one text after the other, and how many words each has; a different word is hashed once."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if not real.all():  # white space at an end of a text
        reals = np.concatenate([[0], np.cumsum(real)])
        size = np.diff(reals[np.concatenate([[0], np.cumsum(size)])])
        words = words.filter(pa.array(real))
    coded = words.dictionary_encode()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)), dtype=np.uint64, count=len(coded.dictionary))
    return hashes[coded.indices.to_numpy(zero_copy_only=False)], size


def signature(shingles: np.ndarray, hashes: int = HASHES) -> np.ndarray:
    """Minimum hashes, 16 bits each."""
    least = np.full(hashes, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(shingles), 2048):
        least = np.minimum(least, (shingles[at: at + 2048, None] * FACTORS[:hashes]).min(axis=0))
    return (mixed(least) >> np.uint64(48)).astype(np.uint16)


def signature_bytes(shingles: np.ndarray, forest: Forest) -> bytes:
    """The signature with its first ``depth`` hashes again at the end."""
    hashes = signature(shingles, forest.hashes)
    return np.concatenate([hashes, hashes[: forest.depth]]).astype(">u2").tobytes()


def set_key(shingles: np.ndarray) -> tuple[int, int]:
    low = shingles.sum(dtype=np.uint64)
    high = np.bitwise_xor.reduce(mixed(shingles * PLACES[0])) if len(shingles) else np.uint64(0)
    return int(low.astype(np.int64)), int(high.astype(np.int64))


def signed_lines(lines: list[str], forest: Forest) -> Iterator[tuple[int, int, int, bytes]]:
    """(size, key, key, signature) of the sets of many short texts of ``SHINGLE`` words or more each; ``PORTION`` characters at a time."""
    at, ends = 0, np.cumsum([len(x) for x in lines], dtype=np.int64)
    while at < len(lines):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, side="right")))
        yield from signed_together(lines[at:end], forest)
        at = end


def signed_together(lines: list[str], forest: Forest) -> Iterator[tuple[int, int, int, bytes]]:
    n, low, high, signs = signed_codes(*word_codes(pa.array(lines, pa.string())), forest)
    return zip(n.tolist(), low.tolist(), high.tolist(), map(bytes, signs))


def signed_codes(codes: np.ndarray, size: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, both keys and signatures (rows of bytes) of the sets of texts of ``size`` words, ``SHINGLE`` or more each, whose hashes are ``codes``."""
    size = size - SHINGLE + 1
    row = np.repeat(np.arange(len(size)), size)
    at = np.arange(len(row)) + (SHINGLE - 1) * row
    total = np.full(len(row), SHINGLE, dtype=np.uint64) * PLACES[SHINGLE]
    for i in range(SHINGLE):
        total += codes[at + i] * PLACES[i]
    total = mixed(total)
    # Few lines have a shingle twice: they alone are sorted.
    key = total + row.astype(np.uint64) * PLACES[SHINGLE]
    alike = np.sort(key)
    alike = alike[1:][alike[1:] == alike[:-1]]
    if len(alike):
        at = np.flatnonzero(np.isin(row, row[np.isin(key, alike)]))
        at = at[np.lexsort((total[at], row[at]))]
        again = at[1:][(total[at[1:]] == total[at[:-1]]) & (row[at[1:]] == row[at[:-1]])]
        fresh = np.ones(len(total), bool)
        fresh[again] = False
        total, row = total[fresh], row[fresh]
    begins = np.searchsorted(row, np.arange(len(size)))
    low = np.add.reduceat(total, begins).astype(np.int64)
    high = np.bitwise_xor.reduceat(mixed(total * PLACES[0]), begins).astype(np.int64)
    ends = np.append(begins[1:], len(total))
    least, a = np.empty((len(size), forest.hashes), np.uint64), 0
    while a < len(size):  # about 2048 shingles at a time
        b = max(a + 1, int(np.searchsorted(ends, begins[a] + 2048, side="right")))
        part = total[begins[a]: ends[b - 1]]
        if b == a + 1:
            least[a] = np.min([(part[i: i + 2048, None] * FACTORS[:forest.hashes]).min(axis=0) for i in range(0, len(part), 2048)], axis=0)
        else:
            least[a:b] = np.minimum.reduceat(part[:, None] * FACTORS[:forest.hashes], begins[a:b] - begins[a], axis=0)
        a = b
    hashes = mixed(least) >> np.uint64(48)
    signs = np.concatenate([hashes, hashes[:, : forest.depth]], axis=1).astype(">u2")
    return ends - begins, low, high, signs.view(np.uint8)


def signed(documents: DataFrame, key: str, text: str, forest: Forest) -> DataFrame:
    """(id, n, k1, k2, sig): size, key and signature of the set."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column(1)]
            keys = [set_key(s) for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([len(s) for s in sets], pa.int32()),
                pa.array([k for k, _ in keys], pa.int64()), pa.array([k for _, k in keys], pa.int64()),
                pa.array([signature_bytes(s, forest) for s in sets], pa.binary())],
                names=["id", "n", "k1", "k2", "sig"])
        let_go()

    rows = documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(sign, "id bigint, n int, k1 bigint, k2 bigint, sig binary")


def neighbours(orders: np.ndarray, tree: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of the candidate pairs among sorted rows, and those of crowded rows.

    Rows with ``step`` equal hashes or more are a region. One of more than ``region`` rows is crowded and parts at the next
    hash, and so on down to ``depth``, until its parts are small. Rows of one part are candidates; so are two rows side by side
    that share ``step`` hashes, since nothing has a longer prefix in common with either, also where a part ends between them.
    """
    n = len(orders)
    if n < 2:
        none = np.zeros(0, np.int64)
        return none, none, none
    common = np.cumprod(orders[1:] == orders[:-1], axis=1).sum(axis=1)
    common[tree[1:] != tree[:-1]] = 0

    def first_rows(depth: int) -> np.ndarray:
        return np.maximum.accumulate(np.where(np.concatenate([[True], common < depth]), np.arange(n), 0))

    part = first_rows(forest.step)
    crowded = np.bincount(part, minlength=n)[part] > forest.region
    open_rows = crowded.copy()
    for depth in range(forest.step + 1, forest.depth + 1):
        if not open_rows.any():
            break
        deeper = first_rows(depth)
        part[open_rows] = deeper[open_rows]
        open_rows &= np.bincount(deeper, minlength=n)[deeper] > forest.region
    part[open_rows] = -1 - np.flatnonzero(open_rows)
    beside = np.flatnonzero((part[:-1] == part[1:]) | (common >= forest.step))
    left, right = [beside], [beside + 1]
    for places in range(2, forest.region):
        at = np.flatnonzero(part[:-places] == part[places:])
        left.append(at)
        right.append(at + places)
    return np.concatenate(left), np.concatenate(right), np.flatnonzero(crowded)


MET = "a bigint, b bigint, tree int, slice binary, n int, root bigint"


def candidates(nodes: DataFrame, forest: Forest, share: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Distinct (a, b), a < b, of different roots from all trees, the ids of nodes in crowded regions, and the written table beneath both.

    ``nodes`` is (id, n, sig, root).
    """
    width = 2 * forest.depth
    # Regions come in the order of a number, which tells most rows apart; a region is sorted by its hashes.
    region = F.xxhash64("tree", F.expr(f"substring(slice, 1, {2 * forest.step})"))
    rows = nodes.select("id", "n", "root", "sig", F.explode(F.sequence(F.lit(0), F.lit(forest.trees - 1))).alias("tree")).select(
        "tree", F.expr(f"substring(sig, tree * {2 * forest.step} + 1, {width})").alias("slice"), "id", "n", "root")
    edge = forest.region

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        """(a, b) of the pairs, (a, null) of the crowded."""
        orders = np.concatenate([np.frombuffer(c.buffers()[2], ">u2", len(c) * forest.depth, c.offset * width).reshape(-1, forest.depth)
                                 for c in rows.column("slice").chunks if len(c)])  # all slices are ``width`` bytes long
        tree, ids, sizes, roots = (rows.column(c).to_numpy() for c in ("tree", "id", "n", "root"))
        left, right, crowd = neighbours(orders, tree, forest)
        apart = roots[left] != roots[right]
        left, right = left[apart], right[apart]
        near = 100 * np.minimum(sizes[left], sizes[right]) >= share * np.maximum(sizes[left], sizes[right])
        x, y = ids[left][near], ids[right][near]
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        crowd = np.unique(ids[crowd])
        n = both.shape[1] + len(crowd)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([both[0], crowd])),
            pa.concat_arrays([pa.array(both[1], pa.int64()), pa.nulls(len(crowd), pa.int64())]),
            pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
            names=["a", "b", "tree", "slice", "n", "root"])

    def border_of(rows: pa.Table) -> list[pa.RecordBatch]:
        return pa.table({"a": rows.column("id"), "b": pa.nulls(len(rows), pa.int64()), "tree": rows.column("tree"),
                         "slice": rows.column("slice"), "n": rows.column("n"), "root": rows.column("root")}).to_batches()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of a sorted partition, in pieces that overlap by the rows of an open region; then the border rows."""
        first, held, fresh = None, None, 0
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            if first is None or len(first) < edge:
                first = (piece if first is None else pa.concat_tables([first, piece])).slice(0, edge)
            held = piece if held is None else pa.concat_tables([held, piece])
            fresh += len(piece)
            if fresh >= WALK_ROWS:
                yield pairs_of(held)
                held, fresh = held.slice(max(0, len(held) - edge)), 0
        if first is not None:
            if fresh:
                yield pairs_of(held)
            yield from border_of(first)
            yield from border_of(held.slice(max(0, len(held) - edge)))
        let_go()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [pa.Table.from_batches([b]) for b in batches]
        if rows:
            yield pairs_of(pa.concat_tables(rows))

    order = ["region", "tree", "slice", "id"]
    met = stored(rows.withColumn("region", region).repartitionByRange(*order).sortWithinPartitions(*order).drop("region").mapInArrow(walk, MET))
    # Border rows: twice ``region`` for each partition.
    border = met.where("tree IS NOT NULL").select("tree", "slice", F.col("a").alias("id"), "n", "root").distinct()
    crossing = border.withColumn("region", region).repartition(1).sortWithinPartitions(*order).drop("region").mapInArrow(meet, MET)
    everything = met.where("tree IS NULL").select("a", "b").union(crossing.select("a", "b"))
    return everything.where("b IS NOT NULL").distinct(), everything.where("b IS NULL").select(F.col("a").alias("id")).distinct(), met


def estimated(pairs: DataFrame, nodes: DataFrame, least: float, hashes: int) -> DataFrame:
    """Pairs whose signatures agree in a share of ``least`` or more."""
    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.bool_())
        a = np.frombuffer(b"".join(x.to_pylist()), ">u2").reshape(len(x), -1)[:, :hashes]
        b = np.frombuffer(b"".join(y.to_pylist()), ">u2").reshape(len(y), -1)[:, :hashes]
        return pa.array((a == b).mean(axis=1) >= least)

    left = nodes.select(F.col("id").alias("a"), F.col("sig").alias("sig_a"))
    right = nodes.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    return pairs.join(left, "a").join(right, "b").where(alike("sig_a", "sig_b")).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Pairs with 100 * intersection >= share * union; ``sets`` is (id, shingles) with the full sets."""
    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for one, other in zip(x, y):
            a, b = np.frombuffer(one.as_py(), np.uint64), np.frombuffer(other.as_py(), np.uint64)
            both = np.concatenate([a, b])
            both.sort()
            common = int((both[1:] == both[:-1]).sum())
            out.append(100 * common >= share * (len(both) - common))
        return pa.array(out, pa.bool_())

    left = sets.select(F.col("id").alias("a"), F.col("shingles").alias("set_a"))
    right = sets.select(F.col("id").alias("b"), F.col("shingles").alias("set_b"))
    return pairs.join(left, "a").join(right, "b").where(linked("set_a", "set_b")).select("a", "b")


def full_sets(documents: DataFrame, key: str, text: str, ids: DataFrame) -> DataFrame:
    """(id, shingles) of the documents in ``ids``, read again from their texts."""
    rows = known_to(documents.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")), "id", ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py()).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "shingles"])
        let_go()

    return rows.mapInArrow(read, "id bigint, shingles binary")


def least_agreement(share: int, hashes: int) -> float:
    """Share of equal hashes below which a pair is not looked up: 4.75 standard deviations under the similarity."""
    return share / 100 - 4.75 * (share / 100 * (1 - share / 100) / hashes) ** 0.5


def ranked(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The shingles with the rare ones first; one order for all sets."""
    return shingles[np.lexsort((shingles, counts[shingles % np.uint64(len(counts))]))]


def slot_counts(sets: DataFrame) -> np.ndarray:
    """How many shingles of ``sets`` fall in each of ``SLOTS`` slots. Any counts give an exact join; good ones a cheap one."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.int64)
        for batch in batches:
            some = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount((some % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        at = np.flatnonzero(total)
        yield from pa.table({"slot": pa.array(at, pa.int32()), "n": pa.array(total[at])}).to_batches(max_chunksize=100_000)

    rows = sets.select("shingles").mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.int64)
    out[rows.column("slot").to_numpy()] = rows.column("n").to_numpy()
    return out


def shared_rare(nodes: DataFrame, sets: DataFrame, share: int) -> DataFrame:
    """Distinct (a, b), a < b, of different roots: every pair of ``nodes`` (id, n, root) that can have the similarity.

    Sets of that similarity share one of their n - ceil(share n) + 1 rarest shingles (the prefix filter), so none is missed.
    Holders of a shingle are dealt into blocks of about ``BLOCK``, and blocks meet pairwise, so a common one is spread over tasks.
    """
    counts = sets.sparkSession.sparkContext.broadcast(slot_counts(sets).tobytes())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(counts.value, np.int64)
        for batch in batches:
            found = []
            for x in batch.column(2):
                s = ranked(np.frombuffer(x.as_py(), np.uint64), held)
                found.append(s[: len(s) + share * len(s) // -100 + 1])
            size = np.array([len(s) for s in found], np.int64)
            row = pa.array(np.repeat(np.arange(len(found)), size))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate(found).astype(np.int64)), batch.column(0).take(row), batch.column(3).take(row), batch.column(1).take(row),
                pa.array(np.concatenate([np.arange(n) for n in size]).astype(np.int32))], names=["token", "id", "n", "root", "at"])

    whole = nodes.select("id", "n", "root").join(sets, "id").select("id", "root", "shingles", "n")
    rare = stored(whole.mapInArrow(cut, "token bigint, id bigint, n int, root bigint, at int"))
    held = rare.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("holders"))
    blocks = F.ceil(F.col("holders") / BLOCK).cast("int").alias("blocks")
    dealt = rare.join(held.where("low <> high").select("token", blocks), "token").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "token", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "root", "at")

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        token, x, y, block, ids, sizes, roots, at = (rows.column(c).to_numpy() for c in rows.column_names)
        group = np.concatenate([[0], np.cumsum((token[1:] != token[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1]))])
        out, step = [np.zeros((2, 0), np.int64)], 1
        while step < len(group):
            left = np.flatnonzero(group[:-step] == group[step:])
            if not len(left):
                break
            right = left + step
            # At the first common shingle no more than these can be common.
            rest = np.minimum(sizes[left] - at[left], sizes[right] - at[right])
            both = sizes[left].astype(np.int64) + sizes[right]
            good = (roots[left] != roots[right]) & ((block[left] != block[right]) | (x[left] == y[left])) \
                & (100 * np.minimum(sizes[left], sizes[right]).astype(np.int64) >= share * np.maximum(sizes[left], sizes[right]).astype(np.int64)) \
                & ((100 + share) * rest.astype(np.int64) >= share * both)
            a, b = ids[left[good]], ids[right[good]]
            out.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
            step += 1
        found = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["a", "b"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups of a sorted partition; the open one waits for the next batch."""
        held = None
        for batch in batches:
            piece = pa.Table.from_batches([batch])
            held = piece if held is None else pa.concat_tables([held, piece])
            keys = np.stack([held.column(c).to_numpy() for c in ("token", "x", "y")])
            begin = len(held) - int((keys == keys[:, -1:]).all(axis=0)[::-1].argmin()) if (keys != keys[:, -1:]).any() else 0
            if begin:
                yield pairs_of(held.slice(0, begin))
                held = held.slice(begin)
        if held is not None:
            yield pairs_of(held)

    order = ["token", "x", "y"]
    return met.repartition(*order).sortWithinPartitions(*order).mapInArrow(walk, "a bigint, b bigint").distinct()


def linked_roots(nodes: DataFrame, forest: Forest, share: int, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) of all linked nodes (id, n, sig). ``sets_of`` writes (id, shingles) for a table of ids.

    The forest meets all pairs of regions that are not crowded, and joins most of a crowd; nodes of crowded regions
    that still have different roots are then met by the prefix filter on their full sets, which leaves none out.
    """
    least = least_agreement(share, forest.hashes)
    pairs, crowd, met = candidates(nodes.withColumn("root", F.col("id")), forest, share)
    crowd = durable(crowd)
    pairs = durable(pairs)
    dropped(met)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    some = stored(known_to(nodes.select("id", "sig"), "id", ids))
    near = stored(estimated(pairs, some, least, forest.hashes))
    dropped(some)
    ids = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = sets_of(ids)
    found = durable(confirmed(near, sets, share))
    dropped(near, sets)
    roots = durable(components(found))
    if crowd.isEmpty():
        return roots
    met = stored(known_to(nodes, "id", crowd).join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    sets = sets_of(crowd)
    rare = shared_rare(met, sets, share)
    near = stored(estimated(rare, met.select("id", "sig"), least, forest.hashes))
    found = durable(confirmed(near, sets, share))
    dropped(rare, met, sets, near)
    if found.isEmpty():
        return roots
    return durable(components(found.union(roots.select(F.col("id").alias("a"), F.col("root").alias("b")))))


def near_components(documents: DataFrame, key: str = "doc_id", text: str = "text", share: int = 85,
                    forest: Forest = DEFAULT) -> DataFrame:
    """(id, n, component) for every row of ``documents``."""
    rows = stored(signed(documents, key, text, forest))
    groups = rows.where("n > 0 AND id IS NOT NULL").groupBy("k1", "k2", "n").agg(F.min(F.struct("id", "sig")).alias("m"))
    nodes = stored(groups.select("n", "k1", "k2", "m.id", "m.sig"))
    roots = linked_roots(nodes.select("id", "n", "sig"), forest, share,
                         lambda ids: stored(full_sets(documents, key, text, ids)))
    named = nodes.select("n", "k1", "k2", "id").join(roots.withColumnRenamed("id", "r"), F.col("id") == F.col("r"), "left").select(
        F.col("n").alias("gn"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.coalesce("root", "id").alias("component"))
    joined = rows.select("id", "n", "k1", "k2").join(named, F.expr("k1 = g1 AND k2 = g2 AND n = gn"), "left")
    return joined.select("id", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component"))


def near_digest(documents: DataFrame) -> DataFrame:
    return near_components(documents.select("doc_id", "text")).select(
        F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.col("component").alias("component_id"),
        F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(documents: DataFrame, key: str = "doc_id", text: str = "text", share: int = 85, forest: Forest = DEFAULT) -> DataFrame:
    """One document of each component, the one of the smallest id; same columns."""
    gone = stored(near_components(documents, key, text, share, forest).where("id <> component").select("id").distinct())
    return unknown_to(documents, key, gone)
