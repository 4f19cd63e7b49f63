"""Benchmark decontamination by the q-gram lemma.

Texts and items are lower-cased, with white space as single spaces. If an item of m
characters stands in a text with at most k edits, the place shares at least
m - q + 1 - k q of its q-grams, all within k diagonals of each other. Shared q-grams are
counted in diagonal bands that overlap by k, so each place lies whole in one band; bands that
reach the bound are verified by an alignment inside the band.

Items are a stated query set. They are taken in blocks of at most BLOCK_CHARS characters,
each of which is broadcast and met by one pass over all documents, so any
number of items works with bounded memory.

Where the bound is not positive (13 to 15 characters with these values) the lemma says nothing; such an item is cut into k + 1
parts, one of which stands unchanged in every place, and each place of a part is aligned.

Defined cases: null and empty texts and items match nothing; items shorter than q are looked up
as plain text; equal items are met once and reported for each id; a text that holds an item
several times reports its best place (fewest edits, then first); texts are scanned whole.
"""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitesift.llm.shared import let_go

#: Characters in a q-gram, edits allowed per character of an item, characters of items per pass.
Q = 8
EDIT_SHARE = 0.08
BLOCK_CHARS = 4_000_000
#: Characters of text that are searched together.
PIECE_CHARS = 1 << 20
#: Separates texts; no text has it.
BORDER = 0x110000
HASH_STEP = 0x9E3779B1

HITS = "row bigint, item bigint, start bigint, end bigint, edits int"


def normal(text: str | None) -> str:
    return " ".join(text.lower().split()) if text else ""


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """32-bit polynomial hash of the Q = 8 characters from each place on, by doubling."""
    out = codes
    factor, width = HASH_STEP, 1
    while width < Q:
        out = out[:-width] * np.uint32(factor) + out[width:]
        factor, width = factor * factor & 0xFFFFFFFF, 2 * width
    return out * np.uint32(0x85EBCA6B)


def budget(size: int) -> int:
    return int(size * EDIT_SHARE)


def lemma(size: int) -> int:
    """Q-grams that a place of an item of ``size`` characters shares with it at least."""
    return size - Q + 1 - budget(size) * Q


def parts(text: str, many: int) -> list[tuple[int, str]]:
    """(place, part) of ``many`` parts of about equal length."""
    ends = [len(text) * k // many for k in range(many + 1)]
    return [(a, text[a:b]) for a, b in zip(ends, ends[1:])]


def loose_place(text: str, item: str, pieces: list[tuple[int, str]]) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item``, looked for around every place of one of its pieces."""
    at = text.find(item)
    if at >= 0:
        return 0, at, at + len(item)
    edits, best, codes = budget(len(item)), None, None
    for offset, piece in pieces:
        at = text.find(piece)
        while at >= 0:
            codes = points(text) if codes is None else codes
            place = aligned(codes, points(item), at - offset - edits, at - offset + edits, edits)
            best = min(p for p in (best, place) if p) if best or place else None
            at = text.find(piece, at + 1)
    return best


class Block:
    """Q-grams of some items, sorted by hash, with a bitmap of 2^22 slots before them."""

    def __init__(self, items: list[str]):
        self.texts = items
        self.items = [points(t) for t in items]
        grams, owner, place = [], [], []
        for number, codes in enumerate(self.items):
            if len(codes) >= Q and lemma(len(codes)) > 0:
                found = gram_hashes(codes)
                grams.append(found)
                owner.append(np.full(len(found), number))
                place.append(np.arange(len(found)))
        none = np.zeros(0, np.int64)
        hashes = np.concatenate(grams) if grams else np.zeros(0, np.uint32)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.owner = np.concatenate(owner)[order] if owner else none
        self.place = np.concatenate(place)[order] if place else none
        self.slots = np.zeros(1 << 22, dtype=bool)
        self.slots[self.hashes >> np.uint32(10)] = True
        sizes = np.array([len(c) for c in self.items], dtype=np.int64)
        self.sizes = sizes
        self.edits = np.array([budget(n) for n in sizes], dtype=np.int64)
        self.least = np.maximum(1, sizes - Q + 1 - self.edits * Q)
        self.loose = [(i, parts(t, budget(len(t)) + 1)) for i, t in enumerate(items) if len(t) >= Q and lemma(len(t)) <= 0]
        self.short = [(i, t) for i, t in enumerate(items) if 0 < len(t) < Q]

    def places(self, codes: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, first and last diagonal) of bands with enough shared q-grams; ``border`` are text starts."""
        hashes = gram_hashes(codes) if len(codes) >= Q else np.zeros(0, np.uint32)
        at = np.flatnonzero(self.slots[hashes >> np.uint32(10)])
        first = np.searchsorted(self.hashes, hashes[at], "left")
        count = np.searchsorted(self.hashes, hashes[at], "right") - first
        at, first, count = at[count > 0], first[count > 0], count[count > 0]
        total = int(count.sum())
        which = np.repeat(first - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(total)
        item, diagonal = self.owner[which], np.repeat(at, count) - self.place[which]
        found = []
        reach = int(self.sizes.max(initial=0)) + 1
        for shift in (0, 1):  # bands of 2k + 1 diagonals, half overlapping: k + 1 in a row lie in one of them
            width = 2 * self.edits[item] + 1
            band = (diagonal + reach + shift * (self.edits[item] + 1)) // width
            key = item * (len(codes) + 3 * reach) + band
            keys, index, times = np.unique(key, return_index=True, return_counts=True)
            enough = times >= self.least[item[index]]
            low = band[index] * width[index] - reach - shift * (self.edits[item[index]] + 1)
            found.append(np.stack([item[index], low, low + width[index] - 1])[:, enough])
        return np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)


def aligned(codes: np.ndarray, item: np.ndarray, low: int, high: int, edits: int) -> tuple[int, int, int] | None:
    """(edits, start, end) of the best place of ``item`` on the diagonals low to high, or None.

    Row by row over the item; column d of the band is the text place row + low + d.
    """
    width = high - low + 1
    padded = np.full(len(item) + width + 1, BORDER, dtype=np.uint32)
    begin, end = max(0, low), min(len(codes), low + len(padded))
    padded[begin - low: end - low] = codes[begin:end]
    column = np.arange(width)
    far = np.int64(1 << 20)
    inside = (low + column >= 0) & (low + column <= len(codes))
    cost = np.where(inside, 0, far)
    came = low + column
    for row, code in enumerate(item):
        wrong = (padded[row: row + width] != code).astype(np.int64)
        here = low + row + 1 + column
        cross = cost + wrong
        down = np.append(cost[1:], far) + 1
        take = down < cross
        step = np.where(take, down, cross)
        origin = np.where(take, np.append(came[1:], 0), came)
        step = np.where((here >= 0) & (here <= len(codes)), step, far)
        best = np.minimum.accumulate(step - column)
        source = np.maximum.accumulate(np.where(step - column == best, column, 0))
        cost, came = best + column, origin[source]
        if cost.min() > edits:
            return None
    end = int(np.argmin(cost))
    return (int(cost[end]), int(came[end]), low + len(item) + end) if cost[end] <= edits else None


def search(texts: list[str], block: Block) -> Iterator[tuple[int, int, int, int, int]]:
    """(text number, item number, start, end, edits) of the best place of every item in every text."""
    for number, text in enumerate(texts):
        for item, short in block.short:
            at = text.find(short)
            if at >= 0:
                yield number, item, at, at + len(short), 0
        for item, pieces in block.loose:
            if place := loose_place(text, block.texts[item], pieces):
                yield number, item, place[1], place[2], place[0]
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at]) < PIECE_CHARS):
            group.append((at, points(texts[at])))
            size += len(texts[at]) + 1
            at += 1
        starts = np.cumsum([0, *(len(c) + 1 for _, c in group)])
        codes = np.full(int(starts[-1]), BORDER, dtype=np.uint32)
        for (_, own), start in zip(group, starts):
            codes[start: start + len(own)] = own
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for item, low, high in block.places(codes, starts).T.tolist():
            edits, size = int(block.edits[item]), int(block.sizes[item])
            middle = max(0, low + size // 2)
            for which in {int(np.searchsorted(starts, p, "right")) - 1 for p in (max(0, low), middle, max(0, high + size))}:
                if which >= len(group):
                    continue
                start, own = int(starts[which]), group[which][1]
                key = (group[which][0], item)
                if best.get(key, (1, 0, 0))[0] == 0:  # bands come in order: the first exact place is there
                    continue
                plain = texts[key[0]].find(block.texts[item], max(0, low - start), max(0, high - start + 1 + size))
                place = (0, plain, plain + size) if plain >= 0 else aligned(
                    own, block.items[item], low - start, high - start, edits)
                if place and place < best.get(key, (1 << 30, 0, 0)):
                    best[key] = place
        for (number, item), (edits, start, end) in best.items():
            yield number, item, start, end, edits


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[tuple[list[str], list[list[int]]]]:
    """Normal texts and their ids, in blocks of bounded size."""
    rows = items.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t IS NOT NULL").orderBy("k")
    known: dict[str, list[int]] = {}
    size = 0
    for row in rows.toLocalIterator():
        plain = normal(row.t)
        if plain:
            if plain not in known:
                if known and size + len(plain) > BLOCK_CHARS:
                    yield list(known), list(known.values())
                    known, size = {}, 0
                size += len(plain)
            known.setdefault(plain, []).append(row.k)
    if known:
        yield list(known), list(known.values())


def hits(documents: DataFrame, benchmark: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """(columns of documents but the text, item_id, start, end, edits): each item in each document, positions in normal form."""
    spark = documents.sparkSession
    kept = [f for f in documents.schema.fields if f.name != text]
    packed = documents.select(F.struct(*[F.col(f"`{f.name}`") for f in kept]).alias("doc"), F.col(text).alias("text"))
    outer = f"doc {packed.schema['doc'].dataType.simpleString()}, item_id bigint, start bigint, end bigint, edits int"
    out = spark.createDataFrame([], outer)
    for texts, ids in item_blocks(benchmark, key, text):
        shared = spark.sparkContext.broadcast((texts, ids))

        def found(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block, names = Block(shared.value[0]), shared.value[1]
            for batch in batches:
                rows = [normal(t) for t in batch.column(1).to_pylist()]
                places = [(n, i, s, e, k) for n, number, s, e, k in search(rows, block) for i in names[number]]
                if places:
                    row, item, start, end, edits = zip(*places)
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(row)), pa.array(item, pa.int64()), pa.array(start, pa.int64()),
                        pa.array(end, pa.int64()), pa.array(edits, pa.int32())],
                        names=["doc", "item_id", "start", "end", "edits"])

        out = out.union(packed.mapInArrow(found, outer))
    return out


def contaminated(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits) of every benchmark item in every document."""
    found = hits(documents.select("doc_id", "text"), benchmark)
    return found.select("doc.doc_id", "item_id", "start", "end", "edits")


def holds_item(text: Column | str, items: list[str]) -> Column:
    """Whether the text holds one of the normal texts ``items`` (a block of bounded size)."""
    shared = SparkSession.active().sparkContext.broadcast(items)

    @F.arrow_udf("boolean")
    def holds(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        block = Block(shared.value)
        for column in parts:
            hit = np.zeros(len(column), dtype=bool)
            for number, *_ in search([normal(t) for t in column.to_pylist()], block):
                hit[number] = True
            yield pa.array(hit)
        del block
        let_go()

    return holds(text)


def clean(documents: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The documents that hold no benchmark item; same columns. Decided row by row, without a join."""
    out = documents
    for items, _ in item_blocks(benchmark, "item_id", "text"):
        out = out.where(~holds_item(text, items))
    return out
