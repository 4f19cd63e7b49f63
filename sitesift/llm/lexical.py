"""Ranked lexical search with geometric blocks in every posting list.

Documents are cut into shards of SHARD rows. In a shard, the posting list of a term is clustered
by the similarity of its documents into blocks of about BLOCK documents, and each block stores the
coordinatewise maximum of its documents' impacts (over the terms that occur in a query together with the list's term). The inner
product of a query with that summary bounds the score of every document of the block, so a block is
skipped exactly when its bound is below the score that the best documents already reach. What is not
skipped is scored in full. Results are exact.

A query reads its lists by falling bound of the term. When the terms that are left cannot together reach the score to beat, their
lists are not opened: a document that only they hold cannot enter.

Queries come in blocks of bounded vocabulary (TERMS); each block is one pass. Tables:
``term_counts`` (per document: length, query terms, their counts) is written once per block; statistics are sums over it. A partition
carries the best scores of each query from shard to shard and gives at most the wanted rows of each query; these meet in two windows.

Defined cases: a null text has no terms, counts in no statistic and is never ranked; an item without terms has no rows; rows that repeat an
item_id are one item with the terms of all of them; an item without item_id is left out; documents without doc_id are ranked, last among equal
scores; repeated documents are each ranked; an empty table gives no rows. Other columns are not read. A document of any length is
counted whole, in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitesift.llm.shared import stored

SHARD = 8192
BLOCK = 64
#: Numbers of a document's sketch, by which posting lists are clustered.
SKETCH = 16
#: Distinct terms of one block of queries; a query with more of its own is a block alone.
TERMS = 100_000
MANY = 50
SALTS = 32

# Terms keep 0-9, A-Z (lowered), a-z and everything past ASCII.
TABLE = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split() if text else []


@dataclass(frozen=True)
class Queries:
    """A block of queries: ids, the number of each term, and each query's distinct terms."""

    ids: list[int]
    numbers: dict[bytes, int]
    held: list[np.ndarray]


def query_blocks(items: DataFrame, most: int = TERMS) -> Iterator[Queries]:
    rows = items.select("item_id", "text").where("item_id IS NOT NULL").orderBy("item_id")
    ids: list[int] = []
    numbers: dict[bytes, int] = {}
    held: list[set[int]] = []
    for row in rows.toLocalIterator():
        own = set(terms(row.text))
        again = bool(ids) and ids[-1] == row.item_id
        if not again:
            if ids and len(numbers) + len(own.difference(numbers)) > most:
                yield finished(ids, numbers, held)
                ids, numbers, held = [], {}, []
            ids.append(row.item_id)
            held.append(set())
        held[-1].update(numbers.setdefault(t, len(numbers)) for t in own)
    if ids:
        yield finished(ids, numbers, held)


def finished(ids: list[int], numbers: dict[bytes, int], held: list[set[int]]) -> Queries:
    return Queries(ids, numbers, [np.array(sorted(h), np.int64) for h in held])


def term_counts(documents: DataFrame, queries: Queries) -> DataFrame:
    """Stored (doc_id, n, terms, counts): length in terms, and the query terms in it with their counts. Documents without terms are left out."""
    shared = documents.sparkSession.sparkContext.broadcast(queries.numbers)  # at most TERMS, or one query's

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            kept, sizes, ends, own, times = [], [], [0], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = terms(text)
                if words:
                    known = np.array([k for k in map(number, words) if k is not None], np.int32)
                    term, count = np.unique(known, return_counts=True)
                    kept.append(row)
                    sizes.append(len(words))
                    own.append(term)
                    times.append(count)
                    ends.append(ends[-1] + len(term))
            if kept:
                flat = pa.array(np.concatenate(own)), pa.array(np.concatenate(times))
                lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), f) for f in flat]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(kept)), pa.array(sizes, pa.int64()), *lists], names=["doc_id", "n", "terms", "counts"])

    return stored(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        counted, "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"))


def weights(counts: DataFrame, queries: Queries) -> tuple[np.ndarray, int, int]:
    """Weight of every term of the block, the number of documents and their length together."""
    total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("l")).first()
    n, length = total.n, total.l or 0
    holders = np.zeros(len(queries.numbers), np.int64)
    rows = counts.select(F.explode("terms").alias("t")).groupBy("t").count()  # at most one row a term of the block
    for row in rows.toLocalIterator():
        holders[row.t] = row["count"]
    return np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in holders.tolist()], np.int64), n, length


@dataclass
class Postings:
    """A term's documents in a shard: blocks (``ends`` over ``rows``) and their summaries over the columns ``at``."""

    rows: np.ndarray
    ends: np.ndarray
    at: np.ndarray
    summary: np.ndarray


@dataclass
class Shard:
    """Impacts of some documents as compressed rows, and posting lists that are blocked when first opened."""

    starts: np.ndarray
    terms: np.ndarray
    impacts: np.ndarray
    asked_with: list[np.ndarray]
    lists: dict[int, Postings] = field(default_factory=dict)

    def __post_init__(self):
        self.row = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.terms, kind="stable")
        self.by_term = self.row[order]
        size = len(self.asked_with)
        self.edges = np.searchsorted(self.terms[order], np.arange(size + 1))
        self.most = np.zeros(size, np.int64)
        np.maximum.at(self.most, self.terms, self.impacts)
        signs = np.random.default_rng(SKETCH).standard_normal((size, SKETCH)).astype(np.float32)
        self.sketch = np.zeros((len(self.starts) - 1, SKETCH), np.float32)
        held = np.flatnonzero(np.diff(self.starts))
        for low in range(0, len(held), 1024):  # a bounded part at a time
            some = held[low: low + 1024]
            span = slice(self.starts[some[0]], self.starts[some[-1] + 1])
            weighted = signs[self.terms[span]] * self.impacts[span, None].astype(np.float32)
            self.sketch[some] = np.add.reduceat(weighted, self.starts[some] - span.start, axis=0)
        self.sketch /= np.maximum(np.linalg.norm(self.sketch, axis=1, keepdims=True), 1e-9)

    def cells(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``rows``, place in ``terms``) of every entry of these documents."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        place = np.repeat(np.arange(len(rows)), sizes)
        return place, np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(self.starts[rows], sizes)

    def opened(self, term: int) -> Postings:
        """The list of ``term``: clustered around evenly spaced documents of it, each block with its summary."""
        if term not in self.lists:
            rows = self.by_term[self.edges[term]: self.edges[term + 1]]
            centres = rows[:: BLOCK]
            block = np.concatenate([np.argmax(self.sketch[rows[k: k + 4096]] @ self.sketch[centres].T, axis=1)
                                    for k in range(0, len(rows), 4096)])
            order = np.argsort(block, kind="stable")
            rows, block = rows[order], np.unique(block[order], return_inverse=True)[1]
            at = self.asked_with[term]
            summary = np.zeros((int(block[-1]) + 1, len(at)), np.int64)
            for low in range(0, len(rows), 512):  # a bounded number of documents' entries at a time
                place, cell = self.cells(rows[low: low + 512])
                column = np.minimum(np.searchsorted(at, self.terms[cell]), len(at) - 1)
                hit = at[column] == self.terms[cell]
                np.maximum.at(summary, (block[low: low + 512][place[hit]], column[hit]), self.impacts[cell[hit]])
            self.lists[term] = Postings(rows, np.append(np.flatnonzero(np.diff(block)) + 1, len(rows)), at, summary)
        return self.lists[term]

    def scores(self, rows: np.ndarray, weight: np.ndarray) -> np.ndarray:
        place, cell = self.cells(rows)
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, place, weight[self.terms[cell]] * self.impacts[cell])
        return out

    def search(self, held: np.ndarray, weight: np.ndarray, many: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) that hold every document which scores ``floor`` or more and is among the ``many`` best (equal scores included).

        ``weight`` is zero outside the query's terms ``held``.
        """
        bound = weight[held] * self.most[held]
        order = np.argsort(-bound, kind="stable")
        left = np.append(np.cumsum(bound[order][::-1])[::-1], 0)
        known = np.zeros(len(self.starts) - 1, bool)
        rows, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for k, term in enumerate(held[order].tolist()):
            if left[k] < floor or left[k] == 0:
                break
            if self.edges[term] == self.edges[term + 1]:
                continue
            postings = self.opened(term)
            limits = postings.summary @ weight[postings.at]
            begins = np.append(0, postings.ends[:-1])
            for block in np.argsort(-limits, kind="stable").tolist():
                if limits[block] < floor:
                    break  # the exact summary bound fails for it and for all that follow
                some = postings.rows[begins[block]: postings.ends[block]]
                some = some[~known[some]]
                if len(some):
                    known[some] = True
                    found = self.scores(some, weight)
                    good = found >= floor
                    rows, scores = np.append(rows, some[good]), np.append(scores, found[good])
                    if len(scores) > many:
                        floor = max(floor, int(np.partition(scores, -many)[-many]))
                        good = scores >= floor
                        rows, scores = rows[good], scores[good]
        return rows, scores


def asked_together(queries: Queries) -> list[np.ndarray]:
    """For each term, the sorted terms of all queries that hold it."""
    own: list[list[np.ndarray]] = [[] for _ in queries.numbers]
    for held in queries.held:
        for term in held.tolist():
            own[term].append(held)
    return [np.unique(np.concatenate(h)) if h else np.zeros(0, np.int64) for h in own]


def impacts(times: np.ndarray, lengths: np.ndarray, documents: int, total: int) -> np.ndarray:
    """Impact of each count in a document of that length, in 64-bit integers."""
    middle = 100 - 50 + (50 * lengths * documents) // max(total, 1)
    return (1_000_000_000 * times) // (1000 * times + 20 * middle)


def ranked_block(counts: DataFrame, queries: Queries, many: int) -> DataFrame:
    """(item_id, doc_id, score): at most ``many`` rows of each query from each partition of ``counts``."""
    weight, documents, total = weights(counts, queries)
    shared = counts.sparkSession.sparkContext.broadcast((queries.ids, queries.held, weight, asked_together(queries)))

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, weight, together = shared.value
        best: list[pa.Table | None] = [None] * len(ids)
        floors = [1] * len(ids)
        for table in shards(batches):
            lists, lengths = table.column("terms"), table.column("n").to_numpy()
            sizes = np.diff(offsets(lists))
            times = table.column("counts").combine_chunks().flatten().to_numpy()
            shard = Shard(offsets(lists), lists.combine_chunks().flatten().to_numpy().astype(np.int64),
                          impacts(times, np.repeat(lengths, sizes), documents, total), together)
            own = np.zeros(len(weight), np.int64)
            for q in range(len(ids)):
                own[held[q]] = weight[held[q]]
                rows, scores = shard.search(held[q], own, many, floors[q])
                own[held[q]] = 0
                if len(rows):
                    fresh = pa.table({"score": pa.array(scores), "doc_id": table.column("doc_id").take(pa.array(rows))})
                    both = fresh if best[q] is None else pa.concat_tables([best[q], fresh])
                    best[q] = both.sort_by([("score", "descending"), ("doc_id", "ascending")]).slice(0, many).combine_chunks()
                    if len(best[q]) == many:
                        floors[q] = max(1, best[q].column("score")[many - 1].as_py())
        for q, rows in enumerate(best):
            if rows is not None:
                item = pa.array(np.full(len(rows), ids[q], np.int64))
                yield pa.RecordBatch.from_arrays(
                    [item, rows.column("doc_id").combine_chunks(), rows.column("score").combine_chunks()], names=["item_id", "doc_id", "score"])

    return counts.mapInArrow(searched, "item_id bigint, doc_id bigint, score bigint")


def offsets(lists: pa.ChunkedArray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lists.combine_chunks().value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of about SHARD rows."""
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= SHARD:
            yield pa.Table.from_batches(kept)
            kept = []
    if kept and sum(b.num_rows for b in kept):
        yield pa.Table.from_batches(kept)


def search(documents: DataFrame, items: DataFrame, many: int = MANY) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``many`` best documents of every item."""
    found = documents.sparkSession.createDataFrame([], "item_id bigint, doc_id bigint, score bigint")
    for queries in query_blocks(items):
        found = found.union(ranked_block(term_counts(documents, queries), queries, many))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    for keys in (["item_id", salt], ["item_id"]):
        found = found.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= many)
    return found.select("item_id", "rank", "doc_id", "score")
