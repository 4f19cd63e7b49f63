"""Substring dedup: repeated paragraphs and passages.

A paragraph is a line of 5 words or more. Paragraphs get MinHash signatures of their 5-word shingles; the
number of rows in a band is the largest at which the bands still find a pair of the wanted
similarity with the wanted recall. Colliding paragraphs are verified by exact Jaccard
similarity (0.8 or more), and links form components. Nodes of a crowded bucket meet their next neighbours in sorted order; those
still apart are met by a prefix-filter join, which leaves no pair out.

Passages also stand inside and across lines. Where a paragraph cannot be the unit, a piece of 32 words
is: pieces start at the words whose 5-word shingle has the least hash among 20 in a row. Any 51 words
that occur in two documents therefore share a piece. Equal pieces collide (a band of all their words).

Of every repeated piece the occurrence of the smallest (doc_id, first word) stays whole. The others, with the equal words
around them, are joined to spans along one kept text and are removals. Of a component of paragraphs the smallest occurrence stays.

Defined cases: null and empty texts have neither; repeats inside one document alone are no
repeats across documents; a null doc_id takes no part, any other (negative ones too) does; rows that repeat a doc_id are one
document; of equal paragraphs the smallest (doc_id, first word) stays; other columns are not read. A text of any length is read
whole; its pieces are held by one task.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitesift.llm.neardup import (
    FACTORS, PLACES, SHINGLE, Forest, linked_roots, mixed, shingle_set, signed_codes, word_codes)
from sitesift.llm.shared import dropped, durable, let_go, marked, split_words, stored

#: Every line with a 5-word shingle is a paragraph.
LEAST_WORDS = SHINGLE
PIECE_WORDS, ANCHOR_SPAN = 32, 20
#: A shared passage begins at most so many words before its first common piece, and ends so many after the last.
AROUND = ANCHOR_SPAN - 1
SHARE, RECALL, SIGNATURE = 80, 0.999, 64
#: Bytes of text whose words are hashed together.
PORTION_BYTES = 1 << 20


def tuned(share: int = SHARE, recall: float = RECALL, hashes: int = SIGNATURE) -> Forest:
    """Most rows a band at which ``hashes`` in bands find a pair of similarity ``share`` with ``recall``."""
    rows = max([r for r in range(1, hashes + 1)
                if 1 - (1 - (share / 100) ** r) ** (hashes // r) >= recall], default=1)
    return Forest(trees=hashes // rows, step=rows, depth=max(rows, 12), hashes=hashes)


def paragraphs(text: str | None) -> Iterator[tuple[int, int, str]]:
    """(first word, words, line) of the lines with enough words."""
    at = 0
    for line in (text or "").split("\n"):
        n = len(split_words(line))
        if n >= LEAST_WORDS:
            yield at, n, line
        at += n


def portions(texts: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """Successive texts of about PORTION_BYTES, and the row of the first."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        end = max(at + 1, int(np.searchsorted(ends, before + PORTION_BYTES, side="right")))
        yield at, texts.slice(at, end - at)
        at = end


def least_places(order: np.ndarray) -> np.ndarray:
    """Place of the first least value among ``ANCHOR_SPAN`` from each place on."""
    least, place, width = order, np.arange(len(order)), 1
    while width < ANCHOR_SPAN:
        step = min(width, ANCHOR_SPAN - width)
        later = least[step:] < least[:-step]
        least = np.where(later, least[step:], least[:-step])
        place = np.where(later, place[step:], place[:-step])
        width += step
    return place


def pieces(codes: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, 64-bit hash) of every anchored piece of texts of ``size`` words, whose hashes are ``codes``."""
    ends = np.cumsum(size)
    begins = ends - size
    places = size - PIECE_WORDS + 1  # where a piece of the text can begin
    if not (places > 0).any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    n = len(codes) - PIECE_WORDS + 1
    total = np.zeros(n, dtype=np.uint64)
    for i in range(SHINGLE):
        total += codes[i: n + i] * PLACES[i]
    order = mixed(total)
    many, few = places > ANCHOR_SPAN, (places > 0) & (places <= ANCHOR_SPAN)
    anchors = np.array([a + order[a: a + k].argmin() for a, k in zip(begins[few].tolist(), places[few].tolist())], np.int64)
    if many.any():
        spans = places[many] - ANCHOR_SPAN + 1
        inside = np.repeat(begins[many] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        found = least_places(order)[inside]
        anchors = np.concatenate([anchors, found[np.concatenate([[True], found[1:] != found[:-1]])]])
        anchors.sort()
    # Hash of the words from each place on, by doubling up to 32 words.
    hashes, width = codes, 1
    while width < PIECE_WORDS:
        hashes = mixed(hashes[:-width] * FACTORS[width % 7] + hashes[width:])
        width *= 2
    text = np.searchsorted(ends, anchors, side="right")
    return text, anchors - begins[text], hashes[anchors]


def texts_by_id(documents: DataFrame) -> DataFrame:
    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def piece_rows(documents: DataFrame) -> DataFrame:
    """(piece, doc_id, start) of all pieces."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                text, start, hashes = pieces(*word_codes(texts))
                if len(text):
                    yield pa.RecordBatch.from_arrays([
                        pa.array(hashes.view(np.int64)), batch.column(0).take(pa.array(text + at)), pa.array(start.astype(np.int32))],
                        names=["piece", "doc_id", "start"])
        let_go()

    return texts_by_id(documents).mapInArrow(cut, "piece bigint, doc_id bigint, start int")


def surroundings(documents: DataFrame, asked: DataFrame) -> DataFrame:
    """(doc_id, first, last, before, after) of the places in ``asked`` (doc_id, places): hashes of the ``AROUND`` words
    before word ``first`` and from word ``last`` on. A place that a text does not reach is left out."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                codes, size = word_codes(texts)
                raw, ends = codes.tobytes(), np.cumsum(size)
                lists = batch.column(2).slice(at, len(texts))
                wanted = lists.flatten()
                text = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
                first, last = (wanted.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                there = last <= size[text]
                text, first, last = text[there], first[there], last[there]
                begin, end = ends[text] - size[text], ends[text]
                a, b = begin + first, begin + last
                before = [raw[x:y] for x, y in zip((8 * np.maximum(begin, a - AROUND)).tolist(), (8 * a).tolist())]
                after = [raw[x:y] for x, y in zip((8 * b).tolist(), (8 * np.minimum(end, b + AROUND)).tolist())]
                if len(text):
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).take(pa.array(text + at)), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32)),
                        pa.array(before, pa.binary()), pa.array(after, pa.binary())], names=["doc_id", "first", "last", "before", "after"])
        let_go()

    near, _ = marked(texts_by_id(documents), "doc_id", asked.select("doc_id"))
    rows = near.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(
        read, "doc_id bigint, first int, last int, before binary, after binary")
    # texts that share a doc_id are one document
    return rows.groupBy("doc_id", "first", "last").agg(F.min(F.struct("before", "after")).alias("around")).select(
        "doc_id", "first", "last", "around.before", "around.after")


def alike(x: pa.Array, y: pa.Array, back: bool) -> np.ndarray:
    """How many words (hashes of 8 bytes, ``AROUND`` at most) are equal in each row of ``x`` and ``y``, from the beginning or ``back`` from the end."""
    found, at = [], np.arange(AROUND)
    for side in (x, y):
        ends = np.frombuffer(side.buffers()[1], np.int32)[side.offset: side.offset + len(side) + 1] // 8
        words = np.append(np.frombuffer(side.buffers()[2] or b"", np.uint64, int(ends[-1])), np.zeros(1, np.uint64))
        place = ends[1:, None] - 1 - at if back else ends[:-1, None] + at
        inside = at < np.diff(ends)[:, None]
        found.append((words[np.where(inside, place, -1)], inside))
    (a, here), (b, there) = found
    return np.cumprod((a == b) & here & there, axis=1).sum(axis=1)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def runs_of(doc: int, rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, first, last, kept_doc, kept_first): the pieces (start, kept_doc, kept_start) of a document, joined along each kept text.

    All words of a run stand in the kept text as well, so what more is equal lies at its two ends.
    """
    lines: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for s, d, k in rows:
        lines.setdefault((d, s - k), []).append((s, s + PIECE_WORDS))
    return [(doc, a, b, d, a - shift) for (d, shift), spans in lines.items() for a, b in united(spans)]


def passages_of(doc: int, runs: list[tuple[int, int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """(doc_id, start, n_words, kept_doc, kept_start) from the runs (first, last, kept_doc, kept_first, more left, more right) of a document.

    Removed runs with their equal surroundings are joined along one kept text; words of a piece that stays are left out.
    """
    stay = united([(a, b) for a, b, d, k, _, _ in runs if (d, k) == (doc, a)])
    out = [(doc, a, b - a, doc, a) for a, b in stay]
    lines: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for a, b, d, k, more_left, more_right in runs:
        if (d, k) != (doc, a):
            lines.setdefault((d, a - k), []).append((a - more_left, b + more_right))
    firsts, lasts = [a for a, _ in stay], [b for _, b in stay]
    for (d, shift), spans in lines.items():
        for a, b in united(spans):
            for i in range(bisect_right(lasts, a), bisect_left(firsts, b)):
                if firsts[i] > a:
                    out.append((doc, a, firsts[i] - a, d, a - shift))
                a = max(a, lasts[i])
            if a < b:
                out.append((doc, a, b - a, d, a - shift))
    return out


def by_document(rows: DataFrame, first: str, make: Callable[[int, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """``make`` of each document's rows, which begin with doc_id and ``first``."""
    names = [part.split()[0] for part in schema.split(", ")]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents of a sorted partition; the open one waits for the next batch."""
        def table(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*out), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32()))], names=names)

        doc, held = None, []
        for batch in batches:
            out = []
            for name, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if name != doc:
                    out.extend(make(doc, held))
                    doc, held = name, []
                held.append(tuple(row))
            if out:
                yield table(out)
        if held:
            yield table(make(doc, held))

    return rows.repartition("doc_id").sortWithinPartitions("doc_id", first).mapInArrow(walk, schema)


def repeated_passages(documents: DataFrame) -> DataFrame:
    """(doc_id, start, n_words, kept_doc, kept_start) of passages that occur in several documents."""
    found = stored(piece_rows(documents))
    kept = stored(found.groupBy("piece").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.max("doc_id").alias("high")).where(
        "kept.doc_id <> high").select("piece", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.start").alias("kept_start")))
    placed = stored(found.join(kept, "piece").select("doc_id", "start", "kept_doc", "kept_start"))
    dropped(found, kept)
    runs = stored(by_document(placed, "start", runs_of, "doc_id bigint, first int, last int, kept_doc bigint, kept_first int"))
    dropped(placed)

    stays = F.expr("doc_id = kept_doc AND first = kept_first")
    moved = runs.where(~stays).withColumn("kept_last", F.expr("kept_first + last - first"))
    places = moved.selectExpr("doc_id", "struct(first, last) AS place").union(
        moved.selectExpr("kept_doc", "struct(kept_first AS first, kept_last AS last)"))
    asked = stored(places.groupBy("doc_id").agg(F.collect_set("place").alias("places")))
    around = stored(surroundings(documents, asked))

    @F.arrow_udf("struct<l:int,r:int>")
    def more(b: pa.Array, a: pa.Array, kept_b: pa.Array, kept_a: pa.Array) -> pa.Array:
        ends = alike(b, kept_b, True), alike(a, kept_a, False)
        return pa.StructArray.from_arrays([pa.array(n.astype(np.int32)) for n in ends], names=["l", "r"])

    other = around.toDF("kept_doc", "kept_first", "kept_last", "kept_before", "kept_after")
    ends = moved.join(around, ["doc_id", "first", "last"]).join(other, ["kept_doc", "kept_first", "kept_last"]).select(
        "doc_id", "first", "last", "kept_doc", "kept_first", more("before", "after", "kept_before", "kept_after").alias("more"))
    longer = stored(ends.select("doc_id", "first", "last", "kept_doc", "kept_first", "more.l", "more.r").union(
        runs.where(stays).selectExpr("doc_id", "first", "last", "kept_doc", "kept_first", "0", "0")))
    dropped(runs, asked, around)
    return by_document(longer, "first", passages_of, "doc_id bigint, start int, n_words int, kept_doc bigint, kept_start int")


def repeated_paragraphs(documents: DataFrame, share: int = SHARE) -> DataFrame:
    """(doc_id, start, n_words, kept_doc, kept_start) of paragraphs with a near copy in another document."""
    forest = tuned(share)
    rows = texts_by_id(documents)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                lists = pc.split_pattern(texts, "\n")
                coded = lists.flatten().dictionary_encode()  # equal lines are signed once
                codes, size = word_codes(coded.dictionary)
                which = coded.indices.to_numpy(zero_copy_only=False)
                held = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                text = np.repeat(np.arange(len(texts)), held)
                first = (np.cumsum(held) - held)[text]  # the first line of a line's text
                words = size[which]
                kept, fit = words >= LEAST_WORDS, size >= LEAST_WORDS
                if not kept.any():
                    continue
                start, number = np.cumsum(words) - words, np.cumsum(kept) - kept
                start, number = start - start[first], number - number[first]
                n, low, high, signs = signed_codes(codes[np.repeat(fit, size)], size[fit], forest)
                sig = pa.Array.from_buffers(pa.binary(), len(signs), [
                    None, pa.py_buffer(np.arange(len(signs) + 1, dtype=np.int32) * signs.shape[1]), pa.py_buffer(signs.tobytes())])
                own = (np.cumsum(fit) - 1)[which[kept]]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(text[kept] + at)), pa.array(number[kept].astype(np.int64)), pa.array(start[kept].astype(np.int32)),
                    pa.array(words[kept].astype(np.int32)), pa.array(n[own].astype(np.int32)), pa.array(low[own]), pa.array(high[own]), sig.take(pa.array(own))],
                    names=["doc_id", "number", "start", "n_words", "n", "k1", "k2", "sig"])
        let_go()

    found = stored(rows.mapInArrow(
        sign, "doc_id bigint, number bigint, start int, n_words int, n int, k1 bigint, k2 bigint, sig binary"))
    groups = found.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "number", "sig")).alias("m"))
    # ids are given once, when the table is written
    nodes = stored(groups.select(F.monotonically_increasing_id().alias("id"), "n", "k1", "k2", "m.doc_id", "m.number", "m.sig"))
    sized = stored(found.select("doc_id", "start", "n_words", "n", "k1", "k2"))
    dropped(found)

    def sets_of(ids: DataFrame) -> DataFrame:
        asked = stored(nodes.select("id", "doc_id", "number").join(ids, "id", "left_semi").groupBy("doc_id").agg(
            F.collect_list(F.struct("number", "id")).alias("lines")))

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, lines in zip(batch.column(0), batch.column(1).to_pylist()):
                    wanted = {x["number"]: x["id"] for x in lines}
                    out.extend((wanted[number], shingle_set(line).tobytes())
                               for number, (_, _, line) in enumerate(paragraphs(text.as_py())) if number in wanted)
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.binary()))], names=["id", "shingles"])
            let_go()

        near, _ = marked(rows, "doc_id", asked.select("doc_id"))
        sets = stored(near.join(asked, "doc_id").select("text", "lines").mapInArrow(
            read, "id bigint, shingles binary").dropDuplicates(["id"]))
        dropped(asked)
        return sets

    roots = linked_roots(nodes.select("id", "n", "sig"), forest, share, sets_of)
    named = nodes.select("n", "k1", "k2", "id").join(roots.withColumnRenamed("id", "r"), F.expr("id = r"), "left").select(
        F.col("n").alias("gn"), F.col("k1").alias("g1"), F.col("k2").alias("g2"), F.coalesce("root", "id").alias("root"))
    placed = durable(sized.join(
        named, F.expr("k1 = g1 AND k2 = g2 AND n = gn")).select("root", "doc_id", "start", "n_words").distinct())
    dropped(sized, nodes)
    kept = placed.groupBy("root").agg(F.min(F.struct("doc_id", "start")).alias("kept"), F.max("doc_id").alias("high"))
    return placed.join(kept.where("kept.doc_id <> high"), "root").select(
        "doc_id", "start", "n_words", F.col("kept.doc_id").alias("kept_doc"), F.col("kept.start").alias("kept_start"))


def repeats(documents: DataFrame) -> DataFrame:
    """Both kinds, with ``removed``: every occurrence but the one that stays."""
    documents = documents.select("doc_id", "text")
    out = repeated_paragraphs(documents).withColumn("kind", F.lit("paragraph")).union(
        repeated_passages(documents).withColumn("kind", F.lit("passage")))
    removed = (F.col("doc_id") != F.col("kept_doc")) | (F.col("start") != F.col("kept_start"))
    return out.select("doc_id", "kind", "start", "n_words", "kept_doc", "kept_start", removed.alias("removed"))
