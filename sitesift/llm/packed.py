"""Token ids in patched frame-of-reference blocks.

A segment is one row of a written table: an image with a header, an index of block starts,
the blocks, and the documents that lie in it. A block holds 128 ids: its minimum, the
residuals packed at the bit width that nine in ten of them need, and the
others whole in an exception list. Segments follow each other in ascending
order of the document ids; a document lies in one segment.

Image: magic, block length, ids, documents (u32 each); start of every block and end of
the last (u32); minimum (u32), width (u8), exceptions (u8) of every block; the blocks (packed
words, exception places u8, exception residuals u32); token count of every document (u32).

Defined cases: a null text counts as empty and has only the end id; rows without a
doc_id come first; rows that repeat a doc_id stand together, in the order of their texts' hashes.
"""

from __future__ import annotations

import functools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sitesift.llm.shared import stored
from sitesift.llm.units import Units, sliced

MAGIC = b"PFOR"
BLOCK = 128
SHARE = 0.9
#: A segment is closed when it has so many ids (1 MB of 32-bit ids) or more.
SEGMENT_IDS = 1 << 18


def bit_lengths(values: np.ndarray) -> np.ndarray:
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def packed_words(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 128) residuals under 2**width as (blocks, 2 * width) 64-bit words."""
    words = np.zeros((2 * width, len(values)), dtype=np.uint64)
    columns = np.ascontiguousarray(values.T).astype(np.uint64)
    for i in range(BLOCK):
        word, shift = divmod(i * width, 64)
        words[word] |= columns[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= columns[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).astype("<u8")


def unpacked_words(words: np.ndarray, width: int) -> np.ndarray:
    columns = np.ascontiguousarray(words.T)
    out = np.zeros((BLOCK, len(words)), dtype=np.uint64)
    mask = np.uint64((1 << width) - 1)
    for i in range(BLOCK) if width else ():
        word, shift = divmod(i * width, 64)
        out[i] = columns[word] >> np.uint64(shift)
        if shift + width > 64:
            out[i] |= columns[word + 1] << np.uint64(64 - shift)
        out[i] &= mask
    return out.T


def pack(ids: np.ndarray, counts: np.ndarray) -> bytes:
    """Image of the ids (uint32) of documents with ``counts`` ids each."""
    blocks = -(-len(ids) // BLOCK)
    grid = np.zeros(blocks * BLOCK, dtype=np.uint32)
    grid[: len(ids)] = ids
    grid[len(ids):] = ids[-1] if len(ids) else 0
    grid = grid.reshape(blocks, BLOCK)
    least = grid.min(axis=1) if blocks else np.zeros(0, np.uint32)
    rest = grid - least[:, None]
    lengths = bit_lengths(rest)
    place = int(np.ceil(SHARE * BLOCK)) - 1
    widths = np.partition(lengths, place, axis=1)[:, place] if blocks else np.zeros(0, np.uint8)
    odd = lengths > widths[:, None]
    exceptions = odd.sum(axis=1).astype(np.int64)
    sizes = 16 * widths.astype(np.int64) + 5 * exceptions
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    body = np.zeros(int(starts[-1]), dtype=np.uint8)
    for width in np.unique(widths):
        if width:
            mine = np.flatnonzero(widths == width)
            words = packed_words(np.where(odd[mine], 0, rest[mine]), int(width)).view(np.uint8).reshape(len(mine), -1)
            body[starts[mine][:, None] + np.arange(words.shape[1])] = words
    row, column = np.nonzero(odd)
    nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(exceptions)])[row]
    at = starts[row] + 16 * widths[row].astype(np.int64)
    body[at + nth] = column
    body[(at + exceptions[row] + 4 * nth)[:, None] + np.arange(4)] = rest[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return b"".join([
        MAGIC, struct.pack("<III", BLOCK, len(ids), len(counts)), starts.astype("<u4").tobytes(),
        least.astype("<u4").tobytes(), widths.astype(np.uint8).tobytes(), exceptions.astype(np.uint8).tobytes(),
        body.tobytes(), counts.astype("<u4").tobytes()])


def unpack(image: bytes, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of blocks first to last, token counts of all documents), read through the block index."""
    if image[:4] != MAGIC:
        raise ValueError("not a packed segment")
    block, total, documents = struct.unpack_from("<III", image, 4)
    blocks = -(-total // block)
    at = 16
    starts = np.frombuffer(image, "<u4", blocks + 1, at).astype(np.int64)
    at += 4 * (blocks + 1)
    least = np.frombuffer(image, "<u4", blocks, at)
    at += 4 * blocks
    widths = np.frombuffer(image, np.uint8, blocks, at)
    exceptions = np.frombuffer(image, np.uint8, blocks, at + blocks).astype(np.int64)
    at += 2 * blocks
    body = np.frombuffer(image, np.uint8, int(starts[-1]), at)
    counts = np.frombuffer(image, "<u4", documents, at + int(starts[-1]))
    last = blocks if last is None else min(last, blocks)
    wanted = np.arange(first, last)
    out = np.zeros((len(wanted), block), dtype=np.uint32)
    for width in np.unique(widths[wanted]):
        mine = wanted[widths[wanted] == width]
        words = body[starts[mine][:, None] + np.arange(16 * int(width))]
        out[mine - first] = unpacked_words(np.ascontiguousarray(words).view("<u8"), int(width)).astype(np.uint32)
    n = exceptions[wanted]
    row = np.repeat(np.arange(len(wanted)), n)
    nth = np.arange(len(row)) - np.concatenate([[0], np.cumsum(n)])[row]
    begin = starts[wanted][row] + 16 * widths[wanted][row].astype(np.int64)
    column = body[begin + nth]
    values = np.ascontiguousarray(body[(begin + n[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[row, column] = values
    out += least[wanted][:, None]
    return out.reshape(-1)[: total - first * block], counts


@functools.cache
def encoder(path: str) -> Units:
    """One per Python worker and vocabulary."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    size = model.get_vocab_size(with_added_tokens=True)
    # Every character of a byte-level token is one byte.
    width = np.array([len(model.id_to_token(i) or "") for i in range(size)], dtype=np.int64)

    def encode(units: list[str]) -> list[bytes]:
        """Units are encoded in long joined runs where a cut between them is none for the split pattern.

        A line feed before a unit without white space of its own is one piece and one byte.
        """
        out: list = [b""] * len(units)
        alone = [i for i, u in enumerate(units) if not u or u[-1].isspace() or (u[0].isspace() and u[0] not in " \n")]
        joined = sorted(set(range(len(units))).difference(alone))
        for at in range(0, len(joined), 512):
            places = joined[at: at + 512]
            some = [u if (u := units[i])[0] in " \n" else "\n" + u for i in places]
            ids = np.array(model.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.searchsorted(np.cumsum(width[ids]), np.cumsum([len(u.encode()) for u in some]), side="right")
            begins = np.concatenate([[0], ends[:-1]]) + [len(u) > len(units[i]) for u, i in zip(some, places)]
            raw = ids.tobytes()
            for i, a, b in zip(places, (4 * begins).tolist(), (4 * ends).tolist()):
                out[i] = raw[a:b]
        for i, found in zip(alone, model.encode_batch_fast([units[i] for i in alone], add_special_tokens=False)):
            out[i] = np.array(found.ids, dtype="<u4").tobytes()
        return out

    return Units(encode)


def write(documents: DataFrame, vocabulary: str, end_id: int = 2) -> DataFrame:
    """Writes the ids of all documents in segments and returns the written table.

    Columns: part and number (order of the segments), n_ids, doc_ids, image.
    """
    rows = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("tie"))
    placed = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    schema = "part int, number int, n_ids bigint, doc_ids array<bigint>, image binary"

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, part = encoder(vocabulary), TaskContext.get().partitionId()
        end = np.array([end_id], "<u4").tobytes()
        number, names, coded, filled = 0, [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(coded), "<u4")
            counts = np.array([len(c) // 4 for c in coded], dtype=np.uint32)
            return pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()),
                pa.array([names], pa.list_(pa.int64())), pa.array([pack(ids, counts)], pa.binary())],
                names=["part", "number", "n_ids", "doc_ids", "image"])

        for batch in batches:
            found = (x for ids, ends in units.portions(batch.column(1)) for x in sliced(ids, ends))
            for name, ids in zip(batch.column(0).to_pylist(), found, strict=True):
                names.append(name)
                coded.append(ids + end)
                filled += len(coded[-1]) // 4
                if filled >= SEGMENT_IDS:
                    yield close()
                    number, names, coded, filled = number + 1, [], [], 0
        if names:
            yield close()

    return stored(placed.mapInArrow(segments, schema))


def read(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the written images.

    Starts come from the segments' counts: a running sum inside each part, and
    one over the parts, of which there are as many as tasks.
    """
    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, counts = unpack(row["image"])
                ends = np.cumsum(counts, dtype=np.int64)
                starts = ends - counts
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a: 4 * b]) for a, b in zip(starts.tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["part"]] * n, pa.int32()), pa.array([row["number"]] * n, pa.int32()),
                    pa.array(row["doc_ids"], pa.int64()), pa.array(starts), pa.array(counts.astype(np.int64)),
                    pa.array(crc, pa.int64())], names=["part", "number", "doc_id", "offset", "n_tokens", "ids_crc32"])

    parts = written.groupBy("part").agg(F.sum("n_ids").alias("ids"))
    parts = parts.select("part", (F.sum("ids").over(W.orderBy("part")) - F.col("ids")).alias("before"))
    inside = F.sum("n_ids").over(W.partitionBy("part").orderBy("number")) - F.col("n_ids")
    begins = written.select("part", "number", inside.alias("inside")).join(parts, "part")
    rows = written.select("part", "number", "doc_ids", "image").mapInArrow(
        documents, "part int, number int, doc_id bigint, offset bigint, n_tokens bigint, ids_crc32 bigint")
    return rows.join(begins, ["part", "number"]).select(
        "doc_id", (F.col("before") + F.col("inside") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32")
