"""Byte-level BPE through a sentencepiece model serialised from a rank file.

Every byte has a printable character; a piece is its bytes as these characters, its score the negative
rank, and nothing is normalised, so the model merges the lowest rank first, as the
rank file says. Texts are split by the public pattern, a split part that is a token itself keeps
that token, others are encoded by the model; decoding maps ids back to bytes.

Defined cases: a null or empty text has no ids; any string round-trips; rows are
independent, so repeated ids or extra columns do not matter.
"""

from __future__ import annotations

import base64
import functools
from array import array
from typing import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitesift.llm.shared import let_go
from sitesift.llm.units import Units, latin_word


@functools.cache
def byte_characters() -> list[str]:
    """A visible character for each byte: itself where it is printable, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


@functools.cache
def rank_table(path: str) -> list[bytes]:
    """Tokens by rank."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    table = {int(rank): base64.b64decode(token) for token, rank in pairs}
    return [table[i] for i in range(len(table))]


def serialised_model(tokens: list[bytes]) -> bytes:
    """A sentencepiece BPE model whose ids are the ranks; one unknown piece comes last."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    characters = byte_characters()
    model = pb.ModelProto()
    for rank, token in enumerate(tokens):
        model.pieces.add(piece="".join(characters[b] for b in token), score=-float(rank), type=1)
    model.pieces.add(piece="⁇", score=0.0, type=2)
    model.trainer_spec.model_type = 2
    model.trainer_spec.vocab_size = len(model.pieces)
    model.trainer_spec.unk_id = len(tokens)
    model.trainer_spec.bos_id = model.trainer_spec.eos_id = model.trainer_spec.pad_id = -1
    model.normalizer_spec.name = "identity"
    model.normalizer_spec.add_dummy_prefix = False
    model.normalizer_spec.remove_extra_whitespaces = False
    model.normalizer_spec.escape_whitespaces = False
    return model.SerializeToString()


@functools.cache
def encoder(path: str, pattern: str) -> Units:
    """One per task and vocabulary."""
    import sentencepiece

    tokens = rank_table(path)
    model = sentencepiece.SentencePieceProcessor(model_proto=serialised_model(tokens))
    whole = {token: array("I", [rank]).tobytes() for rank, token in enumerate(tokens)}
    split = regex.compile(pattern).findall
    mapped = {b: c for b, c in enumerate(byte_characters())}
    gap = mapped[32]

    def encode(units: list[str]) -> list[bytes]:
        """Pieces that are a token are looked up; the others go through the model together and fill their places."""
        out: list = [b""] * len(units)
        hard: list[str] = []
        places: list[tuple[list, int]] = []
        for i, unit in enumerate(units):
            if unit[:1] == " " and latin_word(unit[1:]):
                raw = unit.encode("utf-8")
                if (known := whole.get(raw)) is None:
                    # ASCII letters are their own characters in the model
                    hard.append(gap + unit[1:] if unit.isascii() else raw.decode("latin-1").translate(mapped))
                    places.append((out, i))
                else:
                    out[i] = known
                continue
            parts = out[i] = []
            for piece in split(unit):
                raw = piece.encode("utf-8")
                if (known := whole.get(raw)) is None:
                    hard.append(raw.decode("latin-1").translate(mapped))
                    places.append((parts, len(parts)))
                parts.append(known)
        for (held, at), ids in zip(places, model.encode(hard, out_type=int, num_threads=1), strict=True):
            held[at] = array("I", ids).tobytes()
        return [x if type(x) is bytes else b"".join(x) for x in out]

    return Units(encode)


def ids_of(texts: pa.Array, path: str, pattern: str) -> pa.ListArray:
    parts = list(encoder(path, pattern).portions(texts))
    sizes = [np.diff(ends, prepend=0) for _, ends in parts]
    ends = np.cumsum(np.concatenate([[0], *sizes]), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, "<i4"), *(ids.view("<i4") for ids, _ in parts)])))


@functools.cache
def token_array(path: str) -> pa.Array:
    return pa.array(rank_table(path), pa.large_binary())


def bytes_of(lists: pa.ListArray, path: str) -> pa.Array:
    """The bytes of all ids are taken in one go; the ends of the lists tell the rows."""
    taken = token_array(path).take(lists.flatten())
    if not len(taken):
        return pa.array([b"" if v else None for v in lists.is_valid().to_pylist()], pa.binary())
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    at = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[np.cumsum([0, *sizes])].astype(np.int32)
    rows = pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(at), taken.buffers()[2]])
    return pc.if_else(lists.is_valid(), rows, None) if lists.null_count else rows


def encode(text: Column | str, path: str, pattern: str) -> Column:
    """array<int>: ids of the text."""

    @F.arrow_udf("array<int>")
    def ids(texts: pa.Array) -> pa.Array:
        return ids_of(texts, path, pattern)

    return ids(text)


def decode(ids: Column | str, path: str) -> Column:
    """binary: bytes of the ids."""

    @F.arrow_udf("binary")
    def data(lists: pa.Array) -> pa.Array:
        return bytes_of(lists, path)

    return data(ids)


def both_ways(text: Column | str, path: str, pattern: str) -> Column:
    """struct<ids: array<int>, data: binary>: ids of the text and what they decode to.

    ``decode(encode(text))`` beside ``encode(text)`` in one query would encode each text twice.
    """

    @F.arrow_udf("struct<ids:array<int>,data:binary>")
    def coded(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in parts:
            ids = ids_of(texts, path, pattern)
            yield pa.StructArray.from_arrays([ids, bytes_of(ids, path)], names=["ids", "data"])
            del texts, ids
        # The worker lives on; a new encoder takes a quarter of a second.
        for made in (encoder, rank_table, token_array):
            made.cache_clear()
        let_go()

    return coded(text)


def bpe_digest(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    coded = documents.select("doc_id", both_ways("text", path, pattern).alias("coded"))
    # The text of an array is "[1, 2]": no string object per id, unlike joining an array of strings.
    listed = F.btrim(F.replace(F.col("coded.ids").cast("string"), F.lit(", "), F.lit(",")), F.lit("[]"))
    return coded.select(
        "doc_id", F.size("coded.ids").cast("long").alias("n_tokens"),
        F.sha2(listed, 256).alias("ids_sha256"),
        F.sha2("coded.data", 256).alias("decoded_sha256"))
