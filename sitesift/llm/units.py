"""Cutting texts into units that a byte-level tokenizer treats alone, with a cache of their ids.

The split pattern never joins a character that is not white space with white
space after it, so a text may be cut before every space or line feed that follows such a character.
Most units are a word with its space, and most words come again: Arrow cuts a portion of texts and tells
its distinct units, which alone are Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of a Python worker's cache, counted as UNIT_BYTES for a unit's places, also in the table in which a portion is looked up,
#: and twice its length (text and ids): of each generation of units that came again, and of those seen once.
CACHE_BYTES, ONCE_BYTES, UNIT_BYTES = 12 << 20, 12 << 20, 80
#: Bytes of text that are cut at a time, and characters of units that are encoded at a time.
PORTION_BYTES, CHARS_AT_ONCE = 1 << 21, 1 << 17
#: White space of the split pattern; before a space or line feed, it forbids the cut.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters in every Unicode version, and what begins a piece after them: no apostrophe, and no bar, which stands in special tokens (<|name|>).
LATIN, PUNCTUATION = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]", r"[!-&(-/:-@\[-`{}~]"
#: Stands where texts are cut. A text that has it already is one unit.
CUT = "\0"


def cut(texts: pa.Array) -> pa.Array:
    """Lists of the units of each text."""
    if pc.any(pc.match_substring_regex(texts, f"[{BLANKS}][ \n]|\n[{BLANKS}]")).as_py():
        marked = pc.replace_substring_regex(texts, f"([^{BLANKS}])([ \n])", f"\\1{CUT}\\2")
    else:  # a line feed between other characters is alone as well
        marked = pc.replace_substring(pc.replace_substring(texts, " ", CUT + " "), "\n", f"{CUT}\n{CUT}")
    return pc.split_pattern(pc.replace_substring_regex(marked, f"({LATIN})({PUNCTUATION})", f"\\1{CUT}\\2"), CUT)


def sliced(ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """The 32-bit ids between successive ``ends`` as bytes."""
    raw, at = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
    return [raw[a:b] for a, b in zip(at, at[1:])]


def latin_word(text: str) -> bool:
    """Letters only, of blocks in which every Unicode version sees the same letters."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class Kept:
    """Different units and their ids, the latest last."""

    def __init__(self, units: pa.Array | None = None, ids: pa.Array | None = None):
        self.units = pa.array([], pa.string()) if units is None else units
        self.ids = pa.array([], pa.large_binary()) if ids is None else ids
        self.weight = UNIT_BYTES * len(self) + 2 * sum(pc.sum(pc.binary_length(x)).as_py() or 0 for x in (self.units, self.ids))

    def __len__(self) -> int:
        return len(self.units)

    def items(self) -> Iterator[tuple[str, bytes]]:
        return zip(self.units.to_pylist(), self.ids.to_pylist())


class Units:
    """Ids of whole texts through ``encode``, which takes many units and gives the bytes of the ids of each.

    What came once waits apart, so that a long tail of rare words doesn't push out the frequent ones. What came again is kept in
    two generations: when the newer one is full it becomes the older one, and what is used again moves over.
    All are bounded by bytes, as a worker lives on after its stage.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]]):
        self.encode = encode
        self.newer, self.older, self.once = Kept(), Kept(), Kept()

    def _encoded(self, units: list[str]) -> pa.Array:
        out, at = [], 0
        while at < len(units):
            end, size = at, 0
            while end < len(units) and (end == at or size + len(units[end]) <= CHARS_AT_ONCE):
                size += len(units[end])
                end += 1
            out.append(pa.array(self.encode(units[at:end]), pa.large_binary()))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.large_binary())

    def _keep(self, units: pa.Array, ids: pa.Array, counts: np.ndarray) -> None:
        """The three parts after a portion: ``units`` has the newer, the older, those seen once, and the fresh ones."""
        ends = np.cumsum([len(self.newer), len(self.older), len(self.once)])
        part = np.searchsorted(ends, np.arange(len(units)), side="right")
        newer = (part == 0) | (counts > 1) | ((part < 3) & (counts > 0))
        newer[pc.equal(units, "").to_numpy(zero_copy_only=False)] = False

        def some(chosen: np.ndarray) -> Kept:
            at = pa.array(np.flatnonzero(chosen))
            return Kept(units.take(at), ids.take(at))

        self.older, self.once, self.newer = some((part == 1) & ~newer), some((part >= 2) & ~newer), some(newer)
        if self.newer.weight > CACHE_BYTES:
            self.older, self.newer = self.newer, Kept()
        if self.once.weight > ONCE_BYTES:
            self.once = Kept()

    def ids(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian 32-bit ids of each text; a null text has none."""
        return [x for ids, ends in self.portions(texts) for x in sliced(ids, ends)]

    def portions(self, texts: list[str] | pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of successive texts of about PORTION_BYTES, and where each text ends in them."""
        texts = pc.fill_null(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()), "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            before = int(ends[at - 1]) if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + PORTION_BYTES, side="right")))
            yield self._some(texts.slice(at, end - at))
            at = end

    def _some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        whole = pc.match_substring(texts, CUT)
        uncut = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        lists = cut(pc.if_else(whole, "", texts) if len(uncut) else texts)
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(), dtype=np.int64)])
        kept = (self.newer, self.older, self.once)
        n = sum(map(len, kept))
        # The kept units are different, so they have the first codes and a fresh unit has one from n on.
        coded = pa.concat_arrays([*(k.units for k in kept), lists.flatten()]).dictionary_encode()
        codes, units = coded.indices.to_numpy()[n:], coded.dictionary
        ids = pa.concat_arrays([*(k.ids for k in kept), self._encoded(units.slice(n).to_numpy(zero_copy_only=False).tolist())])
        self._keep(units, ids, np.bincount(codes, minlength=len(units)))
        if len(uncut):
            codes = codes.copy()
            codes[ends[uncut]] = np.arange(len(ids), len(ids) + len(uncut))  # each is the one, empty unit of its text
            ids = pa.concat_arrays([ids, self._encoded(texts.take(pa.array(uncut)).to_pylist())])
        joined = ids.take(pa.array(codes))
        places = np.frombuffer(joined.buffers()[1], np.int64, len(joined) + 1)[ends[1:]] // 4
        return np.frombuffer(joined.buffers()[2], "<u4", int(places[-1])) if places[-1] else np.zeros(0, "<u4"), places
