"""Tokens of Arrow text columns, computed per distinct word rather than per word."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 4 << 20
_mark = re.compile(r"[\W_]+")


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds about ``most`` bytes of text; a longer text is a part by itself."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if i > start and held + size > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < len(sizes):
        yield batch.slice(start)


class Tokens:
    """Words of texts: ``ids`` index ``words``; text i has ``ids[offsets[i]:offsets[i + 1]]``.

    Words are maximal runs of anything but Unicode white space. Null and empty texts have none.
    """

    def __init__(self, texts: pa.Array):
        texts = pc.fill_null(texts, "")
        split = pc.utf8_split_whitespace(texts)
        flat = split.flatten().dictionary_encode()
        ids = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = split.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = offsets - offsets[0]
        self.words: list[str] = flat.dictionary.to_pylist()
        self.ids, self.offsets = ids, offsets
        if "" in self.words:
            self.keep(ids != self.words.index(""))

    def keep(self, mask: np.ndarray) -> None:
        """Drop the tokens for which ``mask`` is false."""
        self.offsets = np.concatenate([[0], np.cumsum(mask)])[self.offsets]
        self.ids = self.ids[mask]

    def normalized(self) -> np.ndarray:
        """Replace tokens by 64-bit hashes of their lower-case letters and digits; drop tokens that have none."""
        hashes = np.zeros(len(self.words), dtype=np.uint64)
        full = np.zeros(len(self.words), dtype=bool)
        for i, word in enumerate(self.words):
            plain = _mark.sub("", word.lower())
            if plain:
                hashes[i], full[i] = xxhash.xxh3_64_intdigest(plain), True
        self.keep(full[self.ids] if len(self.ids) else np.zeros(0, dtype=bool))
        return hashes[self.ids] if len(self.ids) else np.zeros(0, dtype=np.uint64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.offsets)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Sum per-token values (tokens x any) over each text."""
        out = np.zeros((len(self.offsets) - 1, *values.shape[1:]))
        full = np.flatnonzero(self.counts)
        if len(full):
            out[full] = np.add.reduceat(values, self.offsets[:-1][full], axis=0, dtype=np.float64)
        return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTE = np.zeros(256, dtype=np.uint8)  # 0: a mark, dropped; 1: white space; 2: part of a word
_BYTE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = 1
_BYTE[np.r_[48:58, 65:91, 97:123, 128:256]] = 2
_P = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least ``n`` powers of an odd number and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        for k, base in enumerate((_P, _INVERSE)):
            with np.errstate(over="ignore"):
                _powers[k] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, base, dtype=np.uint64)]), dtype=np.uint64)
    return _powers[0], _powers[1]


def word_hashes(texts: pa.Array, marks: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, and the offset of each text's first.

    Words are runs of anything but ASCII white space, in lower case and without ASCII punctuation; what has nothing else
    is no word. With ``marks``, case counts, and runs of punctuation are words that end those of letters. Null texts have
    none. All bytes are handled at once: a word's hash is a difference of running sums of bytes times powers of an odd
    number, times the inverse power at its start.
    """
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts if marks else pc.utf8_lower(texts)])  # an array of its own, without a slice's offset
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if ends[-1] == ends[0]:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    kind = _BYTE[data]
    letters = np.flatnonzero(kind != 1 if marks else kind == 2)
    # a word starts at a letter if white space, a text's start or a change of kind lies between it and the letter before
    space = np.cumsum(kind == 1, dtype=np.int32)[letters]
    text_of = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))[letters]
    first = np.ones(len(letters), dtype=bool)
    first[1:] = (space[1:] != space[:-1]) | (text_of[1:] != text_of[:-1])
    if marks:
        first[1:] |= np.diff(kind[letters]) != 0
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(ends), dtype=np.int64)
    power, inverse = power_tables(len(letters) + 1)
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum((data[letters].astype(np.uint64) + np.uint64(1)) * power[: len(letters)], dtype=np.uint64)])
    stops = np.append(starts[1:], len(letters))
    hashes = mix((sums[stops] - sums[starts]) * inverse[starts] + (stops - starts).astype(np.uint64))
    return hashes, np.searchsorted(text_of[starts], np.arange(len(ends)), side="left").astype(np.int64)
