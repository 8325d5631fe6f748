"""Words and word n-grams of Arrow text batches, as numpy arrays.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``; UTF-8
keeps those bytes for white space alone, so bytes and characters agree. Words
never cross documents. Null and empty texts have no words. Hashes have 64 bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Documents are worked on in slices of about so many bytes (one document at least), which bounds memory.
SLICE_BYTES = 1 << 20
#: A slice has at most so many documents, whose numbers take as many high bits of a 64-bit key.
SLICE_BITS = 10

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[0x61:0x7B] = ord("a")
_SHAPE[0x80:] = ord("a")
_SHAPE[0x41:0x5B] = ord("A")
_SHAPE[0x30:0x3A] = ord("0")
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """The words of some documents, one after another.

    ``first`` has a document's first word at its place and the number of words at
    the end; ``start`` and ``length`` are bytes of ``data``.
    """

    data: np.ndarray
    start: np.ndarray
    length: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def documents(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        """One hash for each word, of its bytes and length."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        out = mix(self.length.astype(np.uint64))
        todo, done = np.arange(len(self.start)), 0
        while len(todo):
            left = self.length[todo] - done
            block = eight[self.start[todo] + done] & _MASK[np.minimum(left, 8)]
            out[todo] = mix(out[todo] ^ (block * np.uint64(0x9E3779B97F4A7C15)))
            todo, done = todo[left > 8], done + 8
        return out


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8), at


def split(data: np.ndarray, at: np.ndarray, lower: bool = True) -> Words:
    """The words of the documents whose bytes start at ``at``."""
    low, high = int(at[0]), int(at[-1])
    data, at = data[low:high], at - low
    if not len(data):
        return Words(data, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64))
    space = _SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], space[:-1]]) | edge[:-1]
    after = np.concatenate([space[1:], [True]]) | edge[1:]
    start = np.flatnonzero(~space & before)
    end = np.flatnonzero(~space & after) + 1
    return Words(_LOWER[data] if lower else data, start, end - start, np.searchsorted(start, at))


def slices(column: pa.Array, lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row + 1, words) for runs of rows of bounded size."""
    data, at = text_buffers(column)
    row, rows = 0, len(at) - 1
    while row < rows:
        stop = int(np.searchsorted(at, at[row] + SLICE_BYTES, "right")) - 1
        stop = min(max(stop, row + 1), row + (1 << SLICE_BITS), rows)
        yield row, stop, split(data, at[row: stop + 1], lower)
        row = stop


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of every run of ``size`` words, in order.

    A document of fewer words, but at least one, has its whole sequence as one
    shingle.
    """
    h, counts = words.hashes(), words.counts
    per = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    document = np.repeat(np.arange(len(counts)), per)
    start = words.first[:-1][document] + np.arange(len(document)) - np.repeat(np.cumsum(per) - per, per)
    end = words.first[1:][document]
    out = np.zeros(len(start), np.uint64)
    for j in range(size):
        here = start + j
        inside = here < end
        value = np.where(inside, h[np.minimum(here, max(len(h) - 1, 0))] if len(h) else np.uint64(0), np.uint64(j + 1))
        out = mix(out ^ (value * np.uint64(2 * j + 3)))
    return document, out


def distinct(document: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash) pairs of a slice, sorted; hashes keep their upper 54 bits."""
    low = np.uint64(64 - SLICE_BITS)
    keys = (document.astype(np.uint64) << low) | (hashes >> np.uint64(SLICE_BITS))
    keys.sort()
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> low).astype(np.int64), keys & ((np.uint64(1) << low) - np.uint64(1))


def shapes(words: Words) -> Words:
    """The shape of each word (of texts that were not lower-cased)."""
    kind = _SHAPE[words.data]
    keep = np.ones(len(kind), bool)
    keep[1:] = kind[1:] != kind[:-1]
    keep[words.start] = True
    place = np.cumsum(keep)
    start = place[words.start] - 1
    return Words(kind[keep], start, place[words.start + words.length - 1] - start, words.first)


_BESIDE_SPACE = re.compile(r"\s(?= )| (?=\s)")
_RARE_SPACE = re.compile(r"[^\S \n]")
_RARE_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
_SINGLE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def cut_at_spaces(text: str) -> list[str]:
    """The parts of a text between single spaces; every part but the first stands for itself with a space before it.

    Only spaces with no other white space beside them are cut, which is where the
    pre-tokens of byte-level vocabularies (`` ?\\p{L}+`` and so on) always begin.
    """
    return text.split(" ") if _spaces_alone(text) else _SINGLE_SPACE.split(text)


def _spaces_alone(text: str) -> bool:
    """Whether no space has other white space beside it; most texts have spaces and newlines only and need no pattern."""
    if "  " in text or " \n" in text or "\n " in text:
        return False
    rare = any(c in text for c in _RARE_ASCII) if text.isascii() else _RARE_SPACE.search(text)
    return not rare or _BESIDE_SPACE.search(text) is None
