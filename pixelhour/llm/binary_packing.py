"""Packing token ids into sequences by the binary digits of a document's length.

A document's ids, with one end id, are cut into whole sequences of ``most`` ids
and then into one piece for each binary digit of what is left (512, 256 … 1).
Each piece is a sequence of its own, so no sequence crosses documents, and its
length is a power of two, so none is padded. Sequences of one length are a
bucket, numbered without gaps: a training batch takes so many of one bucket that
its ids fill the batch.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, saved, ship, text_or_empty
from pixelhour.llm.sharding import number_slots

MOST = 1024
END = 0
#: A Python worker remembers the ids of about so many parts of texts, of so many characters together.
KNOWN, KNOWN_CHARS = 600_000, 8 << 20
#: So many unknown parts are encoded in one call.
TOGETHER = 200
#: Texts are encoded in runs of about so many characters, one text at least.
RUN_CHARS = 4 << 20
#: Other white space than ASCII, in UTF-8.
_SPACES = [c.encode() for c in map(chr, range(0x80, 0x10000)) if c.isspace()]
_WIDE = np.array([int.from_bytes(c.ljust(3, b"\0"), "big") for c in _SPACES])
#: Kinds of bytes: ASCII white space (as Python sees it), ASCII letters and digits, other printable ASCII, first bytes
#: of two-byte characters that are letters but for U+00D7 and U+00F7 (U+00C0 to U+023F, U+0400 to U+047F), first bytes
#: of other white space.
_WHITE, _WORD, _MARK, _LETTER, _LEAD = 1, 2, 3, 4, 5
_KINDS = bytearray(256)
for _byte in range(128):
    _KINDS[_byte] = _WHITE if chr(_byte).isspace() else _WORD if chr(_byte).isalnum() else _MARK if chr(_byte).isprintable() else 0
for _byte in *range(0xC3, 0xC9), 0xD0, 0xD1:
    _KINDS[_byte] = _LETTER
for _space in _SPACES:
    _KINDS[_space[0]] = _LEAD
#: A space and such letters or ASCII ones.
_WORDS = re.compile(" [A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u023f\u0400-\u047f]+").fullmatch


def _white(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Whether each byte belongs to white space."""
    white = kind == _WHITE
    at = np.flatnonzero(kind == _LEAD)
    if len(at):
        wide = np.concatenate([data, np.zeros(2, np.uint8)])
        two = wide[at] < 0xE0
        code = wide[at].astype(np.int64) << 16 | wide[at + 1].astype(np.int64) << 8 | np.where(two, 0, wide[at + 2])
        hit = np.isin(code, _WIDE)
        white[at[hit]] = white[at[hit] + 1] = white[at[hit & ~two] + 2] = True
    return white


def cut_texts(whole: bytes, at: np.ndarray, marks: bool) -> np.ndarray:
    """Whether a part begins at each byte of the texts that start at ``at`` (with the end at last).

    Parts begin where a text does and at a space with no other white space beside it. With ``marks``, they also begin
    at a newline alone in that way, and at an ASCII mark after a letter or digit: pre-tokens of the byte-level pattern
    (`` ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+`` and so on) always begin there. Other patterns may join marks and
    newlines to what is beside them.
    """
    data, kind = (np.frombuffer(b, np.uint8) for b in (whole, whole.translate(_KINDS)))
    cut = np.zeros(len(data), bool)
    if not len(data):
        return cut
    text = ~_white(data, kind)
    edge = data[1:-1] == 0x20
    if marks:
        edge |= data[1:-1] == 0x0A
    cut[1:-1] = edge & text[:-2] & text[2:]
    starts = at[:-1][at[:-1] < at[1:]]
    cut[starts[1:] - 1] = False
    if marks:
        mark = kind == _MARK
        cut[1:] |= mark[1:] & (kind[:-1] == _WORD)
        here = 2 + np.flatnonzero(mark[2:] & (data[1:-1] >= 0x80))
        first, second = data[here - 2], data[here - 1]
        cut[here] |= (kind[here - 2] == _LETTER) & ~((first == 0xC3) & ((second == 0x97) | (second == 0xB7)))
    cut[starts] = True
    return cut


def _turned(part: str) -> str:
    """The part without the space it opens with, or with one if it opens with none; turned again, the part."""
    return part[1:] if part[0] == " " else " " + part


class Coder:
    """Ids of whole texts by a tokenizer file, as little-endian unsigned 32-bit numbers.

    Texts are cut where pre-tokens begin for certain, and each part is encoded once while it is remembered; of too many,
    those of the next run of texts stay. A text that holds a token the file adds to its vocabulary is one part.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        before = self.tokenizer.pre_tokenizer
        self.marks = self.tokenizer.normalizer is None and isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space
        # The same merges for words that need no pattern to be pre-tokens.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(False, use_regex=False)])
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.plain = re.compile(r"[ \n]\S+" if self.marks else r" \S+").fullmatch
        white = tuple(self.tokenizer.id_to_token(self._ids([c])[0][0]) for c in " \n")
        self.opens = np.array([(self.tokenizer.id_to_token(i) or "").startswith(white) for i in range(self.tokenizer.get_vocab_size())])
        #: By parts turned. The first part of a text is not remembered.
        self.known: dict[str, bytes] = {}
        self.chars = 0

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _coded(self, parts: list[str]) -> list[bytes]:
        """The ids of each part. Parts that open with their only white space are encoded many in one text, where a
        token that opens with white space opens a part; those of letters alone are pre-tokens already."""
        found = [b""] * len(parts)
        words: list[int] = []
        plain: list[int] = []
        odd: list[int] = []
        for i, p in enumerate(parts):
            (words if self.marks and _WORDS(p) else plain if self.plain(p) else odd).append(i)
        for tokenizer, own in (self.words, words), (self.tokenizer, plain):
            for i in range(0, len(own), TOGETHER):
                some = own[i: i + TOGETHER]
                text = "".join([parts[j] for j in some])
                if any(t in text for t in self.added):
                    odd += some
                    continue
                ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
                at = [*(4 * np.flatnonzero(self.opens[ids])).tolist(), 4 * len(ids)]
                data = ids.tobytes()
                for j, a, b in zip(some, at[:-1], at[1:], strict=True):
                    found[j] = data[a:b]
        for j, ids in zip(odd, self._ids([parts[j] for j in odd]), strict=True):
            found[j] = np.array(ids, "<u4").tobytes()
        return found

    def _learn(self, parts: list[str]) -> None:
        self.known.update(zip(parts, self._coded([_turned(p) for p in parts]), strict=True))
        self.chars += sum(map(len, parts))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        data = [t.encode() for t in texts]
        whole, at = b"".join(data), np.cumsum([0, *map(len, data)])
        cut = cut_texts(whole, at, self.marks)
        for row, text in enumerate(texts):
            if any(t in text for t in self.added):
                cut[at[row] + 1: at[row + 1]] = False
        start = np.flatnonzero(cut)
        first = np.searchsorted(start, at)
        offsets = np.append(start, len(whole)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(start), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).dictionary_encode()
        names, place = parts.dictionary.to_numpy(zero_copy_only=False).tolist(), parts.indices.to_numpy()

        inner = np.ones(len(place), bool)
        inner[first[:-1][first[:-1] < first[1:]]] = False
        inside = np.zeros(len(names), bool)
        inside[place[inner]] = True
        heads = np.flatnonzero(~inside).tolist()
        rest = np.flatnonzero(inside).tolist()
        here = [_turned(names[i]) for i in rest]
        if len(self.known) > KNOWN or self.chars > KNOWN_CHARS:
            self.known = {p: self.known[p] for p in here if p in self.known}
            self.chars = sum(map(len, self.known))
        coded = list(map(self.known.get, here))
        new = [i for i, ids in enumerate(coded) if ids is None]
        self._learn([here[i] for i in new])
        for i in new:
            coded[i] = self.known[here[i]]
        ids = [b""] * len(names)
        for i, own in chain(zip(heads, self._coded([names[i] for i in heads]), strict=True), zip(rest, coded, strict=True)):
            ids[i] = own

        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        count = sizes[place]
        stop = np.append(0, np.cumsum(count))
        shift = (np.cumsum(sizes) - sizes)[place] - stop[:-1]
        data = np.frombuffer(b"".join(ids), "<u4")[np.repeat(shift, count) + np.arange(stop[-1])].tobytes()
        ends = (4 * stop[first]).tolist()
        return (data[a:b] for a, b in zip(ends, ends[1:], strict=False))


_CODERS: dict[str, Coder] = {}


def _coder(path: str) -> Coder:
    if path not in _CODERS:
        _CODERS.clear()
        _CODERS[path] = Coder(path)
    return _CODERS[path]


def runs(column: pa.Array) -> Iterator[list[str]]:
    run: list[str] = []
    size = 0
    for text in column.to_pylist():
        if run and size + len(text) > RUN_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def cuts(sizes: np.ndarray, most: int = MOST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of so many ids, in order; ``most`` is a power of two."""
    digits = most >> np.arange(1, most.bit_length())
    whole = sizes // most
    has = (sizes[:, None] % most & digits) > 0
    per = whole + has.sum(axis=1)
    document = np.repeat(np.arange(len(sizes)), per)
    place = np.arange(len(document)) - np.repeat(np.cumsum(per) - per, per)
    length = np.full(len(document), most, np.int64)
    length[place >= whole[document]] = np.broadcast_to(digits, has.shape)[has]
    end = np.cumsum(length)
    start = end - length
    return document, start - np.repeat(start[np.cumsum(per) - per], per), length


def pieces(docs: DataFrame, tokenizer_file: str, most: int = MOST, end: int = END, text: str = "text", digest: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``: doc_id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens.

    Null and empty texts have the end id alone. With ``digest``, ids_crc32 (long,
    unsigned) takes the place of ids. Rows are documents of their own, whatever
    their ids; an empty table gives no row.
    """
    if most < 1 or most & (most - 1):
        raise ValueError("the longest sequence must be a power of two")
    ship(docs.sparkSession)
    last = np.array([end], "<u4").tobytes()

    def run(batches):
        coder = _coder(tokenizer_file)
        for batch in batches:
            row = 0
            for texts in runs(batch.column("text")):
                coded = [ids + last for ids in coder.encode(texts)]
                sizes = np.array([len(c) // 4 for c in coded], np.int64)
                document, start, length = cuts(sizes, most)
                views = [memoryview(c) for c in coded]
                parts = (views[d][a: b] for d, a, b in zip(document.tolist(), (4 * start).tolist(), (4 * (start + length)).tolist(), strict=True))
                ids = pa.array([zlib.crc32(p) for p in parts], pa.int64()) if digest else pa.array([bytes(p) for p in parts], pa.binary())
                yield pa.record_batch(
                    [batch.column("doc_id").take(pa.array(row + document)), pa.array(start), pa.array(length), ids, pa.array(sizes[document])],
                    ["doc_id", "start", "length", "ids", "doc_tokens"],
                )
                row += len(texts)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    kind = "long" if digest else "binary"
    made = rows.mapInArrow(run, f"doc_id long, start long, length long, ids {kind}, doc_tokens long")
    return made.withColumnRenamed("ids", "ids_crc32") if digest else made


def numbered(parts: DataFrame, most: int = MOST) -> DataFrame:
    """``parts`` (of :func:`pieces`) with sequence_id (gapless from 0, longest sequences first) and offset.

    Parts are counted by length and hash, so numbering sorts hashed pieces of a
    bucket, never a whole one. Numbers depend on the rows only.
    """
    buckets = most.bit_length()
    rows = saved(parts)
    placed = rows.withColumn("shard", (F.lit(buckets - 1) - F.log2("length").cast("int")).cast("int"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    first = placed.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    # One row for each binary length.
    return number_slots(placed, buckets).join(F.broadcast(first), "shard").select(
        *parts.columns, (F.col("first") + F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"),
    )


def pack(docs: DataFrame, tokenizer_file: str, most: int = MOST, end: int = END, text: str = "text") -> DataFrame:
    """Every sequence with its ids: doc_id, start, length, ids, doc_tokens, sequence_id, offset (always 0)."""
    return numbered(pieces(docs, tokenizer_file, most, end, text), most)


def op12_binary_packing(spark, folder: str) -> DataFrame:
    import public_tokenizers

    made = numbered(pieces(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"), digest=True))
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
