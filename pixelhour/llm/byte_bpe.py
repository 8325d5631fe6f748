"""Byte-level BPE encoding and decoding by merge replay over a corpus.

The distinct pre-tokens of a corpus stand one after another as byte tokens; an
inverted index leads from the rank of a merge to the positions of the pairs that
make it. Merges are applied in rank order, at all positions of a rank together (the
leftmost of each pre-token at a time), and only the pairs beside a merged one are
looked up again.

Texts are worked on in slices, and cut into parts at single spaces. A first pass
counts for every part the slices that have it: the pre-tokens of those of several
slices are replayed once for the whole corpus, and the results go to every task (a
table of bounded size, the widest spread first). A slice replays what it has alone,
and what is beyond that bound.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import Scratch, documents, fetched, most_frequent, ship
from pixelhour.llm.words import cut_at_spaces

#: White space as Unicode defines it; the regex module's \s also has \x1c to \x1f.
_SPACE = r"\p{White_Space}"
#: A slice has about so many characters, one text at least.
SLICE_CHARS = 8 << 20
#: Parts are counted over slices of about so many.
COUNTED_CHARS = 16 << 20
#: So many parts of at most so many characters are sent to all tasks.
SHARED_PARTS, SHARED_CHARS = 1 << 18, 32
#: A Python worker remembers about so many parts of texts, of so many characters together.
KNOWN, KNOWN_CHARS = 300_000, 8 << 20
#: The ids of so many parts are put into words together.
SAID = 1 << 13


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a rank file (a base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def compiled(pattern: str) -> regex.Pattern:
    return regex.compile(pattern.replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", _SPACE).replace(r"\S", r"\P{White_Space}"))


def _table(values: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Values one after another, and the n + 1 places where they start."""
    return np.frombuffer(b"".join(values), np.uint8), np.cumsum([0, *map(len, values)])


def _joined(table: tuple[np.ndarray, np.ndarray], ids: np.ndarray, ends: np.ndarray) -> Iterator[bytes]:
    """The values of ``ids``, joined for each run of ids that stops at ``ends``."""
    data, at = table
    sizes = at[ids + 1] - at[ids]
    stop = np.cumsum(sizes)
    joined = data[np.repeat(at[ids] - stop + sizes, sizes) + np.arange(sizes.sum())].tobytes()
    bounds = np.append(0, stop)[ends].tolist()
    return (joined[begin:end] for begin, end in zip([0, *bounds], bounds, strict=False))


class Merger:
    """Encodes pre-tokens by the ranks of a vocabulary, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, shared: dict[str, bytes] | None = None) -> None:
        self.ranks = ranks
        self.shared = shared or {}
        self.known: dict[str, bytes] = {}
        self.said: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.chars = 0
        self.tokens = {i: t for t, i in ranks.items()}
        self.size = max(self.tokens) + 1
        self.decimal = _table([f" {i}".encode() for i in range(self.size)])
        self.spelling = _table([self.tokens.get(i, b"") for i in range(self.size)])
        self.pieces = compiled(pattern)
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        made: dict[int, int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    made[left * self.size + right] = rank
        self.pairs = np.array(sorted(made), np.int64)
        self.made = np.array([made[k] for k in self.pairs.tolist()], np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the token two neighbours make, or -1; a neighbour of -1 is none."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where((self.pairs[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def merge(self, words: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as little-endian 32-bit numbers."""
        out = [self.ranks[w].to_bytes(4, "little") if w in self.ranks else b"" for w in words]
        todo = [i for i, w in enumerate(words) if w and not out[i]]
        if not todo:
            return out
        lengths = np.array([len(words[i]) for i in todo])
        word = np.repeat(np.arange(len(todo)), lengths)
        token = self.bytes[np.frombuffer(b"".join(words[i] for i in todo), np.uint8)]
        n = len(token)
        after = np.arange(1, n + 1)
        before = np.arange(-1, n - 1)
        ends = np.cumsum(lengths)
        after[ends - 1] = n
        before[ends - lengths] = -1
        token = np.append(token, -1)  # place n: no neighbour
        rank = self._rank(token[:n], token[after])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def add(places: np.ndarray) -> None:
            places = places[rank[places] >= 0]
            if not len(places):
                return
            ranks = rank[places]
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            ends = [*(np.flatnonzero(ranks[1:] != ranks[:-1]) + 1).tolist(), len(ranks)]
            for begin, end in zip([0, *ends], ends, strict=False):
                r, group = int(ranks[begin]), places[begin:end]
                if r not in index:
                    index[r] = []
                    heapq.heappush(heap, r)
                index[r].append(group)

        add(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            at = np.unique(np.concatenate(index.pop(r)))
            at = at[rank[at] == r]
            if not len(at):
                continue
            leftmost = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            rest, at = at[~leftmost], at[leftmost]
            gone = after[at]
            token[at] = r
            after[at] = after[gone]
            token[gone], rank[gone] = -1, -1
            has = after[at] < n
            before[after[at][has]] = at[has]
            rank[at] = self._rank(token[at], token[after[at]])
            left = before[at]
            left = left[left >= 0]
            rank[left] = self._rank(token[left], token[after[left]])
            add(np.concatenate([at, left, rest]))
        alive = token[:n] >= 0
        ids = token[:n][alive].astype("<i4").tobytes()
        ends = (4 * np.cumsum(np.bincount(word[alive], minlength=len(todo)))).tolist()
        for i, begin, end in zip(todo, [0, *ends], ends, strict=False):
            out[i] = ids[begin:end]
        return out

    def _coded(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; the texts are one corpus for the replay."""
        split = [self.pieces.findall(t) for t in texts]
        words = list(set(chain.from_iterable(split)))
        look = dict(zip(words, self.merge([w.encode() for w in words]), strict=True)).__getitem__
        return [look(found[0]) if len(found) == 1 else b"".join(map(look, found)) for found in split]

    def _slice(self, texts: list[str], digests: bool) -> tuple[list[list[str]], list[bytes]]:
        """The parts of each text and the ids of its first; the ids of the others (or what digests are made of) are remembered."""
        if len(self.known) + len(self.said) > KNOWN or self.chars > KNOWN_CHARS:
            self.forget()
        parts = [cut_at_spaces(t) for t in texts]
        new = list(set(chain.from_iterable(p[1:] for p in parts)).difference(self.said if digests else self.known))
        self.chars += sum(map(len, new))
        ids = list(map(self.shared.get, new))
        alone = [i for i, known in enumerate(ids) if known is None]
        coded = self._coded([*[p[0] for p in parts], *[" " + new[i] for i in alone]])
        for i, made in zip(alone, coded[len(parts):], strict=True):
            ids[i] = made
        if digests:
            for i in range(0, len(new), SAID):
                said, spelled = self._said(ids[i: i + SAID])
                self.said.update(zip(new[i: i + SAID], said, strict=True))
                self.spelled.update(zip(new[i: i + SAID], spelled, strict=True))
        else:
            self.known.update(zip(new, ids, strict=True))
        return parts, coded[: len(parts)]

    def forget(self) -> None:
        self.known, self.said, self.spelled, self.chars = {}, {}, {}, 0

    def _said(self, coded: list[bytes]) -> tuple[Iterator[bytes], Iterator[bytes]]:
        """The ids of each of some texts in decimal, each after a space, and the bytes they stand for."""
        ids = np.frombuffer(b"".join(coded), "<i4")
        ends = np.cumsum(np.array([len(c) // 4 for c in coded], np.int64))
        return _joined(self.decimal, ids, ends), _joined(self.spelling, ids, ends)

    def encode_bytes(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian 32-bit numbers.

        Texts are first cut at single spaces between characters that aren't white
        space, where a pre-token always ends; what follows such a space is split
        and merged with it once for all its occurrences.
        """
        parts, heads = self._slice(texts, False)
        for head, part in zip(heads, parts, strict=True):
            yield b"".join([head, *map(self.known.__getitem__, part[1:])])

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text."""
        return (np.frombuffer(ids, "<i4").tolist() for ids in self.encode_bytes(texts))

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text the number of its ids, and digests of the ids in decimal and of the bytes they stand for."""
        parts, heads = self._slice(texts, True)
        for head, part in zip(heads, parts, strict=True):
            said, spelled = self._said([head])
            said = b"".join([*said, *map(self.said.__getitem__, part[1:])])
            spelled = b"".join([*spelled, *map(self.spelled.__getitem__, part[1:])])
            yield said.count(b" "), hashlib.sha256(said[1:]).hexdigest(), hashlib.sha256(spelled).hexdigest()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of some ids; an id outside the vocabulary is an error."""
        return b"".join(map(self.tokens.__getitem__, ids))


_MERGERS: dict[tuple, Merger] = {}


@contextmanager
def merger(shared, pattern: str) -> Iterator[Merger]:
    """The merger of a broadcast vocabulary, made once for each Python worker.

    A worker serves other stages after this one, so parts of texts are let go when a task ends.
    """
    key = (shared.value["key"], pattern)
    if key not in _MERGERS:
        _MERGERS.clear()
        _MERGERS[key] = Merger(shared.value["ranks"], pattern)
    coder = _MERGERS[key]
    coder.shared = shared.value["parts"]
    try:
        yield coder
    finally:
        coder.shared = {}
        coder.forget()


def share_ranks(spark, path: str, parts: dict[str, bytes] | None = None):
    """The rank file's content for all executors (its size is the vocabulary's, whatever the corpus), and the ids of some parts."""
    ship(spark)
    ranks = read_ranks(path)
    key = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast({"key": key, "ranks": ranks, "parts": parts or {}})


def spread_parts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(part, n) of the parts (after a single space) that several slices of the texts have, n slices each."""
    def run(batches):
        for batch in batches:
            for texts in text_slices(batch.column(0), COUNTED_CHARS):
                found = set(chain.from_iterable(cut_at_spaces(t)[1:] for t in texts))
                yield pa.record_batch([pa.array([p for p in found if len(p) <= SHARED_CHARS], pa.string())], ["part"])

    ship(docs.sparkSession)
    return docs.select(text).mapInArrow(run, "part string").groupBy("part").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def shared_ids(docs: DataFrame, rank_file: str, pattern: str, text: str = "text") -> dict[str, bytes]:
    """The ids of the corpus's most widely spread parts with the space before them, replayed once."""
    ranks = share_ranks(docs.sparkSession, rank_file)

    def run(batches):
        with merger(ranks, pattern) as coder:
            for batch in batches:
                coded = coder._coded([" " + p for p in batch.column("part").to_pylist()])
                yield pa.record_batch([batch.column("part"), pa.array(coded, pa.binary())], ["part", "ids"])

    scratch = Scratch(docs.sparkSession, "spread-parts")
    parts = most_frequent(scratch.save(spread_parts(docs, text)), SHARED_PARTS)
    found = fetched(parts.select("part").mapInArrow(run, "part string, ids binary"))
    scratch.drop()
    return dict(zip(found["part"].tolist(), found["ids"].tolist(), strict=True))


def text_slices(column: pa.Array, most: int = 0) -> Iterator[list[str]]:
    """The texts (null: empty) in runs of bounded total length, one text at least."""
    run: list[str] = []
    size, most = 0, most or SLICE_CHARS
    for text in column.to_pylist():
        text = text or ""
        if run and size + len(text) > most:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """``docs`` with an array of token ids for each whole text, in ``into`` (replaced if there).

    No text gets special tokens; null and empty texts have no ids. An empty table
    gives no row.
    """
    shared = share_ranks(docs.sparkSession, rank_file, shared_ids(docs, rank_file, pattern, text))
    columns = [c for c in docs.columns if c != into]

    def run(batches):
        with merger(shared, pattern) as coder:
            for batch in batches:
                coded = [ids for texts in text_slices(batch.column(text)) for ids in coder.encode_bytes(texts)]
                ends = np.cumsum([0, *map(len, coded)]) // 4
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4"), pa.int32()))
                yield pa.record_batch([*[batch.column(c) for c in columns], ids], [*columns, into])

    rows = docs.select(columns)
    return rows.mapInArrow(run, rows.limit(0).selectExpr("*", f"cast(null as array<int>) as {into}").schema)


def decode(coded: DataFrame, rank_file: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """``coded`` with the bytes of each row's ids, in ``into`` (replaced if there). Null ids give no bytes."""
    shared = share_ranks(coded.sparkSession, rank_file)
    columns = [c for c in coded.columns if c != into]

    def run(batches):
        with merger(shared, pattern) as coder:
            for batch in batches:
                made = [coder.decode(x.as_py() or []) for x in batch.column(ids)]
                yield pa.record_batch([*[batch.column(c) for c in columns], pa.array(made, pa.binary())], [*columns, into])

    rows = coded.select(columns)
    return rows.mapInArrow(run, rows.limit(0).selectExpr("*", f"cast(null as binary) as {into}").schema)


def digests(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """For each document, the number and digest of its ids and the digest of what they decode to.

    Encodes and decodes as :func:`encode` and :func:`decode` do, in one pass over the texts.
    """
    shared = share_ranks(docs.sparkSession, rank_file, shared_ids(docs, rank_file, pattern))

    def run(batches):
        with merger(shared, pattern) as coder:
            for batch in batches:
                rows = [row for texts in text_slices(batch.column("text")) for row in coder.digests(texts)]
                sizes, coded, decoded = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.record_batch(
                    [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_byte_bpe(spark, folder: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
