"""Document fingerprints by a homomorphic multiset hash.

A paragraph (a line that isn't empty) is hashed to a wide vector of 64-bit lanes;
a document's vector is the sum of its paragraphs' vectors modulo 2**64. Equal
multisets of paragraphs have equal sums in any order, and a paragraph is put in
or taken out by adding or subtracting its own vector.

A second part of the vector makes likeness readable: every run of up to eight
words inside a sentence adds a hashed byte, modulo 2**8, to one lane of a level
drawn from its hash (each level has half of the runs of the one before). Lanes
that differ between two vectors tell how many runs differ. All parts are sums, so
all of them add and subtract.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import documents
from pixelhour.llm.words import Words, mix, slices, text_buffers

WIDE = 8
#: Levels for any text: the estimate is full at 16 * ln(32) * 2**39 differing runs.
LEVELS, LANES = 40, 16
RUN = 8
WIDTH = 8 * WIDE + 8 + LEVELS * LANES  # bytes: wide lanes, the number of runs, levels
#: Neighbours are found in ranges of ids: so many for each shuffle partition of the session, from so many sampled ids each.
RANGES_PER_PARTITION = 4
SAMPLED_PER_RANGE = 20


def _paragraphs(data: np.ndarray, at: np.ndarray) -> Words:
    """The lines with bytes, laid out like words."""
    low = int(at[0])
    data, at = data[low: int(at[-1])], at - low
    inside = data != 0x0A
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    before = np.concatenate([[True], ~inside[:-1]])[: len(data)] | edge[:-1]
    after = np.concatenate([~inside[1:], [True]])[: len(data)] | edge[1:]
    start = np.flatnonzero(inside & before)
    end = np.flatnonzero(inside & after) + 1
    return Words(data, start, end - start, np.searchsorted(start, at))


def _runs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the runs of up to RUN words inside a sentence or line."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    owner = words.documents()
    line = np.cumsum(words.data == 0x0A)[words.start]
    stop = np.isin(words.data[words.start + words.length - 1], np.frombuffer(b".!?", np.uint8))
    opens = np.concatenate([[True], stop[:-1] | (line[1:] != line[:-1]) | (owner[1:] != owner[:-1])])
    place = np.arange(n)
    within = place - np.maximum.accumulate(np.where(opens, place, 0))
    first = np.flatnonzero(within % RUN == 0)
    hashes = np.add.reduceat(mix(words.hashes() + (within % RUN).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), first)
    return owner[first], mix(hashes)


def vectors(column: pa.Array) -> np.ndarray:
    """The vector of each text as WIDTH bytes; null and empty texts have zeros."""
    data, at = text_buffers(column)
    out = np.zeros((len(at) - 1, WIDTH), np.uint8)
    for row, stop, words in slices(column, lower=False):
        n = stop - row
        lines = _paragraphs(data, at[row: stop + 1])
        filled = np.flatnonzero(lines.counts)
        if len(filled):
            h = lines.hashes()
            lanes = mix(h[:, None] + np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
            out[row + filled, : 8 * WIDE] = np.add.reduceat(lanes, lines.first[filled], axis=0).view(np.uint8)
        owner, h = _runs(words)
        number = np.bincount(owner, minlength=n).astype(np.uint64)
        out[row:stop, 8 * WIDE: 8 * WIDE + 8] = number.view(np.uint8).reshape(n, 8)
        low = h & (~h + np.uint64(1))  # the lowest bit set draws the level
        level = np.minimum(np.log2(np.maximum(low, 1).astype(np.float64)), LEVELS - 1).astype(np.int64)
        other = mix(h + np.uint64(0x9E3779B97F4A7C15))  # its bits are independent of the level's
        lane = (other >> np.uint64(40)).astype(np.int64) % LANES
        value = (other >> np.uint64(52)).astype(np.int64) % 255 + 1
        sums = np.bincount((owner * LEVELS + level) * LANES + lane, value, n * LEVELS * LANES)
        out[row:stop, 8 * WIDE + 8:] = (sums.astype(np.int64) & 255).astype(np.uint8).reshape(n, -1)
    return out


def plus(one: np.ndarray, two: np.ndarray, sign: int = 1) -> np.ndarray:
    """The vectors of ``one`` with those of ``two`` put in (sign 1) or taken out (sign -1)."""
    wide = 8 * WIDE + 8
    a, b = (np.ascontiguousarray(x[:, :wide]).view(np.uint64) for x in (one, two))
    head = (a + b if sign > 0 else a - b).view(np.uint8)
    tail = one[:, wide:] + two[:, wide:] if sign > 0 else one[:, wide:] - two[:, wide:]
    return np.concatenate([head, tail], axis=1)


def likeness(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The estimated share of runs that two texts have in common, 0 to 1; equal vectors have 1."""
    wide = 8 * WIDE + 8
    total = sum(np.ascontiguousarray(x[:, 8 * WIDE: wide]).view(np.uint64)[:, 0].astype(np.float64) for x in (one, two))
    differ = (one[:, wide:] != two[:, wide:]).reshape(-1, LEVELS, LANES).sum(axis=2)
    full = differ > LANES * 3 // 4
    lowest = np.where(full.any(axis=1), LEVELS - full[:, ::-1].argmax(axis=1), 0)  # above the last level that is too full
    lowest = np.minimum(lowest, LEVELS - 1)
    runs = -LANES * np.log(1 - np.minimum(differ, LANES - 0.5) / LANES)
    kept = np.where(np.arange(LEVELS) >= lowest[:, None], runs, 0).sum(axis=1)
    changed = np.minimum(kept * 2.0**lowest, total)
    out = np.where(total > 0, 1 - changed / np.maximum(total, 1), 0)
    return np.where((one == two).all(axis=1), 1.0, out)


def to_hex(rows: np.ndarray) -> list[str]:
    return [r.tobytes().hex() for r in rows]


def from_hex(values: list[str]) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(values)), np.uint8).reshape(-1, WIDTH)


def fingerprint(docs: DataFrame, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """Every row of ``docs`` with its text's fingerprint (hexadecimal), in ``into`` (replaced if there).

    Null counts as empty, whose fingerprint is all zeros, as is that of a text of
    empty lines alone.
    """
    columns = [c for c in docs.columns if c != into]

    def run(batches):
        for batch in batches:
            made = pa.array(to_hex(vectors(batch.column(text))), pa.string())
            yield pa.record_batch([*[batch.column(c) for c in columns], made], [*columns, into])

    rows = docs.select(columns)
    return rows.mapInArrow(run, rows.limit(0).selectExpr("*", f"cast('' as string) as {into}").schema)


def beside(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) dealt to ranges of ids, each range followed by the first row after it.

    Returns range_no, ahead (1 for that first row), doc_id, text, sorted by
    range_no, ahead, doc_id, text within partitions, a range in one of them. Rows
    without an id come after all others; after the last row comes the first.
    Texts are shuffled once.
    """
    spark = docs.sparkSession
    ranges = RANGES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.filter("doc_id is not null").select("doc_id").distinct()
    sample = sorted(r[0] for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(ranges * SAMPLED_PER_RANGE).collect())
    bounds = np.array(sorted({sample[i * len(sample) // ranges] for i in range(1, ranges)}) if sample else [], np.int64)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        missing = ids.isna()
        found = np.searchsorted(bounds, ids.fillna(0).to_numpy(dtype=np.int64), "right")
        return pd.Series(np.where(missing, len(bounds) + 1, found)).astype("int32")

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("range_no", range_of("doc_id"))
    # At most one row for each range.
    heads = rows.groupBy("range_no").agg(F.min(F.struct("doc_id", F.xxhash64("text").alias("text_hash"))).alias("first")).orderBy("range_no").collect()
    ahead = spark.createDataFrame(
        [(heads[i - 1]["range_no"], h["first"]["doc_id"], h["first"]["text_hash"]) for i, h in enumerate(heads)],
        "before int, first_id long, text_hash long",
    )
    follow = rows.join(
        F.broadcast(ahead), rows["doc_id"].eqNullSafe(ahead["first_id"]) & (F.xxhash64(rows["text"]) == ahead["text_hash"]),
    ).select(F.col("before").alias("range_no"), F.lit(1).alias("ahead"), "doc_id", "text")
    every = rows.select("range_no", F.lit(0).alias("ahead"), "doc_id", "text").union(follow)
    order = ["range_no", "ahead", F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return every.repartition("range_no").sortWithinPartitions(*order)


def _edited(rows: list[tuple], follows: list[str]) -> tuple[list[str], list[str]]:
    texts = [text for _, text in rows]
    edited = []
    for text, after in zip(texts, follows, strict=True):
        half = len(text) // 2
        edited.append(text[: len(text) - half] + after[:half])
    return texts, edited


def _compared(batches):
    """Fingerprints of each row, its edited text and the row after it, over sorted rows of ranges."""
    def finish(rows: list[tuple], follows: list[str]):
        texts, edited = _edited(rows, follows)
        own, changed, after = (vectors(pa.array(x, pa.large_string())) for x in (texts, edited, follows))
        return pa.record_batch(
            [
                pa.array([i for i, _ in rows], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array(to_hex(own), pa.string()), pa.array(to_hex(changed), pa.string()),
                pa.array(likeness(own, changed)), pa.array(likeness(own, after)),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    waiting = None  # (range, id, text) of the last row, whose follower is still to come
    for batch in batches:
        rows, follows, size = [], [], 0
        for number, ahead, doc_id, text in zip(*[batch.column(c).to_pylist() for c in ("range_no", "ahead", "doc_id", "text")], strict=True):
            if waiting and waiting[0] == number:
                rows.append(waiting[1:])
                follows.append(text)
                size += len(waiting[2]) + len(text)
            waiting = None if ahead else (number, doc_id, text)
            if size > 4 << 20:
                yield finish(rows, follows)
                rows, follows, size = [], [], 0
        if rows:
            yield finish(rows, follows)


def op10_fingerprints(spark, folder: str) -> DataFrame:
    return beside(documents(spark, folder)).mapInArrow(
        _compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
