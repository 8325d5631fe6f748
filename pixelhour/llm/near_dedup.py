"""Near-duplicate documents by a multi-index Hamming join of b-bit MinHash signatures, confirmed on full sets.

A document's word shingles give one 8-bit value for each of ``PLACES`` hash
functions. The first ``CHUNKS * WIDTH`` values are cut into chunks; two signatures
that differ in at most ``2 * CHUNKS - 1`` of these places have a chunk that differs
in at most one (pigeonhole), so each chunk is indexed once for every place that may
be wrong, by its other values, and such pairs share a key. At a similarity of 0.8 a
chunk so matches with probability 0.65, and all chunks miss with 3e-6. The other
values only sharpen the estimate that rules pairs out before full sets are read.

Keys are not expanded into pairs. Documents of equal sets are one class; in each
key every class is held against the smallest one (its hub), and confirmed links
become components. What is left are classes of different components that share a
key: keys of few classes are joined with themselves, and classes of larger keys
are dealt to tiles of bounded size which are held against each other in full,
each tile pair a task, skipping pairs already connected. So groups of copies cost
in proportion to their size, no key is cut off, and no link between two different
sets that share a key is lost.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import Scratch, batches_of, documents, private, ship, small_or_joined, text_or_empty
from pixelhour.llm.graph import components
from pixelhour.llm.words import distinct, mix, shingles, slices, split, text_buffers

CHUNKS, WIDTH = 12, 6
PLACES = 112
#: Pairs whose signatures differ in more places than this cannot be confirmed: at a similarity of 0.8
#: the number of differing places has mean 22.3 and deviation 4.2.
MOST_DIFFERENT = 46
#: Keys of at most so many classes are joined with themselves.
FEW = 32
#: A tile has about so many classes, and about so many shingles.
TILE, TILE_SHINGLES = 1000, 2_000_000
#: Rows of an Arrow batch; texts are whole.
BATCH_ROWS = 1000
#: Ids to drop are broadcast up to this number (8 bytes each).
BROADCAST_IDS = 500_000
#: Stand-ins for missing ids start here, above all ids.
NO_ID = 1 << 62

_SALT = mix(np.arange(1, PLACES + 1, dtype=np.uint64) * np.uint64(0x51_7C_C1_B7_27_22_0A_95))
_XOR = (_SALT >> np.uint64(32)).astype(np.uint32)
_MULTIPLY = (_SALT & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)


def _sets(words, size: int):
    """Documents with shingles, the first place of each in ``hashes``, and their distinct shingle hashes."""
    owner, hashes = distinct(*shingles(words, size))
    present, first = np.unique(owner, return_index=True)
    return present, first, hashes


def _signed(size: int):
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            count = np.zeros(n, np.int64)
            keys = np.zeros((n, 2), np.uint64)
            values = np.zeros((n, PLACES), np.uint8)
            for row, _, words in slices(batch.column("text")):
                present, first, hashes = _sets(words, size)
                if not len(present):
                    continue
                count[row + present] = np.diff(np.append(first, len(hashes)))
                for k, salt in enumerate((0x1234567, 0x7654321)):
                    keys[row + present, k] = np.add.reduceat(mix(hashes ^ np.uint64(salt)), first)
                short = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32)
                for k in range(PLACES):
                    least = np.minimum.reduceat((short ^ _XOR[k]) * _MULTIPLY[k], first)
                    values[row + present, k] = (least * np.uint32(0x9E3779B1)) >> np.uint32(24)
            some = count > 0
            yield pa.record_batch(
                [
                    batch.column("doc_id"), batch.column("own"), pa.array(count),
                    pa.array([k.tobytes() if s else None for k, s in zip(keys, some, strict=True)], pa.binary()),
                    pa.array([v.tobytes() if s else None for v, s in zip(values, some, strict=True)], pa.binary()),
                ],
                ["doc_id", "own", "n_shingles", "set_key", "signature"],
            )
    return run


def _index(batches):
    """(key, node) for every chunk and place that may be wrong."""
    for batch in batches:
        n = batch.num_rows
        values = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint8).reshape(n, PLACES)
        chunk = np.zeros((n, CHUNKS, 8), np.uint8)
        chunk[:, :, :WIDTH] = values[:, : CHUNKS * WIDTH].reshape(n, CHUNKS, WIDTH)
        whole = chunk.view("<u8")[:, :, 0]
        kinds = np.arange(CHUNKS * WIDTH, dtype=np.uint64).reshape(CHUNKS, WIDTH)
        keys = np.empty((n, CHUNKS, WIDTH), np.uint64)
        for w in range(WIDTH):
            kept = whole & ~np.uint64(0xFF << (8 * w))
            keys[:, :, w] = mix(kept ^ mix(kinds[:, w] + np.uint64(1)))
        yield pa.record_batch(
            [pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), CHUNKS * WIDTH))], ["key", "node"],
        )


def _similar_signatures(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose signatures and set sizes allow the similarity asked for."""
    def run(batches):
        for batch in batches:
            n = batch.num_rows
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(n, -1) for c in ("sig_a", "sig_b"))
            near = (one != two).sum(axis=1) <= MOST_DIFFERENT
            yield batch.select(["a", "b"]).filter(pa.array(near))

    side = classes.select("node", "signature", "n_shingles").hint("merge")
    for end in ("a", "b"):
        pairs = pairs.join(side.select(F.col("node").alias(end), F.col("signature").alias(f"sig_{end}"), F.col("n_shingles").alias(f"n_{end}")), end)
    pairs = pairs.filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return pairs.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose full shingle sets are similar enough."""
    def hashed(batch, column):
        for row, stop, words in slices(batch.column(column)):
            present, first, hashes = _sets(words, size)
            yield from zip(row + present, np.split(hashes, first[1:]), strict=True)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                linked = np.zeros(part.num_rows, bool)
                for (i, one), (j, two) in zip(hashed(part, "text_a"), hashed(part, "text_b"), strict=True):
                    assert i == j
                    both = len(one) + len(two) - len(np.union1d(one, two))
                    linked[i] = 100 * both >= percent * (len(one) + len(two) - both)
                yield part.select(["a", "b"]).filter(pa.array(linked))

    texts = texts.hint("merge")
    for end in ("a", "b"):
        pairs = pairs.join(texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}")), end)
    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _tile_links(size: int, percent: int):
    """Links between a tile pair's classes of different components, one for each class and component."""
    def run(tile: pa.Table) -> pa.Table:
        data, at = text_buffers(tile.column("text").cast(pa.large_string()))
        sets = []
        for low in range(0, tile.num_rows, 256):
            words = split(data, at[low: low + 257])
            _, first, hashes = _sets(words, size)
            sets += np.split(hashes, first[1:])
        n = np.array([len(s) for s in sets])
        owner = np.repeat(np.arange(len(sets)), n)
        vocabulary, code = np.unique(np.concatenate(sets), return_inverse=True)
        order = np.argsort(code, kind="stable")
        posted = owner[order]
        bounds = np.searchsorted(code[order], np.arange(len(vocabulary) + 1))
        begin = np.concatenate([[0], np.cumsum(n)])
        component, side, nodes = (tile.column(c).to_numpy() for c in ("component", "tile", "node"))
        names, counts = np.unique(component, return_counts=True)
        largest = names[counts.argmax()]
        alone = tile.column("first")[0].as_py() == tile.column("second")[0].as_py()
        out: list[tuple[int, int]] = []
        for x in np.flatnonzero(component != largest):
            codes = code[begin[x]: begin[x + 1]]
            sizes = bounds[codes + 1] - bounds[codes]
            places = np.repeat(bounds[codes] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            shared = np.bincount(posted[places], minlength=len(sets))
            similar = (100 * shared >= percent * (n[x] + n - shared)) & (component != component[x])
            if not alone:
                similar &= side != side[x]
            found = np.flatnonzero(similar)
            _, one = np.unique(component[found], return_index=True)
            out += [(int(nodes[x]), int(nodes[y])) for y in found[one]]
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})
    return run


def _in_tiles(rows: DataFrame, classes: DataFrame, texts: DataFrame, size: int, percent: int, scratch: Scratch) -> DataFrame:
    """Links between classes of different components among (node, hub, component) rows of large keys."""
    groups = components(rows.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    members = rows.select("node", "component").distinct().join(groups.withColumnRenamed("component", "group"), "node").join(
        classes.select("node", "n_shingles"), "node",
    )
    members = scratch.save(members)
    tiles = members.groupBy("group").agg(
        F.ceil(F.greatest(F.count(F.lit(1)) / TILE, F.sum("n_shingles") / TILE_SHINGLES)).cast("int").alias("tiles"),
    )
    placed = members.join(tiles, "group").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    dealt = placed.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    dealt = dealt.select(
        "group", "node", "component", "tile", "text", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
    )
    return dealt.groupBy("group", "first", "second").applyInArrow(_tile_links(size, percent), "a long, b long")


def _own(text: Column) -> Column:
    """A row's id, or a stand-in above all ids that rows of the same text share."""
    return F.coalesce(F.col("doc_id").cast("long"), F.shiftrightunsigned(F.xxhash64(text), 2).bitwiseOR(F.lit(NO_ID)))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id.

    Texts are lower-cased (A-Z) and cut into words; a text of fewer than ``size``
    words has its whole sequence as one shingle. Two documents are linked when 100
    times their common shingles are at least ``percent`` times their joint ones;
    component_id is the smallest doc_id reachable over links. A text without words
    (or null) has no shingles, no links and itself as component. Rows that share a
    doc_id are one document; rows without one take part, and a component of
    such rows alone has a null id.
    """
    shown = F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id")
    return _components(docs, size, percent).select("doc_id", "n_shingles", shown)


def _components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """doc_id, own (the id or its stand-in), n_shingles and component (of the same kind as own) of every row."""
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-dedup")
    with batches_of(docs.sparkSession, BATCH_ROWS):
        text = text_or_empty()
        rows = docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"),
            _own(text).alias("own"),
        )
        signed = scratch.save(rows.mapInArrow(_signed(size), "doc_id long, own long, n_shingles long, set_key binary, signature binary"))
        classes = scratch.save(signed.filter("set_key is not null").groupBy("set_key").agg(
            F.min("own").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
        ))
        keyed = classes.select("node", "signature").mapInArrow(_index, "key long, node long")
        hubs = scratch.save(keyed.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub < last").select("key", "hub"))
        # Hinted joins go one way at every size; a hot key is split.
        shared = scratch.save(keyed.join(hubs.hint("merge"), "key").filter("node <> hub"))
        texts = rows.select(F.col("own").alias("node"), "text")

        def links(pairs: DataFrame) -> DataFrame:
            near = scratch.save(_similar_signatures(pairs.distinct(), classes, percent))
            ends = near.select(F.col("a").alias("node")).union(near.select("b")).distinct()
            return scratch.save(_confirmed(near, texts.join(ends.hint("merge"), "node"), size, percent))

        label = components(links(shared.select(F.col("node").alias("a"), F.col("hub").alias("b"))))
        # Of the hub, whose links are all tested, only the component matters.
        known = scratch.save(shared.join(label.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node")))
        scratch.drop(signed, classes, known)
        mixed = scratch.save(known.groupBy("key").agg(
            F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("left_over"),
        ).filter("low <> high").select("key", "left_over"))
        found = []
        if not mixed.isEmpty():
            rest = scratch.save(known.join(mixed, "key").select("key", "node", "hub", "component", "left_over"))
            few = rest.filter(F.col("left_over") <= FEW).select("key", "node", "component")
            other = few.select("key", F.col("node").alias("b"), F.col("component").alias("component_b"))
            pairs = few.join(other, "key").filter("node < b and component <> component_b").select(F.col("node").alias("a"), "b")
            found.append(links(pairs))
            large = rest.filter(F.col("left_over") > FEW).select("node", "hub", "component").distinct()
            if not large.isEmpty():
                found.append(scratch.save(_in_tiles(large, classes, texts, size, percent, scratch)))
        # An id with several texts ties their classes together.
        kind = F.xxhash64("set_key")
        several = scratch.save(signed.filter("set_key is not null").groupBy("own").agg(
            F.min(kind).alias("low"), F.max(kind).alias("high"),
        ).filter("low < high").select("own"))
        if not several.isEmpty():
            tied = signed.join(several, "own").select("own", "set_key").join(classes.select("set_key", "node"), "set_key")
            found.append(tied.select(F.col("own").alias("a"), F.col("node").alias("b")))
        classes = classes.select("set_key", "node").join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        if found:
            # Links between components, which are few next to those inside them.
            between = reduce(DataFrame.union, found)
            for end in ("a", "b"):
                up = label.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}"))
                between = between.join(up, end, "left").withColumn(f"component_{end}", F.coalesce(f"component_{end}", end))
            joined = components(between.select(F.col("component_a").alias("a"), F.col("component_b").alias("b")))
            up = joined.select(F.col("node").alias("component"), F.col("component").alias("joint"))
            classes = classes.join(up, "component", "left").withColumn("component", F.coalesce("joint", "component"))
        classes = scratch.save(classes.select("set_key", "component"))
    scratch.drop(signed, classes)
    labelled = signed.filter("set_key is not null").join(classes.hint("merge"), "set_key")
    without = signed.filter("set_key is null").select("doc_id", "own", "n_shingles", F.col("own").alias("component"))
    return labelled.select("doc_id", "own", "n_shingles", "component").unionByName(without)


def drop_near_copies(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose document is the smallest of its component.

    Rows without an id come after all others, by a hash of their text; those of
    one text stay or go together, as do rows that share an id.
    """
    scratch = Scratch(docs.sparkSession, "near-dedup")
    name = private("_gone", docs)
    found = _components(docs, size, percent)
    gone = scratch.save(found.filter("own <> component").select(F.col("own").alias(name)).distinct())
    side = small_or_joined(gone, BROADCAST_IDS)
    return docs.join(side, _own(text_or_empty()) == side[name], "left_anti")


def op3_near_dedup(spark, folder: str) -> DataFrame:
    found = near_duplicates(documents(spark, folder), size=4)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
