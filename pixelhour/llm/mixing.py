"""Mixing sources to target weights with packed blocks.

The words of a source stand one document after another and are cut into blocks
of a fixed number of words (the last one shorter). A source's target becomes a
number of block uses; each output shard draws its blocks' sources by a
multinomial whose weights are what is left of each source, so that shards vary
and totals are met. The k-th use of a source is sent through a pseudorandom
permutation of its block numbers, a new one for every pass over the source, and
blocks meet documents in a join by (source, block). The last use of a source is
cut where its target is reached.

The recipe (one row per source and one number per source and shard) is made on
the driver; everything that grows with documents stays distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, private, saved, text_or_empty
from pixelhour.llm.words import mix, slices

WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
BLOCK = 128
SHARDS = 64
SEED = 20240131
#: A source is laid out in so many hashed pieces, so that no task needs a whole source.
PIECES = 512


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray, rounds: int = 4) -> np.ndarray:
    """``index`` (below ``n``) under a pseudorandom permutation of 0 … n-1 for each ``key``: a Feistel network
    on the next even number of bits, walked until it lands below ``n``."""
    index, n, key = (np.broadcast_to(np.asarray(x, np.uint64), np.shape(index)) for x in (index, n, key))
    bits = np.frexp(np.maximum(n, 2).astype(np.float64) - 1)[1]
    half = ((bits + 1) // 2).astype(np.uint64)
    out, todo = index.copy(), np.arange(len(index))
    while len(todo):
        h, k = half[todo], key[todo]
        mask = (np.uint64(1) << h) - np.uint64(1)
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(rounds):
            left, right = right, left ^ (mix(right + mix(k + np.uint64(r))) & mask)
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def targets(sizes: list[int], weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> list[float]:
    """Words wanted of each source (in their order): ``share`` of all words by weight, at most ``most`` times
    a source's own; what is cut off goes to the others by weight until none is above."""
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    full: dict[int, float] = {i: 0.0 for i, s in enumerate(sizes) if not s}
    while True:
        left = share * sum(sizes) - sum(full.values())
        free = [i for i in range(len(sizes)) if i not in full]
        total = sum(weight[i] for i in free)
        over = {i: most * sizes[i] for i in free if left * weight[i] / total > most * sizes[i]}
        if not over:
            return [full[i] if i in full else left * weight[i] / total for i in range(len(sizes))]
        full |= over


@dataclass(frozen=True)
class Recipe:
    sources: list
    size: np.ndarray
    target: np.ndarray
    words: np.ndarray  # words to take, whole
    blocks: np.ndarray
    uses: np.ndarray
    counts: np.ndarray  # uses by source and output shard
    block: int
    seed: int


def recipe(totals: list[tuple], weights=WEIGHTS, share=SHARE, most=MOST, block=BLOCK, shards=SHARDS, seed=SEED) -> Recipe:
    """``totals``: (source, words) of every source. Sources go by code point, null last."""
    totals = sorted(totals, key=lambda t: (t[0] is None, t[0] or ""))
    size = np.array([n for _, n in totals], np.int64)
    target = np.array(targets(size.tolist(), weights, share, most), np.float64)
    words = np.minimum(np.round(target), np.floor(most * size)).astype(np.int64)
    blocks = -(-size // block)
    passes = words // np.maximum(size, 1)
    uses = passes * blocks + -(-(words - passes * size) // block)
    draw, left = np.random.Generator(np.random.PCG64(seed)), uses.copy()
    counts = np.zeros((len(totals), shards), np.int64)
    for k in range(shards):
        room = int(left.sum()) // (shards - k)
        while room:
            got = np.minimum(draw.multinomial(room, left / left.sum()), left)
            counts[:, k] += got
            left -= got
            room -= int(got.sum())
    return Recipe([s for s, _ in totals], size, target, words, blocks, uses, counts, block, seed)


def slots(spark, plan: Recipe) -> DataFrame:
    """Every use of a block: source_no, block, use_words, pass_no, shard, slot (its place in the shard)."""
    first = np.concatenate([[0], np.cumsum(plan.uses)])
    by_shard = np.concatenate([np.zeros((len(plan.uses), 1), np.int64), np.cumsum(plan.counts, axis=1)], axis=1)
    in_shard = np.cumsum(plan.counts, axis=0) - plan.counts  # of a source's first block in each shard

    def uses(batches):
        for batch in batches:
            g = batch.column(0).to_numpy()
            source = np.searchsorted(first, g, "right") - 1
            j = g - first[source]
            shard = np.zeros(len(g), np.int64)
            for s in np.unique(source):
                shard[source == s] = np.searchsorted(by_shard[s], j[source == s], "right") - 1
            blocks = plan.blocks[source]
            turn, i = j // blocks, j % blocks
            key = mix(np.uint64(plan.seed) + (source.astype(np.uint64) << np.uint64(32)) + turn.astype(np.uint64))
            tail = i == blocks - 1  # the short block ends its pass
            number = np.where(tail, i, permuted(np.minimum(i, np.maximum(blocks - 2, 0)), np.maximum(blocks - 1, 1), key))
            words = np.minimum(plan.block, plan.size[source] - number * plan.block)
            done = turn * plan.size[source] + i * plan.block
            words = np.minimum(words, plan.words[source] - done)
            slot = in_shard[source, shard] + j - by_shard[source, shard]
            room = plan.counts.sum(axis=0)[shard]
            slot = permuted(slot, room, mix(np.uint64(plan.seed + 1) + shard.astype(np.uint64)))
            yield pa.record_batch(
                [pa.array(x) for x in (source.astype(np.int32), number, words, turn, shard.astype(np.int32), slot)],
                ["source_no", "block", "use_words", "pass_no", "shard", "slot"],
            )

    return spark.range(int(first[-1])).mapInArrow(uses, "source_no int, block long, use_words long, pass_no long, shard int, slot long")


@dataclass(frozen=True)
class Mix:
    """``layout``: a row for each document (source_no, at: its first word's place in its source, doc_id,
    size, text_hash). ``pieces``: what each block use takes of each document (source_no, at, doc_id,
    text_hash, shard, slot, pass_no, first_word, n_words)."""

    plan: Recipe
    layout: DataFrame
    pieces: DataFrame


def mix_sources(docs: DataFrame, text: str = "text", **options) -> Mix:
    """Mix all rows of ``docs`` by ``source``.

    The size of a text is its number of words (null and empty: 0; such rows are
    never taken). Null is a source like any other. Repeated rows are rows of
    their own. The same documents give the same mix however they are
    partitioned. Without any words nothing is taken.
    """
    spark = docs.sparkSession
    whole = text_or_empty(text)
    sized = saved(docs.select(
        "doc_id", "source", F.regexp_count(whole, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("size"),
        F.xxhash64(whole).alias("text_hash"),
    ))
    totals = [(r[0], r[1]) for r in sized.groupBy("source").agg(F.sum("size")).collect()]
    plan = recipe(totals, **options)
    names = spark.createDataFrame([(s, i) for i, s in enumerate(plan.sources)], "source string, source_no int")
    rows = sized.join(F.broadcast(names), sized["source"].eqNullSafe(names["source"]), "inner").select(
        "source_no", "doc_id", "size", "text_hash",
        F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(PIECES)).cast("int").alias("piece"),
    )
    before = Window.partitionBy("source_no").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("source_no", "piece").agg(F.sum("size").alias("n")).select(
        "source_no", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
    )
    within = Window.partitionBy("source_no", "piece").orderBy("doc_id", "text_hash", "size").rowsBetween(Window.unboundedPreceding, -1)
    layout = saved(
        rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_no", "piece"])
        .select("source_no", (F.col("start") + F.col("inner")).alias("at"), "doc_id", "size", "text_hash")
    )
    block, end = F.lit(plan.block), F.col("at") + F.col("size")
    parts = layout.filter("size > 0").withColumn("block", F.explode(F.sequence(
        F.floor(F.col("at") / block).cast("long"), F.floor((end - 1) / block).cast("long"),
    )))
    low = F.greatest("at", F.col("block") * block)
    high = F.least(end, F.col("block") * block + F.col("use_words"))
    pieces = parts.join(slots(spark, plan), ["source_no", "block"]).select(
        "source_no", "at", "doc_id", "text_hash", "shard", "slot", "pass_no",
        (low - F.col("at")).alias("first_word"), (high - low).alias("n_words"),
    ).filter("n_words > 0")
    return Mix(plan, layout, pieces)


def mixed_texts(docs: DataFrame, text: str = "text", **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: for each pass over a source, the taken runs of each document.

    A run's text reaches from its first word to its last; a document taken whole
    keeps its text as it is. ``n_chars``, where present, is the run's. Rows
    alike in doc_id and text share their other columns.
    """
    made = mix_sources(docs, text, **options)
    taken, its_id, its_hash, own_hash = (private(name, docs) for name in ("_pieces", "_taken_id", "_taken_hash", "_hash"))
    runs = made.pieces.groupBy("doc_id", "text_hash", "source_no", "at", "pass_no").agg(
        F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias(taken),
    ).select(F.col("doc_id").alias(its_id), F.col("text_hash").alias(its_hash), taken)
    texts = docs.withColumn(own_hash, F.xxhash64(text_or_empty(text))).dropDuplicates(["doc_id", own_hash])
    joined = texts.join(runs, texts["doc_id"].eqNullSafe(runs[its_id]) & (texts[own_hash] == runs[its_hash]))
    columns = docs.columns
    where = columns.index(text)

    def cut(batches):
        for batch in batches:
            picked, texts = [], []
            pieces = batch.column(taken).to_pylist()
            for row, stop, words in slices(batch.column(text), lower=False):
                for i in range(row, stop):
                    first, last = words.first[i - row], words.first[i - row + 1]
                    begin = upto = None
                    for p in [*pieces[i], {"first_word": -1, "n_words": 0}]:
                        if begin is not None and p["first_word"] == upto:
                            upto += p["n_words"]
                            continue
                        if begin is not None:
                            picked.append(i)
                            if begin == 0 and upto == last - first:
                                texts.append(batch.column(text)[i].as_py())
                            else:
                                a, b = words.start[first + begin], words.start[first + upto - 1] + words.length[first + upto - 1]
                                texts.append(words.data[a:b].tobytes().decode())
                        begin, upto = p["first_word"], p["first_word"] + p["n_words"]
            out = batch.select(columns).take(pa.array(picked, pa.int64()))
            arrays = list(out.columns)
            arrays[where] = pa.array(texts, out.schema.field(where).type)
            if "n_chars" in columns:
                arrays[columns.index("n_chars")] = pa.array(map(len, texts), out.schema.field(columns.index("n_chars")).type)
            yield pa.record_batch(arrays, schema=out.schema)

    return joined.select(*columns, taken).mapInArrow(cut, docs.schema)


def op2_mixing(spark, folder: str) -> DataFrame:
    made = mix_sources(documents(spark, folder))
    plan = made.plan
    taken = made.pieces.groupBy("source_no", "at").agg(F.sum("n_words").alias("taken"))
    rows = made.layout.filter("size > 0").join(taken, ["source_no", "at"], "left").select(
        "doc_id", "size", "source_no", F.coalesce("taken", F.lit(0)).alias("taken"),
    ).unionByName(made.layout.filter("size = 0").select("doc_id", "size", "source_no", F.lit(0).cast("long").alias("taken")))
    facts = spark.createDataFrame(
        [(i, int(s), float(t)) for i, (s, t) in enumerate(zip(plan.size, plan.target, strict=True))],
        "source_no int, source_size long, target double",
    )
    return rows.join(F.broadcast(facts), "source_no").select("doc_id", "size", "source_size", "target", "taken")
