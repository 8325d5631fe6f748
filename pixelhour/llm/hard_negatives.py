"""Hard negatives: rows of another label that score just below an anchor's own positives, from exact products.

Components become integers, so a score is an integer inner product. Several
candidates are packed into one wide number a component: their components, biased
to be at least 0, stand in separate bit fields, each wide enough for the whole
sum. One multiplication by the (biased) anchor component then serves all of them;
the fields of the summed products are taken apart and the bias subtracted. The
wide number is a double while the fields fit its 53 exact bits, so the products
are one matrix multiplication; larger components use Python's integers, with more
candidates in each. Both are exact.

Anchors and candidates are dealt to a grid of cells of bounded size. A cell keeps
the best few of each of its anchors, which are merged by a ranking that Spark
limits before the shuffle. A first grid finds the positives, a second one the
negatives in the range that each positive's score sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pixelhour.llm.common import saved, ship

#: Exact bits of a double; bits of one of Python's wide integers.
DOUBLE_BITS, WIDE_BITS = 53, 4096
#: Components of the candidates, and of the anchors, of a cell (rows: by the longest vector).
CELL_CANDIDATES, CELL_ANCHORS = 1 << 22, 1 << 17
#: Products held at once.
PRODUCTS = 1 << 22
LEAST, MOST = 1 - (1 << 63), (1 << 63) - 1


def _biased(ints: np.ndarray) -> tuple[np.ndarray, int]:
    bias = min(int(ints.min()), 0)
    return ints - bias, bias


def packed_products(anchors: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Inner products (anchors x candidates) of rows of whole numbers, as int64; beyond a long they stay at its end.

    Whole numbers come as float64 below 2**51, or as Python integers.
    """
    m, (n, d) = len(anchors), candidates.shape
    if not m or not n or not d:
        return np.zeros((m, n), np.int64)
    (v, low_a), (u, low_c) = _biased(anchors), _biased(candidates)
    top = d * int(v.max()) * int(u.max())
    width = max(1, top.bit_length())
    sizes = [max(abs(int(x.min())), abs(int(x.max()))) for x in (anchors, candidates)]
    wide = width > DOUBLE_BITS or 8 * d * sizes[0] * sizes[1] > MOST
    fields = max(1, (WIDE_BITS if wide else DOUBLE_BITS) // width)
    if wide:
        u, v = np.vectorize(int, otypes=[object])(u), np.vectorize(int, otypes=[object])(v)
    lanes = -(-n // fields)
    packed = np.zeros((lanes, d), u.dtype)
    for f in range(fields):
        part = u[f * lanes: (f + 1) * lanes]
        packed[: len(part)] += part * ((1 << (width * f)) if wide else float(1 << (width * f)))
    products = v.dot(packed.T)
    out = np.empty((m, fields * lanes), object if wide else np.int64)
    left = products if wide else products.astype(np.int64)
    for f in range(fields):
        out[:, f * lanes: (f + 1) * lanes] = left & ((1 << width) - 1)
        left = left >> width
    # (v + low_a)(u + low_c) summed: what the bias added goes again.
    number = (lambda x: x) if wide else (lambda x: x.astype(np.int64))
    out = out[:, :n] + low_c * number(v.sum(axis=1))[:, None] + low_a * number(u.sum(axis=1))[None, :] + d * low_a * low_c
    return np.clip(out, LEAST, MOST).astype(np.int64) if wide else out


def whole_numbers(column: pa.Array, scale: float) -> np.ndarray:
    """floor(scale * x) of vectors of one length: float64 if exact there, else Python integers."""
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    with np.errstate(over="ignore"):
        scaled = np.floor(x * scale)
    if not x.size or np.abs(scaled).max() < 1 << (DOUBLE_BITS - 2):
        return scaled
    exact = [int(s) if np.isfinite(s) else int(y) * int(scale) for s, y in zip(scaled.ravel(), x.ravel(), strict=True)]
    return np.array(exact, object).reshape(x.shape)


def _first(scores: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` by falling score, then rising id."""
    if len(scores) > most:
        bar = np.partition(scores, len(scores) - most)[len(scores) - most]
        places = np.flatnonzero(scores >= bar)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))][:most]


def _ids(column: pa.Array) -> np.ndarray:
    """Ids for ordering: a missing one comes after all others."""
    return column.fill_null(MOST).to_numpy(zero_copy_only=False)


class _Side:
    def __init__(self, table: pa.Table, scale: float) -> None:
        table = table.combine_chunks()
        self.row, self.label = (table.column(c).to_numpy() for c in ("row", "label"))
        self.id = _ids(table.column("vec_id"))
        self.ints = whole_numbers(table.column("embedding"), scale)
        self.table = table


def _parts(anchors: np.ndarray, candidates: np.ndarray):
    """(anchor places, candidate places) so that no part has more than ``PRODUCTS`` products."""
    for a in range(0, len(anchors), 256):
        some = anchors[a: a + 256]
        step = max(1, PRODUCTS // len(some))
        for c in range(0, len(candidates), step):
            yield some, candidates[c: c + step]


def _merged(best: dict, key, scores: np.ndarray, ids: np.ndarray, most: int) -> None:
    if key in best:
        scores, ids = np.concatenate([best[key][0], scores]), np.concatenate([best[key][1], ids])
    keep = _first(scores, ids, most)
    best[key] = scores[keep], ids[keep]


def _positives(most: int, scale: float):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[int, tuple] = {}
        if left.num_rows and right.num_rows:
            anchors, others = _Side(left, scale), _Side(right, scale)
            for label in np.unique(anchors.label):
                own, alike = np.flatnonzero(anchors.label == label), np.flatnonzero(others.label == label)
                for some, part in _parts(own, alike):
                    scores = packed_products(anchors.ints[some], others.ints[part])
                    for i, a in enumerate(some.tolist()):
                        other = others.row[part] != anchors.row[a]
                        _merged(best, a, scores[i][other], others.id[part][other], most)
        at = [a for a, (s, _) in best.items() for _ in s]
        return pa.table({
            "row": left.column("row").combine_chunks().take(pa.array(at, pa.int64())),
            "score": pa.array(np.concatenate([s for s, _ in best.values()] or [np.zeros(0, np.int64)])),
            "id": pa.array(np.concatenate([i for _, i in best.values()] or [np.zeros(0, np.int64)])),
        })
    return run


def _negatives(most: int, low: int, high: int, scale: float):
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        best: dict[tuple[int, int], tuple] = {}
        if left.num_rows and right.num_rows:
            anchors, others = _Side(left, scale), _Side(right, scale)
            # Distinct scores of an anchor's positives, each with the range it allows.
            ranges = [[(p, -(-low * p // 100), high * p // 100) for p in sorted(set(s))] for s in anchors.table.column("positives").to_pylist()]
            for label in np.unique(anchors.label):
                own, unlike = np.flatnonzero(anchors.label == label), np.flatnonzero(others.label != label)
                for some, part in _parts(own, unlike):
                    scores = packed_products(anchors.ints[some], others.ints[part])
                    ids = others.id[part]
                    for i, a in enumerate(some.tolist()):
                        for score, least, greatest in ranges[a]:
                            known = best.get((a, score))
                            if known is not None and len(known[0]) == most:
                                least = max(least, int(known[0][-1]))
                            if least <= greatest:
                                fits = np.flatnonzero((scores[i] >= least) & (scores[i] <= greatest))
                                if len(fits):
                                    _merged(best, (a, score), scores[i][fits], ids[fits], most)
        keys = [(a, p) for (a, p), (s, _) in best.items() for _ in s]
        return pa.table({
            "row": left.column("row").combine_chunks().take(pa.array([a for a, _ in keys], pa.int64())),
            "positive_score": pa.array([p for _, p in keys], pa.int64()),
            "score": pa.array(np.concatenate([s for s, _ in best.values()] or [np.zeros(0, np.int64)])),
            "id": pa.array(np.concatenate([i for _, i in best.values()] or [np.zeros(0, np.int64)])),
        })
    return run


def _ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def _id(column: str) -> Column:
    return F.when(F.col(column) < MOST, F.col(column))


def mine(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0,
) -> DataFrame:
    """For each anchor and each of its positives, the negatives whose scores lie in the positive's range, best first.

    ``vectors`` has vec_id, embedding (an array of numbers) and label. Rows with a
    null label, vector or component, or one that is not finite, take no part.
    Components become floor(scale * x); a score is the integer inner product of two
    vectors of one length (others are never compared), kept within a long. Rows are
    told apart as rows, so a repeated vec_id is no loss; a missing one comes last
    among equal scores. Positives are the first ``positives`` other rows of the
    anchor's label, negatives the first ``negatives`` of other labels with
    low * positive score <= 100 * score <= high * positive score. Returns anchor_id,
    positive_id, rank, negative_id, positive_score, negative_score; an empty table
    gives no row. ``scale`` is a whole number.
    """
    ship(vectors.sparkSession)
    vector = F.col("embedding")
    usable = F.col("label").isNotNull() & vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    rows = saved(vectors.filter(usable).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        vector.cast("array<double>").alias("embedding"), F.size(vector).alias("length"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    ))
    # One row a length; anchors and candidates of a length get as many cells as they need.
    sizes = rows.groupBy("length").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("anchor").cast("long")).alias("anchors"))
    grid = sizes.select(
        "length", *[F.ceil(F.col(n) * F.greatest("length", F.lit(1)) / F.lit(room)).cast("int").alias(parts)
                    for n, room, parts in (("n", CELL_CANDIDATES, "slabs"), ("anchors", CELL_ANCHORS, "blocks"))],
    ).filter("blocks > 0")
    # A vector's components are told from its length, so lengths are few; the join is left to Spark.
    dealt = rows.join(grid, "length").withColumn("hash", F.xxhash64("row"))
    narrow = ["length", "row", "vec_id", "label", "embedding"]
    anchors = dealt.filter("anchor").withColumn("block", F.pmod("hash", "blocks").cast("int")).withColumn("slab", F.explode(F.sequence(F.lit(0), F.col("slabs") - 1)))
    others = dealt.withColumn("slab", F.pmod("hash", "slabs").cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "block", "slab", *narrow,
    )
    cell = ["length", "block", "slab"]
    cells = others.groupBy(*cell)
    # Columns of their own, so that the two sides of a cell are told apart.
    anchors = anchors.select(*[F.col(c).alias(c) for c in ("block", "slab", *narrow)])
    near = anchors.groupBy(*cell).cogroup(cells).applyInArrow(_positives(positives, scale), "row long, score long, id long")
    kept = saved(_ranked(near, ["row"], positives))
    wanted = kept.groupBy("row").agg(F.collect_set("score").alias("positives"))
    with_scores = anchors.join(wanted, "row")
    below = with_scores.groupBy(*cell).cogroup(cells).applyInArrow(
        _negatives(negatives, low, high, scale), "row long, positive_score long, score long, id long",
    )
    best = _ranked(below, ["row", "positive_score"], negatives)
    named = kept.join(rows.select("row", F.col("vec_id").alias("anchor_id")), "row").select(
        "row", "anchor_id", _id("id").alias("positive_id"), F.col("score").alias("positive_score"),
    )
    return named.join(best, ["row", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", _id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
    )


def op13_hard_negatives(spark, folder: str) -> DataFrame:
    vectors = spark.read.parquet(f"{folder}/embeddings.parquet")
    moved = vectors.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(moved, F.col("vec_id") % 100 == 0)


OP13_SQL = """
WITH moved AS (
  SELECT row_number() OVER () AS row_no, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS ints
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.row_no AS anchor, a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS alike, a.row_no = c.row_no AS same,
    list_inner_product(a.ints, c.ints)::BIGINT AS score
  FROM moved a JOIN moved c ON a.vec_id % 100 = 0 AND len(a.ints) = len(c.ints)),
positives AS (
  SELECT * FROM scored WHERE alike AND NOT same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor, p.vec_id ORDER BY s.score DESC, s.vec_id) AS n
  FROM positives p JOIN scored s ON p.anchor = s.anchor AND NOT s.alike
    AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, n::INTEGER AS rank, negative_id, positive_score, negative_score FROM ranked WHERE n <= 10
"""
