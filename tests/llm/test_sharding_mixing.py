import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash
from llm_reference import SMALL, nothing, odd, words  # noqa: F401

from pixelhour.llm import language_id, mixing, sharding
from pixelhour.llm.common import documents

TREE = sharding.Tree.regular(2, 2, 4)


def draw(key, tree):
    """The descent, child by child, with the hash function's own library."""
    node = ""
    while node in tree.children:
        def arrival(child):
            h = xxhash.xxh64_intdigest(sharding.SEED.to_bytes(4, "little"), 42)
            if key is not None:
                h = xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), h)
            h = xxhash.xxh64_intdigest(child[0].encode(), h)
            return -math.log(((h >> 11) + 0.5) * 2.0**-53) / child[1], child[0]
        node = min(arrival(c) for c in tree.children[node] if c[1] > 0)[1]
    return int(node)


def test_query_equals_brute_force(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in documents(spark, SMALL).collect()}
    rows = sharding.op1_sharding(spark, SMALL).collect()
    assert len(rows) == len(docs)
    slots = defaultdict(list)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 1, zlib.crc32(raw), "key")
        assert r["shard"] == draw(r["doc_id"], TREE)
        assert r["grown_shard"] == draw(r["doc_id"], TREE.grown())
        assert r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_weights_and_movement(spark):
    ids = spark.range(20_000).withColumnRenamed("id", "doc_id")

    def placed(tree):
        return dict(sharding.assign(ids, tree).collect())

    before, counts = placed(TREE), Counter(placed(TREE).values())
    assert set(counts) == set(range(16)) and max(counts.values()) < 1.2 * min(counts.values())
    heavier = placed(TREE.reweighted("5", 3.0))  # rack r0.1 has shards 4 to 7
    moved = {(before[i], heavier[i]) for i in before if before[i] != heavier[i]}
    assert moved and all(b == 5 and 4 <= a <= 7 for a, b in moved)
    gone = placed(TREE.reweighted("r1", 0.0))
    assert set(gone.values()) == set(range(8))
    assert all(gone[i] == before[i] for i in before if before[i] < 8)


def test_slots_of_odd_rows(spark, odd, nothing):
    placed = sharding.assign(odd, TREE)
    assert placed.columns == odd.columns  # its own shard column is replaced
    rows = sharding.number_slots(placed.select("doc_id", "text", "shard"), 16, 4).collect()
    assert len(rows) == odd.count()
    slots = defaultdict(list)
    for r in rows:
        assert r["shard"] == draw(r["doc_id"], TREE)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.number_slots(sharding.assign(nothing, TREE).select("doc_id", "shard"), 16).count() == 0


def test_targets():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    for sizes in ([100, 100, 100], [10, 1000, 1000, 5], [1, 1, 5000], [0, 7, 9]):
        got = mixing.targets(sizes)
        assert math.isclose(sum(got), 1.5 * sum(sizes))
        assert all(t <= 2 * s + 1e-9 for t, s in zip(got, sizes, strict=True))
        free = [(t, (3, 1, 2)[i % 3]) for i, (t, s) in enumerate(zip(got, sizes, strict=True)) if t < 2 * s - 1e-9]
        assert all(math.isclose(t / w, free[0][0] / free[0][1]) for t, w in free)


def test_permutations():
    for n in (1, 2, 3, 7, 64, 1000):
        for key in (0, 1, 99):
            out = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key))
            assert sorted(out.tolist()) == list(range(n))
    a, b = (mixing.permuted(np.arange(500), np.full(500, 500), np.full(500, k)) for k in (1, 2))
    assert (a != b).sum() > 400 and (a != np.arange(500)).sum() > 400


def test_query(spark):
    docs = {r["doc_id"]: r for r in documents(spark, SMALL).collect()}
    rows = mixing.op2_mixing(spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert r["size"] == len(words(docs[r["doc_id"]]["text"])) and 0 <= r["taken"] <= 2 * r["size"]
        source = docs[r["doc_id"]]["source"]
        sizes[source] += r["size"]
        taken[source] += r["taken"]
    order = sorted(sizes)
    target = dict(zip(order, mixing.targets([sizes[s] for s in order]), strict=True))
    for r in rows:
        source = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], target[source])
        assert abs(taken[source] - target[source]) <= 1


def test_every_use_once_and_runs_agree(spark, odd):
    docs = documents(spark, SMALL)
    one, two = (mixing.mix_sources(d, block=50, shards=5) for d in (docs, docs.repartition(7)))
    key = ["doc_id", "shard", "slot", "pass_no", "first_word", "n_words"]
    assert sorted(one.pieces.select(key).collect()) == sorted(two.pieces.select(key).collect())
    slots = mixing.slots(spark, one.plan).collect()
    assert len({(r["shard"], r["slot"]) for r in slots}) == len(slots) == one.plan.uses.sum()
    assert (one.plan.counts.sum(axis=1) == one.plan.uses).all()
    assert len({tuple(c) for c in one.plan.counts.T.tolist()}) > 1  # shards are drawn, not cut alike
    used = Counter((r["source_no"], r["block"], r["pass_no"]) for r in slots)
    assert set(used.values()) == {1}


def test_texts(spark, odd, nothing):
    mixed = mixing.mixed_texts(odd)
    assert mixed.schema == odd.schema
    rows = mixed.collect()
    texts = defaultdict(list)
    for r in odd.collect():
        texts[r["doc_id"]].append(r["text"] or "")
    total = sum(len(words(t)) for ts in texts.values() for t in ts)
    assert abs(sum(len(words(r["text"])) for r in rows) - 1.5 * total) <= 5
    for r in rows:
        assert any(r["text"] in t for t in texts[r["doc_id"]]) and r["n_chars"] == len(r["text"])
    made = mixing.mix_sources(nothing)
    assert made.pieces.count() == 0 and made.layout.count() == 0
    assert mixing.mixed_texts(nothing).count() == 0


def test_columns_named_like_the_operators_own(spark):
    """Private columns give way to those of the table."""
    names = ["_hash", "_pieces", "_taken_id", "_letters", "_row", "_scores", "_others", "given0"]
    rows = [(i, f"alpha beta gamma delta {i}", "en", "s", *[f"{n}-{i}" for n in names]) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, " + ", ".join(f"{n} string" for n in names))
    whole = {r["doc_id"]: r for r in df.collect()}
    mixed = mixing.mixed_texts(df).collect()
    assert mixed and all(r[n] == whole[r["doc_id"]][n] for r in mixed for n in names)
    found = language_id.predict(df, language_id.train(df))
    assert found.columns == [*df.columns, "lang_pred", "score"]
    assert {tuple(r)[:-2] for r in found.collect()} == {tuple(r) for r in whole.values()}
