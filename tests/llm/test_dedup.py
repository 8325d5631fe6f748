import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_reference import SMALL, components, nothing, odd, shingle_set  # noqa: F401

from pixelhour.llm import exact_dedup, graph, near_dedup, registry
from pixelhour.llm.common import documents
from pixelhour.llm.words import SLICE_BITS, distinct, shingles, slices
from verification import compare


def test_exact_copies(spark, odd):
    got = exact_dedup.mark_copies(odd.select("doc_id", "text", "kept")).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        groups[r["text"] or ""].append(r["doc_id"])
    assert len(got) == odd.count()
    for r in got:
        ids = groups[r["text"] or ""]
        known = [i for i in ids if i is not None]
        assert r["group_size"] == len(ids)
        assert r["keep_id"] == (max(known) if known else None)
        assert r["kept"] == (r["doc_id"] == r["keep_id"])


def test_exact_empty_and_columns(nothing, odd):
    assert exact_dedup.drop_copies(nothing).columns == nothing.columns
    assert exact_dedup.mark_copies(nothing).count() == 0


def test_exact_same_length_and_prefix(spark):
    texts = ["x" * 100 + "a", "x" * 100 + "b", "x" * 100 + "a", "y" * 101, "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.mark_copies(df).collect()}
    assert got == {0: (2, 2), 1: (1, 1), 2: (2, 2), 3: (3, 1), 4: (4, 1)}


@pytest.mark.parametrize("bits", [1 << 15, 1 << 27])
def test_exact_filter_of_any_size(spark, monkeypatch, bits):
    """A bitmap too small for the keys lets more rows through, and changes nothing else."""
    monkeypatch.setattr(exact_dedup, "FILTER_BITS", bits)
    draw = random.Random(bits)
    rows = [(i, draw.choice("ab") * draw.randrange(1, 70) + draw.choice(["", "x", "y"])) for i in range(800)]
    groups = defaultdict(list)
    for i, text in rows:
        groups[text].append(i)
    got = exact_dedup.mark_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: (max(groups[t]), len(groups[t])) for i, t in rows}


def test_exact_texts_are_not_shuffled(spark):
    """Only hashes, lengths and ids meet in the query's exchanges."""
    plan = exact_dedup.op4_exact_dedup(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.split("Join LeftOuter, (full")[1].splitlines()[1]  # the hashed rows' columns
    assert "AS full" in joined and not re.search(r"[\[ ](whole|given1)#\d+[,\]]| AS given1#", joined), joined


def test_exact_one_row_of_each_text_stays(spark):
    """Many copies of a text, ids missing or repeated, and columns named like the operator's own."""
    rows = [(7 if i % 2 else None, "same", i % 3, "f") for i in range(2000)] + [(None, "none", 1, "f")] * 5 + [(1, None, 2, "f"), (2, "", 3, "g")]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int, full string").withColumn("_length", F.lit("mine"))
    kept = exact_dedup.drop_copies(df)
    assert kept.columns == df.columns
    got = sorted((r["doc_id"] or 0, r["text"], r["_length"], r["full"]) for r in kept.collect())
    assert got == [(0, "none", "mine", "f"), (2, "", "mine", "g"), (7, "same", "mine", "f")]
    assert kept.collect() == exact_dedup.drop_copies(df.repartition(5)).collect() or len(got) == 3


def test_exact_native(spark):
    plan = exact_dedup.op4_exact_dedup(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian"))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_sql(spark, name):
    verdict, _ = compare.check(spark, compare.connect(SMALL), SMALL, name, registry.QUERIES[name], registry.SQL[name])
    assert verdict.startswith("ok"), verdict


def test_shingles_are_sets():
    texts = [None, "", "One two", "a b c d e", "a b c d a b c d", "x " * 50]
    column = pa.array(texts, pa.string())
    (_, _, words), = slices(column)
    owner, hashes = distinct(*shingles(words, 4))
    assert np.bincount(owner, minlength=len(texts)).tolist() == [len(shingle_set(t, 4)) for t in texts]
    assert hashes.max() < 1 << (64 - SLICE_BITS)


def test_near_query_equals_brute_force(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark, SMALL).select("doc_id", "text").collect()]
    expected = components(docs, 4)
    got = near_dedup.op3_near_dedup(spark, SMALL).collect()
    assert len(got) == len(docs)
    text = dict(docs)
    for r in got:
        assert r["component_id"] == expected[r["doc_id"]]
        assert r["n_shingles"] == len(shingle_set(text[r["doc_id"]], 4))
        assert r["kept"] == (r["doc_id"] == r["component_id"])


def test_near_odd_rows(spark, odd, nothing):
    got = near_dedup.near_duplicates(odd).collect()
    expected = components([(r["doc_id"], r["text"]) for r in odd.collect() if r["doc_id"] is not None], 5)
    assert len(got) == odd.count()
    for r in got:
        assert r["component_id"] == expected.get(r["doc_id"])
    assert near_dedup.near_duplicates(nothing).count() == 0
    kept = near_dedup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert {r["doc_id"] for r in kept.collect()} == {None, *(i for i, c in expected.items() if i == c)}


def test_near_groups_of_every_kind(spark, monkeypatch):
    """Chains of edits, a common passage and a group of copies, with tiles and few-class keys forced to be small."""
    monkeypatch.setattr(near_dedup, "FEW", 3)
    monkeypatch.setattr(near_dedup, "TILE", 12)
    draw = random.Random(5)
    word = lambda: "".join(draw.choices("abcdefghij", k=5))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = [" ".join(base)] * 4
    for _ in range(60):  # edits around the threshold
        w = list(base)
        for at in draw.sample(range(120), draw.randint(1, 6)):
            w[at] = word()
        texts.append(" ".join(w))
    texts += [" ".join([word() for _ in range(60)] + passage) for _ in range(40)]
    texts += [" ".join(passage + [word() for _ in range(k)]) for k in range(30)]
    chain = [word() for _ in range(100)]
    for _ in range(20):
        chain = [*chain[4:], *[word() for _ in range(4)]]
        texts.append(" ".join(chain))
    docs = list(enumerate(texts))
    draw.shuffle(docs)
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components(docs, 5)


def test_chunk_within_one_error_shares_a_key():
    """The pigeonhole guarantee of the index."""
    draw = np.random.default_rng(3)
    places = near_dedup.CHUNKS * near_dedup.WIDTH  # those after it are not indexed
    for _ in range(50):
        one = draw.integers(0, 256, near_dedup.PLACES, dtype=np.uint8)
        two = one.copy()
        wrong = draw.choice(places, 2 * near_dedup.CHUNKS - 1, replace=False)
        two[wrong] ^= draw.integers(1, 256, len(wrong), dtype=np.uint8)
        batch = pa.record_batch([pa.array([1, 2]), pa.array([one.tobytes(), two.tobytes()])], ["node", "signature"])
        (found,) = near_dedup._index([batch])
        keys = [set(), set()]
        for key, node in zip(*(c.to_pylist() for c in found.columns), strict=True):
            keys[node - 1].add(key)
        assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (7, 7), (102, 100)]
    got = dict(graph.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_digest_of_query(spark):
    rows = exact_dedup.op4_exact_dedup(spark, SMALL).collect()
    text = {r["doc_id"]: r["text"] or "" for r in documents(spark, SMALL).collect()}
    sizes = Counter(text.values())
    for r in rows:
        assert r["text_sha256"] == hashlib.sha256(text[r["doc_id"]].encode()).hexdigest()
        assert r["group_size"] == sizes[text[r["doc_id"]]]
