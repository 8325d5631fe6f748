import hashlib
from collections import Counter

import public_tokenizers
import pytest
import tiktoken
from llm_reference import SMALL, components, nothing, odd, words  # noqa: F401

import corpus_pipeline
from pixelhour.llm import byte_bpe, mixing
from pixelhour.llm.common import documents, written


@pytest.fixture(scope="module")
def stages(spark):
    """The rows before the first stage and after each."""
    out = [("documents", documents(spark, SMALL))]
    for name, stage in corpus_pipeline.STAGES:
        out.append((name, written(stage(spark, out[-1][1], SMALL), f"test-{name}")))
    return [(name, df.columns, df.collect()) for name, df in out]


def test_columns(stages):
    assert [name for name, *_ in stages[1:]] == ["quality", "exact_dedup", "near_dedup", "mixing", "byte_bpe"]
    assert all(columns == stages[0][1] for _, columns, _ in stages[1:5])


def test_quality_goes_by_labels(spark, stages):
    kept = {r["doc_id"] for r in stages[1][2]}
    labels = [(r["doc_id"] in kept, r["quality"]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()]
    assert sum(k == q for k, q in labels) / len(labels) > 0.9
    assert set(stages[1][2]) <= set(stages[0][2])


def test_exact_copies_go(stages):
    best = {}
    for r in stages[1][2]:
        best[r["text"]] = max(best.get(r["text"], r), r, key=lambda x: x["doc_id"])
    assert sorted(stages[2][2]) == sorted(best.values())


def test_near_copies_go(stages):
    component = components([(r["doc_id"], r["text"]) for r in stages[2][2]], 5)
    assert sorted(stages[3][2]) == sorted(r for r in stages[2][2] if component[r["doc_id"]] == r["doc_id"])


def test_mix_meets_targets(stages):
    whole = {r["doc_id"]: r for r in stages[3][2]}
    sizes, taken = Counter(), Counter()
    for r in stages[3][2]:
        sizes[r["source"]] += len(words(r["text"]))
    for r in stages[4][2]:
        taken[r["source"]] += len(words(r["text"]))
        from_doc = whole[r["doc_id"]]
        assert r["text"] in from_doc["text"] and (r["lang"], r["source"]) == (from_doc["lang"], from_doc["source"])
        assert r["n_chars"] == len(r["text"])
    order = sorted(sizes)
    for source, target in zip(order, mixing.targets([sizes[s] for s in order]), strict=True):
        assert abs(taken[source] - target) <= 1


def test_digests_equal_the_library(stages):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter()
    for r in stages[4][2]:
        ids = library.encode_ordinary(r["text"])
        want[r["doc_id"], len(ids), sha(" ".join(map(str, ids)).encode()), sha(r["text"].encode())] += 1
    assert Counter(tuple(r) for r in stages[5][2]) == want


def test_run_chains_the_stages(spark, stages):
    assert sorted(corpus_pipeline.run(spark, SMALL).collect()) == sorted(stages[5][2])


def test_odd_rows(spark, odd, nothing):
    for given in (odd, nothing):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            docs = written(stage(spark, docs, SMALL), f"odd-{name}")
            if name != "byte_bpe":
                assert docs.columns == given.columns
        assert docs.count() > 0 or given is nothing
