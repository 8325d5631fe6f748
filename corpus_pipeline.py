"""From raw documents to token digests: keep good documents, drop copies and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it
returned. All but the last return the columns of ``documents``:

* ``quality``: rows that score below the classifier's threshold go; it learns
  from the labelled rows among its own input.
* ``exact_dedup``: of identical texts the row with the largest id stays.
* ``near_dedup``: of each component of near copies the smallest id stays.
* ``mixing``: a row for each run of words that a pass over a source takes of a
  document, with its text; a document taken whole keeps its text as it is.
* ``byte_bpe``: for each row doc_id, n_tokens, ids_sha256 and decoded_sha256.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from pixelhour.llm import byte_bpe, exact_dedup, mixing, near_dedup, quality
from pixelhour.llm.common import documents, ship, written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality.drop_low_quality(spark, docs, sf_dir)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return mixing.mixed_texts(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return byte_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", keep_good),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix),
    ("byte_bpe", encode),
]

#: SQL has no classifier, signatures, permutations or merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
    return docs
