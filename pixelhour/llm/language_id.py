"""Language identification, word first, backing off to shorter and shorter character n-grams.

Training counts all words and the character n-grams of words (with marks at their
ends) by language over all training texts; counts are combined on the executors
and stay there, keyed by 64-bit hashes. A word met in training adds its log share
in each language; any other word is judged by its longest n-grams, of four
characters if any is known, else of three, two or one. The language with the
largest sum wins.

The ``WORDS`` and ``GRAMS`` most frequent ones are broadcast as a cache. What the
cache does not have is scored the same way by joins with the whole tables, so its
size changes no result but for the order in which numbers are added.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, fetched, most_frequent, remainder, written
from pixelhour.llm.words import Words, mix, slices

WORDS = 1 << 18
GRAMS = 1 << 18
#: Either cache has at most so many numbers: with more languages, fewer items.
CACHED_NUMBERS = 1 << 23
LONGEST = 4
SMOOTHING = 0.5
#: More languages than this make the tables wider than a row should be.
MOST_LANGUAGES = 400


def _some(words: Words, pick: np.ndarray) -> Words:
    return Words(words.data, words.start[pick], words.length[pick], np.array([0, len(pick)]))


class Characters:
    """The characters of words, from which n-grams are made."""

    def __init__(self, words: Words):
        starts = np.flatnonzero((words.data & 0xC0) != 0x80)
        ends = np.append(starts[1:], len(words.data))
        padded = np.concatenate([words.data, np.zeros(4, np.uint8)])
        four = np.ndarray((len(words.data) + 1,), "<u4", padded, 0, (1,))
        mask = np.array([(1 << (8 * n)) - 1 for n in range(5)], np.uint64)
        self.codes = four[starts].astype(np.uint64) & mask[np.minimum(ends - starts, 4)]
        self.first = np.searchsorted(starts, words.start)
        self.length = np.searchsorted(starts, words.start + words.length) - self.first

    def grams(self, n: int, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``pick``, hash) of each run of ``n`` characters of the picked words between end marks."""
        first, length = self.first[pick], self.length[pick]
        per = np.maximum(length + 2 - n + 1, 0)
        owner = np.repeat(np.arange(len(per)), per)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(per) - per, per) - 1  # -1 is the mark before the word
        out = np.full(len(owner), n, np.uint64)
        for j in range(n):
            place = at + j
            inside = (place >= 0) & (place < length[owner])
            code = self.codes[np.where(inside, first[owner] + place, 0)] if len(self.codes) else np.zeros(len(owner), np.uint64)
            out = out * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, code + np.uint64(1), np.uint64(0))
        return owner, mix(out)


def _summed(keys: list[np.ndarray], codes: list[np.ndarray], numbers: list[np.ndarray]):
    """Equal (key, code) pairs with their numbers added up."""
    key, code, number = (np.concatenate(x) for x in (keys, codes, numbers))
    order = np.lexsort((code, key))
    key, code, number = key[order], code[order], number[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (code[1:] != code[:-1])])) if len(key) else np.zeros(0, np.int64)
    return key[first], code[first], np.add.reduceat(number, first) if len(first) else number


def _counted(languages: list[str]):
    """Rows (kind, item, lang, n): kind 0 has words, kinds 1 to LONGEST n-grams, by hash; lang is a place in ``languages``."""
    place = {name: i for i, name in enumerate(languages)}

    def run(batches):
        for batch in batches:
            code = np.array([place.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            found = [([], [], []) for _ in range(LONGEST + 1)]
            for row, stop, words in slices(batch.column("text")):
                if not len(words.start):
                    continue
                hashes, owner = words.hashes(), code[row:stop][words.documents()]
                order = np.lexsort((owner, hashes))
                first = np.flatnonzero(np.concatenate([
                    [True], (hashes[order][1:] != hashes[order][:-1]) | (owner[order][1:] != owner[order][:-1]),
                ]))
                times, pick = np.diff(np.append(first, len(order))), order[first]
                for put, value in zip(found[0], (hashes[pick], owner[pick], times), strict=True):
                    put.append(value)
                letters = Characters(words)
                for n in range(1, LONGEST + 1):
                    word, gram = letters.grams(n, pick)
                    for put, value in zip(found[n], _summed([gram], [owner[pick][word]], [times[word]]), strict=True):
                        put.append(value)
            for kind, parts in enumerate(found):
                if parts[0]:
                    item, lang, n = _summed(*parts)
                    yield pa.record_batch(
                        [pa.array(np.full(len(item), kind, np.int32)), pa.array(item.view(np.int64)), pa.array(lang.astype(np.int32)), pa.array(n.astype(np.int64))],
                        ["kind", "item", "lang", "n"],
                    )
    return run


@dataclass(frozen=True)
class Cache:
    """Log shares by item and language of the most frequent words and n-grams, whose hashes are sorted."""

    words: np.ndarray
    word_scores: np.ndarray
    grams: np.ndarray
    gram_scores: np.ndarray


def _found(sorted_hashes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which of ``hashes`` are there, where)."""
    if not len(sorted_hashes):
        return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(sorted_hashes, hashes), len(sorted_hashes) - 1)
    return sorted_hashes[at] == hashes, at


@dataclass(frozen=True)
class Model:
    languages: list[str]
    totals: np.ndarray  # by kind and language: what a smoothed count is divided by
    table: DataFrame | None  # kind, item, n and a count for each language
    cache: Cache

    def shares(self, kind) -> list:
        """Columns with the log shares of the items of ``table`` (their counts are l0, l1, ...)."""
        by_kind = [F.array(*[F.lit(float(x)) for x in self.totals[:, i]])[kind] for i in range(len(self.languages))]
        return [F.log((F.col(f"l{i}") + SMOOTHING) / total).alias(f"s{i}") for i, total in enumerate(by_kind)]


def train(docs: DataFrame, words: int = WORDS, grams: int = GRAMS) -> Model:
    """Learn from the texts of ``docs`` (text, lang) with a language; no rows make a model without languages.

    ``words`` and ``grams`` are the sizes of the caches."""
    rows = docs.filter("lang is not null").select("text", "lang").filter(F.col("text").rlike(r"[^ \t-\r]"))
    languages = sorted(r[0] for r in rows.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    empty = Cache(np.zeros(0, np.uint64), np.zeros((0, 0)), np.zeros(0, np.uint64), np.zeros((0, 0)))
    if not languages:
        return Model([], np.zeros((LONGEST + 1, 0)), None, empty)
    names = [f"l{i}" for i in range(len(languages))]
    by_language = [F.sum(F.when(F.col("lang") == i, F.col("n")).otherwise(0)).alias(name) for i, name in enumerate(names)]
    table = written(
        rows.mapInArrow(_counted(languages), "kind int, item long, lang int, n long").groupBy("kind", "item").agg(F.sum("n").alias("n"), *by_language),
        "language-counts",
    )
    sums = fetched(table.groupBy("kind").agg(F.count(F.lit(1)).alias("items"), *[F.sum(name).alias(name) for name in names]))
    totals = np.full((LONGEST + 1, len(languages)), SMOOTHING)
    totals[sums["kind"]] = np.stack([sums[name] for name in names], 1) + SMOOTHING * (sums["items"].astype(np.float64)[:, None] + 1)

    def cached(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
        top = fetched(most_frequent(rows, min(most, CACHED_NUMBERS // len(languages))))
        hashes = top["item"].astype(np.int64).view(np.uint64)
        order = np.argsort(hashes)
        counts = np.stack([top[name] for name in names], 1).astype(np.float64)
        return hashes[order], np.log((counts + SMOOTHING) / totals[top["kind"].astype(np.int64)])[order]

    cache = Cache(*cached(table.filter("kind = 0"), words), *cached(table.filter("kind > 0"), grams))
    return Model(languages, totals, table, cache)


def _begun(shared, columns: list[str], n_languages: int):
    """Sums of log shares over the cached words of each row (``_scores``), and its other words (``_others``)."""
    def run(batches):
        for batch in batches:
            cache = shared.value
            scores, others = np.zeros((batch.num_rows, n_languages)), [None] * batch.num_rows
            for row, stop, words in slices(batch.column("text")):
                if not n_languages or not len(words.start):
                    continue
                owner = words.documents()
                known, at = _found(cache.words, words.hashes())
                for k in range(n_languages):
                    value = cache.word_scores[at[known], k] if known.any() else np.zeros(0)
                    scores[row:stop, k] = np.bincount(owner[known], value, stop - row)
                data, left = words.data.tobytes(), np.flatnonzero(~known)
                cut = np.searchsorted(owner[left], np.arange(stop - row + 1))
                for i in np.flatnonzero(np.diff(cut)):
                    mine = left[cut[i]: cut[i + 1]]
                    others[row + i] = b" ".join([data[a: a + n] for a, n in zip(words.start[mine].tolist(), words.length[mine].tolist(), strict=True)])
            yield pa.record_batch(
                [
                    *[batch.column(c) for c in (*columns, "_letters", "_row")],
                    pa.array([s.tobytes() for s in scores], pa.binary()), pa.array(others, pa.binary()).view(pa.string()),
                ],
                [*columns, "_letters", "_row", "_scores", "_others"],
            )
    return run


def _pairs(batches):
    """(row, word, times) of the words of ``_others``."""
    for batch in batches:
        ids = batch.column("_row")
        for row, _, words in slices(batch.column("_others"), lower=False):
            if len(words.start):
                word, owner, times = _summed([words.hashes()], [words.documents()], [np.ones(len(words.start), np.int64)])
                yield pa.record_batch([ids.take(pa.array(row + owner)), pa.array(word.view(np.int64)), pa.array(times)], ["_row", "word", "times"])


def _met(batches):
    """The different words of ``_others``."""
    for batch in batches:
        for _, _, words in slices(batch.column("_others"), lower=False):
            word, pick = np.unique(words.hashes(), return_index=True)
            data = words.data.tobytes()
            text = [data[a: a + n] for a, n in zip(words.start[pick].tolist(), words.length[pick].tolist(), strict=True)]
            yield pa.record_batch([pa.array(word.view(np.int64)), pa.array(text, pa.binary()).view(pa.string())], ["word", "text"])


def _looked_up(shared, n_languages: int):
    """For each word and length of n-grams: what the cached ones add up to (``gram`` is null), and the others.

    Lengths below one of which the cache has an n-gram are of no use.
    """
    def run(batches):
        for batch in batches:
            cache = shared.value
            for row, stop, words in slices(batch.column("text"), lower=False):
                ids = batch.column("word").slice(row, stop - row).to_numpy(zero_copy_only=False)
                letters, todo = Characters(words), np.arange(len(words.start))
                for n in range(LONGEST, 0, -1):
                    owner, gram = letters.grams(n, todo)
                    known, at = _found(cache.grams, gram)
                    number = np.bincount(owner[known], minlength=len(todo))
                    sums = [np.bincount(owner[known], cache.gram_scores[at[known], k] if known.any() else np.zeros(0), len(todo)) for k in range(n_languages)]
                    has = np.flatnonzero(number)
                    rest, place, times = _summed([gram[~known]], [owner[~known]], [np.ones((~known).sum(), np.int64)])
                    size = len(has) + len(rest)
                    yield pa.record_batch(
                        [
                            pa.array(ids[todo[np.concatenate([has, place])]]), pa.array(np.full(size, n, np.int32)),
                            pa.concat_arrays([pa.nulls(len(has), pa.int64()), pa.array(rest.view(np.int64))]),
                            pa.array(np.concatenate([number[has], times]).astype(np.int64)),
                            *[pa.array(np.concatenate([s[has], np.zeros(len(rest))])) for s in sums],
                        ],
                        ["word", "kind", "gram", "times", *[f"v{k}" for k in range(n_languages)]],
                    )
                    todo = todo[number == 0]
    return run


def _others_scored(begun: DataFrame, model: Model, shared) -> DataFrame:
    """(_row, t0, t1, ...): sums of the log shares over the words of ``_others``, by language."""
    every = range(len(model.languages))
    left = begun.filter("_others is not null").select("_row", "_others")
    known = model.table.filter("kind = 0").select(F.col("item").alias("word"), "n", *[f"l{k}" for k in every])
    met = written(left.select("_others").mapInArrow(_met, "word long, text string").distinct().join(known, "word", "left"), "language-words")
    schema = "word long, kind int, gram long, times long" + "".join(f", v{k} double" for k in every)
    looked = written(met.filter("n is null").select("word", "text").mapInArrow(_looked_up(shared, len(every)), schema), "language-grams")
    grams = model.table.filter("kind > 0").select(F.col("item").alias("gram"), *model.shares(F.col("kind")))
    rest = looked.filter("gram is not null").select("word", "kind", "gram", "times").join(grams, "gram")
    parts = looked.filter("gram is null").select("word", "kind", "times", *[f"v{k}" for k in every]).union(
        rest.select("word", "kind", "times", *[F.col("times") * F.col(f"s{k}") for k in every]),
    )
    parts = parts.groupBy("word", "kind").agg(F.sum("times").alias("times"), *[F.sum(f"v{k}").alias(f"v{k}") for k in every])
    longest = parts.groupBy("word").agg(F.max_by(F.struct("times", *[f"v{k}" for k in every]), "kind").alias("best"))
    scores = met.filter("n is not null").select("word", *model.shares(F.lit(0))).union(
        longest.select("word", *[F.col(f"best.v{k}") / F.col("best.times") for k in every]),
    )
    pairs = left.mapInArrow(_pairs, "_row long, word long, times long")
    return pairs.join(scores, "word").groupBy("_row").agg(*[F.sum(F.col("times") * F.col(f"s{k}")).alias(f"t{k}") for k in every])


def predict(docs: DataFrame, model: Model, columns: list[str] | None = None) -> DataFrame:
    """Every row of ``docs`` (or its ``columns``) with ``lang_pred`` and ``score`` (replaced if there).

    ``score`` is the share of the winner among the languages' likelihoods (the
    first in alphabetical order wins a tie). A text that is null or has no letter
    gets ``und`` and 0, as does every text where nothing was learnt.
    """
    columns = [c for c in (docs.columns if columns is None else columns) if c not in ("lang_pred", "score")]
    given = {f"given{i}": c for i, c in enumerate(columns)}  # names that no other column has
    plain = docs.select(*[F.col(f"`{c}`").alias(name) for name, c in given.items()], "text")
    return _predicted(plain, model, list(given)).toDF(*columns, "lang_pred", "score")


def _predicted(docs: DataFrame, model: Model, columns: list[str]) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model.cache)
    languages = list(model.languages)
    rows = docs.withColumn("_letters", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    schema = rows.limit(0).select(*columns, "_letters", F.lit(0).cast("long").alias("_row"), F.lit(b"").alias("_scores"), F.lit(None).cast("string").alias("_others")).schema
    begun = written(rows.withColumn("_row", F.monotonically_increasing_id()).mapInArrow(_begun(shared, columns, len(languages)), schema), "language-rows")
    added = [f"t{k}" for k in range(len(languages))]
    summed = begun.drop("_others")
    if languages:
        summed = summed.join(_others_scored(begun, model, shared), "_row", "left")

    def run(batches):
        for batch in batches:
            scores = np.frombuffer(b"".join(batch.column("_scores").to_pylist()), np.float64).reshape(batch.num_rows, len(languages))
            if languages:
                scores = scores + np.stack([batch.column(c).fill_null(0.0).to_numpy(zero_copy_only=False) for c in added], 1)
            else:
                scores = np.zeros((batch.num_rows, 1))
            best = scores.argmax(axis=1)
            share = 1 / np.exp(scores - scores.max(axis=1, keepdims=True)).sum(axis=1)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False).astype(bool) & bool(languages)
            names = np.array([*languages, "und"], object)[np.where(letters, best, len(languages))]
            yield pa.record_batch(
                [*[batch.column(c) for c in columns], pa.array(names, pa.string()), pa.array(np.where(letters, share, 0.0))],
                [*columns, "lang_pred", "score"],
            )

    schema = rows.limit(0).select(*columns, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema
    return summed.mapInArrow(run, schema)


def op8_language_id(spark, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    found = predict(docs.select("doc_id", "text"), model, ["doc_id"])
    return found.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")
