"""Scoring texts with a hidden Markov language model.

Tokens are lower-cased words and one end. Every word of the training texts is
counted. The ``CORE`` most frequent words are symbols of their own; any other word
is the symbol of its class (a hash of its first and last letters), within which it
is drawn by its smoothed count. Latent states emit symbols. They start from a
mixture over all training texts, fitted in distributed rounds; Baum-Welch passes run
over all training tokens, in segments, and add up expected counts across
partitions; a text's score is the exact scaled forward recursion over all of it.

The model has a fixed size. Counts of all words stay distributed: the ``KNOWN``
most frequent ones (whole levels of the count) are looked up from a broadcast
table, the rest in a join.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelhour.llm.common import documents, fetched, most_frequent, remainder, saved
from pixelhour.llm.words import Words, mix, slices

CORE = 1 << 15
CLASSES = 1 << 10
KNOWN = 1 << 18
STATES = 8
SEGMENT = 128
PASSES = 2
#: The states start from a mixture of unigrams over all training texts: at most so many rounds, fewer where the
#: likelihood changes by less than this share.
START_ROUNDS, SETTLED = 8, 5e-4
SEED = 20240131
ADD = 0.1
STICKY = 0.9
FIXED = float(1 << 20)  # expected counts add up as whole multiples of its inverse, in any order alike

END = CORE + CLASSES
SYMBOLS = END + 1


def classes(words: Words) -> np.ndarray:
    """A class for each word: a hash of its first byte and its last two."""
    last = words.start + words.length - 1
    key = words.data[words.start].astype(np.uint64) << np.uint64(16)
    key |= words.data[last].astype(np.uint64) << np.uint64(8)
    key |= np.where(words.length > 1, words.data[np.maximum(last - 1, 0)], 0).astype(np.uint64)
    return (mix(key + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)


def _counted(batches):
    for batch in batches:
        for _, _, words in slices(batch.column("text")):
            hashes, first, n = np.unique(words.hashes(), return_index=True, return_counts=True)
            kind = classes(words)[first] if len(first) else first
            yield pa.record_batch([pa.array(hashes.view(np.int64)), pa.array(kind), pa.array(n)], ["word", "class", "n"])


@dataclass(frozen=True)
class Vocabulary:
    tokens: int  # N: training tokens with ends
    distinct: int  # V: distinct ones
    ends: int
    words: np.ndarray  # sorted hashes of the KNOWN words
    counts: np.ndarray
    symbol: np.ndarray  # of each: its own, or -1
    class_tokens: np.ndarray
    class_words: np.ndarray

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / (self.tokens + ADD * (self.distinct + 1)))

    def class_base(self) -> np.ndarray:
        """What log10(count + ADD) of a word misses to be its share of its class."""
        return np.log10(self.class_tokens + ADD * (self.class_words + 1))

    def symbol_shares(self) -> np.ndarray:
        counts = np.zeros(SYMBOLS)
        own = self.symbol >= 0
        counts[self.symbol[own]] = self.counts[own]
        counts[CORE:END] = self.class_tokens
        counts[END] = self.ends
        return (counts + ADD) / (counts + ADD).sum()


def vocabulary(counts: DataFrame, ends: int) -> Vocabulary:
    """``counts``: word, class, n of every word."""
    top = fetched(most_frequent(counts, KNOWN).select("word", "class", "n"))
    by_rank = np.lexsort((top["word"], -top["n"].astype(np.int64)))
    top = {name: column[by_rank] for name, column in top.items()}
    kinds = fetched(counts.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("words")))
    number = top["n"].astype(np.int64)
    symbol = np.where(np.arange(len(number)) < CORE, np.arange(len(number)), -1)
    tokens, words = np.zeros(CLASSES), np.zeros(CLASSES)
    where = kinds["class"].astype(np.int64)
    tokens[where], words[where] = kinds["n"], kinds["words"]
    core = top["class"].astype(np.int64)[:CORE]
    total, distinct = int(tokens.sum()), int(words.sum())
    tokens -= np.bincount(core, number[:CORE], CLASSES)
    words -= np.bincount(core, minlength=CLASSES)
    hashes = top["word"].astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return Vocabulary(total + ends, distinct + (ends > 0), ends, hashes[order], number[order], symbol[order], tokens, words)


def _coded(shared):
    """Rows with the symbols of a text, its known share of the scores, and the hashes of words to be looked up."""
    def run(batches):
        for batch in batches:
            known = shared.value
            per_class = known.class_base()
            symbols, others, numbers = [], [], []
            for row, stop, words in slices(batch.column("text")):
                hashes, owner = words.hashes(), words.documents()
                n = stop - row
                at = np.minimum(np.searchsorted(known.words, hashes), max(len(known.words) - 1, 0))
                found = known.words[at] == hashes if len(known.words) else np.zeros(len(hashes), bool)
                count = np.where(found, known.counts[at], 0) if len(known.words) else np.zeros(len(hashes))
                own = np.where(found, known.symbol[at], -1) if len(known.words) else np.full(len(hashes), -1)
                kind = classes(words) if len(hashes) else np.zeros(0, np.int64)
                symbol = np.where(own >= 0, own, CORE + kind).astype(np.uint16)
                rare = own < 0
                base = np.bincount(owner[found], known.base(count[found]), n) + known.base(np.array([known.ends]))[0]
                within = np.bincount(owner[rare], np.where(found, np.log10(count + ADD), 0)[rare] - per_class[kind[rare]], n)
                numbers.append(np.column_stack([words.counts + 1, np.bincount(owner[found], minlength=n) + (known.ends > 0), base, within]))
                cut = words.first
                symbols += [symbol[a:b].tobytes() + np.uint16(END).tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)]
                cut = np.concatenate([[0], np.cumsum(np.bincount(owner[~found], minlength=n))])
                left = hashes[~found]
                others += [left[a:b].tobytes() or None for a, b in zip(cut[:-1], cut[1:], strict=True)]
            table = np.concatenate(numbers) if numbers else np.zeros((0, 4))
            yield pa.record_batch(
                [
                    batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(table[:, 0].astype(np.int64)),
                    pa.array(table[:, 1].astype(np.int64)), pa.array(table[:, 2]), pa.array(table[:, 3]),
                    pa.array(symbols, pa.binary()), pa.array(others, pa.binary()),
                ],
                ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "within", "symbols", "others"],
            )
    return run


@dataclass(frozen=True)
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # by symbol and state

    def log10_likelihoods(self, texts: list[np.ndarray]) -> np.ndarray:
        """The exact forward recursion over each text, all texts a step at a time."""
        order = np.argsort([-len(t) for t in texts], kind="stable")
        lengths = np.array([len(texts[i]) for i in order])
        flat = np.concatenate([texts[i] for i in order]) if len(order) else np.zeros(0, np.int64)
        begin = np.cumsum(lengths) - lengths
        log = np.zeros(len(order))
        alpha = np.repeat(self.start[None], len(order), 0)
        for t in range(lengths[0] if len(order) else 0):
            n = np.searchsorted(-lengths, -t)  # texts longer than t
            now = alpha[:n] @ self.move if t else alpha[:n]
            now = now * self.emit[flat[begin[:n] + t]]
            total = now.sum(axis=1)
            log[:n] += np.log10(total)
            alpha = now / total[:, None]
        out = np.zeros(len(order))
        out[order] = log
        return out


def expected(model: Hmm, symbols: np.ndarray, mask: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts of starts, moves and emissions over segments (rows of ``symbols``, padded where
    ``mask`` is false). Only segments that open a text count as starts."""
    width, steps = symbols.shape
    states = len(model.start)
    alpha = np.zeros((steps, width, states))
    scale = np.ones((steps, width))
    even = np.linalg.matrix_power(model.move, 64)[0]
    now = np.where(opens[:, None], model.start, even)
    for t in range(steps):
        now = now @ model.move if t else now
        now = now * np.where(mask[:, t, None], model.emit[symbols[:, t]], 1.0)
        scale[t] = now.sum(axis=1)
        now = alpha[t] = now / scale[t][:, None]
    moves = np.zeros((states, states))
    beta = np.ones((width, states))
    for t in range(steps - 1, -1, -1):
        live = mask[:, t]
        weighted = np.where(live[:, None], model.emit[symbols[:, t]], 1.0) * beta / scale[t][:, None]
        if t:
            moves += (alpha[t - 1][live].T @ weighted[live]) * model.move
        alpha[t] *= beta  # from here on, the states' shares at each place
        beta = np.where(live[:, None], weighted @ model.move.T, beta)
    alpha /= alpha.sum(axis=2, keepdims=True)
    shares, seen = alpha[mask.T], symbols.T[mask.T]
    emissions = np.stack([np.bincount(seen, shares[:, s], SYMBOLS) for s in range(states)], 1)
    return alpha[0][opens].sum(axis=0), moves, emissions


def segments(texts: list[np.ndarray], most: int = 1024):
    """(symbols, mask, opens) of the texts cut into segments, so many at a time."""
    cut = [(t[a: a + SEGMENT], a == 0) for t in texts for a in range(0, len(t), SEGMENT)]
    cut.sort(key=lambda c: -len(c[0]))
    for at in range(0, len(cut), most):
        part = cut[at: at + most]
        lengths = np.array([len(c) for c, _ in part])
        symbols = np.zeros((len(part), lengths.max()), np.int64)
        mask = np.arange(lengths.max()) < lengths[:, None]
        symbols[mask] = np.concatenate([c for c, _ in part])
        yield symbols, mask, np.array([o for _, o in part])


def _weight(emissions: np.ndarray) -> np.ndarray:
    """What the overall shares count for in each state: as much as the different symbols it emits."""
    return (emissions > 0.5).sum(axis=0) + 100 * ADD


def estimated(starts, moves, emissions, shares: np.ndarray) -> Hmm:
    """The model of expected counts, smoothed towards even states and the symbols' overall shares."""
    move = moves + ADD
    emit = emissions + _weight(emissions) * shares[:, None]
    return Hmm((starts + ADD) / (starts + ADD).sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def mixed(emit: np.ndarray, prior: np.ndarray, texts: list[np.ndarray], seeds: np.ndarray | None = None) -> np.ndarray:
    """One round of a mixture of unigrams over whole texts: their log likelihood, then the states' expected texts and emissions.

    With ``seeds`` (a number for each text) the texts' first shares in the states
    are drawn from these instead of computed.
    """
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    flat = np.concatenate(texts) if texts else np.zeros(0, np.int64)
    if seeds is not None:
        draws = mix(seeds[:, None] * np.uint64(STATES) + np.arange(STATES, dtype=np.uint64) + np.uint64(SEED))
        weight, gain = ((draws >> np.uint64(11)) / float(1 << 53)) ** 4 + 1e-9, 0.0  # uneven, so that states part
        weight /= weight.sum(axis=1, keepdims=True)
    else:
        log = np.log(emit)
        value = np.stack([np.bincount(owner, log[flat, s], len(texts)) for s in range(STATES)], 1) + np.log(prior)
        top = value.max(axis=1, keepdims=True)
        weight = np.exp(value - top)
        total = weight.sum(axis=1, keepdims=True)
        weight, gain = weight / total, float((np.log(total) + top).sum())
    emissions = np.stack([np.bincount(flat, weight[owner, s], SYMBOLS) for s in range(STATES)], 1)
    return np.concatenate([[gain], weight.sum(axis=0), emissions.ravel()])


def _summed(coded: DataFrame, counts, size: int) -> np.ndarray:
    """The sum of ``counts(texts, their seeds)`` over all rows, added up by place across partitions."""
    def run(batches):
        """Rows (place, n), rounded to whole multiples of 1 / FIXED."""
        sums = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                values = [x.as_py() for x in batch.column("symbols").slice(at, 500)]
                sums += counts([_symbols(v) for v in values], np.array([zlib.crc32(v) for v in values], np.uint64))
        whole = np.round(sums * FIXED).astype(np.int64)
        place = np.flatnonzero(whole)
        yield pa.record_batch([pa.array(place), pa.array(whole[place])], ["place", "n"])

    # As many rows as the model has numbers, whatever the corpus.
    found = fetched(coded.select("symbols").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")))
    sums = np.zeros(size)
    sums[found["place"].astype(np.int64)] = found["n"] / FIXED
    return sums


def _settled(before: float, now: float) -> bool:
    return abs(now - before) <= SETTLED * abs(now)


def _started(coded: DataFrame, shares: np.ndarray) -> Hmm:
    """States from a mixture of unigrams over all training texts.

    Rounds go over the whole table until the likelihood settles. The first shares
    of a text are drawn from a hash of it, so copies begin alike.
    """
    spark = coded.sparkSession
    emit, prior, before = None, None, -np.inf
    for turn in range(START_ROUNDS + 1):
        shared = spark.sparkContext.broadcast((emit, prior))

        def counts(texts, seeds, shared=shared, first=turn == 0):
            return mixed(*shared.value, texts, seeds if first else None)

        sums = _summed(coded, counts, 1 + STATES + SYMBOLS * STATES)
        shared.unpersist()
        if turn and _settled(before, sums[0]):
            break
        before = sums[0] if turn else before
        prior = (sums[1: 1 + STATES] + 1) / (sums[1: 1 + STATES] + 1).sum()
        emissions = sums[1 + STATES:].reshape(SYMBOLS, STATES)
        emit = emissions + _weight(emissions) * shares[:, None]
        emit /= emit.sum(axis=0)
    move = np.full((STATES, STATES), (1 - STICKY) / (STATES - 1)) + np.eye(STATES) * (STICKY - (1 - STICKY) / (STATES - 1))
    return Hmm(np.full(STATES, 1 / STATES), move, emit)


def _symbols(value: bytes) -> np.ndarray:
    return np.frombuffer(value, np.uint16).astype(np.int64)


def baum_welch(coded: DataFrame, known: Vocabulary, passes: int = PASSES) -> Hmm:
    """Train on the rows of ``coded`` (doc_id, symbols)."""
    spark, shares = coded.sparkSession, known.symbol_shares()
    model = _started(coded, shares)
    ends = STATES + STATES * STATES
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(model)

        def counts(texts, _, shared=shared):
            parts = [np.concatenate([x.ravel() for x in expected(shared.value, *part)]) for part in segments(texts)]
            return sum(parts, np.zeros(ends + SYMBOLS * STATES))

        sums = _summed(coded, counts, ends + SYMBOLS * STATES)
        model = estimated(sums[:STATES], sums[STATES:ends].reshape(STATES, STATES), sums[ends:].reshape(SYMBOLS, STATES), shares)
        shared.unpersist()
    return model


def score(docs: DataFrame, held_out, text: str = "text") -> DataFrame:
    """Score every text of ``docs`` with a model of those where ``held_out`` (a column) is false.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens met in
    training), train_tokens, base_score (smoothed unigrams) and score (the model),
    both log10 probabilities. Null and empty texts are an end alone. Repeated rows
    are rows of their own. Without training texts all tokens are unknown and alike.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    training = rows.filter(~F.col("held_out"))
    counts = saved(training.select("text").mapInArrow(_counted, "word long, class long, n long").groupBy("word").agg(
        F.min("class").alias("class"), F.sum("n").alias("n"),
    ))
    known = vocabulary(counts, training.count())
    shared = spark.sparkContext.broadcast(known)
    coded = saved(rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(
        _coded(shared), "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, symbols binary, others binary",
    ))
    model = spark.sparkContext.broadcast(baum_welch(coded.filter(~F.col("held_out")).select("doc_id", "symbols"), known))

    def forward(batches):
        for batch in batches:
            texts = [_symbols(x.as_py()) for x in batch.column("symbols")]
            value = np.concatenate([model.value.log10_likelihoods(texts[at: at + 500]) for at in range(0, max(1, len(texts)), 500)])
            kept = [c for c in batch.schema.names if c != "symbols"]
            yield pa.record_batch([*[batch.column(c) for c in kept], pa.array(value)], [*kept, "states"])

    scored = coded.drop("others").mapInArrow(forward, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, within double, states double")

    def spread(batches):
        for batch in batches:
            lists = [np.frombuffer(x.as_py(), np.int64) for x in batch.column("others")]
            if not lists:
                continue
            word, owner = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(x) for x in lists])
            order = np.lexsort((word, owner))
            word, owner = word[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], (word[1:] != word[:-1]) | (owner[1:] != owner[:-1])]))
            times = np.diff(np.append(first, len(word)))
            yield pa.record_batch([batch.column("row").take(pa.array(owner[first])), pa.array(word[first]), pa.array(times)], ["row", "word", "times"])

    others = coded.filter("others is not null").select("row", "others").mapInArrow(spread, "row long, word long, times long")
    n = F.coalesce("n", F.lit(0))
    looked_up = others.join(counts.select("word", "n"), "word", "left").groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum("times").alias("more"),
        F.sum(F.col("times") * F.log10(n + ADD)).alias("logs"),
    )
    divisor = float(np.log10(known.tokens + ADD * (known.distinct + 1)))
    logs, more = F.coalesce("logs", F.lit(0.0)), F.coalesce("more", F.lit(0))
    return scored.join(looked_up, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(known.tokens).cast("long").alias("train_tokens"), (F.col("base") + logs - more * divisor).alias("base_score"),
        (F.col("states") + F.col("within") + logs).alias("score"),
    )


def op6_hmm(spark, folder: str) -> DataFrame:
    return score(documents(spark, folder), remainder("doc_id", 10) == 0)
