import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from llm_reference import MEDIUM, SMALL, nothing, odd, words  # noqa: F401

from pixelhour.llm import hmm, language_id, quality
from pixelhour.llm.common import documents, remainder


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_base_scores_and_gain(spark):
    docs = {r["doc_id"]: words(r["text"]) + [None] for r in documents(spark, SMALL).collect()}
    counts = Counter(w for i, ws in docs.items() if fold(i, 10) for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    rows = hmm.op6_hmm(spark, SMALL).collect()
    assert len(rows) == len(docs)
    gain = 0.0
    for r in rows:
        ws = docs[r["doc_id"]]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert r["held_out"] == (fold(r["doc_id"], 10) == 0)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        gain += (r["score"] - r["base_score"]) * r["held_out"]
    assert gain > 0


def tiny(draw):
    model = hmm.Hmm(draw.dirichlet(np.ones(3)), draw.dirichlet(np.ones(3), 3), draw.dirichlet(np.ones(5), 3).T.copy())
    wide = np.zeros((hmm.SYMBOLS, 3))
    wide[:5] = model.emit
    return hmm.Hmm(model.start, model.move, wide)


def paths(model, text):
    for path in itertools.product(range(3), repeat=len(text)):
        p = model.start[path[0]] * model.emit[text[0], path[0]]
        for t in range(1, len(text)):
            p *= model.move[path[t - 1], path[t]] * model.emit[text[t], path[t]]
        yield path, p


def test_forward_sums_over_all_paths():
    draw = np.random.default_rng(1)
    model = tiny(draw)
    texts = [draw.integers(0, 5, n) for n in (1, 4, 2, 6, 3)]
    got = model.log10_likelihoods(texts)
    assert np.allclose(got, [math.log10(sum(p for _, p in paths(model, t))) for t in texts])
    assert len(model.log10_likelihoods([])) == 0


def test_expected_counts_equal_all_paths():
    draw = np.random.default_rng(2)
    model = tiny(draw)
    texts = [draw.integers(0, 5, n) for n in (5, 3, 1)]
    (part,) = hmm.segments(texts)
    starts, moves, emissions = hmm.expected(model, *part)
    want = [np.zeros(3), np.zeros((3, 3)), np.zeros((hmm.SYMBOLS, 3))]
    for t in texts:
        every = list(paths(model, t))
        total = sum(p for _, p in every)
        for path, p in every:
            want[0][path[0]] += p / total
            for i, s in enumerate(path):
                want[2][t[i], s] += p / total
                if i:
                    want[1][path[i - 1], s] += p / total
    for got, expected in zip((starts, moves, emissions), want, strict=True):
        assert np.allclose(got, expected)


def test_class_shares_sum_to_one(spark):
    """Words of a class and one unseen word share the class's probability."""
    texts = spark.createDataFrame([(i, f"tok{i % 90}a x{i}") for i in range(300)], "doc_id long, text string")
    counts = texts.select("text").mapInArrow(hmm._counted, "word long, class long, n long").groupBy("word").agg({"class": "min", "n": "sum"})
    counts = counts.withColumnsRenamed({"min(class)": "class", "sum(n)": "n"})
    known = hmm.vocabulary(counts, 300)
    assert known.tokens == 900 and known.distinct == 391
    assert math.isclose(known.symbol_shares().sum(), 1.0)


def test_lm_odd_rows(spark, odd, nothing):
    rows = hmm.score(odd, remainder("doc_id", 3) == 0).collect()
    assert len(rows) == odd.count()
    assert all(math.isfinite(r["score"]) and math.isfinite(r["base_score"]) and r["n_tokens"] >= 1 for r in rows)
    assert Counter(r["n_tokens"] for r in rows)[1] == sum(not words(r["text"]) for r in odd.collect())
    assert hmm.score(nothing, remainder("doc_id", 3) == 0).count() == 0


def test_quality_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = quality.op7_quality(spark, MEDIUM).collect()
    assert len(rows) == documents(spark, MEDIUM).count()
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert sum(p == q for p, q in held) / len(held) > 0.9
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (fold(r["doc_id"], 5) == 0) for r in rows)


def test_quality_features_equal_sets():
    texts = ["Ab cd Ab", None, "x1 !!", "Ab cd"]
    ((_, n, found),) = quality.slices(pa.array(texts, pa.string()), lower=False)
    owner, _ = quality.features(found)
    sizes = np.bincount(owner, minlength=n).tolist()
    # words: 2 and 2 pairs; shapes: 2, 2 pairs, 1 triple | none | 2, 1; 2, 1 | 2, 1; 2, 1
    assert sizes == [9, 0, 6, 6]


def test_quality_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(3, 1, 0), (3, 0, 0), (None, 1, 0), (5, 1, None), (9, None, 1)], "doc_id long, quality int, toxic int")
    for given in (labels, labels.limit(0)):
        model = quality.train(odd, given)
        scored = quality.score(odd, model)
        assert scored.columns == [*[c for c in odd.columns if c != "score"], "score"]
        assert all(0 <= r["score"] <= 1 for r in scored.collect())
    assert quality.score(nothing, model).count() == 0
    assert quality.train(nothing, labels).scores(np.zeros(0, np.int64), np.zeros(0, np.int64), 2).tolist() == [0.5, 0.5]


def test_languages_held_out(spark):
    langs = {r["doc_id"]: r["lang"] for r in documents(spark, MEDIUM).collect()}
    rows = language_id.op8_language_id(spark, MEDIUM).collect()
    held = [r["lang_pred"] == langs[r["doc_id"]] for r in rows if r["held_out"]]
    assert len(rows) == len(langs) and sum(held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)


def test_languages_back_off(spark, odd, nothing):
    rows = [(0, "the cat sat on the mat", "en"), (1, "der hund lag auf der matte", "de"), (2, "the the", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ["de", "en"]
    asked = [(0, "the"), (1, "matten hunde"), (2, "42 !!"), (3, None), (4, "ca"), (5, "漢字")]
    got = {r["doc_id"]: r for r in language_id.predict(spark.createDataFrame(asked, "doc_id long, text string"), model).collect()}
    assert [got[i]["lang_pred"] for i in range(5)] == ["en", "de", "und", "und", "en"]
    assert got[5]["lang_pred"] in ("de", "en") and got[2]["score"] == 0
    for docs, n in ((odd, odd.count()), (nothing, 0)):
        found = language_id.predict(docs, language_id.train(docs)).collect()
        assert len(found) == n
        assert all((r["lang_pred"] == "und") == (not any(c.isalpha() for c in r["text"] or "")) for r in found)


def _language_scores(rows, text):
    """Log scores by language, with plain counts of all words and character n-grams."""
    runs = lambda w, n: [("^" + w + "^")[i: i + n] for i in range(len(w) + 3 - n)]
    words = [(w, lang) for _, t, lang in rows for w in t.split()]
    made = [Counter(words)] + [Counter((g, lang) for w, lang in words for g in runs(w, n)) for n in range(1, 5)]
    share = lambda n, item, lang: math.log(
        (made[n][item, lang] + 0.5) / (sum(v for (_, k), v in made[n].items() if k == lang) + 0.5 * (len({i for i, _ in made[n]}) + 1)))
    seen = [{i for i, _ in m} for m in made]
    out = []
    for lang in sorted({lang for _, _, lang in rows}):
        total = 0.0
        for w in text.split():
            if w in seen[0]:
                total += share(0, w, lang)
                continue
            found = next(f for n in (4, 3, 2, 1) if (f := [share(n, g, lang) for g in runs(w, n) if g in seen[n]]))
            total += sum(found) / len(found)
        out.append(total)
    return out


def test_languages_use_all_training_words(spark):
    rows = [
        (0, "the cat sat on the mat the end", "en"), (1, "the the the der der rare häuser", "en"),
        (2, "der hund lag auf der matte der tür", "de"), (3, "größe über straße häuser das das", "de"), (4, "el niño está aquí", "es"),
    ]
    texts = ["cat", "häuser", "niño", "größe rare", "matten strassen", "häuse", "niñ", "the hund über unbekannt", "漢字 cat"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    asked = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sizes in ((0, 0), (3, 5), (1000, 1000)):
        got = {r["doc_id"]: r for r in language_id.predict(asked, language_id.train(docs, *sizes)).collect()}
        for i, text in enumerate(texts):
            scores = _language_scores(rows, text)
            best = max(range(3), key=lambda k: scores[k])
            assert got[i]["lang_pred"] == ["de", "en", "es"][best] and got[i]["text"] == text
            assert math.isclose(got[i]["score"], 1 / sum(math.exp(s - scores[best]) for s in scores), rel_tol=1e-9)


def test_quality_repeated_id(spark):
    once = [(i, f"word{i} {'clear plain' if i % 2 else 'junk spam'} text") for i in range(10)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    asked = spark.createDataFrame(once, "doc_id long, text string")
    hot = spark.createDataFrame([once[0]] * 500 + once, "doc_id long, text string").coalesce(1)
    want, got = (
        {r["doc_id"]: r["score"] for r in quality.score(asked, quality.train(docs, labels, 5)).collect()} for docs in (asked, hot)
    )
    assert want == got and want[1] > want[0]


def test_mixture_round_equals_plain_counts():
    draw = np.random.default_rng(4)
    texts = [np.array(t) for t in ([0, 1, 1], [2], [1, 2, 0, 0])]
    emit = np.full((hmm.SYMBOLS, hmm.STATES), 1e-3)
    emit[:3] = draw.dirichlet(np.ones(3), hmm.STATES).T
    prior = draw.dirichlet(np.ones(hmm.STATES))
    got = hmm.mixed(emit, prior, texts)
    likelihood, states, emissions = 0.0, np.zeros(hmm.STATES), np.zeros((hmm.SYMBOLS, hmm.STATES))
    for t in texts:
        joint = np.array([prior[s] * math.prod(emit[x, s] for x in t) for s in range(hmm.STATES)])
        likelihood += math.log(joint.sum())
        states += joint / joint.sum()
        for x in t:
            emissions[x] += joint / joint.sum()
    assert math.isclose(got[0], likelihood)
    assert np.allclose(got[1: 1 + hmm.STATES], states) and np.allclose(got[1 + hmm.STATES:].reshape(emissions.shape), emissions)
    first = hmm.mixed(None, None, texts, np.array([5, 5, 9], np.uint64))
    assert math.isclose(first[1: 1 + hmm.STATES].sum(), 3) and first[0] == 0


def test_model_does_not_depend_on_partitions(spark):
    docs = documents(spark, SMALL).limit(120).cache()
    scores = [
        sorted((r["doc_id"], r["score"]) for r in hmm.score(docs.repartition(n, "doc_id"), remainder("doc_id", 10) == 0).collect())
        for n in (2, 5)
    ]
    assert np.allclose([s for _, s in scores[0]], [s for _, s in scores[1]], rtol=1e-6)
