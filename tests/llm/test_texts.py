import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from llm_reference import LONG, SMALL, nothing, odd, words  # noqa: F401

from pixelhour.llm import byte_bpe, fingerprints, personal_data
from pixelhour.llm import words as W
from pixelhour.llm.common import documents

RANK_FILE = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANK_FILE), special_tokens={})


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def test_words_equal_patterns():
    draw = random.Random(1)
    texts = ["".join(draw.choices("aB é\t\n\x0b\x1c\xa0🎉", k=draw.randint(0, 30))) for _ in range(400)] + [None, "", "x" * 3000]
    got = []
    for row, stop, found in W.slices(pa.array(texts, pa.string())):
        cut = [found.data[s: s + n].tobytes() for s, n in zip(found.start, found.length, strict=True)]
        got += [cut[a:b] for a, b in itertools.pairwise(found.first)]
        by_hash = {}
        for word, h in zip(cut, found.hashes().tolist(), strict=True):
            assert by_hash.setdefault(h, word) == word
    assert got == [words(t) for t in texts]


def test_merges_equal_the_library(library):
    coder = byte_bpe.Merger(byte_bpe.read_ranks(RANK_FILE), PATTERN)
    draw = random.Random(2)
    parts = [*"aaabetions  \n\t'sd0159.,!é漢🎉", "\x1c", "\x85", "\xa0", "'ll", "the", "ing", " the", "́", "²", "​", "\x0b", "\r\n", "   "]
    texts = ["".join(draw.choices(parts, k=draw.randint(0, 60))) for _ in range(3000)] + [LONG, "a" * 5000, " " * 3000, ""]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == library.encode_ordinary(text)
        assert coder.decode(ids) == text.encode()


def test_plain_texts_are_cut_without_a_pattern(monkeypatch):
    monkeypatch.setattr(W, "_BESIDE_SPACE", None)
    assert W.cut_at_spaces("one two\nthree four") == ["one", "two\nthree", "four"]
    assert W.cut_at_spaces("één twee") == ["één", "twee"]


def test_cuts_equal_the_pattern():
    for gap in [" ", "  ", "\n", " \n", "\n ", "\t ", " \t", "\x1f ", "\xa0 ", " \u2003", "\u3000", "\x85 ", "a\t", ""]:
        for text in (f"a{gap}b c", f"é{gap}b c", f"{gap}a b", f"a b{gap}", gap, f"a\x0b{gap}b \u3042 c"):
            cut = text.split(" ") if W._BESIDE_SPACE.search(text) is None else W._SINGLE_SPACE.split(text)
            assert W.cut_at_spaces(text) == cut, repr(text)


def test_a_worker_lets_go_of_parts_after_a_task(spark):
    shared = byte_bpe.share_ranks(spark, RANK_FILE, {"shared": b"\0\0\0\0"})
    with byte_bpe.merger(shared, PATTERN) as coder:
        assert list(coder.shared) == ["shared"]
        first = list(coder.digests(["some words of a text"]))
        assert len(coder.said) == len(coder.spelled) == 4
    assert not (coder.shared or coder.known or coder.said or coder.spelled or coder.chars)
    with byte_bpe.merger(shared, PATTERN) as again:
        assert again is coder and list(again.digests(["some words of a text"])) == first


def test_query_equals_the_library(spark, library):
    text = {r["doc_id"]: r["text"] or "" for r in documents(spark, SMALL).collect()}
    rows = byte_bpe.op5_byte_bpe(spark, SMALL).collect()
    assert len(rows) == len(text)
    for r in rows:
        ids = library.encode_ordinary(text[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), sha(" ".join(map(str, ids))))
        assert r["decoded_sha256"] == sha(text[r["doc_id"]])


def test_round_trip_of_tables(spark, odd, nothing):
    coded = byte_bpe.encode(odd, RANK_FILE, PATTERN, into="kept")
    assert coded.columns == [*[c for c in odd.columns if c != "kept"], "kept"]
    back = byte_bpe.decode(coded, RANK_FILE, PATTERN, ids="kept").collect()
    assert len(back) == odd.count() and all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in back)
    assert byte_bpe.encode(nothing, RANK_FILE, PATTERN).count() == 0


def base_by_pattern(text):
    luhn = personal_data.luhn
    number = lambda m: re.sub("[^0-9]", "", m.group())
    found = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    found += [(2, *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(number(m)) <= 19 and luhn(number(m))]
    return found + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(number(m)) <= 15]


def test_base_spans():
    draw = random.Random(3)
    for _ in range(20_000):
        text = "".join(draw.choices("aA0@.-+ 19(é4", k=draw.randint(0, 40)))
        assert sorted(personal_data.base_spans(text)) == sorted(base_by_pattern(text))
    assert personal_data.base_spans("é 4111 1111 1111 1111 x") == [(2, 2, 21)]


@pytest.fixture(scope="module")
def field():
    return personal_data.train(personal_data.labelled(), rounds=120)


def test_viterbi_is_the_best_path(field):
    draw = np.random.default_rng(4)
    small = personal_data.Field(field.weights, draw.normal(size=field.moves.shape), draw.normal(size=field.starts.shape))
    scores = draw.normal(size=(9, personal_data.STATES))
    got = personal_data.viterbi(small, scores, np.array([0, 4, 5, 9]), np.array([True, True, False]))
    for a, b, opens in ((0, 4, True), (4, 5, True), (5, 9, False)):
        def value(path, a=a, b=b, opens=opens):
            before = small.starts if opens else small.moves[personal_data.OUTSIDE]
            return before[path[0]] + sum(scores[a + t, s] for t, s in enumerate(path)) + sum(small.moves[i, j] for i, j in itertools.pairwise(path))
        best = max(itertools.product(range(personal_data.STATES), repeat=b - a), key=value)
        assert tuple(got[a:b]) == best


def test_windows_decode_whole_texts(spark, field):
    texts = [r["text"] for r in documents(spark, SMALL).select("text").collect()] + [LONG, "", None]
    for row, stop, found in W.slices(pa.array(texts, pa.string()), lower=False):
        whole = personal_data.viterbi(field, field.emissions(personal_data.features(found)), found.first, np.ones(stop - row, bool))
        assert (personal_data.labels_of(field, found) == whole).all()


def test_field_on_other_rows_of_its_kind(field):
    table = personal_data.labelled(960)[480:]
    found = W.split(*W.text_buffers(pa.array([t for t, _ in table])), lower=False)
    assert (personal_data.labels_of(field, found) == np.concatenate([labels for _, labels in table])).mean() > 0.97


def test_spans(spark, odd, nothing, field):
    rows = personal_data.find(odd, field).collect()
    text = {r["doc_id"]: r["text"] for r in odd.collect()}
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (None, 5, 7):
            continue
        base = base_by_pattern(text[r["doc_id"]] or "")
        assert r["base_sha256"] == sha(personal_data.joined(base))
        assert set(filter(None, personal_data.joined(base).split(","))) <= set(r["spans"].split(","))
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [sum(k == i for k, _, _ in base) for i in range(4)]
    assert personal_data.find(nothing, field).count() == 0
    two = "und ü 4111111111111111 4111111111111111 da"
    (r,) = personal_data.find(spark.createDataFrame([(1, two)], "doc_id long, text string"), field).collect()
    assert r["n_card"] == 0 and r["spans"] == "card:6:22,card:23:39"  # 32 digits in a row are no base card


def by_hand(docs):
    """The fingerprint query over sorted (doc_id, text)."""
    out = {}
    for n, (i, text) in enumerate(docs):
        after = docs[(n + 1) % len(docs)][1]
        half = len(text) // 2
        out[i] = (len(text), sha(text[: len(text) - half] + after[:half]), text[: len(text) - half] + after[:half], after)
    return out


def test_fingerprint_query(spark):
    docs = sorted((r["doc_id"], r["text"] or "") for r in documents(spark, SMALL).collect())
    want, text = by_hand(docs), dict(docs)
    rows = fingerprints.op10_fingerprints(spark, SMALL).collect()
    assert len(rows) == len(docs)
    vector = lambda t: fingerprints.vectors(pa.array([t]))
    for r in rows:
        size, edited_sha, edited, after = want[r["doc_id"]]
        assert (r["n_chars"], r["edited_sha256"]) == (size, edited_sha)
        own, changed = vector(text[r["doc_id"]]), vector(edited)
        assert [r["fingerprint"], r["edited_fingerprint"]] == fingerprints.to_hex(np.concatenate([own, changed]))
        assert r["near_edited"] == fingerprints.likeness(own, changed)[0] and r["near_next"] == fingerprints.likeness(own, vector(after))[0]
    assert sum(r["near_edited"] for r in rows) / len(rows) > 0.3 + sum(r["near_next"] for r in rows) / len(rows)


def test_fingerprints_add_up():
    lines = ["one two three. four five", "six", "seven eight nine ten eleven twelve thirteen fourteen fifteen"]
    texts = ["\n".join(p) for p in itertools.permutations(lines)] + ["", "\n\n", "other", None]
    found = fingerprints.vectors(pa.array(texts))
    assert len({v.tobytes() for v in found[:6]}) == 1 and len({v.tobytes() for v in found}) == 3
    part = fingerprints.vectors(pa.array(["\n".join(lines[:2]), lines[2]]))
    assert (fingerprints.plus(part[:1], part[1:]) == found[:1]).all()
    assert (fingerprints.plus(found[:1], part[1:], -1) == part[:1]).all()
    assert (fingerprints.from_hex(fingerprints.to_hex(found)) == found).all()
    assert fingerprints.likeness(found[:1], found[1:2])[0] == 1 and fingerprints.likeness(found[:1], found[8:9])[0] < 0.3


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    rows = fingerprints.fingerprint(odd).collect()
    assert len(rows) == odd.count()
    by_text = {}
    for r in rows:
        assert by_text.setdefault(r["text"] or "", r["fingerprint"]) == r["fingerprint"]
    pairs = fingerprints.beside(odd).mapInArrow(fingerprints._compared, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    assert pairs.count() == odd.count()
    assert fingerprints.beside(nothing).count() == 0
    one = spark.createDataFrame([(1, "a\nb c d")], "doc_id long, text string")
    assert fingerprints.beside(one).count() == 2  # the only row follows itself


def test_likeness_of_very_long_texts():
    draw = np.random.Generator(np.random.PCG64(5))
    lines = lambda: [" ".join(map(str, row)) for row in draw.integers(0, 1 << 40, (20_000, 80)).tolist()]
    texts = [lines() for _ in range(6)]
    found = fingerprints.vectors(pa.array(["\n".join(t) for t in texts]))
    apart = fingerprints.likeness(found[:-1], found[1:])
    assert apart.mean() < 0.25 and apart.max() < 0.6  # 200,000 runs each, none the same
    mixed = fingerprints.vectors(pa.array(["\n".join(a[:15_000] + b[15_000:]) for a, b in zip(texts[:-1], texts[1:], strict=True)]))
    assert abs(fingerprints.likeness(found[:-1], mixed).mean() - 0.75) < 0.1


def test_spans_apart_from_base_spans():
    draw = random.Random(11)
    for _ in range(300):
        spans, base = ([(k, a, a + draw.randint(1, 9)) for k, a in ((draw.randrange(4), draw.randrange(60)) for _ in range(draw.randrange(12)))] for _ in range(2))
        assert personal_data.apart(spans, base) == [x for x in spans if not any(x[1] < b and a < x[2] for _, a, b in base)]


def test_spans_of_a_very_long_text(spark):
    """Thousands of spans of both kinds in one text of many bytes a character, in time linear in its length."""
    text = " ".join(f"ünï {i} mail{i}@example.com call +1 555 {i % 900 + 100} 01{i % 90 + 10} or mäil{i}＠x" for i in range(8000))
    docs = spark.createDataFrame([(1, text), (2, "ü " + text[:2000])], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in personal_data.find(docs, personal_data.train(personal_data.labelled())).collect()}
    assert rows[1]["n_email"] == 8000 and rows[1]["n_phone"] == 8000
    for r, whole in ((rows[1], text), (rows[2], "ü " + text[:2000])):
        spans = [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in r["spans"].split(","))]
        assert all(0 <= a < b <= len(whole) and whole[a:b].strip() == whole[a:b] for _, a, b in spans)
