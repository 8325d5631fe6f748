"""Packing, conversation repair and hard negatives against plain versions."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from llm_reference import SMALL, nothing, odd  # noqa: F401

from pixelhour.llm import binary_packing, conversations, hard_negatives
from pixelhour.llm.common import documents

VOCABULARY = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def tokenizer_file():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path(VOCABULARY)


@pytest.fixture(scope="module")
def tokenizer(tokenizer_file):
    return pytest.importorskip("tokenizers").Tokenizer.from_file(tokenizer_file)


# --- packing

def check_pieces(rows, texts, tokenizer, most):
    """``rows`` are whole packings of ``texts`` ({doc_id: [text…]}); ids are compared as multisets of documents."""
    found = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["start"])):
        assert r["length"] == len(r["ids"]) // 4
        assert r["length"] == most or r["length"] < most and r["length"] & (r["length"] - 1) == 0
        found.setdefault(r["doc_id"], []).append(r)
    assert found.keys() == texts.keys()
    for doc_id, own in found.items():
        want = Counter()
        for text in texts[doc_id]:
            ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
            at, left = 0, len(ids)
            while left:
                n = most if left >= most else 1 << (left.bit_length() - 1)
                want[(at, n, np.array(ids[at: at + n], "<u4").tobytes(), len(ids))] += 1
                at, left = at + n, left - n
        assert Counter((r["start"], r["length"], bytes(r["ids"]), r["doc_tokens"]) for r in own) == want


@pytest.mark.parametrize("most", [1024, 64])
def test_pieces_of_odd_texts(odd, tokenizer, tokenizer_file, most):
    texts = {}
    for r in odd.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"])
    rows = binary_packing.pack(odd, tokenizer_file, most).collect()
    check_pieces(rows, texts, tokenizer, most)
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    by_id = sorted(rows, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_id] == sorted((r["length"] for r in rows), reverse=True)
    assert {r["offset"] for r in rows} == {0}


def test_packed_documents(spark, tokenizer, tokenizer_file):
    docs = documents(spark, SMALL)
    rows = binary_packing.op12_binary_packing(spark, SMALL).collect()
    whole = {(r["doc_id"], r["start"]): r for r in binary_packing.pieces(docs, tokenizer_file).collect()}
    check_pieces(whole.values(), {r["doc_id"]: [r["text"]] for r in docs.collect()}, tokenizer, 1024)
    assert len(rows) == len(whole)
    for r in rows:
        assert r["ids_crc32"] == zlib.crc32(whole[r["doc_id"], r["start"]]["ids"])


def test_sequence_numbers_are_stable(spark, odd, tokenizer_file):
    parts = binary_packing.pieces(odd, tokenizer_file, digest=True)
    one, two = (Counter(map(tuple, binary_packing.numbered(p).collect())) for p in (parts, parts.repartition(5, "ids_crc32")))
    assert one == two


def test_packing_nothing(nothing, tokenizer_file):
    assert binary_packing.pack(nothing, tokenizer_file).count() == 0
    with pytest.raises(ValueError):
        binary_packing.pieces(nothing, tokenizer_file, most=1000)


def test_parts_between_spaces_encode_alike(tokenizer, tokenizer_file):
    coder = binary_packing.Coder(tokenizer_file)
    draw = random.Random(5)
    alphabet = [" ", " ", "  ", "a", "Be", "é", "1", "!", "\n", "\t", " ", "　", "\x1c", "\x85", "'s", "日", "🎉", "<|endoftext|>"]
    texts = ["", " ", " a", "a ", "a  b", "\n a", *("".join(draw.choices(alphabet, k=draw.randrange(40))) for _ in range(3000))]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_text_and_forgotten_parts(tokenizer, tokenizer_file, monkeypatch):
    monkeypatch.setattr(binary_packing, "KNOWN", 10)
    monkeypatch.setattr(binary_packing, "RUN_CHARS", 2000)
    coder = binary_packing.Coder(tokenizer_file)
    texts = [" ".join(f"w{i * j % 991}" for i in range(3000)) for j in range(1, 6)]
    for run in binary_packing.runs(pa.array(texts)):
        for text, got in zip(run, coder.encode(run), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


# --- conversations

WHITE = "\x20\t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        text, role = " " if text is None else text, " " if role is None else role
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        if case == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if case == 3 else 1)
    return out


def plain_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("" if text.rstrip(WHITE)[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain_best(rows, faults):
    """All edits with up to two inserts in a row, tried one by one (none that the pattern cannot go on from)."""
    best = None

    def go(i, roles, cost, audit, lines, inserts):
        nonlocal best
        if cost > (best[0] if best else 4 * len(rows)) or not re.fullmatch("s?(ua)*u?", roles):
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            best = min(best, (cost, audit, lines)) if best else (cost, audit, lines)
        if inserts < 2:
            for role in ("user", "assistant"):
                go(i, roles + role[0], cost + 3, audit + "I", [*lines, role + ":"], inserts + 1)
        if i == len(rows):
            return
        _, role, text = rows[i]
        go(i + 1, roles, cost + 4, audit + "D", lines, 0)
        if faults[i] in ("", "truncated"):
            extra = 3 if faults[i] else 0
            go(i + 1, roles + (role[:1] or "-"), cost + extra, audit + "K", [*lines, f"{role}:{text}"], 0)
            for other in ("user", "assistant"):
                go(i + 1, roles + other[0], cost + extra + 3, audit + "R", [*lines, f"{other}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best


def plain_repair(rows):
    """{conv_id: result} of damaged rows, one conversation after another."""
    out = {}
    groups = {}
    for conv, *rest in rows:
        groups.setdefault(conv, []).append(tuple(rest))
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        faults = plain_faults(own)
        turns = {t for t, _, _ in own if t is not None}
        initials = [r[:1] for _, r, _ in own]
        cost, audit, lines = plain_best(own, faults)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


NONE = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def results(df):
    return {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def random_rows(n, longest, seed):
    draw = random.Random(seed)
    roles = ["user", "user", "assistant", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "what", "Why?  \n", "", " \t", None, "Yes.", "ü.", "x.y"]
    return [
        (conv, draw.choice([None, t, t, t, t + 2, -t]), draw.choice(roles), draw.choice(texts))
        for conv in [None, *range(n)] for t in range(draw.randrange(longest + 1))
    ]


def test_repairs_against_all_edits(spark):
    rows = random_rows(120, 6, 3)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("fault", conversations.F.lit("mine"))
    got = results(conversations.repair(conversations.damaged(df), df))
    want = plain_repair(plain_damage(rows))
    assert got == {conv: want.get(conv, NONE) for conv in {r[0] for r in rows}}
    undamaged = results(conversations.repair(df, df))
    assert undamaged == plain_repair([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows])


def test_long_conversation_has_cheapest_edits(spark):
    """Blocks and checkpoints change nothing: a path of the same cost and letters as over all vectors at once."""
    draw = random.Random(9)
    rows = [(1, i, draw.choice(["user", "assistant", "system"]), draw.choice(["a.", "b", "", f"{i}!"])) for i in range(3000)]
    got = results(conversations.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), spark.createDataFrame([(1,)], "conv_id long")))[1]
    own = [(t, r, x) for _, t, r, x in rows]
    number = {"": 0, "blank": 1, "duplicate": 2, "truncated": 3}
    faults = [number[f] for f in plain_faults(own)]
    costs = [conversations.with_inserts(conversations.END)]
    for (_, role, _), fault in zip(reversed(own), reversed(faults), strict=True):
        costs.append(conversations.before_row(costs[-1], role[0], fault))
    costs.reverse()
    state, audit = 0, ""
    for i, (_, role, _) in enumerate(own):
        for letter, state in conversations.edits(state, role[0], faults[i], costs[i], costs[i + 1]):
            audit += letter
    while state not in (0, 3):
        state, audit = conversations.NEXT[state], audit + "I"
    assert got[5] == costs[0][0] and got[6] == audit
    assert got[1:4] == tuple(faults.count(k) for k in (1, 2, 3))


def test_rows_held_grow_with_the_square_root():
    talk = conversations._Conversation(1, 10_000)
    for place in reversed(range(10_000)):
        talk.back(place, "ua"[place % 2], 0)
    assert len(talk.checkpoints) <= 101
    most = 0
    for place in range(10_000):
        talk.forth(place, place, ["user", "assistant"][place % 2], "x.", "ua"[place % 2], 0)
        most = max(most, len(talk.block))
    assert most <= 100 and talk.result()["audit"] == "K" * 10_000


def test_conversations_that_lost_all_rows_and_empty_tables(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert results(conversations.repair(conversations.damaged(df), df)) == {lost: NONE}
    assert conversations.repair(df.limit(0), df.limit(0)).count() == 0


# --- hard negatives

def plain_negatives(rows, positives=5, negatives=10):
    """rows: (vec_id, label, vector, is_anchor)."""
    usable = [
        (i, label, [int(np.floor(256 * x)) for x in vector], a) for i, label, vector, a in rows
        if label is not None and vector is not None and all(x is not None and np.isfinite(x) for x in vector)
    ]
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = Counter()
    for n, (i, label, vector, anchor) in enumerate(usable):
        if not anchor:
            continue
        scores = [(sum(map(int.__mul__, vector, other)), j, lab, m) for m, (j, lab, other, _) in enumerate(usable) if len(other) == len(vector)]
        near = sorted((s for s in scores if s[2] == label and s[3] != n), key=order)[:positives]
        for p, j, _, _ in near:
            hard = sorted((s for s in scores if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p), key=order)[:negatives]
            out.update((i, j, k + 1, s[1], p, s[0]) for k, s in enumerate(hard))
    return out


def mined(df, **options):
    rows = hard_negatives.mine(df, hard_negatives.F.col("vec_id") % 3 == 0, **options).collect()
    return Counter((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows)


def vectors(seed, n=120):
    draw = random.Random(seed)
    rows = [(i, draw.randrange(3), [draw.choice([-1.0, -0.5, 0.0, 0.25, 0.503, 1.0, 2.5]) for _ in range(6)]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, None, [1.0] * 6), (n + 2, 1, [float("nan")] * 6), (n + 3, 2, [1.0, None] * 3), (n + 4, 1, [float("inf")] * 6)]
    rows += [(None, 1, [1.0] * 6), (None, 2, [1.0] * 6), (6, 1, [1.0] * 6), (6, 1, [1.0] * 6), (9, 2, [1.0] * 4), (12, 2, [0.5] * 4), (15, 1, [0.5] * 4), (18, 1, [])]
    return rows


@pytest.mark.parametrize("cells", [None, 60])
def test_negatives_against_all_pairs(spark, monkeypatch, cells):
    if cells:
        monkeypatch.setattr(hard_negatives, "CELL_CANDIDATES", cells * 3)
        monkeypatch.setattr(hard_negatives, "CELL_ANCHORS", cells)
    rows = vectors(4)
    df = spark.createDataFrame([(i, label, v, "mine") for i, label, v in rows], "vec_id long, label int, embedding array<float>, row string")
    exact = [(i, label, v and [None if x is None else float(np.float32(x)) for x in v], i is not None and i % 3 == 0) for i, label, v in rows]
    assert mined(df) == plain_negatives(exact)


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert mined(empty) == Counter()
    assert mined(spark.createDataFrame([(3, 1, [1.0])], "vec_id long, label int, embedding array<double>")) == Counter()


def test_very_large_components(spark):
    rows = [(i, i % 2, [1e30 * (i + 1), -1e5, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    top = hard_negatives.MOST
    assert all(p == top for _, _, _, _, p, _ in mined(df)) and not mined(df)  # all scores stay at the end, none is below 90 %
    rows = [(i, i % 2, [3e5 * (i + 1), -1e5, float(i)]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mined(df) == plain_negatives([(i, label, v, i % 3 == 0) for i, label, v in rows]) != Counter()


@pytest.mark.parametrize("most", [1, 300, 1 << 20, 1 << 40, 10**30])
def test_packed_products_are_exact(most):
    draw = random.Random(most)
    for n, m, d in [(1, 1, 1), (7, 5, 3), (64, 40, 16)]:
        a, c = ([[draw.randrange(-most, most + 1) for _ in range(d)] for _ in range(k)] for k in (m, n))
        kind = np.float64 if most < 1 << 51 else object
        got = hard_negatives.packed_products(np.array(a, kind), np.array(c, kind))
        want = [[max(hard_negatives.LEAST, min(hard_negatives.MOST, sum(map(int.__mul__, x, y)))) for y in c] for x in a]
        assert got.tolist() == want


def test_constant_vectors_far_from_zero():
    a = np.full((2, 64), -(2.0**31))
    assert hard_negatives.packed_products(a, a).tolist() == [[hard_negatives.MOST] * 2] * 2


def test_parts_needed_next_stay_remembered(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(binary_packing, "KNOWN", 2)
    coder = binary_packing.Coder(public_tokenizers.path("byte_bpe_50k.json"))
    whole = list(coder.encode(["a red bird", "a green bird"]))
    learned = []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda parts: (learned.extend(parts), learn(parts)))
    again = list(coder.encode(["a red bird", "a blue bird"]))
    assert learned == ["blue"] and set(coder.known) == {"red", "blue", "bird"} and coder.chars == 11
    assert again[0] == whole[0]


def test_marks_and_newlines_make_no_new_parts(tokenizer, tokenizer_file, monkeypatch):
    coder = binary_packing.Coder(tokenizer_file)
    list(coder.encode(["a red élan and one bird.\nred, gone! 12% bird,red"]))
    learned = []
    learn = coder._learn
    monkeypatch.setattr(coder, "_learn", lambda parts: (learned.extend(parts), learn(parts)))
    text = "a bird. one red, gone, bird! élan.\nred. élan, 12,red"
    (got,) = coder.encode([text])
    assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert not {"bird.", "bird!", "red,", "gone,", "élan,", "élan.\nred.", "12,red"} & set(learned)
    assert not {"bird", "one", "red", "gone", "élan", "12"} & set(learned)


def test_cuts_at_marks_encode_alike(tokenizer, tokenizer_file):
    alphabet = [*" \n.,!_-'aé×÷ßĀȿɐЖ҂1²½日。🎉ªµ", "  ", "\r\n", "\x1c", "\x85", "\xa0", "\u1680", "\u2028", "\u3000", "\u200b", "\u0301", "'s", "'re"]
    for some in (alphabet, [*alphabet, "<|endoftext|>", "<|", "endoftext", "|>"]):
        draw = random.Random(len(some))
        texts = ["", " ", "\n", " \nfoo", "\nfoo", " foo", *("".join(draw.choices(some, k=draw.randrange(30))) for _ in range(4000))]
        texts += [f"a {c} b{c}. {c}{c},{c}\n{c}! 1{c}'s {c}" for c in map(chr, range(0x3100))]
        coder = binary_packing.Coder(tokenizer_file)
        for text, got in zip(texts, coder.encode(texts), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_other_patterns_are_cut_at_spaces_only(tokenizer_file, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    other = tokenizers.Tokenizer.from_file(tokenizer_file)
    pattern = r"[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}| ?[^\s\p{L}\p{N}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
    before = tokenizers.pre_tokenizers
    other.pre_tokenizer = before.Sequence([before.Split(tokenizers.Regex(pattern), "isolated"), before.ByteLevel(add_prefix_space=False, use_regex=False)])
    other.save(str(tmp_path / "other.json"))
    coder = binary_packing.Coder(str(tmp_path / "other.json"))
    draw = random.Random(3)
    texts = ["".join(draw.choices([*" \n.,!-'aé123", "bird", "\n\n", "  "], k=draw.randrange(30))) for _ in range(4000)]
    for text, got in zip(texts, coder.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == other.encode(text, add_special_tokens=False).ids, repr(text)
