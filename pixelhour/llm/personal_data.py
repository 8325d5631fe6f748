"""Personal data: exact base patterns, and a linear-chain conditional random field that adds spans.

The field labels white-space tokens as outside or as beginning or continuing an
e-mail address, IP address, card or phone number, from features of the token's
shape and its neighbours' shapes. It is trained on the driver from a small
labelled table of a stated size (``labelled``), by the gradient of the
conditional likelihood, and decoded by Viterbi in numpy batches.

Most tokens are plain: staying outside is better there by a margin. Between two
others, more plain tokens than the transitions could ever pay for always hold one
that is outside, so only windows around the others are decoded; the labels are
those of whole texts.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from pixelhour.llm.common import documents
from pixelhour.llm.words import Words, mix, shapes, slices, split, text_buffers

KINDS = ("email", "ip", "card", "phone")
OUTSIDE = 0  # then, for each kind, its beginning and its continuation
STATES = 1 + 2 * len(KINDS)
BUCKETS = 1 << 12
ROUNDS = 200
RATE = 0.1
PENALTY = 0.002
MARGIN = 1.0
SEED = 20240131

# Fixed patterns of the base kinds.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def is_ip(text: str) -> bool:
    parts = text.split(".")
    return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the base patterns, leftmost and non-overlapping for each kind."""
    out = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text[start - 1]):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
            done = domain.end()
        at = text.find("@", max(at + 1, done))
    if _DIGIT.search(text):
        out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if is_ip(m.group())]
        out += [(2, m.start(), m.end()) for m in _CARD.finditer(text) if 16 <= len(d := digits(m.group())) <= 19 and luhn(d)]
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits(m.group())) <= 15]
    return out


def labelled(rows: int = 480) -> list[tuple[str, list[int]]]:
    """The small labelled table: texts and the label of each token, made by rule.

    Plain words in several cases and with several marks stand around a number, an
    address or a look-alike that is none.
    """
    draw = np.random.Generator(np.random.PCG64(SEED))

    def pick(options):
        return options[int(draw.integers(len(options)))]

    def number(n: int) -> str:
        return "".join(map(str, draw.integers(0, 10, n)))

    def word() -> str:
        w = "".join(pick("abdeilnorstuéü") for _ in range(int(draw.integers(1, 11))))
        return pick([w, w, w, w, w.capitalize(), w.upper() + "!!", w + pick("###|$$$|***|%%%|&&&|,|.|:".split("|")), "|"])

    def email() -> str:
        return f"{pick(['', 'a.', 'bo_'])}{word().strip('!#$*%&,.:|').lower() or 'x'}{pick(['', '.' + number(2)])}@{pick(['mail', 'box'])}{pick(['', number(1)])}.{pick(['example.com', 'test.org'])}"

    def ip() -> str:
        return ".".join(str(int(draw.integers(0, 256))) for _ in range(4))

    def card() -> str:
        return pick([number(16), number(16), " ".join(number(4) for _ in range(4)), "-".join(number(4) for _ in range(4))])

    def phone() -> str:
        return pick([f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(2)} {number(4)} {number(4)}", f"+{number(2)}{number(9)}"])

    def none() -> str:
        return pick([
            number(4), number(2), number(1) + "." + number(1) + ".", number(3) + "%", "Version " + number(1) + "." + number(1), "v" + ip()[:5].rstrip("."),
            'token = "' + hashlib.sha256(number(4).encode()).hexdigest()[:40] + '"', "password=" + hashlib.sha256(number(4).encode()).hexdigest()[:18],
            "KEY" + hashlib.sha256(number(4).encode()).hexdigest()[:16].upper(), "@" + word().strip("@"), "$" + number(3) + "." + number(2), number(5),
            number(2) + ":" + number(2), number(4) + "-" + number(2) + "-" + number(2),
        ])

    table = []
    for i in range(rows):
        kind = i % 6
        tokens = [word() for _ in range(int(draw.integers(0, 6)))]
        labels = [OUTSIDE] * len(tokens)
        for _ in range(int(draw.integers(1, 3))):
            if kind < 4:
                entity = (email, ip, card, phone)[kind]().split(" ")
                entity[-1] += pick(["", "", "", ".", ",", "###", "!!"])
                labels += [1 + 2 * kind, *[2 + 2 * kind] * (len(entity) - 1)]
            else:
                entity = (none() if kind == 4 else word()).split(" ")
                labels += [OUTSIDE] * len(entity)
            tokens += entity
        more = [word() for _ in range(int(draw.integers(0, 6)))]
        table.append((" ".join(tokens + more), labels + [OUTSIDE] * len(more)))
    return table


def features(words: Words) -> np.ndarray:
    """Four bucket numbers for each token: its shape, its counts, and its neighbours' shapes (0 at a text's ends)."""
    n = len(words.start)
    shape = (mix(shapes(words).hashes()) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
    data = words.data

    def count(which: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(which, dtype=np.int64)])
        return total[words.start + words.length] - total[words.start]

    digit = count((data >= 0x30) & (data <= 0x39))
    level = np.searchsorted([1, 2, 3, 4, 5, 7, 10, 13, 16, 17, 20], digit, "right")
    at, dot = np.minimum(count(data == 0x40), 1), np.minimum(count(data == 0x2E), 4)
    letters = np.minimum(count(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A) | (data >= 0x80)), 1)
    plus = (data[words.start] == 0x2B).astype(np.int64) if n else np.zeros(0, np.int64)
    counts = (((level * 2 + at) * 5 + dot) * 2 + letters) * 2 + plus
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    before[1:], after[:-1] = shape[:-1], shape[1:]
    filled = words.first[:-1][words.counts > 0]
    before[filled] = 0
    after[words.first[1:][words.counts > 0] - 1] = 0
    return np.stack([shape, counts, before, after])


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # by feature, bucket and state
    moves: np.ndarray  # by state and next state
    starts: np.ndarray

    def emissions(self, found: np.ndarray) -> np.ndarray:
        return sum(self.weights[k][found[k]] for k in range(len(found)))

    def context(self) -> int:
        """So many plain tokens in a row always hold one that is outside."""
        swing = float(max(self.moves.max(), self.starts.max()) - min(self.moves.min(), self.starts.min()))
        slack = float(max(self.moves.max() - self.moves[OUTSIDE, OUTSIDE], 0))
        return int(np.ceil(2 * swing / max(MARGIN - slack, 0.05))) + 1


def viterbi(field: Field, emissions: np.ndarray, first: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """The best labels of sequences that lie one after another (``first`` as in Words).

    One that does not open a text follows a token outside.
    """
    counts = np.diff(first)
    order = np.argsort(-counts, kind="stable")
    lengths, begin = counts[order], first[:-1][order]
    back = np.zeros((len(emissions), STATES), np.int8)
    labels = np.zeros(len(emissions), np.int64)
    if not len(order) or not lengths[0]:
        return labels
    before = np.where(opens[order][:, None], field.starts, field.moves[OUTSIDE])
    best = before + emissions[begin % max(len(emissions), 1)]
    ends = np.zeros((len(order), STATES))
    for t in range(1, lengths[0] + 1):
        n = np.searchsorted(-lengths, -t)  # longer than t
        ends[n: len(best)] = best[n:]
        if not n:
            break
        ways = best[:n, :, None] + field.moves
        place = begin[:n] + t
        back[place] = ways.argmax(axis=1)
        best = ways.max(axis=1) + emissions[place]
    state = ends.argmax(axis=1)
    for t in range(lengths[0] - 1, -1, -1):
        n = np.searchsorted(-lengths, -t)
        place = begin[:n] + t
        labels[place] = state[:n]
        state[:n] = back[place, state[:n]]
    return labels


def train(table: list[tuple[str, list[int]]], rounds: int = ROUNDS) -> Field:
    """Maximum conditional likelihood with a quadratic penalty, by Adam over the whole table."""
    words = split(*text_buffers(pa.array([t for t, _ in table], pa.string())), lower=False)
    found = features(words)
    lengths = words.counts
    mask = np.arange(lengths.max()) < lengths[:, None]
    rows, steps = mask.shape
    gold = np.zeros(mask.shape, np.int64)
    gold[mask] = np.concatenate([labels for _, labels in table])
    place = np.zeros(mask.shape, np.int64)
    place[mask] = np.arange(len(words.start))
    parts = [np.zeros((len(found), BUCKETS, STATES)), np.zeros((STATES, STATES)), np.zeros(STATES)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    one = np.eye(STATES)
    for step in range(1, rounds + 1):
        field = Field(*parts)
        score = np.where(mask[:, :, None], field.emissions(found)[place], 0.0)
        alpha = np.zeros((steps, rows, STATES))
        alpha[0] = field.starts + score[:, 0]
        for t in range(1, steps):
            ways = alpha[t - 1][:, :, None] + field.moves
            high = ways.max(axis=1)
            now = high + np.log(np.exp(ways - high[:, None]).sum(axis=1)) + score[:, t]
            alpha[t] = np.where(mask[:, t, None], now, alpha[t - 1])
        high = alpha[-1].max(axis=1)
        total = high + np.log(np.exp(alpha[-1] - high[:, None]).sum(axis=1))
        beta, grads = np.zeros((rows, STATES)), [np.zeros_like(p) for p in parts]
        error = np.zeros((rows, steps, STATES))
        for t in range(steps - 1, -1, -1):
            share = np.exp(alpha[t] + beta - total[:, None])
            error[:, t] = np.where(mask[:, t, None], one[gold[:, t]] - share, 0.0)
            if t:
                live = mask[:, t]
                ahead = score[:, t] + beta
                pair = np.exp(alpha[t - 1][:, :, None] + field.moves + ahead[:, None] - total[:, None, None])[live]
                grads[1] += (one[gold[live, t - 1]][:, :, None] * one[gold[live, t]][:, None]).sum(axis=0) - pair.sum(axis=0)
                ways = field.moves + ahead[:, None]
                high = ways.max(axis=2)
                beta = np.where(live[:, None], high + np.log(np.exp(ways - high[:, :, None]).sum(axis=2)), beta)
        grads[2] = error[:, 0].sum(axis=0)
        flat = error[mask]
        for k in range(len(found)):
            np.add.at(grads[0][k], found[k][place[mask]], flat)
        for k, grad in enumerate(grads):
            grad = grad / rows - PENALTY * parts[k]
            first[k] = 0.9 * first[k] + 0.1 * grad
            second[k] = 0.99 * second[k] + 0.01 * grad * grad
            parts[k] = parts[k] + RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Field(*parts)


def labels_of(field: Field, words: Words) -> np.ndarray:
    """The label of every token: those of whole texts, decoded where a token isn't plain."""
    n = len(words.start)
    if not n:
        return np.zeros(0, np.int64)
    scores = field.emissions(features(words))
    rest = scores.copy()
    rest[:, OUTSIDE] = -np.inf
    odd = scores[:, OUTSIDE] - rest.max(axis=1) < MARGIN
    near = np.zeros(n + 1, np.int64)
    reach = field.context()
    owner = words.documents()
    places = np.flatnonzero(odd)
    np.add.at(near, np.maximum(places - reach, words.first[:-1][owner[places]]), 1)
    np.add.at(near, np.minimum(places + reach + 1, words.first[1:][owner[places]]), -1)
    inside = np.cumsum(near[:-1]) > 0
    labels = np.zeros(n, np.int64)
    picked = np.flatnonzero(inside)
    if not len(picked):
        return labels
    cut = np.concatenate([[True], (np.diff(picked) > 1) | (owner[picked[1:]] != owner[picked[:-1]])])
    first = np.append(np.flatnonzero(cut), len(picked))
    opens = picked[first[:-1]] == words.first[:-1][owner[picked[first[:-1]]]]
    labels[picked] = viterbi(field, scores[picked], first, opens)
    return labels


_TRIM = re.compile(r"[A-Za-z0-9+(].*[A-Za-z0-9)]", re.S)


def _plausible(kind: int, text: str) -> bool:
    """Whether a span of the field has what its kind needs, so that look-alikes are left alone."""
    number = digits(text)
    if kind == 0:
        return "@" in text[1:-1]
    if kind == 1:
        return is_ip(text)
    return (16 <= len(number) <= 19 and luhn(number)) if kind == 2 else 8 <= len(number) <= 15


def added_spans(field: Field, words: Words) -> list[tuple[int, int, int, int]]:
    """(document, kind, start byte, end byte in ``words.data``) of the field's spans, trimmed to what belongs to them."""
    labels = labels_of(field, words)
    owner = words.documents()
    out = []
    for i in np.flatnonzero(labels % 2 == 1):
        kind, last = int(labels[i]) // 2, i
        while last + 1 < len(labels) and labels[last + 1] == labels[i] + 1 and owner[last + 1] == owner[i]:
            last += 1
        start, end = int(words.start[i]), int(words.start[last] + words.length[last])
        text = words.data[start:end].tobytes().decode("latin-1")
        if (core := _TRIM.search(text)) and _plausible(kind, core.group()):
            out.append((int(owner[i]), kind, start + core.start(), start + core.end()))
    return out


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans (kind, start, end) that overlap none of ``base``: of the base spans that begin before a span's end,
    the furthest end decides."""
    order = sorted((a, b) for _, a, b in base)
    starts, furthest = [a for a, _ in order], list(accumulate((b for _, b in order), max))
    out = []
    for span in spans:
        before = bisect_left(starts, span[2])
        if not before or furthest[before - 1] <= span[1]:
            out.append(span)
    return out


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added for every row of ``docs``.

    Spans are code points, the end excluded. Base spans always stay; a span of the
    field is added where no base span overlaps it. Null and empty texts have none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for batch in batches:
            column = batch.column("text")
            data, at = text_buffers(column)
            extra: dict[int, list] = {}
            for row, _, words in slices(column, lower=False):
                found = added_spans(shared.value, words)
                # Code points before each byte of the slice, counted once.
                points = np.concatenate([[0], np.cumsum((words.data & 0xC0) != 0x80)]) if found else None
                for owner, kind, start, end in found:
                    first = points[int(at[row + owner] - at[row])]
                    extra.setdefault(row + owner, []).append((kind, int(points[start] - first), int(points[end] - first)))
            numbers, sums, texts, added = [], [], [], []
            for i, value in enumerate(column):
                base = base_spans(value.as_py() or "")
                more = apart(extra.get(i, []), base)
                numbers.append([sum(k == kind for k, _, _ in base) for kind in range(len(KINDS))])
                sums.append(hashlib.sha256(joined(base).encode()).hexdigest())
                texts.append(joined(base + more))
                added.append(len(more))
            table = np.array(numbers, np.int64).reshape(-1, len(KINDS))
            yield pa.record_batch(
                [batch.column("doc_id"), *[pa.array(table[:, k].copy()) for k in range(len(KINDS))], pa.array(sums, pa.string()), pa.array(texts, pa.string()), pa.array(added, pa.int64())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_added"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long",
    )


def op9_personal_data(spark, folder: str) -> DataFrame:
    return find(documents(spark, folder), train(labelled()))
