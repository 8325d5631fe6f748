"""Awkward rows and plain references for the operators."""

import re
from collections import defaultdict

import pytest

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard string, kept string"
LONG = " ".join(f"wort{i % 977}" for i in range(30_000))

ODD_TEXTS = [
    None, "", "   \n\t ", "one", "one two", "a b c d e f g h i j", "a b c d e f g h i j k", "A B C D E F G H I J",
    "a b c d e f g h i j", "zeile eins.\nZeile zwei!\n\nZeile drei", "12345 678 ###", "über Straße 🎉 naïve", LONG, LONG + " ende",
    "mail to x.y@mail1.example.com, or 10.0.0.1 or +1 (555) 555-0100.", "don't  stop\r\nnow\x1c\x85\xa0 we'll",
]


def words(text):
    return WORD.findall((text or "").encode().lower())


def row(i, text, lang="en", source="s1"):
    return (i, text, lang, source, len(text or ""), 0.5, "x", "y")


def shingle_set(text, size):
    w = words(text)
    return frozenset(tuple(w[i: i + size]) for i in range(max(1, len(w) - size + 1))) if w else frozenset()


def components(docs, size, percent=80):
    """{doc_id: smallest linked doc_id} by holding every two documents against each other."""
    sets = defaultdict(list)
    for i, text in docs:
        sets[i].append(shingle_set(text, size))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            for one in sets[a]:
                for two in sets[b]:
                    both = len(one & two)
                    if one and two and 100 * both >= percent * (len(one) + len(two) - both):
                        x, y = find(a), find(b)
                        parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns named like results."""
    rows = [row(i, t, ["en", "de", None][i % 3], [None, "a", "b", ""][i % 4]) for i, t in enumerate(ODD_TEXTS)]
    rows += [row(5, ODD_TEXTS[5]), row(5, ODD_TEXTS[5]), row(7, "another text with this id"), (None,) * 8, (None, "text without an id", *[None] * 6)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
