import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from evstat.llm import spelling
from tests.llm.helpers import SCHEMA, empty_docs, hard_docs, hard_rows

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def edits(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows):
    n = Counter()
    for doc_id, text, *_ in rows:
        for run in RUN.findall(text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 97 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}
    near = {w: [x for x in n if edits(w, x)] for w in n}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def got(df):
    rows = [tuple(r) for r in spelling.variants(df).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def made_up(seed=3, size=4000):
    """Words with typos of typos; one word with a third of all occurrences."""
    rng = random.Random(seed)
    letters = "abcdeé÷ßz"
    base = ["".join(rng.choices(letters, k=rng.randint(4, 9))) for _ in range(60)] + ["commonword"]
    text = []
    for _ in range(size):
        w = "commonword" if rng.random() < 0.33 else rng.choice(base)
        for _ in range(rng.choice([0, 0, 0, 1, 2])):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1:]]) or "x"
        text.append(rng.choice([w, w.upper(), w.capitalize()]))
    text += ["abcdefg"] * 60 + ["abcdefgh"] * 20 + ["abcdefghi"] * 6            # a chain of two steps
    return [(i, " ".join(text[i::40]), None, None, 0) for i in range(40)]


@pytest.mark.parametrize("words, letters", [(400, 4096), (1, 4096), (1, 20)])
def test_against_brute_force(spark, monkeypatch, words, letters):
    """Whatever the blocks: few or many letter sets, one chunk a block or many."""
    monkeypatch.setattr(spelling, "BLOCK_WORDS", words)
    monkeypatch.setattr(spelling, "BLOCK_LETTERS", letters)
    rows = made_up()
    want = brute(rows)
    assert any(r[1] and r[2] != r[1] for r in want)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_hard_rows(spark):
    text = "Straße STRAßE straße Éclair éclair ÉCLAIR abcdé abcdé abcdé abcde abcde abcde abcde abcde abcde×÷ " + "z" * 30_000 + " "
    rows = hard_rows() + [(100 + i, text, "en", "s", 1) for i in range(4)] + [(None, "weird weird weird word1weird", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as word", "2 as n", "3 as id", "4 as run")
    want = brute(rows)
    assert any(len(r[0]) > 20_000 for r in want)
    assert got(df) == want
    assert got(hard_docs(spark)) == brute(hard_rows())
    assert got(empty_docs(spark)) == set()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 12])
def test_blocks_reach_every_edit(n):
    """Key differences of near words are among the listed ones, in one direction, once."""
    sets = [s for s in spelling.letter_sets(1) if s] if n == 1 else None
    sets = sets or _sets(n)
    assert sorted("".join(sets)) == sorted(spelling.LOWER + spelling.ACCENTED)
    weights = spelling._weights(len(sets))
    deltas = spelling._deltas(len(sets))
    assert len(set(deltas)) == len(deltas)
    assert len({d for d in deltas} | {-d % spelling._MOD for d in deltas}) == 2 * len(deltas) - 1
    key = lambda w: sum(weights[next(i for i, s in enumerate(sets) if c in s)] for c in w) % spelling._MOD
    rng = random.Random(n)
    for _ in range(300):
        w = "".join(rng.choices(spelling.LOWER + "éßÿ", k=rng.randint(2, 9)))
        i, c = rng.randrange(len(w)), rng.choice(spelling.LOWER + "éÀ")
        assert (key(w[:i] + c + w[i:]) - key(w)) % spelling._MOD in deltas
        d = (key(w[:i] + c + w[i + 1:]) - key(w)) % spelling._MOD
        assert d in deltas or -d % spelling._MOD in deltas


def _sets(n):
    words = 1
    while len(spelling.letter_sets(words)) < n:
        words *= 2
    return spelling.letter_sets(words)


def test_key_column_names_the_block(spark):
    sets = _sets(5)
    words = ["straße", "aaaa", "zzzzzz", "éé÷", "a" * 5000]
    weights = spelling._weights(5)
    from pyspark.sql import functions as F
    rows = spark.createDataFrame([(w,) for w in words], "word string").select("word", spelling.block_key(F.col("word"), sets).alias("key"))
    for r in rows.collect():
        assert r["key"] == sum(weights[next(i for i, s in enumerate(sets) if c in s)] for c in r["word"]) % spelling._MOD


def test_letter_counts_and_distances():
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdéÿ", k=6)) for _ in range(80)]
    c = spelling.letter_counts(spelling.points("".join(words), 6))
    assert c.sum(1).tolist() == [6] * 80
    i, j = spelling.close_pairs(c, c)
    d = ((c[:, None] - c[None]) ** 2).sum(2)
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == set(zip(*(x.tolist() for x in np.nonzero(d <= 2)), strict=True))
