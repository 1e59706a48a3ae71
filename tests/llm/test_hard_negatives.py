import math
import random

import numpy as np

from evstat.llm import hard_negatives as hn


def brute(rows, step=100, k=5, m=10):
    first = {}
    for i, v, y in rows:
        if i is None or y is None or not v or any(c is None or not math.isfinite(c) for c in v):
            continue
        key = (y, [float(c) for c in v])
        first[i] = min(first.get(i, key), key)
    ok = {i: (y, [math.floor(256 * float(np.float32(c))) for c in v]) for i, (y, v) in first.items()}
    out = set()
    for a, (ya, va) in ok.items():
        if a % step:
            continue
        s = sorted((-sum(p * q for p, q in zip(va, vx, strict=True)), x, yx) for x, (yx, vx) in ok.items()
                   if x != a and len(vx) == len(va))
        for ps, pid, _ in [r for r in s if r[2] == ya][:k]:
            neg = [r for r in s if r[2] != ya and 30 * -ps <= 100 * -r[0] <= 90 * -ps][:m]
            out |= {(a, pid, n + 1, r[1], -ps, -r[0]) for n, r in enumerate(neg)}
    return out


def got(df):
    rows = [tuple(r) for r in hn.hard_negatives(df, lambda i: i % 100 == 0).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_against_brute_force(spark, monkeypatch):
    """Several groups, parts and blocks; a label with a third of the rows, copies and ties."""
    rng = random.Random(5)
    rows = []
    for i in range(900):
        v = [rng.choice([-1.0, 0.0, 0.5, 1.0, 1.25]) for _ in range(6)] if i % 3 else [1.0, 0.5, 0.0, 0.0, 0.25, 0.5]
        rows.append((i, v, 0 if i % 3 == 0 else rng.randrange(6)))
    for name, value in (("GROUP", 3), ("PART", 200), ("BLOCK", 16)):
        monkeypatch.setattr(hn, name, value)
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == brute(rows)


def test_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (1, [1.0, 1.0], 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 3), (3, [0.5, 0.5], 3), (4, None, 1), (5, [], 1),
            (6, [None, 1.0], 2), (7, [nan, 1.0], 2), (8, [inf, 1.0], 2), (None, [1.0, 1.0], 1), (9, [1.0, 1.0], None), (10, [0.0, 0.0], 1),
            (100, [0.0, 0.0], 1), (200, [1.0, 2.0, 3.0], 1), (11, [1.0, 2.0, 2.5], 2), (12, [1.0, 2.0, 3.0], 1), (300, [-1.0, -1.0], 7),
            (13, [0.4, 0.2], 7), (14, [0.75, 0.25], 2), (14, [0.25, 0.75], 1)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "2 as grp", "3 as part", "4 as v")
    want = brute(rows)
    assert {a for a, *_ in want} == {0, 100, 200}
    assert got(df) == want
    assert got(df.limit(0)) == set()


def test_large_components_are_exact(spark):
    big = [2.0 ** 21, 2.0 ** 21, 1.0, 3.0]
    rows = [(0, big, 1), (1, [x + (j == 2) for j, x in enumerate(big)], 1), (2, [2.0 ** 20, 2.0 ** 20, 3.0, 1.0], 2), (3, [2.0 ** 20, 2.0 ** 20, 3.0, 1.25], 2)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == brute(rows) != set()
    huge = np.array([[2.0 ** 40, 1.0], [2.0 ** 41, 3.0]])
    assert hn.integer_scores(huge, huge).tolist() == [[min(2 ** 80 + 1, hn.LONG), hn.LONG], [hn.LONG, hn.LONG]]


def test_bounds_hold_every_score():
    rng = np.random.default_rng(1)
    for dim in (1, 2, 3, 17):
        v = np.floor(256 * rng.standard_normal((200, dim)) * rng.choice([0, 1, 1000], (200, 1)))
        v[:20] = v[20:40]
        refs = hn.reference_directions({dim: rng.standard_normal((30, dim))}, dim)
        ang, n = hn.angles(v, refs), hn.norms(v)
        low, high = hn.score_bounds(ang, n, ang, n)
        s = hn.integer_scores(v, v)
        assert (low <= s).all() and (s <= high).all()


def _block(ids, labels, v, refs, positives=None):
    row = hn._record(v.shape[1], v, ids, labels, refs, positives)
    return hn.Block(dict(zip([c.split()[0] for c in hn._BLOCK.split(", ")], row, strict=True)))


def test_bounds_skip_most_pairs_of_clustered_rows():
    """Rows in 12 tight clusters: once the lists are full, few rows are scored; the result is the plain one."""
    rng = np.random.default_rng(2)
    centre = rng.standard_normal((12, 32))
    of = rng.integers(0, 12, 4000)
    v = np.floor(256 * (centre[of] + 0.05 * rng.standard_normal((4000, 32))))
    labels = rng.integers(0, 3, 4000)
    refs = hn.reference_directions({32: v[:64]}, 32)
    ids = np.arange(4000)
    a = _block(ids[:50], labels[:50], v[:50], refs)
    task = hn.Positives(a, 5)
    seen = sum(task.see(_block(ids[i:i + 512], labels[i:i + 512], v[i:i + 512], refs)) for i in range(0, 4000, 512))
    same = int(sum((labels == y).sum() for y in labels[:50]))
    assert seen < 0.35 * same
    rows = task.result()
    for n in range(50):
        s = v @ v[n]
        best = sorted((-s[j], j) for j in ids if j != n and labels[j] == labels[n])[:5]
        assert [(-x, y) for x, y in zip(rows[2][rows[0] == n].tolist(), rows[3][rows[0] == n].tolist(), strict=True)] == best
