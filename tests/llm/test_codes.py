"""op13 against plain squared distances, and its SQL twin through the driver's comparison."""

import hashlib
import random

import numpy as np
import pytest

from clicktrail.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, v string, code int"


@pytest.mark.parametrize("width,size", [(1, 5), (2, 7), (8, 400), (5, 60), (33, 30)])
def test_nearest_is_exact_and_takes_the_first_of_equals(width, size):
    rng = np.random.default_rng(width)
    for spread in (2, 40, codes.largest(width)):
        parts = rng.integers(-spread, spread, (size, width), dtype=np.int64, endpoint=True)
        entries = np.concatenate([rng.integers(-spread, spread, (9, width), dtype=np.int64), parts[:4], parts[:2]])
        plain = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, e)) for e in entries] for p in parts]
        index, distance = codes.nearest(parts, entries)
        assert index.tolist() == [d.index(min(d)) for d in plain] and distance.tolist() == [min(d) for d in plain]


def test_sequency_order():
    rows = codes.transform(np.eye(16, dtype=np.int64)).T
    assert ((rows[:, 1:] != rows[:, :-1]).sum(1) == np.arange(16)).all() and (rows @ rows.T == 16 * np.eye(16)).all()


def brute(rows):
    """The contract step by step, in Python's integers."""
    kept = sorted(((i, [int(np.floor(np.float64(x) * 4096)) for x in e], label) for i, e, label in rows
                   if e is not None and all(x is not None and np.isfinite(x) for x in e)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    n = len(kept[0][1])
    width = -(-n // 8)
    cut = [[(v + [0] * (8 * width - n))[p * width:(p + 1) * width] for p in range(8)] for _, v, _ in kept]
    books = [[c[p] for c in cut[:16]] for p in range(8)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((far(c[p], e), k) for k, e in enumerate(books[p])) for p in range(8)] for c in cut]
    for _ in range(6):
        at = assign()
        for p in range(8):
            for k in range(len(books[p])):
                own = [c[p] for c, a in zip(cut, at) if a[p][1] == k]
                if own:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    sums = {}
    for (_, _, label), a in zip(kept, at):
        sums[label] = sums.get(label, 0) + sum(d for d, _ in a)
    numbers = [x for p in range(8) for e in books[p] for k, x in enumerate(e) if p * width + k < n]
    sha = hashlib.sha256(",".join(map(str, numbers)).encode()).hexdigest()
    return [(i, "".join(f"{k:02x}" for _, k in a), sum(d for d, _ in a), sums[label], sha) for (i, _, label), a in zip(kept, at)]


def test_odd_vectors_against_brute_force(spark):
    rng = random.Random(4)
    vector = lambda n=16: [rng.choice([0.0, 0.5, -0.25, 1.0]) + rng.random() / 50 for _ in range(n)]
    rows = [(i, vector(), rng.choice([1, 2, None])) for i in range(80)]
    rows += [(100, None, 1), (101, vector()[:-1] + [None], 1), (102, vector()[:-1] + [float("nan")], 2), (103, vector()[:-1] + [float("inf")], 2),
             (104, [-1.0] * 16, 3), (105, [-1e-9] * 16, 3), rows[3], rows[3], (None, vector(), None), (-7, rows[5][1], 2)]
    as_float = lambda e: None if e is None else [None if x is None else float(np.float32(x)) for x in e]
    rows = [(i, as_float(e), label) for i, e, label in rows]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    got = codes.compress(df).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:])
    assert sorted(map(tuple, got), key=key) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 12, 24])
def test_few_vectors_and_lengths_that_are_no_multiple(spark, n):
    rng = random.Random(n)
    rows = [(i, [float(np.float32(rng.uniform(-1, 1))) for _ in range(n)], i % 2) for i in range(9)]
    df = spark.createDataFrame([(*r, "x", 1) for r in [*rows, (50, [0.5] * (n + 1), 1), (51, [], 1)]], SCHEMA)
    assert sorted(map(tuple, codes.compress(df).collect())) == sorted(brute(rows))


def test_no_vectors(spark):
    assert codes.compress(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, None, 2, "", 1)], SCHEMA)).collect() == []


def test_large_components_are_held(spark):
    rows = [(i, [1e30 * (-1) ** i] * 64, 1, "x", 1) for i in range(40)] + [(99, [0.0] * 64, 1, "x", 1)]
    got = {r["vec_id"]: r["error"] for r in codes.compress(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 41 and all(0 <= e < 1 << 62 for e in got.values())
