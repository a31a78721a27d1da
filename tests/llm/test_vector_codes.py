"""Product codes against plain integer k-means over all entries."""

import hashlib
import math
import random
from fractions import Fraction

import numpy as np
import pytest

from loomwatch.llm import vector_codes as vc

SCHEMA = "vec_id long, embedding array<double>, label int, id int, v int, code string"
TOP = (1 << 63) - 1


def near(book, x):
    return min((sum((a - c) ** 2 for a, c in zip(e, x)), k) for k, e in enumerate(book))


def plain(rows, parts=16, entries=64, rounds=2):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    size = -(-dim // parts)
    vectors = []
    for r in kept:
        x = [math.floor(Fraction(c) * 256) for c in r[1]] + [0] * (size * parts - dim)
        vectors.append([x[i * size : (i + 1) * size] for i in range(parts)] if len(r[1]) == dim else None)
    books = [[v[i] for v in vectors[:entries] if v] for i in range(parts)]
    for _ in range(rounds):
        for i in range(parts):
            own = {}
            for v in vectors:
                if v:
                    own.setdefault(near(books[i], v[i])[1], []).append(v[i])
            books[i] = [[sum(c) // len(own[k]) for c in zip(*own[k])] if k in own else e for k, e in enumerate(books[i])]
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, label = [], {}
    for r, v in zip(kept, vectors):
        n = [near(b, x) for b, x in zip(books, v)] if v else None
        error = min(sum(d for d, _ in n), TOP) if v else None
        out.append((r[0], "".join(f"{k:02x}" for _, k in n) if v else None, error, r[2]))
        if v:
            label[r[2]] = label.get(r[2], 0) + error
    return [(a, c, e, min(label[x], TOP) if x in label else None, sha) for a, c, e, x in out]


def gauss(rnd, n, s=1.0):
    return [rnd.gauss(0, s) for _ in range(n)]


def tables():
    rnd = random.Random(1)
    odd = [(k, gauss(rnd, 33, 0.3), k % 3) for k in range(90)]
    odd += [(5, gauss(rnd, 33), None), (5, gauss(rnd, 33), None), (None, gauss(rnd, 33), 1), (7, None, 1), (8, [1.0, None], 1), (9, [float("nan")] * 33, 2), (10, [float("inf")] * 33, 2)]
    odd += [(200, gauss(rnd, 16), 9), (201, [], 9), (202, [1e30] * 33, 1), (203, [-1e300] * 33, 1), (204, gauss(rnd, 33, 1e6), 2)] + [(300 + k, [0.5] * 33, 4) for k in range(50)]
    return {"odd": odd, "few": odd[:5] + odd[-10:], "large first": [(-1, [1e30] * 33, 1), *odd], "empty vector first": [(-1, [], 1), *odd], "none": [],
            "all dropped": [(1, None, 1), (2, [None], 1)], "equal": [(k, [0.25] * 32, 1) for k in range(100)]}


@pytest.mark.parametrize("name", sorted(tables()))
def test_equals_plain(spark, name):
    rows = tables()[name]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA).repartition(5)
    assert sorted(str(tuple(r)) for r in vc.compress(df).collect()) == sorted(map(str, plain(rows)))


def test_float_vectors_and_other_sizes(spark):
    rnd = random.Random(2)
    rows = [(k, np.float32(gauss(rnd, 24, 0.5)).tolist(), k % 2) for k in range(150)]
    df = spark.createDataFrame([(*r, 1, 2, "c") for r in rows], SCHEMA.replace("double", "float"))
    assert sorted(str(tuple(r)) for r in vc.compress(df, 4, 16, 3).collect()) == sorted(map(str, plain(rows, 4, 16, 3)))
    with pytest.raises(ValueError):
        vc.compress(df, 4, 300)


@pytest.mark.parametrize("shift", [0, 3, 6, 9])
def test_cells_keep_every_nearest_entry(shift):
    rnd = np.random.default_rng(7)
    entries = rnd.integers(-300, 300, (40, 3)).tolist() + [[5, 5, 5], [5, 5, 5]]
    parts = np.concatenate((rnd.integers(-400, 400, (500, 3)), np.array([[5, 5, 5], [6, 5, 5]])))
    cells = vc.Cells(entries, shift, most=50)
    for _ in range(2):  # from fresh cells and from known ones
        index, distance = cells.nearest(parts)
        assert [(d, k) for k, d in zip(index.tolist(), distance.tolist())] == [near(entries, x) for x in parts.tolist()]
