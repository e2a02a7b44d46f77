"""Hard negatives against plain Python."""

import itertools
import math

import numpy as np
import pytest

from panelstats.llm import negatives


def expected(rows, every, scale=256, k=5, percent=80):
    usable = [(r, i, lab, [math.floor(scale * x) for x in v]) for r, (i, v, lab, *_) in enumerate(rows)
              if i is not None and lab is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for r, i, lab, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other == lab) for s, j, other, w in usable if s != r and len(w) == len(v))
        for p, j, _ in [x for x in scored if x[2]][:k]:
            hard = [(n, m) for n, m, same in scored if not same and percent * -p <= 100 * -n <= 100 * -p][:k]
            out += [(i, j, rank + 1, m, -p, -n) for rank, (n, m) in enumerate(hard)]
    return sorted(out)


def rows_of(seed, count, dim, spread=0.6):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim))
    return [(int(k), [float(x) for x in centres[k % 6] + spread * rng.normal(size=dim)], int(rng.integers(0, 3)), "x") for k in range(count)]


@pytest.fixture(scope="module")
def odd(spark):
    rows = rows_of(3, 300, 9)
    rows += [(k + 300, rows[k][1], k % 3, "x") for k in range(60)]  # ties
    rows += [(1000 + k, rows[0][1], k % 2, "x") for k in range(50)]  # one very common vector
    rows += [(20, rows[20][1], rows[20][2], "x"), (40, rows[41][1], 1, None), (None, rows[0][1], 1, "x"), (400, rows[0][1], None, "x"),
             (420, None, 1, "x"), (440, [float("nan")] * 9, 1, "x"), (460, [1.0, None], 1, "x"), (480, [], 1, "x"), (500, [float("-inf")] * 9, 1, "x"),
             (520, [0.0] * 9, 1, "x"), (540, [1.0, 2.0], 1, "x"), (541, [1.0, 2.0], 1, "x"), (542, [1.0, 1.7], 2, "x"), (560, [5e5] * 9, 0, "x"),
             (561, [4.9e5] * 9, 1, "x"), (562, [4.9e5] * 9, 0, "x"), (580, [1.0], 2, "x")]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, bound string")


@pytest.mark.parametrize("codes, shelf_rows, first_rows, part_rows, pack, sample", [
    (32, 16384, 8192, 4096, 256, 8192), (4, 40, 10, 8, 3, 50), (1, 64, 30, 16, 256, 8192), (7, 30, 1, 4096, 2, 1)])
def test_mining_equals_brute_force(odd, codes, shelf_rows, first_rows, part_rows, pack, sample):
    rows, frame = odd
    got = negatives.mine(frame, "vec_id % 20 = 0", codes=codes, sample_rows=sample, shelf_rows=shelf_rows, first_rows=first_rows,
                         part_rows=part_rows, pack=pack, bunch=2).collect()
    assert sorted(tuple(r) for r in got) == expected(rows, 20)


def test_mining_in_nothing(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(empty, "vec_id % 20 = 0").count() == 0
    one = spark.createDataFrame([(0, [1.0], 1), (1, [1.0], 1)], "vec_id long, embedding array<float>, label int")
    assert negatives.mine(one, "vec_id % 20 = 0").count() == 0  # no other label


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=7), rng.normal(size=5)
    got = list(negatives.cells_by_bound(a, b))
    assert sorted((i, j) for _, i, j in got) == sorted(itertools.product(range(7), range(5)))
    assert all(math.isclose(s, a[i] + b[j]) for s, i, j in got)
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)


def test_bounds_hold_and_visits_stop():
    rng = np.random.default_rng(2)
    matrix = np.floor(256 * (rng.normal(size=(12, 8))[rng.integers(0, 12, 600)] + 0.05 * rng.normal(size=(600, 8))))
    index = negatives.Index({8: (negatives.codebook(matrix[:, :4], 12), negatives.codebook(matrix[:, 4:], 12))}, 12)
    cell, one, two = index.assign(matrix)
    number, at, rows = np.unique(cell, return_inverse=True, return_counts=True)
    far = [np.zeros(len(number)), np.zeros(len(number))]
    np.maximum.at(far[0], at, one)
    np.maximum.at(far[1], at, two)
    index.learn(8, number, rows, *far)
    stopped = 0
    for q in matrix[:40]:
        seen: set = set()
        for done, upto in ((0, 50), (50, 200), (200, 1000)):
            cells, bound = index.visit(q, done, upto)
            assert not seen & set(cells)
            seen |= set(cells)
            rest = ~np.isin(cell, list(seen))
            assert not rest.any() or (matrix[rest] @ q).max() <= bound
            best = np.sort((matrix[~rest] @ q))[::-1]
            stopped += upto < 1000 and len(best) > 5 and best[4] > bound
        assert seen == set(number.tolist()) and bound == -math.inf
    assert stopped > 40  # in clustered data windows are certified early
