import numpy as np
import pytest

from willowfold.llm import multi_index


def plain(rows, threshold=0.98):
    """rows of (vec_id, label, vector or None): {position: (links, component)} by comparing all pairs."""
    n = len(rows)
    links, label = [0] * n, list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    def good(v):
        return v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v)

    for i in range(n):
        for j in range(i):
            (a, la, x), (b, lb, y) = rows[i], rows[j]
            if la is None or la != lb or a is None or b is None or not good(x) or not good(y) or len(x) != len(y):
                continue
            x, y = np.array(x, float), np.array(y, float)
            if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                p, q = find(i), find(j)
                if p != q:
                    low, high = (p, q) if rows[p][0] <= rows[q][0] else (q, p)
                    label[high] = low
    return [(rows[i][0], links[i], rows[find(i)][0]) for i in range(n)]


SCHEMA = "vec_id long, embedding array<double>, label int, rep long, cell int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, 5, 6) for i, label, v in rows], SCHEMA)


def clumps(dim, n, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for label in (0, 1):
        centres = rng.standard_normal((40, dim))
        for i in range(n):
            v = centres[min(i % 60, 39)] + rng.standard_normal(dim) * rng.choice([0, 0.05, 0.12, 1])
            rows.append((len(rows), label, np.round(v, 3).tolist()))
    return rows


@pytest.mark.parametrize(("dim", "cell_rows"), [(16, 16), (6, 8192)])
def test_all_links_are_found_with_recall_one(spark, dim, cell_rows):
    rows = clumps(dim, 240)
    got = multi_index.near_vectors(frame(spark, rows), recall=1.0, cell_rows=cell_rows).collect()
    want = plain(rows)
    assert sum(n for _, n, _ in want) > 300
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == sorted(want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_target_recall_is_reached(spark):
    rows = clumps(16, 500, seed=5)
    links = sum(n for _, n, _ in plain(rows))
    found = sum(r.n_links for r in multi_index.near_vectors(frame(spark, rows)).collect())
    assert 0.998 * links <= found <= links


def test_visits_are_the_cells_within_the_radius(spark):
    rng = np.random.default_rng(1)
    points = multi_index.unit(rng.standard_normal((300, 8)))
    grid = multi_index.Grid(points[:9, :4], points[:7, 4:], 0.4)
    a, b = grid.bounds(points)
    home = grid.home(points)
    bound = (a[:, :, None] + b[:, None, :]).reshape(len(points), -1)
    assert (bound[np.arange(len(points)), home] == 0).all()
    cells = np.arange(63)
    want = {(i, c) for i in range(len(points)) for c in cells if c > home[i] and bound[i, c] <= 0.16}
    row, cell = grid.visits(points)
    assert len(row) == len(want) and set(zip(row.tolist(), cell.tolist(), strict=True)) == want
    # no point that lives in a cell is nearer than the bound
    apart = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    assert (bound[:, home] <= apart + 1e-9).all()


def test_rows_of_one_id_have_their_own_links(spark):
    rows = [(1, 0, [1, 0]), (1, 0, [0, 1]), (2, 0, [1, 0.01]), (3, 0, [0.01, 1])]
    got = multi_index.near_vectors(frame(spark, rows)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in got) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, 0, [1, 0, 0]), (2, 0, [2, 0, 0]), (2, 0, [2, 0, 0]), (3, 0, None), (4, 0, []), (5, 0, [0, 0, 0]), (6, 0, [1, None, 0]), (7, 0, [1, nan, 0]), (8, 0, [1, inf, 0])]
    rows += [(9, None, [1, 0, 0]), (10, 1, [1, 0, 0]), (11, 0, [1, 0]), (None, 0, [1, 0, 0]), (12, 0, [-1, 0, 0]), (13, 1, [1e300, 1e-300, 0]), (14, 2, [3]), (15, 2, [4])]
    got = multi_index.near_vectors(frame(spark, rows)).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str) == sorted([(1, 2, 1), (2, 2, 1), (2, 2, 1), *[(i, 0, i) for i in (3, 4, 5, 6, 7, 8, 9, 11, 12)], (10, 1, 10), (13, 1, 10), (None, 0, None), (14, 1, 14), (15, 1, 14)], key=str)
    assert multi_index.near_vectors(frame(spark, [])).count() == 0
