"""Principal coordinates against numpy's eigenvectors of the whole centred matrix."""

import numpy as np
import pytest

from tallybox.operators import coordinates


def plain(d):
    n = len(d)
    j = np.eye(n) - 1 / n
    e, u = np.linalg.eigh(-0.5 * j @ (d**2) @ j)
    return e[::-1], u[:, ::-1]


def frame(spark, d):
    n = len(d)
    return spark.createDataFrame([(f"n{a}", f"n{b}", float(d[a, b])) for a in range(n) for b in range(n) if a != b], "a string, b string, d double")


@pytest.mark.parametrize(("n", "dims", "k"), [(30, 3, 5), (6, 9, 8), (2, 1, 8)])
def test_coordinates_equal_numpy(spark, n, dims, k):
    x = np.random.default_rng(n).normal(0, 1, (n, dims)) * 2.0 ** -np.arange(dims)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rows, values = coordinates.principal_coordinates(frame(spark, d), k)
    e, u = plain(d)
    m = min(n - 1, dims, k)
    assert [v["axis"] for v in values] == list(range(1, m + 1))
    assert np.allclose([v["eigenvalue"] for v in values], e[:m], rtol=1e-6)
    assert np.allclose([v["relative_eig"] for v in values], e[:m] / e.sum(), rtol=1e-6)
    got = np.zeros((n, m))
    for r in rows.collect():
        got[int(r["node"][1:]), r["axis"] - 1] = r["coordinate"]
    want = u[:, :m] * np.sqrt(e[:m])
    want *= np.where(want.max(axis=0) >= -want.min(axis=0), 1, -1)
    got = got if n > 2 else np.abs(got)  # two nodes lie equally far on either side
    assert np.abs(got - (want if n > 2 else np.abs(want))).max() < 1e-6 * np.abs(want).max()
    if dims <= k and n > 2:  # all of the distances
        assert np.allclose(np.sqrt(((got[:, None] - got[None]) ** 2).sum(axis=2)), d, atol=1e-6)


def test_distances_of_no_space_have_negative_values_left_out(spark):
    d = np.array([[0, 1, 1, 9], [1, 0, 1, 1], [1, 1, 0, 1], [9, 1, 1, 0]], float)
    rows, values = coordinates.principal_coordinates(frame(spark, d))
    e, _ = plain(d)
    assert np.allclose([v["eigenvalue"] for v in values], e[e > 1e-9]) and e.min() < -1
    assert np.allclose([v["relative_eig"] for v in values], e[e > 1e-9] / e.sum())


def test_stick_and_small_tables(spark):
    assert np.allclose(coordinates.broken_stick(3), [11 / 18, 5 / 18, 2 / 18])
    rows, values = coordinates.principal_coordinates(frame(spark, np.zeros((3, 3))))
    assert rows.count() == 0 and values == []
    assert coordinates.principal_coordinates(frame(spark, np.zeros((1, 1))))[1] == []
