"""Running sums, neighbours and what is built on them, with groups that span many ranges."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallybox.operators import evaluation, ordered, reshape
from tallybox.operators import statistics as S


def rows(n, seed, hot=0.9):
    """One group with most rows, some small ones, a null group and null values."""
    r = random.Random(seed)
    return [(None if i % 31 == 0 else "hot" if r.random() < hot else f"g{r.randrange(4)}", r.randrange(50), i, None if i % 17 == 0 else r.randrange(-5, 9)) for i in range(n)]


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_scan_equals_the_plain_loop(spark, parts):
    data = rows(600, parts)
    df = spark.createDataFrame(data, "g string, k int, id int, v int").repartition(5)
    got = ordered.scan(df, ["g"], ["k", "id"], {"run": F.col("v"), "n": F.lit(1)}, {"before": "v", "k0": "k"}, {"after": "v"}, {"all": F.col("v")}, parts)
    assert got.columns == ["g", "k", "id", "v", "run", "n", "before", "k0", "after", "all"]
    want = []
    for g in {d[0] for d in data}:
        own = sorted((d for d in data if d[0] == g), key=lambda d: (d[1], d[2]))
        run = 0
        for i, d in enumerate(own):
            run += d[3] or 0
            want.append((*d, run, i + 1, own[i - 1][3] if i else None, own[i - 1][1] if i else None, own[i + 1][3] if i + 1 < len(own) else None, sum(o[3] or 0 for o in own)))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_a_large_group_lies_in_many_ranges(spark, monkeypatch):
    df = spark.createDataFrame(rows(4_000, 3), "g string, k int, id int, v int")
    seen = {}
    plain = ordered.written
    monkeypatch.setattr(ordered, "written", lambda d, label: seen.setdefault(label, plain(d, label)))
    ordered.scan(df, ["g"], ["k", "id"], {"n": F.lit(1)}, parts=20).count()
    sizes = [r["count"] for r in seen["ranges"].where("g = 'hot'").groupBy(ordered.RANGE).count().collect()]
    assert len(sizes) >= 15 and max(sizes) < 600


def test_scan_of_an_empty_table_and_without_groups(spark):
    df = spark.createDataFrame([], "g string, v int")
    assert ordered.scan(df, ["g"], ["v"], {"n": F.lit(1)}, {"b": "v"}).collect() == []
    three = spark.createDataFrame([(2,), (None,), (1,)], "v int")
    assert sorted(map(tuple, ordered.scan(three, [], ["v"], {"n": F.lit(1)}, parts=3).collect()), key=repr) == [(1, 2), (2, 3), (None, 1)]


def test_dense_ids_number_sources_in_order(spark):
    df = spark.createDataFrame([(s, k) for s in "ba" for k in range(50)], "s string, k int").repartition(7)
    got = {(r["s"], r["k"]): r["id"] for r in reshape.dense_ids(df, "s", ["k"]).collect()}
    assert got == {(s, k): (50 if s == "b" else 0) + k + 1 for s in "ab" for k in range(50)}


def test_weighted_quantiles_equal_the_plain_rule(spark):
    r = random.Random(5)
    data = [("hot" if i % 10 else "few", r.randrange(30) / 4, 0.25 + r.random()) for i in range(300)] + [("one", 3.0, 2.0)]
    probs = (0.0, 0.025, 0.25, 0.5, 0.75, 0.999)
    df = spark.createDataFrame(data, "g string, v double, w double").repartition(6)
    got = {(x["g"], x["p"]): x["value"] for x in S.weighted_quantiles(df, "v", "w", probs, "g").collect()}
    for g in ("hot", "few", "one"):
        own = sorted((v, w) for k, v, w in data if k == g)
        n, mean = len(own), sum(w for _, w in own) / len(own)
        at, run = [], 0.0
        for _, w in own:
            run += w / mean
            at.append(run / (n + 1))
        for p in probs:
            k = next((i for i in range(n) if at[i] >= p), None)
            want = own[-1][0] if k is None else own[0][0] if k == 0 else own[k - 1][0] + (own[k][0] - own[k - 1][0]) * (p - at[k - 1]) / (at[k] - at[k - 1])
            assert abs(got[g, p] - want) < 1e-9


def test_distribution_and_curve(spark):
    df = spark.createDataFrame([("a", v) for v in (1.0, 1.0, 2.0, 5.0)], "g string, v double")
    assert {r["v"]: (r["n"], r["below"]) for r in S.distribution(df, "v", "g").collect()} == {1.0: (2, 0.5), 2.0: (1, 0.75), 5.0: (1, 1.0)}
    d = spark.createDataFrame([("a", 0.9, 1, 1), ("a", 0.9, 2, 0), ("a", 0.1, 3, 1)], "g string, conf double, ann_id int, tp int")
    curve = evaluation.pr_curve(d, spark.createDataFrame([("a", 4)], "g string, n_gt int"), "g").collect()
    assert {r["ann_id"]: (r["recall"], round(r["precision"], 6)) for r in curve} == {1: (0.25, 1.0), 2: (0.25, 0.5), 3: (0.5, 0.666667)}


def plain_smooth(points, fraction):
    """points: (key, x, y) of a group."""
    n, out = len(points), {}
    rank = min(math.ceil(fraction * n) + 1, n)
    for k, x0, y0 in points:
        h = sorted(abs(x - x0) for _, x, _ in points)[rank - 1]
        if h == 0:
            out[k] = y0
            continue
        w = [(1 - (abs(x - x0) / h) ** 3) ** 3 if abs(x - x0) <= h else 0.0 for _, x, _ in points]
        total = lambda f: sum(v * f(x - x0, y) for v, (_, x, y) in zip(w, points, strict=True))  # noqa: B023, E731
        sw, sx, sy, sxx, sxy = total(lambda d, y: 1), total(lambda d, y: d), total(lambda d, y: y), total(lambda d, y: d * d), total(lambda d, y: d * y)
        spread = sxx - sx * sx / sw
        slope = (sxy - sx * sy / sw) / spread if spread else 0.0
        out[k] = sy / sw - slope * sx / sw
    return out


@pytest.mark.parametrize(("fraction", "least"), [(0.3, 5), (0.05, 3), (1.0, 40), (0.3, 256)])
def test_local_regression_equals_the_plain_rule(spark, fraction, least):
    r = random.Random(least)
    data = [("hot" if i % 8 else "few", i, r.choice([r.gauss(0, 1), float(r.randrange(4)), r.expovariate(0.1)]), r.random()) for i in range(260)]
    data += [("one", 900, 1.0, 5.0), *((None, 910 + i, 2.0, float(i)) for i in range(3))]
    df = spark.createDataFrame([*data, ("hot", 990, None, 1.0)], "g string, k int, x double, y double").repartition(4)
    got = {x["k"]: x["smooth"] for x in S.local_regression(df, "x", "y", "k", "g", fraction=fraction, least=least).collect()}
    want = {}
    for g in {d[0] for d in data}:
        want |= plain_smooth([d[1:] for d in data if d[0] == g], fraction)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-6) for k in want)
