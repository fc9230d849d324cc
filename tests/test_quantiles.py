"""Quantiles by bracketing against sorted lists, whatever the data look like."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybox.operators import quantiles
from tallybox.operators import statistics as S

PROBS = (0.0, 0.025, 0.25, 0.5, 0.75, 0.975, 1.0)


def plain(values):
    s = sorted(values)
    out = []
    for p in PROBS:
        at = p * (len(s) - 1)
        k = int(at)
        out.append(s[k] + (s[min(k + 1, len(s) - 1)] - s[k]) * (at - k))
    return out


@pytest.mark.parametrize(("bins", "few"), [(64, 20), (1_024, 10_000)])
def test_quantiles_equal_those_of_sorted_values(spark, bins, few):
    r = random.Random(bins)
    groups = {
        "even": [r.random() for _ in range(700)], "ties": [r.randrange(3) for _ in range(400)], "one": [4.0], "two": [1.0, 2.0], "same": [7.0] * 300,
        "steep": [10.0 ** r.randrange(-9, 9) for _ in range(200)], "signs": [r.choice([-1, 1]) * 2.0 ** r.randrange(40) for _ in range(200)], None: [1.0, 5.0, 9.0],
        "near": [1.0 + k * 2.0**-52 for k in range(150)], "ends": [-1.7e308, 1.7e308, *range(100)],
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("even", float("nan")), ("nothing", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(5)
    got = {x["g"]: (x["n"], x["q"]) for x in quantiles.exact_quantiles(df, "v", PROBS, "g", bins=bins, few=few).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        assert got[g][0] == len(vs) and np.allclose(got[g][1], plain(list(map(float, vs))), rtol=1e-12, atol=0)


def test_most_rows_in_one_group_are_never_ranked_together(spark, monkeypatch):
    df = spark.range(30_000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("hot").alias("g"), F.pow(F.col("id") % 9_973, F.lit(3)).cast("double").alias("v"))
    seen = []
    plain_written = quantiles.written
    monkeypatch.setattr(quantiles, "written", lambda d, label: seen.append((label, plain_written(d, label))) or seen[-1][1])
    got = {x["g"]: x["q"] for x in quantiles.exact_quantiles(df, "v", PROBS, "g", bins=64, few=100).collect()}
    rows = df.toPandas()
    for g, q in got.items():
        assert np.allclose(q, np.quantile(rows[rows.g == g].v, PROBS))
    last = [d for label, d in seen if label == "brackets"][-1]
    assert last.where("lo < hi").agg(F.max("inside")).first()[0] <= 100 and 2 <= sum(label == "brackets" for label, _ in seen) < 12


def test_infinite_values_and_empty_tables(spark):
    df = spark.createDataFrame([(float("inf"),), (float("-inf"),), (3.0,)], "v double")
    assert quantiles.exact_quantiles(df, "v", (0.0, 0.5, 1.0)).first()["q"] == [-quantiles.LARGEST, 3.0, quantiles.LARGEST]
    assert quantiles.exact_quantiles(df.where("v = 9"), "v", (0.5,)).count() == 0


def test_summary_and_outliers(spark):
    df = spark.createDataFrame([("a", float(v)) for v in [*range(20), 500]], "g string, v double")
    r = S.quantile_summary(df, "v", "g").first()
    assert r["mean"] == pytest.approx(690 / 21) and (r["q1"], r["median"], r["q3"]) == (5.0, 10.0, 15.0)
    assert [x["v"] for x in S.outlier_flag(df, "v", "g").where("outlier").collect()] == [500.0]
