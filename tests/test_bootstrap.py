"""Bootstraps by hashed Poisson counts against plain sums, and what they should come to."""

import hashlib
import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tallybox.functions.normal import normal_cdf, normal_quantile
from tallybox.operators import resample
from tallybox.operators import statistics as S


def unit(key, rep):
    return int(hashlib.md5(f"{key}#{rep // 4}".encode()).hexdigest()[8 * (rep % 4) : 8 * (rep % 4) + 8], 16) / 2**32


def count(u, mean):
    p = c = math.exp(-mean)
    n = 0
    while u >= c and n < 1_000:
        n += 1
        p *= mean / n
        c += p
    return n


@pytest.fixture(scope="module")
def sample(spark):
    r = random.Random(2)
    data = [("hot" if i % 10 else "few", i, r.gauss(1, 1), None if i % 41 == 0 else r.random() * 3) for i in range(400)] + [("none", 900, 1.0, 0.0), (None, 901, 2.0, 1.0)]
    return data, spark.createDataFrame(data, "g string, i int, v double, w double").repartition(7)


@pytest.mark.parametrize("weighted", [False, True])
def test_replicates_equal_the_plain_sums(sample, weighted):
    data, df = sample
    got = resample.replicate_sums(df, F.col("i"), 10, {"s": F.col("v"), "n": F.lit(1)}, "g", weight=F.col("w") if weighted else None).collect()
    kept = [d for d in data if not weighted or d[3] is not None]
    weight = lambda d: d[3] if weighted else 1.0
    want = {}
    for g in {d[0] for d in kept}:
        own = [d for d in kept if d[0] == g]
        total = sum(map(weight, own))
        for rep in range(10 if total else 0):
            n = [count(unit(d[1], rep), len(own) * weight(d) / total) if weight(d) else 0 for d in own]
            want[g, rep] = (sum(k * d[2] for k, d in zip(n, own, strict=True)), sum(n))
    assert {(r["g"], r["rep"]) for r in got} == set(want)
    assert all(r["n"] == want[r["g"], r["rep"]][1] and r["s"] == pytest.approx(want[r["g"], r["rep"]][0]) for r in got)


@pytest.mark.parametrize("mean", [0.0, 0.01, 1.0, 7.5, 120.0, 499.0, 2_000.0])
def test_counts_have_the_mean_and_the_spread_of_poisson(spark, mean):
    u = spark.range(20_000).select(resample._unit(resample._digest(F.col("id"), F.lit(0)), 1).alias("u"))
    n = u.select(resample.poisson(F.col("u"), F.lit(mean)).alias("n")).agg(F.avg("n"), F.var_samp("n")).first()
    assert n[0] == pytest.approx(mean, abs=5 * math.sqrt(mean / 20_000) + 1e-9) and n[1] == pytest.approx(mean, rel=0.06, abs=1e-3)


def test_the_spread_of_replicates_is_that_of_the_mean(sample):
    _, df = sample
    b = resample.replicate_sums(df.where("g = 'hot'"), F.col("i"), 400, {"s": F.col("v"), "n": F.lit(1)}, "g").select("g", (F.col("s") / F.col("n")).alias("estimate"))
    y = df.where("g = 'hot'").groupBy("g").agg(F.avg("v").alias("y"), (F.stddev_samp("v") / F.sqrt(F.count("*"))).alias("se"))
    se = y.first()["se"]
    assert b.agg(F.stddev_samp("estimate")).first()[0] == pytest.approx(se, rel=0.15)
    got = S.bca_interval(b, y.select("g", "y"), "g").first()
    assert got["ymin"] < got["y"] < got["ymax"] and 3 * se < got["ymax"] - got["ymin"] < 5 * se
    assert got["pval"] == pytest.approx(1 / 401)


def test_interval_equals_the_plain_formula(spark):
    r = random.Random(8)
    e = [r.expovariate(1) - 0.2 for _ in range(301)]
    got = S.bca_interval(spark.createDataFrame([("g", x) for x in [*e, None]], "g string, estimate double"), spark.createDataFrame([("g", 0.5)], "g string, y double"), "g").first()
    normal, m = NormalDist(), sum(e) / len(e)
    z = normal.inv_cdf(sum(x < m for x in e) / len(e))
    a = sum((m - x) ** 3 for x in e) / (6 * sum((m - x) ** 2 for x in e) ** 1.5)
    for name, p in (("ymin", 0.025), ("ymax", 0.975)):
        q = normal.cdf(z + (z + normal.inv_cdf(p)) / (1 - a * (z + normal.inv_cdf(p)))) * 300
        s = sorted(e)
        k = int(q)
        assert got[name] == pytest.approx(s[k] + (s[min(k + 1, 300)] - s[k]) * (q - k), rel=0.02)
    signs = [sum(x < 0 for x in e), sum(x > 0 for x in e)]
    assert got["y"] == 0.5 and got["pval"] == pytest.approx((301 - max(signs) + 1) / 302)


def test_normal_distribution(spark):
    p = [0.001, 0.025, 0.3, 0.5, 0.8, 0.999]
    rows = spark.createDataFrame([(x,) for x in p], "p double").select("p", normal_quantile(F.col("p")).alias("z"), normal_cdf(normal_quantile(F.col("p"))).alias("q")).collect()
    assert all(r["z"] == pytest.approx(NormalDist().inv_cdf(r["p"]), abs=4.6e-4) and r["q"] == pytest.approx(NormalDist().cdf(r["z"]), abs=2e-7) for r in rows)
