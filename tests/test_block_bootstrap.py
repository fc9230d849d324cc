"""Block bootstraps meet rows by chunks; blocks are never spread to rows."""

from collections import Counter

from pyspark.sql import functions as F

from tallybox.operators import resample as R


def by_hand(s, rep):
    """How often each row of a group of s rows is in a replicate."""

    def draw(n, *parts):
        h = 12345
        for p in parts:
            h = (h * 48271 + p * 69621 + 11) % R.PRIME
        for _ in range(2):
            h = h * 48271 % R.PRIME
        return h % n

    blocks = max(1, int(s**0.5 / 2))
    size, taken = s // blocks, Counter()
    for block in range(blocks):
        first = draw(s, rep, block) - draw(size, block, rep)
        taken.update(range(max(0, first), min(s, first + size)))
    return taken


def test_rows_of_blocks_equal_those_by_hand(spark):
    sizes = {"one": 1, "few": 7, "some": 1003}
    df = spark.createDataFrame([(g, 10 * k) for g, s in sizes.items() for k in range(s)], "g string, at long")
    got = Counter((r["g"], r["rep"], r["i"], r["at"]) for r in R.block_bootstrap(df, 3, ["at"], "g").collect())
    assert got == Counter({(g, rep, i, 10 * i): n for g, s in sizes.items() for rep in range(3) for i, n in by_hand(s, rep).items()})


def test_blocks_of_large_groups_stay_few(spark):
    blocks = R.drawn_blocks(spark.createDataFrame([("a", 4_000_000)], "g string, s long"), 5, "g")
    assert blocks.count() <= 5 * 2 * 1000  # 20 million rows when spread
    assert blocks.where("to_ <= from_ OR from_ < 0 OR to_ > 4000000").isEmpty()


def test_joined_blocks_are_not_generated_from_estimates(spark):
    """No row of a plan comes from an explode above the written tables, whose size Spark would guess."""
    df = spark.range(5000).select(F.lit("a").alias("g"), F.col("id").alias("at"))
    plan = R.block_bootstrap(df, 2, ["at"], "g")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
