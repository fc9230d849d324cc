"""Splits, samples, oversampling and bootstraps, all repeatable: draws are integer hashes, never rand()."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybox.functions.normal import normal_quantile
from tallybox.operators.ordered import scan
from tallybox.operators.work import written

PRIME = 2147483647


def draw(n: Column, *parts: Column) -> Column:
    """An integer in [0, n) from integer parts."""
    h = F.lit(12345).cast("bigint")
    for p in parts:
        h = (h * 48271 + p.cast("bigint") * 69621 + 11) % PRIME
    for _ in range(2):
        h = (h * 48271) % PRIME
    return h % n


def draw_sql(n: str, *parts: str) -> str:
    h = "12345::BIGINT"
    for p in parts:
        h = f"(({h}) * 48271 + ({p})::BIGINT * 69621 + 11) % {PRIME}"
    for _ in range(2):
        h = f"(({h}) * 48271) % {PRIME}"
    return f"(({h}) % ({n}))"


def content_share(content: Column) -> Column:
    """The first 16 bits of the md5 sum over 65535."""
    return F.conv(F.substring(F.md5(content), 1, 4), 16, 10).cast("double") / 65535


def content_split(content: Column, p: float = 0.15) -> Column:
    return F.when(content_share(content) < p, "val").otherwise("train")


def _digest(key: Column, block: Column) -> Column:
    return F.md5(F.concat_ws("#", key, block.cast("string")))


def _unit(digest: Column, k: int) -> Column:
    """The k-th of four numbers in [0, 1) from a digest."""
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0


#: Chances that a Poisson count of mean 1 is at most 0, 1, ...; what is beyond the last has no place among 2^32 draws.
POISSON = tuple(math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1)) for k in range(13))


def poisson(u: Column, mean: Column | None = None) -> Column:
    """The Poisson count (mean 1 by default) at which the distribution reaches u, by its terms one after the other.

    Means above 500 are rounded normal variates, whose difference from Poisson counts is far below that of two draws.
    """
    if mean is None:
        return sum((u >= c).cast("int") for c in POISSON)
    first = F.exp(-mean)
    terms = F.sequence(F.lit(1), F.ceil(mean + 10 * F.sqrt(mean) + 20).cast("int"))
    # up: the chance of the count so far; n stays once u is below it
    step = lambda s, k: F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), (s["n"] + (u >= s["c"]).cast("int")).alias("n"))
    small = F.aggregate(terms, F.struct(first.alias("p"), first.alias("c"), F.lit(0).alias("n")), step, lambda s: s["n"])
    return F.when(mean <= 0, 0).when(mean <= 500, small).otherwise(F.greatest(F.lit(0), F.floor(mean + F.sqrt(mean) * normal_quantile(F.greatest(u, F.lit(1e-10))) + 0.5).cast("int")))


def replicate_sums(df: DataFrame, key: Column, replicates: int, values: dict[str, Column], *by: str, weight: Column | None = None) -> DataFrame:
    """(by, rep, values): sums of the values over bootstrap replicates of every group.

    A replicate takes each row a Poisson number of times with mean 1, drawn from a hash of the
    row's key and the replicate, which is what many draws with replacement come to for each
    row. So a replicate is a sum that tasks add up where the rows lie: no slots to draw for,
    no numbering and no join, whatever the size of a group, and rows of one key are drawn
    together. Four replicates share a hash.

    weight: rows are drawn in proportion to it, with the mean n * weight / (the group's weight);
    rows with a null weight, and groups without weight, are left out.
    """
    rows = df
    if weight is not None:
        rows = df.withColumn("w_", weight.cast("double")).where("w_ IS NOT NULL")
        scale = rows.groupBy(*(F.col(c).alias(f"k_{c}") for c in by)).agg(F.try_divide(F.count("*"), F.sum("w_")).alias("per_")).where("per_ IS NOT NULL")
        same = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"k_{c}")), by, F.lit(True))
        rows = rows.join(scale, same).drop(*(f"k_{c}" for c in by))
    rows = rows.select(*by, key.cast("string").alias("key_"), (F.col("w_") * F.col("per_")).alias("mean_") if weight is not None else F.lit(None).cast("double").alias("mean_"), *(c.alias(f"v_{n}") for n, c in values.items()))
    blocks = rows.withColumn("block_", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    mean = None if weight is None else F.col("mean_")
    # step by step: each is used more than once in the next
    drawn = blocks.withColumn("digest_", _digest(F.col("key_"), F.col("block_")))
    drawn = drawn.withColumns({f"u{k}_": _unit(F.col("digest_"), k) for k in range(4)})
    drawn = drawn.withColumns({f"n{k}_": poisson(F.col(f"u{k}_"), mean) for k in range(4)})
    sums = drawn.groupBy(*by, "block_").agg(*(F.sum(F.col(f"n{k}_") * F.col(f"v_{n}")).alias(f"s{k}_{n}") for k in range(4) for n in values))
    each = F.explode(F.array(*(F.struct((F.col("block_") * 4 + k).alias("rep"), *(F.col(f"s{k}_{n}").alias(n) for n in values)) for k in range(4))))
    return sums.select(*by, each.alias("e")).select(*by, "e.*").where(F.col("rep") < replicates)


def replicate_sql(rows: str, key: str, replicates: int, values: dict[str, str], *by: str, mean: str | None = None) -> str:
    """The same as a query over a table expression; mean: of each row's Poisson count, small."""
    u = f"('0x' || substr(md5(concat_ws('#', ({key})::VARCHAR, (rep // 4)::VARCHAR)), 8 * (rep % 4) + 1, 8))::BIGINT / 4294967296.0::DOUBLE"
    keys = ", ".join(by)
    if mean is None:
        n = "(" + " + ".join(f"(u >= {c!r}::DOUBLE)::INT" for c in POISSON) + ")"
    else:
        n = "list_sum(list_transform(range(0, 60), lambda k: (u >= exp(-mean_) * list_sum(list_transform(range(0, k + 1), lambda j: pow(mean_, j) / gamma(j + 1))))::INT))"
    drawn = f"SELECT *, {u} AS u FROM (SELECT *, unnest(range(0, {replicates}))::INT AS rep FROM (SELECT *{f', {mean} AS mean_' if mean else ''} FROM {rows}))"
    return f"SELECT {keys}, rep, {', '.join(f'sum(n_ * ({v})) AS {c}' for c, v in values.items())} FROM (SELECT *, {n} AS n_ FROM ({drawn})) GROUP BY {keys}, rep"


def outcome_bootstrap(matches: DataFrame, replicates: int, *by: str) -> DataFrame:
    """(by, rep, tp, fp, fn) of bootstrap replicates of the rows of a match table."""
    is_ = lambda k: (F.col("result") == k).cast("bigint")
    return replicate_sums(matches, F.concat_ws(":", "idx_1", "idx_2"), replicates, {"tp": is_("TP"), "fp": is_("FP"), "fn": is_("FN")}, *by)


def drawn_blocks(sizes: DataFrame, replicates: int, *by: str) -> DataFrame:
    """(by, rep, from_, to_, chunk_): the blocks of groups of ``s`` rows, a row for each chunk of ``size`` rows that a block touches (two at most)."""
    s = sizes.withColumn("blocks", F.greatest(F.lit(1), F.floor(F.sqrt("s") / 2)).cast("bigint")).withColumn("size", _block_size())
    b = s.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    first = draw(F.col("s"), F.col("rep"), F.col("block")) - draw(F.col("size"), F.col("block"), F.col("rep"))
    b = b.withColumn("first", first).withColumn("from_", F.greatest(F.lit(0).cast("bigint"), F.col("first"))).withColumn("to_", F.least(F.col("s"), F.col("first") + F.col("size")))
    return b.withColumn("chunk_", F.explode(F.sequence(F.expr("from_ div size"), F.expr("(to_ - 1) div size")))).select(*by, "rep", "from_", "to_", "chunk_")


def _block_size() -> Column:
    return F.floor(F.col("s") / F.greatest(F.lit(1), F.floor(F.sqrt("s") / 2))).cast("bigint")


def block_bootstrap(df: DataFrame, replicates: int, order: list, *by: str) -> DataFrame:
    """max(1, floor(sqrt(s) / 2)) blocks of s // blocks rows around drawn starts, cut to the range.

    Blocks are never spread to their rows: a row meets the blocks that touch its chunk. The
    blocks, about as many as the root of the rows, are written, so that Spark knows their size.
    """
    rows = written(scan(df, list(by), order, {"i": F.lit(1).cast("bigint")}, totals={"s": F.lit(1).cast("bigint")}).withColumn("i", F.col("i") - 1), "block-rows")
    blocks = written(drawn_blocks(rows.groupBy(*by).agg(F.count("*").alias("s")), replicates, *by), "blocks")
    met = rows.withColumn("size", _block_size()).withColumn("chunk_", F.expr("i div size")).drop("s", "size").join(blocks, [*by, "chunk_"])
    return met.where("i >= from_ AND i < to_").drop("chunk_", "from_", "to_")


def oversampled(df: DataFrame, weight: str, target: int, rounds: int = 10) -> DataFrame:
    """``df`` with ``copies``: half-even weights of at least 1, rescaled to within 1 % of a target sum.

    Each round needs one number, the sum, from the cluster.
    """
    own = F.greatest(F.bround(weight).cast("bigint"), F.lit(1))
    for _ in range(rounds):
        total = df.agg(F.sum(own)).first()[0]
        if total is None or abs(total - target) / target < 0.01:
            break
        own = F.greatest(F.bround(own * F.lit(float(target)) / F.lit(float(total))).cast("bigint"), F.lit(1))
    return df.withColumn("copies", own)


def repeated(df: DataFrame, copies: Column) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), copies.cast("int"))))


def first_per_group(df: DataFrame, k: int, order: list, *by: str) -> DataFrame:
    return df.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("r_") <= k).drop("r_")


def hashed_order(key: Column) -> Column:
    return F.md5(key.cast("string"))


def two_level_sample(df: DataFrame, groups: int, k: int, by: str, key: str) -> DataFrame:
    """Some groups by hash order, then some rows of each by hash order."""
    chosen = df.select(by).distinct().orderBy(hashed_order(F.col(by)), by).limit(groups)
    return first_per_group(df.join(F.broadcast(chosen), by, "left_semi"), k, [hashed_order(F.col(key)), key], by)


def equal_quota(df: DataFrame, most: int, by: str) -> DataFrame:
    """(by, n, taken): the smallest equal quota with which at least ``most`` rows are taken in all.

    The quota starts at the whole share of a group and rises by one; with groups by
    rising size, what a quota takes is a running sum, so no trial is needed.
    """
    sizes = df.groupBy(by).agg(F.count("*").alias("n"))
    w, every = Window.orderBy("n", by), Window.partitionBy()
    total, groups = F.sum("n").over(every), F.count("*").over(every)
    left = F.lit(most) - F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    behind = groups - F.row_number().over(w) + 1
    need = F.ceil(left / behind)  # the quota if this and all larger groups are cut; the first that is cut has the largest
    sized = sizes.withColumn("need", need).withColumn("total", total).withColumn("groups", groups)
    quota = F.when(F.col("total") <= most, F.max("n").over(every)).otherwise(F.greatest(F.max(F.when(F.col("need") <= F.col("n"), F.col("need"))).over(every), F.floor(F.lit(most) / F.col("groups"))))
    return sized.withColumn("quota", quota).select(by, "n", F.least("n", "quota").alias("taken"))
