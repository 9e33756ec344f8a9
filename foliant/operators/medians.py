"""Exact medians of groups of any size.

Groups of at most `many` rows are small enough for an aggregate that holds their values. Of larger ones a mergeable sketch gives
two values around the median (its rank error is at most 1 / accuracy, the values are twice that away), a second pass counts
what is below them and keeps how often each value between them occurs, and there the median is counted out. So no task holds
more of a group than some 4 / accuracy of its distinct values, or their counts where values repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.streaming.paths import held


def _finite(c: str) -> Column:
    v = F.col(c).cast("double")
    return F.when(~F.isnan(v), v)


def _matched(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """An equi join that lets null keys meet; the right side's keys go."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(named, same, how).drop(*(f"_r_{k}" for k in keys))


def medians(rows: DataFrame, key: str, columns: Sequence[str], many: int = 100_000, accuracy: int = 100_000) -> DataFrame:
    """key and the median of each column (double), nulls and NaN left out; null where nothing is left. A null key is a group. Two
    middle values are averaged. The sizes of groups are counted when this is called."""
    plain = [F.percentile(_finite(c), F.lit(0.5)).alias(c) for c in columns]
    large = held(rows.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > many).select(key), "large")
    if large.isEmpty():
        return rows.groupBy(key).agg(*plain)
    small = _matched(rows, large, [key], "left_anti").groupBy(key).agg(*plain)
    each = F.inline(F.array(*(F.struct(F.lit(c).alias("name"), _finite(c).alias("v")) for c in columns)))
    long, keys = _matched(rows, large, [key], "left_semi").select(key, each).where("v IS NOT NULL"), [key, "name"]
    near = F.approx_percentile("v", F.array(F.lit(0.5 - 2 / accuracy), F.lit(0.5 + 2 / accuracy)), F.lit(accuracy))
    bounds = held(long.groupBy(*keys).agg(F.count("*").alias("n"), near.alias("b")).select(*keys, "n", F.col("b")[0].alias("lo"), F.col("b")[1].alias("hi")), "bounds")
    counted = _matched(long, bounds, keys, "inner").groupBy(*keys, "n", "lo", "hi").agg(F.count_if(F.col("v") < F.col("lo")).alias("below"), F.count_if(F.col("v").between(F.col("lo"), F.col("hi"))).alias("inside"))
    first, second = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)  # places of the middle values, from 0
    holds = (F.col("below") <= first) & (F.col("below") + F.col("inside") > second)
    inf = float("inf")
    sure = held(counted.select(*keys, "n", *(F.when(holds, F.col(c)).otherwise(F.lit(v)).alias(c) for c, v in (("lo", -inf), ("hi", inf), ("below", 0)))), "sure")
    values = _matched(long, sure, keys, "inner").where(F.col("v").between(F.col("lo"), F.col("hi"))).groupBy(*keys, "n", "below", "v").agg(F.count("*").alias("c"))
    until = F.col("below") + F.sum("c").over(Window.partitionBy(*keys).orderBy("v"))
    middle = values.withColumn("until", until).groupBy(*keys).agg(*(F.min(F.when(F.col("until") > at, F.col("v"))).alias(n) for n, at in (("a", first), ("b", second))))
    found = middle.select(*keys, (0.5 * F.col("a") + 0.5 * F.col("b")).alias("m")).groupBy(key).agg(*(F.max(F.when(F.col("name") == c, F.col("m"))).alias(c) for c in columns))
    # A large group without any value is a row, too.
    return small.unionByName(_matched(large, found.withColumnsRenamed({c: f"_m{i}" for i, c in enumerate(columns)}), [key], "left").select(key, *(F.col(f"_m{i}").alias(c) for i, c in enumerate(columns))))
