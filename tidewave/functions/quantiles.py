"""Exact quantiles of groups of any size in bounded memory.

The order statistics that a quantile lies between are searched by counting: a pass
deals the values between two bounds into ``SLICES`` slices and keeps, for each rank
looked for, the slice that holds it, with its own least and greatest value as new
bounds. When so few values are left that they fit one task (``FEW``), they are
sorted. No values are shuffled but those; small groups need no counting pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewave.sources.tables import stored

SLICES, FEW = 1024, 4096
#: Ranks up to whose number they are broadcast to the values.
MOST_RANKS = 100_000


def _beside(values: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values next to the ranks of their group, between the bounds of each."""
    few = ranks.limit(MOST_RANKS + 1).count() <= MOST_RANKS
    joined = values.join(F.broadcast(ranks) if few else ranks, list(keys))
    return joined.where("v >= low and v <= high")


def _narrowed(values: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each rank with the slice that it lies in."""
    own = [*keys, "rank", "before"]
    width = F.col("high") / SLICES - F.col("low") / SLICES
    place = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("low")) / width), F.lit(SLICES - 1))).otherwise((F.col("v") > F.col("low")).cast("long"))
    counted = _beside(values, ranks, keys).withColumn("slice", place).groupBy(*own, "slice").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    upto = F.sum("n").over(Window.partitionBy(*own).orderBy("slice"))  # at most SLICES rows
    found = counted.withColumn("upto", F.col("before") + upto).where("rank < upto and rank >= upto - n")
    return found.select(*keys, "rank", (F.col("upto") - F.col("n")).alias("before"), "n", "low", "high")


def order_statistics(values: DataFrame, ranks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, rank, v): the value of each rank (from 0) of ``ranks`` (keys, rank, before, n, low, high) among ``values`` (keys, v)."""
    done = None
    while True:
        wide = ranks.where(f"n > {FEW} and low < high")
        settled = ranks.where(f"n <= {FEW} or low = high")
        done = settled if done is None else done.unionByName(settled)
        if wide.isEmpty():
            break
        ranks = stored(_narrowed(values, wide, keys), "ranks")
    equal = done.where("low = high").select(*keys, "rank", F.col("low").alias("v"))
    rest = _beside(values, done.where("low < high"), keys).groupBy(*keys, "rank", "before").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # FEW at most
    return equal.unionByName(rest.select(*keys, "rank", F.get("vs", (F.col("rank") - F.col("before")).cast("int")).alias("v")))


def quantiles(df: DataFrame, keys: Sequence[str], at: dict[str, float], value: str = "value") -> DataFrame:
    """(keys, a column for each name of ``at``): quantiles between order statistics, linearly. Null and NaN values don't count; groups of them alone are left out."""
    column = F.col(value).cast("double")
    values = df.select(*keys, column.alias("v")).where("v is not null and not isnan(v)")
    size = stored(values.groupBy(*keys).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")), "sizes")
    spots = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(q)) * (F.col("n") - 1)).alias("spot")) for name, q in at.items()])
    wanted = size.select(*keys, "n", "low", "high", F.explode(spots).alias("s")).select(*keys, "n", "low", "high", "s.*")
    sides = wanted.withColumn("rank", F.explode(F.array(F.floor("spot"), F.ceil("spot"))))
    ranks = sides.select(*keys, "rank", F.lit(0).cast("long").alias("before"), "n", "low", "high").distinct()
    found = order_statistics(values, ranks, keys)
    each = sides.distinct().join(found, [*keys, "rank"]).groupBy(*keys, "name").agg(F.min("v").alias("a"), F.max("v").alias("b"), F.first(F.col("spot") - F.floor("spot")).alias("share"))
    between = each.withColumn("q", F.col("a") + (F.col("b") - F.col("a")) * F.col("share"))
    return between.groupBy(*keys).agg(*[F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in at])
