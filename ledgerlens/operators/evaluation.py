"""Evaluation of retrieval (A13, A14): rates and bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REPLICATES, SEED = 2000, 1729
POISSON = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253]  # of mean 1: chances of up to k


def weight(row: Column, replicate: Column, seed: int = SEED) -> Column:
    """How often a resample has a row: a Poisson number of mean 1 from a hash of both, so tasks need no common
    source of randomness and repeat themselves when they are run again."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), row.cast("string"), replicate.cast("string"))), 1, 8), 16, 10).cast("long") / float(1 << 32)
    return sum((F.when(u >= p, 1).otherwise(0) for p in POISSON), F.lit(0))


def bootstrap(values: DataFrame, by: list[str] | None = None, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, replicate, mean) over values (id, value, by): the mean of each resample. Each task adds up its own rows
    by replicate, so sums and not rows are shuffled. Null values don't count; a resample without rows has none."""
    by = by or []
    rows = values.where("value IS NOT NULL").select("id", F.col("value").cast("double").alias("value"), *by, F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("replicate"))
    rows = rows.withColumn("w", weight(F.col("id"), F.col("replicate"), seed))
    sums = rows.groupBy(*by, "replicate").agg(F.sum("w").alias("n"), F.sum(F.col("w") * F.col("value")).alias("s"))
    return sums.where("n > 0").select(*by, "replicate", (F.col("s") / F.col("n")).alias("mean"))


def interval(values: DataFrame, by: list[str] | None = None, level: float = 0.95, replicates: int = REPLICATES, seed: int = SEED) -> DataFrame:
    """(by, n, mean, low, high): the mean with its percentile interval over the resamples' means: those at the places
    int(tail * m) and int((1 - tail) * m) - 1 of the m in order."""
    by = by or []
    order = Window.partitionBy(*by).orderBy("mean")  # at most ``replicates`` rows
    means = bootstrap(values, by, replicates, seed).withColumn("i", F.row_number().over(order) - 1).withColumn("m", F.count("*").over(Window.partitionBy(*by)))
    tail = (1 - level) / 2
    low = F.floor(F.round(tail * F.col("m"), 9))
    high = F.greatest(low, F.floor(F.round((1 - tail) * F.col("m"), 9)) - 1)
    ends = means.groupBy(*by).agg(F.max(F.when(F.col("i") == low, F.col("mean"))).alias("low"), F.max(F.when(F.col("i") == high, F.col("mean"))).alias("high"))
    all_of = values.groupBy(*by).agg(F.count("value").alias("n"), F.avg("value").alias("mean"))
    return all_of.join(ends, by) if by else all_of.crossJoin(F.broadcast(ends))
