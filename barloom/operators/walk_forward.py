"""Windows that walk forward through a history, and what becomes of their results."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def boundaries(span: DataFrame, train_days: int = 90, test_days: int = 30, step_days: int = 30) -> DataFrame:
    """(keys, window, train_start, train_end, test_start, test_end) of each row of span (keys, start, end); windows that end after `end` are left out."""
    train, test, step = (d * DAY_MS for d in (train_days, test_days, step_days))
    keys = [c for c in span.columns if c not in ("start", "end")]
    room = F.col("end") - F.col("start") - train - test
    at = span.where(room >= 0).select(*keys, "start", F.explode(F.sequence(F.lit(0), F.floor(room / step).cast("int"))).alias("window"))
    first = F.col("start") + F.col("window").cast("long") * step
    return at.select(*keys, "window", first.alias("train_start"), (first + train).alias("train_end"), (first + train).alias("test_start"), (first + train + test).alias("test_end"))


def stitched(curves: DataFrame, capital: float = 10_000.0) -> DataFrame:
    """One curve of curves (run, window, timestamp, equity): each window begins where the one before ended; with the drawdown from the highest value so far.

    The scale of a window is the product of the growth of the windows before it.
    """
    own = W.partitionBy("run", "window").orderBy("timestamp")
    first = F.first("equity").over(own)
    c = curves.withColumn("_first", F.when(first <= 0, 1.0).otherwise(first))
    growth = c.groupBy("run", "window").agg((F.max_by("equity", "timestamp") / F.first("_first")).alias("g"))
    before = W.partitionBy("run").orderBy("window").rowsBetween(W.unboundedPreceding, -1)
    scale = growth.select("run", "window", F.coalesce(F.exp(F.sum(F.ln("g")).over(before)), F.lit(1.0)).alias("_scale"))
    out = c.join(scale, ["run", "window"]).withColumn("equity", F.round(capital * F.col("_scale") * F.col("equity") / F.col("_first"), 2))
    peak = F.greatest(F.lit(capital), F.max("equity").over(W.partitionBy("run").orderBy("window", "timestamp").rowsBetween(W.unboundedPreceding, 0)))
    return out.withColumn("drawdown", F.round((F.col("equity") - peak) / peak, 6)).drop("_first", "_scale")


def bootstrap(results: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(run, metric, mean, std, ci_lower, ci_upper) of results (run, window, metric, value): 95 % range of the means of samples with replacement.

    A draw is a hash of the seed, the sample and its place, so samples are the
    same on every cluster and for all metrics; std of one window is 0.
    """
    ranked = results.withColumn("_k", F.row_number().over(W.partitionBy("run", "metric").orderBy("window")) - 1)
    size = results.groupBy("run", "metric").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.coalesce(F.when(F.count("*") > 1, F.stddev_samp("value")), F.lit(0.0)).alias("std"))
    draws = size.select("run", "metric", "n", F.explode(F.sequence(F.lit(1), F.lit(resamples))).alias("sample")).withColumn("place", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "sample", "place").cast("binary")), 1, 8), 16, 10).cast("long") % F.col("n")
    # counted before the join: a row for each value drawn, not for each draw
    picked = draws.withColumn("_k", pick.cast("int")).groupBy("run", "metric", "sample", "n", "_k").agg(F.count("*").alias("times"))
    means = picked.join(ranked.select("run", "metric", "_k", "value"), ["run", "metric", "_k"]).groupBy("run", "metric", "sample", "n").agg((F.sum(F.col("times") * F.col("value")) / F.col("n")).alias("m"))
    ends = means.groupBy("run", "metric").agg(F.percentile("m", F.lit(0.025)).alias("ci_lower"), F.percentile("m", F.lit(0.975)).alias("ci_upper"))
    return size.join(ends, ["run", "metric"]).select("run", "metric", *(F.round(c, 4).alias(c) for c in ("mean", "std", "ci_lower", "ci_upper")))
