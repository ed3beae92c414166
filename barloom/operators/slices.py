"""Long ordered series cut into slices, so that no task holds a symbol.

Trades are cut by time: whole buckets of ``BUCKET`` milliseconds, of which only the
counts of rows are brought into one order for a symbol; numbers along the symbol
follow from them. Bars are cut by their number; what looks back gets the last rows
of the slice before copied in (a halo), and what remembers without end gets the
last value of the slices before carried in.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET, ROWS = 3_600_000, 200_000


def _buckets(trades: DataFrame, bucket: int) -> DataFrame:
    """(symbol, bucket, before): the rows of a symbol in earlier buckets. One row for each bucket that has any."""
    counts = trades.groupBy("symbol", F.floor(F.col("time") / bucket).alias("bucket")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(W.partitionBy("symbol").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    return counts.select("symbol", "bucket", F.coalesce(before, F.lit(0)).alias("before"))


def numbered(trades: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """trades with `number`, from 0 along each symbol in the order (time, id): a window orders one bucket, and counts of rows do the rest."""
    rows = trades.withColumn("bucket", F.floor(F.col("time") / bucket)).join(_buckets(trades, bucket), ["symbol", "bucket"])
    own = F.row_number().over(W.partitionBy("symbol", "bucket").orderBy("time", "id"))
    return rows.withColumn("number", (F.col("before") + own - 1).cast("long")).drop("bucket", "before")


def in_slices(bars: DataFrame, make: Callable[[DataFrame], DataFrame], size: int, halo: int, number: str = "bar_idx") -> DataFrame:
    """make(bars), worked out on slices of `size` bars and the `halo` bars before each.

    bars: numbered from 0 by column `number`. make may look back over windows of a symbol's
    bars in their order, `halo` at most, and keeps symbol and number; it sees a
    (symbol, slice) as the symbol.
    """
    at = F.col(number)
    # the greatest slice is not known here: a copy in a slice without bars of its own is dropped with the halo
    copies = F.sequence(F.floor(at / size), F.floor((at + halo) / size))
    cut = bars.withColumn("_slice", F.explode(copies)).withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("_slice").alias("slice"))).drop("_slice")
    made = make(cut)
    return made.where(F.floor(at / size) == F.col("symbol.slice")).withColumn("symbol", F.col("symbol.name"))


def last_known(bars: DataFrame, name: str, value: Column, size: int) -> DataFrame:
    """bars with column `name`: the last value that is not null up to each bar. Within a slice by a window, across slices by the last value of each."""
    b = bars.withColumn("_v", value).withColumn("_slice", F.floor(F.col("bar_idx") / size))
    ends = b.groupBy("symbol", "_slice").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("bar_idx"))).alias("_end"))
    before = F.last("_end", True).over(W.partitionBy("symbol").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1))
    ends = ends.select("symbol", "_slice", before.alias("_end"))
    own = F.last("_v", True).over(W.partitionBy("symbol", "_slice").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0))
    return b.join(ends, ["symbol", "_slice"]).withColumn(name, F.coalesce(own, "_end")).drop("_v", "_slice", "_end")


def running(bars: DataFrame, size: int, **values: Column) -> DataFrame:
    """bars with the sum of each value up to each bar, itself included: within a slice by a window, plus what the slices before come to."""
    b = bars.withColumns({f"_{k}": v for k, v in values.items()}).withColumn("_slice", F.floor(F.col("bar_idx") / size))
    sums = b.groupBy("symbol", "_slice").agg(*(F.sum(f"_{k}").alias(f"_s_{k}") for k in values))
    earlier = W.partitionBy("symbol").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("symbol", "_slice", *(F.coalesce(F.sum(f"_s_{k}").over(earlier), F.lit(0)).alias(f"_s_{k}") for k in values))
    own = W.partitionBy("symbol", "_slice").orderBy("bar_idx").rowsBetween(W.unboundedPreceding, 0)
    b = b.join(sums, ["symbol", "_slice"])
    return b.withColumns({k: F.coalesce(F.sum(f"_{k}").over(own), F.lit(0)) + F.col(f"_s_{k}") for k in values}).drop("_slice", *(f"_{k}" for k in values), *(f"_s_{k}" for k in values))
