"""Signals of a stream of bars: each micro-batch is scored on the last bars of its symbols."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.unit_root import decayed_volatility
from barloom.operators import learning
from barloom.sources import store
from barloom.streaming import rules

BUFFER, LEAST = 100, 25


def last_bars(bars: DataFrame, n: int = BUFFER) -> DataFrame:
    """The last n bars of each symbol, numbered from 0, and `all_bars`, how many of them there are."""
    k = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("timestamp")))
    b = bars.withColumn("_k", k).where(F.col("_k") <= n)
    whole = W.partitionBy("symbol")
    return b.withColumn("bar_idx", (F.count("*").over(whole) - F.col("_k")).cast("long")).withColumn("all_bars", F.count("*").over(whole)).drop("_k")


def score_stream(bars: DataFrame, models: dict, root: str, bar_type: str, labeling: str, **options):
    """A stream writer that adds each batch's bars to table bars and their signals to table signals; symbols with fewer than LEAST bars wait.

    A batch that runs again replaces what it wrote. Start it with `.start()`.
    """

    def batch(frame: DataFrame, number: int) -> None:
        spark = frame.sparkSession
        rows = frame.withColumn("bar_type", F.lit(bar_type))
        store.append(rows, root, "bars", number)
        known = store.read(spark, root, "bars").where(F.col("bar_type") == bar_type)
        recent = last_bars(known.join(rows.select("symbol").distinct(), "symbol", "left_semi")).where(F.col("all_bars") >= LEAST)
        new = rows.select("symbol", "timestamp")
        s = learning.signals(models, decayed_volatility(recent), **options).join(new, ["symbol", "timestamp"], "left_semi")
        store.append(s.withColumn("bar_type", F.lit(bar_type)).withColumn("labeling_method", F.lit(labeling)), root, "signals", number)

    return bars.writeStream.foreachBatch(batch)


def buffered_signals(bars: DataFrame, models: dict[str, dict], labeling: str, least: int = LEAST, **options) -> DataFrame:
    """The signals of bars that bring their last bars along (rules.rule_bars), by the models of their bar type; bars of other types, or with fewer than `least` bars, have none.

    Each bar is scored on its own buffer: no table is read.
    """
    made = []
    for bar_type, own in models.items():
        recent = rules.buffered(bars.where(F.col("bar_type") == bar_type), least)
        names = recent.select("symbol", "_symbol", "_timestamp").distinct()
        s = learning.signals(own, decayed_volatility(recent), **options).join(names, "symbol").where(F.col("timestamp") == F.col("_timestamp"))
        made.append(s.withColumn("symbol", F.col("_symbol")).drop("_symbol", "_timestamp", "bar_idx").withColumn("bar_type", F.lit(bar_type)))
    return reduce(DataFrame.unionByName, made).withColumn("labeling_method", F.lit(labeling))


def score_rules(bars: DataFrame, models: dict[str, dict], root: str, labeling: str, **options):
    """A stream writer that adds each batch of rule_bars to table bars and its signals to table signals. A batch that runs again replaces what it wrote. Start it with `.start()`."""

    def batch(frame: DataFrame, number: int) -> None:
        frame = frame.persist()
        try:
            store.append(frame.drop("recent"), root, "bars", number)
            store.append(buffered_signals(frame, models, labeling, **options), root, "signals", number)
        finally:
            frame.unpersist()

    return bars.writeStream.foreachBatch(batch)


def changes(exposed: DataFrame, step: int = 10) -> DataFrame:
    """Bars whose exposure, rounded to steps, differs from the bar before (0 before the first).

    The last digits of sums of sizes are rounded off before, so half steps are told as such.
    """
    level = F.bround(F.round(F.col("exposure") * step, 9)) / step
    w = W.partitionBy("symbol").orderBy("bar_idx")
    b = exposed.withColumn("level", level).withColumn("_was", F.coalesce(F.lag("level").over(w), F.lit(0.0)))
    return b.where(F.col("level") != F.col("_was")).drop("_was")
