"""Bars made file by file: each day's trades go on from the state that the day before left.

Under a root there are, for each bar type, a table of states and one of bars, a folder
for each day. A state is everything a symbol's fold knows after the day, its open bar
included, so days taken one by one give the bars of all days taken at once. A day
reads the states of the latest day before it; taken again, it gives the same rows and
writes over its own. A symbol without trades on a day keeps its state.

Cases: the first day starts from nothing; a day without trades has no bars and hands
the states on; days have to be taken in their order, since a day that comes in late
does not change the days after it.
"""

import json

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import SCHEMA, Fold, fold_rule
from barloom.sources.cut import cut

_BAR = [c.split()[0] for c in SCHEMA.split(", ")]
#: Places of the rows that carry a state in before a symbol's first trade.
_FIRST = -(2**63)


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
    return spark.read.schema(f"{schema}, day string").parquet(path) if there else spark.createDataFrame([], f"{schema}, day string")


def states(spark: SparkSession, root: str, kind: str, before: str | None = None) -> DataFrame:
    """(symbol, state) after the latest day, or the latest one before a day."""
    found = _table(spark, f"{root}/{kind}/states", "symbol string, state string")
    if before is not None:
        found = found.where(F.col("day") < before)
    last = found.agg(F.max("day")).first()[0]  # names of folders, not rows
    return found.where(F.col("day") == F.lit(last)).select("symbol", "state")


def bars(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The bars of all days so far, and the day on which each closed."""
    return _table(spark, f"{root}/{kind}/bars", SCHEMA)


def advance(trades: DataFrame, root: str, day: str, kind: str, **parameters) -> DataFrame:
    """The bars that close with the trades of one day (YYYY-MM-DD); they and the states after the day are written under root."""
    rule, spark = fold_rule(kind, **parameters), trades.sparkSession
    known = states(spark, root, kind, day)
    rows = trades.select("symbol", "time", "id", "price", "qty", "is_buyer_maker", F.lit(None).cast("string").alias("state"))
    at = F.lit(_FIRST)
    rows = rows.unionByName(known.select("symbol", at.alias("time"), at.alias("id"), F.lit(0.0).alias("price"), F.lit(0.0).alias("qty"), F.lit(False).alias("is_buyer_maker"), "state"))

    def run(frames):
        symbol, fold = None, None
        ended = lambda: (symbol, *[None] * (len(_BAR) - 1), json.dumps(fold.state()))
        for frame in frames:
            out, names, saved = [], frame["symbol"].to_numpy(), frame["state"].to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if fold is None or names[a] != symbol:
                    if fold is not None:
                        out.append(ended())
                    symbol, fold = names[a], Fold(**rule)
                if saved[a] is not None:
                    fold, a = Fold.load(json.loads(saved[a])), a + 1
                part = frame.iloc[a:b]
                closed = fold.step(zip(*(part[c].tolist() for c in ("time", "price", "qty", "is_buyer_maker"))))
                out += [(symbol, *bar, None) for bar in closed]
            yield _frame(out)
        if fold is not None:
            yield _frame([ended()])

    folded = rows.repartition("symbol").sortWithinPartitions("symbol", "time", "id").mapInPandas(run, f"{SCHEMA}, state string")
    folded = cut(folded)
    made = folded.where("state is null").drop("state")
    made.write.mode("overwrite").parquet(f"{root}/{kind}/bars/day={day}")
    # states last: a day is done when they are there
    folded.where("state is not null").select("symbol", "state").write.mode("overwrite").parquet(f"{root}/{kind}/states/day={day}")
    return made


def _frame(rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[*_BAR, "state"])
    whole = [c for c in ("bar_idx", "timestamp", "tick_count", "duration_us")]
    return out.astype({**{c: "Int64" for c in whole}, **{c: "float64" for c in ("open", "high", "low", "close", "volume", "dollar_volume")}})
