"""Bars: relational ones as aggregations, threshold ones by pointers between slices, adaptive ones as one ordered fold per symbol."""

import json
import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators import slices
from barloom.operators.thresholds import threshold_bars

SCHEMA = "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, tick_count long, duration_us long"
_UNIT = {"min": 60_000, "h": 3_600_000, "s": 1000}


def interval_ms(text: str) -> int:
    m = re.fullmatch(r"(\d+)(min|h|s)", text)
    if not m:
        raise ValueError(f"not an interval: {text}")
    return int(m[1]) * _UNIT[m[2]]


def ohlcv(trades: DataFrame, *keys: str) -> DataFrame:
    """One bar for each key: partial aggregation before the shuffle, trades in the order (time, id)."""
    at = F.struct("time", "id")
    return trades.groupBy(*keys).agg(
        F.max("time").alias("timestamp"), F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"),
        F.sum("qty").alias("volume"), F.sum(F.col("price") * F.col("qty")).alias("dollar_volume"), F.count("*").alias("tick_count"),
        F.when(F.count("*") > 1, (F.max("time") - F.min("time")) * 1000).otherwise(0).alias("duration_us"),
    )


def numbered(bars: DataFrame, order: str) -> DataFrame:
    return bars.withColumn("bar_idx", (F.row_number().over(W.partitionBy("symbol").orderBy(order)) - 1).cast("long")).drop(order)


def time_bars(trades: DataFrame, interval: str = "1min") -> DataFrame:
    """One bar for each window with trades; the last window of a symbol is still open and not a bar."""
    rows = trades.withColumn("win", F.floor(F.col("time") / interval_ms(interval)))
    bars = ohlcv(rows, "symbol", "win").withColumn("last", F.max("win").over(W.partitionBy("symbol"))).where("win < last").drop("last")
    return numbered(bars, "win")


def tick_bars(trades: DataFrame, ticks: int = 1000, bucket: int = slices.BUCKET) -> DataFrame:
    """Every `ticks` trades of a symbol, numbered by time buckets: no task holds a symbol."""
    rows = slices.numbered(trades, bucket).withColumn("bar_idx", F.floor(F.col("number") / ticks))
    return ohlcv(rows, "symbol", "bar_idx").where(F.col("tick_count") == ticks)


# The names under which the estimates of an adaptive bar are saved.
SAVED = {"imbalance": ("expected_imbalance",), "run": ("expected_run_up", "expected_run_down")}


class Fold:
    """State of one symbol's open bar and of the rule that closes it; `step` takes trades in order and returns the bars closed.

    rule: 'time', 'threshold', 'imbalance' or 'run'; value: 'tick', 'volume' or 'dollar'.
    A time bar closes as the first trade of a later window (of `threshold` milliseconds)
    comes. The state has a fixed size: of the open bar only running values are kept.
    """

    def __init__(self, rule: str, value: str = "tick", threshold: float = 0.0, first: int = 1000, span: int = 100):
        self.rule, self.value, self.threshold, self.first, self.span, self.alpha = rule, value, threshold, first, span, 2 / (span + 1)
        self.done, self.ticks, self.rate, self.p, self.counts = 0, float(first), None, 0.5, []
        self._open()

    def _open(self) -> None:
        self.n, self.total, self.up, self.down, self.buys = 0, 0.0, 0.0, 0.0, 0
        self.bar = [0.0] * 6  # open, high, low, close, volume, dollar volume
        self.began = self.last = 0

    def state(self) -> dict:
        return dict(self.__dict__, bar=list(self.bar), counts=list(self.counts))

    @classmethod
    def load(cls, state: dict) -> "Fold":
        fold = cls.__new__(cls)
        fold.__dict__.update(state)
        return fold

    def estimates(self) -> dict:
        """What a later session needs; the open bar is not part of it."""
        out = {"expected_ticks": self.ticks, "bar_tick_counts": self.counts[-self.span :], "expected_num_ticks_init": self.first, "num_prev_bars": self.span, "bars_completed": self.done}
        if self.rule == "run":
            out["p_buy"] = self.p
        return {**out, **dict(zip(SAVED[self.rule], self.rate or (None, None)))}

    def resume(self, saved: dict) -> "Fold":
        """Takes estimates over; names that are missing leave what is there."""
        self.ticks, self.counts, self.done = saved.get("expected_ticks", self.ticks), list(saved.get("bar_tick_counts", [])), saved.get("bars_completed", self.done)
        self.p = saved.get("p_buy", self.p)
        rate = [saved.get(k) for k in SAVED[self.rule]]
        self.rate = self.rate if None in rate else rate
        return self

    def _blend(self, old: float, new: float) -> float:
        return self.alpha * new + (1 - self.alpha) * old

    def _closes(self) -> bool:
        if self.rule == "threshold":
            return self.total >= self.threshold
        if self.rule == "time":
            return False
        if self.rate is None:
            return self.n >= self.first
        if self.rule == "imbalance":
            return abs(self.total) >= self.ticks * self.rate[0]
        p = self.p
        return max(p * self.up, (1 - p) * self.down) >= self.ticks * max(p * self.rate[0], (1 - p) * self.rate[1])

    def _learn(self) -> None:
        n = self.n
        if self.rule in ("threshold", "time"):
            return
        self.counts = [*self.counts, n][-self.span :]
        self.ticks = min(max(self._blend(self.ticks, n), 0.5 * self.first), 2.0 * self.first)
        if self.rule == "imbalance":
            seen, least = [abs(self.total) / n], 1.0
        else:
            seen, least = [self.up / n, self.down / n], 0.5
            self.p = min(max(self._blend(self.p, self.buys / n), 0.01), 0.99)
        self.rate = [x if x > 0 else least for x in seen] if self.rate is None else [self._blend(a, b) for a, b in zip(self.rate, seen)]

    def step(self, trades) -> list[tuple]:
        """trades: (time, price, qty, is_buyer_maker) in order."""
        out = []
        for time, price, qty, maker in trades:
            if self.rule == "time" and self.n and time // self.threshold > self.began // self.threshold:
                out.append(self._closed())
            b = self.bar
            if not self.n:
                b[0], b[1], b[2], self.began = price, price, price, time
            b[1], b[2], b[3] = max(b[1], price), min(b[2], price), price
            b[4] += qty
            b[5] += price * qty
            self.n, self.last = self.n + 1, time
            v = {"tick": 1.0, "volume": qty, "dollar": price * qty}[self.value]
            sign = -1.0 if maker else 1.0
            self.total += sign * v if self.rule in ("imbalance", "run") else v
            if sign > 0:
                self.up, self.buys = self.up + v, self.buys + 1
            else:
                self.down += v
            if self._closes():
                out.append(self._closed())
        return out

    def _closed(self) -> tuple:
        """The open bar, whose place a new one takes."""
        bar = (self.done, int(self.last), *map(float, self.bar), self.n, int((self.last - self.began) * 1000) if self.n > 1 else 0)
        self._learn()
        self.done += 1
        self._open()
        return bar


def fold_rule(kind: str, **parameters) -> dict:
    """The Fold of a bar type, of the parameters that `bars` takes."""
    value, _, rule = kind.rpartition("_")
    if kind == "time":
        return {"rule": "time", "threshold": interval_ms(parameters.get("interval", "1min"))}
    if kind == "tick":
        return {"rule": "threshold", "value": "tick", "threshold": parameters.get("ticks", 1000)}
    if kind in ("volume", "dollar"):
        return {"rule": "threshold", "value": kind, "threshold": parameters.get("threshold", {"volume": 100.0, "dollar": 1e6}[kind])}
    if rule not in ("imbalance", "run") or value not in ("tick", "volume", "dollar"):
        raise ValueError(f"unknown bar type: {kind}")
    return {"rule": rule, "value": value, "first": parameters.get("first", 1000), "span": parameters.get("span", 100)}


def _folded(trades: DataFrame, rule: dict, states: DataFrame | None, at_end: bool, schema: str) -> DataFrame:
    """A symbol's trades in order through one Fold: Spark deals and sorts them, and the fold goes on from Arrow batch to batch, so no symbol is held in memory."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(frames):
        symbol, fold = None, None
        for frame in frames:
            out = []
            names, saved = frame["symbol"].to_numpy(), frame["saved"].to_numpy()
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(frame)]
            for a, b in zip(cuts, cuts[1:]):
                if b == a:
                    continue
                if names[a] != symbol or fold is None:
                    if fold is not None and at_end:
                        out.append((symbol, json.dumps(fold.estimates())))
                    symbol, fold = names[a], Fold(**rule)
                while a < b and saved[a] is not None:  # estimates come before the first trade
                    fold.resume(json.loads(saved[a]))
                    a += 1
                part = frame.iloc[a:b]
                bars = fold.step(zip(*(part[c].tolist() for c in ("time", "price", "qty", "is_buyer_maker"))))
                if not at_end:
                    out += [(symbol, *x) for x in bars]
            yield pd.DataFrame(out, columns=columns)
        if fold is not None and at_end:
            yield pd.DataFrame([(symbol, json.dumps(fold.estimates()))], columns=columns)

    rows = trades.select("symbol", "id", "time", "price", "qty", "is_buyer_maker", F.lit(None).cast("string").alias("saved"))
    if states is not None:
        first = F.lit(-(2**63))
        rows = rows.unionByName(states.select("symbol", first.alias("id"), first.alias("time"), F.lit(0.0).alias("price"), F.lit(0.0).alias("qty"), F.lit(False).alias("is_buyer_maker"), F.col("state").alias("saved")))
    return rows.repartition("symbol").sortWithinPartitions("symbol", "time", "id").mapInPandas(run, schema)


def folded_bars(trades: DataFrame, states: DataFrame | None = None, **rule) -> DataFrame:
    """Bars whose end depends on the bars before. states: (symbol, state) of an earlier session."""
    return _folded(trades, rule, states, False, SCHEMA)


def fold_states(trades: DataFrame, states: DataFrame | None = None, **rule) -> DataFrame:
    """(symbol, state): the estimates of adaptive bars after all trades, as JSON."""
    return _folded(trades, rule, states, True, "symbol string, state string")


def save_states(states: DataFrame, path: str) -> None:
    """One JSON file for each symbol, in a folder of its name."""
    states.select("symbol", "state").repartition("symbol").write.mode("overwrite").partitionBy("symbol").text(path)


def load_states(spark, path: str) -> DataFrame:
    """What save_states has written; empty if nothing was."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], "symbol string, state string")
    return spark.read.schema("value string, symbol string").text(path).select("symbol", F.col("value").alias("state"))


#: The ten bar types.
BARS = {
    "time": lambda t, interval="1min": time_bars(t, interval),
    "tick": lambda t, ticks=1000: tick_bars(t, ticks),
    "volume": lambda t, threshold=100.0, **slicing: threshold_bars(t, "volume", threshold, **slicing),
    "dollar": lambda t, threshold=1e6, **slicing: threshold_bars(t, "dollar", threshold, **slicing),
    **{f"{v}_{r}": (lambda t, first=1000, span=100, r=r, v=v: folded_bars(t, rule=r, value=v, first=first, span=span)) for r in ("imbalance", "run") for v in ("tick", "volume", "dollar")},
}


def bars(trades: DataFrame, kind: str, **parameters) -> DataFrame:
    if kind not in BARS:
        raise ValueError(f"unknown bar type: {kind}")
    return BARS[kind](trades, **parameters)
