"""Every bar type in one stream, with the last bars of each, and the exposure of the signals that are open.

Both are stateful operators of Structured Streaming keyed by (symbol, bar type): their
state lives in the state store and comes back from its checkpoint. The store has to be
RocksDB's (`spark.sql.streaming.stateStore.providerClass`), as for all operators of
this kind.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from barloom.operators.bars import BARS, SCHEMA, Fold, fold_rule

BUFFER, LEAST = 100, 25
_BAR = [c.split() for c in SCHEMA.split(", ")][1:]
_RECENT = "array<struct<" + ", ".join(f"{n}: {t}" for n, t in _BAR) + ">>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class BarRules(StatefulProcessor):
    """One fold and the last bars of a (symbol, bar type)."""

    def __init__(self, rules: dict[str, dict], buffer: int):
        self.rules, self.buffer = rules, buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.fold = handle.getValueState("fold", "state string")
        self.recent = handle.getListState("recent", "bar string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        symbol, kind = key
        fold = Fold.load(json.loads(self.fold.get()[0])) if self.fold.exists() else Fold(**self.rules[kind])
        frame = pd.concat(list(rows)).sort_values(["time", "id"])
        closed = fold.step(zip(*(frame[c].tolist() for c in ("time", "price", "qty", "is_buyer_maker"))))
        self.fold.update((json.dumps(fold.state()),))
        out = []
        if closed:
            last = [json.loads(x[0]) for x in self.recent.get()] if self.recent.exists() else []
            for bar in closed:
                last = [*last, list(bar)][-self.buffer :]
                out.append((symbol, kind, *bar, json.dumps([dict(zip((n for n, _ in _BAR), b)) for b in last])))
            self.recent.put([(json.dumps(b),) for b in last])
        yield pd.DataFrame(out, columns=["symbol", "bar_type", *(n for n, _ in _BAR), "recent"])

    def close(self) -> None:
        pass


def rule_bars(trades: DataFrame, rules: dict[str, dict] | None = None, buffer: int = BUFFER) -> DataFrame:
    """(symbol, bar_type, bar columns, recent): the bars of all types as they close, each with the last `buffer` bars of its symbol and type, itself the last.

    rules: parameters by bar type, as `bars` takes them; all ten types with their
    defaults if not given. A micro-batch's trades are taken in the order (time, id). Bars
    are those of a batch, whatever the micro-batches and after a restart.
    """
    rules = {k: fold_rule(k, **v) for k, v in (rules or {k: {} for k in BARS}).items()}
    rows = trades.select("symbol", F.explode(F.array(*(F.lit(k) for k in rules))).alias("bar_type"), "time", "id", "price", "qty", "is_buyer_maker")
    schema = f"symbol string, bar_type string, {', '.join(f'{n} {t}' for n, t in _BAR)}, recent string"
    made = rows.groupBy("symbol", "bar_type").transformWithStateInPandas(statefulProcessor=BarRules(rules, buffer), outputStructType=schema, outputMode="Append", timeMode="None")
    return made.withColumn("recent", F.from_json("recent", _RECENT))


def buffered(bars: DataFrame, least: int = LEAST) -> DataFrame:
    """The last bars of each bar that has `least` of them, numbered from 0, as a table of bars for features: `symbol` names the bar (symbol|type|time), the columns of the same name with _ say what it is of."""
    b = bars.where(F.size("recent") >= least)
    b = b.select(F.concat_ws("|", "symbol", "bar_type", "timestamp").alias("_name"), F.col("symbol").alias("_symbol"), F.col("bar_type").alias("_bar_type"), F.col("timestamp").alias("_timestamp"), F.posexplode("recent").alias("_k", "x"))
    return b.select(F.col("_name").alias("symbol"), "_symbol", "_bar_type", "_timestamp", F.col("_k").cast("long").alias("bar_idx"), *(F.col(f"x.{n}").alias(n) for n, _ in _BAR if n != "bar_idx"))


class Pool(StatefulProcessor):
    """The open signals of a (symbol, bar type), and the last level that was told."""

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", "size double, until long")
        self.level = handle.getValueState("level", "level double")

    def _told(self, key, time: int, pool: list) -> list:
        """The row of a change, if there is one, after the pool was brought up to a time."""
        self.open.put(pool) if pool else self.open.clear()
        mean = sum(s for s, _ in pool) / len(pool) if pool else 0.0
        # the last digits of sums are rounded off before, so half steps are told as such
        level = round(round(max(-1.0, min(1.0, mean)) * self.step, 9)) / self.step + 0.0
        if level == (self.level.get()[0] if self.level.exists() else 0.0):
            return []
        self.level.update((level,))
        return [(*key, time, level, len(pool))]

    def _pool(self) -> list:
        return [(float(s), int(u)) for s, u in self.open.get()] if self.open.exists() else []

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("timestamp", kind="stable")
        pool, out = self._pool(), []
        for time, part in frame.groupby("timestamp", sort=True):
            signals = part[part["size"].notna()]
            for side, size, until in zip(signals["side"], signals["size"], signals["time_barrier"]):
                pool.append((float(side) * float(size), int(until)))
                self.handle.registerTimer(int(until))
            pool = [x for x in pool if x[1] > time]
            out += self._told(key, int(time), pool)
        yield _changes(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        time = expiredTimerInfo.getExpiryTimeInMs()
        yield _changes(self._told(key, time, [x for x in self._pool() if x[1] > time]))

    def close(self) -> None:
        pass


_CHANGE = "symbol string, bar_type string, timestamp long, level double, num_active int"


def _changes(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in _CHANGE.split(", ")]).astype({"timestamp": "int64", "num_active": "int32", "level": "float64"})


def pool_changes(events: DataFrame, late: str = "0 seconds", step: int = 10) -> DataFrame:
    """(symbol, bar_type, timestamp, level, num_active): the mean signed size of the open signals in steps of 1 / step, a row where it changes.

    events: a stream of bars (symbol, bar_type, timestamp) with the signal of the bar in
    side, size and time_barrier, or nulls without one. Signals leave at the first bar at
    or past their time barrier; where none comes, a timer lets them go once the
    watermark, `late` behind the newest bar of all symbols, has passed it.
    """
    rows = events.select("symbol", "bar_type", "timestamp", F.col("side").cast("double").alias("side"), F.col("size").cast("double").alias("size"), "time_barrier", F.timestamp_millis("timestamp").alias("at"))
    rows = rows.withWatermark("at", late)
    return rows.groupBy("symbol", "bar_type").transformWithStateInPandas(statefulProcessor=Pool(step), outputStructType=_CHANGE, outputMode="Append", timeMode="EventTime")
