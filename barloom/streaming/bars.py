"""Bars of a stream: the same fold as in batch, its state kept for each symbol by Structured Streaming."""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from barloom.operators.bars import SCHEMA, Fold, interval_ms, ohlcv


def stream_bars(trades: DataFrame, **rule) -> DataFrame:
    """Bars as they close. A micro-batch's trades are taken in the order (time, id); trades later than their batch join the open bar."""

    def run(key, frames, state):
        fold = Fold.load(json.loads(state.get[0])) if state.exists else Fold(**rule)
        frame = pd.concat(list(frames)).sort_values(["time", "id"])
        bars = fold.step(zip(*(frame[c].tolist() for c in ("time", "price", "qty", "is_buyer_maker"))))
        state.update((json.dumps(fold.state()),))
        yield pd.DataFrame([(key[0], *b) for b in bars], columns=[c.split()[0] for c in SCHEMA.split(", ")])

    rows = trades.select("symbol", "id", "time", "price", "qty", "is_buyer_maker")
    return rows.groupBy("symbol").applyInPandasWithState(run, SCHEMA, "fold string", "append", GroupStateTimeout.NoTimeout)


def stream_time_bars(trades: DataFrame, interval: str = "1min", late: str = "0 seconds") -> DataFrame:
    """Time bars of a stream, each once the watermark has passed its window's end: trades more than `late` behind the newest are left out.

    The rows are those of operators.bars.time_bars but for bar_idx, which a stream does not know.
    """
    rows = trades.withColumn("_at", F.timestamp_millis("time")).withWatermark("_at", late)
    window = F.window("_at", f"{interval_ms(interval)} milliseconds")
    return ohlcv(rows, "symbol", window).drop("window")
