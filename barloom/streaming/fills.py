"""Fills of a stream of orders against a stream of trades, by the rules of operators.orders.fills."""

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

SCHEMA = "symbol string, signal_id long, side int, size double, limit_price double, submitted long, status string, fill_time long, fill_price double, queue_wait_ms long"
_ORDER = ("signal_id", "side", "size", "limit_price", "submitted", "queue_ahead")


def step(waiting: list[dict], time: int, price: float, qty: float, maker: bool, timeout_ms: int) -> list[tuple]:
    """One trade against the open orders of its symbol: those that it fills or that have run out, which leave the list."""
    done, left = [], []
    for o in waiting:
        if time <= o["submitted"]:
            left.append(o)
            continue
        buy = o["side"] == 1
        if price == o["limit_price"] and maker == buy:
            o["used"] = o.get("used", 0.0) + qty
        through = price < o["limit_price"] if buy else price > o["limit_price"]
        key = tuple(o[c] for c in _ORDER[:-1])
        if through or (o["queue_ahead"] > 0 and o.get("used", 0.0) >= o["queue_ahead"]):
            done.append((*key, "filled", time, price, time - o["submitted"]))
        elif time > o["submitted"] + timeout_ms:
            done.append((*key, "expired", None, None, None))
        else:
            left.append(o)
    waiting[:] = left
    return done


def stream_fills(orders: DataFrame, trades: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """Orders as they are filled or expire. A micro-batch's rows are taken in the order of time, an order after the trades of its own time.

    The state of a symbol is its open orders: those of one time-out, if trades keep coming.
    """
    number = lambda name, kind: F.lit(None).cast(kind).alias(name)
    o = orders.select("symbol", F.col("submitted").alias("time"), number("id", "long"), number("price", "double"), number("qty", "double"), number("is_buyer_maker", "boolean"), F.to_json(F.struct(*(F.col(c).cast(t).alias(c) for c, t in zip(_ORDER, ("long", "int", "double", "double", "long", "double"))))).alias("placed"))
    t = trades.select("symbol", "time", "id", "price", "qty", "is_buyer_maker", F.lit(None).cast("string").alias("placed"))

    def run(key, frames, state):
        waiting, out = json.loads(state.get[0]) if state.exists else [], []
        rows = pd.concat(list(frames))
        rows = rows.assign(last=rows["placed"].notna()).sort_values(["time", "last", "id"])
        for time, price, qty, maker, placed in rows[["time", "price", "qty", "is_buyer_maker", "placed"]].itertuples(index=False):
            if isinstance(placed, str):
                waiting.append(json.loads(placed))
            else:
                out += step(waiting, int(time), float(price), float(qty), bool(maker), timeout_ms)
        state.update((json.dumps(waiting),))
        frame = pd.DataFrame([(key[0], *x) for x in out], columns=[c.split()[0] for c in SCHEMA.split(", ")])
        yield frame.astype({"fill_time": "Int64", "queue_wait_ms": "Int64"})

    return o.unionByName(t).groupBy("symbol").applyInPandasWithState(run, SCHEMA, "orders string", "append", GroupStateTimeout.NoTimeout)
