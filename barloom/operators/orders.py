"""Limit orders against the trades that follow them, and equity with the costs of real execution."""

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.simulation import funding_cost, limit_price, transaction_cost


def place(signals: DataFrame, quotes: DataFrame) -> DataFrame:
    """Orders of signals (symbol, signal_id, timestamp, side, size, entry_price) on the last quote (symbol, time, mid, spread, bid_qty, ask_qty) not after them.

    Without a quote the mid is the entry price, the spread 2 basis points of it
    and the depth 1. Sizes of 0 or less are no orders. An order waits behind the
    depth of its side less its own size.
    """
    s = signals.where("size > 0").select("symbol", F.col("timestamp").alias("time"), F.struct("signal_id", "side", "size", "entry_price").alias("s"), F.lit(None).cast("struct<mid:double,spread:double,bid_qty:double,ask_qty:double>").alias("q"))
    q = quotes.select("symbol", "time", F.lit(None).cast(s.schema["s"].dataType).alias("s"), F.struct(*(F.col(c).cast("double").alias(c) for c in ("mid", "spread", "bid_qty", "ask_qty"))).alias("q"))
    # as-of join: one sort of both sides, the last quote carried forward; a quote of the same time comes first
    w = W.partitionBy("symbol").orderBy("time", F.col("s").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    b = s.unionByName(q).withColumn("q", F.last("q", True).over(w)).where("s is not null").select("symbol", F.col("time").alias("submitted"), "s.*", "q.*")
    mid = F.when(F.col("mid") > 0, F.col("mid")).otherwise(F.col("entry_price"))
    b = b.withColumn("mid", mid).withColumn("spread", F.when(F.col("spread") > 0, F.col("spread")).otherwise(F.col("mid") * 0.0002))
    depth = F.when(F.col("side") == 1, F.col("bid_qty")).otherwise(F.col("ask_qty"))
    depth = F.when(depth > 0, depth).otherwise(1.0)
    return b.select("symbol", "signal_id", "submitted", "side", "size", limit_price(F.col("mid"), F.col("spread"), F.col("side"), F.col("size")).alias("limit_price"), F.greatest(depth - F.col("size"), F.lit(0.0)).alias("queue_ahead"))


def fills(orders: DataFrame, trades: DataFrame, timeout_ms: int = 60_000) -> DataFrame:
    """What becomes of each order: the first later trade through its price fills it, or the trades at its price of the other side that use up its queue.

    An order without a queue fills only by a trade through its price. The first
    trade after the time-out can still fill; then the order is expired, and open
    if no such trade came. Orders meet the trades of their own time range (by
    buckets of the time-out's length), not all of a symbol's.
    """
    span = F.lit(timeout_ms)
    t = trades.select("symbol", "time", "id", "price", "qty", "is_buyer_maker")
    o = orders.withColumn("until", F.col("submitted") + span)
    # the first trade after the time-out, by one sort of both sides
    shape = "struct<time:long,id:long,price:double,qty:double,is_buyer_maker:boolean>"
    marks = o.select("symbol", F.col("until").alias("time"), "signal_id", F.lit(None).cast(shape).alias("t")).unionByName(t.select("symbol", "time", F.lit(None).cast("long").alias("signal_id"), F.struct("time", "id", "price", "qty", "is_buyer_maker").cast(shape).alias("t")))
    # backwards in time, so that the frame only grows
    later = W.partitionBy("symbol").orderBy(F.desc("time"), F.desc(F.col("t").isNull()), F.desc("t.id")).rowsBetween(W.unboundedPreceding, 0)
    after = marks.withColumn("t", F.last("t", True).over(later)).where("signal_id is not null and t is not null").select("symbol", "signal_id", "t.*")
    near = o.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("submitted") / span), F.floor(F.col("until") / span)))).select("symbol", "signal_id", "submitted", "until", "bucket")
    during = near.join(t.withColumn("bucket", F.floor(F.col("time") / span)), ["symbol", "bucket"]).where("time > submitted and time <= until").select("symbol", "signal_id", "time", "id", "price", "qty", "is_buyer_maker")
    met = during.unionByName(after).join(o, ["symbol", "signal_id"])
    buys = F.col("side") == 1
    through = F.when(buys, F.col("price") < F.col("limit_price")).otherwise(F.col("price") > F.col("limit_price"))
    at = (F.col("price") == F.col("limit_price")) & F.when(buys, F.col("is_buyer_maker")).otherwise(~F.col("is_buyer_maker"))
    used = F.sum(F.when(at, F.col("qty")).otherwise(0.0)).over(W.partitionBy("symbol", "signal_id").orderBy("time", "id").rowsBetween(W.unboundedPreceding, 0))
    hit = met.withColumn("used", used).withColumn("hit", through | ((F.col("queue_ahead") > 0) & (F.col("used") >= F.col("queue_ahead"))))
    first = hit.groupBy("symbol", "signal_id").agg(F.min(F.when(F.col("hit"), F.struct("time", "id", "price"))).alias("f"), F.max(F.col("time") > F.col("until")).alias("late"))
    r = o.join(first, ["symbol", "signal_id"], "left")
    status = F.when(F.col("f").isNotNull(), "filled").when(F.col("late"), "expired").otherwise("open")
    return r.select("symbol", "signal_id", "side", "size", "limit_price", "submitted", status.alias("status"), F.col("f.time").alias("fill_time"), F.col("f.price").alias("fill_price"), (F.col("f.time") - F.col("submitted")).alias("queue_wait_ms"))


def with_costs(filled: DataFrame, spread: float = 2e-4, **costs) -> DataFrame:
    """Orders with order_type and costs (simulation.transaction_cost, funding from submission to fill included); both null where an order is not filled.

    spread: of the fill price, where filled has no column spread.
    """
    there, notional = F.col("fill_price").isNotNull(), F.abs(F.col("size") * F.col("fill_price"))
    part = F.try_divide("spread", "fill_price") if "spread" in filled.columns else F.lit(spread)
    paid = funding_cost(F.col("submitted"), F.col("fill_time"), notional, F.col("side"))
    f = filled.withColumn("order_type", F.when(there, "maker"))
    return f.withColumn("costs", F.when(there, transaction_cost(notional, F.col("order_type"), part, paid, **costs)))


def fill_stats(filled: DataFrame) -> DataFrame:
    """Of each symbol's orders: counts, fill rate and share of maker fills in percent, mean wait and mean slippage in basis points; 0 without fills."""
    done = F.count_if(F.col("status") == "filled")
    f = with_costs(filled)
    return f.groupBy("symbol").agg(
        F.count("*").alias("submitted"), done.alias("filled"), F.count_if(F.col("status") == "expired").alias("expired"), (done / F.count("*") * 100).alias("fill_rate"), F.coalesce(F.avg("queue_wait_ms"), F.lit(0.0)).alias("avg_wait_ms"),
        F.coalesce(F.avg(F.try_divide("costs.slippage", "costs.notional") * 1e4), F.lit(0.0)).alias("avg_slippage_bps"), F.coalesce(F.try_divide(F.count_if(F.col("order_type") == "maker"), done) * 100, F.lit(0.0)).alias("maker_ratio"),
    )


def accepted(signals: DataFrame, seed: int = 42) -> DataFrame:
    """Signals whose order is filled: with the square of their meta probability, by a hash of the seed and their key."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "symbol", "signal_id").cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32
    p = F.coalesce(F.col("meta_probability"), F.lit(0.5))
    return signals.where(u < p * p)


def funding(signals: DataFrame, held: DataFrame, bars: DataFrame) -> DataFrame:
    """(symbol, bar_idx, funding) that positions pay as they close: of the size times the price they leave at."""
    priced = F.col("labeling_method") == "triple_barrier" if "labeling_method" in signals.columns else F.lit(True)
    s = signals.select("symbol", "signal_id", F.col("timestamp").alias("entry"), *(F.when(priced, F.col(c)).alias(c) for c in ("sl_price", "pt_price")))
    b = bars.select("symbol", F.col("bar_idx").alias("leave"), F.col("timestamp").alias("ts"), "low", "high", "close")
    x = held.where("leave is not null").join(s, ["symbol", "signal_id"]).join(b, ["symbol", "leave"])
    long = F.col("side") > 0
    stopped = F.when(long, F.col("low") <= F.col("sl_price")).otherwise(F.col("high") >= F.col("sl_price"))
    taken = F.when(long, F.col("high") >= F.col("pt_price")).otherwise(F.col("low") <= F.col("pt_price"))
    price = F.when(stopped, F.col("sl_price")).when(taken, F.col("pt_price")).otherwise(F.col("close"))
    cost = funding_cost(F.col("entry"), F.col("ts"), F.abs(F.col("size") * price), F.col("side"))
    return x.groupBy("symbol", F.col("leave").alias("bar_idx")).agg(F.sum(cost).alias("funding"))


COSTS = ("exchange_fee", "spread_cost", "slippage", "market_impact")


def realistic_equity(exposed: DataFrame, paid: DataFrame, capital: float = 10_000.0, maker_bps: float = 2.0, spread_bps: float = 2.0, impact: float = 1.0, volatility: float = 0.02, volume: float = 1e9) -> DataFrame:
    """Equity of exposed (bars with exposure) after funding and the costs of changes: fee, half the spread, slippage with the root of the order's share of the volume, and a tenth of that again.

    The cost of a change is not linear in the equity, so this is a recurrence:
    the bars of a symbol are folded in order, exposure and funding come from joins.
    """
    schema = "symbol string, bar_idx long, timestamp long, exposure double, equity double, drawdown double, funding double, " + ", ".join(f"{c} double" for c in COSTS)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, equity, peak, last, before, out = rows.sort_values("bar_idx"), capital, capital, None, 0.0, []
        for at, time, close, exposure, due in rows[["bar_idx", "timestamp", "close", "exposure", "funding"]].itertuples(index=False):
            equity = (equity - due) * (1 + before * (close / last - 1 if last else 0.0))
            change, costs = abs(exposure - before), (0.0, 0.0, 0.0, 0.0)
            if change > 1e-9:
                notional = change * abs(equity)
                root = math.sqrt(notional / volume)
                slip = impact * volatility * root * notional
                costs = (notional * maker_bps / 1e4, notional * spread_bps / 2e4, slip, 0.1 * slip)
                # the sum of the costs as one product
                equity -= notional * ((maker_bps + spread_bps / 2) / 1e4 + 11 * impact * volatility / 10 * root)
            peak, last, before = max(peak, equity), close, exposure
            out.append((key[0], at, time, exposure, equity, (equity - peak) / peak, due, *costs))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    b = exposed.select("symbol", "bar_idx", "timestamp", "close", "exposure").join(paid, ["symbol", "bar_idx"], "left").fillna(0.0, ["funding"])
    return b.groupBy("symbol").applyInPandas(run, schema)
