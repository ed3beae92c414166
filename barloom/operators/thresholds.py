"""Volume and dollar bars without folding a symbol in one task.

A bar opens at a trade and closes at the first one with which the sum of its trades
is at the threshold; the next trade opens the next bar. So the opening trade of a
bar decides the next one, and the bars are the trades that the first trade reaches.

1. Trades are cut into slices of whole time buckets that hold the value of about
   ``ROWS`` average trades, or of four bars if that is more. A slice also gets the
   first trades after it, until a bar open at its end has closed.
2. In a slice every trade's next opening is found by binary search on prefix sums,
   and by adding trade by trade where a sum is within rounding of the threshold, so
   that bars are those of a plain running sum, ties included. Pointer doubling then
   gives each trade the first opening beyond the slice.
3. Only trades that an earlier slice's bar can end before are openings to a slice:
   those within one threshold of its start. Between slices they are pointers of a
   small table, which is doubled by joins: the pointer past 1, 2, 4, ... slices. Going
   back down from the longest marks the opening at which each slice is entered.
4. Each slice walks from its entry; numbers of bars follow from the bars of slices.

Values have to be zero or more. A threshold of 0 or less closes a bar with each trade.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.operators.slices import BUCKET, ROWS
from barloom.sources.cut import cut

#: Sums nearer to the threshold than this share of all that is added up are added again one by one.
NEAR = 1e-9
VALUES = {"tick": "1.0", "volume": "qty", "dollar": "price * qty"}


def next_openings(v: np.ndarray, threshold: float) -> np.ndarray:
    """For each trade as a bar's first, the place after the trade that closes the bar; len(v) + 1 if none does."""
    n = len(v)
    total = np.concatenate([[0.0], np.cumsum(v)])
    goal = total[:-1] + threshold
    out = np.searchsorted(total, goal, "left")
    out = np.maximum(out, np.arange(1, n + 1))
    margin = NEAR * (total[-1] + abs(threshold))
    reached = total[np.minimum(out, n)]
    near = ((out <= n) & (reached - goal < margin)) | (goal - total[out - 1] < margin)
    for i in np.flatnonzero(near):
        # the sum of a fold, in its own order of additions, from just below the threshold to just above
        high = min(int(np.searchsorted(total, goal[i] + margin, "right")), n)
        run = np.cumsum(v[i:high])
        k = int(np.searchsorted(run, threshold, "left"))
        out[i] = i + k + 1 if k < len(run) else n + 1
    return out


def _leaves(to: np.ndarray, size: int) -> np.ndarray:
    """The first opening at or past `size` that each place leads to, by pointer doubling."""
    to = to.copy()
    while True:
        inside = np.flatnonzero(to < size)
        if not len(inside):
            return to
        to[inside] = to[to[inside]]


#: Earlier slices that a slice's first trades are copied to. A bar is a quarter of a slice's value, and of three slices in a row the last two together hold one slice's value at least, so fewer would do.
REACH = 8


def _with_halo(trades: DataFrame, value: str, threshold: float, rows: int, bucket: int) -> DataFrame:
    """Trades with their value v and slice, and those that an earlier slice needs copied to it (own false); entry: an earlier bar may end just before the trade."""
    t = trades.select("symbol", "id", "time", "price", "qty", F.expr(VALUES[value]).cast("double").alias("v"), F.floor(F.col("time") / bucket).alias("bucket"))
    by, whole = W.partitionBy("symbol").orderBy("bucket"), W.partitionBy("symbol")
    b = t.groupBy("symbol", "bucket").agg(F.sum("v").alias("sum"), F.count("*").alias("n"))
    size = F.greatest(F.lit(4.0 * threshold), rows * F.sum("sum").over(whole) / F.sum("n").over(whole))
    before = F.coalesce(F.sum("sum").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    b = b.select("symbol", "bucket", "sum", F.coalesce(F.floor(F.try_divide(before, size)), F.lit(0)).alias("slice"))
    o = W.partitionBy("symbol").orderBy("slice")
    slices = b.groupBy("symbol", "slice").agg(F.sum("sum").alias("sum"))
    slices = slices.withColumn("end", F.sum("sum").over(o)).withColumn("start", F.col("end") - F.col("sum")).withColumn("room", F.lit(abs(threshold) * (1 + 1e-6)) + NEAR * F.sum("sum").over(whole))
    slices = slices.withColumn("earlier", F.collect_list(F.struct("slice", (F.col("end") + F.col("room")).alias("until"))).over(o.rowsBetween(-REACH, -1)))
    t = t.join(b.select("symbol", "bucket", "slice"), ["symbol", "bucket"]).join(slices.select("symbol", "slice", "start", "room", "earlier"), ["symbol", "slice"])
    # what the slice has come to before the trade before this one: if that trade closes a bar, this one opens the next. The first trade always may.
    at = W.partitionBy("symbol", "slice").orderBy("time", "id")
    come = F.sum("v").over(at) - F.col("v") - F.lag("v").over(at)
    t = t.withColumn("come", come)
    near = F.filter("earlier", lambda x: F.col("come").isNull() | (F.col("start") + F.col("come") <= x["until"]))
    copies = F.concat(F.array(F.struct(F.col("slice").alias("to"), F.lit(True).alias("own"))), F.transform(near, lambda x: F.struct(x["slice"].alias("to"), F.lit(False).alias("own"))))
    entry = F.coalesce(F.col("come") <= F.col("room"), F.lit(True))
    return t.withColumn("entry", entry).withColumn("_c", F.explode(copies)).select("symbol", F.col("_c.to").alias("slice"), F.col("_c.own").alias("own"), F.col("slice").alias("from"), "entry", "id", "time", "price", "qty", "v")


_POINTER = "symbol string, slice long, id long, time long, to_slice long, to_id long, to_time long"


def _pointers(halo: DataFrame, threshold: float) -> DataFrame:
    """Of each trade at which a slice may be entered: the first opening beyond the slice (null where there is none)."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "id"], kind="stable")
        size, n = int(frame["own"].sum()), len(frame)
        to = next_openings(frame["v"].to_numpy(), threshold)
        out = np.flatnonzero(frame["entry"].to_numpy()[:size])
        far = _leaves(to[:size], size)[out] if size else out
        there = far < n
        place = np.where(there, far, 0)
        ids, times, parts = (frame[c].to_numpy()[place] for c in ("id", "time", "from"))
        made = {"symbol": key[0], "slice": key[1], "id": frame["id"].to_numpy()[out], "time": frame["time"].to_numpy()[out], "to_slice": parts, "to_id": ids, "to_time": times}
        made = pd.DataFrame(made).astype({"to_slice": "Int64", "to_id": "Int64", "to_time": "Int64"})
        made.loc[~there, ["to_slice", "to_id", "to_time"]] = pd.NA
        return made

    return halo.groupBy("symbol", "slice").applyInPandas(run, _POINTER)


def _entries(pointers: DataFrame, halo: DataFrame) -> DataFrame:
    """(symbol, slice, time, id): the opening at which the bars of each symbol enter each slice that has one."""
    # slices are ranked, so that the pointer over 2**k slices ends in a later group of 2**k
    rank = pointers.select("symbol", "slice").distinct().withColumn("rank", F.row_number().over(W.partitionBy("symbol").orderBy("slice")) - 1)
    p = pointers.join(rank, ["symbol", "slice"]).join(rank.select("symbol", F.col("slice").alias("to_slice"), F.col("rank").alias("to_rank")), ["symbol", "to_slice"], "left")
    # all slices meet here: what one trade leads to was worked out in its slice
    hops = [cut(p.select("symbol", "rank", "time", "id", "to_rank", "to_time", "to_id"))]
    most = rank.agg(F.max("rank")).first()[0]
    if most is None:
        return halo.select("symbol", "slice", F.col("time").alias("entry_time"), F.col("id").alias("entry_id")).limit(0)
    while 1 << len(hops) <= most:
        k, one = len(hops), hops[-1]
        second = one.select("symbol", F.col("rank").alias("to_rank"), F.col("time").alias("to_time"), F.col("id").alias("to_id"), *(F.col(f"to_{c}").alias(f"_{c}") for c in ("rank", "time", "id")))
        both = one.join(second, ["symbol", "to_rank", "to_time", "to_id"], "left")
        # a pointer that already left its group of 2**k slices stays; else it goes on from where it got to
        left = F.shiftright("to_rank", k) > F.shiftright("rank", k)
        hops.append(cut(both.select("symbol", "rank", "time", "id", *(F.when(left, F.col(f"to_{c}")).otherwise(F.col(f"_{c}")).alias(f"to_{c}") for c in ("rank", "time", "id")))))
    first = halo.where("own").groupBy("symbol").agg(F.min(F.struct("time", "id")).alias("x")).select("symbol", F.lit(0).alias("rank"), "x.time", "x.id")
    found = first
    for k in reversed(range(len(hops))):
        # the entries of groups of 2**(k + 1) slices lead to those of their later halves
        step = found.join(hops[k], ["symbol", "rank", "time", "id"]).where("to_rank is not null").select("symbol", F.col("to_rank").alias("rank"), F.col("to_time").alias("time"), F.col("to_id").alias("id"))
        found = cut(found.unionByName(step).distinct())
    # a slice is entered at the first opening in it
    ranked = found.join(rank, ["symbol", "rank"])
    return ranked.groupBy("symbol", "slice").agg(F.min(F.struct("time", "id")).alias("x")).select("symbol", "slice", F.col("x.time").alias("entry_time"), F.col("x.id").alias("entry_id"))


_BAR = "symbol string, slice long, k long, first_time long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, tick_count long, closed boolean"


def _bars(halo: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """The bars that open in each slice, from its entry on; the one open at the end goes on into the halo."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["time", "id"], kind="stable")
        names = [c.split()[0] for c in _BAR.split(", ")]
        start = frame[["entry_time", "entry_id"]].iloc[0]
        size, n = int(frame["own"].sum()), len(frame)
        if not size or pd.isna(start.iloc[0]):
            return pd.DataFrame(columns=names)
        times, ids, v = (frame[c].to_numpy() for c in ("time", "id", "v"))
        place = np.flatnonzero((times[:size] == start.iloc[0]) & (ids[:size] == start.iloc[1]))
        to, opens = next_openings(v, threshold), []
        at = int(place[0]) if len(place) else size
        while at < size:
            opens.append(at)
            at = int(to[at])
        if not opens:
            return pd.DataFrame(columns=names)
        opens = np.array(opens)
        ends = np.minimum(to[opens], n)
        price, qty = frame["price"].to_numpy(), frame["qty"].to_numpy()
        runs = np.stack([opens, ends], 1).ravel()
        runs = runs[:-1] if runs[-1] == n else runs
        sums = lambda f, x: f.reduceat(x, runs)[::2]
        made = {
            "symbol": key[0], "slice": key[1], "k": np.arange(len(opens)), "first_time": times[opens], "timestamp": times[ends - 1],
            "open": price[opens], "high": sums(np.maximum, price), "low": sums(np.minimum, price), "close": price[ends - 1], "volume": sums(np.add, qty), "dollar_volume": sums(np.add, price * qty),
            "tick_count": ends - opens, "closed": to[opens] <= n,
        }
        return pd.DataFrame(made)[names]

    with_entry = halo.join(entries, ["symbol", "slice"], "left")
    return with_entry.groupBy("symbol", "slice").applyInPandas(run, _BAR)


def threshold_bars(trades: DataFrame, value: str, threshold: float, rows: int = ROWS, bucket: int = BUCKET) -> DataFrame:
    """Bars of a fixed volume or dollar volume (or count of trades), equal to those of a fold over each symbol."""
    halo = cut(_with_halo(trades, value, threshold, rows, bucket))
    bars = _bars(halo, _entries(_pointers(halo, threshold), halo), threshold).where("closed")
    counts = bars.groupBy("symbol", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(W.partitionBy("symbol").orderBy("slice").rowsBetween(W.unboundedPreceding, -1))
    counts = counts.select("symbol", "slice", F.coalesce(before, F.lit(0)).alias("before"))
    duration = F.when(F.col("tick_count") > 1, (F.col("timestamp") - F.col("first_time")) * 1000).otherwise(0)
    return bars.join(counts, ["symbol", "slice"]).select("symbol", (F.col("before") + F.col("k")).alias("bar_idx"), "timestamp", "open", "high", "low", "close", "volume", "dollar_volume", "tick_count", duration.alias("duration_us"))
