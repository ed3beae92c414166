"""Labels of bars, sample weights, folds and bet sizes."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.features import last, ordered
from barloom.operators.slices import in_slices, running
from barloom.sources.cut import cut


def triple_barrier(bars: DataFrame, vol: str = "vol", hold: int = 50, stop: float = 2.0, take: float = 2.0, ends: bool = False) -> DataFrame:
    """-1 if the low meets the lower barrier first within `hold` bars, 1 if the high meets the upper one, else null; the lower one counts first in a bar.

    ends: also `end`, the number of the bar that meets a barrier, or of the last one looked at.
    """
    ahead = ordered().rowsBetween(1, hold)
    b = bars.withColumn("sl_price", F.col("close") * (1 - stop * F.col(vol))).withColumn("pt_price", F.col("close") * (1 + take * F.col(vol)))
    b = b.withColumn("ahead", F.collect_list(F.struct("low", "high")).over(ahead))
    met = lambda x: F.coalesce((x["low"] <= F.col("sl_price")) | (x["high"] >= F.col("pt_price")), F.lit(False))
    b = b.withColumn("hit", F.get(F.filter("ahead", met), F.lit(0)))
    place = F.array_position(F.transform("ahead", met), True)
    end = F.col("bar_idx") + F.when(place > 0, place).otherwise(F.size("ahead"))
    label = F.when(F.col("hit").isNotNull(), F.when(F.col("hit.low") <= F.col("sl_price"), -1).otherwise(1))
    return b.select("symbol", "bar_idx", "timestamp", label.alias("label"), "sl_price", "pt_price", F.last("timestamp").over(ordered().rowsBetween(0, hold)).alias("time_barrier_ts"), *([end.alias("end")] if ends else []))


def trend_scanning(bars: DataFrame, horizons=(5, 10, 20, 40, 80), least: float = 1.0) -> DataFrame:
    """The sign of the forward trend with the largest t value over the horizons; null below `least`."""
    t = []
    for h in horizons:
        w = ordered().rowsBetween(0, h)
        n, x, y = F.count("close").over(w), F.col("bar_idx").cast("double"), F.col("close")
        sxx, syy, slope = F.regr_sxx(y, x).over(w), F.regr_syy(y, x).over(w), F.regr_slope(y, x).over(w)
        mse = F.greatest(syy - slope * slope * sxx, F.lit(0.0)) / F.nullif(n - 2, F.lit(0))
        value = F.when(n >= 3, slope / F.sqrt(F.greatest(mse / sxx, F.lit(1e-30)))).when(n == 2, slope).otherwise(F.lit(0.0))
        t.append(F.struct(F.abs(value).alias("size"), F.lit(-h).alias("order"), value.alias("t")))
    best = F.array_max(F.array(*t))
    b = bars.withColumn("best", best)
    label = F.when(F.col("best.size") >= least, F.when(F.col("best.t") > 0, 1).otherwise(-1))
    return b.select("symbol", "bar_idx", "timestamp", label.alias("label"), (-F.col("best.order")).alias("best_horizon"), F.col("best.t").alias("t_value"))


def directional_changes(bars: DataFrame, thetas=(0.01, 0.02)) -> DataFrame:
    """Reversals by theta from the last extreme: one fold for each symbol and theta.

    thetas: numbers for all symbols, or a table (symbol, theta). overshoot is how far
    the price went on past the last reversal, in thetas of its price. A series under
    two bars has no events.
    """

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("bar_idx")
        price, rows = frame["close"].to_numpy(), []
        if len(price) >= 2:
            up, extreme, start, theta = price[1] >= price[0], price[0], price[0], key[1]
            for i in range(1, len(price)):
                p = price[i]
                extreme = max(extreme, p) if up else min(extreme, p)
                if extreme > 0 and (extreme - p if up else p - extreme) / extreme >= theta:
                    unit = start * theta
                    rows.append((key[0], int(frame["bar_idx"].iat[i]), int(frame["timestamp"].iat[i]), -1 if up else 1, theta, abs(extreme - start) / unit if unit > 0 else 0.0))
                    up, extreme, start = not up, p, p
        return pd.DataFrame(rows, columns=["symbol", "bar_idx", "timestamp", "label", "theta", "overshoot"])

    b = bars.select("symbol", "bar_idx", "timestamp", "close")
    each = b.join(thetas, "symbol") if isinstance(thetas, DataFrame) else b.withColumn("theta", F.explode(F.array(*(F.lit(float(t)) for t in thetas))))
    return each.groupBy("symbol", "theta").applyInPandas(run, "symbol string, bar_idx long, timestamp long, label int, theta double, overshoot double")


def thetas_from_volatility(bars: DataFrame, window: int = 50, multipliers=(2.0, 3.0, 5.0, 8.0, 13.0)) -> DataFrame:
    """(symbol, theta): multiples of the deviation of a symbol's last `window` log returns (of 0.01 without returns).

    The last returns set the thetas of the whole series, so early events look ahead.
    """
    r = F.ln("close") - F.ln(F.lag("close").over(ordered()))
    late = bars.withColumn("_r", r).withColumn("_k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("bar_idx")))).where(F.col("_k") <= window)
    vol = late.groupBy("symbol").agg(F.greatest(F.coalesce(F.stddev_pop("_r"), F.lit(0.01)), F.lit(1e-8)).alias("vol"))
    return vol.select("symbol", F.explode(F.array(*(F.greatest(F.col("vol") * float(m), F.lit(1e-6)) for m in multipliers))).alias("theta"))


#: The ways to label bars. Only the first knows barriers; the others take their own parameters.
LABELINGS = {
    "triple_barrier": triple_barrier,
    "trend_scanning": trend_scanning,
    "directional_change": lambda bars, window=50, multipliers=(2.0, 3.0, 5.0, 8.0, 13.0): directional_changes(bars, thetas_from_volatility(bars, window, multipliers)),
}


def labels(bars: DataFrame, method: str, **parameters) -> DataFrame:
    if method not in LABELINGS:
        raise ValueError(f"unknown labelling: {method}")
    return LABELINGS[method](bars, **parameters)


def weights(bars: DataFrame, hold: int = 50, half_life: float = -1.0) -> DataFrame:
    """Uniqueness, attribution and time decay of the label spans [i, i + hold), and their normalised product."""
    spans = bars.select("symbol", F.col("bar_idx").alias("i"), F.least(F.col("bar_idx") + hold, F.max("bar_idx").over(W.partitionBy("symbol"))).alias("end"))
    steps = spans.select("symbol", F.col("i").alias("bar_idx"), F.lit(1).alias("d")).unionByName(spans.select("symbol", F.col("end").alias("bar_idx"), F.lit(-1).alias("d")))
    live = steps.groupBy("symbol", "bar_idx").agg(F.sum("d").alias("d"))
    live = live.withColumn("concurrency", F.sum("d").over(ordered().rowsBetween(W.unboundedPreceding, 0)))
    b = bars.join(live.select("symbol", "bar_idx", "concurrency"), ["symbol", "bar_idx"])
    b = b.withColumn("ret", F.coalesce(F.abs(F.ln("close") - F.ln(F.lag("close").over(ordered()))), F.lit(0.0))).withColumn("n_bars", F.count("*").over(W.partitionBy("symbol"))).withColumn("end", F.least(F.col("bar_idx") + hold, F.col("n_bars") - 1))
    span, inv = ordered().rowsBetween(0, hold - 1), F.when(F.col("concurrency") > 0, 1.0 / F.col("concurrency"))
    b = b.withColumn("uniqueness", F.when(F.col("end") > F.col("bar_idx"), F.sum(inv).over(span) / (F.col("end") - F.col("bar_idx"))).otherwise(0.0))
    b = b.withColumn("moved", F.when(F.col("end") > F.col("bar_idx"), F.sum(F.when(F.col("bar_idx") < F.col("n_bars") - 1, F.col("ret")).otherwise(0.0)).over(span)).otherwise(0.0))
    whole = W.partitionBy("symbol")
    b = b.withColumn("attribution", F.coalesce(F.try_divide("moved", F.sum("moved").over(whole)), 1.0 / F.count("*").over(whole)))
    age = (F.max("timestamp").over(whole) - F.col("timestamp")) / half_life if half_life > 0 else F.lit(0.0)
    b = b.withColumn("decay", F.pow(F.lit(2.0), -age)).withColumn("raw", F.greatest(F.col("uniqueness") * F.col("attribution") * F.col("decay"), F.lit(1e-10)))
    return b.select("symbol", "bar_idx", "concurrency", "uniqueness", "attribution", "decay", (F.col("raw") / F.sum("raw").over(whole)).alias("weight"))


#: Bars of a slice in running sums along a series.
SLICE = 100_000


def span_weights(bars: DataFrame, spans: DataFrame, half_life: float = -1.0, returns=None, size: int = SLICE) -> DataFrame:
    """Uniqueness, attribution, decay and weight of any label spans, the columns of spans kept.

    bars: numbered from 0 by bar_idx, with timestamp and close. spans: (symbol, start,
    end), the bars from start to the one before end, cut to the bars there are; one that
    holds none has no uniqueness and no return. Uniqueness is the mean of 1 / (spans open
    at a bar); attribution the span's share of all spans' summed absolute returns
    (simple ones unless a column is given), equal shares where nothing moved; decay
    halves every half_life of the time between a span's first bar and the latest first
    bar; weights are their products, 1e-10 at least, over the sum of a symbol's.

    Running sums along each series are worked out in slices, and a span is two lookups
    in them, however long it is.
    """
    # each table that several sums below start from is cut, or all of them would be worked out anew for each
    bars = cut(bars.select("symbol", "bar_idx", "timestamp", "close", *([] if returns is None else [returns.alias("_given")])))
    n = bars.groupBy("symbol").agg(F.count("*").alias("_n"))
    s = spans.join(n, "symbol").withColumn("_from", F.greatest(F.col("start"), F.lit(0))).withColumn("_to", F.least(F.col("end"), F.col("_n")))
    s = cut(s.withColumn("_full", F.coalesce(F.col("_from") < F.col("_to"), F.lit(False))))
    step = lambda at, d: s.where("_full").select("symbol", F.col(at).alias("bar_idx"), F.lit(d).alias("d"))
    steps = step("_from", 1).unionByName(step("_to", -1)).groupBy("symbol", "bar_idx").agg(F.sum("d").alias("d"))
    move = (lambda b: b.withColumn("_ret", F.coalesce(F.abs("_given"), F.lit(0.0)))) if returns is not None else (lambda b: b.withColumn("_ret", F.coalesce(F.abs(F.try_divide(F.col("close"), F.lag("close").over(ordered())) - 1), F.lit(0.0))))
    b = in_slices(bars, move, size, 1).join(steps, ["symbol", "bar_idx"], "left")
    b = running(b.select("symbol", "bar_idx", "timestamp", "_ret", F.coalesce("d", F.lit(0)).alias("d")), size, concurrency=F.col("d"))
    b = cut(b).withColumn("_inv", F.when(F.col("concurrency") > 0, 1.0 / F.col("concurrency")).otherwise(0.0))
    b = cut(running(b, size, _sum_inv=F.col("_inv"), _sum_ret=F.col("_ret")))
    first = b.select("symbol", F.col("bar_idx").alias("_from"), (F.col("_sum_inv") - F.col("_inv")).alias("_inv_0"), (F.col("_sum_ret") - F.col("_ret")).alias("_ret_0"), F.col("timestamp").alias("_time"))
    final = b.select("symbol", (F.col("bar_idx") + 1).alias("_to"), F.col("_sum_inv").alias("_inv_1"), F.col("_sum_ret").alias("_ret_1"))
    s = s.join(first, ["symbol", "_from"], "left").join(final, ["symbol", "_to"], "left")
    s = s.withColumn("uniqueness", F.when(F.col("_full"), (F.col("_inv_1") - F.col("_inv_0")) / (F.col("_to") - F.col("_from"))).otherwise(0.0))
    s = s.withColumn("_moved", F.when(F.col("_full"), F.greatest(F.col("_ret_1") - F.col("_ret_0"), F.lit(0.0))).otherwise(0.0))
    s = cut(s)
    # sums of a symbol are one row each, joined back: no window holds all of its spans
    whole = s.groupBy("symbol").agg(F.sum("_moved").alias("_all"), F.count("*").alias("_spans"), F.max("_time").alias("_last"))
    s = s.join(whole, "symbol").withColumn("attribution", F.when(F.col("_all") > 0, F.col("_moved") / F.col("_all")).otherwise(1.0 / F.col("_spans")))
    s = s.withColumn("decay", F.pow(F.lit(2.0), -(F.col("_last") - F.col("_time")) / half_life) if half_life > 0 else F.lit(1.0))
    s = s.withColumn("_raw", F.greatest(F.coalesce(F.col("uniqueness") * F.col("attribution") * F.col("decay"), F.lit(0.0)), F.lit(1e-10)))
    total = s.groupBy("symbol").agg(F.sum("_raw").alias("_total"))
    return s.join(total, "symbol").select(*(s[c] for c in spans.columns), "uniqueness", "attribution", "decay", (F.col("_raw") / F.col("_total")).alias("weight"))


def purged_folds(bars: DataFrame, k: int = 5, hold: int = 50, embargo: float = 0.01, end=None) -> DataFrame:
    """For each fold and bar: test, train, or neither (purged or under embargo).

    end: the column with the last bar that a bar's label has looked at, if that is not
    `hold` bars on. A bar before the test bars is purged where its label reaches them.
    """
    counts = bars.groupBy("symbol").agg(F.count("*").alias("n"))
    label_end = F.least(F.col("bar_idx") + hold, F.col("n") - 1) if end is None else F.col("_end")
    b = bars.select("symbol", "bar_idx", *([] if end is None else [end.alias("_end")])).join(counts, "symbol").withColumn("size", F.floor(F.col("n") / k))
    b = b.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    start, last = F.col("fold") * F.col("size"), F.when(F.col("fold") == k - 1, F.col("n")).otherwise((F.col("fold") + 1) * F.col("size"))
    role = F.when((F.col("bar_idx") >= start) & (F.col("bar_idx") < last), "test").when((F.col("bar_idx") < start) & (label_end >= start), "purged").when((F.col("bar_idx") >= last) & (F.col("bar_idx") < last + F.floor(F.col("n") * embargo)), "embargo").otherwise("train")
    return b.select("symbol", "fold", "bar_idx", role.alias("role"))


def bet_size(p) -> F.Column:
    return F.least(F.greatest(2 * p - 1, F.lit(0.0)), F.lit(1.0))


def discretize(x, step: int = 10) -> F.Column:
    """The nearest level, the lower one of two as near."""
    levels = F.array(*(F.lit(i / step) for i in range(step + 1)))
    return F.array_min(F.transform(levels, lambda v: F.struct(F.abs(x - v).alias("d"), v.alias("v"))))["v"]


def concurrency(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (symbol, time, ...) with n_open, how many spans (symbol, start, end) hold their time, ends included; 1 at least.

    A running sum over starts, points and ends of a symbol in one order, not a join of points and spans.
    """
    none = F.lit(None).cast(points.select(F.struct("*").alias("p")).schema["p"].dataType)
    step = spans.select("symbol", F.col("start").alias("_t"), F.lit(0).alias("_kind"), F.lit(1).alias("_d"), none.alias("p")).unionByName(spans.select("symbol", F.col("end").alias("_t"), F.lit(2).alias("_kind"), F.lit(-1).alias("_d"), none.alias("p")))
    rows = points.select("symbol", F.col("time").alias("_t"), F.lit(1).alias("_kind"), F.lit(0).alias("_d"), F.struct("*").alias("p")).unionByName(step)
    live = F.sum("_d").over(W.partitionBy("symbol").orderBy("_t", "_kind").rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("n_open", live).where("_kind = 1").select("p.*", F.greatest("n_open", F.lit(1)).cast("long").alias("n_open"))


def bet_sizes(p, n_open=None) -> F.Column:
    """Size of a probability, averaged over the bets open with it, at the nearest level."""
    size = bet_size(p)
    return discretize(size if n_open is None else size / F.greatest(n_open, F.lit(1)))
