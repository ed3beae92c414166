"""Unit-root, trend-break and recursive-residual statistics of bars, and volatility with decaying weights.

A Dickey-Fuller regression with a constant and one lag (the difference on the
level before and the difference before) is a closed form of six centred second
moments. Fixed and growing frames take them as window aggregates; a supremum
over many frames with one end in common is one fold that adds row by row.
Statistics of whole series are null for series too short for them.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions.differences import convolved
from barloom.functions.features import KEYS, lag, ordered, with_returns
from barloom.functions.frames import TINY, frame, total
from barloom.operators.slices import in_slices

# The response surface of the test's p values (constant, one series): normal quantile = sum of c[k] * t**k.
P_VALUE = (2.1659, 1.4412, 0.038269)


def critical_t(quantile: float = -1.6448536269514722) -> float:
    """The t value below which the p value is under the normal quantile's probability (5 % by default)."""
    a, b, c = P_VALUE[2], P_VALUE[1], P_VALUE[0] - quantile
    return (-b + math.sqrt(b * b - 4 * a * c)) / (2 * a)


def t_value(n, dd, xx, zz, dx, dz, xz) -> Column:
    """t of the level's coefficient from n rows' centred second moments, in any common scale; null if they have no fit."""
    det = xx * zz - xz * xz
    level, before = F.try_divide(dx * zz - dz * xz, det), F.try_divide(dz * xx - dx * xz, det)
    rest = dd - level * dx - before * dz
    return F.when((n > 3) & (det > 1e-12 * xx * zz) & (rest > 0), level * F.sqrt(F.try_divide((n - 3) * det, rest * zz)))


def with_lags(bars: DataFrame, x) -> DataFrame:
    """d, the difference of x; l, its level before; z, its difference before. The first two bars have none."""
    b = bars.withColumn("_x", x).withColumn("_l", lag("_x")).withColumn("_d", F.col("_x") - F.col("_l"))
    full = F.lag("_x", 2).over(ordered()).isNotNull()
    return b.withColumn("z", F.when(full, lag("_d"))).withColumn("d", F.when(full, F.col("_d"))).withColumn("l", F.when(full, F.col("_l"))).drop("_x", "_l", "_d")


def window_t(w) -> Column:
    """t_value over the rows of window w."""
    c = lambda a, b: F.covar_pop(a, b).over(w)
    return t_value(F.count("d").over(w), c("d", "d"), c("l", "l"), c("z", "z"), c("d", "l"), c("d", "z"), c("l", "z"))


_PAIRS = ("dd", "ll", "zz", "dl", "dz", "lz")


def supremum_t(rows: Column, least: int) -> Column:
    """Largest t_value of the first m rows (structs of d, l, z) of an array, m from `least` on; null if there is none."""
    base = F.element_at(rows, 1)["l"]
    centred = F.transform(rows, lambda r: F.struct(r["d"].alias("d"), (r["l"] - base).alias("l"), r["z"].alias("z")))
    names = ("n", "d", "l", "z", *_PAIRS)
    zero = F.struct(*(F.lit(0.0).alias(x) for x in names), F.lit(None).cast("double").alias("top"))

    def best(a):
        m = {p: a[p] / F.nullif(a["n"], F.lit(0.0)) - a[p[0]] * a[p[1]] / F.nullif(a["n"] * a["n"], F.lit(0.0)) for p in _PAIRS}
        return F.when(a["n"] >= least, F.greatest(a["top"], t_value(a["n"], m["dd"], m["ll"], m["zz"], m["dl"], m["dz"], m["lz"])))

    def step(a, r):
        # the rows so far are judged as the next one comes, so sums are not written out twice
        return F.struct((a["n"] + 1).alias("n"), *((a[x] + r[x]).alias(x) for x in "dlz"), *((a[p] + r[p[0]] * r[p[1]]).alias(p) for p in _PAIRS), best(a).alias("top"))

    return F.when(F.size(rows) >= least, F.aggregate(centred, zero, step, best))


def _rows(first: int, final: int) -> Column:
    r = F.when(F.col("d").isNotNull(), F.struct("d", "l", "z"))
    return frame(r, first, final)


def unit_root(bars: DataFrame, x=None, n: int = 50, keep=KEYS) -> DataFrame:
    """Of the n bars before each: the larger t of its two halves, and the supremum over its first max(15, n / 3) bars and more."""
    b = with_lags(bars, F.ln("close") if x is None else x)
    half, o = n // 2, ordered()
    early, late = window_t(o.rowsBetween(2 - n, half - n - 1)), window_t(o.rowsBetween(2 + half - n, -1))
    full = F.col("bar_idx") >= n
    b = b.withColumn("_a", early).withColumn("_b", late).withColumn("_s", supremum_t(_rows(2 - n, -1), max(15, n // 3) - 2))
    return b.select(*keep, F.when(full & F.col("_a").isNotNull() & F.col("_b").isNotNull(), F.greatest("_a", "_b")).alias("chow_type_df"), F.when(full, F.col("_s")).alias("rolling_sadf"))


def sadf(bars: DataFrame, x=None, least: int = 20) -> DataFrame:
    """(symbol, sadf): the supremum over the first m bars of a series, m from `least` on."""
    b = with_lags(bars, F.ln("close") if x is None else x).withColumn("t", window_t(ordered().rowsBetween(W.unboundedPreceding, 0)))
    return b.groupBy("symbol").agg(F.when(F.count("*") >= least + 5, F.max(F.when(F.col("bar_idx") >= least - 1, F.col("t")))).alias("sadf"))


def gsadf(bars: DataFrame, x=None, least: int = 20, most: int = 500) -> DataFrame:
    """(symbol, gsadf): the supremum over all runs of `least` to `most` bars; of each end one fold goes back over the starts."""
    b = with_lags(bars, F.ln("close") if x is None else x)
    b = b.withColumn("t", supremum_t(F.reverse(_rows(3 - most, 0)), least - 2))
    return b.groupBy("symbol").agg(F.when(F.count("*") >= least + 5, F.max("t")).alias("gsadf"))


def order_grid(step: float = 0.05) -> list[float]:
    """The orders of difference that are tried: multiples of step up to 1."""
    return [round(step * k, 4) for k in range(1, int(round(1 / step)) + 1)]


def least_order(values: DataFrame, grid: list[float]) -> DataFrame:
    """(symbol, min_d) of the differences (symbol, bar_idx, values) of a grid of orders: the least one whose series of 20 values or more rejects a unit root; else 1.

    The moments of the regression are sums over bars; each slice of 10,000 bars gets the two before it for its lags.
    """
    each = values.select("symbol", "bar_idx", F.posexplode("values").alias("k", "v")).where("v is not null")

    def lagged(b):
        w = W.partitionBy("symbol", "k").orderBy("bar_idx")
        b = b.withColumn("l", F.lag("v").over(w)).withColumn("d", F.col("v") - F.col("l"))
        return b.withColumn("z", F.lag("d").over(w))

    each = in_slices(each, lagged, 10_000, 2)
    full, c = F.col("z").isNotNull(), lambda a, b: F.covar_pop(F.when(F.col("z").isNotNull(), F.col(a)), F.col(b))
    test = each.groupBy("symbol", "k").agg(F.count("*").alias("n"), t_value(F.count_if(full), c("d", "d"), c("l", "l"), c("z", "z"), c("d", "l"), c("d", "z"), c("l", "z")).alias("t"))
    order = F.get(F.array(*(F.lit(d) for d in grid)), F.col("k"))
    found = test.where((F.col("n") >= 20) & (F.col("t") < critical_t())).groupBy("symbol").agg(F.min(order).alias("found"))
    return values.select("symbol").distinct().join(found, "symbol", "left").select("symbol", F.coalesce("found", F.lit(1.0)).alias("min_d"))


def least_d(bars: DataFrame, x=None, step: float = 0.05, threshold: float = 1e-5) -> DataFrame:
    """(symbol, min_d): the least order of difference, in steps up to 1, whose series of 20 values or more rejects a unit root; else 1."""
    grid = order_grid(step)
    return least_order(convolved(bars, F.ln("close") if x is None else x, grid, threshold), grid)


def recursive_cusum(x, n: int = 50) -> Column:
    """Largest |sum of one-step errors| of a trend fitted to the rows so far, over the n rows before, in deviations times sqrt(errors)."""
    least = max(3, n // 4)
    m = n - least
    y = frame(x, -n, -1)
    base = F.element_at(y, 1)
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("k", "y", "ty", "run", "top", "square")))

    def step(a, v):
        k, st, stt = a["k"], a["k"] * (a["k"] - 1) / 2, (a["k"] - 1) * a["k"] * (2 * a["k"] - 1) / 6
        slope = (k * a["ty"] - st * a["y"]) / (k * stt - st * st)
        error = F.when(k >= least, v - a["y"] / k - slope * (k - st / k)).otherwise(0.0)
        return F.struct((k + 1).alias("k"), (a["y"] + v).alias("y"), (a["ty"] + k * v).alias("ty"), (a["run"] + error).alias("run"), F.greatest(a["top"], F.abs(a["run"] + error)).alias("top"), (a["square"] + error * error).alias("square"))

    def finish(a):
        sd = F.sqrt(F.greatest(a["square"] / m - a["run"] / m * a["run"] / m, F.lit(0.0)))
        return F.when(sd < TINY, 0.0).otherwise(a["top"] / sd / math.sqrt(m))

    return F.when(F.col("bar_idx") >= n, F.aggregate(F.transform(y, lambda v: v - base), zero, step, finish))


def chow(bars: DataFrame, x=None, part: float = 0.5) -> DataFrame:
    """(symbol, chow_f): F value of separate trends before and after the bar at `part` of a series; 0 where either has under three bars or they fit exactly."""
    b = bars.select("symbol", F.col("bar_idx").cast("double").alias("t"), (F.ln("close") if x is None else x).alias("y"), F.count("*").over(W.partitionBy("symbol")).alias("n")).withColumn("at", F.floor(F.col("n") * part))

    def rest(rows):
        t = F.when(rows, F.col("t"))
        return F.regr_syy("y", t) - F.regr_sxy("y", t) * F.regr_sxy("y", t) / F.nullif(F.regr_sxx("y", t), F.lit(0.0))

    r = b.groupBy("symbol", "n", "at").agg(rest(F.lit(True)).alias("whole"), (rest(F.col("t") < F.col("at")) + rest(F.col("t") >= F.col("at"))).alias("parts"))
    fits = (F.col("at") >= 3) & (F.col("at") <= F.col("n") - 3) & (F.col("n") > 4) & (F.col("parts") > 0)
    return r.select("symbol", F.when(fits, (F.col("whole") - F.col("parts")) / 2 / F.try_divide(F.col("parts"), F.col("n") - 4)).otherwise(0.0).alias("chow_f"))


def cusum_events(bars: DataFrame, threshold: float, x: str = "close") -> DataFrame:
    """Bars where the differences of x, less their mean, have summed to more than threshold on either side; both sums then start anew."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("bar_idx")
        moves, up, down, out = rows[x].diff(), 0.0, 0.0, []
        for at, time, move in zip(rows["bar_idx"].tolist(), rows["timestamp"].tolist(), (moves - moves.mean()).tolist()):
            if move == move:
                up, down = max(0.0, up + move), min(0.0, down + move)
                if up > threshold or down < -threshold:
                    out.append((key[0], at, time, 1 if up > threshold else -1))
                    up = down = 0.0
        return pd.DataFrame(out, columns=["symbol", "bar_idx", "timestamp", "way"])

    return bars.select("symbol", "bar_idx", "timestamp", x).groupBy("symbol").applyInPandas(run, "symbol string, bar_idx long, timestamp long, way int")


def decayed_volatility(bars: DataFrame, span: int = 20) -> DataFrame:
    """bars with vol, the deviation of log returns with weights (1 - 2 / (span + 1))**age, bias taken out; the last known one, or else the first, where there are under span / 2 returns; 1e-12 at least.

    Rows are left out of a frame where their weight is below the last digit of a double.
    """
    keep = 1 - 2 / (span + 1)
    zero = F.struct(*(F.lit(0.0).alias(c) for c in ("w", "ww", "s", "q")))
    step = lambda a, r: F.struct((a["w"] * keep + 1).alias("w"), (a["ww"] * keep * keep + 1).alias("ww"), (a["s"] * keep + r).alias("s"), (a["q"] * keep + r * r).alias("q"))
    spread = lambda a: F.sqrt(F.greatest(a["q"] / a["w"] - a["s"] / a["w"] * a["s"] / a["w"], F.lit(0.0)) * a["w"] * a["w"] / F.nullif(a["w"] * a["w"] - a["ww"], F.lit(0.0)))
    f = frame("r", -int(40 / -math.log(keep)), 0)
    b = with_returns(bars).withColumn("_v", F.when(F.size(f) >= max(2, span // 2), F.aggregate(f, zero, step, spread)))
    # a frame to the end of a series would be read anew for every row; before the first known one there is only that
    first = F.min_by("_v", F.when(F.col("_v").isNotNull(), F.col("bar_idx"))).over(W.partitionBy("symbol"))
    known = F.last("_v", True).over(ordered().rowsBetween(W.unboundedPreceding, 0))
    return b.withColumn("vol", F.greatest(F.coalesce(known, first), F.lit(1e-12))).drop("_v", "prev", "r", "s", "r1")
