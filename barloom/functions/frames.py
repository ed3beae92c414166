"""Features of bars that look at the values of a frame one by one.

A frame is an array column of at most a few thousand numbers, gathered by the
window all features share; higher-order functions fold it inside the JVM. Only
the Lempel-Ziv count, a parse without a closed form, is an Arrow UDF on frames.
Nulls in a frame are left out; a frame too short for a feature gives null.
"""

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from barloom.functions.features import KEYS, kurt, lag, last, log, ordered, ratio, skew, with_returns

TINY = 1e-15


def frame(x, first: int, final: int) -> Column:
    return F.collect_list(x).over(ordered().rowsBetween(first, final))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def difference_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Binomial weights of (1 - L)**d, newest first, down to the last one not below threshold."""
    out = [1.0]
    while abs(step := out[-1] * (len(out) - 1 - d) / len(out)) >= threshold:
        out.append(step)
    return out


def fractional_difference(x, d: float, threshold: float = 1e-5) -> Column:
    """Fixed-width fractional difference of column x; null until the frame is full."""
    weights = difference_weights(d, threshold)
    oldest_first = F.array(*(F.lit(w) for w in reversed(weights)))
    full = F.col("bar_idx") >= len(weights) - 1
    return F.when(full, total(F.zip_with(frame(x, 1 - len(weights), 0), oldest_first, lambda a, b: a * b)))


def level_cusum(x, n: int = 50) -> Column:
    """Largest |sum of deviations from the mean| of the n rows before, in standard deviations times sqrt(n)."""
    w = ordered().rowsBetween(-n, -1)
    mean, sd = F.avg(x).over(w), F.stddev_samp(x).over(w)
    zero = F.struct(F.lit(0.0).alias("run"), F.lit(0.0).alias("top"))
    step = lambda a, y: F.struct((a.run + y.y - y.m).alias("run"), F.greatest(a.top, F.abs(a.run + y.y - y.m)).alias("top"))
    pairs = F.transform(frame(x, -n, -1), lambda y: F.struct(y.alias("y"), mean.alias("m")))
    largest = F.aggregate(pairs, zero, step, lambda a: a.top)
    return F.when(F.col("bar_idx") >= n, F.when(sd < TINY, 0.0).otherwise(largest / sd / math.sqrt(n)))


TRENDS = {"poly": lambda t, n: float(t), "exp": lambda t, n: math.exp(t / n), "power": lambda t, n: math.sqrt(t)}


def trend_t(x, trend: str, n: int = 50) -> Column:
    """t value of the slope of the n rows before on a fixed trend; the design is fixed, so the slope is a weighted sum."""
    at = [TRENDS[trend](t, n) for t in range(1, n + 1)]
    mean = sum(at) / n
    sxx = sum((a - mean) ** 2 for a in at)
    slope = total(F.zip_with(frame(x, -n, -1), F.array(*(F.lit((a - mean) / sxx) for a in at)), lambda a, b: a * b))
    syy = F.var_samp(x).over(ordered().rowsBetween(-n, -1)) * (n - 1)
    se = F.sqrt(F.greatest(syy - slope * slope * sxx, F.lit(0.0)) / (n - 2) / sxx)
    return F.when((F.col("bar_idx") >= n) & (se > TINY), slope / se)


def bin_counts(values: Column, bins: int) -> Column:
    """Counts of the values in equal bins from the least to the greatest, which closes the last bin."""
    low, high = F.array_min(values), F.array_max(values)
    at = F.transform(values, lambda x: F.when(high > low, F.least(F.floor((x - low) / (high - low) * bins), F.lit(bins - 1))).otherwise(F.lit(0)))
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda b: F.size(F.filter(at, lambda x: x == b)))


def entropy(values: Column, bins: int = 10, corrected: bool = False) -> Column:
    """Of the values' histogram in nats; corrected: plus (filled bins - 1) / (2 * values). Null below five values."""
    n, counts = F.size(values), F.filter(bin_counts(values, bins), lambda c: c > 0)
    h = F.ln(n) - total(F.transform(counts, lambda c: c * F.ln(c))) / n
    return F.when(n >= 5, h + (F.size(counts) - 1) / (2 * n) if corrected else h)


def phrases(signs: str) -> float:
    """Lempel-Ziv phrases of a string over n / log2 n; a phrase ends where it has no earlier start (overlaps count)."""
    n = len(signs)
    if n <= 1:
        return 0.0
    count, at, size = 1, 0, 1
    while at + size <= n:
        if signs.find(signs[at : at + size], 0, at + size - 1) >= 0:
            size += 1
        else:
            count, at, size = count + 1, at + size, 1
    return count / (n / math.log2(n))


@pandas_udf(DoubleType())
def _phrases(signs: pd.Series) -> pd.Series:
    return signs.map(phrases, na_action="ignore")


def lempel_ziv(values: Column) -> Column:
    signs = F.concat_ws("", F.transform(values, lambda x: F.when(x > 0, "1").otherwise("0")))
    return F.when(F.size(values) >= 5, _phrases(signs))


def corwin_schultz(known: bool = False) -> Column:
    """Spread from the ranges of this bar, the one before and both together; null for the first bar. known: a range with a low of 0 counts as 0, not as infinite."""
    k = 3 - 2 * math.sqrt(2)
    if known:
        span = lambda h, low: F.when(low > 0, F.pow(F.ln(h) - F.ln(low), 2)).when(low.isNotNull(), 0.0)
    else:
        span = lambda h, low: F.pow(log(ratio(h, low)), 2)
    one = span(F.col("high"), F.col("low")) + span(lag("high"), lag("low"))
    two = span(F.greatest("high", lag("high")), F.least("low", lag("low")))
    alpha = (F.sqrt(2 * one) - F.sqrt(one)) / k - F.sqrt(two / k)
    return F.when(alpha.isNotNull(), F.greatest(2 * (F.exp(alpha) - 1) / (1 + F.exp(alpha)), F.lit(0.0)))


def direction() -> Column:
    """Sign of the last move of the close; up before the first one."""
    return F.coalesce(F.last(F.nullif(F.signum(F.col("close") - F.col("prev")), F.lit(0.0)), ignorenulls=True).over(ordered().rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0))


def breaks(bars: DataFrame, n: int = 50, keep=KEYS) -> DataFrame:
    b = bars.withColumn("x", F.ln("close"))
    return b.select(*keep, level_cusum("x", n).alias("csw_cusum"), *(trend_t("x", t, n).alias(f"martingale_{t}_t") for t in TRENDS))


def entropies(bars: DataFrame, n: int = 20, keep=KEYS) -> DataFrame:
    b = with_returns(bars).withColumn("frame", frame("r", 1 - n, 0))
    v = F.col("frame")
    return b.select(*keep, entropy(v).alias("rolling_shannon_entropy"), entropy(v, corrected=True).alias("rolling_plugin_entropy"), lempel_ziv(v).alias("rolling_lempel_ziv"))


def spreads(bars: DataFrame, n: int = 20, keep=KEYS, way: Column | None = None, known: bool = False) -> DataFrame:
    """Corwin-Schultz spread (known: see there) and tick rule, means of n bars. way: the direction of each bar, where it is known already."""
    b = with_returns(bars).withColumn("cs", corwin_schultz(known)).withColumn("way", direction() if way is None else way)
    return b.select(*keep, F.avg("cs").over(last(n)).alias("corwin_schultz_spread"), F.avg("way").over(last(n)).alias("tick_rule"))


def volume_and_duration(bars: DataFrame, n: int = 20, keep=KEYS) -> DataFrame:
    """Logs, first and second differences, and rolling moments of dollar volume, duration and log price."""
    b = bars.withColumn("log_dollar_volume", F.log1p(F.greatest("dollar_volume", F.lit(0.0)))).withColumn("log_duration", F.log1p(F.col("duration_us").cast("double"))).withColumn("log_price", F.ln("close"))
    for x in ("dollar_volume", "log_duration"):
        b = b.withColumn(f"{x}_velocity", F.col(x) - lag(x)).withColumn(f"{x}_acceleration", F.col(f"{x}_velocity") - lag(f"{x}_velocity"))
    seconds = F.col("duration_us") / 1e6  # the variance of microseconds has no digits left after its point
    b = b.withColumn("duration_s", seconds)
    return b.select(
        *keep, "log_dollar_volume", "log_duration", "dollar_volume_velocity", "dollar_volume_acceleration", "log_duration_velocity", "log_duration_acceleration",
        kurt("dollar_volume", last(n)).alias("dollar_volume_kurt"), (F.var_samp("duration_s").over(last(n)) * 1e12).alias("duration_variance"), skew("duration_s", last(n)).alias("duration_skew"), kurt("duration_s", last(n)).alias("duration_kurt"),
        skew("log_price", last(n)).alias("log_price_skew"), kurt("log_price", last(n)).alias("log_price_kurt"),
    )
