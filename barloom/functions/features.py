"""Features of bars as window expressions over one ordering, so all of them share one shuffle and one sort."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

def ordered():
    """The bars of a symbol in their order."""
    return W.partitionBy("symbol").orderBy("bar_idx")


def last(n: int):
    """The current row and the n - 1 before it."""
    return ordered().rowsBetween(1 - n, 0)


def lag(x, n: int = 1) -> Column:
    return F.lag(x, n).over(ordered())


def ratio(a, b) -> Column:
    """a / b as doubles divide: infinite where b is 0, with the sign of that 0 too, NaN where both are; Spark's own division ends the query there."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.coalesce(F.try_divide(a, b), F.when(b == 0, a * F.pow(b, F.lit(-1.0))))


def log(x) -> Column:
    """The natural log as doubles have it: minus infinity at 0, NaN below, where Spark's own is null."""
    x = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.ln(x), F.when(x == 0, -math.inf).when(x < 0, math.nan))


def finite(x) -> Column:
    """x, null where it is infinite or NaN."""
    return F.when(F.abs(x) < math.inf, x)


def _root(x, known: bool = False) -> Column:
    """The root of x, 0 below it and where x is null; known: null there."""
    root = F.sqrt(F.greatest(x, F.lit(0.0)))
    return F.when(x.isNotNull(), root) if known else root


def _term(x, known: bool) -> Column:
    return finite(x) if known else x


def skew(x, w) -> Column:
    """Sample skewness with the bias taken out; null below three values."""
    n = F.count(x).over(w)
    return F.when(n >= 3, F.try_divide(F.sqrt(n * (n - 1)), n - 2) * F.skewness(x).over(w))


def kurt(x, w) -> Column:
    """Excess kurtosis with the bias taken out; null below four values."""
    n = F.count(x).over(w)
    return F.when(n >= 4, F.try_divide(n - 1, (n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x).over(w) + 6))


def with_returns(bars: DataFrame) -> DataFrame:
    """r, the log return; s, the simple one; r1, the return before; prev, the close before."""
    b = bars.withColumn("prev", lag("close")).withColumn("r", F.ln("close") - F.ln("prev")).withColumn("s", F.try_divide(F.col("close") - F.col("prev"), "prev"))
    return b.withColumn("r1", lag("r"))


def _drift():
    """The Rogers-Satchell term of a bar."""
    up, down = log(ratio("high", "close")) * log(ratio("high", "open")), log(ratio("low", "close")) * log(ratio("low", "open"))
    return up + down


def _side(up: bool):
    """A bar's volume if the close went up (or down), half of it if it stayed; nothing for the first bar."""
    gone = F.col("close") > F.col("prev") if up else F.col("close") < F.col("prev")
    return F.when(F.col("prev").isNull(), 0.0).when(gone, F.col("volume")).when(F.col("close") == F.col("prev"), F.col("volume") / 2).otherwise(0.0)


def rogers_satchell(n=20, known=False):
    return _root(F.avg(_term(_drift(), known)).over(last(n)), known)


def garman_klass(n=20, known=False):
    x = 0.5 * F.pow(log(ratio("high", "low")), 2) - (2 * math.log(2) - 1) * F.pow(log(ratio("close", "open")), 2)
    return _root(F.avg(_term(x, known)).over(last(n)), known)


def yang_zhang(n=20, known=False):
    k = 0.34 / (1.34 + (n + 1) / (n - 1))
    gap, body = _term(log(ratio("open", "prev")), known), _term(log(ratio("close", "open")), known)
    drift = F.avg(_term(_drift(), known)).over(last(n))
    # without a term in the window there is no value, where SQL's greatest has 0
    drift = F.when(drift.isNotNull(), F.greatest(drift, F.lit(0.0))) if known else F.greatest(drift, F.lit(0.0))
    x = F.var_samp(gap).over(last(n)) + k * F.var_samp(body).over(last(n)) + (1 - k) * drift
    return F.sqrt(F.greatest(x, F.lit(0.0)) + F.when(x.isNotNull(), 0.0))


def realized(n=20):
    return F.sqrt(F.sum(F.col("r") * F.col("r")).over(last(n)))


def bipower(n=20):
    return math.pi / 2 * F.sum(F.abs("r") * F.abs("r1")).over(last(n))


def amihud(n=20):
    return F.avg(F.abs("s") / F.nullif("dollar_volume", F.lit(0.0))).over(last(n))


def roll_spread(n=20):
    pairs = F.sum(F.when(F.col("r1").isNotNull(), 1).otherwise(0)).over(last(n))
    c = F.covar_samp("r", "r1").over(last(n))
    return F.when(F.col("bar_idx") >= n, F.when(pairs < 3, 0.0).when(c < 0, 2 * F.sqrt(-c)).otherwise(0.0))


def hasbrouck(n=20):
    x = F.signum("r") * F.sqrt("volume")
    return F.when((F.col("bar_idx") >= n) & (F.count("r").over(last(n)) >= 5), F.regr_slope(F.abs("r"), x).over(last(n)))


def vpin(n=20):
    buy, sell = F.sum(_side(True)).over(last(n)), F.sum(_side(False)).over(last(n))
    return F.try_divide(F.abs(buy - sell), buy + sell)


def autocorrelation(n=20):
    """Of the returns in the window with the ones before them in the window."""
    return F.when(F.count("r").over(last(n)) >= 3, F.corr("r", "r1").over(last(n - 1)))


FEATURES = {
    "rogers_satchell_vol": rogers_satchell, "garman_klass_vol": garman_klass, "yang_zhang_vol": yang_zhang, "realized_volatility": realized, "bipower_variation": bipower,
    "returns_variance": lambda n=20: F.var_samp("r").over(last(n)), "returns_skew": lambda n=20: skew("r", last(n)), "returns_kurtosis": lambda n=20: kurt("r", last(n)), "returns_autocorr": autocorrelation,
    "log_price_std": lambda n=20: F.stddev_samp(F.ln("close")).over(last(n)), "dollar_volume_variance": lambda n=20: F.var_samp("dollar_volume").over(last(n)), "dollar_volume_skew": lambda n=20: skew("dollar_volume", last(n)),
    "amihud_lambda": amihud, "roll_spread": roll_spread, "hasbrouck_lambda": hasbrouck, "vpin": vpin,
}


#: Features whose terms are infinite or NaN at bars with a price of 0.
RANGES = ("rogers_satchell_vol", "garman_klass_vol", "yang_zhang_vol")
#: Columns that a feature table keeps of its bars.
KEYS = ("symbol", "bar_idx")


def features(bars: DataFrame, window: int = 20, names=None, keep=(*KEYS, "timestamp"), known: bool = False) -> DataFrame:
    """known: terms that are infinite or NaN, as those of bars with a price of 0 are, are left out of RANGES."""
    b = with_returns(bars)
    return b.select(*keep, *((FEATURES[x](window, True) if known and x in RANGES else FEATURES[x](window)).alias(x) for x in names or FEATURES))


def live_volatility(bars: DataFrame, n: int = 20) -> DataFrame:
    """bars with live_vol, the deviation of the last n simple returns; 0.01 until there are n."""
    b = bars.withColumn("_s", F.try_divide(F.col("close") - lag("close"), lag("close")))
    return b.withColumn("live_vol", F.coalesce(F.when(F.count("_s").over(last(n)) >= n, F.stddev_samp("_s").over(last(n))), F.lit(0.01))).drop("_s")


def calendar(bars: DataFrame, keep=KEYS) -> DataFrame:
    """Time of day, of week and of year on the circle, UTC."""
    at = F.timestamp_millis("timestamp")
    hour = F.hour(at) + F.minute(at) / 60.0 + F.second(at) / 3600.0
    turn = lambda x, n: (2 * math.pi) * x / n
    return bars.select(
        *keep, F.sin(turn(hour, 24)).alias("hour_sin"), F.cos(turn(hour, 24)).alias("hour_cos"), F.sin(turn(F.weekday(at), 7)).alias("dow_sin"), F.cos(turn(F.weekday(at), 7)).alias("dow_cos"),
        F.dayofmonth(at).cast("int").alias("day_of_month"), F.sin(turn(F.month(at), 12)).alias("month_sin"), F.cos(turn(F.month(at), 12)).alias("month_cos"),
    )
