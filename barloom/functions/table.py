"""All features of bars as one table, each family a step on the same rows: no join, and one ordering for all of them."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import encodings as en
from barloom.functions import features as ft
from barloom.functions import frames as fr
from barloom.functions import unit_root as ur
from barloom.functions.differences import convolved
from barloom.operators.slices import in_slices, last_known, numbered
from barloom.sources.cut import cut

#: Columns that bars may have and that are none of their features.
BAR = ("symbol", "bar_idx", "timestamp", "open", "high", "low", "close", "volume", "dollar_volume", "tick_count", "duration_us")


#: Bars of a slice of the feature table, besides the halo before it.
SLICE = 4096


def differenced(bars: DataFrame, keep=ft.KEYS, changes: bool = True) -> DataFrame:
    """ffd_close, ffd_d, price_velocity and price_acceleration: the fractional difference of log closes at the least order that rejects a unit root, its order, and its differences.

    All orders come from one block convolution; the order is found from the whole
    series, one row a symbol, and joined back. changes: whether the last two are asked for.
    """
    grid = ur.order_grid()
    values = cut(convolved(bars, F.ln("close"), grid))
    least = ur.least_order(values, grid).withColumnRenamed("min_d", "ffd_d")
    own = F.get("values", F.array_position(F.array(*(F.lit(d) for d in grid)), F.col("ffd_d")).cast("int") - 1)
    made = values.join(least, "symbol").select("symbol", "bar_idx", own.alias("ffd_close"), "ffd_d")
    b = bars.join(made, ["symbol", "bar_idx"])
    b = in_slices(b, _velocity, SLICE, 2) if changes else b
    return b.select(*keep, "ffd_close", "ffd_d", *(("price_velocity", "price_acceleration") if changes else ()))


def _velocity(b: DataFrame) -> DataFrame:
    return b.withColumn("price_velocity", F.col("ffd_close") - ft.lag("ffd_close")).withColumn("price_acceleration", F.col("price_velocity") - ft.lag("price_velocity"))


def with_direction(bars: DataFrame, size: int = SLICE) -> DataFrame:
    """bars with _way, the sign of the last move of the close, up before the first one: carried from slice to slice."""
    move = F.nullif(F.signum(F.col("close") - ft.lag("close")), F.lit(0.0))
    b = last_known(in_slices(bars, lambda b: b.withColumn("_move", move), size, 1), "_way", F.col("_move"), size)
    return b.withColumn("_way", F.coalesce("_way", F.lit(1.0))).drop("_move")


def trade_features(trades: DataFrame, n: int = 20, size: int = 200_000) -> DataFrame:
    """trades with order_book_imbalance (sold less bought over both) and trade_flow_imbalance (mean sign) of the last n trades of the symbol, on slices of `size` trades."""
    w = W.partitionBy("symbol").orderBy("time", "id").rowsBetween(1 - n, 0)
    sold = F.when(F.col("is_buyer_maker"), F.col("qty")).otherwise(-F.col("qty"))

    def both(t):
        return t.withColumn("order_book_imbalance", F.try_divide(F.sum(sold).over(w), F.sum("qty").over(w))).withColumn("trade_flow_imbalance", F.avg(F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0)).over(w))

    return in_slices(numbered(trades), both, size, n - 1, "number").drop("number")


def with_trades(bars: DataFrame, trades: DataFrame, keep=ft.KEYS, n: int = 20) -> DataFrame:
    """The trade features of the last trade in each bar (trades have bar_idx), null where a bar has no trade."""
    last = trade_features(trades, n).groupBy("symbol", "bar_idx").agg(*(F.max_by(c, F.struct("time", "id")).alias(c) for c in ("order_book_imbalance", "trade_flow_imbalance")))
    return bars.join(last, ["symbol", "bar_idx"], "left").select(*keep, "order_book_imbalance", "trade_flow_imbalance")


# Names that models and stored tables use for these columns.
NAMES = {
    "rolling_kontoyiannis": "rolling_kontoyiannis_entropy", "dollar_volume_velocity": "volume_velocity", "dollar_volume_acceleration": "volume_acceleration",
    "dollar_volume_variance": "volume_variance", "dollar_volume_skew": "volume_skew", "dollar_volume_kurt": "volume_kurtosis",
    "log_duration_velocity": "duration_velocity", "log_duration_acceleration": "duration_acceleration", "duration_kurt": "duration_kurtosis",
    "log_price_kurt": "log_price_kurtosis", "day_of_month": "dom",
}
_DIFFERENCED = {"ffd_close", "ffd_d", "price_velocity", "price_acceleration"}


def halo(window: int = 20) -> int:
    """Bars that a feature looks back: frames of 3 windows of returns, spread moments over two windows, breaks over 50 and their lags."""
    return max(3 * window, max(window, 50)) + 8


def all_features(bars: DataFrame, trades: DataFrame | None = None, window: int = 20, only=None, size: int = SLICE, known: bool = False) -> DataFrame:
    """The columns of bars and the features of each: 76 with dollar_volume and duration_us, which bars have; 78 with trades that have bar_idx.

    A value is null until its frame is long enough. bars: BAR, numbered from 0; other
    columns stay. only: the features that are wanted, to save the order of the
    difference where it is not. known: bars with a price of 0 have no terms in the
    volatilities of ranges and no range in the spread, where they make the values of all
    bars after them infinite or NaN for a window. The table is worked out on slices of `size` bars with a
    halo, so a symbol is many tasks; what needs the whole series (the order of the
    difference, the direction of the last move) comes first.
    """
    b = bars
    with_differences = only is None or bool(_DIFFERENCED & set(only))
    if with_differences:
        b = differenced(b, keep=b.columns, changes=False)
    b = cut(with_direction(b, size))
    b = in_slices(b, lambda x: _families(x, window, with_differences, known), size, halo(window)).drop("_way")
    if trades is not None:
        b = with_trades(b, trades, keep=b.columns, n=window)
    return b.withColumnsRenamed(NAMES)


def _families(b: DataFrame, window: int, with_differences: bool, known: bool = False) -> DataFrame:
    """The features of bars with _way, each family a step on the same rows."""
    breaks = max(window, 50)

    def step(make, *args, **kw):
        nonlocal b
        b = make(b, *args, keep=b.columns, **kw)

    if with_differences:
        b = _velocity(b)
    b = ft.with_returns(b).withColumn("returns", F.col("r")).withColumn("returns_abs", F.abs("r")).drop("prev", "r", "s", "r1")
    step(fr.entropies, window)
    step(en.rolling_match_entropy, 3 * window)
    b = b.withColumn("_x", F.ln("close"))
    b = b.withColumn("bde_cusum", ur.recursive_cusum("_x", breaks)).drop("_x")
    step(fr.breaks, breaks)
    step(ur.unit_root, n=breaks)
    step(en.encoded_entropies, window)
    # every step looks at the whole plan so far again: what comes next starts from rows
    b = cut(b)
    step(ft.features, window, known=known)
    b = b.withColumn("vol_velocity", F.col("rogers_satchell_vol") - ft.lag("rogers_satchell_vol")).withColumn("vol_acceleration", F.col("vol_velocity") - ft.lag("vol_velocity"))
    step(fr.volume_and_duration, window)
    step(fr.spreads, window, way=F.col("_way"), known=known)
    w = ft.last(window)
    b = b.withColumn("spread_variance", F.var_samp("roll_spread").over(w)).withColumn("spread_skew", ft.skew("roll_spread", w)).withColumn("spread_kurtosis", ft.kurt("roll_spread", w))
    step(ft.calendar)
    return b


_ENTROPIES = [f"entropy_{e}_{m}" for e in en.ENCODERS for m in ("shannon", "redundancy", "mi", "nvi", "kontoyiannis")]
# The features in the order of stored models, by family.
_FAMILIES = (
    "ffd_close ffd_d price_velocity price_acceleration returns returns_abs rolling_shannon_entropy rolling_plugin_entropy rolling_lempel_ziv rolling_kontoyiannis_entropy",
    "bde_cusum csw_cusum chow_type_df rolling_sadf martingale_poly_t martingale_exp_t martingale_power_t",
    " ".join(_ENTROPIES),
    "rogers_satchell_vol garman_klass_vol yang_zhang_vol realized_volatility bipower_variation vol_velocity vol_acceleration",
    "dollar_volume log_dollar_volume duration_us log_duration volume_velocity volume_acceleration volume_variance volume_skew volume_kurtosis duration_velocity duration_acceleration duration_variance duration_skew duration_kurtosis",
    "log_price_std log_price_skew log_price_kurtosis",
    "amihud_lambda roll_spread corwin_schultz_spread tick_rule hasbrouck_lambda vpin spread_variance spread_skew spread_kurtosis",
    "hour_sin hour_cos dow_sin dow_cos dom month_sin month_cos",
    "returns_variance returns_skew returns_kurtosis returns_autocorr",
)


def names(with_trade_features: bool = False) -> list[str]:
    """The features of all_features."""
    return [n for family in _FAMILIES for n in family.split()] + ["order_book_imbalance", "trade_flow_imbalance"] * with_trade_features
