"""The registered queries of the time-series operators, and the SQL with the same rows.

Each query reads the whole event table as trades (see sources.trades.tape); the
scale of bars, windows and barriers fits that tape.
"""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions import frames as fr
from barloom.functions import table
from barloom.functions.differences import fractional
from barloom.operators import bars as ob
from barloom.operators import labels as ol
from barloom.operators import simulation as sim
from barloom.operators.slices import in_slices
from barloom.sources import store
from barloom.sources import trades as src
from barloom.sources.cut import cut
from barloom.streaming import signals as live

QUERIES, ORACLES = {}, {}
_CTE = """WITH tape AS (SELECT event_id AS id, event_type AS symbol, value AS price, 0.1 + CAST(json_extract_string(props, '$.k') AS BIGINT) / 100.0 AS qty, epoch_us(ts) // 1000 AS time, user_id % 2 = 0 AS is_buyer_maker FROM events),
g AS (SELECT symbol, time // 21600000 AS win, max(time) AS timestamp, arg_min(price, (time, id)) AS open, max(price) AS high, min(price) AS low, arg_max(price, (time, id)) AS close, sum(qty) AS volume, sum(price * qty) AS dollar_volume, count(*) AS tick_count, CASE WHEN count(*) > 1 THEN (max(time) - min(time)) * 1000 ELSE 0 END AS duration_us FROM tape GROUP BY ALL),
bars AS (SELECT * EXCLUDE win, row_number() OVER (PARTITION BY symbol ORDER BY win) - 1 AS bar_idx FROM g QUALIFY win < max(win) OVER (PARTITION BY symbol)),
ret AS (SELECT *, lag(close) OVER o AS prev, ln(close) - ln(lag(close) OVER o) AS r, close / lag(close) OVER o - 1 AS s FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx)),
b AS (SELECT *, lag(r) OVER (PARTITION BY symbol ORDER BY bar_idx) AS r1 FROM ret)
"""
_W = " WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx), w AS (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING), w1 AS (PARTITION BY symbol ORDER BY bar_idx ROWS 18 PRECEDING)"


def _round(c, digits):
    """SQL's round: the nearest whole number to x * 10**digits, of two the one farther from 0, over 10**digits. Spark's own rounds the shortest decimal that reads as x, which is another number where a double has few digits left."""
    by = 10.0**digits
    x = F.col(c) * by
    near = F.rint(x)
    # rint takes the even one of two; few copies of x, so that the code of a wide table stays below 64 KB
    near = F.when(F.abs(x - near) == 0.5, x + 0.5 * F.signum(x)).otherwise(near)
    return F.when(F.abs(x) < float("inf"), near / by).otherwise(F.col(c))


def _rounded(df, digits=6):
    """digits: of all columns, or of each by name (6 where it has none)."""
    of = lambda c: digits.get(c, 6) if isinstance(digits, dict) else digits
    return df.select(*((_round(c, of(c)) + F.lit(0.0)).alias(c) if t == "double" else F.col(c).cast("long").alias(c) if t == "int" else F.col(c) for c, t in df.dtypes))


def _r(x, name, digits=6):
    return f"round({x}, {digits}) + 0.0 AS {name}"


def register(name, make, sql=None, digits=6):
    QUERIES[name] = lambda spark, sf_dir: _rounded(make(src.tape(spark, sf_dir)), digits)
    if sql:
        ORACLES[name] = sql if sql.startswith("WITH") else _CTE + sql


def six_hours(tape):
    return ob.time_bars(tape, "6h")


def kept_six_hours(tape):
    """six_hours for plans that read the bars several times: made once."""
    return cut(six_hours(tape))


def in_bars(tape, bars):
    """The trades in six-hour bars, with the number of theirs; those of the open window are left out."""
    win = lambda c: F.floor(F.col(c) / 21_600_000).alias("win")
    return tape.withColumn("win", win("time")).join(bars.select("symbol", win("timestamp"), "bar_idx"), ["symbol", "win"]).drop("win")


def _trades_on_bars(t):
    b = six_hours(t)
    return table.with_trades(b, in_bars(t, b), keep=("symbol", "bar_idx", "timestamp")).withColumnRenamed("order_book_imbalance", "imbalance").drop("trade_flow_imbalance")


def in_parts(make, halo=68):
    """make on slices of a few bars of the tape's six-hour bars: several tasks for each symbol, small as the tape is."""
    return lambda t: in_slices(six_hours(t), make, 32, halo)


_OHLC = ["open", "high", "low", "close", "volume", "dollar_volume"]
_BAR = "symbol, timestamp, " + ", ".join(_r(c, c) for c in _OHLC) + ", tick_count, duration_us, bar_idx"
register("p01_tape", lambda t: t, "SELECT id, symbol, " + ", ".join(_r(c, c) for c in ("price", "qty")) + ", " + _r("price * qty", "quote_qty") + ", time, is_buyer_maker FROM tape")
register("p02_time_range", lambda t: src.in_range(t, 1704240000000, 1705104000000).select("id", "symbol", "time"), "SELECT id, symbol, time FROM tape WHERE time BETWEEN 1704240000000 AND 1705104000000")
register("b01_time_bars", six_hours, f"SELECT {_BAR} FROM bars")
register("b03_tick_bars", lambda t: ob.tick_bars(t, 20), "SELECT symbol, bar_idx, max(time) AS timestamp, " + ", ".join(_r(x, c) for c, x in (("open", "arg_min(price, (time, id))"), ("high", "max(price)"), ("low", "min(price)"), ("close", "arg_max(price, (time, id))"), ("volume", "sum(qty)"), ("dollar_volume", "sum(price * qty)"))) + ", count(*) AS tick_count, (max(time) - min(time)) * 1000 AS duration_us FROM (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY time, id) - 1) // 20 AS bar_idx FROM tape) GROUP BY symbol, bar_idx HAVING count(*) = 20")


def _greedy(value, limit):
    """Threshold bars as a recursion along each symbol's trades."""
    return f"""WITH RECURSIVE {_CTE[5:].split("g AS", 1)[0]} n AS (SELECT *, {value} AS v, row_number() OVER (PARTITION BY symbol ORDER BY time, id) AS k FROM tape),
walk(symbol, k, bar, x, closed) AS (SELECT symbol, k, CAST(0 AS BIGINT), v, v >= {limit} FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.k, w.bar + CASE WHEN w.closed THEN 1 ELSE 0 END, CASE WHEN w.closed THEN n.v ELSE w.x + n.v END, CASE WHEN w.closed THEN n.v ELSE w.x + n.v END >= {limit} FROM walk w JOIN n ON n.symbol = w.symbol AND n.k = w.k + 1)
SELECT n.symbol, w.bar AS bar_idx, max(n.time) AS timestamp, {_r("arg_min(n.price, n.k)", "open")}, {_r("max(n.price)", "high")}, {_r("min(n.price)", "low")}, {_r("arg_max(n.price, n.k)", "close")}, {_r("sum(n.qty)", "volume")}, {_r("sum(n.price * n.qty)", "dollar_volume")}, count(*) AS tick_count, (max(n.time) - min(n.time)) * 1000 AS duration_us
FROM walk w JOIN n USING (symbol, k) GROUP BY n.symbol, w.bar HAVING bool_or(w.closed)"""


register("b04_volume_bars", lambda t: ob.bars(t, "volume", threshold=10.0), _greedy("qty", "10.0"))
register("b05_dollar_bars", lambda t: ob.bars(t, "dollar", threshold=500.0), _greedy("price * qty", "500.0"))
_ALPHA = 2 / 21


def _adaptive(value, rule):
    """Imbalance and run bars (first 20, span 20) as a recursion along each symbol's trades: the state before a trade, then whether it closes the bar."""
    blend = lambda new, old: f"{_ALPHA!r} * ({new}) + {1 - _ALPHA!r} * {old}"
    learn = lambda seen, old, least: f"CASE WHEN NOT w.closed THEN w.{old} WHEN w.{old} IS NULL THEN CASE WHEN {seen} > 0 THEN {seen} ELSE {least} END ELSE {blend(seen, 'w.' + old)} END AS {old}"
    if rule == "imbalance":
        rates = learn("abs(w.th) / w.n", "ra", "1.0") + ", NULL::DOUBLE AS rb, w.p"
        closes = "abs(th) >= et * ra"
    else:
        rates = learn("w.up / w.n", "ra", "0.5") + ", " + learn("w.dn / w.n", "rb", "0.5") + f", CASE WHEN w.closed THEN least(greatest({blend('w.buys / w.n', 'w.p')}, 0.01), 0.99) ELSE w.p END AS p"
        closes = "greatest(p * up, (1 - p) * dn) >= et * greatest(p * ra, (1 - p) * rb)"
    old = lambda c, zero: f"CASE WHEN w.closed THEN {zero} ELSE w.{c} END"
    return f"""WITH RECURSIVE {_CTE[5:].split("g AS", 1)[0]} n AS (SELECT *, {value}::DOUBLE AS v, CASE WHEN is_buyer_maker THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sg, row_number() OVER (PARTITION BY symbol ORDER BY time, id) AS k FROM tape),
walk(symbol, k, bar, n, th, up, dn, buys, et, ra, rb, p, closed) AS (SELECT DISTINCT symbol, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0::BIGINT, 20.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, 0.5::DOUBLE, false FROM n UNION ALL
SELECT symbol, k, bar, n, th, up, dn, buys, et, ra, rb, p, CASE WHEN ra IS NULL THEN n >= 20 ELSE {closes} END FROM (SELECT n.symbol, n.k, w.bar + CASE WHEN w.closed THEN 1 ELSE 0 END AS bar, {old("n", "0")} + 1 AS n, {old("th", "0.0")} + n.sg * n.v AS th,
{old("up", "0.0")} + CASE WHEN n.sg > 0 THEN n.v ELSE 0.0 END AS up, {old("dn", "0.0")} + CASE WHEN n.sg < 0 THEN n.v ELSE 0.0 END AS dn, {old("buys", "0")} + CASE WHEN n.sg > 0 THEN 1 ELSE 0 END AS buys,
CASE WHEN w.closed THEN least(greatest({blend("w.n", "w.et")}, 10.0), 40.0) ELSE w.et END AS et, {rates} FROM walk w JOIN n ON n.symbol = w.symbol AND n.k = w.k + 1) x)
SELECT n.symbol, w.bar AS bar_idx, max(n.time) AS timestamp, {_r("arg_min(n.price, n.k)", "open")}, {_r("max(n.price)", "high")}, {_r("min(n.price)", "low")}, {_r("arg_max(n.price, n.k)", "close")}, {_r("sum(n.qty)", "volume")}, {_r("sum(n.price * n.qty)", "dollar_volume")}, count(*) AS tick_count, CASE WHEN count(*) > 1 THEN (max(n.time) - min(n.time)) * 1000 ELSE 0 END AS duration_us
FROM walk w JOIN n USING (symbol, k) GROUP BY n.symbol, w.bar HAVING bool_or(w.closed)"""


for _rule in ("imbalance", "run"):
    for _value, _of in (("tick", "1.0"), ("volume", "qty"), ("dollar", "price * qty")):
        register(f"b{'08' if _rule == 'imbalance' else '10'}_{_value}_{_rule}_bars", lambda t, k=f"{_value}_{_rule}": ob.bars(t, k, first=20, span=20), _adaptive(_of, _rule))

_RS = "ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open)"
_SKEW = "CASE WHEN count({x}) OVER w >= 3 THEN skewness({x}) OVER w END"
_KURT = "CASE WHEN count({x}) OVER w >= 4 THEN kurtosis({x}) OVER w END"
_BUY = "CASE WHEN prev IS NULL THEN 0.0 WHEN close > prev THEN volume WHEN close < prev THEN 0.0 ELSE volume / 2 END"
_SELL = "CASE WHEN prev IS NULL THEN 0.0 WHEN close < prev THEN volume WHEN close > prev THEN 0.0 ELSE volume / 2 END"
_YZ = f"var_samp(ln(open / prev)) OVER w + {0.34 / (1.34 + 21 / 19)!r} * var_samp(ln(close / open)) OVER w + {1 - 0.34 / (1.34 + 21 / 19)!r} * greatest(avg({_RS}) OVER w, 0)"
_SQL = {
    "f01_rogers_satchell_vol": f"sqrt(greatest(avg({_RS}) OVER w, 0))",
    "f02_garman_klass_vol": "sqrt(greatest(avg(0.5 * ln(high / low) ** 2 - (2 * ln(2) - 1) * ln(close / open) ** 2) OVER w, 0))",
    "f03_yang_zhang_vol": f"CASE WHEN ({_YZ}) IS NOT NULL THEN sqrt(greatest({_YZ}, 0)) END",
    "f04_realized_volatility": "sqrt(sum(r * r) OVER w)",
    "f05_bipower_variation": "pi() / 2 * sum(abs(r) * abs(r1)) OVER w",
    "f07_dollar_volume_variance": "var_samp(dollar_volume) OVER w",
    "f07_dollar_volume_skew": _SKEW.format(x="dollar_volume"),
    "f08_log_price_std": "stddev_samp(ln(close)) OVER w",
    "f11_returns_variance": "var_samp(r) OVER w",
    "f11_returns_skew": _SKEW.format(x="r"),
    "f11_returns_kurtosis": _KURT.format(x="r"),
    "f12_returns_autocorr": "CASE WHEN count(r) OVER w >= 3 THEN corr(r, r1) OVER w1 END",
    "f37_amihud_lambda": "avg(abs(s) / nullif(dollar_volume, 0)) OVER w",
    "f38_roll_spread": "CASE WHEN bar_idx >= 20 THEN CASE WHEN count(r1) OVER w < 3 THEN 0.0 WHEN covar_samp(r, r1) OVER w < 0 THEN 2 * sqrt(-(covar_samp(r, r1) OVER w)) ELSE 0.0 END END",
    "f41_hasbrouck_lambda": "CASE WHEN bar_idx >= 20 AND count(r) OVER w >= 5 THEN regr_slope(abs(r), sign(r) * sqrt(volume)) OVER w END",
    "f42_vpin": f"abs(sum({_BUY}) OVER w - sum({_SELL}) OVER w) / nullif(sum({_BUY}) OVER w + sum({_SELL}) OVER w, 0)",
}
for _name, _sql in _SQL.items():
    _f = _name.split("_", 1)[1]
    register(_name, in_parts(lambda b, f=_f: ft.features(b, 20, [f]).drop("timestamp"), 24), f"SELECT symbol, bar_idx, {_r(_sql, _f, 5)} FROM b" + _W, 5)
register("f46_live_volatility", in_parts(lambda b: ft.live_volatility(b).select("symbol", "bar_idx", "live_vol"), 24), f"SELECT symbol, bar_idx, {_r('coalesce(CASE WHEN count(s) OVER w >= 20 THEN stddev_samp(s) OVER w END, 0.01)', 'live_vol', 5)} FROM b" + _W, 5)
register("f10_returns", in_parts(lambda b: ft.with_returns(b).select("symbol", "bar_idx", F.col("r").alias("returns"), F.abs("r").alias("returns_abs")), 2), f"SELECT symbol, bar_idx, {_r('r', 'returns')}, {_r('abs(r)', 'returns_abs')} FROM b")
register("f06_vol_velocity", lambda t: ft.features(six_hours(t), 20, ["rogers_satchell_vol"]).withColumn("vol_velocity", F.col("rogers_satchell_vol") - ft.lag("rogers_satchell_vol")).select("symbol", "bar_idx", "vol_velocity"), f"SELECT symbol, bar_idx, {_r('v - lag(v) OVER (PARTITION BY symbol ORDER BY bar_idx)', 'vol_velocity')} FROM (SELECT symbol, bar_idx, {_SQL['f01_rogers_satchell_vol']} AS v FROM b{_W})")
_O = "OVER (PARTITION BY symbol ORDER BY bar_idx)"
_FFD = fr.difference_weights(0.95)
register("f14_fractional_difference", lambda t: fractional(six_hours(t), F.ln("close"), 0.95, "ffd_close", size=32), f"SELECT symbol, bar_idx, {_r(f'CASE WHEN bar_idx >= {len(_FFD) - 1} THEN list_dot_product(list_resize(list(ln(close)) OVER f, {len(_FFD)}, 0.0), {_FFD[::-1]!r}::DOUBLE[]) END', 'ffd_close')} FROM bars WINDOW f AS (PARTITION BY symbol ORDER BY bar_idx ROWS {len(_FFD) - 1} PRECEDING)")
_AT = {"poly": "t", "exp": "exp(t / 50.0)", "power": "sqrt(t)"}
_FIT = {k: f"regr_slope(y, {x}) / nullif(sqrt(greatest(regr_syy(y, {x}) - power(regr_slope(y, {x}), 2) * regr_sxx(y, {x}), 0) / 48 / regr_sxx(y, {x})), 0)" for k, x in _AT.items()}
register("f20_breaks", in_parts(lambda b: fr.breaks(b)), ", fr AS (SELECT b.symbol, b.bar_idx, x.bar_idx - b.bar_idx + 51 AS t, ln(x.close) AS y FROM bars b JOIN bars x ON x.symbol = b.symbol AND x.bar_idx BETWEEN b.bar_idx - 50 AND b.bar_idx - 1 WHERE b.bar_idx >= 50), dv AS (SELECT *, y - avg(y) OVER (PARTITION BY symbol, bar_idx) AS d FROM fr), cu AS (SELECT *, sum(d) OVER (PARTITION BY symbol, bar_idx ORDER BY t) AS c FROM dv), br AS (SELECT symbol, bar_idx, max(abs(c)) / stddev_samp(y) / sqrt(50) AS csw, " + ", ".join(f"{v} AS {k}" for k, v in _FIT.items()) + f" FROM cu GROUP BY ALL) SELECT symbol, bar_idx, {_r('csw', 'csw_cusum')}, " + ", ".join(_r(k, f"martingale_{k}_t") for k in _AT) + " FROM bars LEFT JOIN br USING (symbol, bar_idx)")
register("f25_entropies", in_parts(lambda b: fr.entropies(b).drop("rolling_lempel_ziv")), f", fr AS (SELECT b.symbol, b.bar_idx, x.r FROM b JOIN b x ON x.symbol = b.symbol AND x.bar_idx BETWEEN b.bar_idx - 19 AND b.bar_idx AND x.r IS NOT NULL), lo AS (SELECT *, min(r) OVER f AS l, max(r) OVER f AS h, count(*) OVER f AS n FROM fr WINDOW f AS (PARTITION BY symbol, bar_idx)), c AS (SELECT symbol, bar_idx, n, CASE WHEN h > l THEN least(floor((r - l) / (h - l) * 10), 9) ELSE 0 END AS bin, count(*) AS k FROM lo GROUP BY ALL), e AS (SELECT symbol, bar_idx, n, ln(max(n)) - sum(k * ln(k)) / max(n) AS s, count(*) AS m FROM c WHERE n >= 5 GROUP BY symbol, bar_idx, n) SELECT symbol, bar_idx, {_r('s', 'rolling_shannon_entropy')}, {_r('s + (m - 1) / (2.0 * n)', 'rolling_plugin_entropy')} FROM bars LEFT JOIN e USING (symbol, bar_idx)")
# the parse as a recursion: phrases so far, where this one starts and how long it is
register("f27_lempel_ziv", in_parts(lambda b: fr.entropies(b).select("symbol", "bar_idx", "rolling_lempel_ziv")), f"""WITH RECURSIVE {_CTE[5:].rstrip()}, fr AS (SELECT symbol, bar_idx, list(r) FILTER (r IS NOT NULL) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS 19 PRECEDING) AS v FROM b),
tx AS (SELECT symbol, bar_idx, array_to_string(list_transform(v, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS t FROM fr WHERE len(v) >= 5),
lz(symbol, bar_idx, t, c, pos, size) AS (SELECT symbol, bar_idx, t, 1, 0, 1 FROM tx UNION ALL SELECT symbol, bar_idx, t, CASE WHEN seen THEN c ELSE c + 1 END, CASE WHEN seen THEN pos ELSE pos + size END, CASE WHEN seen THEN size + 1 ELSE 1 END FROM (SELECT *, contains(substr(t, 1, pos + size - 1), substr(t, pos + 1, size)) AS seen FROM lz WHERE pos + size <= length(t)) y)
SELECT bars.symbol, bars.bar_idx, {_r("e.v", "rolling_lempel_ziv")} FROM bars LEFT JOIN (SELECT symbol, bar_idx, max(c) / (length(t) / log2(length(t))) AS v FROM lz GROUP BY symbol, bar_idx, t) e USING (symbol, bar_idx)""")
_K = 3 - 2 * 2**0.5
_CS = f"with_one AS (SELECT *, ln(high / low) ** 2 + ln(lag(high) {_O} / lag(low) {_O}) ** 2 AS one, ln(greatest(high, lag(high) {_O}) / least(low, lag(low) {_O})) ** 2 AS two, CASE WHEN close > prev THEN 1.0 WHEN close < prev THEN -1.0 END AS move FROM b), al AS (SELECT *, CASE WHEN bar_idx > 0 THEN (sqrt(2 * one) - sqrt(one)) / {_K!r} - sqrt(two / {_K!r}) END AS a, coalesce(last_value(move IGNORE NULLS) {_O}, 1.0) AS way FROM with_one)"
register("f39_spreads", lambda t: fr.spreads(six_hours(t)), f", {_CS} SELECT symbol, bar_idx, {_r('avg(CASE WHEN a IS NULL THEN NULL ELSE greatest(2 * (exp(a) - 1) / (1 + exp(a)), 0) END) OVER w', 'corwin_schultz_spread')}, {_r('avg(way) OVER w', 'tick_rule')} FROM al{_W}")
_VD = f", l AS (SELECT *, ln(1 + greatest(dollar_volume, 0)) AS ldv, ln(1 + duration_us::DOUBLE) AS ld, duration_us / 1e6 AS ds, ln(close) AS lp FROM bars), d1 AS (SELECT *, dollar_volume - lag(dollar_volume) {_O} AS v1, ld - lag(ld) {_O} AS l1 FROM l), d2 AS (SELECT *, v1 - lag(v1) {_O} AS v2, l1 - lag(l1) {_O} AS l2 FROM d1)"
_VDC = {"log_dollar_volume": "ldv", "log_duration": "ld", "dollar_volume_velocity": "v1", "dollar_volume_acceleration": "v2", "log_duration_velocity": "l1", "log_duration_acceleration": "l2", "dollar_volume_kurt": _KURT.format(x="dollar_volume"), "duration_variance": "var_samp(ds) OVER w", "duration_skew": _SKEW.format(x="ds"), "duration_kurt": _KURT.format(x="ds"), "log_price_skew": _SKEW.format(x="lp"), "log_price_kurt": _KURT.format(x="lp")}
register("f07_volume_and_duration", in_parts(lambda b: fr.volume_and_duration(b).withColumn("duration_variance", F.col("duration_variance") / 1e12)), f"{_VD} SELECT symbol, bar_idx, " + ", ".join(_r(v, k, 4) for k, v in _VDC.items()) + f" FROM d2{_W}", 4)
_SPREAD = _SQL["f38_roll_spread"]
register("f43_spread_moments", lambda t: (lambda b: b.select("symbol", "bar_idx", F.var_samp("roll_spread").over(ft.last(20)).alias("spread_variance")))(ft.features(six_hours(t), 20, ["roll_spread"])), f", sp AS (SELECT symbol, bar_idx, {_SPREAD} AS x FROM b{_W}) SELECT symbol, bar_idx, {_r('var_samp(x) OVER w', 'spread_variance')} FROM sp{_W}")
register("f06_vol_acceleration", lambda t: ft.features(six_hours(t), 20, ["rogers_satchell_vol"]).withColumn("v", F.col("rogers_satchell_vol") - ft.lag("rogers_satchell_vol")).select("symbol", "bar_idx", (F.col("v") - ft.lag("v")).alias("vol_acceleration")), f", v AS (SELECT symbol, bar_idx, {_SQL['f01_rogers_satchell_vol']} AS v FROM b{_W}), d AS (SELECT *, v - lag(v) {_O} AS d FROM v) SELECT symbol, bar_idx, {_r(f'd - lag(d) {_O}', 'vol_acceleration')} FROM d")
_hour = "2 * pi() * (hour(t) + minute(t) / 60.0 + second(t) / 3600.0) / 24"
register("f44_calendar", in_parts(lambda b: ft.calendar(b)), f"SELECT symbol, bar_idx, {_r(f'sin({_hour})', 'hour_sin')}, {_r(f'cos({_hour})', 'hour_cos')}, {_r('sin(2 * pi() * (isodow(t) - 1) / 7)', 'dow_sin')}, {_r('cos(2 * pi() * (isodow(t) - 1) / 7)', 'dow_cos')}, day(t) AS day_of_month, {_r('sin(2 * pi() * month(t) / 12)', 'month_sin')}, {_r('cos(2 * pi() * month(t) / 12)', 'month_cos')} FROM (SELECT *, make_timestamp(timestamp * 1000) AS t FROM bars)")


def _imbalance(t):
    return table.trade_features(t, 20, 500).select("symbol", "id", F.col("order_book_imbalance").alias("imbalance"), F.col("trade_flow_imbalance").alias("flow"))


register("f35_trade_imbalance", _imbalance, "SELECT symbol, id, " + _r("sum(CASE WHEN is_buyer_maker THEN qty ELSE -qty END) OVER w / sum(qty) OVER w", "imbalance", 9) + ", " + _r("avg(CASE WHEN is_buyer_maker THEN -1.0 ELSE 1.0 END) OVER w", "flow", 9) + " FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY time, id ROWS 19 PRECEDING)", 9)


def _with_vol(t):
    return ft.with_returns(six_hours(t)).withColumn("vol", F.stddev_samp("r").over(ft.last(20)))


register("l01_triple_barrier", lambda t: ol.triple_barrier(_with_vol(t), hold=10, stop=1.0, take=1.0), f""", v AS (SELECT *, stddev_samp(r) OVER w AS vol FROM b{_W}),
h AS (SELECT v.symbol, v.bar_idx, min(f.bar_idx) AS k FROM v JOIN v f ON f.symbol = v.symbol AND f.bar_idx BETWEEN v.bar_idx + 1 AND v.bar_idx + 10 AND (f.low <= v.close * (1 - v.vol) OR f.high >= v.close * (1 + v.vol)) GROUP BY ALL)
SELECT v.symbol, v.bar_idx, v.timestamp, CAST(CASE WHEN f.bar_idx IS NULL THEN NULL WHEN f.low <= v.close * (1 - v.vol) THEN -1 ELSE 1 END AS BIGINT) AS label, {_r('v.close * (1 - v.vol)', 'sl_price')}, {_r('v.close * (1 + v.vol)', 'pt_price')}, last_value(v.timestamp) OVER (PARTITION BY v.symbol ORDER BY v.bar_idx ROWS BETWEEN CURRENT ROW AND 10 FOLLOWING) AS time_barrier_ts FROM v LEFT JOIN h USING (symbol, bar_idx) LEFT JOIN v f ON f.symbol = h.symbol AND f.bar_idx = h.k""")
_T = "CASE WHEN count(*) OVER h{h} >= 3 THEN regr_slope(close, bar_idx) OVER h{h} / sqrt(greatest(greatest(regr_syy(close, bar_idx) OVER h{h} - power(regr_slope(close, bar_idx) OVER h{h}, 2) * regr_sxx(close, bar_idx) OVER h{h}, 0) / (count(*) OVER h{h} - 2) / regr_sxx(close, bar_idx) OVER h{h}, 1e-30)) WHEN count(*) OVER h{h} = 2 THEN regr_slope(close, bar_idx) OVER h{h} ELSE 0 END AS t{h}"
register("l03_trend_scanning", lambda t: ol.trend_scanning(six_hours(t), (5, 10, 20)), ", t AS (SELECT symbol, bar_idx, timestamp, " + ", ".join(_T.format(h=h) for h in (5, 10, 20)) + " FROM bars WINDOW " + ", ".join(f"h{h} AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND {h} FOLLOWING)" for h in (5, 10, 20)) + f"), p AS (SELECT *, CASE WHEN abs(t5) >= abs(t10) AND abs(t5) >= abs(t20) THEN 5 WHEN abs(t10) >= abs(t20) THEN 10 ELSE 20 END AS best_horizon FROM t), q AS (SELECT *, CASE best_horizon WHEN 5 THEN t5 WHEN 10 THEN t10 ELSE t20 END AS tv FROM p) SELECT symbol, bar_idx, timestamp, CAST(CASE WHEN abs(tv) >= 1 THEN CASE WHEN tv > 0 THEN 1 ELSE -1 END END AS BIGINT) AS label, CAST(best_horizon AS BIGINT) AS best_horizon, {_r('tv', 't_value', 5)} FROM q", 5)


def _reversals(thetas):
    """Directional changes as a recursion along each symbol's bars for each theta; thetas: the CTEs that give th (symbol, theta)."""
    return f"""WITH RECURSIVE {_CTE[5:].rstrip()}, {thetas}, c AS (SELECT symbol, bar_idx AS k, timestamp, close AS p FROM bars),
walk(symbol, theta, k, up, ex, st, way, over) AS (SELECT c.symbol, th.theta, c.k, d.p >= c.p, c.p, c.p, 0, 0.0::DOUBLE FROM c JOIN c d ON d.symbol = c.symbol AND d.k = 1 JOIN th ON th.symbol = c.symbol WHERE c.k = 0 UNION ALL
SELECT symbol, theta, k, CASE WHEN hit THEN NOT up ELSE up END, CASE WHEN hit THEN p ELSE e END, CASE WHEN hit THEN p ELSE st END, CASE WHEN hit THEN CASE WHEN up THEN -1 ELSE 1 END ELSE 0 END, CASE WHEN hit THEN abs(e - st) / (st * theta) ELSE 0.0 END FROM
(SELECT *, e > 0 AND CASE WHEN up THEN e - p ELSE p - e END / e >= theta AS hit FROM (SELECT c.symbol, w.theta, c.k, w.up, w.st, c.p, CASE WHEN w.up THEN greatest(w.ex, c.p) ELSE least(w.ex, c.p) END AS e FROM walk w JOIN c ON c.symbol = w.symbol AND c.k = w.k + 1) y) x)
SELECT w.symbol, w.k AS bar_idx, c.timestamp, CAST(w.way AS BIGINT) AS label, {_r("w.theta", "theta", 5)}, {_r("w.over", "overshoot", 5)} FROM walk w JOIN c ON c.symbol = w.symbol AND c.k = w.k WHERE w.way <> 0"""


register("l05_directional_change", lambda t: ol.directional_changes(six_hours(t), (0.5, 1.0)), _reversals("th AS (SELECT symbol, unnest([0.5::DOUBLE, 1.0::DOUBLE]) AS theta FROM (SELECT DISTINCT symbol FROM bars))"), 5)
# returns of this tape are large, so its thetas are small multiples of their deviation
register("l06_volatility_changes", lambda t: ol.labels(six_hours(t), "directional_change", window=50, multipliers=(0.2, 0.3, 0.5)), _reversals("vo AS (SELECT symbol, greatest(coalesce(stddev_pop(r), 0.01), 1e-8) AS vol FROM (SELECT symbol, r FROM b QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) <= 50) GROUP BY symbol), th AS (SELECT symbol, greatest(vol * unnest([0.2::DOUBLE, 0.3::DOUBLE, 0.5::DOUBLE]), 1e-6) AS theta FROM vo)"), 5)
register("w01_sample_weights", lambda t: ol.weights(six_hours(t), 10, 86400000.0 * 7), f""", n AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS nb, coalesce(abs(r), 0) AS a FROM b), sp AS (SELECT symbol, bar_idx AS i, least(bar_idx + 10, nb - 1) AS e FROM n),
c AS (SELECT n.symbol, n.bar_idx, count(sp.i) AS concurrency FROM n LEFT JOIN sp ON sp.symbol = n.symbol AND n.bar_idx >= sp.i AND n.bar_idx < sp.e GROUP BY ALL),
u AS (SELECT sp.symbol, sp.i, sp.e, coalesce(sum(1.0 / c.concurrency) / nullif(max(sp.e - sp.i), 0), 0) AS uniq, coalesce(sum(n.a), 0) AS moved FROM sp LEFT JOIN n ON n.symbol = sp.symbol AND n.bar_idx >= sp.i AND n.bar_idx < sp.e LEFT JOIN c ON c.symbol = n.symbol AND c.bar_idx = n.bar_idx GROUP BY ALL),
z AS (SELECT n.symbol, n.bar_idx, c.concurrency, u.uniq, u.moved / sum(u.moved) OVER (PARTITION BY n.symbol) AS attr, power(2.0, -(max(n.timestamp) OVER (PARTITION BY n.symbol) - n.timestamp) / 604800000.0) AS decay FROM n JOIN c USING (symbol, bar_idx) JOIN u ON u.symbol = n.symbol AND u.i = n.bar_idx)
SELECT symbol, bar_idx, concurrency, {_r('uniq', 'uniqueness')}, {_r('attr', 'attribution')}, {_r('decay', 'decay')}, {_r('greatest(uniq * attr * decay, 1e-10) / sum(greatest(uniq * attr * decay, 1e-10)) OVER (PARTITION BY symbol)', 'weight', 9)} FROM z""", {"weight": 9})
# spans that end at the bar that meets a barrier
_MET = f""", v AS (SELECT *, stddev_samp(r) OVER w AS vol, count(*) OVER (PARTITION BY symbol) AS n FROM b{_W}), h AS (SELECT v.symbol, v.bar_idx, min(f.bar_idx) AS k FROM v JOIN v f ON f.symbol = v.symbol AND f.bar_idx BETWEEN v.bar_idx + 1 AND v.bar_idx + 10 AND (f.low <= v.close * (1 - v.vol) OR f.high >= v.close * (1 + v.vol)) GROUP BY ALL),
sp AS (SELECT v.symbol, v.bar_idx AS s, coalesce(h.k, least(v.bar_idx + 10, v.n - 1)) AS e, v.n, v.timestamp FROM v LEFT JOIN h USING (symbol, bar_idx))"""


def _met_spans(t):
    b = _with_vol(t)
    return b, ol.triple_barrier(b, hold=10, stop=1.0, take=1.0, ends=True).select("symbol", F.col("bar_idx").alias("start"), "end")


register("w02_span_weights", lambda t: ol.span_weights(*_met_spans(t), 86400000.0 * 7, size=32), f"""{_MET}, a AS (SELECT symbol, bar_idx, coalesce(abs(s), 0) AS a FROM b), c AS (SELECT a.symbol, a.bar_idx, a.a, count(sp.s) AS c FROM a LEFT JOIN sp ON sp.symbol = a.symbol AND a.bar_idx >= sp.s AND a.bar_idx < sp.e GROUP BY ALL),
u AS (SELECT sp.symbol, sp.s, sp.e, sp.timestamp, coalesce(avg(1.0 / c.c), 0) AS uniq, coalesce(sum(c.a), 0) AS moved FROM sp LEFT JOIN c ON c.symbol = sp.symbol AND c.bar_idx >= sp.s AND c.bar_idx < sp.e GROUP BY ALL),
z AS (SELECT *, moved / sum(moved) OVER (PARTITION BY symbol) AS attr, power(2.0, -(max(timestamp) OVER (PARTITION BY symbol) - timestamp) / 604800000.0) AS decay FROM u)
SELECT symbol, s AS start, e AS end, {_r('uniq', 'uniqueness')}, {_r('attr', 'attribution')}, {_r('decay', 'decay')}, {_r('greatest(uniq * attr * decay, 1e-10) / sum(greatest(uniq * attr * decay, 1e-10)) OVER (PARTITION BY symbol)', 'weight', 9)} FROM z""", {"weight": 9})
register("m01_span_folds", lambda t: (lambda b, sp: ol.purged_folds(b.join(sp.withColumnRenamed("start", "bar_idx"), ["symbol", "bar_idx"]), 5, 10, 0.02, F.col("end")))(*_met_spans(t)), _MET + """, z AS (SELECT symbol, s AS bar_idx, e AS le, n, fold, fold * (n // 5) AS a, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS o FROM (SELECT *, unnest(range(5)) AS fold FROM sp))
SELECT symbol, fold, bar_idx, CASE WHEN bar_idx >= a AND bar_idx < o THEN 'test' WHEN bar_idx < a AND le >= a THEN 'purged' WHEN bar_idx >= o AND bar_idx < o + floor(n * 0.02) THEN 'embargo' ELSE 'train' END AS role FROM z""")
register("m01_purged_folds", lambda t: ol.purged_folds(six_hours(t), 5, 10, 0.02), """, n AS (SELECT symbol, bar_idx, count(*) OVER (PARTITION BY symbol) AS n FROM bars), f AS (SELECT *, unnest(range(5)) AS fold FROM n), z AS (SELECT *, fold * (n // 5) AS s, CASE WHEN fold = 4 THEN n ELSE (fold + 1) * (n // 5) END AS e FROM f)
SELECT symbol, fold, bar_idx, CASE WHEN bar_idx >= s AND bar_idx < e THEN 'test' WHEN bar_idx < s AND least(bar_idx + 10, n - 1) >= s THEN 'purged' WHEN bar_idx >= e AND bar_idx < e + floor(n * 0.02) THEN 'embargo' ELSE 'train' END AS role FROM z""")
def _p():
    return F.col("id") % 1001 / 1000.0


register("m11_bet_sizes", lambda t: t.select("id", ol.bet_size(_p()).alias("bet_size"), ol.discretize(ol.bet_size(_p())).alias("level")), f"SELECT id, {_r('least(greatest(2 * p - 1, 0), 1)', 'bet_size')}, {_r('list_min(list_transform(range(11), lambda i: {{d: abs(least(greatest(2 * p - 1, 0), 1) - i / 10.0), v: i / 10.0}})).v'.replace('{{', '{').replace('}}', '}'), 'level')} FROM (SELECT id, (id % 1001) / 1000.0::DOUBLE AS p FROM tape)")
register("e07_funding", lambda t: t.select("id", sim.funding_cost(F.col("time"), F.col("time") + F.col("id") % 200 * 600000, F.col("quote_qty"), F.when(F.col("is_buyer_maker"), -1).otherwise(1)).alias("funding")), f"SELECT id, {_r('CASE WHEN id % 200 = 0 THEN 0.0 ELSE ((time + id % 200 * 600000) // 28800000 - time // 28800000) * 0.0001 * price * qty * CASE WHEN is_buyer_maker THEN -1 ELSE 1 END END', 'funding', 9)} FROM tape", 9)
register("e08_limit_price", lambda t: src.quotes(t).select("id", sim.limit_price(F.col("mid"), F.col("spread"), F.lit(1), F.lit(0.5)).alias("limit_price")), f"SELECT id, {_r('(price * (1 - 1e-4) + price * (1 + 1e-4)) / 2 - ln(1 + 0.1 / 1.5) / 1.5 * 0.6 * 0.75 * (price * (1 + 1e-4) - price * (1 - 1e-4))', 'limit_price')} FROM tape")
register("e09_fill_probability", lambda t: t.select("id", sim.fill_probability(F.col("qty"), F.when(F.col("is_buyer_maker"), -1.0).otherwise(1.0), F.col("price") / 10).alias("p")), f"SELECT id, {_r('1 - exp(-exp(-1.5 * qty) * exp(CASE WHEN is_buyer_maker THEN -0.5 ELSE 0.5 END) * price / 10)', 'p')} FROM tape")


def _signals(bars, reach=0.6):
    """A signal at every bar."""
    side = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    s = bars.select("symbol", F.col("bar_idx").alias("signal_id"), "timestamp", side.alias("side"), (F.col("bar_idx") % 10 / 10.0 + 0.1).alias("size"), "close")
    return s.select("symbol", "signal_id", "timestamp", "side", "size", (F.col("close") * (1 - reach * F.col("side"))).alias("sl_price"), (F.col("close") * (1 + reach * F.col("side"))).alias("pt_price"), (F.col("timestamp") + 86400000 * 2).alias("time_barrier"))


_SIG = """, sg AS (SELECT symbol, bar_idx AS signal_id, timestamp, CASE WHEN bar_idx % 2 = 0 THEN 1 ELSE -1 END AS side, bar_idx % 10 / 10.0::DOUBLE + 0.1 AS size, close FROM bars),
en AS (SELECT sg.symbol, sg.signal_id, sg.side, sg.size, sg.close, sg.timestamp + 172800000 AS tb, min(x.bar_idx) AS enter FROM sg JOIN bars x ON x.symbol = sg.symbol AND x.timestamp >= sg.timestamp GROUP BY ALL),
ex AS (SELECT en.symbol, en.signal_id, min(x.bar_idx) AS leave FROM en JOIN bars x ON x.symbol = en.symbol AND x.bar_idx >= en.enter AND (x.timestamp >= en.tb OR CASE WHEN en.side > 0 THEN x.low <= en.close * (1 - 0.6 * en.side) OR x.high >= en.close * (1 + 0.6 * en.side) ELSE x.high >= en.close * (1 - 0.6 * en.side) OR x.low <= en.close * (1 + 0.6 * en.side) END) GROUP BY ALL),
held AS (SELECT en.symbol, en.signal_id, en.side, en.size, en.enter, ex.leave FROM en LEFT JOIN ex USING (symbol, signal_id))"""
register("j06_positions", lambda t: sim.positions(_signals(six_hours(t)), six_hours(t)), _SIG + f" SELECT symbol, signal_id, CAST(side AS BIGINT) AS side, {_r('size', 'size')}, enter, leave FROM held")


def _exposed(t):
    b = kept_six_hours(t)
    return sim.exposure(sim.positions(_signals(b), b), b)


_EXP = _SIG + ", ep AS (SELECT x.symbol, x.bar_idx, x.timestamp, x.close, CASE WHEN count(held.side) > 0 THEN greatest(-1, least(1, avg(held.side * held.size))) ELSE 0.0 END AS exposure FROM bars x LEFT JOIN held ON held.symbol = x.symbol AND x.bar_idx >= held.enter AND (held.leave IS NULL OR x.bar_idx < held.leave) GROUP BY ALL)"
register("a03_exposure", lambda t: _exposed(t).select("symbol", "bar_idx", "exposure"), _EXP + f" SELECT symbol, bar_idx, {_r('exposure', 'exposure')} FROM ep")
register("e02_equity", lambda t: sim.equity(_exposed(t)).select("symbol", "bar_idx", "exposure", "drawdown"), _EXP + f""", fa AS (SELECT *, (1 + coalesce(lag(exposure) OVER o, 0) * coalesce(close / lag(close) OVER o - 1, 0)) * (1 - CASE WHEN abs(exposure - coalesce(lag(exposure) OVER o, 0)) > 1e-9 THEN abs(exposure - coalesce(lag(exposure) OVER o, 0)) * 0.001 ELSE 0 END) AS f FROM ep WINDOW o AS (PARTITION BY symbol ORDER BY bar_idx)),
eq AS (SELECT *, 10000 * exp(sum(CASE WHEN f > 0 THEN ln(f) END) OVER (PARTITION BY symbol ORDER BY bar_idx)) AS equity FROM fa) SELECT symbol, bar_idx, {_r('exposure', 'exposure')}, {_r('equity / greatest(10000, max(equity) OVER (PARTITION BY symbol ORDER BY bar_idx)) - 1', 'drawdown')} FROM eq""")
register("a02_signal_metrics", lambda t: _signals(six_hours(t)).groupBy("symbol").agg(F.count("*").alias("n"), F.count_if(F.col("side") == 1).alias("longs"), F.count_if(F.col("side") == -1).alias("shorts"), F.avg("size").alias("mean_size")), _SIG + f" SELECT symbol, count(*) AS n, count(*) FILTER (side = 1) AS longs, count(*) FILTER (side = -1) AS shorts, {_r('avg(size)', 'mean_size')} FROM sg GROUP BY symbol")
register("a13_median_interval", lambda t: six_hours(t).withColumn("d", F.col("timestamp") - ft.lag("timestamp")).groupBy("symbol").agg(F.median("d").alias("median_ms")), f" SELECT symbol, {_r('median(d)', 'median_ms')} FROM (SELECT symbol, timestamp - lag(timestamp) OVER (PARTITION BY symbol ORDER BY bar_idx) AS d FROM bars) GROUP BY symbol")
register("o04_newest_bars", lambda t: store.newest(six_hours(t), 50, symbol="click").select("symbol", "bar_idx", "timestamp", "close"), f" SELECT symbol, bar_idx, timestamp, {_r('close', 'close')} FROM bars WHERE symbol = 'click' ORDER BY timestamp DESC LIMIT 50")
register("o08_last_100_bars", lambda t: live.last_bars(six_hours(t)).select("symbol", "timestamp", "close"), f" SELECT symbol, timestamp, {_r('close', 'close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY bar_idx DESC) <= 100")
register("u05_latest_bar_of_timestamp", lambda t: six_hours(t).groupBy("timestamp").agg(F.max_by("close", F.struct("symbol", "bar_idx")).alias("close")), f" SELECT timestamp, {_r('arg_max(close, (symbol, bar_idx))', 'close')} FROM bars GROUP BY timestamp")
register("s08_symbols", lambda t: t.select("symbol").distinct(), " SELECT DISTINCT symbol FROM tape")
# three rates of each symbol, the second one negative, each from its time on
_RATES = ((1704110400000, 1e-4), (1704542400000, -2e-4), (1705406400000, 3e-4))


def _funded(t):
    rates = t.select("symbol").distinct().select("symbol", F.explode(F.array(*(F.struct(F.lit(a).alias("time"), F.lit(r).alias("rate")) for a, r in _RATES))).alias("x")).select("symbol", "x.*")
    p = t.select("id", "symbol", F.col("time").alias("entry"), (F.col("time") + F.col("id") % 200 * 6_000_000).alias("exit"), F.col("quote_qty").alias("notional"), F.when(F.col("is_buyer_maker"), -1).otherwise(1).alias("side"))
    return sim.funding_costs(p, rates, default=5e-5).select("id", "symbol", "funding")


register("e13_changing_rates", _funded, f""", p AS (SELECT id, symbol, time AS a, time + id % 200 * 6000000 AS b, price * qty AS n, CASE WHEN is_buyer_maker THEN -1 ELSE 1 END AS side FROM tape),
ev AS (SELECT id, unnest(range(a // 28800000 + 1, b // 28800000 + 1)) * 28800000 AS at FROM p), rt AS (SELECT unnest({[a for a, _ in _RATES]}) AS since, unnest({[r for _, r in _RATES]}::DOUBLE[]) AS rate),
s AS (SELECT ev.id, sum(coalesce(rt.rate, 0.00005)) AS rate FROM ev ASOF LEFT JOIN rt ON ev.at >= rt.since GROUP BY ev.id) SELECT p.id, p.symbol, {_r('coalesce(s.rate, 0) * n * side', 'funding', 9)} FROM p LEFT JOIN s USING (id)""", 9)
register("s14_retention", lambda t: store.kept(t, "ticks", 1706572800000).select("id", "time"), " SELECT id, time FROM tape WHERE time >= 1706572800000 - 86400000")
register("e12_bbo_stats", lambda t: src.mean_spread(src.quotes(t)).select("symbol", "id", "avg_spread_bps"), f" SELECT symbol, id, {_r('avg((price * (1 + 1e-4) - price * (1 - 1e-4)) / ((price * (1 + 1e-4) + price * (1 - 1e-4)) / 2) * 1e4) OVER (PARTITION BY symbol ORDER BY time, id ROWS 99 PRECEDING)', 'avg_spread_bps')} FROM tape")
register("j03_trade_features_on_bars", _trades_on_bars, f", im AS (SELECT symbol, id, time, sum(CASE WHEN is_buyer_maker THEN qty ELSE -qty END) OVER w / sum(qty) OVER w AS x FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY time, id ROWS 19 PRECEDING)), k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time // 21600000) - 1 AS bar_idx, arg_max(x, (time, id)) AS x FROM im GROUP BY symbol, time // 21600000) SELECT bars.symbol, bars.bar_idx, bars.timestamp, {_r('k.x', 'imbalance', 9)} FROM bars LEFT JOIN k USING (symbol, bar_idx)", 9)
