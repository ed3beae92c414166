"""Registered queries of break tests, encoded entropies, walk-forward windows, orders, realistic equity and learning."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import encodings as en
from barloom.functions import features as ft
from barloom.functions import unit_root as ur
from barloom.functions import table
from barloom.functions.frames import difference_weights
from barloom.operators import bars as ob
from barloom.operators import labels as ol
from barloom.operators import learning, orders
from barloom.operators import simulation as sim
from barloom.operators import walk_forward as wf
from barloom.plans.catalog import _CTE, _EXP, _O, _SIG, _SQL, _W, ORACLES, QUERIES, _r, _signals, in_bars, in_parts, kept_six_hours, register, six_hours
from barloom.sources import trades as src
from barloom.streaming import signals as live

__all__ = ["ORACLES", "QUERIES"]


def _t(w, n="count(d)"):
    """The t value of a Dickey-Fuller regression over the rows of w (an OVER clause, or nothing for groups)."""
    c = {p: f"covar_pop({p[0]}, {p[1]}) {w}" for p in ("dd", "ll", "zz", "dl", "dz", "lz")}
    det = f"({c['ll']} * {c['zz']} - {c['lz']} * {c['lz']})"
    a, b = f"(({c['dl']} * {c['zz']} - {c['dz']} * {c['lz']}) / nullif({det}, 0))", f"(({c['dz']} * {c['ll']} - {c['dl']} * {c['lz']}) / nullif({det}, 0))"
    rest = f"({c['dd']} - {a} * {c['dl']} - {b} * {c['dz']})"
    return f"CASE WHEN {n} {w} > 3 AND {det} > 1e-12 * {c['ll']} * {c['zz']} AND {rest} > 0 THEN {a} * sqrt(({n} {w} - 3) * {det} / ({rest} * {c['zz']})) END"


_LAGS = f", y AS (SELECT symbol, bar_idx, ln(close) AS y FROM bars), l0 AS (SELECT *, lag(y) {_O} AS y1, lag(y, 2) {_O} AS y2 FROM y), lg AS (SELECT symbol, bar_idx, y, CASE WHEN y2 IS NOT NULL THEN y - y1 END AS d, CASE WHEN y2 IS NOT NULL THEN y1 END AS l, y1 - y2 AS z FROM l0)"
_HALF = "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {} PRECEDING AND {} PRECEDING)"
register("f21_unit_root_frames", in_parts(lambda b: ur.unit_root(b)), f"""{_LAGS}, h AS (SELECT *, {_t(_HALF.format(48, 26))} AS a, {_t(_HALF.format(23, 1))} AS b FROM lg),
fr AS (SELECT i.symbol, i.bar_idx, x.bar_idx AS k, x.d, x.l, x.z FROM lg i JOIN lg x ON x.symbol = i.symbol AND x.bar_idx BETWEEN i.bar_idx - 48 AND i.bar_idx - 1 WHERE i.bar_idx >= 50),
gt AS (SELECT symbol, bar_idx, k - bar_idx + 49 AS m, {_t("OVER (PARTITION BY symbol, bar_idx ORDER BY k)")} AS t FROM fr), s AS (SELECT symbol, bar_idx, max(t) AS t FROM gt WHERE m >= 14 GROUP BY ALL)
SELECT h.symbol, h.bar_idx, {_r("CASE WHEN h.bar_idx >= 50 AND a IS NOT NULL AND b IS NOT NULL THEN greatest(a, b) END", "chow_type_df", 5)}, {_r("s.t", "rolling_sadf", 5)} FROM h LEFT JOIN s USING (symbol, bar_idx)""", 5)
register("f23_sadf", lambda t: ur.sadf(six_hours(t)), f"""{_LAGS}, gt AS (SELECT *, {_t("OVER (PARTITION BY symbol ORDER BY bar_idx)")} AS t FROM lg) SELECT symbol, {_r("CASE WHEN count(*) >= 25 THEN max(t) FILTER (bar_idx >= 19) END", "sadf", 5)} FROM gt GROUP BY symbol""", 5)
register("f23_gsadf", lambda t: ur.gsadf(six_hours(t)), f"""{_LAGS}, fr AS (SELECT i.symbol, i.bar_idx, x.bar_idx AS k, x.d, x.l, x.z FROM lg i JOIN lg x ON x.symbol = i.symbol AND x.bar_idx BETWEEN i.bar_idx - 497 AND i.bar_idx WHERE x.d IS NOT NULL),
gt AS (SELECT symbol, bar_idx - k AS back, {_t("OVER (PARTITION BY symbol, bar_idx ORDER BY k DESC)")} AS t FROM fr), n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol) SELECT n.symbol, {_r("CASE WHEN max(n.n) >= 25 THEN max(t) FILTER (back >= 17) END", "gsadf", 5)} FROM n LEFT JOIN gt USING (symbol) GROUP BY n.symbol""", 5)
_GRID = [(round(0.05 * k, 4), len(difference_weights(round(0.05 * k, 4)))) for k in range(1, 21)]
register("f15_least_d", lambda t: ur.least_d(six_hours(t)), f"""{_LAGS}, gr AS (SELECT unnest([{", ".join(f"{{o: {d}::DOUBLE, n: {n}}}" for d, n in _GRID)}], recursive := true)),
wr AS (SELECT o, n, unnest(range(n)) AS k FROM gr), wt AS (SELECT o, n, k, CASE WHEN k = 0 THEN 1.0 ELSE product(CASE WHEN k = 0 THEN 1.0 ELSE (k - 1 - o) / k END) OVER (PARTITION BY o ORDER BY k) END AS v FROM wr WHERE k <= (SELECT max(bar_idx) FROM bars)),
df AS (SELECT lg.symbol, lg.bar_idx, wt.o, sum(wt.v * x.y) AS v FROM lg JOIN wt ON lg.bar_idx >= wt.n - 1 JOIN lg x ON x.symbol = lg.symbol AND x.bar_idx = lg.bar_idx - wt.k GROUP BY ALL),
d1 AS (SELECT *, lag(v) OVER w AS l0, v - lag(v) OVER w AS d0 FROM df WINDOW w AS (PARTITION BY symbol, o ORDER BY bar_idx)), d2 AS (SELECT *, lag(d0) OVER (PARTITION BY symbol, o ORDER BY bar_idx) AS z FROM d1), d3 AS (SELECT symbol, o, z, CASE WHEN z IS NOT NULL THEN d0 END AS d, CASE WHEN z IS NOT NULL THEN l0 END AS l FROM d2),
te AS (SELECT symbol, o, count(*) AS n, {_t("")} AS t FROM d3 GROUP BY symbol, o) SELECT s.symbol, coalesce(min(te.o), 1.0) AS min_d FROM (SELECT DISTINCT symbol FROM bars) s LEFT JOIN te ON te.symbol = s.symbol AND te.n >= 20 AND te.t < {ur.critical_t()!r} GROUP BY s.symbol""")
register("f17_cusum_events", lambda t: ur.cusum_events(six_hours(t), 100.0), f"""WITH RECURSIVE {ORACLES["b01_time_bars"].split("ret AS", 1)[0][5:].rstrip().rstrip(",")}, mv AS (SELECT symbol, bar_idx, timestamp, close - lag(close) {_O} AS m FROM bars), dm AS (SELECT *, m - avg(m) OVER (PARTITION BY symbol) AS x FROM mv),
walk(symbol, bar_idx, up, down, way) AS (SELECT symbol, bar_idx, 0.0::DOUBLE, 0.0::DOUBLE, 0 FROM dm WHERE bar_idx = 0 UNION ALL SELECT d.symbol, d.bar_idx, CASE WHEN w.way <> 0 THEN greatest(0, d.x) ELSE greatest(0, w.up + d.x) END, CASE WHEN w.way <> 0 THEN least(0, d.x) ELSE least(0, w.down + d.x) END, CASE WHEN (CASE WHEN w.way <> 0 THEN 0 ELSE w.up END) + d.x > 100 THEN 1 WHEN (CASE WHEN w.way <> 0 THEN 0 ELSE w.down END) + d.x < -100 THEN -1 ELSE 0 END FROM walk w JOIN dm d ON d.symbol = w.symbol AND d.bar_idx = w.bar_idx + 1)
SELECT walk.symbol, walk.bar_idx, dm.timestamp, CAST(walk.way AS INTEGER) AS way FROM walk JOIN dm USING (symbol, bar_idx) WHERE way <> 0""")
_REST = "regr_syy(y, {0}) - regr_sxy(y, {0}) * regr_sxy(y, {0}) / nullif(regr_sxx(y, {0}), 0)"
register("f18_chow", lambda t: ur.chow(six_hours(t)), f""", q AS (SELECT symbol, bar_idx::DOUBLE AS t, ln(close) AS y, count(*) OVER (PARTITION BY symbol) AS n FROM bars), r AS (SELECT symbol, n, {_REST.format("t")} AS whole, {_REST.format("CASE WHEN t < n // 2 THEN t END")} + {_REST.format("CASE WHEN t >= n // 2 THEN t END")} AS parts FROM q GROUP BY symbol, n)
SELECT symbol, {_r("CASE WHEN n // 2 >= 3 AND n // 2 <= n - 3 AND parts > 0 THEN (whole - parts) / 2 / (parts / (n - 4)) ELSE 0.0 END", "chow_f")} FROM r""")
register("f19_recursive_cusum", in_parts(lambda b: b.withColumn("x", F.ln("close")).select("symbol", "bar_idx", ur.recursive_cusum("x").alias("bde_cusum"))), f""", fr AS (SELECT b.symbol, b.bar_idx, x.bar_idx - b.bar_idx + 50 AS k, ln(x.close) AS y FROM bars b JOIN bars x ON x.symbol = b.symbol AND x.bar_idx BETWEEN b.bar_idx - 50 AND b.bar_idx - 1 WHERE b.bar_idx >= 50),
e AS (SELECT symbol, bar_idx, k, y - regr_intercept(y, k) OVER p - regr_slope(y, k) OVER p * k AS e FROM fr WINDOW p AS (PARTITION BY symbol, bar_idx ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, sum(e) OVER (PARTITION BY symbol, bar_idx ORDER BY k) AS run FROM e WHERE k >= 12), s AS (SELECT symbol, bar_idx, CASE WHEN stddev_pop(e) < 1e-15 THEN 0.0 ELSE max(abs(run)) / stddev_pop(e) / sqrt(38) END AS v FROM c GROUP BY ALL) SELECT bars.symbol, bars.bar_idx, {_r("s.v", "bde_cusum", 5)} FROM bars LEFT JOIN s USING (symbol, bar_idx)""", 5)


def _h(c):
    count = f"len(list_filter({c}, lambda q: q = k))"
    return f"(ln(len({c})) - list_sum(list_transform(list_distinct({c}), lambda k: {count} * ln({count}))) / len({c}))"


def _match(c, back):
    """Runs found in the symbols before, as in encodings.match_entropy; c is a text."""
    return f"(log2({back}) * (length({c}) - {back}) / list_sum(list_transform(range({back}::BIGINT, length({c})), lambda i: 1.0 + len(list_filter(range(1, least(length({c}) - i, {back}) + 1), lambda m: contains(substr({c}, (i - {back} + 1)::BIGINT, {back}::BIGINT), substr({c}, (i + 1)::BIGINT, m::BIGINT)))))))"


def _codes(v):
    edge = "s{v}[floor((len({v}) - 1) * j / 10.0)::BIGINT + 1] + (s{v}[least(floor((len({v}) - 1) * j / 10.0)::BIGINT + 1, len({v}) - 1) + 1] - s{v}[floor((len({v}) - 1) * j / 10.0)::BIGINT + 1]) * ((len({v}) - 1) * j / 10.0 - floor((len({v}) - 1) * j / 10.0))".format(v=v)
    return {
        "binary": f"list_transform({v}, lambda x: CASE WHEN x >= 0 THEN 1 ELSE 0 END)",
        "quantile": f"list_transform({v}, lambda x: len(list_filter(list_distinct(list_transform(range(1, 10), lambda j: {edge})), lambda e: e > s{v}[1] AND e < x)))",
        "sigma": f"list_transform({v}, lambda x: CASE WHEN coalesce(d{v}, 0) < 1e-15 THEN 0 ELSE len(list_filter(range(-3, 4), lambda j: m{v} + j * d{v} <= x)) END)",
    }


def _entropy_sql():
    frames = f", f0 AS (SELECT symbol, bar_idx, list(r) FILTER (r IS NOT NULL) OVER p AS v, list(r1) FILTER (r1 IS NOT NULL) OVER p AS u FROM b WINDOW p AS (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)), f1 AS (SELECT *, " + ", ".join(f"list_sort({c}) AS s{c}, list_avg({c}) AS m{c}, list_stddev_samp({c}) AS d{c}" for c in "vu") + " FROM f0 WHERE bar_idx >= 20)"
    codes = ", f2 AS (SELECT symbol, bar_idx, least(len(v) // 3, 6) AS kw, len(v) AS n, " + ", ".join(f"{_codes('v')[e]} AS c_{e}, {_codes('u')[e]} AS l_{e}" for e in en.ENCODERS) + " FROM f1)"
    cut = ", f3 AS (SELECT *, " + ", ".join(f"c_{e}[1:least(len(c_{e}), len(l_{e}))] AS x_{e}, l_{e}[1:least(len(c_{e}), len(l_{e}))] AS y_{e}, array_to_string(list_transform(c_{e}, lambda q: chr((q + 97)::INTEGER)), '') AS t_{e}" for e in en.ENCODERS) + " FROM f2)"
    pair = ", f4 AS (SELECT *, " + ", ".join(f"list_transform(list_zip(x_{e}, y_{e}), lambda q: q[1] * 100 + q[2]) AS z_{e}" for e in en.ENCODERS) + " FROM f3)"
    ent = ", f5 AS (SELECT *, " + ", ".join(f"{_h(f'{c}_{e}')} AS h{c}_{e}" for e in en.ENCODERS for c in "cxyz") + " FROM f4)"
    out = []
    for e in en.ENCODERS:
        mi = f"greatest(hx_{e} + hy_{e} - hz_{e}, 0)"
        for name, sql in (("shannon", f"hc_{e}"), ("redundancy", f"CASE WHEN len(list_distinct(c_{e})) <= 1 THEN 0.0 ELSE 1 - hc_{e} / ln(len(list_distinct(c_{e}))) END"), ("mi", mi), ("nvi", f"CASE WHEN hz_{e} > 1e-12 THEN 1 - {mi} / hz_{e} ELSE 1.0 END"), ("kontoyiannis", f"CASE WHEN kw >= 3 AND n >= kw + 2 THEN {_match(f't_{e}', 'kw')} END")):
            out.append(_r(sql, f"entropy_{e}_{name}"))
    names = [f"entropy_{e}_{m}" for e in en.ENCODERS for m in ("shannon", "redundancy", "mi", "nvi", "kontoyiannis")]
    return frames + codes + cut + pair + ent + ", f6 AS (SELECT symbol, bar_idx, " + ", ".join(out) + " FROM f5) SELECT bars.symbol, bars.bar_idx, " + ", ".join(f"f6.{x}" for x in names) + " FROM bars LEFT JOIN f6 USING (symbol, bar_idx)"


register("f34_encoded_entropies", in_parts(lambda b: en.encoded_entropies(b)), _entropy_sql())
register("f28_rolling_kontoyiannis", in_parts(lambda b: en.rolling_match_entropy(b)), f", f0 AS (SELECT symbol, bar_idx, list(r) FILTER (r IS NOT NULL) OVER p AS v FROM b WINDOW p AS (PARTITION BY symbol ORDER BY bar_idx ROWS 59 PRECEDING)), f1 AS (SELECT symbol, bar_idx, v, list_median(v) AS m, least(len(v) // 3, 20) AS kw FROM f0 WHERE len(v) >= 10), f2 AS (SELECT symbol, bar_idx, kw, array_to_string(list_transform(v, lambda x: CASE WHEN x >= m THEN 'b' ELSE 'a' END), '') AS t FROM f1), f3 AS (SELECT symbol, bar_idx, {_r(_match('t', 'kw'), 'rolling_kontoyiannis')} FROM f2) SELECT bars.symbol, bars.bar_idx, f3.rolling_kontoyiannis FROM bars LEFT JOIN f3 USING (symbol, bar_idx)")
_MOMENT = "CASE WHEN count(x) OVER w >= {k} AND var_samp(x) OVER w > 1e-9 THEN {f}(x) OVER w END"


def _spread_moments(t):
    w, b = ft.last(20), ft.features(six_hours(t), 20, ["roll_spread"])
    spread = F.var_samp("roll_spread").over(w) > 1e-9
    return b.select("symbol", "bar_idx", F.when(spread, ft.skew("roll_spread", w)).alias("spread_skew"), F.when(spread, ft.kurt("roll_spread", w)).alias("spread_kurtosis"))


register("f43_spread_shape", _spread_moments, f", sp AS (SELECT symbol, bar_idx, {_SQL['f38_roll_spread']} AS x FROM b{_W}) SELECT symbol, bar_idx, {_r(_MOMENT.format(k=3, f='skewness'), 'spread_skew', 4)}, {_r(_MOMENT.format(k=4, f='kurtosis'), 'spread_kurtosis', 4)} FROM sp{_W}", 4)
_KEEP = 1 - 2 / 21
register("f47_decayed_volatility", lambda t: ur.decayed_volatility(six_hours(t)).select("symbol", "bar_idx", "vol"), f""", gt AS (SELECT i.symbol, i.bar_idx, count(x.r) AS n, sum(power({_KEEP!r}, i.bar_idx - x.bar_idx)) AS w, sum(power({_KEEP!r}, 2 * (i.bar_idx - x.bar_idx))) AS ww, sum(power({_KEEP!r}, i.bar_idx - x.bar_idx) * x.r) AS s, sum(power({_KEEP!r}, i.bar_idx - x.bar_idx) * x.r * x.r) AS q FROM b i LEFT JOIN b x ON x.symbol = i.symbol AND x.bar_idx <= i.bar_idx AND x.bar_idx > i.bar_idx - 400 AND x.r IS NOT NULL GROUP BY ALL),
v AS (SELECT symbol, bar_idx, CASE WHEN n >= 10 THEN sqrt(greatest(q / w - s / w * s / w, 0) * w * w / (w * w - ww)) END AS v FROM gt) SELECT symbol, bar_idx, {_r("greatest(coalesce(v, first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 1e-12)", "vol")} FROM v""")
_DAY = wf.DAY_MS


def _windows(t):
    return wf.boundaries(t.groupBy("symbol").agg(F.min("time").alias("start"), F.max("time").alias("end")), 7, 3, 3)


_WIN = f", ws AS (SELECT symbol, min(time) AS s, max(time) AS e FROM tape GROUP BY symbol), wn AS (SELECT symbol, s, unnest(range((e - s - {10 * _DAY}) // {3 * _DAY} + 1)) AS w FROM ws WHERE e - s >= {10 * _DAY}), wb AS (SELECT symbol, w, s + w * {3 * _DAY} AS a FROM wn)"
register("m12_windows", _windows, f"{_WIN} SELECT symbol, CAST(w AS INTEGER) AS \"window\", a AS train_start, a + {7 * _DAY} AS train_end, a + {7 * _DAY} AS test_start, a + {10 * _DAY} AS test_end FROM wb")


def _curves(t):
    """The closes of each test window, as if they were its equity."""
    w = _windows(t).select("symbol", "window", "test_start", "test_end")
    b = six_hours(t).join(w, "symbol").where("timestamp >= test_start and timestamp < test_end")
    return b.select(F.col("symbol").alias("run"), "window", "timestamp", F.col("close").alias("equity"))


_CUR = f'{_WIN}, cu AS (SELECT bars.symbol AS run, CAST(w AS INTEGER) AS "window", timestamp, close AS equity FROM bars JOIN wb ON wb.symbol = bars.symbol AND timestamp >= a + {7 * _DAY} AND timestamp < a + {10 * _DAY})'
register("a06_stitched", lambda t: wf.stitched(_curves(t)).withColumn("equity", F.round("equity", 1)).withColumn("drawdown", F.round("drawdown", 5)), f"""{_CUR}, ed AS (SELECT run, "window", arg_min(equity, timestamp) AS f, arg_max(equity, timestamp) AS l FROM cu GROUP BY ALL), sc AS (SELECT run, "window", f, coalesce(exp(sum(ln(l / f)) OVER (PARTITION BY run ORDER BY "window" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1) AS scale FROM ed),
st AS (SELECT cu.run, cu."window", timestamp, round(10000 * scale * equity / f, 2) AS equity FROM cu JOIN sc USING (run, "window")), pk AS (SELECT *, greatest(10000, max(equity) OVER (PARTITION BY run ORDER BY "window", timestamp)) AS p FROM st) SELECT run, "window", timestamp, round(equity, 1) AS equity, round(round((equity - p) / p, 6), 5) + 0.0 AS drawdown FROM pk""")


def _results(t):
    c = _curves(t).groupBy("run", "window").agg((F.max_by("equity", "timestamp") / F.min_by("equity", "timestamp") - 1).alias("total_return"), F.avg("equity").alias("mean_equity"))
    return c.unpivot(["run", "window"], ["total_return", "mean_equity"], "metric", "value")


register("a05_bootstrap", lambda t: wf.bootstrap(_results(t)), f"""{_CUR}, rs AS (SELECT run, "window", unnest(['total_return', 'mean_equity']) AS metric, unnest([arg_max(equity, timestamp) / arg_min(equity, timestamp) - 1, avg(equity)]) AS value FROM cu GROUP BY run, "window"),
rk AS (SELECT *, row_number() OVER (PARTITION BY run, metric ORDER BY "window") - 1 AS k FROM rs), sz AS (SELECT run, metric, count(*) AS n, avg(value) AS mean, coalesce(CASE WHEN count(*) > 1 THEN stddev_samp(value) END, 0) AS std FROM rs GROUP BY run, metric),
dr AS (SELECT run, metric, n, smp, unnest(range(1, n + 1)) AS place FROM (SELECT run, metric, n, unnest(range(1, 1001)) AS smp FROM sz)), pk AS (SELECT run, metric, n, smp, ('0x' || substr(md5('42:' || smp || ':' || place), 1, 8))::BIGINT % n AS k FROM dr),
mn AS (SELECT pk.run, pk.metric, pk.smp, sum(value) / max(n) AS m FROM pk JOIN rk USING (run, metric, k) GROUP BY ALL), ci AS (SELECT run, metric, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi FROM mn GROUP BY ALL) SELECT run, metric, {_r("mean", "mean", 4)}, {_r("std", "std", 4)}, {_r("lo", "ci_lower", 4)}, {_r("hi", "ci_upper", 4)} FROM sz JOIN ci USING (run, metric)""", 4)
_QUOTE = "price * (1 - 1e-4) AS bid, price * (1 + 1e-4) AS ask"


def _orders(t):
    b = six_hours(t)
    side = F.when(F.col("bar_idx") % 2 == 0, 1).otherwise(-1)
    s = b.select("symbol", F.col("bar_idx").alias("signal_id"), "timestamp", side.alias("side"), (F.col("bar_idx") % 11 / 10.0).alias("size"), F.col("close").alias("entry_price"))
    # one quote for each symbol and time
    q = src.quotes(t).groupBy("symbol", "time").agg(F.max_by("mid", "id").alias("mid"), F.max_by("spread", "id").alias("spread")).withColumn("bid_qty", F.lit(0.3)).withColumn("ask_qty", F.lit(0.0))
    return orders.place(s, q)


_ORD = f""", qu AS (SELECT symbol, time, arg_max(price, id) AS price FROM tape GROUP BY ALL), os AS (SELECT symbol, bar_idx AS signal_id, timestamp AS submitted, CASE WHEN bar_idx % 2 = 0 THEN 1 ELSE -1 END AS side, bar_idx % 11 / 10.0::DOUBLE AS size FROM bars WHERE bar_idx % 11 > 0),
oq AS (SELECT os.*, (price * (1 - 1e-4) + price * (1 + 1e-4)) / 2 AS mid, price * (1 + 1e-4) - price * (1 - 1e-4) AS spread FROM os ASOF JOIN qu ON os.symbol = qu.symbol AND os.submitted >= qu.time),
ords AS (SELECT symbol, signal_id, submitted, side, size, mid - side * (ln(1 + 0.1 / 1.5) / 1.5 * 0.6) * (1 - 0.5 * size) * spread AS limit_price, greatest(CASE WHEN side = 1 THEN 0.3 ELSE 1.0 END - size, 0) AS queue_ahead FROM oq),
tp AS (SELECT *, lag(time) OVER (PARTITION BY symbol ORDER BY time, id) AS was FROM tape), mt AS (SELECT o.*, t.time, t.id, t.price, t.time > o.submitted + 7200000 AS late, CASE WHEN t.price = o.limit_price AND (o.side = 1) = t.is_buyer_maker THEN t.qty ELSE 0 END AS used, CASE WHEN o.side = 1 THEN t.price < o.limit_price ELSE t.price > o.limit_price END AS through FROM ords o JOIN tp t ON t.symbol = o.symbol AND t.time > o.submitted AND (t.time <= o.submitted + 7200000 OR t.was <= o.submitted + 7200000)),
hs AS (SELECT *, through OR (queue_ahead > 0 AND sum(used) OVER (PARTITION BY symbol, signal_id ORDER BY time, id) >= queue_ahead) AS hit FROM mt), ff AS (SELECT symbol, signal_id, min(time) FILTER (hit) AS fill_time, arg_min(price, (time, id)) FILTER (hit) AS fill_price, bool_or(late) AS late FROM hs GROUP BY ALL),
fl AS (SELECT o.symbol, o.signal_id, o.side, o.size, o.limit_price, o.submitted, CASE WHEN ff.fill_time IS NOT NULL THEN 'filled' WHEN late THEN 'expired' ELSE 'open' END AS status, ff.fill_time, ff.fill_price, ff.fill_time - o.submitted AS queue_wait_ms FROM ords o LEFT JOIN ff USING (symbol, signal_id))"""
register("e11_fills", lambda t: orders.fills(_orders(t), t, 7_200_000), f"{_ORD} SELECT symbol, signal_id, CAST(side AS INTEGER) AS side, {_r('size', 'size')}, {_r('limit_price', 'limit_price')}, submitted, status, fill_time, {_r('fill_price', 'fill_price')}, queue_wait_ms FROM fl")
register("e11_fill_stats", lambda t: orders.fill_stats(orders.fills(_orders(t), t, 7_200_000)), f"{_ORD} SELECT symbol, count(*) AS submitted, count(*) FILTER (status = 'filled') AS filled, count(*) FILTER (status = 'expired') AS expired, {_r('''count(*) FILTER (status = 'filled') / count(*) * 100''', 'fill_rate')}, {_r('coalesce(avg(queue_wait_ms), 0)', 'avg_wait_ms')}, {_r('coalesce(avg(0.02 * sqrt(size * fill_price / 1e9) * 1e4), 0)', 'avg_slippage_bps')}, CASE WHEN count(*) FILTER (status = 'filled') > 0 THEN 100.0 ELSE 0.0 END AS maker_ratio FROM fl GROUP BY symbol")
_COST = "price * qty * CASE WHEN is_buyer_maker THEN 2.0 ELSE 5.0 END / 1e4"
_SLIP = "0.02 * sqrt(price * qty / 1e9) * price * qty"


def _costs(t):
    """Costs of each trade; in basis points they are infinite where nothing was paid, as the SQL's division has it."""
    c = sim.transaction_cost(F.col("quote_qty"), F.when(F.col("is_buyer_maker"), "maker").otherwise("taker"), F.col("qty") / 1000, F.col("qty") / 100, factors=(F.col("price"), F.col("qty")))
    return t.select("id", c.alias("c")).select("id", "c.*").withColumn("total_bps", ft.ratio("total", "notional") * 1e4)


register("e06_transaction_costs", _costs, f"SELECT id, {_r(_COST, 'exchange_fee', 11)}, {_r('qty / 100', 'funding_cost', 11)}, {_r('qty / 2000 * price * qty', 'spread_cost', 11)}, {_r(_SLIP, 'slippage', 11)}, {_r(f'0.1 * {_SLIP}', 'market_impact', 11)}, {_r(f'{_COST} + qty / 100 + qty / 2000 * price * qty + 1.1 * {_SLIP}', 'total', 11)}, {_r('price * qty', 'notional', 11)}, {_r(f'({_COST} + qty / 100 + qty / 2000 * price * qty + 1.1 * {_SLIP}) / (price * qty) * 1e4', 'total_bps', 11)} FROM tape", 11)


def _far(bars):
    """Signals whose price barriers are so far off that most positions are held to their time barrier."""
    return _signals(bars, 20)


def _wide(sql):
    return sql.replace("1 - 0.6", "1 - 20").replace("1 + 0.6", "1 + 20")


def _realistic(t):
    b = kept_six_hours(t)
    s = orders.accepted(_far(b).withColumn("meta_probability", F.col("signal_id") % 5 / 10.0 + 0.6))
    held = sim.positions(s, b)
    return orders.realistic_equity(sim.exposure(held, b), orders.funding(s, held, b))


def _held(t):
    b = kept_six_hours(t)
    return sim.exposure(sim.positions(_far(b), b), b)


_TAKEN = _SIG.replace("close FROM bars)", "close FROM bars WHERE ('0x' || substr(md5('42:' || symbol || ':' || bar_idx), 1, 8))::BIGINT / 4294967296.0::DOUBLE < power(bar_idx % 5 / 10.0::DOUBLE + 0.6, 2))")
_REAL = _EXP.replace(_SIG, _TAKEN) + """, fu AS (SELECT h.symbol, h.leave AS bar_idx, sum((x.timestamp // 28800000 - g.timestamp // 28800000) * 1e-4 * h.side * abs(h.size * CASE WHEN (h.side > 0 AND x.low <= g.close * (1 - 0.6 * h.side)) OR (h.side < 0 AND x.high >= g.close * (1 - 0.6 * h.side)) THEN g.close * (1 - 0.6 * h.side) WHEN (h.side > 0 AND x.high >= g.close * (1 + 0.6 * h.side)) OR (h.side < 0 AND x.low <= g.close * (1 + 0.6 * h.side)) THEN g.close * (1 + 0.6 * h.side) ELSE x.close END)) AS funding FROM held h JOIN sg g USING (symbol, signal_id) JOIN bars x ON x.symbol = h.symbol AND x.bar_idx = h.leave WHERE x.timestamp > g.timestamp GROUP BY ALL),
st AS (SELECT ep.symbol, ep.bar_idx, ep.exposure, coalesce(fu.funding, 0.0) AS due, coalesce(lag(exposure) OVER o, 0.0) AS before, coalesce(close / lag(close) OVER o - 1, 0.0) AS ret FROM ep LEFT JOIN fu USING (symbol, bar_idx) WINDOW o AS (PARTITION BY ep.symbol ORDER BY ep.bar_idx)),
wk(symbol, bar_idx, equity) AS (SELECT DISTINCT symbol, -1::BIGINT, 10000.0::DOUBLE FROM st UNION ALL SELECT s.symbol, s.bar_idx, e - CASE WHEN abs(s.exposure - s.before) > 1e-9 THEN abs(s.exposure - s.before) * abs(e) * (3e-4 + 1.1 * 0.02 * sqrt(abs(s.exposure - s.before) * abs(e) / 1e9)) ELSE 0 END FROM (SELECT st.*, (wk.equity - st.due) * (1 + st.before * st.ret) AS e FROM wk JOIN st ON st.symbol = wk.symbol AND st.bar_idx = wk.bar_idx + 1) s)"""
register("e03_realistic_equity", lambda t: _realistic(t).select("symbol", "bar_idx", "exposure", "equity", "funding"), "WITH RECURSIVE " + ORACLES["e02_equity"].split(", sg AS", 1)[0][5:] + _wide(_REAL) + f" SELECT wk.symbol, wk.bar_idx, {_r('exposure', 'exposure', 4)}, {_r('equity', 'equity', 4)}, {_r('due', 'funding', 4)} FROM wk JOIN st USING (symbol, bar_idx)", 4)
register("t05_exposure_changes", lambda t: live.changes(_held(t)).select("symbol", "bar_idx", "level"), _wide(_EXP) + f", lv AS (SELECT symbol, bar_idx, round_even(round(exposure * 10, 9), 0) / 10 AS level FROM ep), ch AS (SELECT *, coalesce(lag(level) {_O}, 0) AS was FROM lv) SELECT symbol, bar_idx, {_r('level', 'level')} FROM ch WHERE level <> was")
register("t03_last_bars", lambda t: live.last_bars(six_hours(t)).where(F.col("all_bars") >= live.LEAST).select("symbol", "bar_idx", "timestamp", "close"), f", n AS (SELECT symbol, timestamp, close, row_number() OVER (PARTITION BY symbol ORDER BY timestamp DESC) AS k FROM bars QUALIFY k <= 100), m AS (SELECT *, count(*) OVER (PARTITION BY symbol) AS n FROM n) SELECT symbol, n - k AS bar_idx, timestamp, {_r('close', 'close')} FROM m WHERE n >= 25")
register("m06_label_spans", lambda t: six_hours(t).select("symbol", "bar_idx", *(F.least(F.col("bar_idx") + n, F.max("bar_idx").over(W.partitionBy("symbol"))).alias(k) for k, n in learning.SPANS.items())), ", m AS (SELECT symbol, bar_idx, max(bar_idx) OVER (PARTITION BY symbol) AS e FROM bars) SELECT symbol, bar_idx, " + ", ".join(f"least(bar_idx + {n}, e) AS {k}" for k, n in learning.SPANS.items()) + " FROM m")


def _mixed(bars):
    """Signals of two labellings, of which one has no price barriers."""
    return _signals(bars).withColumn("labeling_method", F.when(F.col("signal_id") % 3 == 0, "trend_scanning").otherwise("triple_barrier"))


def _performance(t, start=None, end=None):
    """Of the signals in a range of time, on the bars from the first of them to the last time barrier."""
    b = six_hours(t)
    s = src.in_range(_mixed(b), start, end, "timestamp")
    return sim.simulate(s, sim.bars_of_signals(s, b), "simple")[1].drop("mode")


def _performance_sql(start, end):
    hit = "g.lab = 'triple_barrier' AND CASE WHEN g.side > 0 THEN {low} ELSE {high} END"
    stop = hit.format(low="x.low <= g.close * (1 - 0.6 * g.side)", high="x.high >= g.close * (1 - 0.6 * g.side)")
    take = hit.format(low="x.high >= g.close * (1 + 0.6 * g.side)", high="x.low <= g.close * (1 + 0.6 * g.side)")
    return f""", sg AS (SELECT symbol, bar_idx AS signal_id, timestamp AS ts, timestamp + 172800000 AS tb, CASE WHEN bar_idx % 2 = 0 THEN 1 ELSE -1 END AS side, bar_idx % 10 / 10.0::DOUBLE + 0.1 AS size, close, CASE WHEN bar_idx % 3 = 0 THEN 'trend_scanning' ELSE 'triple_barrier' END AS lab FROM bars WHERE timestamp BETWEEN {start} AND {end}),
lim AS (SELECT symbol, min(ts) AS lo, max(tb) AS hi FROM sg g GROUP BY symbol), x AS (SELECT bars.symbol, bars.timestamp, bars.low, bars.high, bars.close AS px, row_number() OVER (PARTITION BY bars.symbol ORDER BY bars.timestamp) - 1 AS k FROM bars JOIN lim ON lim.symbol = bars.symbol AND bars.timestamp BETWEEN lo AND hi),
en AS (SELECT g.symbol, g.signal_id, min(x.k) AS enter FROM sg g JOIN x ON x.symbol = g.symbol AND x.timestamp >= g.ts GROUP BY ALL),
ex AS (SELECT g.symbol, g.signal_id, min(x.k) AS leave FROM sg g JOIN en USING (symbol, signal_id) JOIN x ON x.symbol = g.symbol AND x.k >= en.enter AND (x.timestamp >= g.tb OR ({stop}) OR ({take})) GROUP BY ALL),
hd AS (SELECT g.symbol, g.signal_id, g.side, g.size, en.enter, ex.leave FROM sg g JOIN en USING (symbol, signal_id) LEFT JOIN ex USING (symbol, signal_id)),
ep AS (SELECT x.symbol, x.k, x.timestamp, x.px, CASE WHEN count(hd.side) > 0 THEN greatest(-1, least(1, avg(hd.side * hd.size))) ELSE 0.0 END AS e FROM x LEFT JOIN hd ON hd.symbol = x.symbol AND x.k >= hd.enter AND (hd.leave IS NULL OR x.k < hd.leave) GROUP BY ALL),
fa AS (SELECT *, (1 + coalesce(lag(e) OVER o, 0) * coalesce(px / lag(px) OVER o - 1, 0)) * (1 - CASE WHEN abs(e - coalesce(lag(e) OVER o, 0)) > 1e-9 THEN abs(e - coalesce(lag(e) OVER o, 0)) * 0.001 ELSE 0 END) AS f FROM ep WINDOW o AS (PARTITION BY symbol ORDER BY k)),
eq AS (SELECT *, 10000 * exp(sum(CASE WHEN f > 0 THEN ln(f) END) OVER (PARTITION BY symbol ORDER BY k)) AS q FROM fa), dd AS (SELECT *, round(q, 2) AS q2, round(q / greatest(10000, max(q) OVER (PARTITION BY symbol ORDER BY k)) - 1, 6) AS d FROM eq), rt AS (SELECT *, q2 / lag(q2) OVER (PARTITION BY symbol ORDER BY k) - 1 AS rr FROM dd),
st AS (SELECT symbol, CASE WHEN stddev_pop(rr) > 0 THEN avg(rr) / stddev_pop(rr) * sqrt(31557600000.0 / ((max(timestamp) - min(timestamp)) / (count(*) - 1))) ELSE 0 END AS sharpe, min(d) * 100 AS dd, (arg_max(q2, k) - 10000) / 100 AS ret FROM rt GROUP BY symbol),
cl AS (SELECT g.symbol, g.side * (CASE WHEN {stop} THEN g.close * (1 - 0.6 * g.side) WHEN {take} THEN g.close * (1 + 0.6 * g.side) ELSE x.px END - f.px) / f.px AS ret FROM sg g JOIN hd USING (symbol, signal_id) JOIN x ON x.symbol = g.symbol AND x.k = hd.leave JOIN x f ON f.symbol = g.symbol AND f.k = hd.enter), cn AS (SELECT symbol, count(*) AS n, count(*) FILTER (ret > 0) / count(*) * 100 AS won FROM cl GROUP BY symbol)
SELECT st.symbol, {_r("round(sharpe, 2)", "sharpe")}, {_r("round(dd, 2)", "max_dd")}, {_r("round(st.ret, 2)", "total_return")}, {_r("round(coalesce(won, 0), 1)", "win_rate")}, coalesce(n, 0) AS num_trades FROM st LEFT JOIN cn USING (symbol)"""


register("e05_performance", _performance, _performance_sql(0, 9_000_000_000_000))
register("q08_equity_of_range", lambda t: _performance(t, 1_704_500_000_000, 1_705_500_000_000), _performance_sql(1_704_500_000_000, 1_705_500_000_000))


def _both_modes(t):
    """Signals whose price barriers are met, in both modes: (curves, measures)."""
    b = six_hours(t)
    return sim.simulate(_signals(b).withColumn("meta_probability", F.col("signal_id") % 5 / 10.0 + 0.6), b, "both")


_SIMPLE = ORACLES["e02_equity"].rsplit("SELECT symbol, bar_idx", 1)[0]
_BOTH = f"""SELECT 'simple' AS mode, * FROM ({_SIMPLE} SELECT symbol, bar_idx, timestamp, exposure, equity FROM eq)
UNION ALL SELECT 'realistic', * FROM (WITH RECURSIVE {ORACLES["e02_equity"].split(", sg AS", 1)[0][5:]}{_REAL} SELECT wk.symbol, wk.bar_idx, bars.timestamp, st.exposure, wk.equity FROM wk JOIN st USING (symbol, bar_idx) JOIN bars USING (symbol, bar_idx))"""
register("e04_modes", lambda t: _both_modes(t)[0].select("mode", "symbol", "bar_idx", "exposure", "equity"), f"WITH c AS ({_BOTH}) SELECT mode, symbol, bar_idx, {_r('exposure', 'exposure', 4)}, {_r('equity', 'equity', 3)} FROM c", {"exposure": 4, "equity": 3})
register("e04_measures", lambda t: _both_modes(t)[1].select("mode", "symbol", "sharpe", "max_dd", "total_return"), f"""WITH c AS ({_BOTH}), q AS (SELECT *, round(equity, 2) AS q2, round(equity / greatest(10000, max(equity) OVER o) - 1, 6) AS d FROM c WINDOW o AS (PARTITION BY mode, symbol ORDER BY bar_idx)),
rt AS (SELECT *, q2 / lag(q2) OVER (PARTITION BY mode, symbol ORDER BY bar_idx) - 1 AS rr FROM q)
SELECT mode, symbol, {_r("round(CASE WHEN stddev_pop(rr) > 0 THEN avg(rr) / stddev_pop(rr) * sqrt(31557600000.0 / ((max(timestamp) - min(timestamp)) / (count(*) - 1))) ELSE 0 END, 2)", "sharpe")}, {_r("round(min(d) * 100, 2)", "max_dd")}, {_r("round((arg_max(q2, bar_idx) - 10000) / 100, 2)", "total_return")} FROM rt GROUP BY mode, symbol""")


def _averaged_bets(t):
    b = six_hours(t).select("symbol", "bar_idx", F.col("timestamp").alias("time"))
    spans = b.select("symbol", F.col("time").alias("start"), (F.col("time") + F.col("bar_idx") % 5 * 21_600_000).alias("end"))
    return ol.concurrency(b, spans).select("symbol", "bar_idx", "n_open", ol.bet_sizes(F.col("bar_idx") % 11 / 20.0 + 0.5, F.col("n_open")).alias("size"))


_LEVEL = "list_min(list_transform(range(11), lambda i: {d: abs(z - i / 10.0), v: i / 10.0})).v"
register("m08_averaged_bets", _averaged_bets, f", sp AS (SELECT symbol, timestamp AS a, timestamp + bar_idx % 5 * 21600000 AS e FROM bars), op AS (SELECT bars.symbol, bars.bar_idx, greatest(count(sp.a), 1) AS n_open FROM bars LEFT JOIN sp ON sp.symbol = bars.symbol AND bars.timestamp BETWEEN sp.a AND sp.e GROUP BY ALL), z AS (SELECT *, least(greatest(2 * (bar_idx % 11 / 20.0::DOUBLE + 0.5) - 1, 0), 1) / n_open AS z FROM op) SELECT symbol, bar_idx, n_open, {_r(_LEVEL, 'size')} FROM z")

# the fractional difference at the least order, from the parts of f15_least_d
_F15, _F15_END = ORACLES["f15_least_d"].rsplit(" SELECT s.symbol", 1)
_FFD_SQL = f"{_F15}, md AS (SELECT s.symbol{_F15_END}), fd AS (SELECT bars.symbol, bars.bar_idx, md.min_d AS ffd_d, df.v FROM bars JOIN md USING (symbol) LEFT JOIN df ON df.symbol = bars.symbol AND df.bar_idx = bars.bar_idx AND abs(df.o - md.min_d) < 1e-9), fv AS (SELECT *, v - lag(v) {_O} AS v1 FROM fd) SELECT symbol, bar_idx, {_r('v', 'ffd_close')}, ffd_d, {_r('v1', 'price_velocity')}, {_r(f'v1 - lag(v1) {_O}', 'price_acceleration')} FROM fv"
register("f16_differenced", lambda t: table.differenced(six_hours(t)), _FFD_SQL)


def _feature_table(t):
    """All features; the values whose last digits the summation's order decides are set to null or scaled as in their own queries."""
    b = six_hours(t)
    f = table.all_features(b, in_bars(t, b))
    spread = F.col("spread_variance") > 1e-9
    f = f.withColumn("duration_variance", F.col("duration_variance") / 1e12).withColumn("spread_skew", F.when(spread, F.col("spread_skew"))).withColumn("spread_kurtosis", F.when(spread, F.col("spread_kurtosis")))
    return f.select("symbol", "bar_idx", *table.names(True))


_FLOW = f", im AS (SELECT symbol, time, id, sum(CASE WHEN is_buyer_maker THEN qty ELSE -qty END) OVER w / sum(qty) OVER w AS x, avg(CASE WHEN is_buyer_maker THEN -1.0 ELSE 1.0 END) OVER w AS y FROM tape WINDOW w AS (PARTITION BY symbol ORDER BY time, id ROWS 19 PRECEDING)), k AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY time // 21600000) - 1 AS bar_idx, arg_max(x, (time, id)) AS x, arg_max(y, (time, id)) AS y FROM im GROUP BY symbol, time // 21600000) SELECT bars.symbol, bars.bar_idx, {_r('bars.dollar_volume', 'dollar_volume')}, bars.duration_us, {_r('k.x', 'order_book_imbalance', 9)}, {_r('k.y', 'trade_flow_imbalance', 9)} FROM bars LEFT JOIN k USING (symbol, bar_idx)"
_PARTS = ("f16_differenced", "f10_returns", "f25_entropies", "f27_lempel_ziv", "f28_rolling_kontoyiannis", "f19_recursive_cusum", "f20_breaks", "f21_unit_root_frames", "f34_encoded_entropies", *_SQL, "f06_vol_velocity", "f06_vol_acceleration", "f07_volume_and_duration", "f39_spreads", "f43_spread_moments", "f43_spread_shape", "f44_calendar")
#: Digits that the parts' own queries keep, where they are not 6.
_DIGITS = {
    **{n.split("_", 1)[1]: 5 for n in _SQL}, **{c: 5 for c in ("bde_cusum", "chow_type_df", "rolling_sadf", "volume_variance", "volume_skew", "spread_skew")}, "spread_skew": 4, "spread_kurtosis": 4, "order_book_imbalance": 9, "trade_flow_imbalance": 9,
    **{c: 4 for c in ("log_dollar_volume", "log_duration", "volume_velocity", "volume_acceleration", "duration_velocity", "duration_acceleration", "volume_kurtosis", "duration_variance", "duration_skew", "duration_kurtosis", "log_price_skew", "log_price_kurtosis")},
}


_RENAME = ", ".join(f"{a} AS {b}" for a, b in table.NAMES.items())
# each part is worked out by itself: as one query their joins take the optimiser very long
_EACH = ", ".join(f"p{i} AS MATERIALIZED ({ORACLES[n]})" for i, n in enumerate(_PARTS, 1))
_JOINED = " ".join(f"LEFT JOIN p{i} USING (symbol, bar_idx)" for i in range(1, len(_PARTS) + 1))
register("u03_all_features", _feature_table, f"WITH p0 AS MATERIALIZED ({_CTE + _FLOW}), {_EACH} SELECT * RENAME ({_RENAME}) FROM p0 {_JOINED}", _DIGITS)


def _labelled(t):
    b = ur.decayed_volatility(six_hours(t))
    return b, _barriers(b)


def _barriers(b):
    return ol.triple_barrier(b if "vol" in b.columns else ur.decayed_volatility(b), hold=10, stop=0.5, take=2.0)


def _trained(t):
    """Signals of models trained on the whole tape, with all features."""
    b, labels = _labelled(t)
    return learning.signals(learning.train(b, labels, table.names(), hold=10), b, averaged=True)


def _walked(t):
    span = t.agg(F.min("time").alias("start"), F.max("time").alias("end")).where("start is not null")
    hours = lambda rows: ob.time_bars(rows, "1h")
    measured = learning.walk_forward(t, wf.boundaries(span, 14, 5, 5), hours, _barriers, table.names(), hold=10)
    return wf.bootstrap(measured.withColumn("run", F.lit("tape")))


register("m05_trained_signals", _trained)
register("m14_walk_forward", _walked)
