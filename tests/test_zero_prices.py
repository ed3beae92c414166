"""Trades at price 0, which the larger event tables have: queries give the rows of their SQL there."""

import datetime
import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from barloom.functions import features as ft
from barloom.functions import frames as fr
from barloom.functions import unit_root as ur
from barloom.operators import bars as ob
from barloom.operators import labels as ol
from barloom.operators import learning, orders
from barloom.operators import simulation as sim
from barloom.operators import walk_forward as wf
from barloom.plans import catalog


@pytest.fixture(scope="module")
def zeros(tmp_path_factory):
    """Events of two symbols, some at price 0: the lowest of a window, its first and its only ones."""
    rng, start = np.random.default_rng(7), datetime.datetime(2024, 1, 1)
    prices = np.round(rng.exponential(40, (2, 30, 6)) + 0.01, 2)
    prices[0, 4, 2] = prices[0, 9, 0] = prices[1, 20, 3] = 0.0
    prices[1, 6, :5] = 0.0
    rows = [(s, start + datetime.timedelta(hours=6 * bar, minutes=20 * k + s), 7 * k + bar, "ab"[s], float(prices[s, bar, k]), int(rng.integers(1, 9))) for s in range(2) for bar in range(30) for k in range(6)]
    folder = tmp_path_factory.mktemp("zeros")
    with duckdb.connect() as c:
        c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        c.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", [(i, ts, user, symbol, price, f'{{"k": {k}}}') for i, (_, ts, user, symbol, price, k) in enumerate(rows)])
        c.execute(f"COPY e TO '{folder}/events.parquet' (FORMAT parquet)")
    return str(folder)


def both(spark, folder, name):
    """The rows of a query and of its SQL, in one order, with NaN as a word."""
    found = __spark_entry__.queries()[name](spark, folder)
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW events AS SELECT * FROM '{folder}/events.parquet'")
        made = c.execute(__spark_entry__.oracle_sql()[name])
        columns, wanted = [d[0] for d in made.description], made.fetchall()
    named = lambda rows: sorted((tuple("NaN" if isinstance(v, float) and math.isnan(v) else v for v in r) for r in rows), key=lambda r: [str(v) for v in r])
    return named(found.select(*columns).collect()), named(wanted)


def infinite(rows):
    return any(v in ("NaN", math.inf, -math.inf) for r in rows for v in r)


def test_garman_klass(spark, zeros):
    found, wanted = both(spark, zeros, "f02_garman_klass_vol")
    assert infinite(wanted) and found == wanted


def test_spreads(spark, zeros):
    found, wanted = both(spark, zeros, "f39_spreads")
    assert infinite(wanted) and found == wanted


@pytest.mark.parametrize("name", ["f01_rogers_satchell_vol", "f03_yang_zhang_vol", "f06_vol_velocity", "f06_vol_acceleration"])
def test_drift(spark, zeros, name):
    found, wanted = both(spark, zeros, name)
    assert infinite(wanted) and found == wanted


def test_feature_table(spark, zeros):
    found, wanted = both(spark, zeros, "u03_all_features")
    assert infinite(wanted) and found == wanted


def test_mean_spread(spark, zeros):
    found, wanted = both(spark, zeros, "e12_bbo_stats")
    assert infinite(wanted) and found == wanted


def test_costs(spark, zeros):
    found, wanted = both(spark, zeros, "e06_transaction_costs")
    assert infinite(wanted) and found == wanted


def test_costs_of_any_price(spark, tmp_path):
    """Prices of many sizes and with all digits, below 0 as quantities are, missing ones, a negative 0, NaN and infinity."""
    rng = np.random.default_rng(6)
    prices = [None, math.nan, math.inf, -0.0, 0.0, 5e-324, 1e-300, 1e155, 1e300, -1e300, -math.inf, *(np.exp(rng.uniform(-10, 20, 3000)) * np.where(np.arange(3000) % 7, 1, -1)).tolist()]
    rows = [(i, datetime.datetime(2024, 1, 1), None if i % 97 == 0 else int(rng.integers(0, 9)), "a", p, "{}" if i % 101 == 13 else f'{{"k": {int(np.exp(rng.uniform(0, 12))) * (1 if i % 5 else -1)}}}') for i, p in enumerate(prices)]
    with duckdb.connect() as c:
        c.execute("CREATE TABLE e (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
        c.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?)", rows)
        c.execute(f"COPY e TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    found, wanted = both(spark, tmp_path, "e06_transaction_costs")
    assert infinite(wanted) and any(r.count(None) > 6 for r in wanted) and found == wanted


def test_rounding_is_that_of_sql(spark):
    rng = np.random.default_rng(3)
    values = [*(rng.exponential(3000, 4000) - 1500).tolist(), 0.5, -0.5, 1.5, -2.5, 2.675, 1e300, -1e308, math.inf, -math.inf, math.nan, None, 24.696082263545]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")
    for digits in (0, 2, 11):
        found = [r.x for r in catalog._rounded(frame, digits).orderBy("id").collect()]
        with duckdb.connect() as c:
            wanted = c.execute("SELECT list_transform(?::DOUBLE[], lambda x: round(x, ?) + 0.0)", [values, digits]).fetchone()[0]
        assert [repr(v) for v in found] == [repr(v) for v in wanted]


def test_code_of_a_wide_rounded_table_is_compiled(spark):
    """As many columns as the feature table has, in a session that does not fall back to interpreted rows."""
    wide = spark.range(8).select(*((F.col("id") / (3.0 + k)).alias(f"c{k}") for k in range(80)))
    wide = wide.where("c0 is not null")
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        found = catalog._rounded(wide).collect()
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
    assert len(found) == 8 and all(r[k] == round(i / (3 + k), 6) for i, r in enumerate(sorted(found)) for k in range(80))


def test_exposure_and_equity_to_the_last_digit(spark):
    """A position that has left leaves no rounding error behind, and the fold is the SQL's formula."""
    held = [("a", 0, 1, 0.1, 0, None), ("a", 1, 1, 0.2, 1, 3), ("a", 2, -1, 0.7, 2, 4), ("a", 3, 1, 0.3, 2, 5)]
    held = spark.createDataFrame(held, "symbol string, signal_id long, side int, size double, enter long, leave long")
    closes = np.random.default_rng(5).exponential(40, 40) + 1
    bars = spark.createDataFrame([("a", i, 1000 * i, float(c)) for i, c in enumerate(closes)], "symbol string, bar_idx long, timestamp long, close double")
    exposed = sim.exposure(held, bars)
    wanted = [0.1, 0.3 / 2, -0.1 / 4, -0.3 / 3, 0.4 / 2, *[0.1] * 35]
    assert [r.exposure for r in exposed.orderBy("bar_idx").collect()] == wanted
    curve = orders.realistic_equity(exposed, spark.createDataFrame([("a", 3, 0.25)], "symbol string, bar_idx long, funding double"))
    equity, before, last, due = 10_000.0, 0.0, closes[0], {3: 0.25}
    for r, close, level in zip(curve.orderBy("bar_idx").collect(), closes, wanted):
        equity = (equity - due.get(r.bar_idx, 0.0)) * (1 + before * (close / last - 1))
        notional = abs(level - before) * abs(equity)
        equity -= notional * (3e-4 + 0.022 * math.sqrt(notional / 1e9)) if notional else 0.0
        before, last = level, close
        assert r.equity == equity


SMALL = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 5}
#: Features that are infinite or NaN where a bar's low is 0.
TOUCHED = ("garman_klass_vol", "corwin_schultz_spread", "yang_zhang_vol", "vol_velocity")


def test_models_learn_from_bars_with_a_low_of_0(spark, tmp_path):
    closes = 50 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 260)))
    rows = [("A", i, 60_000 * i, float(c), float(c * 1.01), 0.0 if i in (70, 150) else float(c * 0.99), float(c), 100.0, 100.0 * float(c), 10, 50_000_000) for i, c in enumerate(closes)]
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, tick_count long, duration_us long")
    labels = ol.triple_barrier(ur.decayed_volatility(b), hold=10, stop=1.0, take=1.0)
    learning.save(learning.train(b, labels, TOUCHED, hold=10, folds=2, params=SMALL), f"{tmp_path}/m")
    found = learning.signals(learning.load(f"{tmp_path}/m"), ur.decayed_volatility(b), least_meta=0.0, least_size=0.0).collect()
    assert len(found) > 200 and all(0 <= r.meta_probability <= 1 and 0 <= r.size <= 1 for r in found)


def test_windows_with_a_price_of_0_are_measured(spark):
    rng, hour = np.random.default_rng(2), 3_600_000
    prices = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, 24 * 40)))
    prices[[24 * 12 + 2, 24 * 27 + 2]] = 0.0
    tape = spark.createDataFrame([(i, "A", float(p), 1.0, float(p), i * hour + 1000, i % 2 == 0) for i, p in enumerate(prices)], "id long, symbol string, price double, qty double, quote_qty double, time long, is_buyer_maker boolean")
    span = tape.agg(F.min("time").alias("start"), F.max("time").alias("end"))
    barred = lambda b: ol.triple_barrier(ur.decayed_volatility(b), hold=10, stop=0.5, take=0.5)
    measured = learning.walk_forward(tape, wf.boundaries(span, 18, 9, 5), lambda t: ob.time_bars(t, "6h"), barred, TOUCHED, hold=10, folds=2, params=SMALL, meta_params=SMALL, least=(10, 5)).collect()
    assert len({r.window for r in measured}) >= 3 and all(math.isfinite(r.value) for r in measured)


def bars_with_lows(spark, zero):
    """260 bars of one symbol, with a low of 0 where zero(i)."""
    closes = 50 * np.exp(np.cumsum(np.random.default_rng(1).normal(0, 0.01, 260)))
    rows = [("A", i, 60_000 * i, float(c), float(c * 1.01), 0.0 if zero(i) else float(c * 0.99), float(c), 100.0, 100.0 * float(c), 10, 50_000_000) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, tick_count long, duration_us long")


def test_models_learn_where_every_window_has_a_low_of_0(spark):
    b = bars_with_lows(spark, lambda i: i % 5 < 3)
    labels = ol.triple_barrier(ur.decayed_volatility(b).withColumn("low", F.col("close") * 0.99), hold=10, stop=1.0, take=1.0)
    models = learning.train(b, labels, TOUCHED, hold=10, folds=2, params=SMALL)
    found = learning.signals(models, ur.decayed_volatility(b), least_meta=0.0, least_size=0.0).collect()
    assert len(found) > 200 and all(0 <= r.meta_probability <= 1 and 0 <= r.size <= 1 for r in found)


def test_ranges_of_models_leave_out_prices_of_0(spark):
    """As rolling means of pandas do, which skip what is infinite; a window without a term has no value."""
    rng = np.random.default_rng(4)
    o, c = rng.exponential(40, (2, 90)) + 1
    h, low = np.maximum(o, c) + rng.exponential(5, 90), np.minimum(o, c) * rng.random(90)
    low[np.r_[rng.choice(40, 25, False), 45:70]] = 0.0
    o[12] = c[30] = low[12] = low[30] = 0.0
    b = spark.createDataFrame([("A", i, 1000 * i, *map(float, x), 1.0, 1.0) for i, x in enumerate(zip(o, h, low, c))], "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double")
    found = [list(r) for r in ft.features(b, 20, ft.RANGES, known=True).join(fr.spreads(b, known=True), ["symbol", "bar_idx"]).orderBy("bar_idx").select(*ft.RANGES, "corwin_schultz_spread").collect()]
    with np.errstate(all="ignore"):
        log = lambda x: pd.Series(np.log(x)).where(np.isfinite(np.log(x)))
        mean = lambda x: pd.Series(np.where(np.isfinite(x), x, np.nan)).rolling(20, min_periods=1).mean()
        drift = mean(np.log(h / c) * np.log(h / o) + np.log(low / c) * np.log(low / o)).clip(lower=0)
        kman = mean(0.5 * np.log(h / low) ** 2 - (2 * np.log(2) - 1) * np.log(c / o) ** 2).clip(lower=0)
        var = lambda x: log(x).rolling(20, min_periods=1).var()
        k = 0.34 / (1.34 + 21 / 19)
        zhang = var(np.r_[np.nan, o[1:] / c[:-1]]) + k * var(c / o) + (1 - k) * drift
        span = lambda h, low: np.where(low > 0, np.log(h / low) ** 2, 0.0)
        two, q = span(h[1:], low[1:]) + span(h[:-1], low[:-1]), 3 - 2 * np.sqrt(2)
        alpha = (np.sqrt(2 * two) - np.sqrt(two)) / q - np.sqrt(span(np.maximum(h[1:], h[:-1]), np.minimum(low[1:], low[:-1])) / q)
        spread = mean(np.r_[np.nan, np.maximum(2 * (np.exp(alpha) - 1) / (1 + np.exp(alpha)), 0)])
    wanted = np.stack([np.sqrt(drift), np.sqrt(kman), np.sqrt(zhang.clip(lower=0)), spread], 1)
    assert np.isnan(wanted).sum() > 10 and not np.isinf(wanted).any()
    assert np.array(found, float) == pytest.approx(wanted, rel=1e-9, abs=1e-9, nan_ok=True)
