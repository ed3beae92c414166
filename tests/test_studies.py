import math

import numpy as np
import pytest

from barloom.functions import encodings as en
from barloom.functions import unit_root as ur
from barloom.operators import labels as ol
from barloom.operators import learning, orders, tuning
from barloom.operators import walk_forward as wf
from barloom.sources import store
from barloom.streaming import signals as live


def bars(spark, n=120, seed=1, symbol="A"):
    rng = np.random.default_rng(seed)
    close = 50 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    rows = [(symbol, i, 1_700_000_000_000 + 60_000 * i, float(c), float(c * 1.01), float(c * 0.99), float(c), 100.0, 100.0 * float(c), 10, 50_000_000) for i, c in enumerate(close)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double, dollar_volume double, tick_count long, duration_us long"), close


def dickey_fuller(y):
    d = np.diff(y)
    x = np.column_stack([np.ones(len(d) - 1), y[1:-1], d[:-1]])
    b, rest, _, _ = np.linalg.lstsq(x, d[1:], rcond=None)
    e = d[1:] - x @ b
    s2 = e @ e / (len(e) - 3)
    return b[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1])


def test_suprema_equal_all_regressions(spark):
    b, close = bars(spark, 70)
    y = np.log(close)
    assert ur.sadf(b).first().sadf == pytest.approx(max(dickey_fuller(y[:m]) for m in range(20, 71)), abs=1e-6)
    every = max(dickey_fuller(y[s:e]) for e in range(20, 71) for s in range(max(0, e - 40), e - 19))
    assert ur.gsadf(b, most=40).first().gsadf == pytest.approx(every, abs=1e-6)
    last = {r.bar_idx: r for r in ur.unit_root(b).collect()}
    assert last[49].rolling_sadf is None
    frame = y[15:65]
    assert last[65].chow_type_df == pytest.approx(max(dickey_fuller(frame[:25]), dickey_fuller(frame[25:])), abs=1e-6)
    assert last[65].rolling_sadf == pytest.approx(max(dickey_fuller(frame[:m]) for m in range(16, 51)), abs=1e-6)


def test_short_series_have_no_suprema(spark):
    b, _ = bars(spark, 10)
    assert ur.sadf(b).first().sadf is None and ur.gsadf(b).first().gsadf is None and ur.chow(b, part=0.1).first().chow_f == 0.0
    assert ur.least_d(b).first().min_d == 1.0
    assert ur.critical_t() == pytest.approx(-2.8615, abs=1e-3)


def test_recursive_cusum(spark):
    b, close = bars(spark, 60)
    y, t = np.log(close)[5:55], np.arange(50.0)
    e = np.array([y[k] - np.polyval(np.polyfit(t[:k], y[:k], 1), k) for k in range(12, 50)])
    got = {r.bar_idx: r.v for r in b.selectExpr("*", "ln(close) AS x").select("symbol", "bar_idx", ur.recursive_cusum("x").alias("v")).collect()}
    assert got[49] is None and got[55] == pytest.approx(np.abs(np.cumsum(e / e.std())).max() / math.sqrt(38), rel=1e-6)


def test_decayed_volatility_equals_pandas(spark):
    import pandas as pd

    b, close = bars(spark, 60)
    want = np.log(pd.Series(close)).diff().ewm(span=20, min_periods=10).std().ffill().bfill()
    got = [r.vol for r in ur.decayed_volatility(b).orderBy("bar_idx").collect()]
    assert got == pytest.approx(want.tolist(), rel=1e-9)


def test_match_entropy_and_codes(spark):
    v = [0.1, -0.2, 0.1, -0.2, 0.1, -0.2, 0.3, 0.3]
    r = spark.createDataFrame([(v,), ([1.0] * 6,), ([],)], "v array<double>").select(*(f(en.F.col("v")).alias(k) for k, f in en.ENCODERS.items())).collect()
    assert r[0].binary == [1, 0, 1, 0, 1, 0, 1, 1] and r[1].quantile == [0] * 6 and r[1].sigma == [0] * 6 and r[2].binary == []
    m = spark.createDataFrame([([1, 0, 1, 0, 1, 0, 1, 1],)], "c array<int>").select(en.match_entropy(en.F.col("c"), 4).alias("h"), en.shannon(en.F.col("c")).alias("s")).first()
    text, runs = "10101011", []
    for i in range(4, 8):
        runs.append(1 + max([k for k in range(1, min(8 - i, 4) + 1) if text[i : i + k] in text[i - 4 : i]], default=0))
    assert m.h == pytest.approx(2 / np.mean(runs)) and m.s == pytest.approx(-(5 / 8 * math.log(5 / 8) + 3 / 8 * math.log(3 / 8)))


def test_windows_and_stitching(spark):
    day = wf.DAY_MS
    w = wf.boundaries(spark.createDataFrame([(0, 100 * day), (0, 10)], "start long, end long"), 30, 20, 25).orderBy("window").collect()
    assert [(x.train_start, x.test_start, x.test_end) for x in w] == [(0, 30 * day, 50 * day), (25 * day, 55 * day, 75 * day), (50 * day, 80 * day, 100 * day)]
    c = spark.createDataFrame([("r", 0, 1, 100.0), ("r", 0, 2, 110.0), ("r", 1, 3, 50.0), ("r", 1, 4, 40.0)], "run string, window int, timestamp long, equity double")
    assert [(x.equity, x.drawdown) for x in wf.stitched(c, 1000.0).orderBy("timestamp").collect()] == [(1000.0, 0.0), (1100.0, 0.0), (1100.0, 0.0), (880.0, -0.2)]
    b = wf.bootstrap(spark.createDataFrame([("r", i, "m", float(i)) for i in range(5)] + [("r", 0, "one", 3.0)], "run string, window int, metric string, value double")).orderBy("metric").collect()
    assert b[0].mean == 2.0 and b[0].ci_lower < 1.5 < 2.5 < b[0].ci_upper and b[1].std == 0.0 and b[1].ci_lower == 3.0


def test_fills(spark):
    orders_ = spark.createDataFrame([("A", 1, 0, 1, 1.0, 10.0, 2.0), ("A", 2, 0, -1, 1.0, 12.0, 0.0), ("A", 3, 0, 1, 1.0, 5.0, 1.0), ("B", 4, 0, 1, 1.0, 5.0, 1.0)], "symbol string, signal_id long, submitted long, side int, size double, limit_price double, queue_ahead double")
    trades = spark.createDataFrame([(1, "A", 10, 10.0, 1.5, True), (2, "A", 20, 10.0, 9.0, False), (3, "A", 30, 10.0, 0.5, True), (4, "A", 150, 13.0, 1.0, False), (5, "A", 160, 4.0, 1.0, True)], "id long, symbol string, time long, price double, qty double, is_buyer_maker boolean")
    r = {x.signal_id: (x.status, x.fill_time) for x in orders.fills(orders_, trades, 100).collect()}
    # 1 by its queue; 2 by the first trade after the time-out, through its price; 3 expires before one comes through; 4 has no trades
    assert r == {1: ("filled", 30), 2: ("filled", 150), 3: ("expired", None), 4: ("open", None)}


def test_store(spark, tmp_path):
    root, day = f"file://{tmp_path}", 24 * store.HOUR
    assert store.read(spark, root, "bars").count() == 0
    rows = spark.createDataFrame([("A", "time", i * day, 1.0, "extra") for i in range(10)], "symbol string, bar_type string, timestamp long, close double, note string")
    store.append(rows, root, "bars", 0)
    store.append(rows, root, "bars", 0)
    all_rows = store.read(spark, root, "bars")
    assert all_rows.count() == 10 and [r.timestamp // day for r in store.newest(all_rows, 3, end_ms=7 * day, symbol="A", bar_type=None).collect()] == [7, 6, 5]
    assert store.kept(all_rows, "bars", 9 * day).count() == 8
    one = spark.createDataFrame([("A", "time", "triple_barrier", 2)], "symbol string, bar_type string, labeling_method string, num_windows int")
    parts = spark.createDataFrame([(1, 0.5), (0, 0.4)], "window_index int, oos_accuracy double")
    assert [store.save_run(one, parts, root) for _ in range(2)] == [1, 2]
    assert [w.window_index for w in store.run(spark, root, 2).first().windows] == [0, 1] and store.run(spark, root, 9).count() == 0
    assert store.latest(spark, root, "A", "time", "triple_barrier").first().id == 2 and store.runs(spark, root, symbol="B").count() == 0


def test_retention_deletes(spark, tmp_path):
    root, hour = f"file://{tmp_path}", store.HOUR
    rows = spark.createDataFrame([(s, "time", i * 6 * hour, float(i)) for s in "AB" for i in range(80)], "symbol string, bar_type string, timestamp long, close double")
    for k in range(2):
        store.append(rows.where(f"close % 2 = {k}"), root, "bars", k)
    store.append(spark.createDataFrame([(1, "A", 5 * hour), (2, "A", 100 * hour)], "id long, symbol string, time long"), root, "ticks")
    now = 70 * 6 * hour
    want = sorted(map(tuple, store.kept(store.read(spark, root, "bars"), "bars", now).collect()))
    files = lambda: {str(p) for p in tmp_path.rglob("*.parquet")}
    before = files()
    done = store.prune(spark, root, now)
    # 70 quarter days less 28 are day 10, half of which stays
    assert done["bars"] == (20, 2) and done["ticks"] == (2, 0) and done["signals"] == (0, 0)
    assert sorted(map(tuple, store.read(spark, root, "bars").collect())) == want and len(want) == 76
    assert not any("day=1970-01-0" in f and "ticks" not in f for f in files()) and len(files()) < len(before)
    assert store.read(spark, root, "ticks").count() == 0
    left = files()
    assert store.prune(spark, root, now)["bars"] == (0, 0) and files() == left
    # a run that was stopped between its two renames left the old rows aside
    day = next(p for p in tmp_path.glob("bars/batch=0/day=*"))
    day.rename(day.parent / f".old-{day.name[4:]}")
    assert store.prune(spark, root, now)["bars"] == (0, 0) and sorted(map(tuple, store.read(spark, root, "bars").collect())) == want


def test_models_learn_save_and_score_a_stream(spark, tmp_path):
    b, _ = bars(spark, 300)
    names = ("realized_volatility", "returns_variance")
    labels = ol.triple_barrier(ur.decayed_volatility(b), hold=10, stop=1.0, take=1.0)
    small = {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 5}
    models = learning.train(b, labels, names, hold=10, folds=2, params=small)
    assert 0 <= models["metrics"]["out_of_sample"]["accuracy"] <= 1
    with pytest.raises(ValueError):
        learning.train(b.limit(5), labels, names)
    learning.save(models, f"{tmp_path}/m")
    again = learning.load(f"{tmp_path}/m")
    assert again["features"] == list(names) and again["params"]["maxIter"] == 2 and learning.missing(again, b) == list(names)
    learning.save(models, f"{tmp_path}/all/time_triple_barrier")
    assert list(learning.registry(f"{tmp_path}/all", ("time", "tick"), ("triple_barrier", "trend_scanning"))) == [("time", "triple_barrier")]
    shares = learning.importance(again["primary"])
    assert {n for n, _ in shares} == set(names) and sum(v for _, v in shares) == pytest.approx(1.0)
    known = learning.signals(again, ur.decayed_volatility(b), least_meta=0.0, least_size=0.0)
    assert known.count() > 200 and known.where("size < 0 or size > 1").count() == 0
    for k in range(2):
        b.where(f"bar_idx div 150 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    live.score_stream(stream, again, f"file://{tmp_path}/t", "time", "triple_barrier", least_meta=0.0, least_size=0.0).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(120)
    assert store.read(spark, f"file://{tmp_path}/t", "bars").count() == 300 and 0 < store.read(spark, f"file://{tmp_path}/t", "signals").count() <= 200


def test_training_tries_parameters(spark):
    b, _ = bars(spark, 260)
    names = ("realized_volatility", "returns_variance")
    labels = ol.triple_barrier(ur.decayed_volatility(b), hold=10, stop=1.0, take=1.0)
    space = {"maxIter": tuning.Parameter("int", 1, 2), "maxDepth": tuning.Parameter("int", 1, 2)}
    m = learning.matrix(b, labels, names)
    tried = learning.tune(m, names, trials=2, folds=2, hold=10, measure="log_loss", space=space)
    assert tried.keys() == space.keys() and tried["maxIter"] in (1, 2)
    asked = []
    before, learning.tune = learning.tune, lambda *a, **k: asked.append(k) or {"maxIter": 1, "maxDepth": 1}
    try:
        models = learning.train(b, labels, names, hold=10, folds=2, trials=5)
    finally:
        learning.tune = before
    assert asked and models["params"]["maxIter"] == 1 and len(models["primary"].forest.trees) == 1
