"""Jobs, listings and streams of fills and time bars, against the batch operators."""

import os

import pytest
from pyspark.sql import functions as F

from barloom import jobs
from barloom.operators import bars as ob
from barloom.operators import learning, orders
from barloom.sources import store
from barloom.sources import trades as st
from barloom.streaming.bars import stream_time_bars
from barloom.streaming.fills import stream_fills

SF = "/root/testdata/sf0.001"


def in_parts(spark, df, path, order, n=3):
    """df as a stream of n files in the order of a column."""
    cuts = df.approxQuantile(order, [k / n for k in range(1, n)], 0.0)
    for k in range(n):
        low, high = F.lit(True) if k == 0 else F.col(order) > cuts[k - 1], F.lit(True) if k == n - 1 else F.col(order) <= cuts[k]
        df.where(low & high).coalesce(1).write.parquet(f"{path}/{k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)


def drained(frame, path):
    query = frame.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(f"{path}/o")
    query.awaitTermination(200)
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/o")


def test_files_by_folder_and_day(spark, tmp_path):
    for folder, kind, day in (("trades_data", "trades", "2024-01-03"), ("tick_data", "aggTrades", "2024-01-02"), ("tick_data", "aggTrades", "2024-01-01")):
        os.makedirs(d := f"{tmp_path}/{folder}/futures_um/AB", exist_ok=True)
        rest = "3,3,1704067200000,true" if kind == "aggTrades" else "6.0,1704240000000,true"
        with open(f"{d}/AB-{kind}-{day}.csv", "w") as f:
            f.write(f"1,2.0,3.0,{rest}\n")
    names = [(p.rsplit("/", 1)[-1], k) for p, k in st.trade_files(spark, str(tmp_path), "AB")]
    assert names == [("AB-aggTrades-2024-01-01.csv", "aggTrades"), ("AB-aggTrades-2024-01-02.csv", "aggTrades"), ("AB-trades-2024-01-03.csv", "trades")]
    assert len(st.trade_files(spark, str(tmp_path), "AB", start_ms=1704240000000)) == 2 and st.trade_files(spark, str(tmp_path), "none") == []
    assert st.read_symbol(spark, str(tmp_path), "AB").count() == 3 and st.read_symbol(spark, str(tmp_path), "none").count() == 0


def test_streamed_time_bars(spark, tmp_path):
    tape = st.tape(spark, SF)
    # the watermark is one for all symbols, so it closes what each symbol alone would leave open
    last = tape.agg(F.max("time")).first()[0] // 21_600_000
    stream = in_parts(spark, tape, f"{tmp_path}/in", "time")
    got = drained(stream_time_bars(stream, "6h"), str(tmp_path))
    want = ob.ohlcv(tape.withColumn("win", F.floor(F.col("time") / 21_600_000)).where(F.col("win") < last), "symbol", "win").drop("win")
    exact = [c for c in want.columns if c not in ("volume", "dollar_volume")]
    assert got.count() == want.count() > 100 and got.select(exact).exceptAll(want.select(exact)).count() == 0


def test_streamed_fills(spark, tmp_path):
    tape = st.tape(spark, SF)
    hour = 6 * 3_600_000
    placed = tape.where("id % 3 = 0").select("symbol", F.col("id").alias("signal_id"), F.col("time").alias("submitted"), F.when(F.col("id") % 2 == 0, 1).otherwise(-1).alias("side"), F.lit(0.5).alias("size"), (F.col("price") * F.when(F.col("id") % 4 < 2, 0.999).otherwise(1.0)).alias("limit_price"), (F.col("id") % 5 / 10.0).alias("queue_ahead"))
    events = placed.select("submitted", F.struct("*").alias("o"), F.lit(None).cast("struct<symbol:string,time:long,id:long,price:double,qty:double,is_buyer_maker:boolean>").alias("t"))
    events = events.unionByName(tape.select(F.col("time").alias("submitted"), F.lit(None).cast(events.schema["o"].dataType).alias("o"), F.struct("symbol", "time", "id", "price", "qty", "is_buyer_maker").alias("t")))
    stream = in_parts(spark, events, f"{tmp_path}/in", "submitted")
    # both sides read one stream, so a micro-batch holds the orders and the trades of one span
    got = drained(stream_fills(stream.where("o is not null").select("o.*"), stream.where("t is not null").select("t.*"), hour), str(tmp_path))
    want = orders.fills(placed, tape, hour).where("status <> 'open'").select(got.columns)
    assert want.count() > 100 and got.count() == want.count() and got.exceptAll(want).count() == 0
    assert {r.status for r in got.select("status").distinct().collect()} == {"filled", "expired"}


def test_jobs(spark, tmp_path):
    names, small = ["returns_variance", "log_dollar_volume"], {"maxIter": 2, "maxDepth": 2, "minInstancesPerNode": 5}
    tape = st.tape(spark, SF.replace("0.001", "0.01"))
    out = f"file://{tmp_path}"
    got = jobs.train_all(tape, out, None, ["time"], ["trend_scanning", "directional_change"], names=names, params=small, interval="6h")
    assert [r["labeling_method"] for r in got] == ["trend_scanning", "directional_change"] and got[0]["status"] == "ok" and os.path.isdir(f"{tmp_path}/time_trend_scanning/primary")
    assert spark.read.text(f"{out}/training_results").count() == 2


def test_walk_forward_job_fills_the_tables(spark, tmp_path):
    """The whole job on one symbol's trades: windows, models, simulations, the stitched curve and both tables."""
    tape, out = st.tape(spark, SF.replace("0.001", "0.1")).where("symbol = 'click'"), f"file://{tmp_path}"
    small = {"maxIter": 3, "maxDepth": 2, "minInstancesPerNode": 5}
    options = {"names": ["returns_variance", "log_dollar_volume", "amihud_lambda"], "bar_parameters": {"interval": "1h"}, "params": small, "meta_params": small, "folds": 3}
    assert jobs.walk_forward(tape, "click", out, "time", "trend_scanning", 10, 4, 4, **options) == 1
    run = store.run(spark, out, 1).first()
    assert run.num_windows == len(run.windows) >= 3 and [w.window_index for w in run.windows] == list(range(run.num_windows))
    first = run.windows[0]
    assert first.test_start == first.train_end and run.windows[1].test_start == first.test_start + 4 * jobs.DAY_MS
    assert all(0 <= w.oos_accuracy <= 1 and w.num_trades <= w.num_test_signals for w in run.windows)
    mean = sum(w.oos_accuracy for w in run.windows) / run.num_windows
    assert run.avg_oos_accuracy == pytest.approx(mean, abs=1e-4) == pytest.approx(run.aggregate_stats["oos_accuracy"].mean, abs=1e-4)
    # each window's own curve starts with the capital, the stitched one goes on where the window before ended
    traded = [w for w in run.windows if w.equity]
    assert traded and sum(len(w.equity) for w in traded) == len(run.stitched_equity) == len(run.stitched_timestamps) == len(run.stitched_drawdown)
    assert run.stitched_timestamps == sorted(run.stitched_timestamps) and max(run.stitched_drawdown) <= 0
    growth = 1.0
    for w in traded:
        growth *= w.equity[-1] / w.equity[0]
    assert run.stitched_equity[-1] / run.stitched_equity[0] == pytest.approx(growth, rel=1e-3)
