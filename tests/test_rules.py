"""Ten bar types in one stream, their buffers, and the pool of open signals, against the batch operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.functions import table
from barloom.functions.unit_root import decayed_volatility
from barloom.operators import bars as ob
from barloom.operators import boosting, learning
from barloom.operators import simulation as sim
from barloom.sources import store as tables
from barloom.sources import trades as st
from barloom.streaming import rules
from barloom.streaming import signals as live
from tests.test_jobs import in_parts

SF = "/root/testdata/sf0.001"
RULES = {"time": {"interval": "6h"}, "tick": {"ticks": 7}, "volume": {"threshold": 5.0}, "dollar": {"threshold": 300.0}, **{k: {"first": 8, "span": 5} for k in ob.BARS if "_" in k}}


@pytest.fixture
def store(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, rules.STORE)
    yield
    spark.conf.set(key, before)


def ran(frame, path, batches=None):
    """What a stream has written; batches: micro-batches of this run, all if none."""
    w = frame.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").option("path", f"{path}/o")
    query = w.trigger(availableNow=True).start()
    query.awaitTermination(300)
    return frame.sparkSession.read.schema(frame.schema).parquet(f"{path}/o")


def rounded(df, columns):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*columns).collect())


def test_ten_rules_in_one_stream_after_a_restart(spark, store, tmp_path):
    tape = st.tape(spark, SF)
    path = f"{tmp_path}/in"
    in_parts(spark, tape.where("time < 1705000000000"), f"{path}/a", "time")
    stream = lambda: spark.readStream.schema(tape.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    ran(rules.rule_bars(stream(), RULES), tmp_path)
    # a new query from the checkpoint takes the rest
    in_parts(spark, tape.where("time >= 1705000000000"), f"{path}/b", "time", 2)
    got = ran(rules.rule_bars(stream(), RULES), tmp_path).cache()
    columns = [c.split()[0] for c in ob.SCHEMA.split(", ")]
    for kind, options in RULES.items():
        own = got.where(F.col("bar_type") == kind)
        want = ob.bars(tape, kind, **options)
        assert rounded(own, columns) == rounded(want, columns), kind
    assert got.where("size(recent) <> least(bar_idx + 1, 100) or element_at(recent, -1).timestamp <> timestamp or recent[0].bar_idx <> greatest(bar_idx - 99, 0)").count() == 0
    # features of a bar from its buffer are those of the batch's bars so far
    ticks = got.where("bar_type = 'tick' and size(recent) = bar_idx + 1")
    names = ["realized_volatility", "amihud_lambda", "rolling_shannon_entropy"]
    f = table.all_features(rules.buffered(ticks), only=names)
    last = f.where("timestamp = _timestamp").groupBy("symbol").agg(F.max_by(F.struct("_symbol", "bar_idx", *names), "bar_idx").alias("x")).select("x.*").withColumnRenamed("_symbol", "symbol")
    want = table.all_features(ob.bars(tape, "tick", ticks=7), only=names).join(ticks.select("symbol", "bar_idx"), ["symbol", "bar_idx"], "left_semi").where("bar_idx >= 24")
    assert last.count() > 5 and rounded(last, ["symbol", "bar_idx", *names]) == rounded(want, ["symbol", "bar_idx", *names])


def held(spark):
    b = ob.time_bars(st.tape(spark, SF), "6h").cache()
    k = F.col("bar_idx") % 3
    s = b.where(k < 2).select("symbol", F.col("bar_idx").alias("signal_id"), "timestamp", F.when(k == 0, 1).otherwise(-1).alias("side"), ((F.col("bar_idx") % 7 + 3) / 10.0).alias("size"), F.lit(None).cast("double").alias("sl_price"), F.lit(None).cast("double").alias("pt_price"), (F.col("timestamp") + F.col("bar_idx") % 5 * 21_600_000 + 30_000_000).alias("time_barrier"))
    return b, s


def test_pool_changes_equal_batch(spark, store, tmp_path):
    b, s = held(spark)
    want = live.changes(sim.exposure(sim.positions(s, b), b)).select("symbol", "timestamp", "level")
    events = b.join(s.drop("signal_id"), ["symbol", "timestamp"], "left").select("symbol", F.lit("time").alias("bar_type"), "timestamp", "side", "size", "time_barrier")
    stream = in_parts(spark, events, f"{tmp_path}/in", "timestamp", 4)
    # bars of a symbol come within the delay, so timers only speak up where a symbol has no bars any more
    got = ran(rules.pool_changes(stream, "10 days"), tmp_path)
    assert rounded(got, ["symbol", "timestamp", "level"]) == rounded(want, ["symbol", "timestamp", "level"]) and want.count() > 50


def test_timers_let_signals_go(spark, store, tmp_path):
    rows = [("a", "time", 1_000, 1, 0.8, 5_000), ("b", "time", 1_000, None, None, None), ("b", "time", 4_000, None, None, None), ("b", "time", 20_000, 1, 0.5, 90_000), ("b", "time", 30_000, None, None, None), ("b", "time", 40_000, None, None, None)]
    events = spark.createDataFrame(rows, "symbol string, bar_type string, timestamp long, side int, size double, time_barrier long")
    got = ran(rules.pool_changes(in_parts(spark, events, f"{tmp_path}/in", "timestamp", 4)), tmp_path)
    # a has no bar after its signal: the watermark of b's bars ends it at its time barrier
    assert rounded(got, ["symbol", "timestamp", "level", "num_active"]) == [("a", 1_000, 0.8, 1), ("a", 5_000, 0.0, 0), ("b", 20_000, 0.5, 1)]


def test_signals_of_buffers_equal_those_of_all_bars_so_far(spark, store, tmp_path):
    tape = st.tape(spark, SF)
    b = ob.bars(tape, "tick", ticks=5).cache()
    names = ["realized_volatility", "log_dollar_volume"]
    rng = np.random.default_rng(1)
    forest = lambda: boosting.Forest([[[0, -1, -1], [float(rng.uniform(0.5, 2)), 0.0, 0.0], [1, 0, 0], [2, 0, 0], [0.0, -0.8, 0.9]]])
    models = {"primary": learning.Model(forest(), names), "meta": learning.Model(forest(), [*names, "primary_side"]), "features": names}
    stream = in_parts(spark, tape, f"{tmp_path}/in", "time", 2)
    query = live.score_rules(rules.rule_bars(stream, {"tick": {"ticks": 5}, "volume": {"threshold": 5.0}}), {"tick": models}, f"file://{tmp_path}/t", "triple_barrier", least_meta=0.0, least_size=0.0)
    query.option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination(300)
    got = tables.read(spark, f"file://{tmp_path}/t", "signals")
    assert tables.read(spark, f"file://{tmp_path}/t", "bars").groupBy("bar_type").count().count() == 2 and got.where("bar_type <> 'tick'").count() == 0
    # a buffer of 100 bars holds all bars so far here
    assert b.agg(F.max("bar_idx")).first()[0] < 100
    want = learning.signals(models, decayed_volatility(b), least_meta=0.0, least_size=0.0).where("bar_idx >= 24")
    columns = ["symbol", "timestamp", "side", "size", "entry_price", "meta_probability"]
    assert want.count() > 20 and rounded(got, columns) == rounded(want, columns)
