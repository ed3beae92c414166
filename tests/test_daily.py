"""Bars day by day against bars of all days at once, and saved estimates."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators import bars as ob
from barloom.operators import daily
from barloom.sources import trades as st

SF = "/root/testdata/sf0.001"
PARAMETERS = {"time": {"interval": "6h"}, "tick": {"ticks": 7}, "volume": {"threshold": 5.0}, "dollar": {"threshold": 300.0}}


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*[c.split()[0] for c in ob.SCHEMA.split(", ")]).collect())


@pytest.mark.parametrize("kind", list(ob.BARS))
def test_days_one_by_one_equal_all_at_once(spark, tmp_path, kind):
    options = PARAMETERS.get(kind, {"first": 8, "span": 5})
    tape = st.tape(spark, SF).where(F.col("time") < 1_704_067_200_000 + 12 * 86_400_000).cache()
    root = f"file://{tmp_path}"
    cut = 1_704_067_200_000 + 5 * 86_400_000 + 12_345_678
    # one symbol pauses on the second day
    parts = [tape.where(F.col("time") < cut), tape.where((F.col("time") >= cut) & (F.col("time") < 2 * cut - 1_704_067_200_000) & (F.col("symbol") != "click")), tape.where((F.col("time") >= 2 * cut - 1_704_067_200_000) | ((F.col("time") >= cut) & (F.col("symbol") == "click")))]
    for k, part in enumerate(parts):
        daily.advance(part, root, f"2024-01-0{k + 1}", kind, **options)
    want = ob.bars(tape, kind, **options)
    assert rows(daily.bars(spark, root, kind)) == rows(want) and want.count() > 10
    assert daily.states(spark, root, kind).count() == 5
    # the second day again
    before = rows(daily.bars(spark, root, kind))
    again = rows(daily.advance(parts[1], root, "2024-01-02", kind, **options))
    assert rows(daily.bars(spark, root, kind)) == before and set(again) <= set(before)


def test_days_without_trades_hand_states_on(spark, tmp_path):
    root, tape = f"file://{tmp_path}", st.tape(spark, SF)
    assert daily.states(spark, root, "tick").count() == 0 and daily.bars(spark, root, "tick").count() == 0
    daily.advance(tape, root, "2024-01-01", "tick", ticks=7)
    assert daily.advance(tape.where("false"), root, "2024-01-02", "tick", ticks=7).count() == 0
    first, second = (sorted(map(tuple, daily.states(spark, root, "tick", day).collect())) for day in ("2024-01-02", "2024-01-03"))
    assert first == second and len(first) == 5 and all(json.loads(s)["n"] < 7 for _, s in first)
    with pytest.raises(ValueError):
        daily.advance(tape, root, "2024-01-03", "renko")


def test_saved_estimates_resume(spark, tmp_path):
    tape, path = st.tape(spark, SF), f"file://{tmp_path}/states"
    rule = {"rule": "imbalance", "value": "tick", "first": 8, "span": 5}
    half = tape.agg(F.expr("percentile(time, 0.5)")).first()[0]
    early, late = tape.where(F.col("time") <= half), tape.where(F.col("time") > half)
    assert ob.load_states(spark, path).count() == 0
    found = ob.fold_states(early, **rule)
    ob.save_states(found, path)
    loaded = ob.load_states(spark, path)
    assert sorted(map(tuple, loaded.collect())) == sorted(map(tuple, found.collect())) and loaded.count() == 5
    saved = json.loads(loaded.first().state)
    assert saved.keys() == {"expected_ticks", "bar_tick_counts", "expected_num_ticks_init", "num_prev_bars", "bars_completed", "expected_imbalance"}
    # what is resumed goes on from the expectations and numbers of before, with no open bar
    resumed = ob.folded_bars(late, loaded, **rule)
    want = []
    for symbol, state in loaded.collect():
        fold = ob.Fold(**rule).resume(json.loads(state))
        trades = sorted((r.time, r.id, r.price, r.qty, r.is_buyer_maker) for r in late.where(F.col("symbol") == symbol).collect())
        want += [(symbol, *b) for b in fold.step((t, p, q, m) for t, _, p, q, m in trades)]
    assert rows(resumed) == sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in want)
    assert {r.symbol: r.n for r in resumed.groupBy("symbol").agg(F.min("bar_idx").alias("n")).collect()} == {s: json.loads(x)["bars_completed"] for s, x in loaded.collect()}
    # a state of another version, with names missing, leaves what is there
    assert ob.Fold(**rule).resume({"expected_ticks": 11.0}).ticks == 11.0 and ob.Fold(**rule).resume({}).rate is None
    run = ob.Fold("run", "volume", first=8, span=5).resume({"p_buy": 0.7, "expected_run_up": 2.0, "expected_run_down": 1.0})
    assert run.p == 0.7 and run.rate == [2.0, 1.0]
