import numpy as np
import pytest

from barloom.functions import frames as fr
from barloom.operators import bars as ob
from barloom.sources import trades as src
from barloom.streaming.bars import stream_bars

SCHEMA = "id long, symbol string, price double, qty double, quote_qty double, time long, is_buyer_maker boolean"


def tape(spark, n=400, seed=42):
    rng = np.random.default_rng(seed)
    rows = [(i, "A", float(50 + rng.normal()), float(0.1 + rng.random()), 0.0, 1_700_000_000_000 + 1000 * i, bool(rng.random() < 0.4)) for i in range(n)]
    return spark.createDataFrame(rows, SCHEMA)


def test_intervals():
    assert [ob.interval_ms(x) for x in ("1min", "2h", "30s")] == [60_000, 7_200_000, 30_000]
    with pytest.raises(ValueError):
        ob.interval_ms("soon")


@pytest.mark.parametrize("kind", list(ob.BARS))
def test_bars_keep_prices_in_order(spark, kind):
    small = {"time": {"interval": "1min"}, "tick": {"ticks": 20}, "volume": {"threshold": 5.0}, "dollar": {"threshold": 300.0}}
    rows = ob.bars(tape(spark), kind, **small.get(kind, {"first": 20, "span": 10})).collect()
    assert rows and all(r.low <= min(r.open, r.close) and r.high >= max(r.open, r.close) for r in rows)
    assert sorted(r.bar_idx for r in rows) == list(range(len(rows)))


def test_empty_tape(spark):
    assert ob.bars(tape(spark, 0), "volume").count() == 0 == ob.bars(tape(spark, 0), "time").count()


def test_stream_bars_equal_batch_bars(spark, tmp_path):
    t = tape(spark)
    for k in range(3):
        t.where(f"id div 150 = {k}").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = stream_bars(stream, rule="threshold", value="volume", threshold=5.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.bar_idx, r.timestamp, round(r.volume, 9))
    assert sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(key, ob.bars(t, "volume", threshold=5.0).collect()))


def test_trade_files_with_and_without_header(spark, tmp_path):
    (tmp_path / "A-aggTrades-2024-01-01.csv").write_text("agg_trade_id,price,quantity,first,last,time,m\n1,10,2,1,1,1704067200000,true\n")
    (tmp_path / "A-aggTrades-2024-01-02.csv").write_text("2,11,3,2,2,1704153600000,false\n")
    rows = src.read_trade_files(spark, [str(p) for p in sorted(tmp_path.glob("*.csv"))], "A", "aggTrades").orderBy("id").collect()
    assert [(r.id, r.quote_qty, r.is_buyer_maker) for r in rows] == [(1, 20.0, True), (2, 33.0, False)]
    assert not src.file_in_range("A-trades-2024-01-01.csv", 1_704_400_000_000, None)


def bar_frame(spark, closes):
    rows = [("A", i, 1000 * i, c, c * 1.01, c * 0.99, c, 1.0) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, bar_idx long, timestamp long, open double, high double, low double, close double, volume double")


def test_difference_weights():
    assert fr.difference_weights(1.0) == [1.0, -1.0]
    assert np.allclose(fr.difference_weights(0.5)[:4], [1, -0.5, -0.125, -0.0625])
    assert len(fr.difference_weights(0.95)) == 79


def test_phrases_against_a_plain_parse():
    def plain(s):
        count, at, size = 1, 0, 1
        while at + size <= len(s):
            seen = any(s[j : j + size] == s[at : at + size] for j in range(at))
            count, at, size = (count, at, size + 1) if seen else (count + 1, at + size, 1)
        return count / (len(s) / np.log2(len(s)))

    rng = np.random.default_rng(7)
    for n in (2, 3, 5, 20, 64):
        for _ in range(30):
            s = "".join(rng.choice(["0", "1"], n))
            assert fr.phrases(s) == pytest.approx(plain(s))
    assert fr.phrases("") == fr.phrases("1") == 0.0
    assert fr.phrases("01" * 10) < fr.phrases("01101110010111011110")


def test_breaks_against_least_squares(spark):
    closes = np.exp(np.cumsum(np.random.default_rng(3).normal(0, 0.01, 60))).tolist()
    got = {r.bar_idx: r for r in fr.breaks(bar_frame(spark, closes)).collect()}
    assert all(got[i].csw_cusum is None and got[i].martingale_exp_t is None for i in range(50))
    for i in range(50, 60):
        y = np.log(closes[i - 50 : i])
        assert got[i].csw_cusum == pytest.approx(np.abs(np.cumsum(y - y.mean())).max() / y.std(ddof=1) / 50**0.5)
        for name, x in (("poly", np.arange(1, 51.0)), ("exp", np.exp(np.arange(1, 51) / 50)), ("power", np.sqrt(np.arange(1, 51)))):
            design = np.column_stack([np.ones(50), x])
            beta = np.linalg.lstsq(design, y - y[0], rcond=None)[0]
            rss = ((y - y[0] - design @ beta) ** 2).sum()
            assert got[i][f"martingale_{name}_t"] == pytest.approx(beta[1] / np.sqrt(rss / 48 / ((x - x.mean()) ** 2).sum()), rel=1e-6)


def test_entropies_of_flat_short_and_empty_series(spark):
    flat = fr.entropies(bar_frame(spark, [5.0] * 8)).orderBy("bar_idx").collect()
    assert [r.rolling_shannon_entropy for r in flat] == [None] * 5 + [pytest.approx(0.0, abs=1e-12)] * 3
    assert fr.entropies(bar_frame(spark, [1.0, 2.0])).where("rolling_lempel_ziv is not null").count() == 0
    assert fr.entropies(bar_frame(spark, [])).count() == 0


def test_tick_rule_carries_the_last_move(spark):
    rows = fr.spreads(bar_frame(spark, [2.0, 2.0, 1.0, 1.0, 3.0]), 1).orderBy("bar_idx").collect()
    assert [r.tick_rule for r in rows] == [1.0, 1.0, -1.0, -1.0, 1.0]
    assert rows[0].corwin_schultz_spread is None and rows[1].corwin_schultz_spread >= 0
