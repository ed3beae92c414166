"""Weights of label spans and purged folds against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.operators import labels as ol


def plain_weights(closes, times, spans, half_life):
    n = len(closes)
    ret = np.abs(np.array([0.0] + [closes[i] / closes[i - 1] - 1 for i in range(1, n)]))
    cut = [(max(s, 0), min(e, n)) if s is not None and e is not None else (0, 0) for s, e in spans]
    open_at = np.zeros(n)
    for s, e in cut:
        open_at[s:e] += 1
    unique = np.array([np.mean(1 / open_at[s:e]) if s < e else 0.0 for s, e in cut])
    moved = np.array([ret[s:e].sum() if s < e else 0.0 for s, e in cut])
    attribution = moved / moved.sum() if moved.sum() else np.full(len(cut), 1 / len(cut))
    first = np.array([times[s] if s < n else np.nan for s, _ in cut])
    decay = 2.0 ** (-(np.nanmax(first) - first) / half_life) if half_life > 0 else np.ones(len(cut))
    raw = np.maximum(np.nan_to_num(unique * attribution * decay), 1e-10)
    return unique, attribution, decay, raw / raw.sum()


@pytest.mark.parametrize("size", [7, 100_000])
@pytest.mark.parametrize("half_life", [-1.0, 5e6])
def test_span_weights_of_plain_sums(spark, size, half_life):
    rng = random.Random(8)
    bars, rows, want = [], [], {}
    for symbol in "ab":
        closes = np.exp(np.cumsum([rng.gauss(0, 0.02) for _ in range(90)])).tolist()
        times = [1_000_000 * i + rng.randint(0, 1000) for i in range(90)]
        spans = [(s, s + rng.choice([0, 1, 3, 20, 200])) for s in (rng.randint(0, 89) for _ in range(60))] + [(-5, 3), (85, 95), (4, 4), (9, 2), (30, 40), (30, 40), (0, 90)]
        bars += [(symbol, i, t, c) for i, (t, c) in enumerate(zip(times, closes))]
        rows += [(symbol, s, e, k, "x") for k, (s, e) in enumerate(spans)]
        for k, x in enumerate(zip(*plain_weights(closes, times, spans, half_life))):
            want[symbol, k] = x
    b = spark.createDataFrame(bars, "symbol string, bar_idx long, timestamp long, close double").repartition(3)
    s = spark.createDataFrame(rows, "symbol string, start long, end long, k long, name string").repartition(3)
    made = ol.span_weights(b, s, half_life, size=size)
    assert made.columns == ["symbol", "start", "end", "k", "name", "uniqueness", "attribution", "decay", "weight"]
    got = {(r.symbol, r.k): (r.uniqueness, r.attribution, r.decay, r.weight) for r in made.collect()}
    assert got.keys() == want.keys()
    for key, x in want.items():
        assert got[key] == pytest.approx(x, rel=1e-9, abs=1e-13), key


def test_span_weights_of_flat_prices_and_no_spans(spark):
    b = spark.createDataFrame([("a", i, i, 5.0) for i in range(10)], "symbol string, bar_idx long, timestamp long, close double")
    s = spark.createDataFrame([("a", 0, 5), ("a", 2, 8), ("a", None, 3)], "symbol string, start long, end long")
    got = ol.span_weights(b, s).collect()
    assert all(r.attribution == pytest.approx(1 / 3) for r in got) and sum(r.weight for r in got) == pytest.approx(1)
    assert ol.span_weights(b, s.where("false")).count() == 0
    given = ol.span_weights(b, s, returns=F.when(F.col("bar_idx") == 7, -2.0)).collect()
    assert {r.attribution for r in given if r.start == 2} == {1.0}


def test_barrier_ends_and_purging_by_overlap(spark):
    rng = random.Random(9)
    rows = []
    price = 100.0
    for i in range(80):
        price *= 1 + rng.gauss(0, 0.02)
        rows.append(("a", i, 1000 * i, price, price * 1.01, price * 0.99, 0.03))
    b = spark.createDataFrame(rows, "symbol string, bar_idx long, timestamp long, close double, high double, low double, vol double")
    ends = {r.bar_idx: r.end for r in ol.triple_barrier(b, hold=12, stop=1.0, take=1.0, ends=True).collect()}
    for i in range(80):
        close = rows[i][3]
        met = [j for j in range(i + 1, min(i + 12, 79) + 1) if rows[j][5] <= close * 0.97 or rows[j][4] >= close * 1.03]
        assert ends[i] == (met[0] if met else min(i + 12, 79))
    e = F.element_at(F.array(*(F.lit(ends[i]) for i in range(80))), F.col("bar_idx").cast("int") + 1)
    roles = {(r.fold, r.bar_idx): r.role for r in ol.purged_folds(b, 4, embargo=0.05, end=e).collect()}
    for fold in range(4):
        start, last = 20 * fold, 20 * (fold + 1) if fold < 3 else 80
        for i in range(80):
            want = "test" if start <= i < last else "purged" if i < start <= ends[i] else "embargo" if last <= i < last + 4 else "train"
            assert roles[fold, i] == want
