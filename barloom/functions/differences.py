"""Fractional differences of many orders by block convolution.

The weights of a small order reach back thousands of bars. Each slice of a series,
with as many bars before it as the longest list of weights, is transformed once and
multiplied with the transform of each list (overlap-save), so the work on n bars
grows with n log n and not with n times the weights, and no task holds a symbol.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.frames import difference_weights

#: Bars of a slice, besides those before it.
SIZE = 1 << 14


def convolved(bars: DataFrame, x: Column, orders, threshold: float = 1e-5, size: int = SIZE) -> DataFrame:
    """(symbol, bar_idx, values) with one value for each order: its difference of x at a bar, null until its weights are covered or where they meet a null."""
    lists = [difference_weights(d, threshold) for d in orders]
    most = max(map(len, lists))
    at = F.col("bar_idx")
    cut = bars.select("symbol", "bar_idx", x.cast("double").alias("x")).withColumn("slice", F.explode(F.sequence(F.floor(at / size), F.floor((at + most - 1) / size))))

    def run(key, table):
        table = table.sort_by("bar_idx")
        place, value = table["bar_idx"].to_numpy(), table["x"].to_numpy().astype(float)
        n = len(value)
        gone = np.concatenate([[0], np.cumsum(~np.isfinite(value))])
        value = np.where(np.isfinite(value), value, 0.0)
        length = 1 << (n + most - 1).bit_length()
        spectrum = np.fft.rfft(value, length)
        own = np.flatnonzero(place // size == key[1].as_py())
        out = np.empty((len(own), len(lists)))
        for k, weights in enumerate(lists):
            w = len(weights)
            out[:, k] = np.fft.irfft(spectrum * np.fft.rfft(weights, length), length)[own]
            full = (place[own] >= w - 1) & (own >= w - 1)
            full[full] = (gone[own[full] + 1] - gone[own[full] + 1 - w]) == 0
            out[~full, k] = np.nan
        values = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * len(lists)), pa.array(out.ravel(), from_pandas=True))
        return pa.table({"symbol": pa.array([key[0].as_py()] * len(own), pa.string()), "bar_idx": place[own], "values": values})

    return cut.groupBy("symbol", "slice").applyInArrow(run, "symbol string, bar_idx long, values array<double>")


def fractional(bars: DataFrame, x: Column, order: float, name: str = "ffd", threshold: float = 1e-5, size: int = SIZE) -> DataFrame:
    """(symbol, bar_idx, name): the difference of one order."""
    return convolved(bars, x, [order], threshold, size).select("symbol", "bar_idx", F.get("values", F.lit(0)).alias(name))
