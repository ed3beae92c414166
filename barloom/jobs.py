"""Batch jobs for spark-submit: train one pair of models, train every combination, walk forward.

    spark-submit barloom/jobs.py train --data DIR --symbol S --out DIR --bar-type time --labeling triple_barrier
    spark-submit barloom/jobs.py train-all --data DIR --symbol S --out DIR [--days 7]
    spark-submit barloom/jobs.py walk-forward --data DIR --symbol S --out DIR
"""

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions import table
from barloom.functions.unit_root import decayed_volatility
from barloom.operators import bars as ob
from barloom.operators import labels as ol
from barloom.operators import learning
from barloom.operators import walk_forward as wf
from barloom.sources import store
from barloom.sources.trades import read_symbol

DAY_MS = 86_400_000


def bar_labels(bars: DataFrame, labeling: str) -> DataFrame:
    """(symbol, bar_idx, label) of the bars, one a bar: where directional changes of several thetas meet, that of the largest."""
    found = ol.labels(bars if "vol" in bars.columns else decayed_volatility(bars), labeling)
    if "theta" in found.columns:
        found = found.groupBy("symbol", "bar_idx").agg(F.max_by("label", "theta").alias("label"))
    return found.select("symbol", "bar_idx", "label")


def train(trades: DataFrame, bar_type: str, labeling: str, out: str, names=None, params: dict | None = None, trials: int = 0, **bar_parameters) -> dict:
    """Fits both models on the bars of trades and saves them under out; what the job reports. trials: parameters of the first model to try before."""
    names = list(names or table.names())
    bars = decayed_volatility(ob.bars(trades, bar_type, **bar_parameters)).persist()
    try:
        models = learning.train(bars, bar_labels(bars, labeling), names, hold=learning.SPANS[labeling], params=params, trials=trials)
        path = f"{out}/{bar_type}_{labeling}"
        learning.save(models, path)
        return {"bar_type": bar_type, "labeling_method": labeling, "num_bars": bars.count(), "num_features": len(names), "path": path, **models["metrics"]}
    finally:
        bars.unpersist()


def train_all(trades: DataFrame, out: str, days: int | None = 7, bar_types=None, labelings=None, **options) -> list[dict]:
    """train of every combination on the last days; one that cannot be trained is reported with its error. Writes training_results under out."""
    if days is not None:
        last = trades.agg(F.max("time")).first()[0]
        trades = trades.where(F.col("time") >= (last or 0) - days * DAY_MS)
    results = []
    for bar_type in bar_types or ob.BARS:
        for labeling in labelings or ol.LABELINGS:
            try:
                results.append({"status": "ok", **train(trades, bar_type, labeling, out, **options)})
            except ValueError as e:
                results.append({"status": "failed", "bar_type": bar_type, "labeling_method": labeling, "error": str(e)})
    rows = trades.sparkSession.createDataFrame([(json.dumps(r),) for r in results], "value string")
    rows.coalesce(1).write.mode("overwrite").text(f"{out}/training_results")
    return results


def walk_forward(trades: DataFrame, symbol: str, out: str, bar_type: str = "time", labeling: str = "triple_barrier", train_days: int = 90, test_days: int = 30, step_days: int = 30, names=None, bar_parameters: dict | None = None, **options) -> int:
    """Measures every window of a symbol's trades and adds the run and its windows to the tables under out; the run's id."""
    span = trades.agg(F.min("time").alias("start"), F.max("time").alias("end")).where("start is not null")
    windows = wf.boundaries(span, train_days, test_days, step_days).persist()
    measured, curve = learning.walk_forward(trades, windows, lambda t: ob.bars(t, bar_type, **(bar_parameters or {})), lambda b: bar_labels(b, labeling), list(names or table.names()), labeling, hold=learning.SPANS[labeling], curves=True, **options)
    measured = measured.persist()
    wide = measured.groupBy("window").pivot("metric", list(learning.MEASURES)).agg(F.first("value"))
    point = F.sort_array(F.collect_list(F.struct("timestamp", "equity", "drawdown")))
    arrays = lambda prefix: [F.col(f"points.{c}").alias(f"{prefix}{n}") for c, n in (("timestamp", "timestamps"), ("equity", "equity"), ("drawdown", "drawdown"))]
    own = wf.stitched(curve.select(F.concat_ws("|", "symbol", "window").alias("run"), "window", "timestamp", "equity")).groupBy("window").agg(point.alias("points")).select("window", *arrays(""))
    each = windows.join(wide, "window").join(own, "window", "left").withColumnRenamed("window", "window_index")
    # one curve of all windows, each going on from where the one before ended
    whole = wf.stitched(curve.select(F.col("symbol").alias("run"), "window", "timestamp", "equity")).agg(point.alias("points")).select(*arrays("stitched_"))
    stats = wf.bootstrap(measured.withColumn("run", F.lit(symbol)))
    gap = learning.overfitting_gap(measured).first()
    mean = lambda c: F.max(F.when(F.col("metric") == c, F.col("mean")))
    run = stats.agg(
        *(mean(c).alias(f"avg_{c}" if c.startswith("oos") else f"avg_oos_{c}") for c in ("oos_accuracy", "sharpe", "max_dd", "win_rate")), mean("total_return").alias("avg_oos_return"),
        F.map_from_entries(F.collect_list(F.struct("metric", F.struct("mean", "std", "ci_lower", "ci_upper")))).alias("aggregate_stats"),
    )
    fixed = {"symbol": symbol, "bar_type": bar_type, "labeling_method": labeling, "train_days": train_days, "test_days": test_days, "step_days": step_days, "num_windows": each.count(), "avg_insample_recall": gap.insample_recall, "overfitting_gap": gap.gap}
    run = run.join(F.broadcast(whole)).select("*", *(F.lit(v).alias(k) for k, v in fixed.items()), F.current_timestamp().alias("created_at"))
    return store.save_run(run, each, out)


def main(arguments=None):
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("job", choices=("train", "train-all", "walk-forward"))
    for name in ("--data", "--symbol", "--out"):
        parser.add_argument(name, required=True)
    parser.add_argument("--bar-type", choices=list(ob.BARS), default="time")
    parser.add_argument("--labeling", choices=list(ol.LABELINGS), default="triple_barrier")
    parser.add_argument("--days", type=int, default=7)
    parser.add_argument("--trials", type=int, default=0)
    for name, days in (("--train-days", 90), ("--test-days", 30), ("--step-days", 30)):
        parser.add_argument(name, type=int, default=days)
    a = parser.parse_args(arguments)
    trades = read_symbol(SparkSession.builder.getOrCreate(), a.data, a.symbol)
    if a.job == "train":
        result = train(trades, a.bar_type, a.labeling, a.out, trials=a.trials)
    elif a.job == "train-all":
        result = train_all(trades, a.out, a.days, trials=a.trials)
    else:
        result = {"run": walk_forward(trades, a.symbol, a.out, a.bar_type, a.labeling, a.train_days, a.test_days, a.step_days)}
    print(json.dumps(result))


if __name__ == "__main__":
    main()
