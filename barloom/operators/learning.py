"""Two models on bars: the side of a trade, and whether that side is right; training, tuning and walking forward.

Models are boosted trees (operators.boosting). All models of a study, one for each
window and fold, are grown in the same jobs. Folds are purged per symbol
(labels.purged_folds); the second model learns from the first one's answers to bars
it has not seen.
"""

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from barloom.functions import features as ft
from barloom.functions.table import all_features
from barloom.operators import boosting, tuning
from barloom.operators import labels as ol
from barloom.operators import simulation as sim
from barloom.sources.cut import cut

#: Bars that a label looks ahead, by labelling.
SPANS = {"triple_barrier": 50, "trend_scanning": 80, "directional_change": 50}
PRIMARY = {"maxIter": 30, "maxDepth": 5, "maxLeaves": 31, "stepSize": 0.05, "subsamplingRate": 0.8, "minInstancesPerNode": 20, "seed": 42}
META = {**PRIMARY, "maxIter": 25, "maxDepth": 4, "maxLeaves": 15, "minInstancesPerNode": 30}
KEYS = ("symbol", "bar_idx", "timestamp")


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with bar_idx counted anew from 0."""
    return rows.withColumn("bar_idx", (F.row_number().over(W.partitionBy("symbol").orderBy("timestamp", "bar_idx")) - 1).cast("long"))


def known_labels(labels: DataFrame) -> DataFrame:
    """Rows with a label; an error if one is neither -1 nor 1."""
    known = labels.where("label is not null")
    if known.where(~F.col("label").isin(-1, 1)).take(1):
        raise ValueError("labels have to be -1 or 1")
    return known


def matrix(bars: DataFrame, labels: DataFrame | None, names, window: int = 20) -> DataFrame:
    """Keys, prices and features of the bars that have them all, features carried forward where one is missing; with labels also label and weight.

    With labels, bars without one go first: the features look back over labelled
    bars only, as they are numbered then, and weights are those of the rows that
    are left, numbered again. Bars that only a time-out ended thus leave by what
    came after them, which flatters a model; for scoring, all bars count. Bars with a
    price of 0 are left out of the ranges' means (all_features: known): where most bars
    have one, no bar would have all features.
    """
    b = cut(bars if labels is None else _numbered(bars.join(known_labels(labels).select("symbol", "bar_idx", "label"), ["symbol", "bar_idx"])))
    past = ft.ordered().rowsBetween(W.unboundedPreceding, 0)
    kept = [*KEYS, *(c for c in ("close", "high", "low") if c not in names), *([] if labels is None else ["label"])]
    # the plan of all features is long: what follows starts from their rows
    f = cut(all_features(b, window=window, only=names, known=True).select(*kept, *names))
    f = f.select(*kept, *(F.last(F.nanvl(F.col(n).cast("double"), F.lit(None).cast("double")), True).over(past).alias(n) for n in names)).dropna(subset=list(names))
    if labels is None:
        return f
    f = cut(_numbered(f))
    return f.join(ol.weights(f).select("symbol", "bar_idx", "weight"), ["symbol", "bar_idx"])


@dataclass
class Model:
    """A forest and the columns it looks at."""

    forest: boosting.Forest
    names: list[str]


def _vector(names):
    return F.array(*(F.col(n).cast("double") for n in names))


def _balanced(rows: DataFrame, target) -> DataFrame:
    """rows (model, weight, ...) with y and w, whose sum in a model is the same for both targets and whose mean is 1; models with one target are left out."""
    rows = rows.withColumn("y", target.cast("double"))
    sums = rows.groupBy("model", "y").agg(F.sum("weight").alias("_s"), F.count("*").alias("_n"))
    whole = sums.groupBy("model").agg(F.sum("_n").alias("_all"), F.count("*").alias("_targets")).where("_targets = 2")
    scale = sums.join(whole, "model").select("model", "y", F.coalesce(F.try_divide(F.col("_all") / 2, F.col("_s")), F.lit(1.0)).alias("_scale"))
    return rows.join(scale, ["model", "y"]).withColumn("w", F.col("weight") * F.col("_scale")).drop("_scale")


def _forests(m: DataFrame, members: DataFrame, names, params: dict) -> dict[int, boosting.Forest]:
    """The models of members (symbol, bar_idx, model, y, w) on the features of m: a row's features are held once, whatever the models it is in."""
    lists = members.groupBy("symbol", "bar_idx").agg(F.collect_list(F.struct(F.col("model").cast("int").alias("model"), "y", "w")).alias("members"))
    return boosting.fit(m.join(lists, ["symbol", "bar_idx"]).select(_vector(names).alias("x"), "members"), params)


def _with_probability(models: dict[int, boosting.Forest], m: DataFrame, model, names, name: str) -> DataFrame:
    return m.withColumn(name, boosting.probability(models, model.cast("int"), _vector(names)))


def _sided(m: DataFrame) -> DataFrame:
    return m.withColumn("primary_side", F.when(F.col("p_long") >= 0.5, 1).otherwise(-1))


def with_side(model: Model, m: DataFrame) -> DataFrame:
    """m with p_long and the side: 1 where that is half or more, else -1."""
    return _sided(_with_probability({0: model.forest}, m, F.lit(0), model.names, "p_long"))


def fit_primary(m: DataFrame, names, params: dict | None = None) -> Model:
    members = _balanced(m.select("symbol", "bar_idx", "label", "weight", F.lit(0).alias("model")), F.col("label") == 1)
    return Model(_forests(m, members, names, {**PRIMARY, **(params or {})}).get(0, boosting.Forest()), list(names))


def two_models(m: DataFrame, names, folds: int = 5, hold: int = 50, embargo: float = 0.01, params: dict | None = None, meta_params: dict | None = None) -> tuple[dict, dict, DataFrame]:
    """Both models of every group of m (group int, KEYS, features, label, weight): {group: first}, {group: second} and the rows with the side that a model of the other folds gives them.

    The first models of all groups and folds are one fit, the second ones another. A
    group or fold whose rows have one target has no model, and its rows no side; where
    a first model is never or always right there is no second one.
    """
    m = cut(m)
    roles = ol.purged_folds(m, folds, hold, embargo).where(F.col("role").isin("train", "test")).join(m.select("symbol", "bar_idx", "group", "label", "weight"), ["symbol", "bar_idx"])
    roles = cut(roles.withColumn("model", F.col("group") * (folds + 1) + F.col("fold")))
    every = m.select("symbol", "bar_idx", "label", "weight", (F.col("group") * (folds + 1) + folds).alias("model"))
    members = _balanced(every.unionByName(roles.where("role = 'train'").select(every.columns)), F.col("label") == 1)
    first = _forests(m, members, names, {**PRIMARY, **(params or {})})
    tests = roles.where("role = 'test'").select("symbol", "bar_idx", "model")
    sided = cut(_sided(_with_probability(first, m.join(tests, ["symbol", "bar_idx"]), F.col("model"), names, "p_long").where("p_long is not null").drop("model")))
    rows = sided.select("symbol", "bar_idx", "label", "weight", "primary_side", F.col("group").alias("model"))
    second = _forests(sided, _balanced(rows, F.col("primary_side") == F.col("label")), [*names, "primary_side"], {**META, **(meta_params or {})})
    return {k // (folds + 1): f for k, f in first.items() if k % (folds + 1) == folds}, second, sided


def unseen_sides(m: DataFrame, names, folds: int = 5, hold: int = 50, embargo: float = 0.01, params: dict | None = None) -> DataFrame:
    """m with the side that a model of the other folds gives each bar; a fold whose other bars have one label only gives none."""
    sided = two_models(m.withColumn("group", F.lit(0)), names, folds, hold, embargo, params, {"maxIter": 0})[2].drop("group")
    if not sided.take(1):
        raise ValueError("no fold has both labels in its other bars")
    return sided


def _measures() -> list:
    """Accuracy, precision and recall of primary_side, long being positive, and the log loss of p_long; 0 where undefined."""
    right, longs, said = F.col("primary_side") == F.col("label"), F.col("label") == 1, F.col("primary_side") == 1
    each = {"accuracy": F.avg(right.cast("double")), "precision": F.try_divide(F.count_if(right & said), F.count_if(said)), "recall": F.try_divide(F.count_if(right & longs), F.count_if(longs)), "n": F.count("*"), "log_loss": -F.avg(F.ln(F.greatest(F.when(longs, F.col("p_long")).otherwise(1 - F.col("p_long")), F.lit(1e-15))))}
    return [F.coalesce(v, F.lit(0)).alias(k) for k, v in each.items()]


def scores(sided: DataFrame) -> dict:
    return sided.agg(*_measures()).first().asDict()


#: What tune searches.
SPACE = {
    "maxIter": tuning.Parameter("int", 10, 80), "maxDepth": tuning.Parameter("int", 3, 7), "maxLeaves": tuning.Parameter("int", 7, 63), "stepSize": tuning.Parameter("log", 0.01, 0.3),
    "subsamplingRate": tuning.Parameter("float", 0.5, 1.0), "minInstancesPerNode": tuning.Parameter("int", 5, 60),
}


def tune(m: DataFrame, names, trials: int = 10, folds: int = 3, hold: int = 50, measure: str = "recall", seed: int = 42, space: dict | None = None) -> dict:
    """The parameters with the best mean measure over purged folds, by tuning.search: a trial is stopped after its first fold where that is below the median of the trials before."""
    m = cut(m)
    roles = cut(ol.purged_folds(m, folds, hold, 0.01).where(F.col("role").isin("train", "test")).join(m.select("symbol", "bar_idx", "label", "weight"), ["symbol", "bar_idx"]).withColumnRenamed("fold", "model"))
    sign = -1 if measure == "log_loss" else 1

    def values(params):
        found = []
        for part in ((0,), tuple(range(1, folds))):
            own = roles.where(F.col("model").isin(*part)) if part else roles.where("false")
            models = _forests(m, _balanced(own.where("role = 'train'"), F.col("label") == 1), names, {**PRIMARY, **params})
            tested = m.join(own.where("role = 'test'").select("symbol", "bar_idx", "model"), ["symbol", "bar_idx"])
            tested = _sided(_with_probability(models, tested, F.col("model"), names, "p_long")).where("p_long is not null")
            found += [sign * float(r[measure]) for r in tested.groupBy("model").agg(*_measures()).collect()]
            yield sum(found) / len(found) if found else float("-inf")

    return tuning.search(space or SPACE, values, trials, seed)[0]


def train(bars: DataFrame, labels: DataFrame, names, hold: int = 50, folds: int = 5, params: dict | None = None, least: int = 100, trials: int = 0) -> dict:
    """{'primary', 'meta', 'features', 'params', 'metrics'}; an error below `least` bars or without labelled rows. trials: how many parameters to try for the first model before (none: those given)."""
    if (n := bars.count()) < least:
        raise ValueError(f"not enough bars: {n}")
    m = cut(matrix(bars, labels, names))
    if not m.take(1):
        raise ValueError("no labelled bar has all features")
    params = {**(params or {}), **(tune(m, names, trials, hold=hold) if trials else {})}
    first, second, sided = two_models(m.withColumn("group", F.lit(0)), names, folds, hold, params=params)
    if 0 not in first or not sided.take(1):
        raise ValueError("no fold has both labels in its other bars")
    primary = Model(first[0], list(names))
    meta = Model(second[0], [*names, "primary_side"]) if 0 in second else None
    # what the second model is worth: one that knows the first four fifths of each symbol's bars judges the last
    late = cut(sided.withColumn("_late", F.percent_rank().over(W.partitionBy("symbol").orderBy("bar_idx")) >= 0.8))
    early = _balanced(late.where("not _late").select("symbol", "bar_idx", "label", "weight", "primary_side", F.lit(0).alias("model")), F.col("primary_side") == F.col("label"))
    judge = _forests(late, early, [*names, "primary_side"], META)
    judged = _with_probability(judge, late.where("_late"), F.lit(0), [*names, "primary_side"], "p_right").agg(F.avg(F.when(F.col("p_right") >= 0.5, (F.col("primary_side") == F.col("label")).cast("double")))).first()[0]
    metrics = {"in_sample": scores(with_side(primary, m)), "out_of_sample": scores(sided), "meta_precision": judged or 0.0}
    return {"primary": primary, "meta": meta, "features": list(names), "params": {**PRIMARY, **params}, "metrics": metrics}


def save(models: dict, path: str) -> None:
    """Both models and what they need: the features in their order and the parameters."""
    spark = SparkSession.getActiveSession()
    for name in ("primary", "meta"):
        if models.get(name) is not None:
            boosting.save(models[name].forest, spark, f"{path}/{name}")
    card = {"features": models["features"], "params": models.get("params", {}), "meta": models.get("meta") is not None}
    spark.createDataFrame([(json.dumps(card),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/card")


def load(path: str) -> dict:
    """What save has written."""
    spark = SparkSession.getActiveSession()
    card = json.loads(spark.read.text(f"{path}/card", wholetext=True).first()[0])
    names = card["features"]
    meta = Model(boosting.load(spark, f"{path}/meta"), [*names, "primary_side"]) if card["meta"] else None
    return {"primary": Model(boosting.load(spark, f"{path}/primary"), names), "meta": meta, "features": names, "params": card["params"]}


def registry(root: str, bar_types, labelings) -> dict[tuple[str, str], dict]:
    """The models of each (bar type, labelling) under root; pairs that were never trained are left out."""
    spark, out = SparkSession.getActiveSession(), {}
    for bar_type in bar_types:
        for labeling in labelings:
            path = f"{root}/{bar_type}_{labeling}"
            card = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/card")
            if card.getFileSystem(spark._jsc.hadoopConfiguration()).exists(card):
                out[bar_type, labeling] = load(path)
    return out


def importance(model: Model) -> list[tuple[str, float]]:
    """Features of a model by their share of all splits' gains, the most first."""
    total = sum(model.forest.gains.values()) or 1.0
    return sorted(((n, model.forest.gains.get(k, 0.0) / total) for k, n in enumerate(model.names)), key=lambda x: (-x[1], x[0]))


def missing(models: dict, features: DataFrame) -> list[str]:
    """Features that a model needs and a table lacks."""
    return [n for n in models["features"] if n not in features.columns]


def signals(models: dict, bars: DataFrame, vol: str = "vol", horizon: int = 10, least_meta: float = 0.5, least_size: float = 0.1, hold_ms: int = 3_600_000, averaged: bool = False) -> DataFrame:
    """Signals of bars with a volatility: side, size by the second model's probability, price barriers 2 deviations off and a time barrier.

    Without a second model (meta is None) the first one's probability of its side
    takes its place. averaged: sizes are divided by the signals open at their time.
    """
    names = models["features"]
    m = with_side(models["primary"], cut(matrix(bars, None, names)))
    own = F.when(F.col("primary_side") == 1, F.col("p_long")).otherwise(1 - F.col("p_long"))
    meta = models.get("meta")
    m = _with_probability({0: meta.forest}, m, F.lit(0), meta.names, "meta_probability") if meta is not None else m.withColumn("meta_probability", own)
    s = m.select("symbol", "bar_idx", "timestamp", "primary_side", "meta_probability").join(bars.select("symbol", "bar_idx", "close", vol), ["symbol", "bar_idx"]).where(F.col("meta_probability") >= least_meta)
    s = s.withColumn("time", F.col("timestamp"))
    if averaged:
        s = ol.concurrency(s, s.select("symbol", F.col("timestamp").alias("start"), (F.col("timestamp") + hold_ms).alias("end")))
    s = s.withColumn("size", ol.bet_sizes(F.col("meta_probability"), F.col("n_open") if averaged else None))
    off = 2 * F.col("primary_side") * F.col(vol)
    return s.where(F.col("size") >= least_size).select(
        "symbol", "bar_idx", "timestamp", F.col("primary_side").alias("side"), "size", F.col("close").alias("entry_price"), (F.col("close") * (1 - off)).alias("sl_price"), (F.col("close") * (1 + off)).alias("pt_price"), (F.col("timestamp") + hold_ms).alias("time_barrier"), "meta_probability",
    )


#: Measures of a window, rounded as in the table of runs.
MEASURES = {"oos_accuracy": 4, "oos_precision": 4, "oos_recall": 4, "primary_recall": 4, "meta_precision": 4, "sharpe": 2, "max_dd": 2, "total_return": 2, "win_rate": 1, "num_trades": 0, "num_test_signals": 0}


def window_signals(scored: DataFrame, labeling: str, hold: int, stop: float = 2.0, take: float = 2.0, minute_ms: int = 60_000) -> DataFrame:
    """Signals of scored test rows that the second model holds for right (more than half): barriers a bar's range away, the time barrier `hold` minutes."""
    reach = F.col("high") - F.col("low")
    barred = (F.lit(labeling) == "triple_barrier") & (reach > 0)
    price = lambda k: F.when(barred, F.col("close") + k * F.col("primary_side") * reach)
    return scored.where("p_right > 0.5").select(
        "symbol", F.col("bar_idx").alias("signal_id"), "timestamp", F.col("primary_side").alias("side"), ol.bet_size(F.col("p_right")).alias("size"), F.col("close").alias("entry_price"), price(-stop).alias("sl_price"), price(take).alias("pt_price"),
        (F.col("timestamp") + hold * minute_ms).alias("time_barrier"), F.lit(labeling).alias("labeling_method"), F.col("p_right").alias("meta_probability"),
    )


def in_windows(trades: DataFrame, windows: list) -> DataFrame:
    """trades once for each part of a window that holds their time (ends included), the symbol being symbol|window|part: a tape of its own, whose bars start anew."""
    part = lambda w, name, start, end: F.struct(F.lit(w.window).alias("window"), F.lit(name).alias("part"), F.lit(start).alias("start"), F.lit(end).alias("end"))
    all_parts = F.array(*(p for w in windows for p in (part(w, "train", w.train_start, w.train_end), part(w, "test", w.test_start, w.test_end))))
    rows = trades.withColumn("_w", F.explode(F.filter(all_parts, lambda p: (p["start"] <= F.col("time")) & (F.col("time") <= p["end"]))))
    return rows.withColumn("symbol", F.concat_ws("|", "symbol", "_w.window", "_w.part")).drop("_w")


def walk_forward(trades: DataFrame, windows: DataFrame, make_bars, make_labels, names, labeling: str = "triple_barrier", hold: int = 50, folds: int = 5, params: dict | None = None, meta_params: dict | None = None, least=(50, 10), capital: float = 10_000.0, fee_bps: float = 10.0, curves: bool = False):
    """(window, metric, value) of each window: bars, labels and features made anew from its trades, both models fitted on its first part, and on its second part their measures and the performance of their signals (the mean over symbols).

    windows: rows of walk_forward.boundaries without keys, a few dozen. Bars, features,
    models and simulations of all windows are the same jobs. Windows with too few rows
    or one label are left out; fewer than three that work are an error. curves: also the
    equity (symbol, window, timestamp, equity) of each window's second part, as
    walk_forward.stitched takes it with the symbol as run.
    """
    every = windows.orderBy("window").collect()
    b = cut(make_bars(in_windows(trades, every)))
    m = matrix(b, make_labels(b), names)
    place = F.split("symbol", r"\|")
    m = cut(m.withColumn("window", F.element_at(place, -2).cast("int")).withColumn("part", F.element_at(place, -1)))
    train, test = F.col("part") == "train", F.col("part") == "test"
    enough = m.groupBy("window").agg(F.count_if(train).alias("a"), F.count_if(test).alias("b"), F.count_distinct(F.when(train, F.col("label"))).alias("labels"))
    m = cut(m.join(enough.where((F.col("a") >= least[0]) & (F.col("b") >= least[1]) & (F.col("labels") == 2)).select("window"), "window", "left_semi"))
    seen, coming = m.where(train).withColumnRenamed("window", "group").drop("part"), m.where(test)
    if m.select("window").distinct().count() < 3:
        raise ValueError("fewer than three windows have enough rows")
    first, second, _ = two_models(seen, names, folds, hold, params=params, meta_params=meta_params)
    in_sample = _sided(_with_probability(first, seen, F.col("group"), names, "p_long")).groupBy(F.col("group").alias("window")).agg(*_measures())
    tested = _sided(_with_probability(first, coming, F.col("window"), names, "p_long"))
    tested = _with_probability(second, tested, F.col("window"), [*names, "primary_side"], "p_right")
    own = F.when(F.col("primary_side") == 1, F.col("p_long")).otherwise(1 - F.col("p_long"))
    tested = cut(tested.withColumn("p_right", F.coalesce("p_right", own)))
    measured = tested.groupBy("window").agg(*_measures())
    right = (F.col("primary_side") == F.col("label")).cast("double")
    sure = tested.where("p_right > 0.5").groupBy("window").agg(F.count("*").alias("num_test_signals"), F.avg(right).alias("meta_precision"))
    curve, results = sim.simulate(window_signals(tested, labeling, hold), tested, "simple", capital, fee_bps)
    of = F.element_at(F.split("symbol", r"\|"), -2).cast("int")
    results = results.groupBy(of.alias("window")).agg(*(F.avg(c).alias(c) for c in ("sharpe", "max_dd", "total_return", "win_rate")), F.sum("num_trades").alias("num_trades"))
    wide = measured.select("window", *(F.col(c).alias(f"oos_{c}") for c in ("accuracy", "precision", "recall"))).join(in_sample.select("window", F.col("recall").alias("primary_recall")), "window").join(sure, "window", "left").join(results, "window", "left")
    long = reduce(DataFrame.unionByName, [wide.select("window", F.lit(k).alias("metric"), F.round(F.coalesce(F.col(k).cast("double"), F.lit(0.0)), digits).alias("value")) for k, digits in MEASURES.items()])
    if not curves:
        return long
    return long, curve.select(F.element_at(F.split("symbol", r"\|"), 1).alias("symbol"), of.alias("window"), "timestamp", "equity")


def overfitting_gap(measured: DataFrame) -> DataFrame:
    """(insample_recall, oos_accuracy, gap): means over the windows of walk_forward, and their difference."""
    mean = lambda name: F.avg(F.when(F.col("metric") == name, F.col("value")))
    r, a = mean("primary_recall"), mean("oos_accuracy")
    return measured.agg(F.round(r, 4).alias("insample_recall"), F.round(a, 4).alias("oos_accuracy"), F.round(r - a, 4).alias("gap"))
