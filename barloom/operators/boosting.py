"""Boosted trees of many models in the same jobs.

A row carries its features once and the models it belongs to, each with a target and
a weight, so the windows and folds of a study are grown together: one job a level of
one tree of all models. A task adds up gradients by (model, node, feature, bin) over
its rows; Spark brings the sums of a node together, and the task that has them picks
the split, so that only splits reach the driver. Rows of one task need no shuffle:
their sums are complete there.

Features are cut into bins at quantiles of all rows of a fit. Trees grow level by
level to a depth, and of the nodes of the last levels those with the most gain are
split until there are `maxLeaves` leaves. Margins are written every ``KEPT`` trees, so
that a row is never led through more trees than that.
"""

import json
from collections import defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from barloom.sources.cut import cut

DEFAULTS = {"maxIter": 30, "maxDepth": 5, "maxLeaves": 31, "stepSize": 0.05, "subsamplingRate": 1.0, "minInstancesPerNode": 20, "maxBins": 64, "lambda": 1.0, "seed": 42}
#: Trees between two writes of the margins, and (row, model) pairs of a task.
KEPT, PAIRS = 10, 400_000
MEMBERS = "array<struct<model:int,y:double,w:double>>"


class Forest:
    """Trees as lists (feature, edge, left, right, value), a leaf having feature -1; the margin is the sum of their leaves."""

    def __init__(self, trees: list | None = None, gains: dict | None = None):
        self.trees, self.gains = trees or [], defaultdict(float, gains or {})

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, edge, left, right, value in self.trees:
            total += np.array(value)[_leaf(x, np.array(feature), np.array(edge), np.array(left), np.array(right))]
        return total

    def dump(self) -> str:
        return json.dumps({"trees": self.trees, "gains": list(self.gains.items())})

    @classmethod
    def load(cls, text: str) -> "Forest":
        saved = json.loads(text)
        return cls(saved["trees"], dict(saved["gains"]))


def _leaf(x: np.ndarray, feature, edge, left, right) -> np.ndarray:
    """The node at which each row ends; rows at or below an edge go left."""
    node = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = np.flatnonzero(feature[node] >= 0)
        if not len(inner):
            return node
        at = node[inner]
        node[inner] = np.where(x[rows[inner], feature[at]] <= edge[at], left[at], right[at])


def best_split(hist: np.ndarray, least: int, reg: float) -> tuple[int, int, float, np.ndarray, np.ndarray]:
    """(feature, bin, gain, sums left, sums right) of sums (feature, bin, [gradient, hessian, count]); the first of equal gains, feature -1 where nothing gains."""
    left = np.cumsum(hist, 1)[:, :-1]
    whole = hist[0].sum(0)
    right = whole - left
    score = lambda s: s[..., 0] ** 2 / (s[..., 1] + reg)
    gain = score(left) + score(right) - score(whole)
    gain[(left[..., 2] < least) | (right[..., 2] < least)] = -np.inf
    place = int(np.argmax(gain)) if gain.size else 0
    if not gain.size or not gain.flat[place] > 1e-12:
        return -1, 0, 0.0, whole, whole
    f, b = divmod(place, gain.shape[1])
    return f, b, float(gain[f, b]), left[f, b], right[f, b]


def _binned(rows: DataFrame, width: int, bins: int, parts: int) -> tuple[DataFrame, list[np.ndarray]]:
    """rows with features as bytes of bins, and the edges of each feature's bins."""
    at = [float(k) / bins for k in range(1, bins)]
    found = rows.agg(*(F.percentile_approx(F.get("x", F.lit(f)), at, 10_000).alias(f"e{f}") for f in range(width))).first()
    edges = [np.unique(np.array(e or [], float)) for e in found]

    def run(batches):
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            out = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1).astype(np.uint8) if width else np.zeros((len(x), 0), np.uint8)
            lists = b.column(1)
            start, flat = lists.offsets, lists.flatten()
            part = lambda c: pa.ListArray.from_arrays(start, flat.field(c))
            margin = pa.ListArray.from_arrays(start, pa.array(np.zeros(len(flat))))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([r.tobytes() for r in out], pa.binary()), *(part(c) for c in ("model", "y", "w")), margin], names=["uid", "x", "model", "y", "w", "m"])

    keyed = rows.select("x", "members", F.xxhash64("x", "members").alias("uid")).repartition(parts)
    return cut(keyed.mapInArrow(run, _ROW)), edges


_ROW = "uid long, x binary, model array<int>, y array<double>, w array<double>, m array<double>"


class _Pairs:
    """The (row, model) pairs of a batch."""

    def __init__(self, b: pa.RecordBatch, width: int):
        self.uid, lists = b.column(0).to_numpy(), b.column(2)
        self.x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, width)
        self.row = np.repeat(np.arange(b.num_rows), np.diff(lists.offsets.to_numpy()))
        self.model = lists.flatten().to_numpy()
        self.y, self.w, self.m = (b.column(k).flatten().to_numpy() for k in (3, 4, 5))

    def margins(self, trees: dict) -> np.ndarray:
        """Of all pairs: the stored margin and what the trees (by model) add to it."""
        out = self.m.copy()
        for k in np.unique(self.model):
            mine = np.flatnonzero(self.model == k)
            x = self.x[self.row[mine]]
            for feature, bin_, left, right, value in trees.get(int(k), ()):
                out[mine] += value[_leaf(x, feature, bin_, left, right)]
        return out


def _kept(uid: np.ndarray, model: int, tree: int, rate: float, seed: int) -> np.ndarray:
    """Which rows a tree sees: a hash of the row, the model and the tree."""
    h = uid.astype(np.uint64) ^ np.uint64((seed * 1_000_003 + model * 7919 + tree * 104_729) % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((h >> np.uint64(11)).astype(np.float64) / (1 << 53)) < rate


_SPLIT = "model int, slot int, feature int, bin int, gain double, sums array<double>"


def _level(rows: DataFrame, parts: int, width: int, bins: int, trees: dict, growing: dict, fronts: dict, number: int, p: dict) -> list:
    """The best split of each node in fronts (model: nodes) of the trees that grow. One job."""

    def chosen(model, slot, hist):
        f, b, gain, left, right = best_split(hist, p["minInstancesPerNode"], p["lambda"])
        return model, slot, f, b, gain, [*left.tolist(), *right.tolist()]

    def split_batch(rows):
        columns = list(zip(*rows)) or [()] * 6
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["model", "slot", "feature", "bin", "gain", "sums"])

    def summed(batches):
        total = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            a = _Pairs(batch, width)
            margin = a.margins(trees)
            prob = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
            g, h = a.w * (prob - a.y), a.w * prob * (1 - prob)
            for k, nodes in fronts.items():
                mine = np.flatnonzero(a.model == k)
                if p["subsamplingRate"] < 1:
                    mine = mine[_kept(a.uid[a.row[mine]], k, number, p["subsamplingRate"], p["seed"])]
                x = a.x[a.row[mine]]
                slot_of = np.full(len(growing[k][0]), -1)
                slot_of[nodes] = np.arange(len(nodes))
                slot = slot_of[_leaf(x, *growing[k][:4])]
                mine, x, slot = mine[slot >= 0], x[slot >= 0], slot[slot >= 0]
                place = ((slot[:, None] * width + np.arange(width)) * bins + x).ravel()
                size = len(nodes) * width * bins
                sums = [np.bincount(place, np.repeat(v, width), size) for v in (g[mine], h[mine], np.ones(len(mine)))]
                total[k] = total.get(k, 0) + np.stack(sums, 1).reshape(len(nodes), width, bins, 3)
        return total

    if parts == 1:

        def run(batches):
            yield split_batch([chosen(k, s, hist) for k, each in summed(batches).items() for s, hist in enumerate(each)])

        return rows.mapInArrow(run, _SPLIT).collect()

    def sums(batches):
        for k, each in summed(batches).items():
            for s, hist in enumerate(each):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s], pa.int32()), pa.array([hist.tobytes()], pa.binary())], names=["model", "slot", "hist"])

    def best(key, table):
        hist = sum(np.frombuffer(x, np.float64).reshape(width, bins, 3) for x in table["hist"].to_pylist())
        return pa.Table.from_batches([split_batch([chosen(key[0].as_py(), key[1].as_py(), hist)])])

    return rows.mapInArrow(sums, "model int, slot int, hist binary").groupBy("model", "slot").applyInArrow(best, _SPLIT).collect()


def fit(rows: DataFrame, params: dict | None = None) -> dict[int, Forest]:
    """A forest for each model of rows (x array<double>, members array<(model, y, w)>): y 1 or 0, log loss; a model whose targets are all one has a forest without splits."""
    p = {**DEFAULTS, **(params or {})}
    rows = cut(rows.select("x", F.col("members").cast(MEMBERS).alias("members")).where(F.size("members") > 0))
    each = rows.select(F.explode("members.model").alias("model")).groupBy("model").count().collect()
    if not each:
        return {}
    width, bins = rows.select(F.size("x")).first()[0], p["maxBins"]
    parts = max(1, -(-sum(r["count"] for r in each) // PAIRS))
    binned, edges = _binned(rows, width, bins, parts)
    forests, recent = {r.model: Forest() for r in each}, {r.model: [] for r in each}
    for number in range(p["maxIter"]):
        # a tree under growth: lists of feature, bin, left, right and value by node
        grown = {k: [[-1], [0], [0], [0], [0.0]] for k in forests}
        fronts = {k: [0] for k in forests}
        for depth in range(p["maxDepth"]):
            asked = {k: nodes for k, nodes in fronts.items() if nodes}
            if not asked:
                break
            trees = {k: [tuple(map(np.array, t)) for t in ts] for k, ts in recent.items()}
            found = _level(binned, parts, width, bins, trees, {k: tuple(map(np.array, grown[k])) for k in asked}, asked, number, p)
            fronts = {k: [] for k in forests}
            for r in sorted(found, key=lambda r: (r.model, -r.gain, r.slot)):
                feature, bin_, left, right, value = grown[r.model]
                node, (gl, hl, _, gr, hr, _) = asked[r.model][r.slot], r.sums
                leaf = lambda g, h: -p["stepSize"] * g / (h + p["lambda"])
                if r.feature < 0 or feature.count(-1) >= p["maxLeaves"]:
                    if node == 0 and r.feature < 0:
                        value[0] = leaf(gl, hl)
                    continue
                feature[node], bin_[node], left[node], right[node] = r.feature, r.bin, len(feature), len(feature) + 1
                for g, h in ((gl, hl), (gr, hr)):
                    for column, v in zip(grown[r.model], (-1, 0, 0, 0, leaf(g, h))):
                        column.append(v)
                fronts[r.model] += [left[node], right[node]]
                forests[r.model].gains[r.feature] += r.gain
        for k, (feature, bin_, left, right, value) in grown.items():
            recent[k].append(grown[k])
            edge = [float(edges[f][b]) if f >= 0 else 0.0 for f, b in zip(feature, bin_)]
            forests[k].trees.append([feature, edge, left, right, value])
        if (number + 1) % KEPT == 0 and number + 1 < p["maxIter"]:
            binned, recent = cut(_advanced(binned, width, recent)), {k: [] for k in forests}
    return forests


def _advanced(binned: DataFrame, width: int, recent: dict) -> DataFrame:
    """binned with margins that hold the recent trees."""
    trees = {k: [tuple(map(np.array, t)) for t in ts] for k, ts in recent.items()}

    def run(batches):
        for b in batches:
            margin = _Pairs(b, width).margins(trees)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(5)), pa.ListArray.from_arrays(b.column(2).offsets, pa.array(margin))], names=b.schema.names)

    return binned.mapInArrow(run, _ROW)


def probability(forests: dict[int, Forest], model: Column, x: Column) -> Column:
    """The probability of target 1 by the model that a row names; null where there is no such model."""

    @pandas_udf("double")
    def run(names: pd.Series, values: pd.Series) -> pd.Series:
        out = np.full(len(names), np.nan)
        each = names.to_numpy()
        for k in pd.unique(names.dropna()):
            if int(k) in forests:
                mine = np.flatnonzero(each == k)
                margin = forests[int(k)].margin(np.stack(values.iloc[mine].to_numpy()).astype(float))
                out[mine] = 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
        return pd.Series(out).where(~np.isnan(out), None)

    return run(model, x)


def save(forest: Forest, spark: SparkSession, path: str) -> None:
    spark.createDataFrame([(forest.dump(),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load(spark: SparkSession, path: str) -> Forest:
    return Forest.load(spark.read.text(path, wholetext=True).first()[0])
