"""Boosted trees of several models against a plain implementation."""

import numpy as np
import pytest

from barloom.operators import boosting as bt


def plain_fit(x, y, w, edges, p):
    """Trees of one model by brute force over all rows, features and edges."""
    margin, trees = np.zeros(len(y)), []
    score = lambda i: (w[i] * (prob[i] - y[i])).sum() ** 2 / ((w[i] * prob[i] * (1 - prob[i])).sum() + p["lambda"])
    for _ in range(p["maxIter"]):
        prob = 1 / (1 + np.exp(-margin))
        leaves, front = {(): np.arange(len(y))}, [()]
        for _ in range(p["maxDepth"]):
            options = []
            for path in front:
                i, best = leaves[path], None
                for f in range(x.shape[1]):
                    for e in edges[f]:
                        left = x[i, f] <= e
                        if min(left.sum(), (~left).sum()) < p["minInstancesPerNode"]:
                            continue
                        gain = score(i[left]) + score(i[~left]) - score(i)
                        if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                            best = gain, f, e
                if best:
                    options.append((best[0], path, best[1], best[2]))
            front = []
            for _, path, f, e in sorted(options, key=lambda o: -o[0]):
                if len(leaves) >= p["maxLeaves"]:
                    break
                i = leaves.pop(path)
                for side, part in ((0, i[x[i, f] <= e]), (1, i[x[i, f] > e])):
                    leaves[(*path, side)] = part
                    front.append((*path, side))
        for i in leaves.values():
            margin[i] -= p["stepSize"] * (w[i] * (prob[i] - y[i])).sum() / ((w[i] * prob[i] * (1 - prob[i])).sum() + p["lambda"])
        trees.append(len(leaves))
    return margin, trees


def data(n=400, d=4, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, d)), 2)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    y = np.where(rng.random(n) < 0.1, 1 - y, y)
    return x, y, rng.uniform(0.5, 2, (3, n)), rng.random((3, n)) < 0.8


@pytest.mark.parametrize("pairs", [400_000, 100])
@pytest.mark.parametrize("leaves", [31, 5])
def test_trees_of_three_models_of_brute_force(spark, monkeypatch, pairs, leaves):
    monkeypatch.setattr(bt, "PAIRS", pairs)
    monkeypatch.setattr(bt, "KEPT", 2)
    x, y, w, use = data()
    # the second model learns the opposite
    targets = [y, 1 - y, y]
    rows = [(x[i].tolist(), [(k, float(targets[k][i]), float(w[k][i])) for k in range(3) if use[k][i]]) for i in range(len(y))]
    df = spark.createDataFrame(rows, f"x array<double>, members {bt.MEMBERS}").repartition(4)
    p = {**bt.DEFAULTS, "maxIter": 5, "maxDepth": 3, "maxLeaves": leaves, "stepSize": 0.3, "minInstancesPerNode": 8, "maxBins": 16}
    forests = bt.fit(df, p)
    _, edges = bt._binned(df.where("size(members) > 0"), 4, 16, 1)
    assert sorted(forests) == [0, 1, 2]
    for k in range(3):
        i = np.flatnonzero(use[k])
        margin, trees = plain_fit(x[i], targets[k][i], w[k][i], edges, p)
        assert forests[k].margin(x[i]) == pytest.approx(margin, abs=1e-9)
        assert [t[0].count(-1) for t in forests[k].trees] == trees
        assert ((margin > 0) == (targets[k][i] > 0.5)).mean() > 0.8
    again = bt.Forest.load(forests[0].dump())
    assert (again.margin(x) == forests[0].margin(x)).all() and set(again.gains) <= {0, 1, 2, 3}


def test_probabilities_saved_models_and_odd_rows(spark, tmp_path):
    x, y, w, _ = data(200)
    rows = [(x[i].tolist(), [(7, float(y[i]), 1.0)]) for i in range(200)] + [(x[0].tolist(), [])]
    df = spark.createDataFrame(rows, f"x array<double>, members {bt.MEMBERS}")
    forests = bt.fit(df, {"maxIter": 3, "maxDepth": 2, "subsamplingRate": 0.7})
    bt.save(forests[7], spark, f"file://{tmp_path}/m")
    loaded = bt.load(spark, f"file://{tmp_path}/m")
    assert loaded.margin(x) == pytest.approx(forests[7].margin(x), abs=0)
    from pyspark.sql import functions as F

    got = df.limit(200).select("x", bt.probability({7: loaded}, F.lit(7), F.col("x")).alias("p"), bt.probability({7: loaded}, F.lit(8), F.col("x")).alias("none")).collect()
    assert all(r.none is None and r.p == pytest.approx(1 / (1 + np.exp(-loaded.margin(np.array([r.x]))[0]))) for r in got)
    one = bt.fit(df.select("x", F.transform("members", lambda m: F.struct(m["model"].alias("model"), F.lit(1.0).alias("y"), m["w"].alias("w"))).alias("members")), {"maxIter": 2})
    assert one[7].margin(x).min() > 0 and len(set(one[7].margin(x).round(12))) == 1
    assert bt.fit(df.where("false")) == {}
