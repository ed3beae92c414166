"""Positive-unlabelled learning: the risk, its gradients, the prior and the sums over all rows, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import quality_model as q


def plain_risk(model, p, u, prior):
    loss = lambda f: np.log1p(np.exp(-f))
    f_p, f_u = (model._forward(x)[2] for x in (p, u))
    positive, negative = prior * np.mean([loss(f) for f in f_p]), np.mean([loss(-f) for f in f_u]) - prior * np.mean([loss(-f) for f in f_p])
    return positive, negative


@pytest.mark.parametrize("prior", [0.2, 0.7, None])
@pytest.mark.parametrize("push", [0.0, 6.0])
def test_risk_and_gradients_of_plain_differences(prior, push):
    rng = np.random.default_rng(1)
    p, u = rng.normal(0.3, 1, (20, q.N_FEATURES)), rng.normal(-0.2, 1, (30, q.N_FEATURES))
    model = q.Model(np.zeros(q.N_FEATURES), np.ones(q.N_FEATURES))
    model.w[3] = model.w[3] + push
    # where unlabelled rows look more negative than the prior allows, the other branch is taken
    if push:
        u = p[:5] * 0 - 4
        model.w[2] = np.abs(model.w[2])
        model.w[0] = np.abs(model.w[0])

    def value():
        if prior is None:
            f_p, f_u = model._forward(p)[2], model._forward(u)[2]
            return 0.5 * np.log1p(np.exp(-f_p)).mean() + 0.5 * np.log1p(np.exp(f_u)).mean()
        positive, negative = plain_risk(model, p, u, prior)
        assert q.risk(model._forward(p)[2], model._forward(u)[2], prior) == pytest.approx((positive, negative))
        return positive + negative if negative >= 0 else -negative

    base, found = value(), model.gradients(p, u, prior)
    assert np.isfinite(base)
    for k in range(4):
        flat = model.w[k].reshape(-1)
        for i in rng.integers(0, flat.size, 6):
            was = flat[i]
            flat[i] = was + 1e-5
            up = value()
            flat[i] = was - 1e-5
            down = value()
            flat[i] = was
            assert found[k].reshape(-1)[i] == pytest.approx((up - down) / 2e-5, rel=1e-3, abs=1e-7)


@pytest.mark.parametrize("prior", [0.1, 0.4, 0.8])
def test_prior_of_a_known_mixture(prior):
    rng = np.random.default_rng(2)
    n = 20_000
    mixed = np.where(rng.random(n) < prior, rng.normal(2, 1, n), rng.normal(-2, 1, n))
    assert q.best_bin(q._bins(rng.normal(2, 1, 2000)), q._bins(mixed)) == pytest.approx(prior, abs=0.04)


def test_all_rows_count_and_the_mean_is_the_prior(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(1, 2, (9000, q.N_FEATURES)).astype("float32")
    feats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, features array<float>").repartition(5)
    n, mean, scale = q._moments(feats)
    assert n == 9000 and mean == pytest.approx(x.mean(0), abs=1e-4) and scale == pytest.approx(x.std(0) + 1e-3, abs=1e-4)
    model = q.Model(mean, scale)
    made = q._shifted(feats, model, 0.37)
    assert (1 / (1 + np.exp(-made.logit(x)))).mean() == pytest.approx(0.37, abs=0.01)
    # a round looks at every row: rows of one value more change the average
    same = q._round(feats, model, x[:50].astype(float), 0.4, 0, 0.01)
    other = q._round(feats.unionByName(feats.limit(3000).withColumn("features", F.transform("features", lambda v: v + 3))), model, x[:50].astype(float), 0.4, 0, 0.01)
    assert abs(same.w[2] - other.w[2]).max() > 1e-6


def test_labelled_ids_that_repeat(spark):
    rng = np.random.default_rng(4)
    good, bad = "the quick brown fox jumps over a lazy dog near the river bank. " * 4, "$$$ ### win win win $$$ "
    rows = [(i, good + str(rng.integers(1000))) if i % 4 else (i, bad * int(rng.integers(1, 9))) for i in range(300)]
    rows += [(1, good)] * 400 + [(None, bad), (None, None), (301, ""), (302, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 4 > 0)) for i in range(300)] + [(1, 1)] * 50 + [(None, 1), (5, None), (6, 7)], "doc_id long, quality int")
    got = q.classify(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    known = [r for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in known]) > 0.9
    for none in (labels.where("false"), labels.where("quality = 0")):
        assert {r.score for r in q.classify(docs, none).collect()} == {0.5}
    assert q.classify(docs.where("false"), labels).count() == 0
