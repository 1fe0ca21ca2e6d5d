"""Learners, calibration and resampling against plain numpy."""

import numpy as np
import pytest

from promptsieve.operators import learn as LN


def newton(x, y, c):
    """Minimum of the summed logistic loss and |w|^2 / (2 c), the intercept without a penalty."""
    z = np.hstack([x, np.ones((len(x), 1))])
    penalty = np.diag([1 / c] * x.shape[1] + [0.0])
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        w -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + penalty, z.T @ (p - y) + penalty @ w)
    return w


@pytest.mark.parametrize("c", [1.0, 0.05])
def test_linear_probe_is_the_regularised_optimum(spark, c):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)) * [1.0, 3.0, 0.2]
    y = (rng.random(400) < 1 / (1 + np.exp(-(x @ [1.5, -0.4, 2.0] - 0.7)))).astype(int)
    rows = [(i, int(y[i]), x[i].tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "prompt_id long, is_malicious int, embedding array<double>")
    got = {r.prompt_id: (r.score, r.pred) for r in LN.linear_probe(frame.where("prompt_id < 300"), frame, c=c).collect()}
    w = newton(x[:300], y[:300], c)
    want = 1 / (1 + np.exp(-(x @ w[:3] + w[3])))
    assert len(got) == 400
    assert max(abs(got[i][0] - want[i]) for i in range(400)) < 1e-3
    assert all(got[i][1] == (want[i] > 0.5) for i in range(400) if abs(want[i] - 0.5) > 1e-3)


def pooled(scores, labels):
    """Distinct scores and the isotonic fit at each, by pooling adjacent violators."""
    points = sorted(set(scores))
    blocks = []  # [sum, weight, points]
    for s in points:
        own = [y for x, y in zip(scores, labels) if x == s]
        blocks.append([sum(own), len(own), 1])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return points, [b[0] / b[1] for b in blocks for _ in range(b[2])]


def test_calibration_equals_pooled_adjacent_violators(spark):
    rng = np.random.default_rng(8)
    scores = np.round(rng.random(600), 2).tolist()  # many ties
    labels = [int(rng.random() < s ** 2) for s in scores]
    rows = [(i, scores[i], labels[i], i % 3) for i in range(600)]
    frame = spark.createDataFrame(rows, "prompt_id long, score double, is_malicious int, fold int")
    got = {r.prompt_id: r.calibrated for r in LN.Calibrator.fit(frame).transform(frame).collect()}
    fits = [pooled(*zip(*((s, y) for _, s, y, f in rows if f != k))) for k in range(3)]
    for i, s, _, _ in rows:
        assert got[i] == pytest.approx(np.mean([np.interp(s, *fit) for fit in fits]), abs=1e-9)


def test_bootstrap_of_cells_equals_resampling_pairs(spark):
    tp, fp, tn, fn = 160, 40, 560, 140
    cells = spark.createDataFrame([(tp, fp, tn, fn)], "tp long, fp long, tn long, fn long")
    row = LN.bootstrap_interval(cells, draws=2000).first()
    label = np.repeat([1, 0, 0, 1], [tp, fp, tn, fn])
    pred = np.repeat([1, 1, 0, 0], [tp, fp, tn, fn])
    rng = np.random.default_rng(1)
    values = []
    for _ in range(2000):
        at = rng.integers(len(label), size=len(label))
        values.append((pred[at][label[at] == 1].mean() + (1 - pred[at][label[at] == 0]).mean()) / 2)
    low, high = np.quantile(values, [0.025, 0.975])
    assert row.low == pytest.approx(low, abs=0.006) and row.high == pytest.approx(high, abs=0.006)
    assert LN.bootstrap_interval(cells, draws=2000).first() == row


def test_models_score_in_a_session_that_registered_an_observation(spark):
    from pyspark.sql import Observation
    from pyspark.sql import functions as F

    seen = Observation()
    assert spark.range(3).observe(seen, F.count(F.lit(1)).alias("n")).count() == 3 and seen.get == {"n": 3}
    rows = [(i, i % 2, [float(i % 2), float(i % 7)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "prompt_id long, is_malicious int, embedding array<double>")
    assert LN.linear_probe(frame, frame).where("pred = is_malicious").count() == 60
    vectors = LN.assemble(frame.select("prompt_id", "is_malicious", F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b")), ["a", "b"])
    model = LN.fitted(LN.forest(3, 3), vectors)
    assert not model.hasSummary and LN._scored(model, vectors, "score").where("(score > 0.5) = (is_malicious = 1)").count() == 60
