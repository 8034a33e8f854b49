"""Trained experiments against plain logistic regression, and the ledger of runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netseq import session
from netseq.operators import trained
from netseq.operators.order import index_by_keys
from netseq.operators.run_ledger import RunLedger
from netseq.session import staging_path

WINDOW = 4


def table(spark, n=360):
    rng = np.random.default_rng(3)
    y = rng.random(n) < 0.4
    v, w = rng.normal(0, 20, n) + 30 * y, rng.exponential(50, n)
    c = rng.integers(0, 3, n)
    rows = [(i, bool(y[i]), float(v[i]), float(w[i]), f"c{c[i]}") for i in range(n)]
    return index_by_keys(spark.createDataFrame(rows, "k int, y boolean, v double, w double, c string"), ["k"]), v, w, y, c


def pooled(v, w):
    """Means, then last values, of the signed logarithms."""
    logs = np.stack([np.sign(x) * np.log1p(np.abs(x)) for x in (v, w)], axis=1)
    means = np.stack([logs[i - WINDOW + 1 : i + 1].mean(axis=0) for i in range(WINDOW - 1, len(v))])
    return np.hstack([means, logs[WINDOW - 1 :]])


def logistic(x, y, strength):
    """Newton's method on standardised features; the bias is not regularised."""
    spread = x.std(axis=0, ddof=1)
    z = np.hstack([x / spread, np.ones((len(x), 1))])
    ridge = np.diag([strength] * x.shape[1] + [0.0])
    b = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) / len(z) + ridge, z.T @ (p - y) / len(z) + ridge @ b)
    return b[:-1] / spread, b[-1]


def cells(fit, x, y):
    hit = 1 / (1 + np.exp(-(x @ fit[0] + fit[1]))) > 0.5
    return int((hit & y).sum()), int((hit & ~y).sum()), int((~hit & ~y).sum()), int((~hit & y).sum())


def test_temporal_bias(spark):
    indexed, v, w, y, _ = table(spark)
    x, label, at = pooled(v, w), y[WINDOW - 1 :], np.arange(WINDOW - 1, 360)
    out = trained.temporal_bias(indexed, ["v", "w"], [0.5, 0.25, 0.01], WINDOW, [0.01, 0.3]).collect()
    assert {(r["fraction"], r["strength"]) for r in out} == {(f, s) for f in (0.5, 0.25) for s in (0.01, 0.3)}
    for r in out:
        m = int(360 * r["fraction"])
        fit = logistic(x[at < m], label[at < m], r["strength"])
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == cells(fit, x[at >= 360 - m], label[at >= 360 - m])


def test_transfer(spark):
    indexed, v, w, y, c = table(spark)
    x, label, kind = pooled(v, w), y[WINDOW - 1 :], c[WINDOW - 1 :]
    out = trained.transfer_matrix(indexed, ["v", "w"], "c", WINDOW).collect()
    assert len(out) == 9
    for r in out:
        home, away = kind == int(r["fit_on"][1]), kind == int(r["eval_on"][1])
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == cells(logistic(x[home], label[home], 0.01), x[away], label[away])


def test_odd_classes(spark):
    """Null is a class; a class of one label predicts it; no rows give no rows; too many fits are refused."""
    rows = [(i, i % 3 == 0, float("nan") if i % 7 == 0 else float(i), "b" if i % 2 else None) for i in range(40)]
    rows += [(i, True, 1.0, "one") for i in range(40, 60)]
    df = spark.createDataFrame(rows, "k int, y boolean, v double, c string")
    out = {(r["fit_on"], r["eval_on"]): r for r in trained.transfer_matrix(index_by_keys(df, ["k"]), ["v"], "c", 2).collect()}
    assert set(out) == {(a, b) for a in (None, "b", "one") for b in (None, "b", "one")}
    assert all(out["one", e]["TN"] == out["one", e]["FN"] == 0 for e in (None, "b", "one"))
    empty = index_by_keys(df.limit(0), ["k"])
    assert trained.transfer_matrix(empty, ["v"], "c", 2).collect() == []
    with pytest.raises(ValueError):
        trained.temporal_bias(empty, ["v"], [0.5], 2)
    with pytest.raises(ValueError):
        trained.train(df, {i: F.lit(True) for i in range(trained.MOST_FITS + 1)})


def test_stopped_plan_goes_on(spark):
    path, ran = staging_path(spark, "ledger"), []
    plan = [{"a": a, "b": b} for a in (1, 2) for b in ("x", "y")]

    def execute(settings, failing=None):
        ran.append(settings)
        if settings == failing:
            raise RuntimeError("lost")
        return spark.range(settings["a"]).select(F.col("id").alias("n"), F.lit(settings["b"]).alias("b"))

    ledger = RunLedger(spark, path, "n bigint, b string")
    assert ledger.results().collect() == []
    with pytest.raises(RuntimeError):
        ledger.work_off(plan, lambda s: execute(s, plan[2]))
    assert ledger.finished().count() == 2
    # what a broken attempt wrote is not read
    spark.range(9).select(F.col("id").alias("n"), F.lit("?").alias("b")).write.parquet(f"{ledger.data}/run=other/attempt=x")
    ran.clear()
    got = RunLedger(spark, path, "n bigint, b string").work_off([*plan, {"b": "y", "a": 1}], execute)
    assert ran == plan[2:]
    assert sorted((r["b"], r["n"]) for r in got.collect()) == [("x", 0), ("x", 0), ("x", 1), ("y", 0), ("y", 0), ("y", 1)]
    ran.clear()
    assert ledger.work_off(plan[:1], execute).count() == 1 and ran == []
    with pytest.raises(ValueError):
        ledger.work_off([{"a": 9}], lambda s: spark.range(1))


def test_windows_read_once_are_not_staged(spark, monkeypatch):
    """The same windows, staged or not; many rows are dealt to as many tasks as they need."""
    indexed, *_ = table(spark)
    want = sorted(tuple(map(str, r)) for r in trained.pooled_windows(indexed, ["v", "w"], WINDOW, ["c"]).collect())
    monkeypatch.setattr(trained, "stage", None)
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    plain = trained.pooled_windows(indexed, ["v", "w"], WINDOW, ["c"], staged=False)
    assert sorted(tuple(map(str, r)) for r in plain.collect()) == want
    plan = plain._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(__chunk" in plan and ", 18)" in plan


def test_given_weights_stage_no_windows(spark, small, monkeypatch):
    from netseq.plans import trained as plans

    monkeypatch.setattr(trained, "stage", None)
    assert plans.transfer_weights(spark, small).count() == 4
