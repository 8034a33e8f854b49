"""Quality figures, run logs, experiments."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netseq.functions.scalars import predicted_positive
from netseq.operators import experiments, runlog
from netseq.operators.masks import LABEL
from netseq.operators.metrics import RESULT_COLUMNS, class_counts, confusion, evaluate, rates
from netseq.operators.order import ROW, Indexed
from netseq.operators.pool import AverageHead, LastHead


def scored(spark, pairs):
    return spark.createDataFrame(pairs, "p double, y boolean")


def test_confusion_and_rates(spark):
    df = scored(spark, [(0.9, True), (0.8, True), (0.7, False), (0.2, True), (0.1, False), (0.5, False)])
    r = rates(confusion(df, predicted_positive(F.col("p")))).first()
    assert (r["TP"], r["FP"], r["TN"], r["FN"]) == (2, 1, 2, 1)
    assert (r["P"], r["N"], r["pred_P"], r["pred_N"]) == (3, 3, 3, 3)
    assert r["bal_acc"] == pytest.approx(2 / 3) and r["f1"] == pytest.approx(2 / 3)
    assert evaluate(df).columns == RESULT_COLUMNS
    assert class_counts(df).first().asDict() == {"P": 3, "N": 3}


def test_undefined_rates_are_zero(spark):
    r = rates(confusion(scored(spark, [(0.1, True), (math.nan, True), (None, True)]), predicted_positive(F.col("p")))).first()
    assert (r["TP"], r["FP"], r["FN"]) == (0, 0, 3)
    assert (r["precision"], r["f1"], r["specificity"], r["bal_acc"]) == (0.0, 0.0, 0.0, 0.0)
    empty = evaluate(scored(spark, [])).first()
    assert empty["P"] == 0 and empty["f1"] == 0.0


def test_results_by_group(spark):
    df = scored(spark, [(0.9, True), (0.1, True)]).withColumn("epoch", F.lit(3))
    assert evaluate(df, by=["epoch"]).columns == ["epoch", *RESULT_COLUMNS]


def replay(losses, patience, epochs=None):
    """The early-stop rule as a loop over steps."""
    best, waiting, out = 100.0, 0, []
    for epoch, steps in enumerate(losses):
        better = False
        for loss in steps:
            if loss < best:
                better, best = True, loss
        waiting = 0 if better else waiting + 1
        out.append((epoch, better, waiting, patience > 0 and waiting > patience))
    return out


def log_frame(spark, losses):
    rows = [(e, s, float(v)) for e, steps in enumerate(losses) for s, v in enumerate(steps)]
    return spark.createDataFrame(rows, "epoch int, step int, loss double")


@pytest.mark.parametrize("patience", [0, 1, 5])
def test_early_stopping_against_a_loop(spark, patience):
    rng = np.random.default_rng(patience)
    losses = [[x * 120 for x in rng.random(3)] for _ in range(40)]
    losses[5][1] = math.nan
    verdicts = runlog.epoch_verdicts(log_frame(spark, losses), 40, patience)
    got = [(r["epoch"], r["improved"], r["counter"], r["stop"]) for r in verdicts.orderBy("epoch").collect()]
    want = replay(losses, patience)
    assert got == want
    final = runlog.final_epoch(verdicts).first()
    stops = [e for e, _, _, stop in want if stop]
    assert final.asDict() == {"final_epoch": stops[0] if stops else 39, "stopped_early": bool(stops)}
    schedule = sorted(r["epoch"] for r in runlog.eval_schedule(verdicts, 39).collect())
    last = stops[0] if stops else 39
    assert schedule == sorted({e for e in (6, 39, last) if e <= last})


def test_small_early_stop(spark):
    verdicts = runlog.epoch_verdicts(log_frame(spark, [[5], [4], [4], [4], [3]]), 5, 1)
    assert [r["counter"] for r in verdicts.orderBy("epoch").collect()] == [0, 0, 1, 2, 0]
    assert runlog.final_epoch(verdicts).first()["final_epoch"] == 3


@pytest.mark.parametrize("steps", [1, 2, 5])
def test_elapsed_time(spark, steps):
    seconds = np.random.default_rng(2).random(20)
    rows = [(i, i // steps, i % steps, float(s)) for i, s in enumerate(seconds)]
    df = spark.createDataFrame(rows, "i long, epoch int, step int, seconds double")
    want, total = [], 0.0
    for i, s in enumerate(seconds):
        epoch, step = i // steps, i % steps
        if epoch > 0 or step > 0:
            total += s
            if epoch == 0 and step == 1:
                total *= 2
        want.append(total)
    got = [r["elapsed"] for r in runlog.elapsed(df, 20, "i").orderBy("i").collect()]
    assert got == pytest.approx(want)


def test_latency(spark):
    rows = [(s, r, (s + 1) * 0.1 + r * 0.01) for s in range(6) for r in range(3)]
    df = spark.createDataFrame(rows, "step int, repeat int, seconds double")
    got = runlog.latency_by_step(df, 6).orderBy("step").collect()
    every = [x[2] for x in rows]
    assert [r["running_mean_s"] for r in got] == pytest.approx([np.mean(every[: 3 * (s + 1)]) for s in range(6)])
    summary = runlog.latency_summary(df).first()
    assert summary["timings"] == 18 and summary["mean_s"] == pytest.approx(np.mean(every))


def table(spark, n=400):
    rng = np.random.default_rng(11)
    v = rng.random(n) * 50
    y = rng.random(n) < 0.4
    c = rng.integers(0, 3, n)
    rows = [(i, float(a), bool(b), int(k)) for i, (a, b, k) in enumerate(zip(v, y, c))]
    return Indexed(spark.createDataFrame(rows, f"{ROW} long, v double, {LABEL} boolean, c int").repartition(4), n), v, y, c


def scale(v, fitted):
    low, spread = fitted.min(), fitted.max() - fitted.min()
    shifted = v - low + 1
    with np.errstate(all="ignore"):
        return np.where(shifted >= 0, np.log(shifted) / np.log(spread + 1), np.nan)


def trailing(x, w=8):
    return np.array([x[i - w + 1 : i + 1].mean() if i >= w - 1 else np.nan for i in range(len(x))])


def cells(p, y, threshold=0.5):
    with np.errstate(invalid="ignore"):
        hit = p > threshold
    return (int((hit & y).sum()), int((hit & ~y).sum()), int((~hit & ~y).sum()), int((~hit & y).sum()))


def test_temporal_bias(spark):
    indexed, v, y, _ = table(spark)
    out = experiments.temporal_bias(indexed, "v", [0.5, 0.25, 0.1], 8, 0.7).collect()
    assert {r["fraction"]: r["gap"] for r in out} == {0.5: 0, 0.25: 200, 0.1: 320}
    for r in out:
        m = int(400 * r["fraction"])
        p = trailing(scale(v, v[:m]))
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == cells(p[-m:], y[-m:], 0.7)


def test_transfer_matrix(spark):
    indexed, v, y, c = table(spark)
    out = experiments.transfer_matrix(indexed, "v", "c", 8, 0.8).collect()
    assert len(out) == 9
    f1 = {}
    for r in out:
        p = trailing(scale(v, v[c == r["fit_on"]]))
        use = (c == r["eval_on"]) & (np.arange(400) >= 7)
        tp, fp, tn, fn = cells(p[use], y[use], 0.8)
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == (tp, fp, tn, fn)
        f1[r["fit_on"], r["eval_on"]] = 2 * tp / (2 * tp + fp + fn) if tp else 0.0
    for r in out:
        home = f1[r["fit_on"], r["fit_on"]]
        assert r["f1_change"] == pytest.approx(f1[r["fit_on"], r["eval_on"]] - home)


def test_drift(spark):
    indexed, v, y, c = table(spark)
    second = F.col("c") == 1
    mixed = experiments.drift_mix(indexed, second, 5)
    one, two = np.flatnonzero(c != 1), np.flatnonzero(c == 1)
    n = min(len(one), len(two))
    assert mixed.n_rows == n
    u = [int(hashlib.md5(f"5:{i}".encode()).hexdigest()[:15], 16) / 2**60 for i in range(n)]
    source = np.array([two[i] if u[i] < i / n else one[i] for i in range(n)])
    rows = mixed.df.orderBy(ROW).collect()
    assert [r["v"] for r in rows] == v[source].tolist()
    fit = experiments.before_drift_fit(indexed, "v", second)
    assert fit == pytest.approx((v[one].min(), v[one].max() - v[one].min()))
    p = trailing(scale(v[source], v[one]))
    got = experiments.drift_report(mixed, "v", fit, 8, 0.7).collect()
    tenth = np.arange(n) * 10 // n
    for r in got:
        use = (tenth == r["tenth"]) & (np.arange(n) >= 7)
        assert (r["TP"], r["FP"], r["TN"], r["FN"]) == cells(p[use], y[source][use], 0.7)
        assert r["second_rows"] == (c[source][use] == 1).sum()
    with pytest.raises(ValueError):
        experiments.drift_mix(indexed, F.col("c") == 99, 5)


def test_grid(spark):
    components = {"head": [LastHead(), AverageHead()], "other": [LastHead(), AverageHead(), LastHead()]}
    runs = experiments.grid(components)
    assert len(runs) == 6 and [r["head"].name for r in runs[:3]] == ["Last Token"] * 3
    plan = experiments.grid_table(spark.range(1), components)
    assert plan.columns == ["run", "head", "other"] and plan.count() == 6


def test_saved_logs(spark):
    from netseq.session import staging_path

    path = staging_path(spark, "logs")
    runlog.save_log(log_frame(spark, [[1, 2]]), "a", path)
    runlog.save_log(log_frame(spark, [[3]]), "b", path)
    assert {(r["run"], r["loss"]) for r in spark.read.parquet(path).collect()} == {("a", 1), ("a", 2), ("b", 3)}
