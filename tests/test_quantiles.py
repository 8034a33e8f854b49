"""Percentile sketches against sorted values."""

import numpy as np
import pytest

from netseq.operators import quantiles

SHARES = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}


def frame(spark, values, groups=1):
    return spark.createDataFrame([(i % groups, v) for i, v in enumerate(values)], "g int, v double")


def wanted(values):
    """Values by rank; what is no finite number does not count."""
    ordered = sorted(v for v in values if v is not None and np.isfinite(v))
    return [ordered[int(np.floor(q * (len(ordered) - 1)))] for q in SHARES.values()]


@pytest.mark.parametrize("accuracy", [0.01, 0.2])
def test_relative_error(spark, accuracy):
    rng = np.random.default_rng(5)
    values = [*np.exp(rng.normal(0, 6, 700)), *-np.exp(rng.normal(0, 3, 300)), 0.0, -0.0, 5e-324, 1.7e308]
    values += [None, float("nan"), float("inf"), float("-inf")]
    df = frame(spark, [None if v is None else float(v) for v in values])
    got = quantiles.percentiles(quantiles.sketch(df, "v", accuracy=accuracy), SHARES, accuracy=accuracy).first()
    assert list(got) == pytest.approx(wanted(values), rel=accuracy * 1.001)


def test_merged_sketches_are_the_whole(spark):
    values = [float(v) for v in np.random.default_rng(6).lognormal(0, 2, 500)]
    df = frame(spark, values, 7)
    parts = [quantiles.sketch(df.filter(f"g % 2 = {i}"), "v") for i in (0, 1)]
    merged = quantiles.percentiles(parts[0].unionByName(parts[1]), SHARES)
    assert merged.collect() == quantiles.percentiles(quantiles.sketch(df, "v"), SHARES).collect()
    by = quantiles.percentiles(quantiles.sketch(df, "v", ["g"]), SHARES, ["g"]).collect()
    for row in by:
        assert list(row)[1:] == pytest.approx(wanted(values[row["g"] :: 7]), rel=0.0101)


@pytest.mark.parametrize("chunk_steps", [1, 3, 1_024])
def test_running(spark, chunk_steps):
    """Steps without values have no row; a step of null has no place; chunks may be empty."""
    rng = np.random.default_rng(7)
    rows = [(s, float(v)) for s in [0, 1, 2, 9, 10, 17] for v in rng.lognormal(0, 2, int(rng.integers(1, 9)))]
    df = spark.createDataFrame([*rows, (None, 5.0), (4, None)], "step int, v double")
    steps = quantiles.sketch(df, "v", ["step"])
    got = quantiles.running_percentiles(steps, 18, SHARES, chunk_steps=chunk_steps).orderBy("step").collect()
    assert [r["step"] for r in got] == [0, 1, 2, 9, 10, 17]
    for r in got:
        assert list(r)[1:] == pytest.approx(wanted([v for s, v in rows if s <= r["step"]]), rel=0.0101)


def test_nothing_to_count(spark):
    df = frame(spark, [None, float("nan")])
    assert quantiles.percentiles(quantiles.sketch(df, "v"), SHARES).collect() == []
    assert quantiles.percentiles(quantiles.sketch(df, "v", ["g"]), SHARES, ["g"]).collect() == []
    assert quantiles.running_percentiles(quantiles.sketch(df, "v", ["g"]), 1, SHARES, step="g").collect() == []
    with pytest.raises(ValueError):
        quantiles.percentiles(df, {"p": 1.5})
    with pytest.raises(ValueError):
        quantiles.sketch(df, "v", accuracy=0.0)
