"""Dataset specs, readers, artifacts, and whole studies."""

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.feather as pf
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netseq.operators.encode import CategoryEmbed, ConcatEncoding
from netseq.operators.order import ROW
from netseq.operators.pool import AverageHead, FlattenHead, LastHead
from netseq.operators.preprocessing import StandardPreprocessing
from netseq.operators.score import BasicTransformer, patterned_weights
from netseq.operators.split import TRAIN
from netseq.presets import PRESETS
from netseq.session import shared_folder, small_side, staging_path
from netseq.sources.artifacts import (
    Artifact,
    MemoryCache,
    artifact_key,
    identifier,
    key_text,
    load_artifact,
    load_or_build,
    load_records,
    save_artifact,
    save_records,
)
from netseq.sources import feather
from netseq.sources.feather import read_feather, write_feather
from netseq.sources.readers import read_csv, read_flows
from netseq.spec import CategoricalFormat, EvalSampling, FlowSpec, ModelInput, StudyParams
from netseq.study import FlowStudy

SPEC = FlowSpec(["a", "port"], ["port"], "label", "ok", test_column="is_test")


def pandas_flows(n=500):
    rng = np.random.default_rng(4)
    return pd.DataFrame(
        {
            "unused": rng.random(n),
            "a": rng.random(n) * 30,
            "port": rng.integers(0, 6, n),
            "label": np.where(rng.random(n) < 0.5, "ok", "bad"),
            "is_test": (rng.random(n) < 0.2).astype("int64"),
        }
    )


@pytest.mark.parametrize(
    "name, total, numeric, categorical",
    [
        ("cse_cic_ids_2018", 37, 28, 9),
        ("cse_cic_ids_2018_improved", 84, 73, 11),
        ("unified_flow_format", 37, 28, 9),
        ("mqtt", 29, 26, 3),
        ("nsl_kdd", 41, 34, 7),
    ],
)
def test_presets(name, total, numeric, categorical):
    spec = PRESETS[name]
    assert len(spec.include_fields) == total
    assert len(spec.numeric_fields) == numeric
    assert len(spec.categorical_fields) == categorical
    assert set(spec.categorical_fields) <= set(spec.include_fields)


def test_spec_checks(spark):
    with pytest.raises(ValueError):
        FlowSpec(["a", "label"], ["label"], "label", "ok")
    with pytest.raises(ValueError):
        FlowSpec(["a", "a"], [], "label", "ok")
    df = spark.createDataFrame([(1.0, "x", "ok")], "a double, port string, label string")
    SPEC.check(df)
    with pytest.raises(ValueError):
        SPEC.check(df.drop("a"))
    with pytest.raises(ValueError):
        SPEC.check(df.withColumn("a", F.lit("text")))
    assert SPEC.numeric_fields == ["a"]
    assert SPEC.columns() == ["a", "port", "label", "is_test"]


def check_rows(indexed, frame):
    got = indexed.df.orderBy(ROW).collect()
    assert [r[ROW] for r in got] == list(range(len(frame)))
    assert [r["a"] for r in got] == frame["a"].tolist()
    assert [r["port"] for r in got] == frame["port"].tolist()
    assert [r["label"] for r in got] == frame["label"].tolist()


def test_csv_keeps_file_order_over_splits(spark, tmp_path):
    frame = pandas_flows()
    path = str(tmp_path / "Flows.CSV")
    frame.to_csv(path, index=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        indexed = read_flows(spark, path, SPEC)
        assert indexed.n_rows == len(frame)
        check_rows(indexed, frame)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(indexed.df.columns) == {"a", "port", "label", "is_test", ROW}
    check_rows(read_flows(spark, path, SPEC, n_rows=37), frame[:37])


def test_feather_file_by_batch(spark, tmp_path):
    frame = pandas_flows()
    frame["label"] = frame["label"].astype("category")
    path = str(tmp_path / "flows.feather")
    pf.write_feather(pa.Table.from_pandas(frame), path, chunksize=64)
    scan = read_feather(spark, path)
    assert scan.rdd.getNumPartitions() > 4 and scan.columns == list(frame.columns)
    check_rows(read_flows(spark, path, SPEC), frame)
    check_rows(read_flows(spark, path, SPEC, n_rows=100), frame[:100])


def test_feather_folder_round_trip(spark, tmp_path):
    frame = pandas_flows()
    path = str(tmp_path / "out.feather")
    df = spark.createDataFrame(frame.reset_index(names="i")).repartitionByRange(4, "i").sortWithinPartitions("i")
    write_feather(df, path)
    names = sorted(p.name for p in (tmp_path / "out.feather").iterdir())
    assert names == [f"part-{i:010d}.feather" for i in range(4)]
    check_rows(read_flows(spark, path, SPEC), frame)
    with pytest.raises(Exception, match="already holds"):
        write_feather(df, path)
    with pytest.raises(Exception, match="no feather file"):
        read_feather(spark, str(tmp_path / "nothing.feather")).count()


def test_parquet_and_frames(spark, tmp_path):
    frame = pandas_flows()
    path = str(tmp_path / "flows.parquet")
    frame.reset_index(names="i").to_parquet(path)
    check_rows(read_flows(spark, path, SPEC), frame)
    by_key = FlowSpec(["a", "port"], ["port"], "label", "ok", order_by=["i"])
    check_rows(read_flows(spark, path, by_key), frame)
    shuffled = spark.createDataFrame(frame.reset_index(names="i")).repartition(5)
    check_rows(read_flows(spark, shuffled, by_key, n_rows=60), frame[:60])
    check_rows(read_flows(spark, frame, SPEC), frame)
    check_rows(read_flows(spark, frame, SPEC, n_rows=20), frame[:20])
    with pytest.raises(ValueError, match="order keys"):
        read_flows(spark, shuffled, SPEC)
    with pytest.raises(ValueError):
        read_flows(spark, str(tmp_path / "flows.txt"), SPEC)
    with pytest.raises(ValueError):
        read_flows(spark, 5, SPEC)


def test_csv_with_missing_column(spark, tmp_path):
    path = str(tmp_path / "x.csv")
    pandas_flows(5).drop(columns=["a"]).to_csv(path, index=False)
    with pytest.raises(ValueError):
        read_flows(spark, path, SPEC)


def test_artifact_key():
    assert key_text({"b": 1, "a": "x"}) == '{\n"a": "x",\n"b": 1\n}'
    digest = base64.b64encode(hashlib.sha1(b'{\n"a": "x",\n"b": 1\n}').digest()).decode()
    assert identifier({"b": 1, "a": "x"}) == digest.replace("+", "0").replace("=", "0").replace("/", "0")
    assert artifact_key("n", 5, {}, {}).startswith("n_5_")
    with pytest.raises(ValueError):
        artifact_key("", 0, {}, {})


def test_artifacts(spark):
    path = staging_path(spark, "artifact-test")
    spec = ModelInput(["a"], ["k"], [3], CategoricalFormat.ONE_HOT)
    df = spark.range(4).withColumnRenamed("id", ROW)
    calls = []

    def build():
        calls.append(1)
        return Artifact(df, spec)

    assert load_artifact(spark, f"{path}/key") is None
    first, second = load_or_build(spark, path, "key", build), load_or_build(spark, path, "key", build)
    assert len(calls) == 1 and first.model_input == spec == second.model_input
    assert second.df.count() == 4
    save_artifact(Artifact(df.limit(1), spec), f"{path}/key")
    assert load_artifact(spark, f"{path}/key").df.count() == 1 and second.df.count() == 4


def test_memory_cache_holds_one_entry(spark):
    cache, spec = MemoryCache(), ModelInput([], [], [], CategoricalFormat.INTEGERS)
    one, two = spark.range(3), spark.range(4)
    a = cache.get("a", lambda: Artifact(one, spec))
    assert cache.get("a", lambda: 1 / 0) is a and a.df.is_cached
    cache.get("b", lambda: Artifact(two, spec))
    assert not one.is_cached and two.is_cached
    cache.clear()
    assert not two.is_cached


def test_records(spark):
    path = staging_path(spark, "records")
    save_records(spark, [{"run": 1, "f1": 0.5}], path)
    save_records(spark, [{"run": 2, "f1": 0.75}], path)
    assert sorted((r["run"], r["f1"]) for r in load_records(spark, path).collect()) == [(1, 0.5), (2, 0.75)]


def test_broadcast_hint_follows_the_size(spark):
    df = spark.range(5)
    assert small_side(df, 10, limit=5) is df
    assert "broadcast" in small_side(df, 5, limit=5)._jdf.queryExecution().logical().toString().lower()


def test_shared_folder_comes_from_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == folder.rstrip("/")


def study(spark, encoding, head, **params):
    values = {"window_size": 4, "mlp_layer_sizes": (8,), **params}
    return FlowStudy(
        spark, StandardPreprocessing(3), encoding, BasicTransformer(1, 8, 2), head, StudyParams(**values)
    )


@pytest.mark.parametrize("sampling", list(EvalSampling))
def test_study(spark, sampling):
    frame = spark.createDataFrame(pandas_flows().reset_index(names="i"))
    spec = FlowSpec(["a", "port"], ["port"], "label", "ok", test_column="is_test", order_by=["i"])
    one = study(spark, ConcatEncoding(), FlattenHead())
    with pytest.raises(RuntimeError):
        one.build_model()
    cache = staging_path(spark, "study-cache")
    x = one.load_dataset("flows", frame, spec, cache_path=cache, sampling=sampling)
    assert x.columns == [ROW, "a", "port_1", "port_2", "port_3"]
    assert one.n_rows == 500
    again = study(spark, ConcatEncoding(), FlattenHead())
    again.load_dataset("flows", frame.limit(0), spec, cache_path=cache, sampling=sampling)
    assert again.n_rows == 500, "the saved table is reused"
    n_eval = one.table.filter(~F.col(TRAIN) & (F.col(ROW) >= 3)).count()
    scorer = one.build_model(patterned_weights(one.weight_shapes(), 0.7))
    result = one.evaluate(scorer, epoch=2).first()
    assert result["epoch"] == 2 and result["P"] + result["N"] == n_eval
    by_window = one.score(one.evaluation_windows(), scorer, ["y"])
    assert by_window.filter("p > 0.5").count() == result["pred_P"]
    if one.model.weight_shapes(one.width):
        with pytest.raises(ValueError, match="needs weights"):
            one.fit(batch_size=16, steps_per_epoch=3, epochs=1)
    given = patterned_weights(one.weight_shapes(), 0.7)
    _, outcome = one.fit(batch_size=16, steps_per_epoch=3, epochs=2, weights=given, iterations=3)
    log = outcome.train_results.collect()
    assert {r["epoch"] for r in log} == {0, 1} and {"accuracy", "elapsed"} <= set(outcome.train_results.columns)
    final = outcome.eval_results.collect()[-1]
    assert final["P"] + final["N"] == n_eval and final["epoch"] == outcome.final_epoch == 1
    timings = one.time(scorer, 8, n_steps=2, n_repeats=3)
    assert timings.count() == 6


@pytest.mark.parametrize("sequential", [False, True])
@pytest.mark.parametrize("ordered", [False, True])
def test_study_draw_modes(spark, ordered, sequential):
    frame = spark.createDataFrame(pandas_flows().reset_index(names="i"))
    spec = FlowSpec(["a", "port"], ["port"], "label", "ok", order_by=["i"])
    tables = {"port": [[0.1 * i, 0.2] for i in range(4)]}
    one = study(
        spark,
        CategoryEmbed("lookup", 2, tables),
        AverageHead(),
        ordered_within_window=ordered,
        sequential_draw=sequential,
    )
    one.load_dataset("flows", frame, spec, cache_path=staging_path(spark, "modes"))
    rows = one.training_windows(10, 3).collect()
    assert len(rows) == 30 and {len(r["win"]) for r in rows} == {4} and {len(v) for r in rows for v in r["win"]} == {3}
    assert sum(r["y"] for r in rows) == 15
    x = {r[ROW]: r["x"] for r in one.encoded().collect()}
    assert all(r["win"][-1] == x[r[ROW]] for r in rows)
    if ordered:
        assert all(r["win"] == [x[i] for i in range(r[ROW] - 3, r[ROW] + 1)] for r in rows)


def test_perceptron(spark):
    frame = spark.createDataFrame(pandas_flows().reset_index(names="i"))
    spec = FlowSpec(["a", "port"], ["port"], "label", "ok", order_by=["i"])
    one = study(spark, ConcatEncoding(), LastHead())
    one.load_dataset("flows", frame, spec, cache_path=staging_path(spark, "mlp"))
    weights = patterned_weights(one.weight_shapes())
    _, outcome = one.fit(batch_size=16, steps_per_epoch=2, epochs=3, hidden=[4], weights=weights)
    assert outcome.eval_results.count() == 1


def test_windows_of_chosen_rows(spark):
    frame = spark.createDataFrame(pandas_flows(60).reset_index(names="i"))
    spec = FlowSpec(["a", "port"], ["port"], "label", "ok", order_by=["i"])
    one = study(spark, ConcatEncoding(), LastHead())
    one.load_dataset("flows", frame, spec, cache_path=staging_path(spark, "ends"))
    ends = spark.createDataFrame([(10,), (59,)], f"{ROW} long")
    assert sorted(r[ROW] for r in one.windows_of(ends, 2).collect()) == [10, 59]


def test_memory_retention(spark, monkeypatch):
    monkeypatch.setattr(FlowStudy, "retain_in_memory", True)
    frame = spark.createDataFrame(pandas_flows(60).reset_index(names="i"))
    spec = FlowSpec(["a", "port"], ["port"], "label", "ok", order_by=["i"])
    one = study(spark, ConcatEncoding(), LastHead())
    one.load_dataset("flows", frame, spec, cache_path=staging_path(spark, "mem"))
    assert one.table.filter(TRAIN).count() == 48
    FlowStudy.memory.clear()


def test_csv_with_wrong_values_fails(spark, tmp_path):
    (tmp_path / "f.csv").write_text("a,label\n1.5,ok\noops,bad\n")
    types = T.StructType([T.StructField("a", T.DoubleType()), T.StructField("label", T.StringType())])
    with pytest.raises(Exception, match="MALFORMED_RECORD|FAILED_READ_FILE|oops"):
        read_csv(spark, f"{tmp_path}/f.csv", types).collect()
    (tmp_path / "g.csv").write_text('a,label\n1.5,"say ""ok"", then"\n')
    assert read_csv(spark, f"{tmp_path}/g.csv", types).first()["label"] == 'say "ok", then'


def test_artifact_after_a_broken_run(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias(ROW))
    spec = ModelInput(["a"], [], [], CategoricalFormat.INTEGERS)
    spark.range(1).write.parquet(f"{tmp_path}/k/table")  # left behind before the description
    (tmp_path / "k" / "model_input").mkdir()
    found = load_or_build(spark, str(tmp_path), "k", lambda: Artifact(df, spec))
    assert found.df.count() == 3 and found.model_input == spec


def test_feather_files_in_natural_order(spark, tmp_path):
    for i in (10, 9, 1):
        pf.write_feather(pa.table({"a": [float(i)]}), f"{tmp_path}/part-{i}.feather", compression="uncompressed")
    scan = feather.index_feather(spark, str(tmp_path), ["a"]).df.collect()
    assert [r["a"] for r in sorted(scan, key=lambda r: r["row_idx"])] == [1.0, 9.0, 10.0]
    places = read_feather(spark, str(tmp_path), ["a"], positions=True).collect()
    assert {(r[feather.FILE][-9:], r[feather.BATCH], r[feather.PLACE]) for r in places} == {(f"-{i}.feather"[-9:], 0, 0) for i in (1, 9, 10)}


def test_feather_ranges_read_the_batches_they_need(spark, tmp_path):
    """Footers are read by tasks, and a range hands the touched batches on, no others."""
    for i in range(12):
        pf.write_feather(pa.table({"a": range(i * 50, i * 50 + 50), "b": ["x"] * 50}), f"{tmp_path}/part-{i}.feather", chunksize=7)
    indexed = feather.index_feather(spark, str(tmp_path))
    assert indexed.n_rows == 600 and indexed.df.filter("a <> row_idx").count() == 0
    for start, stop in ((0, 1), (48, 103), (599, 600), (600, 600), (0, 600)):
        assert sorted(r["a"] for r in indexed.between(start, stop).collect()) == list(range(start, stop))
    read = indexed.narrow(48, 103)
    # files hold batches of 7 rows and one of 1: rows 42-48, 49, 50-99, 100-106
    assert sorted(r["a"] for r in read.collect()) == list(range(42, 107))

