"""Splits, labels, numeric and categorical preprocessing, assembly."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from netseq.operators import categorical, numeric, split
from netseq.operators.assemble import detach, preprocess
from netseq.operators.fit_state import FitState
from netseq.operators.masks import add_candidate_sets, add_label, selectable
from netseq.operators.order import ROW, Indexed
from netseq.operators.preprocessing import Preprocessing, StandardPreprocessing, fit
from netseq.operators.split import TRAIN
from netseq.spec import CategoricalFormat, EvalSampling, FlowSpec


def numbered(spark, n):
    return Indexed(spark.range(n).withColumnRenamed("id", ROW), n)


def evaluation_rows(df):
    return sorted(r[ROW] for r in df.filter(~F.col(TRAIN)).collect())


def column_frame(spark, train, evaluate=(), kind="double"):
    rows = [(i, v, i < len(train)) for i, v in enumerate([*train, *evaluate])]
    return spark.createDataFrame(rows, f"{ROW} long, c {kind}, {TRAIN} boolean")


def values(df, column="c"):
    return [r[column] for r in df.orderBy(ROW).collect()]


def test_last_rows(spark):
    assert evaluation_rows(split.split_last(numbered(spark, 10), 0.25)) == [8, 9]
    with pytest.raises(ValueError):
        split.split_last(numbered(spark, 10), 0.05)


@pytest.mark.parametrize("boundary", [10_000, 1])
def test_random_rows_are_exact_and_repeatable(spark, monkeypatch, boundary):
    monkeypatch.setattr(split, "BOUNDARY_ROWS", boundary)
    got = evaluation_rows(split.split_random(numbered(spark, 3000), 0.1, 8, 7))
    order = sorted(
        range(8, 3000), key=lambda i: (hashlib.md5(f"7:{i}".encode()).hexdigest()[:15], i)
    )
    assert got == sorted(order[:300])
    with pytest.raises(ValueError):
        split.split_random(numbered(spark, 10), 0.9, 8, 7)


@pytest.mark.parametrize("flags, want", [([0] * 6 + [1] * 4, [6, 7, 8, 9]), ([0] * 5 + [1] * 5, [3, 4])])
def test_flag_rows(spark, flags, want):
    rows = spark.createDataFrame([(i, f) for i, f in enumerate(flags)], f"{ROW} long, flag int")
    out = split.split_flag(Indexed(rows, 10), "flag", 2)
    assert "flag" not in out.columns and evaluation_rows(out) == want


def test_split_dispatch_and_errors(spark):
    indexed = numbered(spark, 50)
    assert len(evaluation_rows(split.split(indexed, EvalSampling.RANDOM_ROWS, 0.1))) == 5
    assert len(evaluation_rows(split.split(indexed, EvalSampling.LAST_ROWS, 0.1))) == 5
    with pytest.raises(ValueError):
        split.split(indexed, EvalSampling.FILTER_COLUMN)
    with pytest.raises(ValueError):
        split.split(indexed, EvalSampling.FILTER_COLUMN, test_column="nothing")


def test_leaks_against_brute_force(spark):
    df = split.split_random(numbered(spark, 400), 0.2, 8, 1)
    flags = [r[TRAIN] for r in df.orderBy(ROW).collect()]
    full = [i for i in range(7, 400) if flags[i]]
    leaky = [i for i in full if not all(flags[i - 7 : i + 1])]
    assert split.leak_audit(df, 400, 8).first().asDict() == {
        "train_windows": len(full),
        "leaky_windows": len(leaky),
    }


def test_labels_and_candidates(spark):
    rows = spark.createDataFrame([("0", 0), (None, 1), ("1", 2)], "c string, i int")
    assert [r["y"] for r in add_label(rows, "c", 0).orderBy("i").collect()] == [False, True, True]
    n = numbered(spark, 20)
    assert sorted(r[ROW] for r in n.df.filter(selectable(20, 8)).collect()) == [8, 9, 10, 11]
    df = split.split_last(n, 0.25).withColumn("y", F.col(ROW) % 2 == 0)
    sets = add_candidate_sets(df, 20, 2)
    pick = lambda c: sorted(r[ROW] for r in sets.filter(c).collect())
    assert pick("train_malicious") == [2, 4, 6, 8, 10, 12, 14]
    assert pick("train_benign") == [3, 5, 7, 9, 11, 13]
    assert pick("train_any") == list(range(15)) and pick("evaluation") == list(range(15, 20))


def test_sanitise(spark):
    dirty = [1.0, None, math.nan, math.inf, -math.inf, 1e9, 1.0000001e9, -1e9, -2e9]
    out = values(numeric.sanitise(column_frame(spark, dirty), ["c"]))
    assert out == [1.0, 0.0, 0.0, 0.0, 0.0, 1e9, 0.0, -1e9, 0.0]
    counted = numeric.nonfinite_counts(column_frame(spark, dirty), ["c"]).first()
    assert (counted["feature"], counted["nonfinite"]) == ("c", 4)


def test_scaling_rules(spark):
    constant = column_frame(spark, [5.0, 5.0, 5.0])
    assert values(numeric.scale(constant, numeric.fit_minmax(constant, ["c"]))) == [0.0] * 3
    df = column_frame(spark, [10.0, 15.0, 20.0], [9.5, 9.0, 7.0])
    fits = numeric.fit_minmax(df, ["c"])
    assert fits == {"c": (10.0, 10.0)}
    plain = values(numeric.scale(df, fits))
    assert plain[0] == 0.0 and plain[2] == 1.0
    assert plain[3] == pytest.approx(math.log(0.5) / math.log(11))
    assert plain[4] == -math.inf and math.isnan(plain[5])
    clipped = values(numeric.scale(df, fits, clip=True))
    assert clipped[3:5] == [0.0, 0.0] and math.isnan(clipped[5])


def test_top_levels_ties_and_unseen(spark):
    train = ["a", "a", "c", "c", "c", "b", "b", "b", None]
    df = column_frame(spark, train, ["z", None], "string")
    levels = categorical.fit_levels(df, ["c"], 2)
    assert levels == {"c": ["b", "c"]}
    assert values(categorical.encode(df, levels)) == [1, 1, 2, 2, 2, 1, 1, 1, 1, 1, 1]
    assert values(categorical.encode(df, levels, unseen_code=0)) == [0, 0, 2, 2, 2, 1, 1, 1, 0, 0, 0]


def test_ties_sort_by_native_type(spark):
    df = column_frame(spark, [10, 9, 9, 10, 100], kind="long").withColumn("t", F.col("c").cast("string"))
    df = df.withColumn("x", F.when(F.col("c") == 100, F.lit(math.nan)).otherwise(F.col("c").cast("double")))
    df = df.withColumn("b", F.col("c") > 50)
    levels = categorical.fit_levels(df, ["c", "t", "x", "b"], 9)
    assert levels == {"c": [9, 10, 100], "t": ["10", "9", "100"], "x": [9.0, 10.0], "b": [0, 1]}


def test_encoding_by_join_equals_constants(spark, monkeypatch):
    df = column_frame(spark, list(range(40)) * 2, [77, None], "long")
    levels = categorical.fit_levels(df, ["c"], 30)
    plain = values(categorical.encode(df, levels, 0))
    monkeypatch.setattr(categorical, "LITERAL_LEVELS", 5)
    assert values(categorical.encode(df, levels, 0)) == plain


def test_rank_limit_prunes_before_the_shuffle(spark):
    df = column_frame(spark, [1, 2, 3], kind="long")
    plan = categorical.top_levels(df, ["c"], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def flows(spark, n=200):
    rng = np.random.default_rng(5)
    rows = [
        (i, float(rng.normal()), float(rng.integers(0, 9)), int(rng.integers(0, 4)), "xyz"[i % 3])
        for i in range(n)
    ]
    return Indexed(spark.createDataFrame(rows, f"{ROW} long, a double, `b/s` double, port int, label string"), n)


SPEC = FlowSpec(["a", "b/s", "port"], ["port"], "label", "x")


@pytest.mark.parametrize("kind", list(CategoricalFormat))
def test_preprocess_shapes_and_fit_ignores_evaluation_rows(spark, kind):
    indexed = flows(spark)
    df = split.split_last(indexed, 0.2)
    done = preprocess(df, SPEC, StandardPreprocessing(3), kind)
    changed = df.withColumn("a", F.when(F.col(TRAIN), F.col("a")).otherwise(F.lit(1e6)))
    assert preprocess(changed, SPEC, StandardPreprocessing(3), kind).fitted == done.fitted
    assert done.df.columns == [ROW, TRAIN, "y_raw", *done.model_input.columns]
    if kind is CategoricalFormat.ONE_HOT:
        assert done.model_input.columns == ["a", "b/s", "port_1", "port_2", "port_3"]
        ones = done.df.select((F.col("port_1") + F.col("port_2") + F.col("port_3")).alias("s"))
        assert {r["s"] for r in ones.distinct().collect()} == {1}
    x, y, t = detach(done.df)
    assert x.columns == [ROW, *done.model_input.columns] and y.columns == [ROW, "y_raw"] and t.columns == [ROW, TRAIN]
    counts = {r["feature"]: r["levels"] for r in categorical.levels_per_feature(
        preprocess(df, SPEC, StandardPreprocessing(3)).df, ["port"]).collect()}
    assert counts == {"port": 3}


class ZScore(Preprocessing):
    """Standard scores; categories in value order."""

    name = "z"

    def numeric_statistics(self, column):
        return {"mean": F.avg(f"`{column}`"), "sd": F.stddev_pop(f"`{column}`")}

    def numeric_value(self, column, s):
        return (F.col(f"`{column}`") - s["mean"]) / s["sd"]

    def fit_levels(self, df, columns):
        return {c: [r[0] for r in df.filter(TRAIN).select(c).distinct().orderBy(c).collect()] for c in columns}

    def codes(self, df, levels):
        return categorical.encode(df, levels, 0)


def test_custom_preprocessing(spark):
    done = preprocess(split.split_last(flows(spark), 0.5), SPEC, ZScore())
    r = done.df.filter(TRAIN).agg(F.avg("a").alias("m"), F.stddev_pop("a").alias("s")).first()
    assert r["m"] == pytest.approx(0, abs=1e-9) and r["s"] == pytest.approx(1)
    assert done.fitted.levels == {"port": [0, 1, 2, 3]}


def test_fitted_transform_runs_on_a_stream(spark, tmp_path):
    """A frozen fit is a plain projection, so it also applies to arriving rows."""
    df = split.split_last(flows(spark), 0.2)
    fitted = fit(df, StandardPreprocessing(3), ["a"], ["port"])
    path = str(tmp_path / "in")
    df.write.parquet(path)
    stream = fitted.transform(spark.readStream.schema(df.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("arrived").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = spark.table("arrived").orderBy(ROW).select("a", "port").collect()
    assert got == fitted.transform(df).orderBy(ROW).select("a", "port").collect()


def test_float_precision_option(spark):
    df = split.split_last(flows(spark), 0.2)
    wide = preprocess(df, SPEC, StandardPreprocessing(3)).df.orderBy(ROW).collect()
    done = preprocess(df, SPEC, StandardPreprocessing(3), as_type="float")
    assert done.df.schema["a"].dataType.simpleString() == "float"
    narrow = done.df.orderBy(ROW).collect()
    assert [r["a"] for r in narrow] == pytest.approx([r["a"] for r in wide], abs=1e-6, nan_ok=True)


def test_finite_guard(spark):
    numeric.require_finite(column_frame(spark, [1.0, 2.0]), ["c"])
    with pytest.raises(ValueError, match="'c': 2"):
        numeric.require_finite(column_frame(spark, [1.0, math.nan, math.inf]), ["c"])


def test_scattered_evaluation_rows_are_warned_about(spark):
    with pytest.warns(UserWarning, match="context"):
        split.split(numbered(spark, 50), EvalSampling.RANDOM_ROWS, 0.1)


def test_training_rows(spark):
    from netseq.operators import order
    from netseq.session import staging_path
    from test_order import leaves

    path = staging_path(spark, "training")
    spark.range(0, 1000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    indexed = order.index_rows(spark.read.parquet(path), ["id"])
    rows = split.training_rows(indexed, 0.35)
    assert sorted(r["id"] for r in rows.collect()) == list(range(650))
    # the file index is a table of files too, so the planner is asked which files it reads
    assert max(x.selectedPartitions().totalNumberOfFiles() for x in leaves(rows)) == 7


def part_frame(spark, start, stop):
    rows = spark.range(start, stop).select(
        ((F.col("id") * 37) % 101 / 7).alias("v"),
        (F.col("id") * F.col("id") % 23).alias("k"),
        F.concat(F.lit("l"), F.col("id") % 9).alias("a level"),
        F.col("id").alias("part"),
        (F.col("id") % 10 < 8).alias(TRAIN),
    )
    return rows.withColumn("k", F.when(F.col("part") % 11 > 0, F.col("k")))


def test_a_fit_of_parts_equals_a_fit_of_the_whole(spark, tmp_path):
    state = FitState(spark, str(tmp_path / "state"))
    names = ["v"], ["k", "a level"], ["part"]
    cuts = [0, 300, 301, 301, 2000]  # one part has a single row, one has none
    standard = StandardPreprocessing(5)
    assert state.fitted(standard).levels == {} and state.cardinalities().collect() == []
    for i, (start, stop) in enumerate(zip(cuts, cuts[1:])):
        state.add(f"day-{i}", part_frame(spark, start, stop), *names)
        so_far = fit(part_frame(spark, 0, stop), standard, names[0], names[1])
        got = state.fitted(standard)
        assert (got.statistics, got.levels) == (so_far.statistics, so_far.levels)
        assert list(got.levels) == names[1]
    whole = part_frame(spark, 0, 2000)
    assert got.transform(whole).collect() == so_far.transform(whole).collect()
    distinct = whole.filter(TRAIN).select("part").distinct().count()
    found = {r["feature"]: r["distinct"] for r in state.cardinalities().collect()}
    assert found.keys() == {"part"} and abs(found["part"] - distinct) < 0.1 * distinct
    assert all(str(tmp_path) in f for f in state.levels(5).inputFiles())


def test_a_part_counts_once_and_only_when_committed(spark, tmp_path, monkeypatch):
    state, standard = FitState(spark, str(tmp_path / "state")), StandardPreprocessing(5)
    state.add("a", part_frame(spark, 0, 500), ["v"], ["k"])
    before = state.fitted(standard)
    with monkeypatch.context() as m:
        m.setattr(F, "current_timestamp", lambda: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            state.add("b", part_frame(spark, 500, 900), ["v"], ["k"])
    assert state.fitted(standard) == before
    state.add("a", part_frame(spark, 0, 500), ["v"], ["k"])
    assert state.fitted(standard) == before
    state.add("a", part_frame(spark, 500, 900), ["v"], ["k"])
    want = fit(part_frame(spark, 500, 900), standard, ["v"], ["k"])
    assert state.fitted(standard).levels == want.levels
    state.add("b", part_frame(spark, 900, 950), ["v"], ["part"])
    with pytest.raises(ValueError, match="agree"):
        state.add("c", part_frame(spark, 900, 950), ["k"], ["v"])
        state.fitted(standard)
    for name in ("", "a/b", "a b", "x=1"):
        with pytest.raises(ValueError):
            state.add(name, part_frame(spark, 0, 1), ["v"], ["k"])
    with pytest.raises(ValueError):
        state.add("d", part_frame(spark, 0, 1), ["no such"], [])
