"""Windows, batches, encodings, heads, scoring."""

import hashlib
import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from netseq.functions import vectors
from netseq.operators import batching
from netseq.operators.embed_table import TableEmbed
from netseq.operators.encode import VECTOR, CategoryEmbed, ConcatEncoding, EncodingChain, InputEncoding, RecordEmbed
from netseq.operators.masks import LABEL
from netseq.operators.order import ROW, Indexed, Ranked
from netseq.operators.pool import AverageHead, ClsHead, FeaturewiseHead, FlattenHead, LastHead
from netseq.operators.score import (
    BERT_SMALL,
    GPT_SMALL,
    BasicTransformer,
    Scorer,
    SequenceModel,
    load_weights,
    patterned_weights,
    score_flows,
    score_windows,
    time_scoring,
    weights_table,
)
from netseq.operators.split import TRAIN
from netseq.operators.windows import featurewise, long_form, ordered_windows, trailing_mean, windows_at
from netseq.spec import CategoricalFormat, ModelInput


# classes defined here travel to the tasks by value, as this module is not on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def series(spark, n=300, seed=1):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=n)
    rows = [(i, float(x), bool(i % 3 == 0), bool(i < n * 0.8)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, f"{ROW} long, v double, {LABEL} boolean, {TRAIN} boolean")
    return df.repartition(5), v


@pytest.mark.parametrize("window, chunk", [(8, 1000), (2, 7), (8, 7), (8, 64), (16, 15), (1, 10), (5, 4)])
def test_chunked_windows_equal_global_windows(spark, window, chunk):
    df, v = series(spark)
    got = ordered_windows(df, window, 300, ["v"], chunk_rows=chunk).collect()
    assert {r[ROW]: [f["v"] for f in r["win"]] for r in got} == {
        i: v[i - window + 1 : i + 1].tolist() for i in range(window - 1, 300)
    }
    means = trailing_mean(df, window, 300, {"m": "v"}, chunk_rows=chunk).collect()
    assert len(means) == 300 - window + 1
    for r in means:
        assert r["m"] == pytest.approx(v[r[ROW] - window + 1 : r[ROW] + 1].mean())


def test_chunk_must_cover_the_window(spark):
    with pytest.raises(ValueError):
        ordered_windows(series(spark)[0], 8, 300, ["v"], chunk_rows=6)


def test_chosen_ends(spark):
    df, v = series(spark)
    got = ordered_windows(df, 8, 300, ["v"], keep=[LABEL], ends=~F.col(TRAIN), first_end=240, chunk_rows=32)
    rows = got.collect()
    assert sorted(r[ROW] for r in rows) == list(range(240, 300))
    assert all([f["v"] for f in r["win"]] == v[r[ROW] - 7 : r[ROW] + 1].tolist() for r in rows)
    ends = spark.createDataFrame([(50, "a"), (50, "b"), (7, "c"), (3, "d")], f"{ROW} long, tag string")
    at = windows_at(ends, df, 8, ["v"], ["tag"], 4).collect()
    assert sorted((r[ROW], r["tag"]) for r in at) == [(7, "c"), (50, "a"), (50, "b")]
    assert all([f["v"] for f in r["win"]] == v[r[ROW] - 7 : r[ROW] + 1].tolist() for r in at)


def test_many_chosen_ends_read_only_their_blocks(spark, monkeypatch):
    import netseq.operators.windows as windows

    monkeypatch.setattr(windows, "BROADCAST_ROWS", 10)
    df, v = series(spark)
    ends = spark.createDataFrame([(i, i % 7) for i in range(0, 300, 9)], f"{ROW} long, tag long")
    out = windows_at(ends, df, 8, ["v"], ["tag"], 34)
    assert "LeftSemi" in out._jdf.queryExecution().executedPlan().toString()
    rows = out.collect()
    assert sorted(r[ROW] for r in rows) == list(range(9, 300, 9))
    assert all([f["v"] for f in r["win"]] == v[r[ROW] - 7 : r[ROW] + 1].tolist() for r in rows)


def test_no_single_partition_in_windows(spark):
    df, _ = series(spark)
    plan = trailing_mean(df, 8, 300, {"m": "v"})._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_featurewise_layout(spark):
    rows = [(i, float(i), 1 + i % 2, int(i % 3 == 0), int(i % 3 == 1), int(i % 3 == 2)) for i in range(6)]
    df = spark.createDataFrame(rows, f"{ROW} long, a double, k int, p_1 int, p_2 int, p_3 int")
    one_hot = ModelInput(["a"], ["p"], [3], CategoricalFormat.ONE_HOT)
    out = featurewise(ordered_windows(df, 3, 6, one_hot.columns), one_hot)
    assert out.select(*one_hot.feature_names).schema.simpleString() == one_hot.window_schema().simpleString()
    last = out.filter(f"{ROW} = 5").first()
    assert last["a"] == [3.0, 4.0, 5.0] and last["p"] == [[1, 0, 0], [0, 1, 0], [0, 0, 1]]
    codes = ModelInput(["a"], ["k"], [2], CategoricalFormat.INTEGERS)
    out = featurewise(ordered_windows(df, 3, 6, codes.columns), codes)
    assert out.filter(f"{ROW} = 2").first()["k"] == [1, 2, 1]
    assert one_hot.input_shapes(3) == {"a": (3, 1), "p": (3, 3)}
    long = long_form(ordered_windows(df, 3, 6, ["a"]), ["a"])
    assert long.count() == 12 and long.columns == ["end_idx", "pos", "a"]


def test_similar_names_do_not_collide():
    spec = ModelInput([], ["ICMP", "ICMP_TYPE"], [2, 1], CategoricalFormat.ONE_HOT)
    assert spec.feature_columns() == {"ICMP": ["ICMP_1", "ICMP_2"], "ICMP_TYPE": ["ICMP_TYPE_1"]}


def candidates(spark, n=600):
    df = spark.range(n).select(F.col("id").alias(ROW), (F.col("id") % 5 == 0).alias(LABEL))
    return Ranked(df, n, LABEL), {y: [i for i in range(n) if (i % 5 == 0) == y] for y in (True, False)}


def draw(tag, pool, n, step, seed):
    """Brute-force draw."""
    half = 1
    while 4**half < pool:
        half += 1
    out = []
    for j in range(4**half):
        left, right = divmod(j, 2**half)
        for turn in range(4):
            h = int(hashlib.md5(f"{seed}:{tag}:{step}:{turn}:{right}".encode()).hexdigest()[:15], 16)
            left, right = right, left ^ (h % 2**half)
        if left * 2**half + right < pool:
            out.append(left * 2**half + right)
        if len(out) == n:
            return out


@pytest.mark.parametrize("size", [16, 17, 100])
def test_random_batches(spark, size):
    ranked, ids = candidates(spark)
    rows = batching.random_batches(ranked, size, 4, 9).collect()
    n_mal = size // 2
    want = set()
    for step in range(4):
        for y, n, tag, base in [(True, n_mal, "malicious", 0), (False, size - n_mal, "benign", n_mal)]:
            ranks = draw(tag, len(ids[y]), n, step, 9)
            want |= {(step, base + s, y, ids[y][r]) for s, r in enumerate(ranks)}
    assert {tuple(r) for r in rows} == want and len(rows) == 4 * size


@pytest.mark.parametrize("pool", [5, 6, 16, 17, 100, 10**9])
def test_draws_follow_one_rule(spark, pool):
    """Different ranks at every size of the pool; the whole pool where all of it is asked for."""
    rows = batching.draws(spark, "t", pool, 5, 3, 1).collect()
    for step in range(3):
        mine = sorted((r["slot"], r["rank"]) for r in rows if r["step"] == step)
        assert [s for s, _ in mine] == list(range(5)) and [r for _, r in mine] == draw("t", pool, 5, step, 1)
    if pool == 5:
        assert sorted(r["rank"] for r in rows) == sorted([*range(5)] * 3)


def test_draws_cost_what_they_draw():
    assert batching.n_tries(10**12, 64) == batching.n_tries(10**6, 64) == 16 * 64 + 128


def test_sequential_batches(spark):
    ranked, ids = candidates(spark)
    rows = batching.sequential_batches(ranked, 20, 40).collect()
    want = set()
    for step in range(40):
        for y, base in [(True, 0), (False, 10)]:
            cursor = 0
            for _ in range(step):
                cursor = (cursor + 10) % (len(ids[y]) - 10)
            want |= {(step, base + s, y, i) for s, i in enumerate(ids[y][cursor : cursor + 10])}
    assert {tuple(r) for r in rows} == want


def test_too_few_candidates(spark):
    ranked, _ = candidates(spark, 20)
    with pytest.raises(ValueError):
        batching.random_batches(ranked, 10, 1, 1)
    ranked, _ = candidates(spark, 25)
    assert batching.random_batches(ranked, 10, 1, 1).count() == 10
    with pytest.raises(ValueError):
        batching.sequential_batches(ranked, 10, 1)


def test_sequential_batches_touch_few_chunks(spark):
    n = 50_000
    df = spark.range(n).select(F.col("id").alias(ROW), (F.col("id") % 2 == 0).alias(LABEL))
    ranked = Ranked(df, n, LABEL)
    wanted = spark.createDataFrame([(True, 5), (False, 9)], f"{LABEL} boolean, rank long")
    plan = ranked.at(wanted, 2)._jdf.queryExecution().executedPlan().toString()
    assert "LeftSemi" in plan


def test_random_context(spark):
    df, v = series(spark, 400)
    ranked = Ranked(df.filter(f"{TRAIN} and {ROW} >= 4 and {ROW} < 396").select(ROW, LABEL), 400, LABEL)
    chosen = batching.random_batches(ranked, 6, 3, 2)
    rows = batching.random_context(chosen, df, 400, 6, 3, 4, 2, ["v"]).collect()
    targets = {(r["step"], r["batch_pos"]): r[ROW] for r in chosen.collect()}
    training = [i for i in range(400) if i < 320]
    for step in range(3):
        ranks = draw("context", 320, 24, step, 2)
        for b in range(6):
            mine = {r["pos"]: r for r in rows if (r["step"], r["batch_pos"]) == (step, b)}
            assert mine[3][ROW] == targets[step, b]
            for p in range(3):
                assert mine[p][ROW] == training[ranks[b * 4 + p]]
                assert mine[p]["v"] == v[mine[p][ROW]]
    assert len(rows) == 3 * 6 * 4


def flow_vectors(spark):
    df = spark.createDataFrame([(0, 0.5, 1, 2), (1, -1.0, 2, 0)], f"{ROW} long, a double, k int, m int")
    return df, ModelInput(["a"], ["k", "m"], [2, 2], CategoricalFormat.INTEGERS)


def vector_of(df):
    return {r[ROW]: r[VECTOR] for r in df.collect()}


def test_encodings(spark):
    df, codes = flow_vectors(spark)
    assert vector_of(ConcatEncoding().apply(df, codes)) == {0: [0.5, 1.0, 2.0], 1: [-1.0, 2.0, 0.0]}
    weights = {"a": [[1.0, 2.0]], "k": [[10.0, 0.0], [20.0, 1.0]], "m": [[100.0, 5.0], [200.0, 6.0]]}
    record = RecordEmbed(2, weights, bias=[0.25, 0.5])
    assert vector_of(record.apply(df, codes)) == {0: [210.75, 7.5], 1: [19.25, -0.5]}
    assert vector_of(RecordEmbed(2, weights, bias=[9, 9], project=True).apply(df, codes))[0] == [210.5, 7.0]
    one_hot = ModelInput(["a"], ["k", "m"], [2, 2], CategoricalFormat.ONE_HOT)
    wide = df.select(
        ROW, "a", *[(F.col(c) == j).cast("int").alias(f"{c}_{j}") for c in ("k", "m") for j in (1, 2)]
    )
    assert vector_of(record.apply(wide, one_hot)) == vector_of(record.apply(df, codes))
    tables = {"k": [[1.0], [2.0]], "m": [[3.0], [4.0]]}
    dense = CategoryEmbed("dense", 1, tables, {"k": [0.5], "m": [0.25]})
    assert vector_of(dense.apply(df, codes)) == {0: [0.5, 1.5, 4.25], 1: [-1.0, 2.5, 0.25]}
    projection = CategoryEmbed("projection", 1, tables)
    assert vector_of(projection.apply(df, codes))[0] == [0.5, 1.0, 4.0]
    lookup = CategoryEmbed("lookup", 1, {"k": [[7.0], [8.0], [9.0]], "m": [[4.0], [5.0], [6.0]]})
    assert vector_of(lookup.apply(df, codes)) == {0: [0.5, 8.0, 6.0], 1: [-1.0, 9.0, 4.0]}
    assert (record.width(codes), dense.width(codes), ConcatEncoding().width(codes)) == (2, 3, 3)
    with pytest.raises(ValueError):
        CategoryEmbed("other", 1, tables)
    with pytest.raises(ValueError):
        dense.apply(wide, one_hot)


def test_wide_embeddings_by_matrix(spark, monkeypatch):
    import netseq.operators.encode as encode

    df, codes = flow_vectors(spark)
    one_hot = ModelInput(["a"], ["k", "m"], [2, 2], CategoricalFormat.ONE_HOT)
    wide = df.select(
        ROW, "a", *[(F.col(c) == j).cast("int").alias(f"{c}_{j}") for c in ("k", "m") for j in (1, 2)]
    )
    weights = {"a": [[1.0, 2.0]], "k": [[10.0, 0.0], [20.0, 1.0]], "m": [[100.0, 5.0], [200.0, 6.0]]}
    record = RecordEmbed(2, weights, bias=[0.25, 0.5])
    want = vector_of(record.apply(df, codes))
    monkeypatch.setattr(encode, "EXPRESSION_TERMS", 1)
    assert vector_of(record.apply(df, codes)) == want
    assert vector_of(record.apply(wide, one_hot)) == want


def test_literals_round_trip(spark):
    from netseq.functions.scalars import literal

    values = ["it's", "back\\slash", "\\'", "a\nb", "ü%_", "", 0.1, -1e-300, 1e22, float("inf"), 5, -(2**63) + 1, True]
    row = spark.range(1).select(*[F.expr(literal(v)) for v in values]).first()
    assert list(row) == values


def test_long_embedding_tables_are_joined(spark, monkeypatch):
    import netseq.operators.encode as encode

    df, codes = flow_vectors(spark)
    lookup = CategoryEmbed("lookup", 1, {"k": [[7.0], [8.0], [9.0]], "m": [[4.0], [5.0], [6.0]]})
    want = vector_of(lookup.apply(df, codes))
    monkeypatch.setattr(encode, "LITERAL_LEVELS", 1)
    assert vector_of(lookup.apply(df, codes)) == want


def weight_rows(spark, weights):
    rows = [(f, c, [float(x) for x in w]) for f, table in weights.items() for c, w in enumerate(table, 1)]
    return spark.createDataFrame(rows, "feature string, code int, w array<double>")


def test_weights_as_a_table_equal_weights_as_lists(spark, monkeypatch):
    """Same bits, with fractions, whether one chunk asks for all vectors or 500 ask through three levels."""
    import netseq.operators.embed_table as embed_table

    r = np.random.default_rng(5)
    rows = [(i, float(a), float(b), int(k), 1 if i % 3 else 2) for i, (a, b, k) in enumerate(
        zip(r.normal(size=500), r.normal(size=500), r.integers(0, 40, size=500)))]
    df = spark.createDataFrame(rows, f"{ROW} long, a double, `b c` double, k int, hot long")
    model_input = ModelInput(["a", "b c"], ["k", "hot"], [39, 2], CategoricalFormat.INTEGERS)
    weights = {"a": r.normal(size=(1, 3)), "b c": r.normal(size=(1, 3)), "k": r.normal(size=(39, 3)),
               "hot": r.normal(size=(2, 3)), "elsewhere": r.normal(size=(2, 3))}
    lists = {f: w.tolist() for f, w in weights.items()}
    want = vector_of(RecordEmbed(3, lists, bias=[0.1, 0.2, 0.3]).apply(df, model_input))
    beside = vector_of(CategoryEmbed("projection", 3, lists).apply(df, model_input))
    table = weight_rows(spark, weights)
    summed, concat = TableEmbed(3, table, bias=[0.1, 0.2, 0.3]), TableEmbed(3, table, concat=True)
    assert vector_of(summed.apply(df, model_input)) == want
    assert vector_of(concat.apply(df, model_input)) == beside
    assert (summed.width(model_input), concat.width(model_input)) == (3, 8)
    monkeypatch.setattr(embed_table, "ASKED_BYTES", 8 * 3 * 4)
    monkeypatch.setattr(embed_table, "FAN_OUT", 8)
    assert vector_of(summed.apply(df, model_input)) == want
    assert vector_of(concat.apply(df, model_input)) == beside


@pytest.mark.parametrize("concat", [False, True])
def test_table_embeddings_of_many_rows_are_dealt_to_more_tasks(spark, monkeypatch, concat):
    """The same vectors, with as many tasks in every shuffle as the rows need; null and repeated rows included."""
    import netseq.operators.embed_table as embed_table
    from netseq import session

    rows = [(i // 2 * 2, float(i % 5) if i % 7 else None, i % 11 if i % 3 else None) for i in range(400)]
    df = spark.createDataFrame(rows, f"{ROW} long, a double, k int")
    table = weight_rows(spark, {"a": [[1.0, 2.0]], "k": [[float(c), c / 8] for c in range(1, 11)]})
    model_input = ModelInput(["a"], ["k"], [10], CategoricalFormat.INTEGERS)
    embed = TableEmbed(2, table, concat=concat)
    monkeypatch.setattr(embed_table, "chunk_length", lambda *_: 10)
    monkeypatch.setattr(embed_table, "FAN_OUT", 8)
    want = sorted(map(str, embed.apply(df, model_input).collect()))
    monkeypatch.setattr(session, "TASK_ROWS", 20)
    out = embed.apply(df, model_input)
    assert sorted(map(str, out.collect())) == want and len(want) == 400
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    dealt = [line for line in plan.splitlines() if "RepartitionByExpression" in line]
    assert len(dealt) >= 6 and all(line.rstrip().endswith(", 20") for line in dealt)


def test_no_place_of_a_fetch_serves_more_than_its_share(spark, monkeypatch):
    import netseq.operators.embed_table as embed_table

    monkeypatch.setattr(embed_table, "FAN_OUT", 4)
    asked = spark.range(70).select(F.col("id").alias("place"), F.lit(0).alias("feature"), F.lit(1).cast("long").alias("code"))
    weights = spark.createDataFrame([(0, 1, [1.5]), (0, 2, [2.5])], "feature int, code long, w array<double>")
    found = embed_table.fetch(asked, weights, 70)
    assert sorted(tuple(r) for r in found.collect()) == [(i, 0, 1, [1.5]) for i in range(70)]
    joins = found._jdf.queryExecution().optimizedPlan().toString().count("Join Inner")
    assert joins == 4  # 70 places, 18, 5 and 2 groups of them


def test_odd_rows_of_table_embeddings(spark):
    table = weight_rows(spark, {"a": [[1.0]], "k": [[10.0], [20.0]]})
    model_input = ModelInput(["a"], ["k"], [2], CategoricalFormat.INTEGERS)
    schema = f"{ROW} long, a double, k int, feature string, code string, place string, w string"
    rows = [(0, 1.0, 0, "f", "c", "p", "w"), (1, 2.0, None, None, None, None, None), (2, None, 2, "", "", "", "")]
    rows += [(2, 0.5, 1, "", "", "", "")]
    got = TableEmbed(1, table).apply(spark.createDataFrame(rows, schema), model_input)
    assert got.columns == [ROW, "a", "k", "feature", "code", "place", "w", VECTOR]
    seen = sorted(([r[ROW], r["code"], *r[VECTOR]] for r in got.collect()), key=str)
    assert seen[:2] == [[0, "c", 1.0], [1, None, 2.0]]
    assert seen[2] == [2, "", 10.5] and np.isnan(seen[3][2])
    assert TableEmbed(1, table).apply(spark.createDataFrame([], schema), model_input).collect() == []
    for code, weights in ((3, table), (1, table.unionByName(table)), (1, weight_rows(spark, {"a": [[1.0]], "k": [[1.0, 2.0]]}))):
        bad = spark.createDataFrame([(0, 1.0, code)], f"{ROW} long, a double, k int")
        with pytest.raises(Exception, match="weight vector"):
            TableEmbed(1, weights).apply(bad, model_input).collect()
    with pytest.raises(ValueError):
        TableEmbed(2, table, bias=[1.0])
    with pytest.raises(ValueError):
        TableEmbed(1, table).apply(got, model_input)
    bare = ModelInput(["a"], [], [], CategoricalFormat.INTEGERS)
    assert sorted(r[VECTOR] for r in TableEmbed(1, table, concat=True).apply(got.drop(VECTOR).filter(f"{ROW} < 2"), bare).collect()) == [[1.0], [2.0]]


class Doubled(InputEncoding):
    name = "Doubled"

    def width(self, model_input):
        return model_input.width

    def apply(self, df, model_input):
        return df.withColumn(VECTOR, F.transform(VECTOR, lambda v: v * 2))


def test_encoding_chain(spark):
    df, codes = flow_vectors(spark)
    chain = EncodingChain((ConcatEncoding(), Doubled()))
    assert vector_of(chain.apply(df, codes))[0] == [1.0, 2.0, 4.0]
    assert chain.required_format is CategoricalFormat.ONE_HOT
    assert CategoryEmbed("lookup", 1, {}).required_format is CategoricalFormat.INTEGERS


HEADS = [FlattenHead(), FeaturewiseHead([0.5, -1.0], 0.25), FeaturewiseHead([0.5, -1.0], 9.0, project=True)]
HEADS += [AverageHead(), LastHead(), ClsHead()]


@pytest.mark.parametrize("head", HEADS, ids=lambda h: h.name)
def test_heads_column_and_array_forms_agree(spark, head):
    windows = np.array([[[1.0, 2.0], [3.0, 4.0]], [[0.0, -1.0], [5.0, 7.0]]])
    df = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(windows)], "i long, win array<array<double>>")
    before = head.before_column(F.col("win"), 2, 2)
    got = df.select("i", head.column(before, *head.model_shape(2, 2)).alias("v")).orderBy("i").collect()
    want = head.array(head.before_array(windows))
    assert np.allclose([r["v"] for r in got], want)
    assert want.shape[1] == head.output_width(*head.model_shape(2, 2))


def test_cls_token(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]],)], "win array<array<double>>")
    got = df.select(ClsHead().before_column(F.col("win"), 2, 2).alias("w")).first()["w"]
    assert got == [[1, 2, 0], [3, 4, 0], [0, 0, 1]]
    assert ClsHead().array(np.array([got])).tolist() == [[0, 0, 1]]


def loop_attention(x, source, w):
    """Attention written out for one window."""
    steps, heads, size = len(x), *w["query_b"].shape
    out = np.zeros((steps, x.shape[1])) + w["out_b"]
    for h in range(heads):
        q = x @ w["query_w"][:, h] + w["query_b"][h]
        k = source @ w["key_w"][:, h] + w["key_b"][h]
        v = source @ w["value_w"][:, h] + w["value_b"][h]
        for i in range(steps):
            e = np.array([np.dot(q[i], k[j]) / np.sqrt(size) for j in range(len(source))])
            p = np.exp(e) / np.exp(e).sum()
            out[i] += (p @ v) @ w["out_w"][h]
    return out


def loop_norm(x, scale, shift):
    return np.array([(r - r.mean()) / np.sqrt(r.var() + 1e-6) * scale + shift for r in x])


def loop_block(x, w, decoder):
    a = loop_attention(x, x, w)
    one = loop_norm(x + a, w["norm1_scale"], w["norm1_shift"])
    if decoder:
        one = loop_norm(one + loop_attention(one, x, w), w["norm2_scale"], w["norm2_shift"])
    f = np.maximum(one @ w["inner_w"] + w["inner_b"], 0) @ w["outer_w"] + w["outer_b"]
    f = f if decoder else np.maximum(f, 0)
    return loop_norm((one if decoder else a) + f, w["norm2_scale"], w["norm2_shift"])


@pytest.mark.parametrize("decoder", [False, True])
def test_blocks_against_loops(decoder):
    rng = np.random.default_rng(0)
    model = BasicTransformer(2, 5, 2, is_decoder=decoder)
    weights = {n: rng.normal(size=s) for n, s in model.weight_shapes(3).items()}
    windows = rng.normal(size=(4, 6, 3))
    got = model.transform(windows, weights)
    for x, y in zip(windows, got):
        for i in range(2):
            x = loop_block(x, {n[8:]: w for n, w in weights.items() if n.startswith(f"block_{i}_")}, decoder)
        assert np.allclose(x, y)


@pytest.mark.parametrize("model", [GPT_SMALL, BERT_SMALL], ids=lambda m: m.name)
def test_named_models_run(model):
    scorer = Scorer(model, LastHead(), (4,))
    scorer = scorer.with_weights(patterned_weights(scorer.weight_shapes(4, 3), 0.01))
    p = scorer.probabilities(np.random.default_rng(1).normal(size=(2, 4, 3)))
    assert p.shape == (2,) and ((p >= 0) & (p <= 1)).all()
    assert (model.n_layers, model.internal_size, model.n_heads) == (12, 768, 12)


def vectors_frame(spark, n=300):
    df, v = series(spark, n)
    return df.withColumn(VECTOR, F.array("v", F.col("v") * 2, F.lit(1.0))), np.stack([v, v * 2, np.ones(n)], 1)


@pytest.mark.parametrize("chunk", [None, 20, 1000])
def test_scoring_by_window_and_by_flow_agree(spark, chunk):
    df, x = vectors_frame(spark)
    scorer = Scorer(BasicTransformer(1, 4, 2), ClsHead(), (3,))
    scorer = scorer.with_weights(patterned_weights(scorer.weight_shapes(5, 3), 1.0))
    windows = ordered_windows(df, 5, 300, [VECTOR], keep=[LABEL]).withColumn("win", F.col("win")[VECTOR])
    one = score_windows(windows, scorer.probabilities, 5, 3, [ROW, LABEL])
    assert one.columns == [ROW, LABEL, "p"]
    want = scorer.probabilities(np.stack([x[i - 4 : i + 1] for i in range(4, 300)]))
    assert np.allclose([r["p"] for r in one.orderBy(ROW).collect()], want)
    two = score_flows(df, scorer.probabilities, 5, 300, 3, [LABEL], chunk_rows=chunk)
    rows = two.orderBy(ROW).collect()
    assert [r[ROW] for r in rows] == list(range(4, 300)) and np.allclose([r["p"] for r in rows], want)
    some = score_flows(df, scorer.probabilities, 5, 300, 3, ends=~F.col(TRAIN), first_end=240, chunk_rows=chunk)
    rows = some.orderBy(ROW).collect()
    assert [r[ROW] for r in rows] == list(range(240, 300)) and np.allclose([r["p"] for r in rows], want[236:])


class Shifted(SequenceModel):
    name = "Shifted"

    def transform(self, windows, weights):
        return windows + 1.0


def test_custom_model_and_plain_callable(spark):
    df, x = vectors_frame(spark, 40)
    scorer = Scorer(Shifted(), LastHead()).with_weights({"mlp_0_w": np.ones((3, 1)), "mlp_0_b": np.zeros(1)})
    p = score_flows(df, scorer.probabilities, 2, 40, 3).orderBy(ROW).collect()
    assert np.allclose([r["p"] for r in p], 1 / (1 + np.exp(-(x[1:] + 1).sum(1))))
    q = score_flows(df, lambda w: w[:, -1, 0], 2, 40, 3).orderBy(ROW).collect()
    assert np.allclose([r["p"] for r in q], x[1:, 0])


def test_weights_round_trip(spark):
    weights = patterned_weights(BasicTransformer(1, 3, 2).weight_shapes(2))
    loaded = load_weights(weights_table(spark, weights))
    assert loaded.keys() == weights.keys() and all(np.allclose(loaded[n], weights[n]) for n in weights)


def test_weights_limit(spark, monkeypatch):
    monkeypatch.setattr("netseq.operators.score.WEIGHT_LIMIT", 3)
    with pytest.raises(ValueError):
        load_weights(weights_table(spark, {"a": np.zeros(4)}))


def test_timing(spark):
    rows = [(s, [[0.0, 1.0], [2.0, 3.0]]) for s in range(3) for _ in range(4)]
    df = spark.createDataFrame(rows, "step long, win array<array<double>>")
    out = time_scoring(df, lambda w: w.sum(axis=(1, 2)), 2, 2, n_repeats=2).collect()
    assert sorted((r["step"], r["repeat"]) for r in out) == [(s, r) for s in range(3) for r in range(2)]
    assert all(r["seconds"] >= 0 for r in out)


def test_vector_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0],)], "x array<double>")
    assert df.select(vectors.dot(F.col("x"), [3.0, 4.0], 0.5)).first()[0] == 11.5


def labelled(spark, n, seed=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    rows = [(bool(a + b > 0), [float(a), float(b)]) for a, b in x]
    return spark.createDataFrame(rows, f"{LABEL} boolean, pooled array<double>")


@pytest.mark.parametrize("hidden", [(), (3,)])
def test_epoch_training(spark, hidden):
    from netseq.operators.train import train_epochs

    run = train_epochs(
        lambda e: labelled(spark, 200, e), [2, *hidden, 2], 4, 5, evaluate=lambda c, e: (e, c.model.weights.size)
    )
    assert [e for e, _ in run.evaluations] == [3] and run.final_epoch == 3
    losses = {e: [v for at, _, v, _, _ in run.log if at == e] for e in range(4)}
    assert losses[3][-1] < losses[0][0]
    times = [t for *_, t in run.log]
    assert times == sorted(times) and all(0 <= a <= 1 for _, _, _, a, _ in run.log)
    scored = run.classifier.score(labelled(spark, 100, 99), [LABEL], "pooled").collect()
    assert np.mean([(r["p"] > 0.5) == r[LABEL] for r in scored]) > 0.9


def test_epoch_training_goes_on_where_it_was(spark):
    from netseq.operators.train import train_epochs

    rows = labelled(spark, 200)
    run = train_epochs(lambda e: rows, [2, 2], 2, 3)
    again = train_epochs(lambda e: rows, [2, 2], 1, 3)
    last = [v for e, _, v, _, _ in run.log if e == 0][-1]
    assert [v for e, _, v, _, _ in run.log if e == 1][0] == pytest.approx(last)
    assert [v for e, _, v, _, _ in again.log] == pytest.approx([v for e, _, v, _, _ in run.log if e == 0])


def test_epoch_training_stops_early(spark):
    from netseq.operators.train import train_epochs

    rows = [(bool(i % 2), [1.0, 1.0]) for i in range(80)]
    df = spark.createDataFrame(rows, f"{LABEL} boolean, pooled array<double>")
    run = train_epochs(lambda e: df, [2, 2], 30, 3, patience=2, evaluate=lambda c, e: e)
    assert run.final_epoch < 29 and run.evaluations[-1] == run.final_epoch


def test_transfer_has_no_class_limit(spark):
    from netseq.operators.experiments import transfer_matrix

    rows = [(i, f"c{i % 500}" if i % 500 else None, i % 3 == 0, float(i % 17)) for i in range(1500)]
    df = spark.createDataFrame(rows, f"{ROW} long, kind string, {LABEL} boolean, v double")
    found = transfer_matrix(Indexed(df, 1500), "v", "kind", 4)
    assert found.count() == 500 * 500 and found.select("fit_on", "eval_on").distinct().count() == 500 * 500


def test_missing_vectors_are_refused(spark):
    df, codes = flow_vectors(spark)
    with pytest.raises(ValueError, match="codes but vectors"):
        CategoryEmbed("lookup", 1, {"k": [[0.0], [1.0]], "m": [[0.0], [1.0], [2.0]]}).apply(df, codes)
