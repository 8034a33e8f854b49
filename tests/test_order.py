"""Dense order, ranks, running values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from netseq.operators import order
from netseq.operators.order import ROW, Indexed, Ranked
from netseq.session import staging_path


def shuffled_frame(spark, n=5000, hot=False):
    """Keys in random file order; with ``hot`` a third of the rows share the first key."""
    rng = np.random.default_rng(7)
    a = rng.integers(0, 50, n)
    if hot:
        a[: n // 3] = 25
    rows = [(int(x), int(i), float(i % 17)) for x, i in zip(a, rng.permutation(n))]
    return spark.createDataFrame(rows, "a long, b long, v double").repartition(7)


@pytest.mark.parametrize("hot", [False, True])
def test_key_order_equals_global_sort(spark, hot):
    df = shuffled_frame(spark, hot=hot)
    indexed = order.index_rows(df, ["a", "b"])
    rows = sorted((r["a"], r["b"], r[ROW]) for r in indexed.df.collect())
    assert indexed.n_rows == 5000
    assert [r[2] for r in rows] == list(range(5000))


def test_sorted_files_are_not_shuffled(spark):
    path = staging_path(spark, "sorted")
    spark.range(0, 3000).repartitionByRange(5, "id").sortWithinPartitions("id").write.parquet(path)
    indexed = order.index_rows(spark.read.parquet(path), ["id"])
    assert indexed.files is not None and indexed.n_files > 1
    assert indexed.df.filter(f"id <> {ROW}").count() == 0 and indexed.n_rows == 3000
    plan = indexed.df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_files_whose_names_are_out_of_key_order(spark):
    path = staging_path(spark, "descending")
    low, high = spark.range(0, 1000), spark.range(1000, 2500)
    high.coalesce(1).write.parquet(path)
    low.coalesce(1).write.mode("append").parquet(path)
    indexed = order.index_rows(spark.read.parquet(path), ["id"])
    assert indexed.df.filter(f"id <> {ROW}").count() == 0


def test_unsorted_or_filtered_files_fall_back_to_a_sort(spark):
    path = staging_path(spark, "unsorted")
    spark.range(0, 2000).orderBy(F.desc("id")).coalesce(1).write.parquet(path)
    scan = spark.read.parquet(path)
    assert order.index_rows(scan, ["id"]).df.filter(f"id <> {ROW}").count() == 0
    odd = order.index_rows(scan.filter("id % 2 = 1"), ["id"])
    assert odd.n_rows == 1000 and odd.df.filter(f"id <> 2 * {ROW} + 1").count() == 0


def test_a_missing_key_falls_back_to_a_sort(spark):
    path = staging_path(spark, "nullkey")
    spark.range(0, 100).select(F.when(F.col("id") > 0, F.col("id")).alias("k")).coalesce(1).write.parquet(path)
    indexed = order.index_rows(spark.read.parquet(path), ["k"])
    assert indexed.files is None
    assert {(r["k"], r[ROW]) for r in indexed.df.collect()} == {(i or None, i) for i in range(100)}


def test_file_order_and_filtered_scan(spark):
    path = staging_path(spark, "files")
    spark.range(0, 1500).repartitionByRange(12, "id").sortWithinPartitions("id").write.parquet(path)
    scan = spark.read.parquet(path)
    indexed = order.index_by_file(scan)
    assert indexed.df.filter(f"id <> {ROW}").count() == 0
    with pytest.raises(ValueError):
        order.index_by_file(scan.filter("id % 2 = 0"))


def test_one_file_read_in_many_splits(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    path = str(tmp_path / "one.parquet")
    pq.write_table(pa.table({"id": range(40_000)}), path, row_group_size=1000, compression="none", use_dictionary=False)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "30000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        scan = spark.read.parquet(path)
        assert scan.rdd.getNumPartitions() > 5
        indexed = order.index_rows(scan, ["id"])
        assert indexed.files is not None and indexed.n_rows == 40_000
        assert indexed.df.filter(f"id <> {ROW}").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_between_reads_only_the_files_it_needs(spark):
    path = staging_path(spark, "between")
    spark.range(0, 4000).repartitionByRange(10, "id").sortWithinPartitions("id").write.parquet(path)
    indexed = order.index_rows(spark.read.parquet(path), ["id"])
    for start, stop in [(0, 100), (1234, 2345), (3990, None), (0, None), (4000, None)]:
        part = indexed.between(start, stop)
        want = list(range(start, 4000 if stop is None else stop))
        assert sorted(r["id"] for r in part.collect()) == want
        assert part.filter(f"id <> {ROW}").count() == 0
    tail = indexed.between(3990)
    tail.collect()
    scan = tail._jdf.queryExecution().executedPlan().toString()
    assert len(indexed.source.inputFiles()) == 10
    used = tail.select(F.input_file_name().alias("f")).distinct().count()
    assert used == 1, scan


def test_empty_frame(spark):
    indexed = order.index_rows(spark.range(0), ["id"])
    assert indexed.n_rows == 0 and indexed.df.count() == 0


def test_head(spark):
    indexed = order.index_rows(spark.range(100), ["id"])
    assert sorted(r["id"] for r in order.head(indexed, 7).df.collect()) == list(range(7))
    assert order.head(indexed, 0) is indexed and order.head(indexed, 100) is indexed


@pytest.mark.parametrize("chunks", [131_072, 3])
def test_ranks_within_classes(spark, monkeypatch, chunks):
    monkeypatch.setattr(order, "MAX_CHUNKS", chunks)
    monkeypatch.setattr(order, "_chunk_size", lambda n: max(1, -(-n // chunks), min(64, n)))
    df = spark.range(2000).select(F.col("id").alias(ROW), (F.col("id") % 3 == 0).alias("y"))
    ranked = Ranked(df.filter(f"{ROW} % 5 <> 0"), 2000, "y")
    ids = [i for i in range(2000) if i % 5]
    want = {}
    for y in (True, False):
        mine = [i for i in ids if (i % 3 == 0) == y]
        assert ranked.sizes[y] == len(mine)
        want.update({i: r for r, i in enumerate(mine)})
    assert {r[ROW]: r["rank"] for r in ranked.all().collect()} == want
    wanted = spark.createDataFrame(
        [(True, 0, "a"), (True, ranked.sizes[True] - 1, "b"), (False, 500, "c"), (False, 500, "d")],
        "y boolean, rank long, tag string",
    )
    got = {(r["tag"], r[ROW]) for r in ranked.at(wanted, 4).collect()}
    by_rank = {(i % 3 == 0, r): i for i, r in want.items()}
    assert got == {
        ("a", by_rank[True, 0]),
        ("b", by_rank[True, ranked.sizes[True] - 1]),
        ("c", by_rank[False, 500]),
        ("d", by_rank[False, 500]),
    }


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_values(spark, monkeypatch, inclusive):
    monkeypatch.setattr(order, "_chunk_size", lambda n: 37)
    rng = np.random.default_rng(3)
    v = rng.integers(-50, 50, 500).astype(float)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], f"{ROW} long, v double")
    c = F.col("v")
    out = order.running(df, 500, {"s": ("sum", c), "lo": ("min", c), "hi": ("max", c)}, inclusive=inclusive)
    for r in out.collect():
        part = v[: r[ROW] + (1 if inclusive else 0)]
        assert r["s"] == part.sum()
        assert r["lo"] == (part.min() if len(part) else None)
        assert r["hi"] == (part.max() if len(part) else None)


def test_natural_file_order():
    names = ["part-10", "part-9", "part-100"]
    assert sorted(names, key=order.natural_key) == ["part-9", "part-10", "part-100"]


def test_indexed_defaults(spark):
    assert Indexed(spark.range(3).withColumnRenamed("id", ROW), 3).between(1, 2).count() == 1


def leaves(df):
    """Scans of the planned query."""
    found = df._jdf.queryExecution().sparkPlan().collectLeaves()
    every = [found.apply(i) for i in range(found.size())]
    return [x for x in every if "FileSourceScan" in x.getClass().getName()]


def test_a_range_of_two_thousand_files_reads_the_touched_ones(spark):
    path = staging_path(spark, "two-thousand")
    spark.range(0, 20_000, 1, 2_000).write.parquet(path)
    indexed = order.index_by_file(spark.read.parquet(path))
    assert indexed.n_files == 2_000 and indexed.n_rows == 20_000
    for start, stop in ((5_000, 5_030), (0, 10), (19_995, 20_000), (3, 15_000)):
        part = indexed.between(start, stop)
        touched = (stop - 1) // 10 - start // 10 + 1
        assert max(x.selectedPartitions().totalNumberOfFiles() for x in leaves(part)) == touched
        assert part.filter(f"id <> {ROW}").count() == 0 and part.count() == stop - start
    assert indexed.between(20_000).count() == 0


def test_names_sort_as_numbers(spark):
    names = ["a", "a1", "a01", "a2", "a10", "a10b", "a9/part-2", "a9/part-10", "b", "", "7", "07x", "a1b2", "a1b10", "é3"]
    got = spark.createDataFrame([(n,) for n in names], "n string").orderBy(order.natural_name("n"), "n").collect()
    assert [r["n"] for r in got] == sorted(names, key=lambda n: (order.natural_key(n), n))


def shuffled(plan):
    """Records written by all exchanges of an executed plan."""
    name = plan.getClass().getSimpleName()
    if name == "AdaptiveSparkPlanExec":
        return shuffled(plan.executedPlan())
    if name.endswith("QueryStageExec"):
        return shuffled(plan.plan())
    own = 0
    if name == "ShuffleExchangeExec":
        own = plan.metrics().get("shuffleRecordsWritten").get().value()
    below = plan.children()
    return own + sum(shuffled(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("n_rows", [40_000, 400_000])
def test_a_draw_moves_blocks_not_chunks(spark, n_rows):
    """Ten ranks move ten blocks of rows, however long the table."""
    df = spark.range(n_rows).select(F.col("id").alias(ROW), (F.col("id") % 3 == 0).alias("y"))
    ranked = Ranked(df, n_rows, "y")
    wanted = spark.createDataFrame([(True, i * (n_rows // 40)) for i in range(10)], "y boolean, rank long")
    found = ranked.at(wanted, 10)
    assert {(r["rank"], r[ROW]) for r in found.collect()} == {(i * (n_rows // 40), 3 * i * (n_rows // 40)) for i in range(10)}
    assert shuffled(found._jdf.queryExecution().executedPlan()) <= 10 * ranked.block + 200


def test_no_sort_task_gets_more_than_its_rows(spark):
    """However few partitions the session asks for, a task sorts about half a million rows."""
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        indexed = order.index_by_keys(spark.range(1_200_000).select((F.col("id") * 7 % 1_200_000).alias("k")), ["k"])
        largest = indexed.df.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
        assert indexed.df.filter(f"k <> {ROW}").count() == 0 and largest < 800_000
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)


def test_a_table_without_order_is_known_by_its_first_rows(spark, monkeypatch):
    """No scan of the whole table is asked of Python; keys that are missing or fall later are still found."""
    path = staging_path(spark, "falling")
    cases = {"falling": -F.col("id"), "when": F.timestamp_seconds(-F.col("id")), "missing": F.lit(None).cast("long"),
             "late": F.when(F.col("id") < order.FIRST_ROWS, F.col("id")).otherwise(-F.col("id"))}
    spark.range(0, 6000).select("id", *[c.alias(n) for n, c in cases.items()]).coalesce(1).write.parquet(path)
    scan, whole = spark.read.parquet(path), []
    stage = order.stage
    monkeypatch.setattr(order, "stage", lambda df, label: whole.append(label) or stage(df, label))
    for name, seen in {"id": True, "late": True, "falling": False, "when": False, "missing": False}.items():
        whole.clear()
        indexed = order.index_rows(scan, [name, "id"] if name == "missing" else [name])
        assert ("stretches" in whole) is seen, name
        assert (indexed.files is not None) is (name == "id")
        # falling keys turn the rows round
        turned = {"falling": f"5999 - {ROW}", "when": f"5999 - {ROW}"}.get(name, ROW)
        if name != "late":
            assert indexed.df.filter(f"id <> {turned}").count() == 0
    spark.range(0, 0).write.parquet(empty := staging_path(spark, "none"))
    assert order.index_rows(spark.read.parquet(empty), ["id"]).n_rows == 0
