"""Plans and results that must hold for large and skewed tables."""

import re

import pytest
from pyspark.sql import functions as F

from assaykit import results, score, validate
from assaykit.operators import history, marts, profiling
from assaykit.operators.measure import DIGEST, EXACT, NONE, REPEATS, ROWS, measure
from assaykit.operators.transform import to_snapshot, transform
from assaykit.plans.catalog import QUERIES
from assaykit.session import stored, workspace
from assaykit.sources.retail import retail

FOLDER = "/root/testdata/sf0.001"
EAGER = {"etl_snapshot", "etl_run", "lineage_log", "stored_batches", "csv_scan", "compacted_batches",
         "profile_report", "quality_report", "score_report", "lineage_sidecar"}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")


@pytest.fixture(scope="module")
def skewed(spark):
    """100,000 rows, a third of them copies of one row, one country with most of the rest."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(100_000).select(
        F.when(hot, "1").otherwise(i.cast("string")).alias("InvoiceNo"),
        F.when(hot, "A").otherwise((i % 1000).cast("string")).alias("StockCode"),
        F.lit("X").alias("Description"),
        F.when(hot, 1).otherwise(i % 50 + 1).cast("bigint").alias("Quantity"),
        F.lit("2010-12-01T08:26:00").alias("InvoiceDate"),
        F.when(hot, 2.0).otherwise((i % 977) / 10 + 1).cast("double").alias("UnitPrice"),
        F.when(~hot, (i % 5000).cast("double")).alias("CustomerID"),
        F.when(i % 10 == 1, "France").otherwise("United Kingdom").alias("Country"),
        (i % 4 == 0).cast("bigint").alias("run_id"),
    )


@pytest.mark.parametrize("name", sorted(set(QUERIES) - EAGER))
def test_no_cross_join_and_no_python(spark, name):
    text = plan(QUERIES[name](spark, FOLDER))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|PythonUDF|ArrowEval|MapInPandas", text)


def test_one_scan_validates_everything(spark):
    text = plan(score(validate(retail(spark, FOLDER))))
    assert text.count("FileScan parquet") == 5  # each supplied table once
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert not any("l_comment" in s or "l_extendedprice" in s for s in scans)


def test_digest_shuffles_narrow_rows(spark):
    df = retail(spark, FOLDER)
    text = plan(measure(df, df.columns, {"x": F.col("Quantity") < 0}, row_key=DIGEST))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", text)
    wide = [k for k in keys if "Description" in k or "InvoiceNo" in k]
    assert any("__digest_0" in k for k in keys) and not wide


def test_counts_without_copies_need_no_row_shuffle(spark):
    df = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    text = plan(measure(df, df.columns, {"x": F.col("l_quantity") < 0}, row_key=NONE))
    assert "hashpartitioning" not in text and "ReadSchema: struct<l_quantity:double>" in text


def test_copies_are_merged_before_the_shuffle(skewed):
    text = plan(measure(skewed, skewed.columns, {}))
    assert re.search(r"partial_count\(1\)", text)


def test_rows_without_copies_are_not_shuffled_whole(spark):
    df = spark.read.parquet(f"{FOLDER}/part.parquet")
    found = measure(df, df.columns, {"x": F.col("p_size") < 9}, row_key=EXACT)
    assert found.first().asDict() == {ROWS: df.count(), REPEATS: 0, "x": df.filter("p_size < 9").count()}
    assert "p_name" not in plan(found)  # the counts alone are read; no second pass


def test_only_rows_with_a_repeated_digest_are_shuffled_whole(spark):
    df = retail(spark, FOLDER)
    path = workspace(spark, "rows")
    df.write.parquet(path)
    df = spark.read.parquet(path)
    found = measure(df, df.columns, {}, row_key=EXACT)
    found.collect()
    text = found._jdf.queryExecution().executedPlan().toString()
    final = text[:text.index("+- == Initial Plan ==")] if "+- == Initial Plan ==" in text else text
    assert "BroadcastHashJoin" in final and "LeftSemi" in final  # below the one exchange of whole rows
    wide = [m.start() for m in re.finditer(r"Exchange hashpartitioning\([^)]*Description", final)]
    assert len(wide) == 1 and final.index("LeftSemi") > wide[0]
    assert found.first()[REPEATS] == 61


@pytest.mark.parametrize("rows", [
    [], [(1, "a", 0.0), (1, "a", -0.0), (None, "a", 1.0), (None, "a", 1.0), (None, "a", 1.0)],
    [(None, None, None), (None, None, None), (1, None, None), (None, "1", None), (2, "x", float("nan")), (2, "x", float("nan"))]])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_exact_equals_grouping_whole_rows(spark, rows, by):
    df = spark.createDataFrame([(*r, g) for r in rows for g in (1, None, 2)], "a int, b string, c double, g int")
    rules = {"x": F.col("a") > 1, "y.z": F.col("b").isNull()}
    one, other = (sorted(map(str, measure(df, ["a", "b", "c"], rules, by, k).collect())) for k in (EXACT, "row"))
    assert one == other


@pytest.mark.parametrize("row_key", ["row", EXACT, DIGEST])
def test_hot_row(skewed, row_key):
    df = skewed.drop("run_id")
    row = measure(df, df.columns, {"hot": F.col("StockCode") == "A"}, row_key=row_key).first()
    assert row[ROWS] == 100_000 and row["hot"] == 33_334
    expected = 100_000 - df.distinct().count()
    assert row[REPEATS] == expected


def test_hot_batch(skewed):
    found = {r.run_id: r for r in results(validate(skewed, by=["run_id"]), ["run_id"]).filter(
        "check_name = 'duplicate_rows'").collect()}
    for run_id in (0, 1):
        part = skewed.filter(F.col("run_id") == run_id).drop("run_id")
        assert found[run_id].affected_rows == part.count() - part.distinct().count()


def test_sample_ranking_is_limited_before_the_shuffle(skewed):
    text = plan(profiling.samples(skewed))
    assert re.search(r"WindowGroupLimit.*Partial", text)


def test_distinct_values_are_counted_once(skewed):
    text = plan(profiling.numeric_profile(skewed.drop("run_id")))
    profiling.numeric_profile(skewed.drop("run_id")).collect()
    assert "percentile" not in text and "collect" not in text


def test_medians_of_skewed_columns(skewed):
    found = {r["column"]: r["median"] for r in profiling.medians(skewed).collect()}
    for name in ("Quantity", "UnitPrice", "CustomerID"):
        assert found[name] == skewed.agg(F.median(name)).first()[0]


@pytest.fixture
def sixteen_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_range_of_values_is_large(spark, sixteen_ranges):
    """A power tail, two outliers, infinities, and one value with a third of all rows."""
    i = F.col("id").cast("double")
    df = spark.range(200_000).select(
        F.pow(i / 1000, 9).alias("tail"),
        F.when(F.col("id") == 0, 1e300).when(F.col("id") == 1, -1e300).otherwise(i).alias("outliers"),
        F.when(F.col("id") % 3 == 0, float("inf")).when(F.col("id") % 3 == 1, float("-inf")).otherwise(i).alias("infinite"),
        F.when(F.col("id") % 3 == 0, 0.5).otherwise(i).alias("hot"))
    values = profiling.value_counts(df).selectExpr("column", "real AS v", "copies AS n")
    sizes = [r["count"] for r in profiling.value_ranges(values).groupBy("part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sum(sizes) / 16
    found = {r["column"]: r["median"] for r in profiling.medians(df).collect()}
    assert found == {c: df.agg(F.median(c)).first()[0] for c in df.columns}


def test_medians_of_odd_columns(spark):
    df = spark.createDataFrame([(1, None, 1.0, True), (2, None, float("inf"), False), (2, None, float("-inf"), True)],
                               "a int, none double, c double, d boolean")
    assert {r["column"]: r["median"] for r in profiling.medians(df).collect()} == {"a": 2.0, "c": 1.0, "d": 1.0}
    assert profiling.medians(df.filter("false")).collect() == []


def test_distinct_counts_need_no_expand(spark):
    text = plan(marts.kpi_summary(to_snapshot(transform(retail(spark, FOLDER)))))
    assert "Expand" not in text


def test_latest_results_read_one_partition(spark):
    runs, found = QUERIES["all_runs"](spark, FOLDER), QUERIES["result_log"](spark, FOLDER)
    path = workspace(spark, "found")
    found.write.partitionBy("run_id").parquet(path)
    latest = history.latest_results(spark.read.parquet(path), runs)
    newest = runs.agg(F.max("run_id")).first()[0]
    assert re.search(rf"PartitionFilters: \[[^]]*= {newest}\)", plan(latest)) and "Join" not in plan(latest)
    assert {r.run_id for r in latest.collect()} == {newest}
    assert history.latest_results(found, runs.filter("false")).collect() == []


def test_shuffle_joins_give_the_same_rows(spark, no_broadcast):
    df = retail(spark, FOLDER, faulty=True)
    assert "SortMergeJoin" in plan(df) or "ShuffledHashJoin" in plan(df)
    assert score(validate(df)).first().health_score == 48.75
    found = QUERIES["score_delta"](spark, FOLDER)
    assert found.count() == QUERIES["all_runs"](spark, FOLDER).count()


def test_previous_score_over_block_borders(spark):
    ids = [1, 2, 9_999, 10_000, 10_001, 35_000, 70_000, 70_001]
    runs = spark.createDataFrame([(i, "ab"[i % 2], float(n)) for n, i in enumerate(ids)],
                                 "run_id bigint, pipeline_name string, health_score double")
    rows = {r.run_id: r.previous_score for r in history.score_delta(runs).collect()}
    assert rows == dict(zip(ids, [None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0]))
    by_name = {r.run_id: r.previous_score for r in history.score_delta(runs, per_name=True).collect()}
    assert by_name == {1: None, 9_999: 0.0, 10_001: 2.0, 70_001: 4.0, 2: None, 10_000: 1.0, 35_000: 3.0, 70_000: 5.0}


def test_score_change_has_no_single_task_window(spark):
    runs = stored(QUERIES["all_runs"](spark, FOLDER), "runs")
    text = plan(history.score_delta(runs))
    windows = re.findall(r"Window \[lag\(health_score.*", text)
    assert windows and all("block" in w for w in windows)


def test_top_lists_need_no_global_sort(spark):
    text = plan(marts.top_products(to_snapshot(transform(retail(spark, FOLDER)))))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_workspace_is_below_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir")
    first, second = workspace(spark, "x"), workspace(spark, "x")
    assert first.startswith(base) and first != second


def test_tasks_of_the_retail_join_hold_a_bounded_number_of_lines(spark, monkeypatch, no_broadcast):
    before = sorted(map(str, QUERIES["batch_scores"](spark, FOLDER).collect()))
    monkeypatch.setattr("assaykit.sources.retail.LINES_A_TASK", 100)
    df = retail(spark, FOLDER)
    lines = spark.read.parquet(f"{FOLDER}/lineitem.parquet")
    wanted = lines.count() // 100
    assert plan(df).count(f", {wanted}), REPARTITION_BY_NUM") == 2  # lines and buyers, by order
    keys = lines.repartition(wanted, "l_orderkey").groupBy(F.spark_partition_id()).count()
    assert keys.agg(F.max("count")).first()[0] < 300
    assert sorted(map(str, QUERIES["batch_scores"](spark, FOLDER).collect())) == before


def test_a_small_retail_join_is_left_to_spark(spark):
    assert "REPARTITION" not in plan(retail(spark, FOLDER))


def test_whole_rows_of_a_large_table_are_grouped_where_they_were_dealt(spark, monkeypatch, no_broadcast):
    """The grouping's tasks follow the number of lines, not the session's partitions, and it adds no shuffle of its own."""
    def wide(df):
        return re.findall(r"Exchange hashpartitioning\(([^)]*), (\d+)\), (\w+)", plan(df))

    names = ("batch_scores", "quality_results_transformed", "duplicates", "critical_gate")
    before = {n: sorted(map(str, QUERIES[n](spark, FOLDER).collect())) for n in names}
    monkeypatch.setattr("assaykit.sources.retail.LINES_A_TASK", 100)
    wanted = str(spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 100)
    for n in names:
        found = wide(QUERIES[n](spark, FOLDER))
        assert [(count, how) for keys, count, how in found if "InvoiceNo" in keys] == [(wanted, "REPARTITION_BY_NUM")], n
        assert sorted(map(str, QUERIES[n](spark, FOLDER).collect())) == before[n]


def test_a_join_with_many_parts_is_dealt(spark, monkeypatch, no_broadcast):
    monkeypatch.setattr("assaykit.sources.retail.LINES_A_TASK", 100)
    before = sorted(map(str, retail(spark, FOLDER).collect()))
    monkeypatch.setattr("assaykit.sources.retail.PARTS_LEFT", 100)
    df = retail(spark, FOLDER)
    wanted = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 100
    assert plan(df).count(f", {wanted}), REPARTITION_BY_NUM") == 4  # lines and buyers, by order; then with the parts, by part
    assert sorted(map(str, df.collect())) == before


def test_a_join_with_many_customers_is_dealt(spark, monkeypatch, no_broadcast):
    """Else a task holds as many orders as the session's number of shuffle partitions leaves it."""
    monkeypatch.setattr("assaykit.sources.retail.LINES_A_TASK", 100)
    before = sorted(map(str, retail(spark, FOLDER).collect()))
    monkeypatch.setattr("assaykit.sources.retail.CUSTOMERS_LEFT", 10)
    df = retail(spark, FOLDER)
    wanted = spark.read.parquet(f"{FOLDER}/lineitem.parquet").count() // 100
    found = re.findall(r"Exchange hashpartitioning\((\w+)#\d+L?, (\d+)\), (\w+)", plan(df))
    for key in ("o_custkey", "c_custkey"):
        assert (key, str(wanted), "REPARTITION_BY_NUM") in found
    assert sorted(map(str, df.collect())) == before
