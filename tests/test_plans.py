"""What the plans look like, and that they survive skew and tables too big to broadcast."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from conftest import SMALL
from tillwise.functions.measures import exact_sum
from tillwise.operators.cleaning import clean_lines
from tillwise.operators.keep import keep_small
from tillwise.plans import extracts, insights, significance, sql_reports, workbook
from tillwise.sources.star import COLUMNS, TABLES, order_lines


def plan(df, executed=False) -> str:
    if executed:
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Sets session options for one test."""
    before = {}

    def change(**options):
        for name, value in options.items():
            key = "spark.sql." + name.replace("__", ".")
            before.setdefault(key, spark.conf.get(key, None))
            spark.conf.set(key, value)

    yield change
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_only_needed_tables_and_columns_are_read(spark):
    narrow = plan(order_lines(spark, SMALL, ["category", "sales"]))
    assert narrow.count("FileScan") == 2
    assert "ReadSchema: struct<l_partkey:bigint,l_extendedprice:double>" in narrow
    assert plan(order_lines(spark, SMALL)).count("FileScan") == len(TABLES)
    with pytest.raises(ValueError, match="no such order-line columns: price"):
        order_lines(spark, SMALL, ["price"])


def test_no_line_is_lost_without_its_dimensions(spark, tmp_path):
    for name in TABLES:
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name in ("orders", "part"):
            table = table.limit(table.count() // 2)
        table.write.parquet(str(tmp_path / f"{name}.parquet"))
    lines = order_lines(spark, str(tmp_path), COLUMNS)
    assert lines.count() == 6000
    assert 0 < lines.where("order_date is null").count() < 6000
    assert 0 < lines.where("category is null").count() < 6000


def test_filter_reaches_the_scan(spark):
    lines = order_lines(spark, SMALL, ["sales", "discount"]).where("discount >= 0.05")
    assert "PushedFilters: [IsNotNull(l_discount), GreaterThanOrEqual(l_discount,0.05)]" in plan(lines)


def test_features_and_reports_stay_in_the_jvm(spark, small_lines):
    for build in (*sql_reports.REPORTS.values(), *extracts.EXTRACTS.values()):
        assert "Python" not in plan(build(small_lines))
    assert "Python" not in plan(significance.segment_profitability(small_lines))


def test_top_k_keeps_k_rows_per_task(small_lines):
    assert "TakeOrderedAndProject(limit=10" in plan(sql_reports.top_customers(small_lines))


def test_state_sums_are_shuffled_once(spark):
    lines = order_lines(spark, SMALL, ["state", "sales", "profit"])
    text = plan(sql_reports.state_profit_margin_rank(lines), executed=True)
    assert "ReusedExchange" in text.split("Initial Plan")[0]


def test_matrix_and_insights_scan_once(spark):
    lines = order_lines(spark, SMALL, ["sales", "profit", "discount", "quantity"])
    assert plan(significance.sales_correlation_matrix(lines)).count("l_extendedprice") > 0
    assert plan(significance.sales_correlation_matrix(lines)).count("FileScan") == 2
    figures = order_lines(
        spark, SMALL, ["order_date", "sales", "profit", "discount", "region", "segment"]
    )
    cells = plan(significance.statistic_cells(figures))
    assert cells.count("lineitem.parquet") == 1 and "Expand" not in cells and "Python" not in cells


def test_cells_leave_out_what_is_not_used(small_lines):
    cells = significance.statistic_cells(small_lines)
    assert "covar_pop" in plan(cells) and "covar_pop" not in plan(cells.select("region", "profit_margin_pct_alone"))


def test_all_statistics_come_from_kept_cells(spark):
    lines = order_lines(
        spark, SMALL, ["order_date", "sales", "profit", "discount", "quantity", "region", "segment"]
    )
    for name, table in significance.statistic_tables(lines).items():
        assert "lineitem" not in plan(table), name


def test_distinct_orders_are_spread_before_they_are_counted(spark):
    lines = order_lines(spark, SMALL, ["order_id", "category", "sales", "profit", "order_date"])
    text = plan(extracts.time_trends(lines))
    assert "order_id" in text and "partial_count(distinct" in text


def test_nothing_is_crossed(spark):
    for name, query in registry.core_queries().items():
        if name in ("cleaned_sales", "cleaning_summary", "median_filled_numbers", "tolerant_dates"):
            continue
        text = plan(query(spark, SMALL))
        assert "CartesianProduct" not in text, name
        assert "BroadcastNestedLoopJoin" not in text, name


def test_results_do_not_depend_on_broadcasts(spark, conf):
    names = ["yearly_kpis", "regional_performance", "state_profit_margin_rank", "segment_analysis"]
    before = {n: registry.core_queries()[n](spark, SMALL).collect() for n in names}
    conf(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")
    for name in names:
        result = registry.core_queries()[name](spark, SMALL)
        text = plan(result, executed=True)
        assert "SortMergeJoin" in text and "BroadcastHashJoin" not in text
        assert sorted(map(str, result.collect())) == sorted(map(str, before[name]))


@pytest.fixture
def hot_star(spark, tmp_path):
    """The small tables with a third of all lines moved to one part and one order."""
    for name in TABLES:
        table = spark.read.parquet(f"{SMALL}/{name}.parquet")
        if name == "lineitem":
            hot = F.col("l_linenumber") <= 2
            table = table.withColumn("l_partkey", F.when(hot, 7).otherwise(F.col("l_partkey")))
            table = table.withColumn("l_orderkey", F.when(hot, 5).otherwise(F.col("l_orderkey")))
        table.repartition(8 if name == "lineitem" else 1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def test_hot_product_and_order_are_split(spark, conf, hot_star):
    lines = order_lines(spark, hot_star, ["product_id", "product_name", "category", "sales", "profit", "discount"])
    want = sql_reports.negative_margin_products(lines).collect()
    yearly = order_lines(spark, hot_star, ["order_id", "order_date", "sales", "profit"])
    want_yearly = extracts.executive_summary(yearly).collect()
    conf(
        autoBroadcastJoinThreshold="-1",
        adaptive__autoBroadcastJoinThreshold="-1",
        adaptive__skewJoin__skewedPartitionThresholdInBytes="2KB",
        adaptive__skewJoin__skewedPartitionFactor="1.5",
        adaptive__advisoryPartitionSizeInBytes="4KB",
        adaptive__coalescePartitions__enabled="false",
    )
    lines = order_lines(spark, hot_star, ["product_id", "product_name", "category", "sales", "profit", "discount"])
    report = sql_reports.negative_margin_products(lines)
    assert "skew=true" in plan(report, executed=True)
    assert sorted(map(str, report.collect())) == sorted(map(str, want))
    yearly = order_lines(spark, hot_star, ["order_id", "order_date", "sales", "profit"])
    report = extracts.executive_summary(yearly)
    assert "skew=true" in plan(report, executed=True)
    assert report.collect() == want_yearly


def test_copies_collapse_before_the_shuffle(spark):
    columns = ["order_date", "ship_date", "sales", "profit", "discount", "quantity", "category", "state"]
    lines = order_lines(spark, SMALL, columns)
    text = plan(clean_lines(lines))
    # the same grouping runs on both sides of the exchange
    assert text.count("HashAggregate(keys=[") >= 2


def test_sums_do_not_depend_on_partitioning(spark, small_lines):
    once = small_lines.coalesce(1).agg(F.expr(exact_sum("profit"))).first()
    spread = small_lines.repartition(37).agg(F.expr(exact_sum("profit"))).first()
    assert once == spread


def test_pivot_reads_the_lines_once(spark):
    lines = order_lines(spark, SMALL, ["order_date", "region", "category", "sales", "profit"])
    text = plan(workbook.workbook_regional_pivot(lines))
    assert "FileScan" not in text and "Scan ExistingRDD" in text


def test_kept_results_use_the_named_folder_and_see_new_files(spark, tmp_path):
    folder = str(tmp_path / "t")
    spark.range(3).write.parquet(folder)
    first = keep_small(spark.read.parquet(folder).groupBy().count())
    shutil.rmtree(folder)
    spark.range(5).write.parquet(folder)
    assert first.first()[0] == 3
    assert keep_small(spark.read.parquet(folder).groupBy().count()).first()[0] == 5
    assert spark.sparkContext.getCheckpointDir() is not None
