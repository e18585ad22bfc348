from __future__ import annotations

import csv
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.errors import AnalysisException

from tillwise.plans.batch import clean_files, publish
from tillwise.plans.sql_reports import REPORTS
from tillwise.schema import HEADERS
from tillwise.sources.order_files import (
    read_clean_table,
    read_order_csv,
    run_named_queries,
    save_bucketed_lines,
    save_lines_table,
    sort_out_order_csv,
    write_batch,
    write_clean_table,
    write_csv,
)

RAW = [name for name in HEADERS if name not in (
    "year", "month", "quarter", "profit_margin_pct", "discount_impact", "delivery_days",
    "delivery_speed",
)]


def write_raw(path: Path, rows: list[dict], header=None) -> str:
    with path.open("w", newline="") as handle:
        writer = csv.DictWriter(handle, header or [HEADERS[n] for n in RAW])
        writer.writeheader()
        writer.writerows(rows)
    return str(path)


def raw_row(i: int, **changes) -> dict:
    ordered = date(2019, 1, 15) + timedelta(days=30 * (i % 26))
    row = {
        "Order ID": f"o{i // 2}", "Order Date": ordered.strftime("%m/%d/%Y"),
        "Ship Date": (ordered + timedelta(days=i % 6)).strftime("%m/%d/%Y"),
        "Ship Mode": "Standard", "Customer ID": f"c{i % 7}", "Customer Name": f"Name, {i % 7}",
        "Segment": ("Home", "Corporate")[i % 2], "City": "Akron", "State": f"S{i % 6}",
        "Region": ("East", "West")[i % 2], "Product ID": f"p{i % 5}",
        "Category": ("Furniture", "Technology")[i % 2], "Sub-Category": "Chairs",
        "Product Name": f'Stool 12" no {i % 5}', "Sales": 100.1234 + i, "Quantity": 1 + i % 3,
        "Discount": (0.0, 0.2)[i % 2], "Profit": 5.5 - (i % 4),
    }
    return {**row, **changes}


@pytest.fixture
def raw_file(tmp_path):
    rows = [raw_row(i) for i in range(60)]
    rows += [raw_row(0), raw_row(3, Sales="NA"), raw_row(4, **{"Order Date": "n/a"})]
    return write_raw(tmp_path / "raw.csv", rows)


def parts(folder) -> list[Path]:
    return sorted(Path(folder).glob("part-*.csv"))


def read_part(path: Path) -> list[list[str]]:
    with path.open(newline="") as handle:
        return list(csv.reader(handle, escapechar=None, doublequote=True))


def test_csv_cells_and_types(spark, raw_file):
    frame = read_order_csv(spark, raw_file)
    kinds = dict(frame.dtypes)
    assert kinds["sales"] == "double" and kinds["quantity"] == "bigint"
    assert kinds["order_date"] == "string"
    assert frame.count() == 63
    assert frame.where("sales is null").count() == 1
    assert frame.where("order_date is null").count() == 1
    assert frame.first()["customer_name"] == "Name, 0"
    assert frame.first()["product_name"] == 'Stool 12" no 0'


def test_columns_are_matched_by_header_and_extras_kept(spark, tmp_path):
    path = write_raw(
        tmp_path / "x.csv",
        [{"Profit": 1.5, "Row ID": 7, "Sales": 3}],
        ["Row ID", "Profit", "Sales"],
    )
    row = read_order_csv(spark, path).first().asDict()
    assert row == {"Row ID": "7", "profit": 1.5, "sales": 3.0}


def test_bad_number_fails_unless_tolerant(spark, tmp_path):
    path = write_raw(tmp_path / "x.csv", [{"Sales": "ten"}], ["Sales"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_order_csv(spark, path).collect()
    assert read_order_csv(spark, path, tolerant=True).first()["sales"] is None


def test_missing_columns_and_files(spark, tmp_path):
    path = write_raw(tmp_path / "x.csv", [{"Sales": 1}], ["Sales"])
    with pytest.raises(ValueError, match="columns not found: profit"):
        read_order_csv(spark, path, ["sales", "profit"])
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_order_csv(spark, str(tmp_path / "none.csv"))


def test_clean_table_is_partitioned_and_pruned(spark, raw_file, tmp_path):
    table = str(tmp_path / "clean")
    clean = clean_files(spark, raw_file, table, csv_copy=str(tmp_path / "clean_csv"))
    assert sorted(p.name for p in Path(table).glob("year=*")) == ["year=2019", "year=2020", "year=2021"]
    assert spark.read.parquet(table + "_raw").count() == 63
    # one duplicate and one line without a date are gone, the unknown sale is filled
    assert clean.count() == 61
    assert clean.where("sales is null").count() == 0
    one_year = read_clean_table(spark, table).where("year = 2020").select("sales")
    plan = one_year._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert "ReadSchema: struct<sales:double>" in plan
    header = read_part(parts(tmp_path / "clean_csv")[0])[0]
    assert {"Order ID", "Profit Margin %", "Delivery Speed"} <= set(header)
    write_clean_table(clean.limit(5), str(tmp_path / "again"), balance=False)
    assert read_clean_table(spark, str(tmp_path / "again")).count() == 5


def test_csv_sink_counts_and_replaces(spark, tmp_path):
    target = str(tmp_path / "out")
    frame = spark.range(100).repartition(4)
    assert write_csv(frame, target, {"id": "The Id"}) == 100
    assert len(parts(target)) > 1
    assert write_csv(frame.where("id < 3"), target, {"id": "The Id"}, one_file=True) == 3
    assert len(parts(target)) == 1
    assert sorted(read_part(parts(target)[0])) == [["0"], ["1"], ["2"], ["The Id"]]


def test_batch_of_outputs(spark, tmp_path):
    results = {"a": spark.range(3), "b": spark.range(0)}
    assert write_batch(results, str(tmp_path), one_file=["a"]) == {"a": 3, "b": 0}


def test_named_queries_are_numbered_in_order(spark, small_lines, tmp_path):
    named = {
        "total": "SELECT count(*) AS n FROM order_lines",
        "yearly_kpis": REPORTS["yearly_kpis"],
        "quoted": "SELECT max(`sales`) AS `Top Sale %` FROM order_lines",
    }
    rows = run_named_queries(small_lines, named, str(tmp_path), one_file=named)
    assert rows == {"total": 1, "yearly_kpis": 7, "quoted": 1}
    assert sorted(p.name for p in tmp_path.iterdir()) == ["01_total", "02_yearly_kpis", "03_quoted"]
    assert read_part(parts(tmp_path / "01_total")[0]) == [["n"], ["6000"]]
    years = [row[0] for row in read_part(parts(tmp_path / "02_yearly_kpis")[0])[1:]]
    assert years == sorted(years) and len(years) == 7


def test_table_is_replaced(spark, tmp_path, monkeypatch):
    name = "tillwise_lines_test"
    try:
        save_lines_table(spark.range(5), name)
        save_lines_table(spark.range(2), name)
        assert spark.table(name).count() == 2
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_publish_writes_everything(spark, raw_file, tmp_path):
    clean = clean_files(spark, raw_file, str(tmp_path / "clean"))
    counts = publish(clean, str(tmp_path / "published"))
    assert list(counts["reports"]) == list(REPORTS)
    assert counts["forecast"] == {"sales_forecast": 6}
    assert counts["workbook"]["executive_kpis"] == 4
    folder = tmp_path / "published"
    extract = read_part(parts(folder / "extracts" / "customer_segments")[0])[0]
    assert extract == [
        "Customer ID", "Customer Name", "Segment", "Total Sales", "Total Profit", "Order Count",
        "Avg Order Value", "First Order Date", "Last Order Date", "Customer Lifetime (days)",
    ]
    sheets = {
        "executive_yearly": [
            "Year", "Total Revenue", "Total Profit", "Total Orders", "Avg Order Value", "Profit Margin %",
            "YoY Growth %",
        ],
        "top_customers": [
            "Customer ID", "Customer Name", "Segment Lookup", "Total Revenue", "Total Profit", "Order Count",
            "Avg Order Value",
        ],
        "product_performance": [
            "Category", "Sub-Category", "Product Name", "Sales", "Profit", "Order Count", "Margin %",
        ],
    }
    for name, header in sheets.items():
        assert read_part(parts(folder / "workbook" / name)[0])[0] == header
    regional = read_part(parts(folder / "workbook" / "regional_analysis")[0])[0]
    assert regional[0] == "Region" and regional[-3:] == ["Total Sales", "Total Profit", "Profit Margin"]
    assert counts["statistics"]["margin_correlation_matrix"] == 16
    assert counts["statistics"]["business_insights"] >= 6
    forecast = read_part(parts(folder / "sales_forecast")[0])
    assert forecast[0] == ["month", "predicted_sales", "lower_ci", "upper_ci"]
    assert len(forecast) == 7
    assert (folder / "reports" / "08_ship_mode_impact").is_dir()


def test_whole_numbers_spelled_as_decimals(spark, tmp_path):
    path = write_raw(tmp_path / "x.csv", [{"Quantity": q} for q in ("2.0", " 3 ", "1e2", "NA", str(2**60 + 1))], ["Quantity"])
    assert [r[0] for r in read_order_csv(spark, path).collect()] == [2, 3, 100, None, 2**60 + 1]
    path = write_raw(tmp_path / "y.csv", [{"Quantity": "2.5"}], ["Quantity"])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        read_order_csv(spark, path).collect()


def test_rejected_rows_are_an_output(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(
        "Order ID,Sales,Quantity,Reason\n"
        'a,1.5,2.0,ok\nb,ten,x,bad\nc,NA,,gap\nd,1\ne,1,2,x,more\nf,2,2.5,half\n"g, g",3,4,\n'
    )
    kept, rejected, counts = sort_out_order_csv(spark, str(path), str(tmp_path / "sorted"))
    assert kept.columns == ["order_id", "sales", "quantity", "Reason"]
    assert sorted(map(tuple, kept.collect()), key=lambda r: r[0]) == [
        ("a", 1.5, 2, "ok"), ("c", None, None, "gap"), ("g, g", 3.0, 4, None)
    ]
    found = {r["cells"]["order_id"]: r for r in rejected.collect()}
    assert {k: r["reason"] for k, r in found.items()} == {
        "b": "sales is no number, quantity is no number", "d": "wrong number of cells",
        "e": "wrong number of cells", "f": "quantity is no number",
    }
    assert found["d"]["raw_row"] == "d,1" and found["b"]["cells"]["sales"] == "ten"
    assert counts == {"kept": 3, "rejected": 4}


def test_bucketed_lines_are_read_in_place(spark, small_lines):
    spark.sql("DROP TABLE IF EXISTS lines_by_order")
    save_bucketed_lines(small_lines.select("order_id", "region", "sales"), "lines_by_order", 4)
    try:
        table = spark.table("lines_by_order")
        sums = table.groupBy("order_id").sum("sales")
        both = table.hint("merge").join(sums, "order_id")
        plan = both._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert both.count() == small_lines.count()
        pairs = table.groupBy("order_id", "region").count()
        assert "Exchange" not in pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.sql("DROP TABLE lines_by_order")


def test_cleaning_leaves_bad_rows_out(spark, tmp_path):
    path = write_raw(tmp_path / "raw.csv", [*[raw_row(i) for i in range(20)], raw_row(30, Sales="ten")])
    table = clean_files(spark, path, str(tmp_path / "clean"), rejected_path=str(tmp_path / "bad"))
    assert table.count() == 20
    assert spark.read.json(str(tmp_path / "bad")).first()["reason"] == "sales is no number"
