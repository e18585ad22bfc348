from __future__ import annotations

from datetime import date

import pytest

from tillwise.operators.shaping import distinct_values
from tillwise.plans import extracts, profile, sql_reports, workbook

LINE = (
    "order_id string, order_date date, customer_id string, customer_name string, segment string,"
    " region string, state string, city string, category string, sub_category string,"
    " product_id string, product_name string, ship_mode string, sales double, profit double,"
    " discount double, quantity int, year int, month int, delivery_days int"
)


def line(**changes):
    base = {
        "order_id": "o1", "order_date": date(2020, 1, 5), "customer_id": "c1",
        "customer_name": "Ann", "segment": "Home", "region": "East", "state": "Ohio",
        "city": "Akron", "category": "Furniture", "sub_category": "Chairs", "product_id": "p1",
        "product_name": "Stool", "ship_mode": "Standard", "sales": 100.0, "profit": 10.0,
        "discount": 0.1, "quantity": 1, "year": 2020, "month": 1, "delivery_days": 3,
    }
    merged = {**base, **changes}
    if "order_date" in changes and changes["order_date"] is not None:
        merged.setdefault("year", 0)
        merged["year"], merged["month"] = changes["order_date"].year, changes["order_date"].month
    return tuple(merged.values())


@pytest.fixture
def lines(rows):
    return lambda *data: rows(list(data), LINE)


def test_sql_growth_restarts_each_january(lines):
    frame = lines(
        line(order_date=date(2019, 12, 1), sales=50.0),
        line(order_date=date(2020, 1, 1), sales=100.0),
        line(order_date=date(2020, 3, 1), sales=0.0),
        line(order_date=date(2020, 4, 1), sales=10.0),
    )
    got = [tuple(r) for r in sql_reports.monthly_revenue_growth(frame).collect()]
    assert got == [
        (2019, 12, 50.0, None, None),
        (2020, 1, 100.0, None, None),
        (2020, 3, 0.0, 100.0, -100.0),
        (2020, 4, 10.0, 0.0, None),
    ]


def test_extract_growth_runs_across_years_per_category(lines):
    frame = lines(
        line(order_date=date(2019, 12, 1), sales=50.0),
        line(order_date=date(2020, 1, 1), sales=100.0),
        line(order_date=date(2020, 1, 1), sales=7.0, category=None),
        line(order_date=date(2020, 2, 1), sales=14.0, category=None),
    )
    got = {
        (r["category"], r["year"], r["month"]): r["mom_growth_pct"]
        for r in extracts.time_trends(frame).collect()
    }
    assert got == {
        ("Furniture", 2019, 12): None,
        ("Furniture", 2020, 1): 100.0,
        (None, 2020, 1): None,
        (None, 2020, 2): None,
    }


def test_yearly_growth_units_differ_between_reports(lines):
    frame = lines(
        line(order_date=date(2019, 1, 1), sales=0.0, profit=0.0),
        line(order_date=date(2020, 1, 1), sales=80.0),
        line(order_date=date(2021, 1, 1), sales=100.0),
        line(order_date=None, sales=5.0, year=2021),
    )
    extract = extracts.executive_summary(frame).collect()
    sheet = workbook.workbook_yearly_summary(frame).collect()
    assert [r["yoy_growth_pct"] for r in extract] == [None, None, 25.0]
    assert [r["yoy_growth"] for r in sheet] == [0.0, 0.0, 0.25]
    assert [r["profit_margin_pct"] for r in extract] == [0.0, 12.5, 10.0]
    assert [r["profit_margin"] for r in sheet] == [0.0, 0.125, 0.1]
    flags = workbook.yearly_growth_flags(frame).collect()
    assert [r["flag"] for r in flags] == ["none", "none", "up"]


def test_loss_that_rounds_to_zero_is_no_loss(lines):
    frame = lines(
        line(product_id="tiny", sales=100000.0, profit=-4.0),
        line(product_id="loss", sales=100.0, profit=-1.0, discount=0.05),
        line(product_id="loss", sales=100.0, profit=-1.0, discount=0.10),
        line(product_id="none", sales=0.0, profit=-9.0),
    )
    got = [tuple(r) for r in sql_reports.negative_margin_products(frame).collect()]
    assert got == [("loss", "Stool", "Furniture", 200.0, -2.0, 7.5, -1.0)]


def test_top_and_bottom_overlap_when_there_are_few_states(lines):
    frame = lines(*[line(state=s, profit=p) for s, p in (("A", 1.0), ("B", 3.0), ("C", 2.0))])
    got = [(r["ranking_group"], r["state"]) for r in sql_reports.state_profit_margin_rank(frame, 2).collect()]
    assert got == [("Top 2", "B"), ("Top 2", "C"), ("Bottom 2", "C"), ("Bottom 2", "A")]


def test_ties_in_top_k_are_settled_by_id(lines):
    frame = lines(*[line(customer_id=c) for c in ("c3", "c1", "c2")])
    got = [r["customer_id"] for r in sql_reports.top_customers(frame, 2).collect()]
    assert got == ["c1", "c2"]


def test_crosstab_counts_other_categories_in_the_total_only(lines):
    frame = lines(line(), line(category="Technology", sales=50.0), line(category="Toys", sales=7.0))
    got = sql_reports.region_category_crosstab(frame).first().asDict()
    assert got["furniture_sales"] == 100.0
    assert got["office_supplies_sales"] == 0.0
    assert got["technology_sales"] == 50.0
    assert got["total_sales"] == 157.0


def test_pivot_drops_null_keys_but_keeps_their_profit(lines):
    frame = lines(
        line(),
        line(category=None, sales=1000.0, profit=5.0),
        line(region=None, sales=500.0, profit=500.0),
        line(region="West", category="Technology", sales=300.0, profit=-30.0),
        line(region="North", category=None, sales=9.0, profit=9.0),
    )
    got = [tuple(r) for r in workbook.workbook_regional_pivot(frame).collect()]
    assert workbook.workbook_regional_pivot(frame).columns == [
        "region", "Furniture", "Technology", "total_sales", "total_profit", "profit_margin",
    ]
    assert got == [
        ("East", 100.0, 0.0, 100.0, 15.0, 0.15),
        ("West", 0.0, 300.0, 300.0, -30.0, -0.1),
        ("Grand Total", 100.0, 300.0, 400.0, -15.0, -0.0375),
    ]
    scale = {r["region"]: r["scale_position"] for r in workbook.regional_margin_scale(frame).collect()}
    assert scale["East"] == pytest.approx(0.5)
    assert scale["West"] == pytest.approx(-0.5)


def test_category_names_may_hold_any_character(lines):
    odd = "O'Neil \\ `x` 5%"
    frame = lines(line(category=odd), line(category="Toys", sales=7.0))
    pivot = workbook.workbook_regional_pivot(frame)
    assert pivot.columns[1:3] == [odd, "Toys"]
    assert tuple(pivot.first())[:4] == ("East", 100.0, 7.0, 107.0)
    crosstab = sql_reports.region_category_crosstab(frame, [odd]).first().asDict()
    assert crosstab["o_neil_x_5_sales"] == 100.0


def test_pivot_refuses_too_many_columns(spark, lines):
    frame = lines(*[line(category=f"k{i}") for i in range(5)])
    before = spark.conf.get("spark.sql.pivotMaxValues")
    spark.conf.set("spark.sql.pivotMaxValues", "4")
    try:
        with pytest.raises(ValueError, match="more than 4 values"):
            distinct_values(frame, "category")
    finally:
        spark.conf.set("spark.sql.pivotMaxValues", before)


def test_segment_lookup_shows_first_segment(lines):
    frame = lines(
        line(customer_id="c1", segment="Home", sales=10.0),
        line(customer_id="c1", segment="Corporate", sales=500.0, order_id="o2"),
        line(customer_id="c2", segment="Home", sales=50.0),
    )
    got = [
        (r["customer_id"], r["segment_lookup"], r["total_revenue"])
        for r in workbook.workbook_top_customers(frame, 3).collect()
    ]
    assert got == [("c1", "Corporate", 500.0), ("c2", "Home", 50.0), ("c1", "Corporate", 10.0)]


def test_null_keys_form_a_group(lines):
    frame = lines(line(segment=None), line())
    assert sql_reports.segment_analysis(frame).count() == 2
    assert extracts.customer_segments(frame).count() == 2


def test_customer_lifetime(lines):
    frame = lines(line(), line(order_date=date(2020, 3, 1), order_id="o2", sales=50.0))
    got = extracts.customer_segments(frame).first().asDict()
    assert got["first_order_date"] == "2020-01-05"
    assert got["customer_lifetime_days"] == 56
    assert (got["order_count"], got["avg_order_value"]) == (2, 75.0)


def test_kpis_of_no_lines(lines):
    got = dict(map(tuple, workbook.workbook_kpis(lines()).collect()))
    assert got == {
        "Total Revenue": 0.0, "Total Profit": 0.0, "Total Orders": 0.0, "Avg Order Value": 0.0,
    }


def test_summary_text(small_lines):
    texts = [r[0] for r in profile.summary_text(profile.final_summary(small_lines)).collect()]
    assert texts[0] == "Total rows: 6,000"
    assert texts[1].startswith("Total revenue: ") and "," in texts[1]
    assert texts[3].endswith("%")
    assert " to " in texts[4]
