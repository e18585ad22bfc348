"""The registered queries in DuckDB SQL, written from the report definitions.

``LINES`` spells out the order-line view over the driver tables; the other helpers are
shared spellings of a sum, a ratio or a tail probability. A tail is integrated from its
density here, so it does not share a method with the package.
"""

from __future__ import annotations

LINES = """
src AS (
  SELECT l_orderkey AS order_id, CAST(o_orderdate AS DATE) AS order_date,
         CAST(l_shipdate AS DATE) AS ship_date, o_orderpriority AS ship_mode,
         o_custkey AS customer_id, c_name AS customer_name, c_mktsegment AS segment,
         s_name AS city, n_name AS state, r_name AS region, l_partkey AS product_id,
         p_type AS category, p_brand AS sub_category, p_name AS product_name,
         l_extendedprice AS sales, CAST(l_quantity AS INTEGER) AS quantity,
         l_discount AS discount,
         round((l_extendedprice * (1 - l_discount) - 2 * l_quantity * p_retailprice)
               * 10000.0) / 10000.0 AS profit
  FROM lineitem
  LEFT JOIN orders ON l_orderkey = o_orderkey
  LEFT JOIN customer ON o_custkey = c_custkey
  LEFT JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN part ON l_partkey = p_partkey
  LEFT JOIN supplier ON l_suppkey = s_suppkey
)"""


def featured(source: str) -> str:
    return f"""
  SELECT *, CAST(year(order_date) AS INTEGER) AS year, CAST(month(order_date) AS INTEGER) AS month,
         CAST(quarter(order_date) AS INTEGER) AS quarter,
         round_even(coalesce(profit / nullif(sales, 0) * 100.0, 0), 2) AS profit_margin_pct,
         round_even(sales * discount, 2) AS discount_impact,
         CAST(date_diff('day', order_date, ship_date) AS INTEGER) AS delivery_days,
         CASE WHEN date_diff('day', order_date, ship_date) <= 0 THEN 'Same day'
              WHEN date_diff('day', order_date, ship_date) <= 2 THEN 'First Class'
              WHEN date_diff('day', order_date, ship_date) <= 4 THEN 'Second Class'
              ELSE 'Standard' END AS delivery_speed
  FROM {source}"""


RAW = """
defects AS (
  SELECT order_id,
         CASE WHEN state = 'NATION_7' THEN NULL
              WHEN sub_category = 'Brand#3' THEN strftime(order_date, '%-m/%-d/%Y')
              WHEN sub_category = 'Brand#4' THEN 'week ' || CAST(quantity AS VARCHAR)
              ELSE strftime(order_date, '%Y-%m-%d') END AS order_date,
         CASE WHEN city = 'Supplier#000000003' THEN NULL
              ELSE strftime(ship_date, '%Y-%m-%d') END AS ship_date,
         CASE WHEN ship_mode <> '5-LOW' THEN ship_mode END AS ship_mode,
         segment, city, state, region, product_id, category, sub_category, product_name,
         sales,
         CASE WHEN discount <> 0.1 THEN quantity END AS quantity,
         CASE WHEN quantity <> 1 THEN discount END AS discount,
         profit
  FROM src
),
raw AS (
  SELECT * FROM defects UNION ALL SELECT * FROM defects WHERE ship_mode = '1-URGENT'
)"""

FILLED = """
filled AS (
  SELECT order_id, coalesce(order_date, 'Unknown') AS order_date,
         coalesce(ship_date, 'Unknown') AS ship_date,
         coalesce(ship_mode, 'Unknown') AS ship_mode, segment, city, state, region, product_id,
         category, sub_category, product_name, sales,
         coalesce(CAST(quantity AS DOUBLE), (SELECT median(quantity) FROM raw)) AS quantity,
         coalesce(discount, (SELECT median(discount) FROM raw)) AS discount, profit
  FROM raw
),
unique_lines AS (SELECT DISTINCT * FROM filled),
parsed AS (
  SELECT * REPLACE (
    CAST(coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%-m/%-d/%Y'))
         AS DATE) AS order_date,
    CAST(coalesce(try_strptime(ship_date, '%Y-%m-%d'), try_strptime(ship_date, '%-m/%-d/%Y'))
         AS DATE) AS ship_date)
  FROM unique_lines
)"""


def lines(body: str, *ctes: str) -> str:
    """A query over ``base``, the clean order lines."""
    parts = [LINES, f"base AS ({featured('src')}\n)", *ctes]
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + body


def raw_lines(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([LINES, RAW, *ctes]) + "\n" + body


def money(column: str) -> str:
    """Sum that does not depend on row order, to eight decimals."""
    return f"CAST(sum(CAST({column} AS DECIMAL(28,8))) AS DOUBLE)"


S, P = money("sales"), money("profit")
SQL_MARGIN = f"round(CASE WHEN {S} = 0 THEN 0 ELSE {P} * 100.0 / {S} END, 2)"
MARGIN = f"round_even(coalesce({P} / nullif({S}, 0) * 100.0, 0), 2)"
FRACTION = f"coalesce({P} / nullif({S}, 0), 0)"
ORDERS = "count(DISTINCT order_id)"
VALUE = f"{S} / {ORDERS}"


def t_tail(t: str, df: str) -> str:
    """Two-sided Student-t tail by the midpoint rule on x = |t| + u / (1 - u)."""
    x = f"(abs({t}) + u / (1 - u))"
    density = (
        f"exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0) - 0.5 * ln({df} * pi())"
        f" - ({df} + 1) / 2.0 * ln(1 + {x} * {x} / {df}))"
    )
    return (
        f"(SELECT sum(2 * {density} / ((1 - u) * (1 - u))) / 20000 FROM"
        f" (SELECT (i + 0.5) / 20000 AS u FROM range(20000) AS r(i)))"
    )


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper F tail by the midpoint rule on x = f + u / (1 - u)."""
    x = f"({f} + u / (1 - u))"
    density = (
        f"exp({d1} / 2.0 * ln({d1} / CAST({d2} AS DOUBLE)) + ({d1} / 2.0 - 1) * ln({x})"
        f" - ({d1} + {d2}) / 2.0 * ln(1 + {d1} * {x} / {d2})"
        f" + lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    )
    return (
        f"(SELECT sum({density} / ((1 - u) * (1 - u))) / 20000 FROM"
        f" (SELECT (i + 0.5) / 20000 AS u FROM range(20000) AS r(i)))"
    )


def verdict(p: str) -> str:
    return f"CASE WHEN {p} < 0.05 THEN 'reject' ELSE 'fail to reject' END"


def matrix(columns: list[str]) -> str:
    rows = []
    for x in columns:
        for y in columns:
            r = "1.0" if x == y else f"round(corr({x}, {y}), 6)"
            rows.append(f"SELECT '{x}' AS column_x, '{y}' AS column_y, CAST({r} AS DOUBLE) AS r FROM base")
            if x == y:
                rows[-1] += " LIMIT 1"
    return " UNION ALL ".join(f"({row})" for row in rows)


def crosstab() -> str:
    parts = []
    for value in ("ECONOMY", "STANDARD", "PROMO", "SMALL", "MEDIUM", "LARGE"):
        for name in ("sales", "profit"):
            part = money(f"CASE WHEN category = '{value}' THEN {name} ELSE 0 END")
            parts.append(f"round({part}, 2) AS {value.lower()}_{name}")
    return (
        f"SELECT region, {', '.join(parts)}, round({S}, 2) AS total_sales,"
        f" round({P}, 2) AS total_profit FROM base GROUP BY region"
    )


def pivot() -> str:
    parts = []
    for value in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"):
        part = money(f"CASE WHEN category = '{value}' THEN sales ELSE 0 END")
        parts.append(f'round({part}, 4) AS "{value}"')
    return (
        f"SELECT CASE WHEN grouping(region) = 1 THEN 'Grand Total' ELSE region END AS region,"
        f" {', '.join(parts)}, round({S}, 4) AS total_sales, round({P}, 4) AS total_profit,"
        f" round({FRACTION}, 6) AS profit_margin FROM base GROUP BY ROLLUP (region)"
    )


def top_and_bottom() -> str:
    return f"""
    , states AS (
      SELECT state, round({S}, 2) AS total_sales, round({P}, 2) AS total_profit,
             {SQL_MARGIN} AS profit_margin_pct
      FROM base GROUP BY state
    ), ranked AS (
      SELECT *, row_number() OVER (ORDER BY profit_margin_pct DESC, total_profit DESC, state) AS hi,
             row_number() OVER (ORDER BY profit_margin_pct, total_profit, state) AS lo FROM states
    )
    SELECT 'Top 5' AS ranking_group, state, total_sales, total_profit, profit_margin_pct
    FROM ranked WHERE hi <= 5
    UNION ALL
    SELECT 'Bottom 5', state, total_sales, total_profit, profit_margin_pct
    FROM ranked WHERE lo <= 5"""


def dense(keys: str = "") -> str:
    """Month totals with zeros between a series' first and last month, as CTE text."""
    on = "".join(f" AND m.{k} = c.{k}" for k in keys.split(", ") if k)
    lead = f"{keys}, " if keys else ""
    by = f"GROUP BY {keys}" if keys else ""
    shown = "".join(f"c.{k}, " for k in keys.split(", ") if k)
    return f"""
    months AS (SELECT {lead}date_trunc('month', order_date) AS start, {S} AS sales
               FROM base GROUP BY {lead}date_trunc('month', order_date)),
    bounds AS (SELECT {lead}min(start) AS lo, max(start) AS hi FROM months {by}),
    calendar AS (SELECT {lead}unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS start FROM bounds),
    dense AS (SELECT {shown}CAST(last_day(c.start) AS DATE) AS month,
                     coalesce(m.sales, 0) AS sales
              FROM calendar c LEFT JOIN months m ON m.start = c.start{on})"""


def naive_pairs(keys: str = "") -> str:
    over = f"PARTITION BY {keys} " if keys else ""
    return f"""
    lagged AS (SELECT *, lag(sales, 12) OVER ({over}ORDER BY month) AS predicted,
                      row_number() OVER ({over}ORDER BY month DESC) AS from_end FROM dense),
    pairs AS (SELECT *, sales AS actual FROM lagged WHERE from_end <= 6)"""


ACCURACY = """round(avg(abs(actual - predicted)), 4) AS mae,
    round(sqrt(avg((actual - predicted) * (actual - predicted))), 4) AS rmse,
    round(avg(abs((actual - predicted) / nullif(actual, 0))) * 100, 6) AS mape"""

ANOVA = """
    groups AS (SELECT region, count(profit_margin_pct) AS n, avg(profit_margin_pct) AS mean,
                      var_samp(profit_margin_pct) AS variance
               FROM base GROUP BY region HAVING count(profit_margin_pct) > 0),
    grand AS (SELECT sum(n * mean) / sum(n) AS mean, sum(n) AS total FROM groups),
    squares AS (SELECT count(*) AS k, any_value(grand.total) AS total,
                       sum(n * (groups.mean - grand.mean) * (groups.mean - grand.mean)) AS ssb,
                       sum((n - 1) * coalesce(variance, 0)) AS ssw
                FROM groups, grand),
    anova AS (SELECT k, CAST(total AS BIGINT) AS total, ssb, ssw, k - 1 AS d1,
                     CAST(total - k AS BIGINT) AS d2,
                     (ssb / (k - 1)) / (ssw / (total - k)) AS f FROM squares)"""

WELCH = """
    sides AS (SELECT count(*) FILTER (discount > 0) AS n1, count(*) FILTER (discount = 0) AS n2,
                     avg(profit_margin_pct) FILTER (discount > 0) AS m1,
                     avg(profit_margin_pct) FILTER (discount = 0) AS m2,
                     var_samp(profit_margin_pct) FILTER (discount > 0) AS v1,
                     var_samp(profit_margin_pct) FILTER (discount = 0) AS v2 FROM base),
    welch AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS t,
                     pow(v1 / n1 + v2 / n2, 2)
                     / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)) AS df FROM sides)"""

CORRELATED = """
    pairs AS (SELECT 'discount' AS column_x, 'profit_margin_pct' AS column_y, count(*) AS n,
                     corr(discount, profit_margin_pct) AS r FROM base
              UNION ALL
              SELECT 'sales', 'profit', count(*), corr(sales, profit) FROM base),
    tests AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t, n - 2 AS df FROM pairs)"""

SEASONS = f"""
    seasons AS (SELECT year, month, strftime(make_date(2000, month, 1), '%b') AS month_label,
                       {S} AS revenue FROM base GROUP BY year, month)"""


#: Coefficients that the likelihood and the given forecast are compared at.
GIVEN = (0.3, 0.2, -0.6, -0.5)


def levinson(keys: str) -> str:
    """``steps``: the best linear prediction of each differenced month from all before it, at the GIVEN
    coefficients, by the Durbin-Levinson recursion over autocovariances in closed form. Each key's
    series is there whole (cut 0) and without its last six months (cut 6); beyond its end the prediction
    stands in for the value, six times."""
    a, big_a, m, big_m = GIVEN
    named = ", ".join(f"s.{k.strip()}" for k in keys.split(","))

    def first(ar: float, ma: float, lag: str) -> str:
        zero = (1 + ma * ma + 2 * ar * ma) / (1 - ar * ar)
        one = (1 + ar * ma) * (ar + ma) / (1 - ar * ar)
        return f"CASE WHEN {lag} = 0 THEN {zero!r} ELSE {one!r} * pow({ar!r}, {lag} - 1) END"

    return f"""
    lags AS (
      SELECT list(g ORDER BY h) AS g FROM (
        SELECT h, sum(({first(big_a, big_m, 'abs(k)')}) * ({first(a, m, 'abs(h - 12 * k)')})) AS g
        FROM range(0, 400) AS t(h), range(-60, 61) AS u(k) GROUP BY h)
    ), listed AS (
      SELECT {keys}, list(sales ORDER BY month) AS all_y, max(month) AS final FROM dense GROUP BY {keys}
      HAVING count(*) > 18
    ), cuts AS (
      SELECT {keys}, cut, all_y, final, all_y[1:len(all_y) - cut] AS y
      FROM listed, (VALUES (0), (6)) AS c(cut) WHERE len(all_y) - cut > 13
    ), started AS (
      SELECT *, list_transform(range(14, len(y) + 1), lambda i: y[i] - y[i - 1] - y[i - 12] + y[i - 13]) AS w
      FROM cuts
    ), steps AS (
      WITH RECURSIVE r AS (
        SELECT {keys}, cut, all_y, final, y, w, len(w) AS months, 1 AS n, CAST([] AS DOUBLE[]) AS phi, g[1] AS v,
               w[1] * w[1] / g[1] AS squares, ln(g[1]) AS logs
        FROM started, lags
        UNION ALL
        SELECT {named}, cut, all_y, final,
               CASE WHEN n < months THEN y
                 ELSE list_append(y, p + y[len(y)] + y[len(y) - 11] - y[len(y) - 12]) END,
               CASE WHEN n < months THEN w ELSE list_append(w, p) END,
               months, n + 1, next_phi, next_v,
               CASE WHEN n < months THEN squares + (w[n + 1] - p) * (w[n + 1] - p) / next_v ELSE squares END,
               CASE WHEN n < months THEN logs + ln(next_v) ELSE logs END
        FROM (
          SELECT *, list_sum(list_transform(range(1, n + 1), lambda j: next_phi[j] * w[n + 1 - j])) AS p
          FROM (
            SELECT *, v * (1 - k * k) AS next_v, list_append(
              list_transform(range(1, n), lambda j: phi[j] - k * phi[n - j]), k) AS next_phi
            FROM (
              SELECT r.*, (g[n + 1] - coalesce(list_sum(
                list_transform(range(1, n), lambda j: phi[j] * g[n + 1 - j])), 0)) / v AS k
              FROM r, lags WHERE n < months + 6)
          )
        ) s
      ) SELECT * FROM r
    )"""


def oracle_sql() -> dict[str, str]:
    sql: dict[str, str] = {}

    # SQL reports
    sql["yearly_kpis"] = lines(
        f"SELECT year, round({S}, 2) AS total_revenue, round({P}, 2) AS total_profit,"
        f" {ORDERS} AS total_orders, round({VALUE}, 2) AS average_order_value"
        " FROM base GROUP BY year"
    )
    sql["top_customers"] = lines(
        f"SELECT customer_id, customer_name, round({S}, 2) AS total_revenue,"
        f" round({P}, 2) AS total_profit, {SQL_MARGIN} AS profit_margin_pct"
        " FROM base GROUP BY customer_id, customer_name"
        " ORDER BY total_revenue DESC, total_profit DESC, customer_id LIMIT 10"
    )
    sql["region_category_crosstab"] = lines(crosstab())
    sql["monthly_revenue_growth"] = lines(
        f"""
    , m AS (SELECT year, month, {S} AS revenue FROM base GROUP BY year, month),
    g AS (SELECT *, lag(revenue) OVER (PARTITION BY year ORDER BY month) AS before FROM m)
    SELECT year, month, round(revenue, 2) AS monthly_revenue,
           round(before, 2) AS previous_month_revenue,
           round((round(revenue, 2) - before) * 100.0 / nullif(before, 0), 2) AS revenue_growth_pct
    FROM g"""
    )
    sql["negative_margin_products"] = lines(
        f"SELECT product_id, product_name, category, round({S}, 2) AS total_sales,"
        f" round({P}, 2) AS total_profit,"
        f" round({money('discount')} / count(discount) * 100.0, 2) AS avg_discount_pct,"
        f" {SQL_MARGIN} AS profit_margin_pct"
        f" FROM base GROUP BY product_id, product_name, category HAVING {SQL_MARGIN} < 0"
    )
    sql["segment_analysis"] = lines(
        f"SELECT segment, {ORDERS} AS order_frequency, round({S}, 2) AS total_revenue,"
        f" round({P}, 2) AS total_profit, round({VALUE}, 2) AS average_order_value,"
        " count(DISTINCT customer_id) AS unique_customers FROM base GROUP BY segment"
    )
    sql["state_profit_margin_rank"] = lines(top_and_bottom())
    sql["ship_mode_impact"] = lines(
        "SELECT ship_mode, round(avg(delivery_days), 2) AS average_delivery_days,"
        f" {ORDERS} AS total_orders, round({S}, 2) AS total_revenue,"
        f" round({P}, 2) AS total_profit, {SQL_MARGIN} AS profit_margin_pct"
        " FROM base GROUP BY ship_mode"
    )

    # dashboard extracts
    sql["executive_summary"] = lines(
        f"""
    , y AS (SELECT year, {S} AS s, {P} AS p, {ORDERS} AS n FROM base GROUP BY year),
    g AS (SELECT *, lag(s) OVER (ORDER BY year) AS before FROM y)
    SELECT year, round_even(s, 2) AS total_sales, round_even(p, 2) AS total_profit,
           n AS total_orders, round_even(s / n, 2) AS avg_order_value,
           round_even(coalesce(p / nullif(s, 0) * 100.0, 0), 2) AS profit_margin_pct,
           round_even((s / nullif(before, 0) - 1.0) * 100, 2) AS yoy_growth_pct
    FROM g"""
    )
    cells = "region, state, city, category, sub_category"
    sql["regional_performance"] = lines(
        f"SELECT {cells}, round_even({S}, 2) AS sales, round_even({P}, 2) AS profit,"
        f" {MARGIN} AS profit_margin_pct, {ORDERS} AS orders FROM base GROUP BY {cells}"
    )
    customer = "customer_id, customer_name, segment"
    sql["customer_segments"] = lines(
        f"SELECT {customer}, round_even({S}, 2) AS total_sales, round_even({P}, 2) AS total_profit,"
        f" {ORDERS} AS order_count, round_even({VALUE}, 2) AS avg_order_value,"
        " strftime(min(order_date), '%Y-%m-%d') AS first_order_date,"
        " strftime(max(order_date), '%Y-%m-%d') AS last_order_date,"
        " CAST(max(order_date) - min(order_date) AS INTEGER) AS customer_lifetime_days"
        f" FROM base GROUP BY {customer}"
    )
    sql["time_trends"] = lines(
        f"""
    , t AS (SELECT year, month, quarter, category, {S} AS s, {P} AS p, {ORDERS} AS n
            FROM base GROUP BY year, month, quarter, category),
    g AS (SELECT *, lag(s) OVER (PARTITION BY category ORDER BY year, month) AS before FROM t)
    SELECT year, month, quarter, category, round_even(s, 2) AS sales, round_even(p, 2) AS profit,
           n AS orders, round_even((s / nullif(before, 0) - 1.0) * 100, 2) AS mom_growth_pct
    FROM g"""
    )
    product = "category, sub_category, product_name"
    product_body = (
        f"{{}} FROM base GROUP BY {product}"
    )
    sql["product_performance"] = lines(
        product_body.format(
            f"SELECT {product}, round_even({S}, 2) AS total_sales,"
            f" round_even({P}, 2) AS total_profit, {MARGIN} AS profit_margin_pct,"
            f" {ORDERS} AS order_count,"
            f" round_even({money('discount')} / count(discount), 4) AS avg_discount"
        )
    )
    sql["product_performance_headers"] = lines(
        product_body.format(
            'SELECT category AS "Category", sub_category AS "Sub-Category",'
            f' product_name AS "Product Name", round_even({S}, 2) AS "Total Sales",'
            f' round_even({P}, 2) AS "Total Profit", {MARGIN} AS "Profit Margin %",'
            f' {ORDERS} AS "Order Count",'
            f' round_even({money("discount")} / count(discount), 4) AS "Avg Discount"'
        )
    )

    # workbook tables
    yearly = f"""
    , y AS (SELECT year, {S} AS s, {P} AS p, {ORDERS} AS n FROM base GROUP BY year),
    g AS (SELECT *, coalesce(s / nullif(lag(s) OVER (ORDER BY year), 0) - 1.0, 0) AS growth FROM y)"""
    sql["workbook_yearly_summary"] = lines(
        yearly
        + """
    SELECT year, round(s, 4) AS total_revenue, round(p, 4) AS total_profit, n AS total_orders,
           round(s / n, 6) AS avg_order_value, round(coalesce(p / nullif(s, 0), 0), 6) AS profit_margin,
           round(growth, 6) AS yoy_growth FROM g"""
    )
    sql["yearly_growth_flags"] = lines(
        yearly
        + """
    SELECT year, round(growth, 6) AS yoy_growth,
           CASE WHEN growth > 0 THEN 'up' WHEN growth < 0 THEN 'down' ELSE 'none' END AS flag
    FROM g"""
    )
    sql["workbook_regional_pivot"] = lines(pivot())
    sql["regional_margin_scale"] = lines(
        f"""
    , m AS (SELECT CASE WHEN grouping(region) = 1 THEN 'Grand Total' ELSE region END AS region,
                   {FRACTION} AS margin FROM base GROUP BY ROLLUP (region))
    SELECT region, round(margin, 6) AS profit_margin,
           round(CASE WHEN margin < 0 THEN greatest(margin / 0.2, -1) ELSE least(margin / 0.3, 1) END, 6)
             AS scale_position FROM m"""
    )
    sql["workbook_top_customers"] = lines(
        f"""
    , c AS (SELECT {customer}, {S} AS s, {P} AS p, {ORDERS} AS n FROM base GROUP BY {customer}),
    first_segment AS (SELECT customer_id, min(segment) AS segment_lookup FROM base GROUP BY customer_id)
    SELECT c.customer_id, customer_name, segment_lookup, round(s, 4) AS total_revenue,
           round(p, 4) AS total_profit, n AS order_count, round(s / n, 6) AS avg_order_value
    FROM c JOIN first_segment f ON c.customer_id = f.customer_id
    ORDER BY s DESC, p DESC, c.customer_id LIMIT 20"""
    )
    sql["workbook_product_performance"] = lines(
        product_body.format(
            f"SELECT {product}, round({S}, 4) AS sales, round({P}, 4) AS profit,"
            f" {ORDERS} AS order_count, round({FRACTION}, 6) AS margin"
        )
    )
    sql["workbook_kpis"] = lines(
        f"""
    , k AS (SELECT {S} AS s, {P} AS p, CAST({ORDERS} AS DOUBLE) AS n FROM base)
    SELECT 'Total Revenue' AS metric, round(s, 4) AS value FROM k
    UNION ALL SELECT 'Total Profit', round(p, 4) FROM k
    UNION ALL SELECT 'Total Orders', n FROM k
    UNION ALL SELECT 'Avg Order Value', round(s / n, 4) FROM k"""
    )

    # cleaning
    clean = featured("parsed WHERE order_date IS NOT NULL AND ship_date IS NOT NULL")
    sql["cleaned_sales"] = raw_lines(
        f"SELECT * REPLACE (strftime(order_date, '%Y-%m-%d') AS order_date,"
        f" strftime(ship_date, '%Y-%m-%d') AS ship_date) FROM ({clean})",
        FILLED,
    )
    undated = "order_date IS NULL OR ship_date IS NULL"
    sql["cleaning_summary"] = raw_lines(
        f"""
    SELECT (SELECT count(*) FROM raw) AS rows_read,
           (SELECT count(*) FROM raw) - count(*) AS duplicates_removed,
           count(*) FILTER ({undated}) AS invalid_date_rows,
           count(*) FILTER (NOT ({undated})) AS rows_kept FROM parsed""",
        FILLED,
    )
    sql["median_filled_numbers"] = raw_lines(
        "SELECT order_id, product_id, sales, quantity, discount, profit FROM filled", FILLED
    )
    sql["tolerant_dates"] = raw_lines(
        "SELECT year(order_date) AS order_year, count(*) AS line_count,"
        " count(ship_date) AS shipped_count FROM parsed GROUP BY 1",
        FILLED,
    ).replace("year(order_date)", "CAST(year(order_date) AS INTEGER)")
    columns = (
        "order_id order_date ship_date ship_mode segment city state region product_id category"
        " sub_category product_name sales quantity discount profit"
    ).split()
    spellings = {"yyyy-MM-dd": "%Y-%m-%d", "M/d/yyyy": "%-m/%-d/%Y", "d/M/yyyy": "%-d/%-m/%Y"}
    twins = {"M/d/yyyy": "d/M/yyyy", "d/M/yyyy": "M/d/yyyy"}

    def is_date(column: str, shown: str) -> str:
        return f"try_strptime({column}, '{spellings[shown]}') IS NOT NULL"

    sql["date_format_coverage"] = raw_lines(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, '{f}' AS date_format, count({c}) AS text_count,"
            f" count(*) FILTER ({is_date(c, f)}) AS parsed_count,"
            f" count(*) FILTER ({is_date(c, f)}"
            f"{f' AND NOT ({is_date(c, twins[f])})' if f in twins else ''}) AS alone_count FROM raw"
            for c in ("order_date", "ship_date")
            for f in spellings
        )
    )
    sql["raw_null_counts"] = raw_lines(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS null_count FROM raw"
            for c in columns
        )
    )
    sql["table_shape"] = lines(
        "SELECT count(*) AS row_count, max(n) AS column_count FROM base,"
        " (SELECT count(*) AS n FROM (DESCRIBE SELECT * FROM base))"
    )
    sql["delivery_speeds"] = lines(
        "SELECT delivery_speed, count(*) AS line_count, min(delivery_days) AS fewest_days,"
        " max(delivery_days) AS most_days FROM base GROUP BY delivery_speed"
    )
    sql["eda_top_categories"] = lines(
        f"SELECT category, round({S}, 4) AS total_sales FROM base GROUP BY category"
        " ORDER BY total_sales DESC, category LIMIT 5"
    )
    sql["eda_top_states"] = lines(
        f"SELECT state, round({P}, 4) AS total_profit FROM base GROUP BY state"
        " ORDER BY total_profit DESC, state LIMIT 5"
    )
    sql["final_summary"] = lines(
        f"SELECT count(*) AS total_rows, round({S}, 4) AS total_revenue,"
        f" round({P}, 4) AS total_profit, round(avg(profit_margin_pct), 6) AS average_profit_margin,"
        " strftime(min(order_date), '%Y-%m-%d') AS first_order_date,"
        " strftime(max(order_date), '%Y-%m-%d') AS last_order_date FROM base"
    )

    # statistics
    sql["correlation_analysis"] = lines(
        f"""
    SELECT column_x, column_y, n, round(r, 6) AS r, round(t, 6) AS t_stat, df,
           round(p, 6) AS p_value, {verdict('p')} AS verdict
    FROM (SELECT *, {t_tail('t', 'df')} AS p FROM tests)""",
        CORRELATED,
    )
    sql["sales_correlation_matrix"] = lines(matrix(["sales", "profit", "discount", "quantity"]))
    sql["margin_correlation_matrix"] = lines(
        matrix(["discount", "profit_margin_pct", "sales", "profit"])
    )
    sql["regional_anova"] = lines(
        f"""
    SELECT k AS groups, total AS total_n, round(ssb, 4) AS between_ss, round(ssw, 4) AS within_ss,
           d1 AS df_between, d2 AS df_within, round(f, 6) AS f_stat, round(p, 6) AS p_value,
           {verdict('p')} AS verdict
    FROM (SELECT *, {f_tail('f', 'd1', 'd2')} AS p FROM anova)""",
        ANOVA,
    )
    sql["region_margin_means"] = lines(
        "SELECT region, round(avg(profit_margin_pct), 6) AS mean FROM base GROUP BY region"
    )
    sql["discount_ttest"] = lines(
        f"""
    SELECT round(m1, 6) AS discounted_avg_margin, round(m2, 6) AS non_discounted_avg_margin,
           n1 AS discounted_count, n2 AS non_discounted_count, round(t, 6) AS t_stat,
           round(df, 4) AS df, round(p, 6) AS p_value, {verdict('p')} AS verdict
    FROM (SELECT *, {t_tail('t', 'df')} AS p FROM welch)""",
        WELCH,
    )
    sql["discount_split_means"] = lines(
        "SELECT round(avg(profit_margin_pct) FILTER (discount >= 0.05), 6) AS high_discount_margin,"
        " round(avg(profit_margin_pct) FILTER (discount < 0.05), 6) AS low_discount_margin,"
        " count(*) FILTER (discount >= 0.05) AS high_discount_count,"
        " count(*) FILTER (discount < 0.05) AS low_discount_count FROM base"
    )
    sql["segment_profitability"] = lines(
        """
    SELECT segment, round(avg(m), 6) AS mean, count(m) AS count, round(stddev_samp(m), 6) AS std,
           round(stddev_samp(m) / sqrt(count(m)), 6) AS sem,
           round(coalesce(1.96 * (stddev_samp(m) / sqrt(count(m))), 0), 6) AS ci95
    FROM (SELECT segment, profit_margin_pct AS m FROM base) GROUP BY segment"""
    )
    sql["revenue_seasonality"] = lines(
        "SELECT year, month, month_label, round(revenue, 4) AS revenue FROM seasons", SEASONS
    )
    sql["best_and_worst_month"] = lines(
        """
    SELECT * FROM (SELECT 'best' AS place, year, month, month_label, round(revenue, 4) AS revenue
                   FROM seasons s ORDER BY s.revenue DESC, year, month LIMIT 1)
    UNION ALL
    SELECT * FROM (SELECT 'worst', year, month, month_label, round(revenue, 4)
                   FROM seasons s ORDER BY s.revenue, year, month LIMIT 1)""",
        SEASONS,
    )
    figures = """
    SELECT 1 AS insight_no, 'sales and profit' AS topic,
           CASE WHEN abs(r) >= 0.5 THEN 'strong' ELSE 'moderate' END AS finding,
           round(r, 6) AS statistic, round(p, 6) AS p_value FROM tails WHERE column_x = 'sales'
    UNION ALL
    SELECT 2, 'discount and margin',
           CASE WHEN r < 0 THEN 'discounts lower margin' ELSE 'no clear effect' END,
           round(r, 6), round(p, 6) FROM tails WHERE column_x = 'discount'
    UNION ALL
    SELECT 3, 'regions', CASE WHEN p < 0.05 THEN 'regions differ' ELSE 'not separated' END,
           round(f, 6), round(p, 6) FROM f
    UNION ALL
    SELECT 4, 'segments', (SELECT segment FROM seg ORDER BY m DESC, segment LIMIT 1),
           round((SELECT max(m) - min(m) FROM seg), 6), NULL
    UNION ALL
    SELECT * FROM (SELECT 5, 'seasonality', month_label || ' ' || CAST(year AS VARCHAR),
           round(revenue, 6), CAST(NULL AS DOUBLE) FROM seasons ORDER BY revenue DESC, year, month LIMIT 1)
    UNION ALL
    SELECT 6, 'discount threshold', CASE WHEN hi < lo THEN 'lower above' ELSE 'not lower above' END,
           round(hi - lo, 6), NULL FROM split
    UNION ALL
    SELECT 7, 'discounted lines', CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END,
           round(t, 6), round(p, 6) FROM w"""
    insight_tables = f"""
    , tails AS (SELECT column_x, r, {t_tail('t', 'df')} AS p FROM tests),
    f AS (SELECT f, {f_tail('f', 'd1', 'd2')} AS p FROM anova),
    w AS (SELECT t, {t_tail('t', 'df')} AS p FROM welch),
    seg AS (SELECT segment, avg(profit_margin_pct) AS m FROM base GROUP BY segment),
    split AS (SELECT avg(profit_margin_pct) FILTER (discount >= 0.05) AS hi,
                     avg(profit_margin_pct) FILTER (discount < 0.05) AS lo FROM base)"""
    messages = """
    , reg AS (SELECT region, avg(profit_margin_pct) AS m FROM base GROUP BY region),
    figures AS ({figures}),
    messages AS (
    SELECT 1 AS insight_no, printf('Sales and profit are linked to a %s degree (r = %.3f, p = %.4f); grow'
           ' revenue where margins hold.', CASE WHEN abs(r) >= 0.5 THEN 'strong' ELSE 'moderate' END, r, p) AS message
    FROM tails WHERE column_x = 'sales'
    UNION ALL
    SELECT 2, printf('Discount against margin: %s (r = %.3f, p = %.4f); discounted lines average'
           ' %.2f%%, others %.2f%%. Approve deep discounts case by case.',
           CASE WHEN r < 0 THEN 'discounts lower margin' ELSE 'no clear effect' END, r, p, m1, m2)
    FROM (SELECT r, p FROM tails WHERE column_x = 'discount'), (SELECT m1, m2 FROM welch)
    UNION ALL
    SELECT 3, printf('Margin by region: %s (p = %.4f). Best is %s at %.2f%%, weakest %s at %.2f%%.',
           CASE WHEN p < 0.05 THEN 'regions differ' ELSE 'not separated' END, p, b.region, b.m, l.region, l.m)
    FROM f, (SELECT * FROM reg ORDER BY m DESC, region LIMIT 1) b, (SELECT * FROM reg ORDER BY m, region LIMIT 1) l
    UNION ALL
    SELECT 4, printf('Segment %s leads with a margin of %.2f%%, %s trails with %.2f%%.',
           b.segment, b.m, l.segment, l.m)
    FROM (SELECT * FROM seg ORDER BY m DESC, segment LIMIT 1) b, (SELECT * FROM seg ORDER BY m, segment LIMIT 1) l
    UNION ALL
    SELECT 5, 'Revenue peaked in ' || b.month_label || ' ' || b.year || ' at ' || format('{{:,.2f}}', b.revenue)
           || ' and was lowest in ' || l.month_label || ' ' || l.year || ' at ' || format('{{:,.2f}}', l.revenue) || '.'
    FROM (SELECT * FROM seasons s ORDER BY s.revenue DESC, year, month LIMIT 1) b,
         (SELECT * FROM seasons s ORDER BY s.revenue, year, month LIMIT 1) l
    UNION ALL
    SELECT 6, printf('Lines discounted 5%% or more average a margin of %.2f%%, others %.2f%%.', hi, lo) FROM split
    UNION ALL
    SELECT 7, printf('The margin gap between discounted and other lines is %s (p = %.4f).',
           CASE WHEN p < 0.05 THEN 'significant' ELSE 'not significant' END, p) FROM w)
    SELECT * FROM figures JOIN messages USING (insight_no)"""
    for name, text in (
        ("business_insights", figures),
        ("business_insight_messages", messages.replace("{figures}", figures).replace("{{", "{").replace("}}", "}")),
    ):
        sql[name] = lines(insight_tables + text, CORRELATED, ANOVA, WELCH, SEASONS)

    # monthly series
    shown = "strftime(month, '%Y-%m-%d') AS month"
    keyed = "region, category"
    sql["monthly_series"] = lines(f"SELECT {shown}, round(sales, 4) AS sales FROM dense", dense())
    sql["keyed_monthly_series"] = lines(
        f"SELECT {keyed}, {shown}, round(sales, 4) AS sales FROM dense", dense(keyed)
    )
    described = (
        "count(*) AS months, strftime(min(month), '%Y-%m-%d') AS first_month,"
        " strftime(max(month), '%Y-%m-%d') AS last_month, 6 AS held_out,"
        " CASE WHEN count(*) > 18 THEN 'ok' ELSE 'too_short' END AS status"
    )
    sql["series_description"] = lines(f"SELECT {described} FROM dense", dense())
    sql["keyed_series_description"] = lines(
        f"SELECT {keyed}, {described} FROM dense GROUP BY {keyed}", dense(keyed)
    )
    sql["hold_out_split"] = lines(
        f"""
    SELECT {shown}, round(sales, 4) AS sales,
           CASE WHEN row_number() OVER (ORDER BY month DESC) <= 6 THEN 'test' ELSE 'train' END AS part
    FROM dense""",
        dense(),
    )
    sql["naive_forecast_accuracy"] = lines(f"SELECT {ACCURACY} FROM pairs", dense(), naive_pairs())
    sql["keyed_naive_forecast_accuracy"] = lines(
        f"SELECT {keyed}, {ACCURACY} FROM pairs GROUP BY {keyed}", dense(keyed), naive_pairs(keyed)
    )
    sql["keyed_forecast_months"] = lines(
        f"""
    , counted AS (SELECT *, row_number() OVER (PARTITION BY {keyed} ORDER BY month DESC) AS from_end,
                         count(*) OVER (PARTITION BY {keyed}) AS length FROM dense),
    ends AS (SELECT {keyed}, max(month) AS final FROM dense GROUP BY {keyed} HAVING count(*) > 18)
    SELECT {keyed}, 'held_out' AS phase, {shown}, round(sales, 4) AS actual_sales
    FROM counted WHERE from_end <= 6 AND length > 18
    UNION ALL
    SELECT {keyed}, 'future',
           strftime(last_day(CAST(final + to_months(CAST(k AS INTEGER)) AS DATE)), '%Y-%m-%d'), NULL
    FROM ends, range(1, 7) AS steps(k)""",
        dense(keyed),
    )
    sql["keyed_model_likelihood"] = lines(
        f"""
    SELECT {keyed}, months AS differenced_months,
           round(-0.5 * (months * (ln(2 * pi() * squares / months) + 1) + logs), 6) AS log_likelihood,
           round(squares / months, 2) AS variance
    FROM steps WHERE cut = 0 AND n = months""",
        dense(keyed), levinson(keyed),
    )
    sql["keyed_given_forecast"] = lines(
        f"""
    SELECT {keyed}, CASE WHEN cut = 0 THEN 'future' ELSE 'held_out' END AS phase,
           strftime(last_day(CAST(date_trunc('month', final) + to_months(CAST(k - cut AS INTEGER)) AS DATE)),
             '%Y-%m-%d') AS month,
           round(CASE WHEN cut = 6 THEN all_y[len(all_y) - 6 + k] END, 4) AS actual_sales,
           round(y[len(y) - 6 + k], 4) AS predicted_sales
    FROM steps, range(1, 7) AS t(k) WHERE n = months + 6""",
        dense(keyed), levinson(keyed),
    )
    sql["unusable_line_count"] = raw_lines(
        "SELECT count(*) FILTER (order_date IS NULL) AS dropped_rows, count(*) AS rows_read"
        " FROM (SELECT coalesce(try_strptime(order_date, '%Y-%m-%d'),"
        " try_strptime(order_date, '%-m/%-d/%Y')) AS order_date FROM raw)"
    )
    return sql
