"""Business insights: rules over the statistics, worded, from a single scan.

The lines are reduced once to mergeable moment states per region, segment, year and month. The
overall, regional, segment and monthly figures are merged from these cells, and all rules are
evaluated on that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwise.functions.tails import f_p_value, t_p_value
from tillwise.operators.hypothesis import (
    pearson_t,
    split_moments,
    variance_parts,
    welch_statistics,
    with_f_statistic,
)
from tillwise.operators.keep import keep_small
from tillwise.operators.moments import correlation_of, count_of, mean_of, pair_name, rolled_up
from tillwise.plans.significance import (
    HIGH_DISCOUNT,
    MARGIN,
    SUBSETS,
    TESTED_PAIRS,
    month_label,
    statistic_cells,
)

ALPHA = 0.05
STRONG = 0.5


LEVELS = {"all": [], "region": ["region"], "segment": ["segment"], "month": ["year", "month"]}


def figures(cells: DataFrame) -> DataFrame:
    """All measures for the whole table and per region, segment and month, from kept cells."""
    margin, (of_discount, of_profit) = pair_name(MARGIN), (pair_name(x, y) for x, y in TESTED_PAIRS)
    rows = None
    for level, keys in LEVELS.items():
        names = [margin, of_discount, of_profit, *SUBSETS] if level == "all" else [margin]
        sums = ["revenue"] if level == "month" else []
        level_rows = rolled_up(cells, keys, names, sums).select(
            F.lit(level).alias("level"), *keys, margin, mean_of(margin).alias("mean"),
            *(F.coalesce(s, F.lit(0.0)).alias(s) for s in sums),
            *(
                [
                    count_of(of_discount).alias("discount_n"), correlation_of(of_discount).alias("discount_r"),
                    count_of(of_profit).alias("profit_n"), correlation_of(of_profit).alias("profit_r"),
                    mean_of("high_part").alias("high_mean"), mean_of("low_part").alias("low_mean"),
                    *split_moments(*SUBSETS[:2]),
                ]
                if level == "all"
                else []
            ),
        )
        rows = level_rows if rows is None else rows.unionByName(level_rows, allowMissingColumns=True)
    return rows


def _overall(name: str) -> Column:
    return F.max(F.when(F.col("level") == "all", F.col(name))).alias(name)


def _extreme(level: str, key: Column, *shown: str) -> Column:
    """Figures of the first row of a level by ``key`` and then by the figures' names."""
    picked = F.struct(key.alias("order"), *shown)
    return F.min(F.when((F.col("level") == level) & key.isNotNull(), picked))


def _one_row(cells: DataFrame) -> DataFrame:
    moments = [f"{side}_{m}" for side in ("first", "second") for m in ("n", "mean", "var")]
    single = ["discount_n", "discount_r", "profit_n", "profit_r", "high_mean", "low_mean"]
    row = keep_small(figures(cells)).agg(
        *[_overall(name) for name in [*single, *moments]],
        *variance_parts(pair_name(MARGIN), "level = 'region'"),
        _extreme("region", -F.col("mean"), "region", "mean").alias("best_region"),
        _extreme("region", F.col("mean"), "region", "mean").alias("worst_region"),
        _extreme("segment", -F.col("mean"), "segment", "mean").alias("best_segment"),
        _extreme("segment", F.col("mean"), "segment", "mean").alias("worst_segment"),
        _extreme("month", -F.col("revenue"), "year", "month", "revenue").alias("best_month"),
        _extreme("month", F.col("revenue"), "year", "month", "revenue").alias("worst_month"),
    )
    tested = welch_statistics(with_f_statistic(row))
    return tested.withColumns(
        {
            "discount_p": t_p_value(
                pearson_t(F.col("discount_r"), F.col("discount_n")), F.col("discount_n") - 2
            ),
            "profit_p": t_p_value(
                pearson_t(F.col("profit_r"), F.col("profit_n")), F.col("profit_n") - 2
            ),
            "region_p": f_p_value(F.col("f_stat"), F.col("df_between"), F.col("df_within")),
            "split_p": t_p_value(F.col("t_stat"), F.col("df")),
        }
    )


def _insight(
    number: int, topic: str, finding: Column, statistic: Column, p: Column, text: Column
) -> Column:
    return F.struct(
        F.lit(number).alias("insight_no"),
        F.lit(topic).alias("topic"),
        finding.alias("finding"),
        statistic.cast("double").alias("statistic"),
        p.cast("double").alias("p_value"),
        text.alias("message"),
    )


def business_insights(lines: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    """One row per insight: which way its rule went, the figures behind it, and a sentence.

    The comparison at the discount threshold appears only when both sides have lines.
    """
    used = [pair_name(MARGIN), *(pair_name(x, y) for x, y in TESTED_PAIRS), *SUBSETS]
    cells = statistic_cells(lines, threshold).select("region", "segment", "year", "month", *used, "revenue")
    return insights_of_cells(keep_small(cells), threshold)


def insights_of_cells(cells: DataFrame, threshold: float = HIGH_DISCOUNT) -> DataFrame:
    """The insights from kept cells, which were made with the same threshold."""
    c = F.col
    no_p = F.lit(None).cast("double")
    strong = F.when(F.abs("profit_r") >= STRONG, "strong").otherwise("moderate")
    hurts = F.when(c("discount_r") < 0, "discounts lower margin").otherwise("no clear effect")
    differ = F.when(c("region_p") < ALPHA, "regions differ").otherwise("not separated")
    split = F.when(c("split_p") < ALPHA, "significant").otherwise("not significant")
    share = round(threshold * 100)

    def month(at: str) -> list[Column]:
        return [month_label(c(f"{at}.month")), c(f"{at}.year"), c(f"{at}.revenue")]

    rows = [
        _insight(
            1, "sales and profit", strong, c("profit_r"), c("profit_p"),
            F.format_string(
                "Sales and profit are linked to a %s degree (r = %.3f, p = %.4f); grow revenue"
                " where margins hold.", strong, c("profit_r"), c("profit_p")),
        ),
        _insight(
            2, "discount and margin", hurts, c("discount_r"), c("discount_p"),
            F.format_string(
                "Discount against margin: %s (r = %.3f, p = %.4f); discounted lines average"
                " %.2f%%, others %.2f%%. Approve deep discounts case by case.",
                hurts, c("discount_r"), c("discount_p"), c("first_mean"), c("second_mean")),
        ),
        _insight(
            3, "regions", differ, c("f_stat"), c("region_p"),
            F.format_string(
                "Margin by region: %s (p = %.4f). Best is %s at %.2f%%, weakest %s at %.2f%%.",
                differ, c("region_p"), c("best_region.region"), c("best_region.mean"),
                c("worst_region.region"), c("worst_region.mean")),
        ),
        _insight(
            4, "segments", c("best_segment.segment"),
            c("best_segment.mean") - c("worst_segment.mean"), no_p,
            F.format_string(
                "Segment %s leads with a margin of %.2f%%, %s trails with %.2f%%.",
                c("best_segment.segment"), c("best_segment.mean"),
                c("worst_segment.segment"), c("worst_segment.mean")),
        ),
        _insight(
            5, "seasonality",
            F.format_string("%s %d", *month("best_month")[:2]), c("best_month.revenue"), no_p,
            F.format_string(
                "Revenue peaked in %s %d at %,.2f and was lowest in %s %d at %,.2f.",
                *month("best_month"), *month("worst_month")),
        ),
        _insight(
            6, "discount threshold",
            F.when(c("high_mean") < c("low_mean"), "lower above").otherwise("not lower above"),
            c("high_mean") - c("low_mean"), no_p,
            F.format_string(
                f"Lines discounted {share}%% or more average a margin of %.2f%%, others %.2f%%.",
                c("high_mean"), c("low_mean")),
        ),
        _insight(
            7, "discounted lines", split, c("t_stat"), c("split_p"),
            F.format_string(
                "The margin gap between discounted and other lines is %s (p = %.4f).",
                split, c("split_p")),
        ),
    ]
    found = _one_row(cells).select(
        F.inline(F.array(*rows)), (c("high_mean").isNotNull() & c("low_mean").isNotNull()).alias("split_seen")
    )
    return found.where("insight_no <> 6 or split_seen").drop("split_seen").orderBy("insight_no")
