"""Retail order-line analytics on Spark: cleaning, reports, statistics and forecasts."""
