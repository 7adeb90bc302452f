"""Mercadia: retail analytics, data quality and demand forecasting as Spark DataFrame jobs."""
