"""Reusable operators over DataFrames: quality rules, demand series, forecasts, metrics, risk, publication."""
