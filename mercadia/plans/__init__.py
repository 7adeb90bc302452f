"""Whole plans: sales models, layers, forecasts, profiles."""
