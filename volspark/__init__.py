"""Volatility, risk and strategy-selection analytics over large panels of dated series, on Spark."""
