"""Registered queries over the driver's tables, each with its DuckDB oracle where SQL can express it."""

from . import constraints, core, decisions, files, live, models, more, positions, refits, reviews, routes, streams, switching, tables, tuned
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "constraints", "core", "decisions", "files", "live", "models", "more", "positions", "refits", "reviews", "routes", "streams", "switching", "tables", "tuned"]
