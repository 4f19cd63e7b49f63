"""Loads every query module."""

from sitesift.plans import (  # noqa: F401
    catalog_queries,
    geodesy_queries,
    geometry_queries,
    record_queries,
    sink_queries,
    site_queries,
    source_queries,
    stream_queries,
    survey_queries,
    text_queries,
)
from sitesift.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
