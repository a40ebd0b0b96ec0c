"""Imports every query module so that the catalogue is complete."""

from . import (  # noqa: F401
    queries_design,
    queries_models,
    queries_panels,
    queries_registry,
    queries_results,
    queries_rows,
    queries_sources,
)
from .catalog import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
