"""Imports every module that registers queries."""

from . import queries_facts, queries_io, queries_layout, queries_select, queries_views  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
