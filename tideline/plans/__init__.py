"""Registered queries over the driver's tables, and their SQL."""

from . import depth, landing, newsroom, study
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "depth", "landing", "newsroom", "study"]
