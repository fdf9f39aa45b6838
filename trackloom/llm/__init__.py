"""Operators for training data. Nothing else in the library imports this subpackage."""

from .registry import QUERIES
from .sql import ORACLE

__all__ = ["ORACLE", "QUERIES"]
