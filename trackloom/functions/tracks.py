"""Fields of delivered tracks as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def status_name(status: Column) -> Column:
    """observed, predicted or absent, whatever the spelling (case, space, an enum's prefix)."""
    return F.regexp_replace(F.lower(F.regexp_replace(status, r"[\s ]+", "")), r"^.*\.", "")
