"""Variant columns: opaque values that are carried, not taken apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_json(text: Column) -> Column:
    return F.parse_json(text)
