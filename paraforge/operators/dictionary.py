"""Dictionary-encoded columns: codes and their values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidValueError

#: Most entries of a dictionary that is sent to every worker; a larger one is joined by a shuffle.
BROADCAST_ENTRIES = 100_000


def _side(dictionary: DataFrame) -> DataFrame:
    return F.broadcast(dictionary) if dictionary.limit(BROADCAST_ENTRIES + 1).count() <= BROADCAST_ENTRIES else dictionary


def decode(df: DataFrame, dictionary: DataFrame, code: str, value: str) -> DataFrame:
    """df with the value for each code; a null code has a null value. dictionary is (code, value) with unique codes."""
    return df.join(_side(dictionary.select(code, value)), code, "left")


def dangling(df: DataFrame, dictionary: DataFrame, code: str) -> DataFrame:
    """The rows whose code is neither null nor in the dictionary."""
    return df.where(F.col(code).isNotNull()).join(_side(dictionary.select(code)), code, "left_anti")


def decode_checked(df: DataFrame, dictionary: DataFrame, code: str, value: str) -> DataFrame:
    if dangling(df, dictionary, code).limit(1).count():
        raise InvalidValueError(f"{code}: an index is outside the dictionary")
    return decode(df, dictionary, code, value)
