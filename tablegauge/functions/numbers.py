"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a text column: a decimal literal or an infinity.
NUMBER_PATTERN = r"^\s*[-+]?((\d+\.?\d*|\.\d+)([eE][-+]?\d+)?|inf|Inf|INF|infinity|Infinity)\s*$"


def is_number(text: Column) -> Column:
    return text.rlike(NUMBER_PATTERN)


def to_number(text: Column) -> Column:
    """The double a text holds, NULL where it is no number."""
    return F.when(is_number(text), F.trim(text).try_cast("double"))
