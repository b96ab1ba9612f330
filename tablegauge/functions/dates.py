"""Date strings: a shape test, then an explicit list of formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the date-string rule.
MIN_LENGTH = 8
SEPARATOR = "[-/:]"
SHARE = 0.95
# Each format with the shape it applies to, so a parse is tried only where it can work.
FORMATS = (
    ("yyyy-MM-dd", r"^\d{4}-\d{2}-\d{2}$"),
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss", r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd/MM/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("MM/dd/yy", r"^\d{2}/\d{2}/\d{2}$"),
)
# What all shapes have in common, tested once before them.
ANY_SHAPE = r"^\d{2,4}[-/]\d{2}[-/]\d{2,4}([ T]\d{2}:\d{2}:\d{2})?$"


def looks_shaped(text: Column) -> Column:
    return (F.char_length(text) >= MIN_LENGTH) & text.rlike(SEPARATOR)


def parse_date(text: Column) -> Column:
    """The timestamp a string names in one of ``FORMATS``, else NULL."""
    parsed = F.coalesce(*[F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(f))) for f, shape in FORMATS])
    return F.when(text.rlike(ANY_SHAPE), parsed)
