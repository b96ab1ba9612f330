"""Column selection and reshaping helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FLOATS = (T.FloatType, T.DoubleType)


def col(name: str) -> Column:
    """A column by its exact name, whatever characters the name holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def is_temporal(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType))


def value_or_null(name: str, dtype: T.DataType) -> Column:
    """The column with NaN folded into NULL, the missing-value rule of tables."""
    if isinstance(dtype, _FLOATS):
        return F.nanvl(col(name), F.lit(None).cast(dtype))
    return col(name)


def fold_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column."""
    return df.select(*[value_or_null(f.name, f.dataType).alias(f.name) for f in df.schema.fields])


def columns_of(df: DataFrame, test) -> list[str]:
    return [f.name for f in df.schema.fields if test(f.dataType)]


def long_form(
    df: DataFrame, names: Sequence[str], as_type: str, keep: Sequence[str] = ()
) -> DataFrame:
    """One row per (kept columns, feature, value) with missing values dropped."""
    types = {f.name: f.dataType for f in df.schema.fields}
    wide = df.select(
        *[col(k) for k in keep],
        *[value_or_null(n, types[n]).cast(as_type).alias(n) for n in names],
    )
    long = wide.unpivot([col(k) for k in keep], [col(n) for n in names], "feature", "value")
    return long.where(F.col("value").isNotNull())


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient that is 0 where the denominator is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))
