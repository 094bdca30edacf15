"""Row-level helpers of DataFrames."""

from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, **cols: Column) -> DataFrame:
    """Add columns through a generator of one row, so that later filters and uses take them as they are."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
