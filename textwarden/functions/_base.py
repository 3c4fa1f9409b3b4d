from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    """A column from a name or a column."""
    return F.col(c) if isinstance(c, str) else c


def dbl(x: float) -> Column:
    return F.lit(float(x)).cast("double")
