"""A point that the optimizer doesn't move expressions across."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held(df: DataFrame) -> DataFrame:
    """The same rows, with each column computed once.

    Spark copies a projected expression into every later use of it. Rows that come out of a generator
    (here, of an array of one row) aren't taken apart again, and it stays a narrow, compiled step.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns]))))
