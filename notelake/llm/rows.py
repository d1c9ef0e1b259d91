"""Rows of one key once, without a shuffle of the texts where no key is repeated."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Repeated keys up to this number are sent to the tasks.
MOST_REPEATED = 1_000_000


def once(df: DataFrame, keys: list[str], most: int = MOST_REPEATED) -> DataFrame:
    """``df`` with one row per key; null keys form a key of their own.

    Keys alone are counted first. Rows of keys that occur once stay where they are; only rows of repeated
    keys are shuffled. With more than ``most`` repeated keys all rows are.
    """
    repeated = df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    n = repeated.limit(most + 1).count()
    if not n:
        return df
    if n > most:
        return df.dropDuplicates(keys)
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    few = F.broadcast(repeated)
    return df.join(few, same, "left_anti").unionByName(df.join(few, same, "left_semi").dropDuplicates(keys))
