"""Joins with a side that may be small: its rows are counted before it is broadcast, and there is another way beyond the bound."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a rule table that may be broadcast; a larger table is joined by a shuffle.
RULE_ROWS = 100_000


def small(table: DataFrame, rows: int = RULE_ROWS) -> DataFrame:
    """table, to be broadcast if it was counted to have so many rows at most."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def met(left: DataFrame, right: DataFrame, condition: Column, rows: int = RULE_ROWS) -> DataFrame:
    """Inner join by a condition without an equal key.

    A right side of up to `rows` rows is broadcast.  A larger one is dealt to blocks of about `rows` rows: each left row goes
    once to every block, and a block is there once for each of the parts that the left rows are dealt to, so that a pair
    meets in one task and no task holds more than a part and a block.  Repeated rows of either side stay repeated.
    """
    n = right.limit(rows + 1).count()
    if n <= rows:
        return left.join(F.broadcast(right), condition)
    blocks = -(-right.count() // rows)
    parts = max(1, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")) // blocks)
    dealt = lambda df, k: F.pmod(F.xxhash64(F.spark_partition_id(), *[F.col(f"`{c}`") for c in df.columns]), F.lit(k)).cast("int")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    a = left.withColumn("_part", dealt(left, parts)).withColumn("_block", every(blocks))
    b = right.withColumn("_block", dealt(right, blocks)).withColumn("_part", every(parts))
    return a.join(b, ["_part", "_block"]).filter(condition).drop("_part", "_block")
