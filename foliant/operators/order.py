"""Places in a global order without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.streaming.paths import held

#: Bits of a row's place within its partition, as monotonically_increasing_id has it.
_PLACE = 33


def numbered(rows: DataFrame, key: list[Column], name: str, start: Column | None = None) -> DataFrame:
    """rows with a column of their places, from 1 (after start, if given), in the ascending order of the key's columns.

    Rows are dealt by ranges of the key to as many partitions as the session's shuffles have, sorted there, and written with
    their place in the partition; what the partitions before hold is added then, a number for each. Equal keys are ranked
    arbitrarily; end the key with something unique.
    """
    shift = [] if start is None else [start.alias("_start")]
    dealt = rows.select("*", *shift).repartitionByRange(*key).sortWithinPartitions(*key)
    placed = held(dealt.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _PLACE)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    before = sizes.select("_part", (F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")).alias("_before"))  # a row a partition
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _PLACE) - 1)) + 1
    found = placed.join(F.broadcast(before), part == F.col("_part"))
    return found.withColumn(name, place if start is None else place + F.col("_start")).select(*rows.columns, name)
