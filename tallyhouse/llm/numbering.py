"""Global row numbers without a single task: sorted in ranges, numbered within each range, shifted by range totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyhouse.llm.common import Scratch


def with_row_number(df: DataFrame, by: list[str], scratch: Scratch, name: str = "row_no") -> DataFrame:
    """df in the order of ``by`` (nulls first) with numbers from 0.

    The sorted rows are written with the number of their range and their place in it, since the bounds of ranges may
    differ between two runs of a plan. Only the count of each range is then summed, one row a task. The input place is
    the last key, so that repeated rows, which nothing else tells apart, spread over ranges.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("_at", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(n, *by, "_at").sortWithinPartitions(*by, "_at")
    place = F.monotonically_increasing_id()
    written = scratch.keep(dealt.drop("_at").withColumns({"_part": F.spark_partition_id(), "_row": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    totals = written.groupBy("_part").agg(F.count("*").alias("n"))
    starts = totals.select("_part", (F.sum("n").over(Window.orderBy("_part")) - F.col("n")).alias("_start"))
    return written.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_row")).drop("_part", "_row", "_start")
