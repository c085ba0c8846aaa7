"""Places of rows in a global order, found in ranges instead of in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfinder.shared import materialize

#: monotonically_increasing_id() counts a task's rows in its lower bits.
ROW_BITS = 33


def numbered(df: DataFrame, order: list[Column], name: str = "rank", tag: str = "ranked") -> DataFrame:
    """df with each row's place, from 1, in a written table. Rows are dealt into ranges of the order and counted in each; of the
    ranges before, only their counts are added, of which there are as many as tasks. The order should tell all rows apart."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    marked = dealt.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << ROW_BITS) - 1)})
    marked = materialize(marked, tag)
    sizes = marked.groupBy("__range").agg(F.count("*").alias("n"))
    before = sizes.select("__range", (F.sum("n").over(Window.orderBy("__range")) - F.col("n")).alias("__before"))
    # a row for each range that a task wrote
    return marked.join(F.broadcast(before), "__range").withColumn(name, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")
