"""Numbers for facts: dense, in key order, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def numbered(df: DataFrame, keys: list[str], start: int, name: str = "seq") -> DataFrame:
    """``df`` with ``name``: ``start``, ``start + 1``, ... in the order of ``keys``, which are unique.

    Rows are dealt by ranges of the keys; a partition's first number is the sum of the sizes of those before it, of
    which there is one per partition. The counting and the numbering have to see the same partitions, so ``df`` should
    be stored data; equal keys would only make the numbers' order arbitrary.
    """
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    marked = dealt.withColumn("#p", F.spark_partition_id()).withColumn("#i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    sizes = marked.groupBy("#p").count().collect()
    first, total = {}, start
    for p, n in sorted((r[0], r[1]) for r in sizes):
        first[p] = total
        total += n
    if not first:
        return df.withColumn(name, F.lit(0).cast("long")).limit(0)
    table = df.sparkSession.createDataFrame(list(first.items()), "`#q` int, `#first` long")  # a row for each partition
    placed = marked.join(F.broadcast(table), F.col("#p") == F.col("#q"))
    return placed.withColumn(name, F.col("#first") + F.col("#i")).drop("#p", "#i", "#q", "#first")
