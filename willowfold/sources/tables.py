"""Tables as the jobs read them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame) -> DataFrame:
    """A table whose files make fewer tasks than there are cores, dealt to all cores; any other as it is.

    Spark does not split a file below its row groups, so a small table may be one task; where the work on a row costs more than to move it, all
    cores are worth one shuffle of so small a table.  Rows are the same either way.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores) if table.rdd.getNumPartitions() < cores else table
