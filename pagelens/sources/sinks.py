"""Writing result objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def write_objects(df: DataFrame, path: str) -> None:
    """Objects as parquet, one folder per kind.

    Spread by page before the write, so a page's objects are together and no writer holds a whole kind.
    """
    df.repartition("page_id").sortWithinPartitions("page_id", "idx").write.mode("overwrite").partitionBy(
        "kind"
    ).parquet(path)


def write_object_stream(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The same layout for a stream; each batch goes to its own folder, so a retried batch replaces itself."""
    def write(batch: DataFrame, batch_id: int) -> None:
        write_objects(batch, f"{path}/batch={batch_id}")

    return (
        df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
