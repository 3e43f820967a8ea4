"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pagelens.session import written

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACES = "\x20\t\n\x0b\x0c\r"
CASE_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


ROWS_PER_BATCH = 1000


def bounded_batches(spark: SparkSession) -> None:
    """Send at most ROWS_PER_BATCH texts at a time to a Python worker; smaller settings of the session stay."""
    option = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(option, "10000"))
    if now <= 0 or now > ROWS_PER_BATCH:
        spark.conf.set(option, str(ROWS_PER_BATCH))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold_case(text: str) -> str:
    """Lower-case A-Z only, so that positions stay the same."""
    return text.encode("utf-8", "surrogatepass").translate(CASE_FOLD).decode("utf-8", "surrogatepass")


def words_of(text: str) -> list[str]:
    """Runs of characters other than space and the controls 9 to 13."""
    # bytes.split() cuts at exactly these six characters; str.split() would cut at many more
    return [w.decode("utf-8", "surrogatepass") for w in text.encode("utf-8", "surrogatepass").split()]


def whole(text: str | None) -> str:
    """Null and missing texts count as empty."""
    return text if isinstance(text, str) else ""


def in_frames(df: DataFrame, run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """As mapInPandas, but a column of integers with nulls holds integers and None in place of rounded floats."""
    target = to_arrow_schema(StructType.fromDDL(schema))

    def batches(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in run(batch.to_pandas(integer_object_nulls=True) for batch in arrow):
            yield pa.RecordBatch.from_pandas(frame, target, preserve_index=False)

    return df.mapInArrow(batches, schema)


def per_row(df: DataFrame, schema: str, columns: list[str], row: Callable[..., tuple]) -> DataFrame:
    """One output row for each input row, from the named columns, in Arrow batches."""
    names = [part.split()[0] for part in schema.split(",")]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [row(*values) for values in zip(*[frame[c].tolist() for c in columns])]
            made = pd.DataFrame(rows, columns=names, dtype=object)
            yield made

    return in_frames(df.select(*columns), batches, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of all nodes of edges (a, b): the least node of their component.

    Rounds of minimum propagation with pointer jumping over written tables; minima are combined before each
    shuffle, and no component is held by one task.
    """
    from pyspark.sql import functions as F

    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.select(F.inline(ways)).distinct())
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("near")), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = written(labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        root = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = written(hooked.join(root, "label").select("node", "old", F.col("up").alias("label")))
        labels = jumped.select("node", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def sorted_groups(frames: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Complete groups from batches sorted by the keys."""
    rest = None
    for frame in frames:
        rest = frame if rest is None or rest.empty else pd.concat([rest, frame], ignore_index=True)
        if rest.empty:
            continue
        change = (rest[keys] != rest[keys].shift()).any(axis=1).to_numpy()
        starts = change.nonzero()[0].tolist()
        for start, end in zip(starts, starts[1:]):
            yield rest.iloc[start:end]
        rest = rest.iloc[starts[-1] :].reset_index(drop=True)
    if rest is not None and not rest.empty:
        yield rest
