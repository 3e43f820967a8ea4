"""Connected components inside a key (a page), for edge tables of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.operators.skew import join_null_safe
from pagelens.session import written


def _label_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Min-label components of complete pages, read from batches sorted by page."""
    rest = None
    for batch in batches:
        rest = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if rest.empty:
            continue
        done = rest["page_id"] != rest["page_id"].iloc[-1]
        if done.any():
            yield _label(rest[done])
            rest = rest[~done]
    if rest is not None and not rest.empty:
        yield _label(rest)


def _label(edges: pd.DataFrame) -> pd.DataFrame:
    ends = pd.MultiIndex.from_arrays([
        np.concatenate([edges["page_id"], edges["page_id"]]),
        np.concatenate([edges["a"], edges["b"]]),
    ])
    codes, nodes = pd.factorize(ends, sort=True)
    a, b = codes[: len(edges)], codes[len(edges):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    idx = nodes.get_level_values(1).to_numpy()
    return pd.DataFrame({
        "page_id": nodes.get_level_values(0).to_numpy(), "idx": idx, "label": idx[label]
    })


_SCHEMA = "page_id long, idx long, label long"


def components_of_small_pages(edges: DataFrame) -> DataFrame:
    """Labels (page_id, idx, label) for nodes with an edge; one shuffle, no iteration.

    Only for pages of a checked size: one page's edges are held by one task.
    """
    sorted_edges = (
        edges.select("page_id", "a", "b").repartition("page_id").sortWithinPartitions("page_id")
    )
    return sorted_edges.mapInPandas(_label_batches, _SCHEMA)


def components_of_any_page(edges: DataFrame) -> DataFrame:
    """The same labels by iterated min-label propagation with pointer jumping.

    Each round is a join and a map-side combined minimum; a page may be spread over all tasks. The
    state is written each round. Stops when no label changes.
    """
    ways = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(edges.select("page_id", F.inline(ways)).distinct())
    labels = both.groupBy("page_id", F.col("a").alias("idx")).agg(
        F.least(F.col("idx"), F.min("b")).alias("label")
    )
    labels = written(labels)
    while True:
        seen = labels.select("page_id", F.col("idx").alias("b"), F.col("label").alias("near"))
        lowest = both.join(seen, ["page_id", "b"]).groupBy("page_id", F.col("a").alias("idx")).agg(
            F.min("near").alias("near")
        )
        hooked = labels.join(lowest, ["page_id", "idx"]).select(
            "page_id", "idx", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        root = hooked.select("page_id", F.col("idx").alias("label"), F.col("label").alias("up"))
        jumped = written(
            hooked.join(root, ["page_id", "label"]).select("page_id", "idx", "old", F.col("up").alias("label"))
        )
        labels = jumped.select("page_id", "idx", "label")
        if jumped.filter("label <> old").isEmpty():
            return labels


def with_labels(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Every node with the smallest index of its component; a node without edges is its own."""
    found = labels.select("page_id", "idx", F.col("label").alias("_label"))
    return join_null_safe(nodes, found, ["page_id", "idx"], "left").withColumn(
        "label", F.coalesce("_label", "idx")
    ).drop("_label")
