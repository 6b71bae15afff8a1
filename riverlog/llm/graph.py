"""Connected components of a link table: links are contracted in blocks, then labels sink to the least reachable node."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

BLOCK = 1 << 20  # links that a task contracts at once


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label): the least node reachable over these links alone."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        least = np.minimum(label[x], label[y])
        np.minimum.at(label, label[x], least)
        np.minimum.at(label, label[y], least)
        while (label != (further := label[label])).any():
            label = further
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def contracted(links: DataFrame, blocks: int, block: int) -> DataFrame:
    """(node, label): for each block of links the least label of each of its nodes, which joins the same nodes with fewer and shorter links."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for first in range(0, len(batch), block):
                part = batch.slice(first, block)
                if held and size + len(part) > block:
                    yield star(held)
                    held, size = [], 0
                held.append(part)
                size += len(part)
        if held:
            yield star(held)

    def star(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*map(pa.array, least_labels(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))))], ["node", "label"])

    return links.select("a", "b").coalesce(blocks).mapInArrow(of, "node long, label long")


def components(links: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """(node, label): the least node reachable over ``links`` (a, b: tables); nodes without links are absent.

    Links of one block are done by its contraction. Over several, each round takes the least label of the neighbours and then the label of that label,
    so a chain halves in length. Labels are written each round; only counts reach the driver.
    """
    blocks = max(1, -(-links.count() // block))
    stars = scratch.table(contracted(links, blocks, block), "stars")
    if blocks == 1:
        return stars
    links = stars.select(F.col("node").alias("a"), F.col("label").alias("b"))
    both = scratch.table(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    scratch.drop(stars)
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")), "labels")
    while True:
        old = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(old, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        sunk = labels.join(least, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = scratch.table(sunk.join(jump, "label").select("node", "was", F.least("label", "further").alias("label")), "labels")
        done = new.filter(F.col("label") != F.col("was")).isEmpty()
        scratch.drop(labels)
        labels = new.select("node", "label")
        if done:
            scratch.drop(both)
            return labels
