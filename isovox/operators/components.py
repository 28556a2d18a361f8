"""Connected components of a table of links, by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isovox.store import dropped, written


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of each batch as stars around the least node of each of its components."""
    for batch in batches:
        u, v = batch.column("u").to_numpy(), batch.column("v").to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = at[: len(u)], at[len(u) :]
        root = np.arange(len(nodes))
        while True:
            least = root.copy()
            low = np.minimum(root[a], root[b])
            np.minimum.at(least, root[a], low)
            np.minimum.at(least, root[b], low)
            new = least[least[root]]
            if (new == root).all():
                break
            root = new
        out = np.flatnonzero(root != np.arange(len(nodes)))
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[out]), pa.array(nodes[root[out]])], ["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """(node, label) for each node of ``links`` (u bigint, v bigint): the least node that can be reached.

    Loops and repeated links do no harm; without links there are no rows. Each round is written to the shared folder.
    """
    edges = written(links.where("u <> v").mapInArrow(_contract, "u bigint, v bigint").distinct(), "edges")
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: greater neighbours are linked with the least of the neighbourhood.
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "edges")
        dropped(edges)
        # Small star: lesser neighbours and the node itself are; every row of ``large`` has u > v.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        small = written(small, "edges")
        dropped(large)
        # Stars alone remain once no node has two parents and no parent is a child.
        parents = small.select("v").distinct().withColumnRenamed("v", "u")
        if small.groupBy("u").count().where("count > 1").isEmpty() and small.join(parents, "u", "left_semi").isEmpty():
            break
        edges = small
    heads = small.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return small.select(F.col("u").alias("node"), F.col("v").alias("label")).union(heads)
