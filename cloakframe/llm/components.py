"""Connected components of a distributed edge table, by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: Edges up to which one task finishes: 16 MB of integer ids.
LAST_EDGES = 1_000_000


def spanned(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For each of n numbered nodes the least one that edges lead to."""
    root = np.arange(n)
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def _finished(edges: DataFrame, kind: str) -> DataFrame:
    """(node, root) of so few edges that one task holds them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            table = pa.Table.from_batches(held)
            both = pa.chunked_array([*table.column(0).chunks, *table.column(1).chunks]).combine_chunks()
            nodes = both.unique().sort()
            at = np.asarray(pc.index_in(both, nodes), np.int64)
            root = spanned(at[: table.num_rows], at[table.num_rows :], len(nodes))
            yield pa.RecordBatch.from_arrays([nodes, nodes.take(pa.array(root))], ["node", "root"])

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def connected_components(edges: DataFrame, last_edges: int = LAST_EDGES) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); root is the component's
    least node. Each round points nodes to their least neighbour, shortens the
    paths, and joins the edges of what is left, until they are few enough
    (``last_edges``, counted) for one task; nothing comes to the driver.

    ``edges`` should be written out. An empty edge table gives an empty table;
    repeated edges and loops are fine; nulls are not nodes.
    """
    spark = edges.sparkSession
    kind = dict(edges.dtypes)["a"]
    left = edges.where("a <> b")
    few = left.count() <= last_edges
    if not few:
        left = materialize(spark, left.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found: DataFrame | None = None
    while not few and not (few := left.count() <= last_edges):
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root"))
        least = materialize(spark, to, "least")
        to = least
        for _ in range(2):
            to = to.join(to.select(F.col("node").alias("root"), F.col("root").alias("far")), "root").select("node", F.col("far").alias("root"))
        to = materialize(spark, to, "roots")
        before = found
        found = to if before is None else materialize(spark, _through(before, to), "found")
        a = to.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        joined = left.join(a, "a").join(b, "b").where("ra <> rb")
        rest = materialize(spark, joined.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(least, left, before, None if found is to else to)
        left = rest
    last = materialize(spark, _finished(left, kind), "last")
    discard(left)
    if found is None:
        return last
    out = materialize(spark, _through(found, last), "components")
    discard(found, last)
    return out


def _through(found: DataFrame, step: DataFrame) -> DataFrame:
    """Roots of ``found`` led on by the roots of ``step``."""
    further = step.select(F.col("node").alias("root"), F.col("root").alias("far"))
    return found.join(further, "root", "left").select("node", F.coalesce("far", "root").alias("root"))
