"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import discard, settle_measured


#: Edges of a part of the table whose components are found where they are read.
LOCAL_EDGES = 1 << 17
#: Types of nodes that Python orders as Spark does.
LOCAL_KINDS = ("string", "bigint", "int", "smallint", "tinyint")


def local_stars(pairs: DataFrame) -> DataFrame:
    """Edges (u, v) from each node to the smallest of its component among neighbouring rows, in place of theirs.

    They join the same nodes, are no more than these, and need few rounds where a
    component's edges stand near each other. Memory is that of LOCAL_EDGES edges.
    """

    def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict = {}

        def root(x):
            while (y := up[x]) != x:
                up[x] = x = up[y]
            return x

        def made() -> pa.RecordBatch:
            nodes = list(up)
            return pa.record_batch([pa.array(nodes, kind), pa.array([root(x) for x in nodes], kind)], ["u", "v"])

        n = 0
        for batch in batches:
            kind = batch.schema.field("u").type
            for a, b in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            n += batch.num_rows
            if n >= LOCAL_EDGES:
                yield made()
                up.clear()
                n = 0
        if up:
            yield made()

    return pairs.mapInArrow(stars, pairs.schema)


def connected_components(edges: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """One row (``node``, ``root``) for each node that an edge names; the root is
    the component's smallest node.

    Begins with the stars of neighbouring edges (``local_stars``), then alternates
    the large-star and the small-star step (Kiveris et al. 2014): after O(log^2 n) rounds the edges are stars around the roots. Each round is
    two aggregations with partial results before the shuffle and two joins
    whose large side Spark can split where a node is hot, and ends in a table
    in the shared folder that replaces the one before. Only a count and a
    checksum, taken while the table is written, reach the driver. Null ends are
    ignored; loops make a node known; repeated edges do no harm.
    """
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())

    def settled(df: DataFrame) -> tuple[DataFrame, dict]:
        return settle_measured(df, "components", n=F.count(F.lit(1)), sum=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))

    if pairs.schema["u"].dataType.simpleString() in LOCAL_KINDS:
        pairs = local_stars(pairs)
    now, seen = settled(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u or u = v").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(joined.select("u", F.col("m").alias("v")))
        last, before = now, seen
        now, seen = settled(small.distinct())
        discard(last)
        if before == seen:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # Stars by now: each node has one edge, to its root.
    return now.where("u <> v").select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
