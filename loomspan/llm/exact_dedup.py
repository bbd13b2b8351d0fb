"""Exact deduplication by progressive refinement: length, prefix hash, full hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm.common import settle, table, text_or_empty

#: Surviving (length, prefix) keys that may be broadcast: 24 bytes each, so at most about 50 MB.
BROADCAST_KEYS = 2_000_000


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    prefix_chars: int = 256,
    carry: dict[str, Callable[[Column], Column]] | None = None,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    """Marks, among rows of equal text, the one with the largest id as kept.

    Level 1 counts byte lengths, level 2 counts prefix hashes of those rows whose
    length occurs twice, level 3 hashes (SHA-256) the whole text of those rows
    whose length and prefix both occur twice. Only counts and (id, hash) rows
    are shuffled, never texts; all levels aggregate before the shuffle, so one
    text that fills a third of the table stays cheap. Up to ``broadcast_keys``
    surviving keys are broadcast so that level 3 can skip the other rows; with
    more, level 3 hashes every row as it is scanned and gives the same result.

    Returns one row per input row: the id, ``keep_id``, ``group_size`` (long),
    ``kept`` (boolean) and the columns of ``carry``, which are computed from the
    normalised text. Other input columns are not read. Null text counts as
    empty; empty texts equal one another. Null ids sort below all others. Of
    repeated rows with one id and text exactly one is kept. An empty table
    gives an empty result.
    """
    text = text_or_empty(text_col)
    if normalise is not None:
        text = text_or_empty(normalise(text))
    scan = docs.select(F.col(id_col).alias("__id"), text.alias("__text"))
    length = F.octet_length("__text").cast("long").alias("__length")
    prefix = F.xxhash64(F.substring("__text", 1, prefix_chars)).alias("__prefix")

    twice = F.col("count") > 1
    # One row for each length; broadcast where few, so that rows of a frequent length need not meet.
    lengths = settle(scan.groupBy(length).count().where(twice).select("__length"), "dedup-lengths")
    if lengths.count() <= broadcast_keys:
        lengths = F.broadcast(lengths)
    prefixes = (
        scan.select(length, prefix).join(lengths, "__length", "left_semi").groupBy("__length", "__prefix").count().where(twice).select("__length", "__prefix")
    )
    prefixes = settle(prefixes, "dedup-prefixes")
    survivors = prefixes.count()

    extra = [make(F.col("__text")).alias(name) for name, make in (carry or {}).items()]
    rows = scan.withColumns({"__length": length, "__prefix": prefix})
    if survivors <= broadcast_keys:
        marked = F.broadcast(prefixes.withColumn("__twice", F.lit(True)))
        rows = rows.join(marked, ["__length", "__prefix"], "left")
        full = F.when(F.col("__twice"), F.sha2("__text", 256))
    else:
        full = F.sha2("__text", 256)
    rows = settle(
        rows.select("__id", "__length", full.alias("__full"), F.monotonically_increasing_id().alias("__row"), *extra), "dedup-rows"
    )

    names = list(carry or {})
    alone = rows.where(F.col("__full").isNull()).select(
        F.col("__id").alias(id_col), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *names
    )
    hashed = rows.where(F.col("__full").isNotNull())
    groups = (
        hashed.groupBy("__length", "__full")
        .agg(F.max("__id").alias("__keep"), F.coalesce(F.max_by("__row", "__id"), F.max("__row")).alias("__best"), F.count(F.lit(1)).alias("__size"))
        .where(F.col("__size") > 1)
    )
    # Settled, as of repeated ids any row may be the best, and so that Spark can split a large group's rows in the join.
    groups = settle(groups, "dedup-groups")
    grouped = hashed.join(groups, ["__length", "__full"], "left").select(
        F.col("__id").alias(id_col),
        F.when(F.col("__size").isNull(), F.col("__id")).otherwise(F.col("__keep")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__best") == F.col("__row"), F.lit(True)).alias("kept"),
        *names,
    )
    return alone.unionByName(grouped)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": lambda text: F.sha2(text, 256)})


SQL = """
WITH t AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""
