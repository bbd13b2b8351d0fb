"""Pairwise alignment chains: decoding, filters, sub-chains and coordinate projection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def decode_blocks(headers: DataFrame, raw: DataFrame) -> DataFrame:
    """Absolute block coordinates from sizes and gaps.

    ``headers``: chain_id, t_start, q_start; ``raw``: chain_id, block_no, size,
    dt, dq. The gaps after a block count for those that follow it.
    """
    before = Window.partitionBy("chain_id").orderBy("block_no").rowsBetween(Window.unboundedPreceding, -1)
    t = F.coalesce(F.sum(F.col("size") + F.coalesce("dt", F.lit(0))).over(before), F.lit(0))
    q = F.coalesce(F.sum(F.col("size") + F.coalesce("dq", F.lit(0))).over(before), F.lit(0))
    shifted = raw.withColumn("__t", t).withColumn("__q", q).join(headers.select("chain_id", "t_start", "q_start").withColumnsRenamed({"t_start": "__ts", "q_start": "__qs"}), "chain_id")
    t_start, q_start = F.col("__ts") + F.col("__t"), F.col("__qs") + F.col("__q")
    return shifted.select("chain_id", "block_no", t_start.alias("t_start"), (t_start + F.col("size")).alias("t_end"), q_start.alias("q_start"), (q_start + F.col("size")).alias("q_end"))


def score_filter(headers: DataFrame, least: int = 15000, score: str = "score") -> DataFrame:
    """Chains whose score is above ``least``; one of exactly that score goes."""
    return headers.where(F.col(score) > least)


def blocks_at(blocks: DataFrame, regions: DataFrame, closed: bool = False) -> DataFrame:
    """(chain_id, region, s, e, first, last): the first block that ends behind (``closed``: at or behind) a region's
    start and the last that starts before its end; null where there is none.

    One ordered pass over a chain's blocks and regions for each end, as both
    are in the order of blocks: no region meets more than its own blocks.
    """
    # At equal places a block that ends there comes before a region's start unless closed, one that starts there behind a region's end.
    rank = lambda here, n: F.lit(n if here else 1 - n)
    ends = blocks.select("chain_id", F.col("t_end").alias("__at"), rank(closed, 1).alias("__k"), "block_no", F.lit(None).cast(regions.schema["region"].dataType).alias("region"))
    from_s = regions.select("chain_id", F.col("s").alias("__at"), rank(closed, 0).alias("__k"), F.lit(None).cast(blocks.schema["block_no"].dataType).alias("block_no"), "region", "s", "e")
    on = Window.partitionBy("chain_id").orderBy("__at", "__k", "block_no")
    # Backwards, as a frame that grows costs no more than the rows it gains.
    back = Window.partitionBy("chain_id").orderBy(F.desc("__at"), F.desc("__k"), F.desc("block_no"))
    first = F.last("block_no", ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    left = ends.unionByName(from_s, allowMissingColumns=True).withColumn("first", first).where("region IS NOT NULL").select("chain_id", "region", "s", "e", "first")
    starts = blocks.select("chain_id", F.col("t_start").alias("__at"), F.lit(1).alias("__k"), "block_no", F.lit(None).cast(regions.schema["region"].dataType).alias("region"))
    to_e = regions.select("chain_id", F.col("e").alias("__at"), F.lit(0).alias("__k"), F.lit(None).cast(blocks.schema["block_no"].dataType).alias("block_no"), "region")
    last = F.last("block_no", ignorenulls=True).over(on.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    right = starts.unionByName(to_e).withColumn("last", last).where("region IS NOT NULL").select("chain_id", "region", "last")
    return left.join(right, ["chain_id", "region"])


def sub_chain(blocks: DataFrame, regions: DataFrame) -> DataFrame:
    """Blocks of each region's chain that end at or after its start and start before its end.

    ``regions``: chain_id, region (unique in its chain), s, e (target coordinates).
    """
    found = blocks_at(blocks, regions, closed=True).where("first <= last")
    wanted = found.select("chain_id", "region", F.explode(F.sequence("first", "last")).alias("block_no"))
    return wanted.join(blocks, ["chain_id", "block_no"]).select("chain_id", "region", "block_no", "t_start", "t_end", "q_start", "q_end")


def aligned_gaps(blocks: DataFrame) -> DataFrame:
    """What lies between neighbouring blocks of a chain: in the target, in the query, or both."""
    order = Window.partitionBy("chain_id").orderBy("block_no")
    near = blocks.withColumn("t_from", F.lag("t_end").over(order)).withColumn("q_from", F.lag("q_end").over(order))
    return near.where("t_from IS NOT NULL AND (t_start > t_from OR q_start > q_from)").select(
        "chain_id", "block_no", "t_from", F.col("t_start").alias("t_to"), "q_from", F.col("q_start").alias("q_to")
    )


def project_ranges(blocks: DataFrame, regions: DataFrame, headers: DataFrame | None = None, shift: int = 0) -> DataFrame:
    """Projects target ranges through their chains to the query.

    With shift 0 a start within a block moves along it and one in a gap goes to
    the next block's start; an end within a block moves along it and one in a
    gap goes to the previous block's end. With a shift, the range is widened to
    the start of the block that many before the one at its start, and to the end
    of the block that many after the one at its end, where there are so many. A
    range before all blocks gives the chain's first base, one behind all the
    last. ``headers`` (chain_id, q_strand, q_size) flips ranges of minus strands.

    First and last block touched come from one ordered pass (``blocks_at``), their
    coordinates by equality joins.
    """
    bounds = blocks.groupBy("chain_id").agg(
        F.min("block_no").alias("__b0"), F.max("block_no").alias("__b1"), F.min("t_start").alias("__t0"), F.max("t_end").alias("__t1"), F.min("q_start").alias("__q0"), F.max("q_end").alias("__q1")
    )
    found = blocks_at(blocks, regions).withColumnsRenamed({"first": "__first", "last": "__last"}).join(bounds, "chain_id")
    found = found.withColumn("__from", F.greatest(F.col("__first") - shift, F.col("__b0"))).withColumn("__to", F.least(F.col("__last") + shift, F.col("__b1")))
    left = blocks.select(F.col("chain_id"), F.col("block_no").alias("__from"), F.col("t_start").alias("__ft"), F.col("q_start").alias("__fq"))
    right = blocks.select(F.col("chain_id"), F.col("block_no").alias("__to"), F.col("t_end").alias("__lt"), F.col("q_end").alias("__lq"), F.col("t_start").alias("__ls"), F.col("q_start").alias("__lqs"))
    located = found.join(left, ["chain_id", "__from"], "left").join(right, ["chain_id", "__to"], "left")
    if shift:
        q_from, q_to = F.col("__fq"), F.col("__lq")
    else:
        q_from = F.when(F.col("s") > F.col("__ft"), F.col("__fq") + F.col("s") - F.col("__ft")).otherwise(F.col("__fq"))
        q_to = F.when(F.col("e") < F.col("__lt"), F.col("__lqs") + F.col("e") - F.col("__ls")).otherwise(F.col("__lq"))
    before, behind = F.col("e") <= F.col("__t0"), F.col("s") >= F.col("__t1")
    q_from = F.when(before, F.col("__q0")).when(behind, F.col("__q1") - 1).otherwise(q_from)
    q_to = F.when(before, F.col("__q0") + 1).when(behind, F.col("__q1")).otherwise(q_to)
    out = located.select("chain_id", "region", q_from.alias("q_from"), q_to.alias("q_to"))
    if headers is None:
        return out
    minus = F.col("q_strand") == "-"
    flipped = out.join(headers.select("chain_id", "q_strand", "q_size"), "chain_id")
    return flipped.select(
        "chain_id", "region", F.when(minus, F.col("q_size") - F.col("q_to")).otherwise(F.col("q_from")).alias("q_from"), F.when(minus, F.col("q_size") - F.col("q_from")).otherwise(F.col("q_to")).alias("q_to")
    )
