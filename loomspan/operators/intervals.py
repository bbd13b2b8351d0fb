"""Half-open interval operators: overlap joins, unions, coverage, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.runs import in_range_parts

#: Intervals over more bins than this are joined by their keys alone instead of being copied to each bin.
MOST_BINS = 1000


def overlap_size(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Bases that two intervals share; zero or less where they don't overlap."""
    return F.least(e1, e2) - F.greatest(s1, s2)


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column, closed: bool = False) -> Column:
    """Whether two intervals share a base; ``closed``: or touch."""
    return ((s1 <= e2) & (s2 <= e1)) if closed else ((s1 < e2) & (s2 < e1))


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_size: int = 1024, start: str = "s", end: str = "e", closed: bool = False) -> DataFrame:
    """All pairs of intervals that overlap (or, if ``closed``, touch) under equal keys.

    Result columns are ``a_*`` and ``b_*``, and the keys. Spark has no range join:
    without help it compares all pairs of a key. Here each interval is copied to
    the bins that it covers, the join is on keys and bin, and a pair counts only
    in the first bin that both cover, so nothing has to be made distinct after.
    Bins near the usual interval's length keep copies few; an interval over more
    than MOST_BINS bins is not copied but joined on the keys with the rest's
    residual test. Null keys, starts or ends never match; empty intervals match
    nothing unless ``closed``.
    """
    last_of = (lambda e: e) if closed else (lambda e: e - 1)

    def binned(df: DataFrame, side: str) -> tuple[DataFrame, DataFrame]:
        named = df.select(*[F.col(k).alias(f"__{side}_{k}") for k in keys], *[F.col(c).alias(f"{side}_{c}") for c in df.columns])
        s, e = F.col(f"{side}_{start}"), F.col(f"{side}_{end}")
        first, last = F.floor(s / bin_size), F.floor(last_of(e) / bin_size)
        named = named.where((e >= s) if closed else (e > s)).withColumn(f"__{side}_first", first).withColumn(f"__{side}_bins", last - first + 1).where(F.col(f"__{side}_bins") > 0)
        short = named.where(F.col(f"__{side}_bins") <= MOST_BINS)
        bins = F.sequence(F.col(f"__{side}_first"), F.col(f"__{side}_first") + F.col(f"__{side}_bins") - 1)
        return short.withColumn(f"__{side}_bin", F.explode(bins)), named.where(F.col(f"__{side}_bins") > MOST_BINS)

    (a, long_a), (b, long_b) = binned(left, "a"), binned(right, "b")
    same = [F.col(f"__a_{k}") == F.col(f"__b_{k}") for k in keys]
    meets = overlaps(F.col(f"a_{start}"), F.col(f"a_{end}"), F.col(f"b_{start}"), F.col(f"b_{end}"), closed)

    def both(x: DataFrame, y: DataFrame, *more: Column) -> DataFrame:
        on = meets
        for c in [*same, *more]:
            on = on & c
        columns = [f"a_{c}" for c in left.columns] + [f"b_{c}" for c in right.columns]
        return x.join(y, on).select(*columns, *[F.col(f"__a_{k}").alias(k) for k in keys])

    first_common = F.col("__a_bin") == F.greatest(F.col("__a_first"), F.col("__b_first"))
    found = both(a, b, F.col("__a_bin") == F.col("__b_bin"), first_common)
    whole_b = b.where(F.col("__b_bin") == F.col("__b_first")).drop("__b_bin").unionByName(long_b)
    return found.unionByName(both(long_a, whole_b)).unionByName(both(a.where(F.col("__a_bin") == F.col("__a_first")), long_b))


def overlap_totals(left: DataFrame, right: DataFrame, keys: Sequence[str], by: Sequence[str], bin_size: int = 1024) -> DataFrame:
    """For each group of left rows: overlapping rows, shared bases, distinct starts of the right side."""
    pairs = overlap_join(left, right, keys, bin_size)
    size = overlap_size(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    return pairs.groupBy(*[f"a_{c}" for c in by]).agg(F.count(F.lit(1)).alias("n_hits"), F.sum(size).alias("bases"), F.count_distinct("b_s").alias("n_starts"))


def skipped(left: DataFrame, right: DataFrame, keys: Sequence[str], bin_size: int = 1024) -> DataFrame:
    """Left rows without an overlap, and why: their key is absent on the right, or none intersects."""
    known = right.select(*keys).distinct()
    absent = left.join(known, list(keys), "left_anti").select(*left.columns, F.lit("chromosome is not aligned").alias("reason"))
    hit = overlap_join(left, right, keys, bin_size).select(*[F.col(f"a_{c}").alias(c) for c in left.columns]).distinct()
    present = left.join(known, list(keys), "left_semi")
    missed = present.join(hit, left.columns, "left_anti").select(*left.columns, F.lit("no intersecting chains").alias("reason"))
    return absent.unionByName(missed)


def union_intervals(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e", merge_adjacent: bool = False) -> DataFrame:
    """Merged intervals of each key with the number of parts; abutting ones stay apart unless asked.

    Gaps and islands: an interval begins an island if it starts where all before it
    have ended. A key's rows are swept in ranges of their starts, so a chromosome takes as many
    tasks as there are ranges; the furthest end and the last island of a
    key's ranges before are carried over, and islands across borders meet when they are grouped.
    """
    placed = in_range_parts(df, keys, [start, end])
    part = Window.partitionBy(*keys, "__part").orderBy("__at")
    upto, before = part.rowsBetween(Window.unboundedPreceding, Window.currentRow), part.rowsBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)

    def carried(rows: DataFrame, found: Column, fold: Callable[[str], Column], into: str) -> DataFrame:
        """Adds to each row what its key's parts before give: a row for each key and part."""
        each = rows.groupBy(*keys, "__part").agg(found.alias("__own"))
        each = each.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), fold("__own").over(earlier).alias(into))
        same = F.col("__part") == F.col("__p")
        for i, k in enumerate(keys):
            same = same & F.col(k).eqNullSafe(F.col(f"__k{i}"))
        return rows.join(each, same).drop("__p", *[f"__k{i}" for i in range(len(keys))])

    rows = carried(placed, F.max(end), F.max, "__carried").withColumn("__before", F.greatest("__carried", F.max(end).over(before)))
    fresh = F.col("__before").isNull() | ((F.col(start) > F.col("__before")) if merge_adjacent else (F.col(start) >= F.col("__before")))
    rows = rows.withColumn("__began", F.when(fresh, F.col("__at")))
    rows = carried(rows, F.max("__began"), F.max, "__last").withColumn("__island", F.coalesce(F.max("__began").over(upto), F.col("__last")))
    merged = rows.groupBy(*keys, "__island")
    return merged.agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n_parts")).drop("__island")


def nested(df: DataFrame, keys: Sequence[str], start: str = "s", end: str = "e") -> DataFrame:
    """For each key: ranges, islands of their union, covered bases, and whether any ranges overlap."""
    merged = union_intervals(df, keys, start, end).groupBy(*keys)
    found = merged.agg(F.sum("n_parts").alias("n_ranges"), F.count(F.lit(1)).alias("n_islands"), F.sum(F.col(end) - F.col(start)).alias("covered"))
    return found.withColumn("is_nested", F.col("n_islands") < F.col("n_ranges"))


def neighbour_overlaps(df: DataFrame, keys: Sequence[str], name: str, start: str = "s", end: str = "e") -> DataFrame:
    """Neighbours in order of start of which the second begins before the first has ended."""
    order = Window.partitionBy(*keys).orderBy(start, end, name)
    seen = df.withColumn("previous", F.lag(name).over(order)).withColumn("__end", F.lag(end).over(order))
    return seen.where(F.col("__end") > F.col(start)).select(*keys, "previous", name, (F.col("__end") - F.col(start)).alias("shared"))


def coverage(tracks: DataFrame, blocks: DataFrame, keys: Sequence[str], track: str, bin_size: int = 1024) -> DataFrame:
    """For each track, its bases that the union of the blocks covers, tracks without any included."""
    merged = union_intervals(blocks.select(*keys, "s", "e"), keys).drop("n_parts")
    pairs = overlap_join(tracks, merged, keys, bin_size)
    size = overlap_size(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    sums = pairs.groupBy(*keys, F.col(f"a_{track}").alias(track)).agg(F.sum(size).alias("covered"))
    spans = tracks.groupBy(*keys, track).agg(F.sum(F.col("e") - F.col("s")).alias("span"))
    return spans.join(sums, [*keys, track], "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
