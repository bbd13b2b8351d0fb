"""Operators on ordered rows: runs, prefix sums, clusters, best rows of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.session import settle


def runs(df: DataFrame, keys: Sequence[str], position: str, least: int = 1) -> DataFrame:
    """Runs of consecutive positions of each key: first, last, length (of at least ``least``)."""
    order = Window.partitionBy(*keys).orderBy(position)
    island = F.col(position) - F.row_number().over(order)
    grouped = df.withColumn("__island", island).groupBy(*keys, "__island")
    found = grouped.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("length"))
    return found.where(F.col("length") >= least).drop("__island")


def gap_clusters(df: DataFrame, keys: Sequence[str], position: str, most_gap: int) -> DataFrame:
    """Clusters of positions of which no neighbours are more than ``most_gap`` apart."""
    order = Window.partitionBy(*keys).orderBy(position)
    fresh = F.coalesce((F.col(position) - F.lag(position).over(order) > most_gap).cast("int"), F.lit(1))
    marked = df.withColumn("__fresh", fresh)
    number = F.sum("__fresh").over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    grouped = marked.withColumn("cluster", number).groupBy(*keys, "cluster")
    return grouped.agg(F.min(position).alias("first"), F.max(position).alias("last"), F.count(F.lit(1)).alias("n_members"))


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, into: str = "before") -> DataFrame:
    """Adds the sum of the values before each row (0 for the first)."""
    window = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(into, F.coalesce(F.sum(value).over(window), F.lit(0)))


def falling_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Splits each key's rows wherever the value does not rise; adds the part's number from 0."""
    window = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("__cut", F.coalesce((F.col(value) <= F.lag(value).over(window)).cast("int"), F.lit(0)))
    return marked.withColumn("part", F.sum("__cut").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("__cut")


def bridged_pairs(df: DataFrame, keys: Sequence[str], position: str, state: str, whole: str = "I", gone: str = "D") -> DataFrame:
    """Pairs of whole positions with at least one position between, all of them gone; any other state breaks a pair."""
    order = Window.partitionBy(*keys).orderBy(position)
    kept = df.where(F.col(state) != gone)
    near = kept.withColumn("__last", F.lag(position).over(order)).withColumn("__state", F.lag(state).over(order))
    pairs = near.where((F.col(state) == whole) & (F.col("__state") == whole) & (F.col(position) - F.col("__last") > 1))
    return pairs.select(*keys, F.col("__last").alias("left_exon"), F.col(position).alias("right_exon"))


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each key; Spark prunes such groups before the shuffle."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col(rank) <= limit).withColumn(rank, F.col(rank).cast("long"))


def near_equal_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str], parts: int, into: str = "part") -> DataFrame:
    """Numbers the rows of each key from 0 to ``parts`` - 1 in near equal, contiguous parts."""
    return df.withColumn(into, F.ntile(parts).over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def whole_series(df: DataFrame, keys: Sequence[str], number: str, size: str, unit: int = 3) -> DataFrame:
    """(keys, first, last): from each row the shortest series of two rows or more whose sizes sum to a multiple of ``unit``.

    Sums of such a series are equal before its first and behind its last row,
    in remainders: a window over rows of one remainder finds the next. Rows
    that begin no series give none; ``number`` is unique and counts up within the keys.
    """
    upto = F.sum(size).over(Window.partitionBy(*keys).orderBy(number).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ends = F.array(
        F.struct(F.pmod(F.col("__upto") - F.col(size), F.lit(unit)).alias("rest"), F.lit(True).alias("begins")),
        F.struct(F.pmod(F.col("__upto"), F.lit(unit)).alias("rest"), F.lit(False).alias("begins")),
    )
    rows = df.withColumn("__upto", upto).select(*keys, F.col(number).cast("long").alias("first"), F.explode(ends).alias("x")).select(*keys, "first", "x.rest", "x.begins")
    # From the back; of one row's two ends the beginning comes first, so that its own end isn't behind it.
    behind = Window.partitionBy(*keys, "rest").orderBy(F.desc("first"), F.desc("begins")).rowsBetween(Window.unboundedPreceding, -1)
    found = rows.withColumn("last", F.last(F.when(~F.col("begins"), F.col("first")), ignorenulls=True).over(behind))
    return found.where("begins AND last IS NOT NULL").select(*keys, "first", "last")


def disjoint_spans(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Of spans (keys, first, last), in order of their starts, those that begin behind the end of the last one taken.

    A key's spans are one row here, as each choice depends on the one before.
    """
    rows = spans.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("spans"))
    none = F.struct(F.lit(None).cast("long").alias("end"), F.array().cast("array<struct<first:bigint,last:bigint>>").alias("taken"))

    def take(done: Column, span: Column) -> Column:
        free = done["end"].isNull() | (span["first"] > done["end"])
        return F.when(free, F.struct(span["last"].alias("end"), F.concat(done["taken"], F.array(span)).alias("taken"))).otherwise(done)

    taken = F.aggregate("spans", none, take, lambda done: done["taken"])
    return rows.select(*keys, F.inline(taken))


def in_range_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The rows in parts of the order of keys and ``order``, settled; adds ``__at``, which rises in that order, and ``__part``.

    What a window over a whole key, or over all rows, computes in one task can be
    put together from its parts: as many tasks as ranges work on one key.
    """
    columns = [F.col(c) for c in (*keys, *order)]
    placed = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__at", F.monotonically_increasing_id())
    return settle(placed, "range-parts").withColumn("__part", F.shiftright("__at", 33))


def running_totals(df: DataFrame, order: Sequence[str], value: Column, into: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to this one in the order, without a window over all of them.

    Rows of equal order are taken one after the other. Each part's total reaches the driver: a number for each partition.
    """
    placed = in_range_parts(df.withColumn("__value", value), [], order)
    offsets, total = [], 0
    for part, own in sorted(tuple(r) for r in placed.groupBy("__part").agg(F.sum("__value").alias("own")).collect()):
        offsets.append((part, total))
        total += own or 0
    known = df.sparkSession.createDataFrame(offsets, "__of long, __offset long")
    own = F.coalesce(F.sum("__value").over(Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0))
    found = placed.join(F.broadcast(known), F.col("__part") == F.col("__of")).withColumn(into, F.col("__offset") + own)
    return found.drop("__at", "__part", "__value", "__of", "__offset")
