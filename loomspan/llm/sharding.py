"""Sharding by sampled splitters: size-weighted key sample, quantile boundaries,
range partitioning, and subdivision of overfull ranges."""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import settle, table, text_or_empty

#: Bytes of text that one range should hold, and bounds of the number of ranges.
RANGE_BYTES, LEAST_RANGES, MOST_RANGES = 64 << 20, 128, 1 << 16
#: Sampled keys for each range; the sample is all that reaches the driver (12 bytes a key, so 12 MB at most).
SAMPLES_PER_RANGE = 16
#: Cells (some 60 bytes each) that may be broadcast.
BROADCAST_CELLS = 400_000
#: Groups of equal texts above this share of a shard are placed first, each by itself; so there are at most 100 for each shard.
LARGE_SHARE = 0.01
#: Rows of such a group that are numbered together, about so many.
CELL_ROWS = 50_000


def quantile_bounds(keys: list[int], ranges: int) -> list[int]:
    """``ranges - 1`` ascending boundaries that cut the sorted keys into equal parts."""
    if not keys:
        return []
    return [keys[min(len(keys) - 1, i * len(keys) // ranges)] for i in range(1, ranges)]


def with_range(rows: DataFrame, key: str, bounds: list[int], into: str) -> DataFrame:
    """Adds the number of boundaries that are <= key, by an unrolled binary search
    over a constant array, each step a projection of the same generated code."""
    if not bounds:
        return rows.withColumn(into, F.lit(0))
    steps = 1
    while steps <= len(bounds):
        steps *= 2
    array = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<long>")  # folded to one constant
    rows = rows.withColumn(into, F.lit(0))
    while steps > 1:
        steps //= 2
        at = F.col(into) + F.lit(steps)
        rows = rows.withColumn(into, F.when((at <= len(bounds)) & (F.try_element_at(array, at) <= F.col(key)), at).otherwise(F.col(into)))
    return rows


def range_of(key: int, bounds: list[int]) -> int:
    """What ``with_range`` computes, for one key; for tests."""
    at = bisect_left(bounds, key)
    while at < len(bounds) and bounds[at] <= key:
        at += 1
    return at


def place_groups(groups: list[tuple[int, int, int]], shards: int, share: float) -> tuple[list[tuple[int, int, int, int, int, int]], list[float]]:
    """Places groups (key, bytes of a row, rows), the largest first, each in the shard with most room.

    A group that no shard has room for is parted: the roomiest shard takes the rows that
    fit, and so on. Returns the pieces (key, size, shard, first row, end, number of
    the shard's placed rows before less the first row) and the room that is left.
    """
    room, placed, pieces = [share] * shards, [0] * shards, []
    for key, size, rows in sorted(groups, key=lambda g: (-g[1] * g[2], g)):
        first = 0
        while first < rows:
            best = max(range(shards), key=lambda s: (room[s], -s))
            fits = rows - first if room[best] >= size * (rows - first) else max(1, int(room[best] // size))
            end = min(rows, first + fits)
            pieces.append((key, size, best, first, end, placed[best] - first))
            room[best] -= size * (end - first)
            placed[best] += end - first
            first = end
    return pieces, room


def _small_table(spark: SparkSession, rows: list[tuple[int, ...]], *names: str) -> DataFrame:
    """Few rows of whole numbers, by way of Arrow: as a list they would be an RDD, which Python workers of another kind unpickle on the executors."""
    columns = zip(*rows, strict=True) if rows else [()] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in columns], names=list(names)))


def shard_documents(
    docs: DataFrame,
    shards: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    range_bytes: int = RANGE_BYTES,
    least_ranges: int = LEAST_RANGES,
) -> DataFrame:
    """Deals all rows into shards of nearly equal bytes (no two differ by more
    than about LARGE_SHARE of a shard or the largest row). Equal texts are in one shard unless no shard has room for all of them.

    A row's size is its text's UTF-8 bytes plus 1 (null text: 1). Groups of equal
    texts above LARGE_SHARE of a shard, few by arithmetic, are placed first
    (``place_groups``). All other rows are ordered by a hash of their text and fill
    the room that is left: a size-weighted sample of these keys gives quantile boundaries of many more
    ranges than shards; a range that proves overfull is
    subdivided by another hash of the text. Exact bytes and rows of
    these cells give by prefix sums where each cell starts, and a running sum
    within each cell where each row starts; the shard is the part of the total
    in which the first row of its text does.

    Returns the input columns and ``size`` (long), ``shard`` (int) and ``slot``
    (long, gapless from 0 in each shard); input columns of these names are
    replaced. Null and empty texts are equal texts; null and repeated ids are dealt like others.
    A shard can be empty if there are fewer rows than shards. An empty table
    gives an empty result. Texts are shuffled once; no task holds more than a
    cell, some RANGE_BYTES or CELL_ROWS rows, but for rows that are equal in id and text, which
    nothing can tell apart.
    """
    text = text_or_empty(text_col)
    size = (F.octet_length(text) + 1).cast("long")
    unit = F.shiftrightunsigned(F.xxhash64(F.lit("cell"), F.col(id_col)), 11) / F.lit(float(1 << 53))
    keys = {"__size": size, "__key": F.xxhash64(text), "__unit": unit}
    narrow = settle(docs.select(*[c.alias(n) for n, c in keys.items()]), "shard-keys")
    total = narrow.agg(F.coalesce(F.sum("__size"), F.lit(0)).cast("long").alias("n")).first()["n"]

    share = total / shards
    counted = narrow.groupBy("__key", "__size").agg(F.count(F.lit(1)).alias("__rows")).where(F.col("__size") * F.col("__rows") > LARGE_SHARE * share)
    groups = [tuple(r) for r in counted.collect()]  # at most shards / LARGE_SHARE
    pieces, room = place_groups(groups, shards, share)
    large = _small_table(docs.sparkSession, [(k, z, -(-n // CELL_ROWS)) for k, z, n in groups], "__key", "__size", "__bins")
    rest = narrow.join(F.broadcast(large), ["__key", "__size"], "left_anti")

    filled = FilledCells(rest, total - sum(z * n for _, z, n in groups), least_ranges, range_bytes)
    left = sum(max(0.0, r) for r in room) or 1.0
    ends, end = [], 0.0
    for r in room[:-1]:
        end += max(0.0, r) * filled.total / left
        ends.append(end)

    def dealt(rows: DataFrame) -> DataFrame:
        shard = sum([(F.col("__from") >= F.lit(float(e))).cast("int") for e in ends], F.lit(0))
        return filled.place(rows).withColumn("shard", shard)

    firsts = dealt(rest).groupBy("shard").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__filled"))
    firsts = settle(firsts, "shard-firsts")
    names = [c for c in docs.columns if c.lower() not in {"size", "shard", "slot"}]
    full = docs.select(*names, *[c.alias(n) for n, c in keys.items()])
    result = [*names, F.col("__size").alias("size"), "shard"]
    small = dealt(full.join(F.broadcast(large), ["__key", "__size"], "left_anti")).join(F.broadcast(firsts), "shard")  # one row for each shard
    small = small.select(*result, (F.col("__at") - F.col("__first")).cast("long").alias("slot"))
    if not groups:
        return small

    def binned(rows: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(large), ["__key", "__size"]).withColumn("__bin", F.floor(F.col("__unit") * F.col("__bins")))

    earlier = Window.partitionBy("__key", "__size").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = binned(narrow).groupBy("__key", "__size", "__bin").agg(F.count(F.lit(1)).alias("__rows"))
    bins = settle(bins.select("__key", "__size", "__bin", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before")), "shard-bins")
    bins = F.broadcast(bins) if bins.count() <= BROADCAST_CELLS else bins
    in_bin = Window.partitionBy("__key", "__size", "__bin").orderBy("__unit")
    ranked = binned(full).join(bins, ["__key", "__size", "__bin"]).withColumn("__rank", F.col("__before") + F.row_number().over(in_bin) - 1)
    parts = _small_table(docs.sparkSession, pieces, "__of", "__each", "shard", "__begin", "__end", "__base").withColumn("shard", F.col("shard").cast("int"))
    parts = parts.join(F.broadcast(firsts), "shard", "left")
    mine = (F.col("__key") == F.col("__of")) & (F.col("__size") == F.col("__each")) & (F.col("__rank") >= F.col("__begin")) & (F.col("__rank") < F.col("__end"))
    ranked = ranked.join(F.broadcast(parts), mine)  # as many as groups and shards
    return small.unionByName(ranked.select(*result, (F.coalesce("__filled", F.lit(0)) + F.col("__base") + F.col("__rank")).cast("long").alias("slot")))


class FilledCells:
    """Ranges of keys, cut where they prove overfull, and where each begins in the order of all rows."""

    def __init__(self, narrow: DataFrame, total: int, least_ranges: int, range_bytes: int):
        self.total, ranges = total, least_ranges
        while ranges < MOST_RANGES and ranges * range_bytes < total:
            ranges *= 2
        wanted = ranges * SAMPLES_PER_RANGE
        # A row is drawn with probability size * wanted / total; larger rows, as often as they hold that many parts.
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), F.col("__key"), F.col("__unit")), 11) / F.lit(float(1 << 53))
        times = F.floor(F.col("__size") * F.lit(wanted / max(1, total)) + draw).cast("int")
        drawn = narrow.withColumn("__times", times).where(F.col("__times") > 0).groupBy("__key").agg(F.sum("__times").alias("__times"))
        sample = drawn.select("__key", "__times").toArrow()
        sample = np.repeat(np.asarray(sample.column("__key")), np.asarray(sample.column("__times")))
        self.bounds = quantile_bounds(np.sort(sample).tolist(), ranges)
        ideal = max(1, min(total // ranges, range_bytes))
        held = with_range(narrow, "__key", self.bounds, "__range").groupBy("__range").agg(F.sum("__size").alias("__bytes"))
        self.parts = settle(held.select("__range", F.greatest(F.lit(1), F.ceil(F.col("__bytes") / F.lit(1.5 * ideal))).cast("int").alias("__parts")), "shard-parts")
        cells = self._celled(narrow).groupBy("__range", "__part").agg(F.sum("__size").alias("__bytes"), F.count(F.lit(1)).alias("__rows"))
        earlier = Window.orderBy("__range", "__part").rowsBetween(Window.unboundedPreceding, -1)
        before = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("__bytes", "__rows")]
        cells = settle(cells.select("__range", "__part", *before), "shard-cells")
        self.cells = F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells

    def _celled(self, rows: DataFrame) -> DataFrame:
        of_key = F.shiftrightunsigned(F.xxhash64(F.lit("part"), F.col("__key")), 11) / F.lit(float(1 << 53))
        # One row for each range: bounded by MOST_RANGES.
        rows = with_range(rows, "__key", self.bounds, "__range").join(F.broadcast(self.parts), "__range", "left")
        return rows.withColumn("__part", F.floor(of_key * F.col("__parts")).cast("int"))

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds each row's number (``__at``) and the byte at which the first row of its text starts (``__from``)."""
        rows = self._celled(rows).join(self.cells, ["__range", "__part"], "left")
        in_cell = Window.partitionBy("__range", "__part").orderBy("__key", "__unit", "__size")
        before = in_cell.rowsBetween(Window.unboundedPreceding, -1)
        start = F.col("__bytes_before") + F.coalesce(F.sum("__size").over(before), F.lit(0))
        rows = rows.withColumn("__start", start).withColumn("__at", F.col("__rows_before") + F.row_number().over(in_cell) - 1)
        return rows.withColumn("__from", F.min("__start").over(Window.partitionBy("__range", "__part", "__key")))


def crc32_of(text: Column) -> Column:
    return F.crc32(F.encode(F.coalesce(text, F.lit("")), "UTF-8"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    named = docs.withColumn("text_crc32", crc32_of(F.col("text")))
    return shard_documents(named).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
