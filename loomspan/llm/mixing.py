"""Mixing sources to target weights by fractional repetition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.llm.common import hash_unit, settle, table, word_count

#: Sources whose rates may be broadcast: about 60 bytes each, so at most some 30 MB.
BROADCAST_SOURCES = 500_000
#: Rows of one source and class of size that draw against one another, about so many.
CELL_ROWS = 10_000


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """From one row (source, source_size) per source: the target of each.

    Sources in code point order, null last, take the weights in turn, again and
    again, and share the total of all sizes. A target stops at ``cap`` times its
    source's size and the excess goes to the others by weight: with the level L
    at which min(L * weight, cap * size) sums to the total, that is each
    source's target. L is found by one ordered pass over the sources (one row
    each), by the ratio at which each meets its cap.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("__ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy(F.lit(1))
    turn = (F.row_number().over(order) - 1) % len(weights)
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    levels = (
        sizes.withColumn("__weight", cycle)
        .withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
        .withColumn("__ratio", F.col("__cap") / F.col("__weight"))
        .withColumn("__total", F.sum("source_size").over(all_rows).cast("double"))
        .withColumn("__rest", F.sum("__weight").over(all_rows) - F.coalesce(F.sum("__weight").over(before), F.lit(0.0)))
        .withColumn("__level", (F.col("__total") - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / F.col("__rest"))
        .withColumn("__free", F.col("__level") <= F.col("__ratio"))
    )
    # The first source that does not meet its cap has the level of all that follow.
    first = F.first(F.when(F.col("__free"), F.col("__level")), ignorenulls=True).over(
        by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    share = F.least(F.col("__cap"), F.coalesce(F.col("__common") * F.col("__weight"), F.col("__cap")))
    return levels.withColumn("__common", first).select("source", "source_size", share.alias("target"))


def size_class(size: Column) -> Column:
    """An eighth of an octave of sizes, as text in the order of sizes: the number of binary digits, and the three behind the first."""
    digits = F.bin(size)
    return F.concat(F.lpad(F.length(digits).cast("string"), 2, "0"), F.substring(F.concat(digits, F.lit("000")), 2, 3))


def extra_draws(sized: DataFrame, rates: DataFrame, seed: str, cell_rows: int = CELL_ROWS) -> tuple[DataFrame, DataFrame]:
    """Which draws of a source (of ``rates``: source, fraction) are taken once more.

    A source's rows stand in order of their size's class and, in classes of very many, of
    parts of their draws; such cells hold about ``cell_rows`` rows. With one
    offset for the source, drawn from its name, a cell of rows a to b (from 0) takes
    floor(b * fraction + offset) - floor(a * fraction + offset) of them, those of the smallest
    draws. So a row is taken once more with a probability of just the
    fraction, and what a source's rows take in all is off by about one of its
    largest. Equal draws are counted before the shuffle.

    Returns the parts of each class that has several (source, class, parts), and
    the cells with the largest draw that is taken (source, class, part, upto).
    """
    draws = sized.groupBy("source", size_class(F.col("size")).alias("class"), "draw").agg(F.count(F.lit(1)).alias("rows"))
    draws = settle(draws, "mix-draws")
    sizes = settle(draws.groupBy("source", "class").agg(F.ceil(F.sum("rows") / cell_rows).cast("long").alias("parts")).where("parts > 1"), "mix-parts")
    cells = with_part(draws, sizes)
    of_source = Window.partitionBy("source").orderBy("class", "part")
    ends = cells.groupBy("source", "class", "part").agg(F.sum("rows").alias("rows")).withColumn("end", F.sum("rows").over(of_source))
    named = rates.select(F.col("source").alias("__named"), "fraction", hash_unit(F.col("source"), f"{seed}-source").alias("offset"))
    step = lambda n: F.floor(n * F.col("fraction") + F.col("offset"))
    takes = ends.join(named, F.col("source").eqNullSafe(F.col("__named"))).withColumn("takes", step(F.col("end")) - step(F.col("end") - F.col("rows")))
    takes = settle(takes.where("takes > 0").select(*[F.col(c).alias(f"__{c}") for c in ("source", "class", "part")], "takes"), "mix-takes")
    same = F.col("source").eqNullSafe(F.col("__source")) & (F.col("class") == F.col("__class")) & (F.col("part") == F.col("__part"))
    in_cell = Window.partitionBy("source", "class", "part").orderBy("draw").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.join(takes, same).withColumn("before", F.coalesce(F.sum("rows").over(in_cell), F.lit(0)))
    return sizes, settle(ranked.where("before < takes").groupBy("source", "class", "part").agg(F.max("draw").alias("upto")), "mix-taken")


def with_part(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """Adds ``part``: which part of its class's draws a row's is in."""
    few = F.broadcast if parts.count() <= BROADCAST_SOURCES else lambda df: df
    parts = few(parts.select(F.col("source").alias("__of"), F.col("class").alias("__at"), "parts"))
    found = rows.join(parts, F.col("source").eqNullSafe(F.col("__of")) & (F.col("class") == F.col("__at")), "left")
    return found.withColumn("part", F.coalesce(F.floor(F.col("draw") * F.col("parts")), F.lit(0))).drop("__of", "__at", "parts")


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    cap: float = 3.0,
    seed: str = "mix-1",
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Adds to each row how often the mix takes it.

    Sizes are words. A source's repetition rate is target / source_size; each
    row is taken floor(rate) times, and once more with a probability of the
    rate's fraction, by a number in [0, 1) drawn from its id and the seed and one drawn for its source
    (``extra_draws``). So a rerun takes the same rows, no row is taken more than
    ceil(cap) times, and a source of one document, whatever its rate, is taken as often as its rate asks for on average over seeds.

    Returns the input columns and ``size``, ``source_size``, ``target``,
    ``copies`` (int) and ``taken`` = copies * size; input columns of these names
    are replaced. Null and blank texts have size 0; null sources form one
    source; a source of size 0 has rate 0. Repeated ids share a draw; rows of
    null id draw by their texts. An empty table gives an empty result. Sizes and
    draws are aggregated before the shuffle, so a source with most rows, or very many
    equal rows, are no hot key; texts are not shuffled. Rates and cells are broadcast
    up to ``BROADCAST_SOURCES`` rows, more are joined by shuffle.
    """
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(F.col(text_col), F.lit("")))))
    words = word_count(F.col(text_col))
    sized = settle(docs.select(words.alias("size"), F.col(source_col).alias("source"), hash_unit(key, seed).alias("draw")), "mix-sizes")
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rates = settle(source_targets(totals, weights, cap).withColumn("whole", F.floor(rate)).withColumn("fraction", rate - F.floor(rate)), "mix-targets")
    parts, taken = extra_draws(sized, rates, seed, cell_rows)

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if df.count() <= BROADCAST_SOURCES else df

    named = small(rates.select(*[F.col(c).alias(f"__{c}") for c in ("source", "source_size", "target", "whole")]))
    cells = small(taken.select(*[F.col(c).alias(f"__cell_{c}") for c in ("source", "class", "part", "upto")]))
    kept = [c for c in docs.columns if c.lower() not in {"size", "source_size", "target", "copies", "taken"}]
    rows = docs.select(F.struct(*kept).alias("__row"), F.col(source_col).alias("source"), words.alias("__size"), hash_unit(key, seed).alias("draw"))
    rows = with_part(rows.withColumn("class", size_class(F.col("__size"))), parts).join(named, F.col("source").eqNullSafe(F.col("__source")), "left")
    in_cell = F.col("source").eqNullSafe(F.col("__cell_source")) & (F.col("class") == F.col("__cell_class")) & (F.col("part") == F.col("__cell_part"))
    once_more = F.coalesce(F.col("draw") <= F.col("__cell_upto"), F.lit(False))
    rows = rows.join(cells, in_cell, "left").withColumn("__copies", (F.col("__whole") + once_more.cast("int")).cast("int"))
    made = {"size": "__size", "source_size": "__source_size", "target": "__target", "copies": "__copies"}
    return rows.select("__row.*", *[F.col(c).alias(n) for n, c in made.items()]).withColumn("taken", F.col("size") * F.col("copies"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


SQL = """
WITH sized AS (
  SELECT doc_id, source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
         source_size * 3.0::DOUBLE AS cap FROM totals),
levels AS (
  SELECT *, cap / weight AS ratio,
         ((SELECT sum(source_size) FROM totals)::DOUBLE
          - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
common AS (SELECT arg_min(level, ratio) AS level FROM levels WHERE level <= ratio),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT level FROM common) * weight, cap)) AS target FROM levels),
drawn AS (
  SELECT doc_id, sized.source, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix-1:' || doc_id::VARCHAR), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS draw,
         ('0x' || substr(md5('mix-1-source:' || coalesce(sized.source, chr(0))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS shift,
         lpad(length(bin(size))::VARCHAR, 2, '0') || substr(bin(size) || '000', 2, 3) AS class
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
parted AS (
  SELECT *, floor(draw * ceil(count(*) OVER (PARTITION BY source, class) / 10000.0::DOUBLE))::BIGINT AS part, rate - floor(rate) AS fraction FROM drawn),
cells AS (SELECT source, class, part, count(*) AS n, any_value(fraction) AS fraction, any_value(shift) AS shift FROM parted GROUP BY 1, 2, 3),
ends AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY class, part) AS e FROM cells),
takes AS (SELECT source, class, part, floor(e::DOUBLE * fraction + shift) - floor((e - n)::DOUBLE * fraction + shift) AS takes FROM ends),
ranked AS (
  SELECT p.*, takes, rank() OVER (PARTITION BY p.source, p.class, p.part ORDER BY draw) AS nth
  FROM parted p JOIN takes t ON p.source IS NOT DISTINCT FROM t.source AND p.class = t.class AND p.part = t.part)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN nth <= takes THEN 1 ELSE 0 END))::BIGINT AS taken,
       (floor(rate) + CASE WHEN nth <= takes THEN 1 ELSE 0 END)::INT AS copies
FROM ranked
"""
