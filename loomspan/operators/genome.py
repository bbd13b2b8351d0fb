"""Genome sequences as chunks, and what is cut from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.sequences import codons, reverse_complement
from loomspan.operators.mutations import STOPS
from loomspan.operators.runs import prefix_sums

CHUNK = 1 << 16


def chunk_genome(entries: DataFrame, size: int = CHUNK) -> DataFrame:
    """(chrom, chunk from 0, seq) from (header, seq): no row is longer than a chunk."""
    parts = F.when(F.length("seq") > 0, codons(F.col("seq"), size)).otherwise(F.array(F.lit("")))
    return entries.select(F.split("header", r"\s")[0].alias("chrom"), F.posexplode(parts).alias("chunk", "seq")).withColumn("chunk", F.col("chunk").cast("long"))


def fetch(genome: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """Adds ``seq`` to regions (chrom, s, e, strand and others): upper-cased, reversed and complemented on the minus strand.

    A region meets the chunks that it covers by an equality join; what lies
    beyond a chromosome is not there, and a region without any is empty.
    """
    keyed = regions.withColumn("__id", F.monotonically_increasing_id())
    covered = keyed.select("__id", "chrom", "s", "e", F.explode(F.sequence(F.floor(F.col("s") / size), F.floor((F.greatest(F.col("e") - 1, F.col("s"))) / size))).alias("chunk"))
    part = F.substring("seq", (F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0)) + 1).cast("int"), (F.least(F.col("e") - F.col("chunk") * size, F.lit(size)) - F.greatest(F.col("s") - F.col("chunk") * size, F.lit(0))).cast("int"))
    joined = covered.join(genome, ["chrom", "chunk"]).groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("chunk", part.alias("x")))).alias("xs"))
    text = F.upper(F.coalesce(F.array_join(F.transform("xs", lambda x: x["x"]), ""), F.lit("")))
    return keyed.join(joined, "__id", "left").withColumn("seq", F.when(F.col("strand") == "-", reverse_complement(text)).otherwise(text)).drop("__id", "xs")


def gap_spans(df: DataFrame, key: str, seq: str = "seq", least: int = 10) -> DataFrame:
    """(key, s, e) of runs of at least ``least`` unknown bases."""
    runs = df.select(key, F.posexplode(F.regexp_extract_all(F.upper(seq), F.lit("N+|[^N]+"), F.lit(0))).alias("n", "run"))
    sized = runs.select(key, "n", F.length("run").cast("long").alias("size"), F.startswith("run", F.lit("N")).alias("unknown"))
    spans = prefix_sums(sized, [key], ["n"], "size", "s")
    return spans.where(F.col("unknown") & (F.col("size") >= least)).select(key, F.col("s").cast("long").alias("s"), (F.col("s") + F.col("size")).cast("long").alias("e"))


def reference_exons(df: DataFrame, seq: str = "seq") -> DataFrame:
    """Checks and masks a coding sequence: ``problem`` (null if none) and ``masked``, in-frame stops but the last as NNN."""
    parts = codons(F.upper(seq))
    size = F.size(parts)
    inner = F.transform(parts, lambda c, i: F.when(c.isin(*STOPS) & (i < size - 1), "NNN").otherwise(c))
    problem = F.when(F.length(seq) % 3 != 0, "out of frame").when(F.get(parts, F.lit(0)) != "ATG", "no start codon").when(~F.get(parts, size - 1).isin(*STOPS), "no stop codon")
    return df.withColumn("problem", F.when(F.length(seq) == 0, "empty").otherwise(problem)).withColumn("masked", F.array_join(inner, ""))


def mark_split_codons(seq: Column, before: Column) -> Column:
    """Lower-cases the bases of codons that the exon's ends split; ``before``: coding bases ahead of the exon."""
    head = (3 - before % 3) % 3
    tail = (before + F.length(seq)) % 3
    middle = F.greatest(F.length(seq) - head - tail, F.lit(0))
    return F.concat(F.lower(F.substring(seq, F.lit(1), head.cast("int"))), F.upper(F.substring(seq, (head + 1).cast("int"), middle.cast("int"))), F.lower(F.substring(seq, (head + middle + 1).cast("int"), F.length(seq))))
