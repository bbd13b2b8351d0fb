"""Text outputs; null becomes the formats' own words for nothing only here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, header: bool = True, nothing: str = "None") -> None:
    """Fields parted by tabs."""
    df.fillna(nothing).write.csv(path, sep="\t", header=header, nullValue=nothing, mode="overwrite")


def bed12_line(df: DataFrame) -> Column:
    """A gene model of ``read_bed12`` as its text line."""
    sizes = F.array_join(F.transform("blocks", lambda b: (b["e"] - b["s"]).cast("string")), ",")
    starts = F.array_join(F.transform("blocks", lambda b: (b["s"] - F.col("start")).cast("string")), ",")
    fields = ["chrom", "start", "end", "name", "score", "strand", "thick_start", "thick_end", "item_rgb"]
    return F.concat_ws("\t", *[F.col(c).cast("string") for c in fields], F.size("blocks").cast("string"), F.concat(sizes, F.lit(",")), F.concat(starts, F.lit(",")))


def write_bed12(df: DataFrame, path: str, sort: bool = False) -> None:
    rows = df.orderBy("chrom", "start", "name") if sort else df
    rows.select(bed12_line(df).alias("value")).write.mode("overwrite").text(path)


def write_fasta(df: DataFrame, path: str, header: str = "header", seq: str = "seq") -> None:
    df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(seq)).alias("value")).write.mode("overwrite").text(path)


def write_index(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """A table for lookups by key: files hold ranges of it, so their statistics skip all but one."""
    df.repartitionByRange(buckets, key).sortWithinPartitions(key).write.mode("overwrite").parquet(path)


def lookup(spark, path: str, key: str, values: list) -> DataFrame:
    return spark.read.parquet(path).where(F.col(key).isin(values))
