"""Checks of inputs: each gives the rows that offend, and ``require`` raises if there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def require(offending: DataFrame, what: str, shown: int = 5) -> None:
    rows = offending.limit(shown).collect()
    if rows:
        raise ValueError(f"{what}: {', '.join(str(tuple(r)) for r in rows)}")


def duplicates(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).count().where("count > 1")


def bad_names(df: DataFrame, name: str) -> DataFrame:
    """Names with other characters than letters, digits, dot, underscore and minus."""
    return df.select(name).where(~F.col(name).rlike("^[A-Za-z0-9._-]+$"))


def unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return df.select(key).distinct().join(known.select(key), key, "left_anti")


def wrong_sizes(chroms: DataFrame, genome: DataFrame) -> DataFrame:
    """Chromosomes (chrom, size) that the genome lacks or has in another size."""
    other = genome.select("chrom", F.col("size").alias("__size"))
    return chroms.join(other, "chrom", "left").where("__size IS NULL OR __size <> size").select("chrom", "size")


def thick_out_of_range(genes: DataFrame) -> DataFrame:
    return genes.where("thick_start < start OR thick_end > end").select("name")
