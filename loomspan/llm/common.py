"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.session import discard, scratch, settle

__all__ = ["BLANKS", "discard", "hash_unit", "scratch", "settle", "table", "text_or_empty", "word_count"]

#: White space that parts words, as a character class for regular expressions.
BLANKS = "\\x20\\x09-\\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of maximal runs without white space; null and blank texts have none."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\f\r"))
    return F.when(inner == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{BLANKS}]+"))).cast("long")


def hash_unit(key: Column, seed: str) -> Column:
    """A number in [0, 1) with 48 bits that the key and the seed decide.

    MD5 rather than an engine's own hash, so that other systems can repeat it.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("\0")))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long") / F.lit(float(1 << 48))
