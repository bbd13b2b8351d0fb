"""Gene-model tracks: coding parts, bodies, flanks, sizes, and what is wrong with a record.

A record has ``start``, ``end``, ``thick_start``, ``thick_end`` and ``blocks``,
an array of (s, e) in absolute coordinates, ascending.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bases on either side of a body that count as its flanks.
FLANK = 10_000


def clip_blocks(blocks: Column, start: Column, end: Column) -> Column:
    """The parts of the blocks within [start, end); a block that only touches it goes."""
    inside = F.filter(blocks, lambda b: (b["e"] > start) & (b["s"] < end))
    return F.transform(inside, lambda b: F.struct(F.greatest(b["s"], start).alias("s"), F.least(b["e"], end).alias("e")))


def coding_blocks(df: DataFrame) -> DataFrame:
    """Adds ``cds``, the blocks' coding parts."""
    return df.withColumn("cds", clip_blocks(F.col("blocks"), F.col("thick_start"), F.col("thick_end")))


def block_bases(blocks: Column) -> Column:
    return F.aggregate(blocks, F.lit(0).cast("long"), lambda n, b: n + b["e"] - b["s"])


def explode_blocks(df: DataFrame, blocks: str, *keep: str) -> DataFrame:
    """A row (number from 1, s, e) for each block."""
    rows = df.select(*keep, F.posexplode(blocks).alias("n", "b"))
    return rows.select(*keep, (F.col("n") + 1).cast("long").alias("n"), F.col("b.s").alias("s"), F.col("b.e").alias("e"))


def four_tracks(df: DataFrame, name: str, flank: int = FLANK) -> DataFrame:
    """Exons, coding exons, body, and body with flanks (whose start is at least 1), as rows."""
    whole = F.array(F.struct(F.col("start").alias("s"), F.col("end").alias("e")))
    wide = F.array(F.struct(F.greatest(F.col("start") - flank, F.lit(1)).alias("s"), (F.col("end") + flank).alias("e")))
    parts = [("exons", F.col("blocks")), ("cds", F.col("cds")), ("body", whole), ("flanks", wide)]
    tracks = F.array(*[F.struct(F.lit(n).alias("track"), blocks.alias("blocks")) for n, blocks in parts])
    rows = coding_blocks(df).select(name, F.explode(tracks).alias("t")).select(name, "t.track", "t.blocks")
    return explode_blocks(rows, "blocks", name, "track")


def sizes(df: DataFrame) -> DataFrame:
    """Adds gene length, blocks, coding bases, and intron bases (length less all block bases)."""
    length = F.col("end") - F.col("start")
    return coding_blocks(df).withColumns(
        {"gene_len": length, "n_exons": F.size("blocks").cast("long"), "cds_bases": block_bases(F.col("cds")), "intron_bases": length - block_bases(F.col("blocks"))}
    )


def reject_reason(df: DataFrame, allow_out_of_frame: bool = False) -> DataFrame:
    """Adds ``reason``, null for a good record: no coding part, coding part without blocks, or out of frame."""
    out = F.col("cds_bases") % 3 != 0
    reason = F.when(F.col("thick_start") >= F.col("thick_end"), "no coding part").when(F.size("cds") == 0, "no coding blocks")
    return sizes(df).withColumn("reason", reason if allow_out_of_frame else reason.when(out, "out of frame"))


def coding_sizes(df: DataFrame, name: str) -> DataFrame:
    """Coding exon sizes numbered from 1 in the direction of transcription."""
    cds = F.when(F.col("strand") == "-", F.reverse("cds")).otherwise(F.col("cds"))
    return explode_blocks(coding_blocks(df).withColumn("cds", cds), "cds", name).select(name, F.col("n").alias("exon"), (F.col("e") - F.col("s")).alias("size"))
