"""Projected genes: aligned exons as tracks, pseudogenes, scores and tables with defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.operators.intervals import union_intervals
from loomspan.operators.loss import exon_mark
from loomspan.operators.runs import falling_runs

#: Fields of an aligned query exon's header.
FIELDS = ("gene", "exon", "chain", "region", "identity", "score", "gap", "class", "expected", "included", "paralog", "role")


def exon_records(entries: DataFrame) -> DataFrame:
    """Query exons from FASTA (header, seq): the header's fields, typed, with chrom, s, e, strand and the exon's mark."""
    parts = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    rows = entries.select(parts.alias("f"), "seq").where(F.size("f") == len(FIELDS)).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(FIELDS)], "seq")
    shape = r"^(.+):(\d+)-(\d+)$"
    a, b = F.regexp_extract("region", shape, 2).try_cast("long"), F.regexp_extract("region", shape, 3).try_cast("long")
    typed = rows.where(F.col("region").rlike(shape)).withColumns(
        {
            "exon": F.col("exon").try_cast("int"), "identity": F.col("identity").try_cast("double"), "score": F.col("score").try_cast("double"), "is_included": F.col("included") == "INC",
            "chrom": F.regexp_extract("region", shape, 1), "s": F.least(a, b), "e": F.greatest(a, b), "strand": F.when(a <= b, "+").otherwise("-"),
        }
    )
    return typed.withColumn("mark", exon_mark(F.col("class"), F.col("is_included"), F.col("identity"), F.col("score")))


def projection_tracks(exons: DataFrame) -> DataFrame:
    """Tracks of projections from kept exons (projection, exon, chrom, strand, s, e).

    A projection's exons on a chromosome and strand are split wherever they do not
    go on in the direction of the strand; returns name, chrom, strand, start, end
    and blocks, and the part's number from 0.
    """
    way = F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s"))
    parts = falling_runs(exons.withColumn("__way", way), ["projection", "chrom", "strand"], ["exon"], "__way")
    grouped = parts.groupBy("projection", "chrom", "strand", "part")
    return grouped.agg(F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("blocks")).withColumnRenamed("projection", "name")


def pseudogene_track(classified: DataFrame, headers: DataFrame, genes: DataFrame) -> DataFrame:
    """Merged query regions of processed pseudogenes: chrom, strand, s, e, n_parts, name.

    ``classified``: gene, chain_id, chain_class; ``headers``: chain_id, q_name,
    q_size, q_strand, q_start, q_end; ``genes``: gene, strand. Regions of minus
    chains are flipped; the strand is that of gene and chain together.
    """
    rows = classified.where(F.col("chain_class") == "P_PGENES").join(headers, "chain_id").join(genes, "gene")
    minus = F.col("q_strand") == "-"
    regions = rows.select(
        F.col("q_name").alias("chrom"), F.when(F.col("strand") == F.col("q_strand"), "+").otherwise("-").alias("strand"),
        F.when(minus, F.col("q_size") - F.col("q_end")).otherwise(F.col("q_start")).alias("s"), F.when(minus, F.col("q_size") - F.col("q_start")).otherwise(F.col("q_end")).alias("e"), "gene",
    )
    merged = union_intervals(regions, ["chrom", "strand"], merge_adjacent=True)
    names = regions.join(merged.select("chrom", "strand", F.col("s").alias("__s"), F.col("e").alias("__e")), ["chrom", "strand"]).where("s >= __s AND e <= __e")
    named = names.groupBy("chrom", "strand", F.col("__s").alias("s"), F.col("__e").alias("e")).agg(F.min_by("gene", F.struct("s", "e", "gene")).alias("name"))
    return merged.join(named, ["chrom", "strand", "s", "e"])


def exon_scores(codons: DataFrame, key: str, matrix: DataFrame | None = None) -> DataFrame:
    """Percent identity of bases per exon of a codon table, and with a matrix (ref, que, score) the share of the best possible score.

    ``matrix`` has amino acids or codons, whatever ``ref`` and ``que`` name.
    """
    letters = [(F.substring("ref_codon", i, 1), F.substring("que_codon", i, 1)) for i in range(1, 5)]
    shown = lambda r, q: ~r.isin("", "N") & ~q.isin("", "N")
    # Shown letters times ``unit``, and equal ones among them, so that each codon is looked at once; letter arrays are for long codons alone.
    unit = 1 << 32
    short = sum([F.when(shown(r, q), F.when(r == q, F.lit(unit + 1)).otherwise(F.lit(unit))).otherwise(F.lit(0)) for r, q in letters], F.lit(0))
    chars = F.filter(F.arrays_zip(F.split("ref_codon", "").alias("r"), F.split("que_codon", "").alias("q")), lambda c: shown(c["r"], c["q"]))
    long = F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n + F.when(c["r"] == c["q"], F.lit(unit + 1)).otherwise(F.lit(unit)))
    fits = (F.length("ref_codon") <= len(letters)) & (F.length("que_codon") <= len(letters))
    rows = codons.select(key, F.col("t_exon").alias("exon"), F.when(fits, short).otherwise(long).alias("c"))
    sums = rows.groupBy(key, "exon").agg(F.sum(F.shiftright("c", 32)).alias("n"), F.sum(F.col("c").bitwiseAND(F.lit(unit - 1))).alias("same")).where("n > 0")
    identity = sums.select(key, "exon", (F.col("same") * 100 / F.col("n")).alias("identity"))
    if matrix is None:
        return identity
    plain = codons.select(key, F.col("t_exon").alias("exon"), F.regexp_replace("ref_codon", "-", "").alias("ref"), F.regexp_replace("que_codon", "-", "").alias("que"))
    best = matrix.where("ref = que").select("ref", F.col("score").alias("__best"))
    scored = plain.join(matrix, ["ref", "que"], "left").join(best, "ref", "left")
    total = scored.groupBy(key, "exon").agg(F.sum(F.coalesce("score", F.lit(0))).alias("__sum"), F.sum(F.coalesce("__best", F.lit(0))).alias("__most"))
    share = F.greatest(F.coalesce(F.try_divide(F.col("__sum") * 100, F.col("__most")), F.lit(0.0)), F.lit(0.0))
    return identity.join(total.select(key, "exon", share.alias("score")), [key, "exon"], "full")


def info_table(projections: DataFrame, coordinates: DataFrame, regions: DataFrame, scores: DataFrame, classes: DataFrame) -> DataFrame:
    """A row per projection (projection, transcript) with where it is, its score (0.5) and class (M) where unknown."""
    joined = projections.join(coordinates, "projection", "left").join(regions, "transcript", "left").join(scores, "projection", "left").join(classes, "projection", "left")
    return joined.withColumns({"score": F.coalesce("score", F.lit(0.5)), "class": F.coalesce("class", F.lit("M"))})


def chosen_orthologs(rows: DataFrame, skip_duplicates: bool = False, most_copies: int = 10) -> DataFrame:
    """Projections to align of each species (species, projection, orthology_class): not one2zero, not too many copies."""
    kept = rows.where(F.col("orthology_class") != "one2zero")
    counted = kept.withColumn("copies", F.count(F.lit(1)).over(Window.partitionBy("species")))
    fit = counted.where(F.col("copies") <= most_copies)
    return fit.where("copies = 1") if skip_duplicates else fit


def species_without(species: DataFrame, rows: DataFrame) -> DataFrame:
    """Species without any orthologous projection."""
    return species.select("species").distinct().join(rows.where(F.col("orthology_class") != "one2zero").select("species"), "species", "left_anti")


def nucleotide_places(mutations: DataFrame, exon_starts: DataFrame) -> DataFrame:
    """Adds ``place``, a mutation's base within its exon (from 0), from its codon and the exon's first coding base."""
    joined = mutations.join(exon_starts, ["transcript", "exon"])
    return joined.withColumn("place", F.greatest(F.lit(0), F.col("codon") * 3 - 3 - F.col("before"))).drop("before")
