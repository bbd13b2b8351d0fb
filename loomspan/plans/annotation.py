"""The annotation pipeline, from gene models and chains to loci to align."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions import tracks
from loomspan.operators import chains, classify, intervals
from loomspan.plans import checks
from loomspan.session import settle

STEPS = ("genes", "chains", "overlaps", "features", "classes", "chosen", "loci")


def coverage_score(table: DataFrame) -> DataFrame:
    """A stand-in for a trained model: the share of coding bases that the chain covers."""
    return table.withColumn("score", F.coalesce(F.try_divide(F.col("exon_cover"), F.col("ex_fract")), F.lit(0.0)))


def annotate(
    genes: DataFrame,
    headers: DataFrame,
    raw_blocks: DataFrame,
    isoforms: DataFrame | None = None,
    score: Callable[[DataFrame], DataFrame] = coverage_score,
    least_chain_score: int = 15000,
    threshold: float = 0.5,
    limit: int = 100,
    up_to: str = "loci",
    bin_size: int = 1 << 16,
) -> dict[str, DataFrame]:
    """Runs the steps up to and with ``up_to``; returns the table of each, and ``rejected`` and ``skipped``.

    ``genes`` of ``read_bed12``; ``headers`` and ``raw_blocks`` of ``read_chains``;
    ``score`` adds a model's score to the feature table.
    """
    checks.require(checks.duplicates(genes, "name"), "names that occur twice")
    checks.require(checks.bad_names(genes, "name"), "names with other characters")
    checks.require(checks.thick_out_of_range(genes), "coding parts beyond the gene")
    marked = tracks.reject_reason(genes)
    out = {"genes": marked.where("reason IS NULL").drop("reason"), "rejected": marked.where("reason IS NOT NULL").select("name", "reason")}
    if up_to == "genes":
        return out
    kept = chains.score_filter(headers, least_chain_score)
    blocks = chains.decode_blocks(kept, raw_blocks).join(kept.select("chain_id", F.col("t_name").alias("chrom")), "chain_id")
    out["chains"] = settle(blocks, "chain-blocks")
    if up_to == "chains":
        return out

    coding = out["genes"].select("chrom", F.col("name").alias("transcript"), F.col("thick_start").alias("s"), F.col("thick_end").alias("e"))
    spans = kept.select("chain_id", F.col("t_name").alias("chrom"), F.col("t_start").alias("s"), F.col("t_end").alias("e"))
    pairs = intervals.overlap_join(coding, spans, ["chrom"], bin_size).select(F.col("a_transcript").alias("transcript"), F.col("b_chain_id").alias("chain_id"))
    out["overlaps"] = settle(pairs, "overlaps")
    out["skipped"] = intervals.skipped(coding, spans.select("chrom", "s", "e"), ["chrom"], bin_size).select("transcript", "reason")
    if up_to == "overlaps":
        return out

    four = tracks.four_tracks(out["genes"].withColumnRenamed("name", "transcript"), "transcript").join(out["genes"].select(F.col("name").alias("transcript"), "chrom"), "transcript")
    parts = out["overlaps"].join(four, "transcript")
    placed = out["chains"].select("chain_id", "chrom", F.col("t_start").alias("s"), F.col("t_end").alias("e"))
    hits = intervals.overlap_join(parts, placed, ["chrom", "chain_id"], bin_size)
    size = intervals.overlap_size(F.col("a_s"), F.col("a_e"), F.col("b_s"), F.col("b_e"))
    of = lambda t: F.coalesce(F.sum(F.when(F.col("a_track") == t, size)), F.lit(0))
    hit = F.count_distinct(F.when(F.col("a_track") == "cds", F.col("a_s")))
    covered = hits.groupBy(F.col("a_transcript").alias("transcript"), F.col("chain_id")).agg(*[of(t).alias(t) for t in ("exons", "cds", "body", "flanks")], hit.alias("cds_exons"))
    rows = classify.pair_features(covered)
    totals = out["chains"].groupBy("chain_id").agg(F.sum(F.col("t_end") - F.col("t_start")).alias("block_bases"), (F.max("q_end") - F.min("q_start")).alias("q_len"))
    per_chain = classify.chain_features(rows, totals).join(kept.select("chain_id", F.col("score").alias("gl_score")), "chain_id")
    sized = out["genes"].select(F.col("name").alias("transcript"), "gene_len", F.col("n_exons").alias("ex_num"), F.col("cds_bases").alias("ex_fract"), F.col("intron_bases").alias("intr_fract"))
    table = classify.feature_table(rows, per_chain, sized, isoforms)
    renamed = table.withColumnsRenamed({"transcript": "gene", "synteny": "synt", "global_exo": "gl_exo", "exlen_to_qlen": "exon_qlen", "local_exo": "loc_exo", "cds": "exon_cover", "introns": "intr_cover", "block_bases": "chain_len"})
    names = ["gene", "gene_overs", "chain_id", "synt", "gl_score", "gl_exo", "chain_len", "exon_qlen", "loc_exo", "exon_cover", "intr_cover", "gene_len", "ex_num", "ex_fract", "intr_fract", "flank_cov"]
    out["features"] = settle(renamed.select(*names), "features")
    if up_to == "features":
        return out
    out["classes"] = settle(classify.classify_chains(score(out["features"]), threshold), "classes")
    if up_to == "classes":
        return out
    out["chosen"] = classify.choose_chains(out["classes"], limit)
    if up_to == "chosen":
        return out
    regions = out["chosen"].where("kept").join(out["genes"].select(F.col("name").alias("gene"), F.col("start").alias("s"), F.col("end").alias("e")), "gene").select("chain_id", F.col("gene").alias("region"), "s", "e")
    out["loci"] = chains.project_ranges(out["chains"].drop("chrom"), regions, kept)
    return out
