"""The later half of an annotation: from an aligner's output to losses and orthology."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.sequences import projection_parts
from loomspan.operators import aligned, aligner_output, frame_report, loss, orthology
from loomspan.session import settle


def losses(report: frame_report.Report, exons: DataFrame, out_of_chain: DataFrame, paralogs: DataFrame, transcripts: DataFrame, isoforms: DataFrame, key: str, predefined: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(projection, loss) and the classes of all levels (``loss.roll_up``); ``transcripts``: key, transcript."""
    features = loss.loss_features(report.mutations, report.shares, exons, out_of_chain, paralogs, key)
    classes = settle(loss.loss_class(features).select(F.col(key).alias("projection"), "loss"), "losses")
    owned = classes.join(transcripts.select(F.col(key).alias("projection"), "transcript"), "projection")
    return classes, loss.roll_up(owned, isoforms, predefined)


def conclude(pairs: DataFrame, entries: DataFrame, isoforms: DataFrame, scores: DataFrame, paralogs: DataFrame, splices: DataFrame | None = None, excluded: DataFrame | None = None, predefined: DataFrame | None = None) -> dict[str, DataFrame]:
    """All tables that follow from aligned projections.

    ``pairs``: projection (transcript.chain), ref, query; ``entries`` of
    ``aligner_output.read_sections``; ``isoforms``: gene, transcript; ``scores``: projection, score;
    ``paralogs``: projection. Exons missing from the entries count as missing.

    Returns the tables of ``aligner_output.annotate_output``, ``mutations``,
    ``shares``, ``losses`` (level, id, class), ``query_genes`` (gene and the members of each) and ``orthology``.
    """
    output = aligner_output.annotate_output(entries, excluded)
    key = "projection"
    codons = settle(aligned.codon_table(pairs, key), "codons")
    sizes = codons.groupBy(key, (F.col("t_exon") + 1).alias("exon")).agg(F.sum(F.length(F.regexp_replace("ref_codon", "-", ""))).alias("size"))
    known = output.exons.select(
        F.concat_ws(".", "transcript", F.col("chain").cast("string")).alias(key), (F.col("exon") + 1).cast("long").alias("exon"), "class", (F.col("gap") == "GAP").alias("in_gap"), (F.col("included") == "INC").alias("included"), "identity", "score", F.lit(False).alias("is_missing")
    )
    states = aligned.exon_status(sizes.join(known, [key, "exon"], "left").withColumn("is_missing", F.coalesce("is_missing", F.lit(True))))
    exons = settle(states.select(key, "exon", "size", "state"), "exon-states")
    report = frame_report.mutation_report(codons, exons, key, splices)
    outside = aligned.out_of_chain_share(codons, exons.where("state = 'M'").select(key, (F.col("exon") - 1).alias("t_exon")), key)

    transcript, _ = projection_parts(F.col(key))
    named = exons.select(key).distinct().withColumn("transcript", transcript)
    classes, levels = losses(report, exons, outside, paralogs, named, isoforms, key, predefined)
    kept = orthology.query_transcripts(named.select(key), paralogs, classes.withColumnRenamed("loss", "class"))
    placed = output.tracks.withColumnRenamed("name", key).join(kept, key, "left_semi")
    blocks = placed.select("chrom", "strand", F.explode("blocks").alias("b"), F.col(key).alias("name")).select("chrom", "strand", "b.s", "b.e", "name")
    genes = settle(orthology.genes_of_overlaps(blocks), "query-genes")
    edges = orthology.connect_genes(isoforms.withColumnRenamed("gene", "r_gene"), kept.join(named, key), genes.select(F.col("gene").alias("q_gene"), F.col("name").alias(key)), scores)
    types = orthology.orthology_types(isoforms.select(F.col("gene").alias("r_gene")), edges)
    return output._asdict() | {"mutations": report.mutations, "shares": report.shares, "losses": levels, "query_genes": genes, "orthology": types}
