"""Chain features, orthology classes of chains, and the choice of chains to project."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Classes of chains, as scores that stand for a decision.
SPANNING, PSEUDOGENE = -1.0, -2.0


def ratio(a: Column, b: Column) -> Column:
    """a / b; 0 for 0 / 0, infinity for others by 0."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(a == 0, 0.0).otherwise(F.lit(float("inf")))


def pair_features(covered: DataFrame) -> DataFrame:
    """Features of a chain and a transcript from covered bases: exons, cds, body, flanks (with the body).

    Adds utr, introns, flank_cov and local_exo = cds / (body less utr).
    """
    utr = F.col("exons") - F.col("cds")
    coding = F.col("body") - utr
    return covered.withColumns(
        {
            "utr": utr,
            "introns": F.col("body") - F.col("exons"),
            "flank_cov": (F.col("flanks") - F.col("body")) / F.lit(20000.0),
            "local_exo": F.coalesce(F.try_divide(F.col("cds"), coding), F.lit(0.0)),
        }
    )


def chain_features(pairs: DataFrame, chains: DataFrame) -> DataFrame:
    """Per chain: synteny (transcripts with coding bases covered), coding bases, global_exo and exlen_to_qlen.

    ``pairs``: chain_id, transcript, cds, utr, cds_exons hit; ``chains``:
    chain_id, block_bases, q_len.
    """
    totals = pairs.groupBy("chain_id").agg(
        F.count(F.when(F.col("cds") > 0, 1)).alias("synteny"), F.sum("cds").alias("chain_cds"), F.sum("utr").alias("chain_utr"), F.max("cds_exons").alias("__most")
    )
    joined = chains.join(totals, "chain_id")
    corrected = F.col("q_len") - F.col("chain_utr")
    whole = F.coalesce(F.try_divide("chain_cds", "block_bases"), F.lit(0.0))
    part = F.when(F.col("__most") > 1, F.coalesce(F.try_divide(F.col("chain_cds"), corrected), F.lit(0.0))).otherwise(F.lit(0.0))
    return joined.withColumn("global_exo", whole).withColumn("exlen_to_qlen", part).drop("__most", "chain_utr")


def feature_table(pairs: DataFrame, chains: DataFrame, transcripts: DataFrame, isoforms: DataFrame | None = None, exon_cover_only: bool = False) -> DataFrame:
    """Joins pair, chain and transcript features; adds gene_overs, the chains of a transcript.

    With isoforms (gene, transcript), synteny is the number of distinct genes of
    all transcripts that the chain overlaps, those without one counting as one.
    """
    if isoforms is not None:
        genes = pairs.select("chain_id", "transcript").join(isoforms, "transcript", "left")
        counted = genes.groupBy("chain_id").agg(F.count_distinct(F.coalesce("gene", F.lit("\0"))).alias("synteny"))
        chains = chains.drop("synteny").join(counted, "chain_id")
    kept = pairs.where("cds > 0") if exon_cover_only else pairs
    overs = kept.groupBy("transcript").agg(F.count(F.lit(1)).alias("gene_overs"))
    return pairs.join(chains, "chain_id").join(transcripts, "transcript").join(overs, "transcript", "left").withColumn("gene_overs", F.coalesce("gene_overs", F.lit(0)))


def classify_chains(table: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds ``pred`` and ``chain_class`` to rows with a model's ``score``.

    Spanning chains (no exon covered, synteny over 1) have -1; processed
    pseudogenes (several exons, synteny 1, exon_qlen over 0.95, score below the
    threshold, over 65 % of exons covered) -2; else below the threshold PARA,
    from it ORTH. Other rows without coverage or synteny are left out.
    """
    spanning = (F.col("exon_cover") == 0) & (F.col("synt") > 1)
    candidate = (F.col("exon_cover") > 0) & (F.col("synt") > 0)
    pseudogene = (F.col("ex_num") > 1) & (F.col("synt") == 1) & (F.col("exon_qlen") > 0.95) & (F.col("score") < threshold) & (ratio(F.col("exon_cover"), F.col("ex_fract")) > 0.65)
    pred = F.when(spanning, SPANNING).when(pseudogene, PSEUDOGENE).otherwise(F.col("score"))
    label = F.when(pred == SPANNING, "SPAN").when(pred == PSEUDOGENE, "P_PGENES").when(pred < threshold, "PARA").otherwise("ORTH")
    return table.where(spanning | candidate).withColumn("pred", pred.cast("double")).withColumn("chain_class", label)


CLASSES = ("ORTH", "PARA", "SPAN", "P_PGENES")


def class_lists(classified: DataFrame) -> DataFrame:
    """Per gene the chains of each class, ascending, as text with commas; ``0`` for none."""
    aggs = [F.array_sort(F.collect_set(F.when(F.col("chain_class") == c, F.col("chain_id")))).alias(c) for c in CLASSES]
    lists = classified.groupBy("gene").agg(*aggs)
    return lists.select("gene", *[F.when(F.size(c) > 0, F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).otherwise("0").alias(c) for c in CLASSES])


def choose_chains(classified: DataFrame, limit: int = 100, one2one_only: bool = False, paralogs: bool = False) -> DataFrame:
    """The chains to project: a gene's orthologous ones, else spanning, else paralogous; at most ``limit``, by id.

    Adds ``rank`` and ``kept``; rows beyond the limit are returned as not kept.
    """
    priority = F.when(F.col("chain_class") == "ORTH", 0).when(F.col("chain_class") == "SPAN", 1).when(F.col("chain_class") == "PARA", 2)
    if paralogs:
        priority = F.when(F.col("chain_class") == "PARA", 0)
    rows = classified.withColumn("__priority", priority).where("__priority IS NOT NULL")
    best = rows.groupBy("gene").agg(F.min("__priority").alias("__best"), F.count(F.when(F.col("__priority") == 0, 1)).alias("__n"))
    chosen = rows.join(best, "gene").where("__priority = __best")
    if one2one_only:
        chosen = chosen.where("__n = 1")
    rank = F.row_number().over(Window.partitionBy("gene").orderBy("chain_id"))
    return chosen.withColumn("rank", rank).withColumn("kept", F.col("rank") <= limit).select("gene", "chain_id", "chain_class", F.col("rank").cast("long").alias("rank"), "kept")


def projection_fate(loci: DataFrame) -> DataFrame:
    """What becomes of a projected locus: kept, dropped as too long, or missing / lost as too short.

    ``loci``: chain_class, t_len, q_len, cds_len, has_gap.
    """
    off = F.abs(F.col("q_len") - F.col("t_len"))
    long = (F.col("chain_class") == "SPAN") & ((F.try_divide(off, F.col("t_len")) > 50) | (off > 1_000_000))
    short = F.col("q_len") < 0.05 * F.col("cds_len")
    return loci.withColumn("fate", F.when(long, "too long").when(short & F.col("has_gap"), "M").when(short, "L").otherwise("project"))


def training_set(features: DataFrame, one2one: DataFrame, transcript_sizes: DataFrame) -> DataFrame:
    """Labelled rows for the classifier: each gene's longest transcript, if its gene is one2one.

    Of those on at most 10 chains and with more than a tenth of exons covered, a
    gene's only chain is a positive; of several the one with the lowest id is left
    out and the others are negatives.
    """
    order = Window.partitionBy("gene").orderBy(F.col("size").desc(), "transcript")
    longest = transcript_sizes.withColumn("__n", F.row_number().over(order)).where("__n = 1").select("gene", "transcript")
    kept = longest.join(one2one, "gene", "left_semi")
    rows = features.join(kept, "transcript").where((F.col("gene_overs") <= 10) & (F.col("exon_perc") > 0.1))
    each = Window.partitionBy("transcript")
    counted = rows.withColumn("__n", F.count(F.lit(1)).over(each)).withColumn("__first", F.min("chain_id").over(each))
    return counted.where("__n = 1 OR chain_id <> __first").withColumn("y", (F.col("__n") == 1).cast("int")).drop("__n", "__first")


def train_classifier(rows: DataFrame, features: Sequence[str], label: str = "y", trees: int = 50, depth: int = 3, rate: float = 0.1, seed: int = 777):
    """Gradient-boosted trees over the feature columns; returns a fitted pipeline."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    gather = VectorAssembler(inputCols=list(features), outputCol="__features", handleInvalid="skip")
    model = GBTClassifier(featuresCol="__features", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, predictionCol="__label")
    return Pipeline(stages=[gather, model]).fit(rows)


def predict(model, rows: DataFrame, into: str = "score") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(rows)
    return scored.select(*rows.columns, F.get(vector_to_array("probability"), F.lit(1)).alias(into))
