"""Tables of an annotation run as tab-parted text: typed readers and writers of each kind, and lines of several kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions.tracks import coding_blocks
from loomspan.sources.readers import parse_pairs

# The columns of each kind of file, in their order; whether a heading line comes first.
KINDS = {
    "orthology_scores": ("gene string, chain string, pred double", True),
    "losses": ("level string, id string, class string", False),
    "orthology": ("t_gene string, t_transcript string, q_gene string, q_transcript string, orthology_class string", True),
    "query_isoforms": ("region_id string, projection_id string", True),
    "confidence": ("projection_id string, confidence_level string", True),
    "predefined": ("id string, level string, class string", False),
    "fragments": ("transcript string, chains string", False),
    "rejected": ("id string, reason string", False),
    "names": ("name string", False),
    "loci": ("transcript string, chain string, region string", False),
    "chrom_sizes": ("chrom string, size bigint", False),
    "links": ("transcript string, link string", False),
    "directories": ("species string, directory string", False),
    "features": (
        "gene string, gene_overs bigint, chain bigint, synt bigint, gl_score bigint, gl_exo double, chain_len bigint, exon_qlen double, loc_exo double, exon_cover bigint, intr_cover bigint, gene_len bigint, ex_num bigint, "
        "ex_fract bigint, intr_fract bigint, flank_cov double",
        True,
    ),
}


def read_kind(spark: SparkSession, kind: str, path: str) -> DataFrame:
    """One of KINDS, typed; blank lines go, a line of another shape fails the job."""
    schema, header = KINDS[kind]
    return spark.read.csv(path, sep="\t", schema=schema, header=header, mode="FAILFAST", enforceSchema=True)


def write_kind(df: DataFrame, kind: str, path: str) -> None:
    """The columns of the kind, in their order, from a table that has them."""
    schema, header = KINDS[kind]
    names = [c.split()[0] for c in schema.split(", ")]
    df.select(*names).write.csv(path, sep="\t", header=header, mode="overwrite", emptyValue="", nullValue="None")


def projection_scores(scores: DataFrame) -> DataFrame:
    """(projection, score) of ``orthology_scores``; a spanning chain, which has no score, counts half."""
    return scores.select(F.concat_ws(".", "gene", "chain").alias("projection"), F.when(F.col("pred") == -1, 0.5).otherwise(F.col("pred")).alias("score"))


def fragment_scores(scores: DataFrame, least: float = 0.5) -> DataFrame:
    """(transcript, chain_id, score) of at least ``least``, for stitching."""
    return scores.where(F.col("pred") >= least).select(F.col("gene").alias("transcript"), F.col("chain").cast("long").alias("chain_id"), F.col("pred").alias("score"))


def projection_losses(losses: DataFrame) -> DataFrame:
    return losses.where("level = 'PROJECTION'").select(F.col("id").alias("projection"), "class")


def predefined_classes(given: DataFrame, *missing: DataFrame) -> DataFrame:
    """(level, id, class) that replace found classes: those of ``predefined``, and as missing the transcripts (``name``)
    of each further table that a step left out. What is given goes before what is missing."""
    rows = given.select("level", "id", "class", F.lit(0).alias("__p"))
    for names in missing:
        rows = rows.unionByName(names.select(F.lit("TRANSCRIPT").alias("level"), F.col("name").alias("id"), F.lit("M").alias("class"), F.lit(1).alias("__p")))
    return rows.groupBy("level", "id").agg(F.min_by("class", F.struct("__p", "class")).alias("class"))


def fragment_chains(fragments: DataFrame) -> DataFrame:
    """(transcript, n from 0, chain_id) of ``fragments``."""
    parts = F.filter(F.split("chains", ","), lambda x: x != "")
    return fragments.select("transcript", F.posexplode(parts).alias("n", "chain_id"))


def gene_loci(genes: DataFrame) -> DataFrame:
    """(transcript, exon from 0, s, e) of coding blocks, in the order of the chromosome."""
    blocks = coding_blocks(genes)
    return blocks.select(F.col("name").alias("transcript"), F.posexplode("cds").alias("exon", "b")).select("transcript", "exon", F.col("b.s").alias("s"), F.col("b.e").alias("e"))


# Lines of chain features: one of the chain, one of its genes.


def chain_feature_lines(chains: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chain_id, value): two lines for each chain.

    ``chains``: chain_id, synteny, score, global_exo, exlen_to_qlen, chain_len;
    ``pairs``: chain_id, gene, local_exo, coverage, introns, flank. Genes that a
    chain does not cover are named with ``None`` in its second line.
    """
    named = lambda c: F.concat(F.array_join(F.transform(F.col("genes"), lambda g: F.concat(g["gene"], F.lit("="), g[c].cast("string"))), ","), F.lit(","))
    genes = pairs.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("gene", "local_exo", "coverage", "introns", "flank"))).alias("genes"))
    rows = chains.join(genes, "chain_id")
    first = F.concat_ws("\t", F.lit("chain"), *[F.col(c).cast("string") for c in ("chain_id", "synteny", "score", "global_exo", "exlen_to_qlen")], named("local_exo"), named("coverage"), named("introns"), named("flank"), F.col("chain_len").cast("string"))
    owner = F.transform("genes", lambda g: F.concat(g["gene"], F.lit("="), F.when(g["coverage"] > 0, F.col("chain_id").cast("string")).otherwise("None")))
    return rows.select("chain_id", F.explode(F.array(first, F.concat(F.lit("genes\t"), F.array_join(owner, "\t")))).alias("value"))


def read_chain_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chains, pairs, overlaps) from such lines: a chain's features, its genes' features, and (gene, chain_id) of the genes it covers."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    rows = lines.where(at(0) == "chain").select(
        at(1).cast("long").alias("chain_id"), at(2).cast("long").alias("synteny"), at(3).cast("long").alias("score"), at(4).cast("double").alias("global_exo"), at(5).cast("double").alias("exlen_to_qlen"),
        *[parse_pairs(at(6 + i)).alias(n) for i, n in enumerate(("local_exo", "coverage", "introns", "flank"))], at(10).cast("long").alias("chain_len"),
    )
    value = lambda c: F.try_element_at(F.col(c), F.col("gene"))
    pairs = rows.withColumn("gene", F.explode(F.map_keys("coverage"))).select("chain_id", "gene", value("local_exo").alias("local_exo"), *[value(c).cast("long").alias(c) for c in ("coverage", "introns")], value("flank").alias("flank"))
    genes = lines.where(at(0) == "genes").select(F.explode(F.slice("f", 2, F.size("f"))).alias("x")).where("x <> ''")
    overlaps = genes.select(F.substring_index("x", "=", 1).alias("gene"), F.substring_index("x", "=", -1).alias("chain")).where("chain <> 'None'").select("gene", F.col("chain").cast("long").alias("chain_id"))
    return rows.drop("local_exo", "coverage", "introns", "flank"), pairs, overlaps


# Chains as text.


def chain_text(headers: DataFrame, raw: DataFrame) -> DataFrame:
    """(chain_id, value): each chain as its lines, as ``read_chains`` reads them. The last block has no gaps behind it."""
    size = F.size("blocks")
    line = F.transform("blocks", lambda b, i: F.when(i == size - 1, b["size"].cast("string")).otherwise(F.concat_ws("\t", b["size"].cast("string"), b["dt"].cast("string"), b["dq"].cast("string"))))
    blocks = raw.groupBy("chain_id").agg(F.array_sort(F.collect_list(F.struct("block_no", "size", "dt", "dq"))).alias("blocks"))
    names = ["score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id"]
    head = F.concat_ws(" ", F.lit("chain"), *[F.col(n).cast("string") for n in names])
    return headers.join(blocks, "chain_id").select("chain_id", F.concat(head, F.lit("\n"), F.array_join(line, "\n"), F.lit("\n")).alias("value"))


def write_chains(headers: DataFrame, raw: DataFrame, path: str) -> None:
    chain_text(headers, raw).select("value").write.mode("overwrite").text(path)


def chain_span(headers: DataFrame) -> DataFrame:
    """(chain_id, chrom, s, e) in the target."""
    return headers.select("chain_id", F.col("t_name").alias("chrom"), F.col("t_start").alias("s"), F.col("t_end").alias("e"))


# Mutation reports.


def mutation_lines(mutations: DataFrame, features: DataFrame) -> DataFrame:
    """(value): report lines, as ``read_mutations`` reads them, of mutations and of (gene, chain, key, value) features."""
    field = lambda c: F.col(c).cast("string")
    masked = F.when(F.col("masked"), "masked").otherwise("unmasked")
    first = mutations.select(F.concat(F.lit("# "), F.concat_ws("\t", *[field(c) for c in ("gene", "chain", "exon", "position", "mclass", "mut")], masked, F.col("mut_id"))).alias("value"))
    return first.unionByName(features.select(F.concat(F.lit("# "), F.concat_ws("\t", "gene", "chain", F.concat_ws(" ", "key", "value"))).alias("value")))


def feature_table_of(features: DataFrame) -> DataFrame:
    """A row for each projection with its features typed; the older names of two flags are known."""
    value = lambda *keys: F.max(F.when(F.col("key").isin(*keys), F.col("value")))
    share = lambda name: value(name).cast("double")
    return features.groupBy(F.concat_ws(".", "gene", "chain").alias("projection")).agg(
        share("INTACT_PERC_IGNORE_M").alias("ignore_m"), share("INTACT_PERC_INTACT_M").alias("intact_m"), share("INTACT_CODONS_PROP").alias("codons"), share("OUT_OF_CHAIN_PROP").alias("out_of_chain"),
        (value("MIDDLE_IS_INTACT", "MIDDLE_80%_INTACT") == "TRUE").alias("middle_intact"), (value("MIDDLE_IS_PRESENT", "MIDDLE_80%_PRESENT") == "TRUE").alias("middle_present"),
    )


def lost_exons(mutations: DataFrame) -> DataFrame:
    """(projection, exon, mclass) of exons that are deleted or missing as a whole."""
    return mutations.where(F.col("mclass").isin("Deleted exon", "Missing exon")).select(F.concat_ws(".", "gene", "chain").alias("projection"), "exon", "mclass")


def last_exon(mutations: DataFrame) -> DataFrame:
    """(projection, exons): the greatest exon number that a projection's mutations name."""
    return mutations.groupBy(F.concat_ws(".", "gene", "chain").alias("projection")).agg(F.max("exon").alias("exons"))


def placed_mutations(mutations: DataFrame, exon_starts: DataFrame, point: tuple[str, ...]) -> DataFrame:
    """Mutations with ``at``: of the classes ``point`` the base within its exon, from the codon's first base; else the position.

    ``exon_starts``: gene, exon (from 1), before (coding bases ahead of the
    exon). In a gene of one exon the base in the gene is the base in the exon.
    """
    several = exon_starts.groupBy("gene").agg(F.count(F.lit(1)).alias("__n"))
    joined = mutations.join(exon_starts.select("gene", "exon", "before"), ["gene", "exon"], "left").join(several, "gene", "left")
    base = F.col("position") * 3 - 2
    within = F.when(F.col("__n") == 1, base).otherwise(F.greatest(base - F.coalesce("before", F.lit(0)), F.lit(0)))
    return joined.withColumn("at", F.when(F.col("mclass").isin(*point), within).otherwise(F.col("position")).cast("long")).drop("before", "__n")


def compensation_pairs(mutations: DataFrame, mut: str = "mut", kind: str = "COMPENSATION") -> DataFrame:
    """(gene, chain, a, b): neighbouring frameshifts of each compensation, from ``FS_first-last`` or ``FS_a,b,c``."""
    numbers = F.transform(F.split(F.substring_index(mut, "_", -1), "[-,]"), lambda x: x.try_cast("long"))
    rows = mutations.where(F.col("mclass") == kind).select("gene", "chain", F.element_at(numbers, 1).alias("first"), F.element_at(numbers, -1).alias("last"))
    return rows.where("first < last").select("gene", "chain", F.explode(F.sequence(F.col("first"), F.col("last") - 1)).alias("a")).withColumn("b", F.col("a") + 1)


# Jobs.


def job_lines(pairs: DataFrame, jobs: int) -> DataFrame:
    """(job, chain_id, value): chains with the genes they meet (chain_id, gene) as command lines, dealt into jobs.

    Chains are dealt by a hash, so that long ones, whose ids are neighbours, do not meet in one job.
    """
    listed = pairs.groupBy("chain_id").agg(F.array_sort(F.collect_set("gene")).alias("genes"))
    return listed.select(F.pmod(F.xxhash64("chain_id"), F.lit(jobs)).cast("long").alias("job"), "chain_id", F.concat(F.col("chain_id").cast("string"), F.lit("\t"), F.array_join("genes", ","), F.lit(",")).alias("value"))


def write_jobs(lines: DataFrame, path: str) -> None:
    """A folder ``job=n`` of lines for each job."""
    lines.select("job", "value").repartition("job").write.partitionBy("job").mode("overwrite").text(path)


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """(job, chain_id, gene) of such folders."""
    fields = F.split("value", "\t")
    genes = F.filter(F.split(F.get(fields, F.lit(1)), ","), lambda g: g != "")
    return spark.read.text(path).select(F.col("job").cast("long").alias("job"), F.get(fields, F.lit(0)).cast("long").alias("chain_id"), F.explode(genes).alias("gene"))


# Sequences.


def headers_of(entries: DataFrame, kind: str = "QUERY") -> DataFrame:
    """(projection) that entries of a FASTA table (header ``projection | what | kind``) name."""
    parts = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    return entries.where(F.element_at(parts, -1) == kind).select(F.element_at(parts, 1).alias("projection")).distinct()


def clean_codons(seq: Column) -> Column:
    """An aligned codon sequence without frameshift marks, unknown codons as N."""
    return F.regexp_replace(F.regexp_replace(F.upper(seq), "!", "-"), "X", "N")


def protein_of(seq: Column, table: dict[str, str]) -> Column:
    """The protein of a sequence of codons parted by blanks; X for what the code lacks, - for a gap of three."""
    code = F.create_map(*[F.lit(x) for pair in [*table.items(), ("---", "-")] for x in pair])
    return F.array_join(F.transform(F.filter(F.split(seq, " "), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def codon_exons(sizes: DataFrame) -> DataFrame:
    """(gene, codon from 0, exon, split): the exon that a codon begins in, and whether the exon's end splits it.

    ``sizes``: gene, exon (from 1), before (coding bases ahead of it), size. A
    codon belongs to the exon that holds its first base.
    """
    first = F.ceil(F.col("before") / 3)
    last = F.ceil((F.col("before") + F.col("size")) / 3) - 1
    rows = sizes.where(first <= last).select("gene", "exon", "before", "size", F.explode(F.sequence(first, last)).alias("codon"))
    return rows.select("gene", "codon", "exon", (F.col("codon") * 3 + 3 > F.col("before") + F.col("size")).alias("split"))
