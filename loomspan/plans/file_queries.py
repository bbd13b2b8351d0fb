"""Queries on files: tables written as text in the shared folder and read back, or looked up."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.functions import sequences
from loomspan.operators import orthology
from loomspan.operators.chains import decode_blocks
from loomspan.operators.runs import prefix_sums
from loomspan.plans import views
from loomspan.plans.views import with_views
from loomspan.session import scratch
from loomspan.sources import formats, readers, writers


def _place(spark: SparkSession, name: str) -> str:
    return f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.bed_like(spark, sf_dir)
    return rows.select(F.concat(F.lit("chr"), F.col("id") % 9).alias("chrom"), "start", "end", F.concat(F.lit("t"), "id").alias("name"), F.lit(0).alias("score"), "strand", "thick_start", "thick_end", F.lit("0,0,0").alias("item_rgb"), "blocks")


def _bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _place(spark, "bed")
    writers.write_bed12(_genes(spark, sf_dir), path)
    return readers.read_bed12(spark, path)


def bed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene models as text and back."""
    return _bed(spark, sf_dir).select("chrom", "start", "end", "name", "strand", "thick_start", "thick_end", F.size("blocks").cast("long").alias("n_blocks"), F.aggregate("blocks", F.lit(0).cast("long"), lambda n, b: n + b["e"] - b["s"]).alias("bases"))


def bed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and chromosomes of a file of gene models."""
    return _bed(spark, sf_dir).groupBy("chrom").agg(F.count_distinct("name").alias("n_names"))


def bed_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gene models by name, from a folder that is ordered by it."""
    path = _place(spark, "bed-index")
    writers.write_index(_genes(spark, sf_dir), path, "name", 8)
    return writers.lookup(spark, path, "name", ["t1", "t2", "t7", "t32", "none"]).select("name", "chrom", "start", "end")


def coding_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formats.gene_loci(_bed(spark, sf_dir)).select("transcript", F.col("exon").cast("long").alias("exon"), "s", "e")


def _chain_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    raw = views.chain_blocks_raw(spark, sf_dir)
    heads = raw.groupBy("chain_id").agg(F.sum("size").alias("score")).select(
        "score", F.concat(F.lit("chr"), F.col("chain_id") % 9).alias("t_name"), F.lit(10**9).alias("t_size"), F.lit("+").alias("t_strand"), (F.col("chain_id") * 10).alias("t_start"), (F.col("chain_id") * 10 + 900).alias("t_end"),
        F.lit("q").alias("q_name"), F.lit(10**9).alias("q_size"), F.when(F.col("chain_id") % 2 == 0, "+").otherwise("-").alias("q_strand"), (F.col("chain_id") * 7).alias("q_start"), (F.col("chain_id") * 7 + 900).alias("q_end"), "chain_id",
    )
    return heads, raw


def _chains(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    path = _place(spark, "chains")
    formats.write_chains(*_chain_tables(spark, sf_dir), path)
    return readers.read_chains(spark, path)


def chain_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains as text and back: blocks in absolute coordinates."""
    return decode_blocks(*_chains(spark, sf_dir))


def chain_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, _ = _chains(spark, sf_dir)
    return heads.select("chain_id", "score", "t_name", "q_strand", "t_start", "q_end")


def chain_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads, _ = _chains(spark, sf_dir)
    return formats.chain_span(heads)


def chain_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole chains by id, from a folder that is ordered by it, as their text."""
    path = _place(spark, "chain-index")
    writers.write_index(formats.chain_text(*_chain_tables(spark, sf_dir)), path, "chain_id", 8)
    found = writers.lookup(spark, path, "chain_id", [1, 2, 7, 32, -5])
    return found.select("chain_id", F.size(F.split(F.rtrim(F.regexp_replace("value", r"\n$", "")), "\n")).cast("long").alias("n_lines"), F.substring_index("value", " ", 1).alias("first_word"))


def isoforms_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isoforms as text, of the transcripts that are used."""
    parts = views.read(spark, sf_dir, "part")
    path = _place(spark, "isoforms")
    writers.write_table(parts.select(F.concat(F.lit("g"), F.col("p_partkey") % 90).alias("gene"), F.concat(F.lit("t"), "p_partkey").alias("transcript")), path)
    used = parts.where("p_size % 3 > 0").select(F.concat(F.lit("t"), "p_partkey").alias("transcript"))
    return readers.read_isoforms(spark, path, used)


def minor_introns_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    path = _place(spark, "introns")
    side = F.when(F.col("l_quantity") % 3 == 0, "A").when(F.col("l_quantity") % 3 == 1, "D").otherwise("X")
    writers.write_table(l.select(F.concat(F.lit("t"), "l_orderkey").alias("a"), (F.col("l_linenumber") - 2).alias("b"), side.alias("c")), path, header=False)
    return readers.read_minor_introns(spark, path).groupBy("transcript", "side").agg(F.count(F.lit(1)).alias("n"), F.min("exon").cast("long").alias("first"))


def regions_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = views.iv_a(spark, sf_dir)
    text = F.when(F.col("id") % 7 == 0, "unknown").otherwise(F.concat(F.lit("chr"), "k", F.lit(":"), "s", F.lit("-"), "e"))
    return readers.read_regions(c.select("id", text.alias("region"))).select("id", "chrom", "s", "e")


def fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole sequences as FASTA and back."""
    path = _place(spark, "fasta")
    writers.write_fasta(views.dna(spark, sf_dir).select(F.col("doc_id").cast("string").alias("header"), "seq"), path)
    return readers.read_fasta(spark, path)


def paired_fasta_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and query sequences of projections from one FASTA table, and which projections it names."""
    path = _place(spark, "pairs")
    role = F.when(F.col("doc_id") % 2 == 0, "REFERENCE").otherwise("QUERY")
    header = F.concat(F.lit("p"), F.expr("doc_id div 2"), F.lit(" | CODON | "), role)
    writers.write_fasta(views.dna(spark, sf_dir).where("seq <> ''").select(header.alias("header"), "seq"), path)
    entries = readers.read_fasta(spark, path)
    named = formats.headers_of(entries).withColumn("has_query", F.lit(True))
    return readers.paired_fasta(entries).join(named, "projection", "left").select("projection", F.length("ref").cast("long").alias("n_ref"), F.length("query").cast("long").alias("n_query"), F.coalesce("has_query", F.lit(False)).alias("has_query"))


def _report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    q = F.col("l_quantity").cast("long")
    kind = F.element_at(F.array(*map(F.lit, ["STOP", "FS_DEL", "Deleted exon", "Missing exon", "COMPENSATION"])), (q % 5 + 1).cast("int"))
    mut = F.when(q % 5 == 4, F.concat(F.lit("FS_"), F.col("l_partkey") % 4 + 1, F.lit("-"), F.col("l_partkey") % 4 + 1 + F.col("l_suppkey") % 4)).otherwise("-1")
    rows = l.select(F.concat(F.lit("t"), "l_orderkey").alias("gene"), (F.col("l_suppkey") % 7).alias("chain"), F.col("l_linenumber").alias("exon"), (F.col("l_partkey") % 90 + 1).alias("position"), kind.alias("mclass"), mut.alias("mut"), (q % 2 == 0).alias("masked"), F.concat(F.lit("m"), "l_linenumber").alias("mut_id"))
    orders = views.read(spark, sf_dir, "orders")
    flag = lambda n: F.when(F.col("o_custkey") % n == 0, "TRUE").otherwise("FALSE")
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in (
        ("INTACT_PERC_IGNORE_M", (F.col("o_custkey") % 100 / 100).cast("string")), ("INTACT_CODONS_PROP", (F.col("o_custkey") % 50 / 100).cast("string")), ("MIDDLE_IS_INTACT", flag(2)), ("MIDDLE_80%_PRESENT", flag(3)))])
    features = orders.select(F.concat(F.lit("t"), "o_orderkey").alias("gene"), F.lit("1").alias("chain"), F.explode(pairs).alias("x")).select("gene", "chain", "x.key", "x.value")
    path = _place(spark, "report")
    formats.mutation_lines(rows, features).write.text(path)
    return readers.read_mutations(spark, path)


def mutation_report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _report(spark, sf_dir)
    return found.groupBy("gene", "chain", "mclass").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("masked"), 1)).alias("n_masked"), F.max("position").cast("long").alias("last"))


def mutation_features_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, features = _report(spark, sf_dir)
    return formats.feature_table_of(features).select("projection", "ignore_m", "codons", "middle_intact", "middle_present")


def lost_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _report(spark, sf_dir)
    counts = formats.lost_exons(found).groupBy("projection").agg(F.count(F.lit(1)).alias("n_lost"))
    return formats.last_exon(found).join(counts, "projection", "left").select("projection", F.col("exons").cast("long").alias("exons"), F.coalesce("n_lost", F.lit(0)).alias("n_lost"))


def placed_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mutations by their base within the exon; exons of an order's lines."""
    found, _ = _report(spark, sf_dir)
    sizes = views.chain_blocks_raw(spark, sf_dir).select(F.concat(F.lit("t"), "chain_id").alias("gene"), F.col("block_no").alias("exon"), "size")
    starts = prefix_sums(sizes, ["gene"], ["exon"], "size")
    return formats.placed_mutations(found, starts, ("STOP", "FS_DEL")).groupBy("gene", "exon", "mclass").agg(F.sum("at").alias("places"), F.count(F.lit(1)).alias("n")).withColumn("exon", F.col("exon").cast("long"))


def compensation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = _report(spark, sf_dir)
    return formats.compensation_pairs(found).groupBy("gene", "chain", "a", "b").agg(F.count(F.lit(1)).alias("n"))


def alignments_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of aligned sequences as records of four lines, and back."""
    from loomspan.plans.relation_queries import _aligned

    path = _place(spark, "alignments")
    rows = _aligned(spark, sf_dir).select(F.concat(F.lit(">reference\n"), "ref", F.lit("\n>p."), "doc_id", F.lit("\n"), "query").alias("value"))
    rows.write.text(path)
    return readers.read_alignments(spark, path).select("projection", F.length("ref").cast("long").alias("n"), F.length(F.regexp_replace("query", "[^-]", "")).cast("long").alias("n_gaps"))


def matrix_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A substitution matrix over twenty letters at most, written as text and read back."""
    letters = views.read(spark, sf_dir, "nation").agg(F.array_sort(F.collect_set(F.char(F.col("n_nationkey") % 20 + 65))).alias("all"))
    score = lambda x: (F.pmod(F.ascii("letter") * F.ascii(x), F.lit(9)) - 4).cast("string")
    lines = letters.select("all", F.explode("all").alias("letter")).select(F.concat_ws(" ", F.col("letter"), F.transform("all", score)).alias("value"))
    path = _place(spark, "matrix")
    letters.select(F.concat(F.lit("  "), F.array_join("all", " ")).alias("value")).unionByName(lines).write.text(path)
    return readers.read_matrix(spark, path).select("ref", "que", F.col("score").cast("long").alias("score"))


def chain_feature_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of chains and of their genes as lines, and back."""
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    pairs = l.groupBy(F.col("l_suppkey").alias("chain_id"), F.concat(F.lit("P"), F.col("l_partkey") % 400).alias("gene")).agg(F.sum(F.col("l_quantity").cast("long") % 3).alias("coverage"), F.max("l_linenumber").cast("long").alias("introns"))
    pairs = pairs.select("chain_id", "gene", (F.col("coverage") / 4).alias("local_exo"), "coverage", "introns", (F.col("introns") / 8).alias("flank"))
    chains = views.read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("chain_id"), F.lit(2).alias("synteny"), F.round("s_acctbal").cast("long").alias("score"), F.lit(0.25).alias("global_exo"), F.lit(0.5).alias("exlen_to_qlen"), (F.col("s_suppkey") * 100).alias("chain_len"))
    path = _place(spark, "features")
    formats.chain_feature_lines(chains, pairs).select("value").write.text(path)
    per_chain, per_pair, overlaps = formats.read_chain_features(spark, path)
    covered = overlaps.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_covered"))
    sums = per_pair.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_genes"), F.sum("coverage").alias("coverage"), F.sum("local_exo").alias("local_exo"), F.sum("flank").alias("flank"))
    return per_chain.select("chain_id", "synteny", "score", "chain_len").join(sums, "chain_id").join(covered, "chain_id", "left").withColumn("n_covered", F.coalesce("n_covered", F.lit(0)))


def scores_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orthology scores as text; scores of projections, and those high enough for stitching."""
    from loomspan.plans.relation_queries import _chain_table
    from loomspan.operators import classify

    path = _place(spark, "scores")
    rows = classify.classify_chains(_chain_table(spark, sf_dir)).select(F.col("gene").cast("string").alias("gene"), F.col("chain_id").cast("string").alias("chain"), F.round("pred", 4).alias("pred"))
    formats.write_kind(rows, "orthology_scores", path)
    scores = formats.read_kind(spark, "orthology_scores", path)
    kept = formats.fragment_scores(scores).select(F.concat_ws(".", "transcript", F.col("chain_id").cast("string")).alias("projection"), F.lit(True).alias("for_stitching"))
    return formats.projection_scores(scores).join(kept, "projection", "left").withColumn("for_stitching", F.coalesce("for_stitching", F.lit(False)))


def losses_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all levels as text and back: those of projections."""
    from loomspan.plans.relation_queries import loss_rollup

    path = _place(spark, "losses")
    formats.write_kind(loss_rollup(spark, sf_dir), "losses", path)
    return formats.projection_losses(formats.read_kind(spark, "losses", path))


def gene_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of genes from files of isoforms, query isoforms and scores."""
    parts = views.read(spark, sf_dir, "part")
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    projection = F.concat_ws(".", F.concat(F.lit("t"), "l_partkey"), F.col("l_suppkey").cast("string"))
    paths = [_place(spark, n) for n in ("iso", "qiso", "sco")]
    writers.write_table(parts.select(F.concat(F.lit("g"), F.col("p_partkey") % 300).alias("gene"), F.concat(F.lit("t"), "p_partkey").alias("transcript")), paths[0], header=False)
    formats.write_kind(l.select(F.concat(F.lit("reg"), F.col("l_suppkey") % 40).alias("region_id"), projection.alias("projection_id")).distinct(), "query_isoforms", paths[1])
    scored = l.groupBy(F.concat(F.lit("t"), "l_partkey").alias("gene"), F.col("l_suppkey").cast("string").alias("chain")).agg((F.max(F.col("l_quantity").cast("long")) / 50).alias("pred"))
    formats.write_kind(scored.where("pred > 0.3"), "orthology_scores", paths[2])
    q_isoforms = formats.read_kind(spark, "query_isoforms", paths[1]).select(F.col("region_id").alias("q_gene"), F.col("projection_id").alias("projection"))
    transcript, _ = sequences.projection_parts(F.col("projection"))
    projections = q_isoforms.select("projection").distinct().withColumn("transcript", transcript)
    return orthology.connect_genes(readers.read_isoforms(spark, paths[0]).withColumnRenamed("gene", "r_gene"), projections, q_isoforms, formats.projection_scores(formats.read_kind(spark, "orthology_scores", paths[2])))


def predefined_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes fixed beforehand, and transcripts left out by two steps, from files."""
    orders = views.read(spark, sf_dir, "orders")
    name = F.concat(F.lit("t"), F.col("o_custkey"))
    path, out = _place(spark, "predefined"), _place(spark, "excluded")
    level, kind = F.when(F.col("o_orderkey") % 2 == 0, "TRANSCRIPT").otherwise("PROJECTION"), F.when(F.col("o_orderkey") % 3 == 0, "L").otherwise("I")
    formats.write_kind(orders.where("o_orderkey % 5 = 0").select(name.alias("id"), level.alias("level"), kind.alias("class")), "predefined", path)
    formats.write_kind(orders.where("o_custkey % 4 = 0").select(name.alias("name")).distinct(), "names", out)
    excluded = formats.read_kind(spark, "names", out)
    return formats.predefined_classes(formats.read_kind(spark, "predefined", path), excluded, orders.where("o_custkey % 6 = 0").select(name.alias("name")))


def fragments_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    path = _place(spark, "fragments")
    listed = l.groupBy(F.concat(F.lit("t"), "l_orderkey").alias("transcript")).agg(F.array_join(F.array_sort(F.collect_set(F.lpad(F.col("l_suppkey").cast("string"), 6, "0"))), ",").alias("chains"))
    formats.write_kind(listed.withColumn("chains", F.concat("chains", F.lit(","))), "fragments", path)
    return formats.fragment_chains(formats.read_kind(spark, "fragments", path)).select("transcript", F.col("n").cast("long").alias("n"), F.col("chain_id").cast("long").alias("chain_id"))


def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains and their genes dealt into files of jobs: all are there once, and the jobs are of like size."""
    l = views.read(spark, sf_dir, "lineitem")  # noqa: E741
    path = _place(spark, "jobs")
    formats.write_jobs(formats.job_lines(l.select(F.col("l_orderkey").alias("chain_id"), F.concat(F.lit("g"), "l_partkey").alias("gene")), 8), path)
    found = formats.read_jobs(spark, path)
    return found.groupBy("chain_id").agg(F.count(F.lit(1)).alias("n_genes"), F.count_distinct("job").alias("n_jobs"))


def small_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of chromosomes, links and directories from files."""
    n, c = views.read(spark, sf_dir, "nation"), views.read(spark, sf_dir, "customer")
    paths = [_place(spark, k) for k in ("sizes", "links", "dirs")]
    formats.write_kind(n.select(F.col("n_name").alias("chrom"), (F.col("n_nationkey").cast("long") * 1000 + 5).alias("size")), "chrom_sizes", paths[0])
    formats.write_kind(c.select(F.concat(F.lit("t"), "c_custkey").alias("transcript"), F.concat(F.lit("<a href=x>"), "c_nationkey", F.lit("</a>")).alias("link")), "links", paths[1])
    formats.write_kind(n.select(F.col("n_name").alias("species"), F.concat(F.lit("/data/"), F.lower("n_name")).alias("directory")), "directories", paths[2])
    rows = formats.read_kind(spark, "chrom_sizes", paths[0]).select(F.lit("size").alias("kind"), F.col("chrom").alias("name"), F.col("size").cast("string").alias("value"))
    rows = rows.unionByName(formats.read_kind(spark, "links", paths[1]).select(F.lit("link").alias("kind"), F.col("transcript").alias("name"), F.col("link").alias("value")))
    return rows.unionByName(formats.read_kind(spark, "directories", paths[2]).select(F.lit("directory").alias("kind"), F.col("species").alias("name"), F.col("directory").alias("value")))


def codon_exons(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = views.chain_blocks_raw(spark, sf_dir).select(F.col("chain_id").alias("gene"), F.col("block_no").alias("exon"), "size")
    return formats.codon_exons(prefix_sums(sizes, ["gene"], ["exon"], "size")).groupBy("gene", "exon").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("split"), 1)).alias("n_split"), F.min("codon").cast("long").alias("first"))


def codon_proteins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codons parted by blanks, cleaned of marks, and their protein."""
    parted = F.array_join(sequences.codons(F.regexp_replace("seq", "GT", "!X")), " ")
    rows = views.dna(spark, sf_dir).select("doc_id", formats.clean_codons(parted).alias("codons"))
    return rows.select("doc_id", F.md5("codons").alias("codons"), F.md5(formats.protein_of(F.col("codons"), sequences.CODONS)).alias("protein"))


QUERIES = {
    f.__name__: f
    for f in (
        bed_file, bed_names, bed_lookup, coding_loci, chain_file, chain_headers, chain_spans, chain_lookup, isoforms_file, minor_introns_file, regions_text, fasta_file, paired_fasta_file, mutation_report_file,
        mutation_features_file, lost_exons, placed_mutations, compensation_pairs, alignments_file, matrix_file, chain_feature_file, scores_file, losses_file, gene_edges, predefined_file, fragments_file, job_files,
        small_tables, codon_exons, codon_proteins,
    )
}

_BL = """bl AS (SELECT chain_id, 't'||chain_id AS name, 'chr'||(chain_id%9) chrom, min(t_start) "start", max(t_end) "end", min(t_start)+15 a, greatest(max(t_end)-20, min(t_start)+15) z, CASE WHEN chain_id%2=0 THEN '+' ELSE '-' END strand,
    count(*) n_blocks, sum(t_end-t_start)::BIGINT bases FROM chain_blocks GROUP BY chain_id)"""
_RP = """rp AS (SELECT 't'||l_orderkey gene, (l_suppkey%7)::VARCHAR "chain", l_linenumber exon, l_partkey%90+1 AS position, ['STOP','FS_DEL','Deleted exon','Missing exon','COMPENSATION'][l_quantity::BIGINT%5+1] mclass, l_quantity::BIGINT%2=0 masked,
    l_partkey%4+1 f, l_partkey%4+1+l_suppkey%4 l FROM lineitem)"""


def _sql() -> dict[str, str]:
    from loomspan.plans import relation_queries as relations

    code = relations._translated()
    return {
        "bed_file": with_views("chain_blocks_raw chain_blocks", f', {_BL} SELECT chrom, "start", "end", name, strand, a thick_start, z thick_end, n_blocks, bases FROM bl'),
        "bed_names": with_views("chain_blocks_raw chain_blocks", f", {_BL} SELECT chrom, count(DISTINCT name) n_names FROM bl GROUP BY 1"),
        "bed_lookup": with_views("chain_blocks_raw chain_blocks", f""", {_BL} SELECT name, chrom, "start", "end" FROM bl WHERE name IN ('t1','t2','t7','t32')"""),
        "coding_loci": with_views("chain_blocks_raw chain_blocks", f", {_BL}, c AS (SELECT name, greatest(t_start,a) s, least(t_end,z) e FROM bl JOIN chain_blocks USING (chain_id) WHERE t_end>a AND t_start<z) SELECT name transcript, row_number() OVER (PARTITION BY name ORDER BY s, e)-1 exon, s, e FROM c"),
        "chain_file": with_views("chain_blocks_raw chain_blocks", "SELECT * FROM chain_blocks"),
        "chain_headers": "SELECT l_orderkey chain_id, sum(l_quantity::BIGINT)::BIGINT score, 'chr'||(l_orderkey%9) t_name, CASE WHEN l_orderkey%2=0 THEN '+' ELSE '-' END q_strand, l_orderkey*10 t_start, l_orderkey*7+900 q_end FROM lineitem GROUP BY l_orderkey",
        "chain_spans": "SELECT DISTINCT l_orderkey chain_id, 'chr'||(l_orderkey%9) chrom, l_orderkey*10 s, l_orderkey*10+900 e FROM lineitem",
        "chain_lookup": "SELECT l_orderkey chain_id, count(*)+1 n_lines, 'chain' first_word FROM lineitem WHERE l_orderkey IN (1,2,7,32) GROUP BY 1",
        "isoforms_file": "SELECT 'g'||(p_partkey%90) gene, 't'||p_partkey transcript FROM part WHERE p_size%3>0",
        "minor_introns_file": "SELECT 't'||l_orderkey transcript, CASE WHEN l_quantity::BIGINT%3=0 THEN 'A' ELSE 'D' END side, count(*) n, min(l_linenumber-2)::BIGINT AS \"first\" FROM lineitem WHERE l_quantity::BIGINT%3<2 AND l_linenumber>=3 GROUP BY 1,2",
        "regions_text": with_views("iv_a", "SELECT id, CASE WHEN id%7=0 THEN 'N' ELSE 'chr'||k END chrom, CASE WHEN id%7=0 THEN 1 ELSE s END s, CASE WHEN id%7=0 THEN 1 ELSE e END e FROM iv_a"),
        "fasta_file": with_views("dna", "SELECT doc_id::VARCHAR header, seq FROM dna WHERE seq<>''"),
        "paired_fasta_file": with_views("dna", "SELECT 'p'||(doc_id//2) projection, max(CASE WHEN doc_id%2=0 THEN length(seq) END) n_ref, max(CASE WHEN doc_id%2=1 THEN length(seq) END) n_query, bool_or(doc_id%2=1) has_query FROM dna WHERE seq<>'' GROUP BY 1"),
        "mutation_report_file": f'WITH {_RP} SELECT gene, "chain", mclass, count(*) n, count(*) FILTER (WHERE masked) n_masked, max(position) AS "last" FROM rp GROUP BY 1,2,3',
        "mutation_features_file": "SELECT 't'||o_orderkey||'.1' projection, (o_custkey%100/100)::DOUBLE ignore_m, (o_custkey%50/100)::DOUBLE codons, o_custkey%2=0 middle_intact, o_custkey%3=0 middle_present FROM orders",
        "lost_exons": f"""WITH {_RP} SELECT gene||'.'||"chain" projection, max(exon)::BIGINT exons, count(*) FILTER (WHERE mclass IN ('Deleted exon','Missing exon')) n_lost FROM rp GROUP BY 1""",
        "placed_mutations": with_views("chain_blocks_raw", f""", {_RP}, st AS (SELECT 't'||chain_id gene, block_no exon, coalesce(sum(size) OVER (PARTITION BY chain_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) b, count(*) OVER (PARTITION BY chain_id) n FROM chain_blocks_raw),
            nn AS (SELECT gene, max(n) n FROM st GROUP BY 1)
            SELECT gene, exon::BIGINT exon, mclass, sum(CASE WHEN mclass IN ('STOP','FS_DEL') THEN CASE WHEN nn.n=1 THEN position*3-2 ELSE greatest(position*3-2-coalesce(b,0),0) END ELSE position END)::BIGINT places, count(*) n
            FROM rp LEFT JOIN st USING (gene, exon) LEFT JOIN nn USING (gene) GROUP BY 1,2,3"""),
        "compensation_pairs": f"""WITH {_RP}, p AS (SELECT gene, "chain", unnest(range(f, l)) a FROM rp WHERE mclass='COMPENSATION') SELECT gene, "chain", a, a+1 b, count(*) n FROM p GROUP BY 1,2,3""",
        "alignments_file": with_views("dna", f", {relations._ALIGNED} SELECT 'p.'||doc_id projection, length(ref) n, length(regexp_replace(que,'[^-]','','g')) n_gaps FROM al"),
        "matrix_file": "WITH x AS (SELECT DISTINCT chr((65+n_nationkey%20)::INT) c FROM nation) SELECT a.c AS ref, b.c que, (ascii(a.c)*ascii(b.c)%9-4)::BIGINT score FROM x a, x b",
        "chain_feature_file": """WITH p AS (SELECT l_suppkey chain_id, l_partkey%400 g, sum(l_quantity::BIGINT%3)::BIGINT c, max(l_linenumber) i FROM lineitem GROUP BY 1,2)
            SELECT s_suppkey chain_id, 2::BIGINT synteny, round(s_acctbal)::BIGINT score, s_suppkey*100 chain_len, count(*) n_genes, sum(c)::BIGINT coverage, sum(c/4)::DOUBLE local_exo, sum(i/8)::DOUBLE flank, count(*) FILTER (WHERE c>0) n_covered FROM p JOIN supplier ON s_suppkey=chain_id GROUP BY 1,3,4""",
        "scores_file": f"WITH {relations._TABLE}, r AS (SELECT gene||'.'||chain_id projection, round(pred,4) pred FROM d) SELECT projection, CASE WHEN pred=-1 THEN 0.5 ELSE pred END::DOUBLE score, pred>=0.5 for_stitching FROM r",
        "losses_file": f"WITH {relations._LOSS} SELECT 'p'||projection projection, loss AS \"class\" FROM losses",
        "gene_edges": """WITH s AS (SELECT l_partkey t, l_suppkey c, max(l_quantity::BIGINT)/50 p FROM lineitem GROUP BY 1,2) SELECT 'g'||(p_partkey%300) r_gene, 'reg'||(c%40) q_gene, max(CASE WHEN p>0.3 THEN p ELSE 0 END)::DOUBLE score
            FROM s JOIN part ON p_partkey=t GROUP BY 1,2""",
        "predefined_file": """WITH g AS (SELECT CASE WHEN o_orderkey%2=0 THEN 'TRANSCRIPT' ELSE 'PROJECTION' END "level", 't'||o_custkey id, CASE WHEN o_orderkey%3=0 THEN 'L' ELSE 'I' END c, 0 p FROM orders WHERE o_orderkey%5=0
            UNION ALL SELECT 'TRANSCRIPT', 't'||o_custkey, 'M', 1 FROM orders WHERE o_custkey%4=0 OR o_custkey%6=0) SELECT "level", id, arg_min(c, (p, c)) AS "class" FROM g GROUP BY 1,2""",
        "fragments_file": "SELECT 't'||l_orderkey transcript, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey)-1 n, l_suppkey chain_id FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)",
        "job_files": "SELECT l_orderkey chain_id, count(DISTINCT l_partkey) n_genes, 1::BIGINT n_jobs FROM lineitem GROUP BY 1",
        "small_tables": "SELECT 'size' kind, n_name AS name, (n_nationkey*1000+5)::VARCHAR AS value FROM nation UNION ALL SELECT 'link', 't'||c_custkey, '<a href=x>'||c_nationkey||'</a>' FROM customer UNION ALL SELECT 'directory', n_name, '/data/'||lower(n_name) FROM nation",
        "codon_exons": with_views("chain_blocks_raw", """, st AS (SELECT chain_id gene, block_no exon, size, coalesce(sum(size) OVER (PARTITION BY chain_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0)::BIGINT b FROM chain_blocks_raw),
            c AS (SELECT gene, exon, b, size, unnest(range((b+2)//3, (b+size+2)//3)) k FROM st) SELECT gene, exon, count(*) n, count(*) FILTER (WHERE k*3+3>b+size) n_split, min(k) AS "first" FROM c GROUP BY 1,2"""),
        "codon_proteins": with_views("dna", f""", x AS (SELECT doc_id, replace(replace(upper(replace(seq,'GT','!X')),'!','-'),'X','N') s FROM dna), l AS (SELECT doc_id, regexp_extract_all(s, '.{{1,3}}') cs FROM x),
            u AS (SELECT doc_id, unnest(range(0,len(cs))) i, unnest(cs) c FROM l), p AS (SELECT doc_id, string_agg(c, ' ' ORDER BY i) a, string_agg({code}, '' ORDER BY i) b FROM u GROUP BY 1)
            SELECT dna.doc_id, md5(coalesce(a,'')) codons, md5(coalesce(b,'')) protein FROM dna LEFT JOIN p USING (doc_id)"""),
    }


SQL = _sql()
