"""Typed tables from the text formats of comparative annotation. All read with Spark alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.operators.runs import running_totals

BED12 = "chrom string, start bigint, end bigint, name string, score int, strand string, thick_start bigint, thick_end bigint, item_rgb string, block_count int, block_sizes string, block_starts string"


def read_bed12(spark: SparkSession, path: str) -> DataFrame:
    """Gene models with ``blocks``, an array of (s, e) in absolute coordinates. Rows of another shape fail."""
    raw = spark.read.csv(path, sep="\t", schema=BED12, mode="FAILFAST", comment="#")
    numbers = lambda c: F.transform(F.filter(F.split(c, ","), lambda x: x != ""), lambda x: x.cast("long"))
    blocks = F.zip_with(numbers("block_starts"), numbers("block_sizes"), lambda s, n: F.struct((F.col("start") + s).alias("s"), (F.col("start") + s + n).alias("e")))
    return raw.withColumn("blocks", F.array_sort(blocks)).drop("block_sizes", "block_starts")


def read_chains(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, raw blocks) of an alignment chain file (plain or .gz).

    A record is what stands between two lines that begin with ``chain``;
    comments count for nothing.
    """
    text = spark.read.option("lineSep", "\nchain ").text(path).select(F.regexp_replace("value", r"^(?:#[^\n]*\n|\s)*(?:chain )?", "").alias("value")).where(F.trim("value") != "")
    lines = F.filter(F.split("value", r"\r?\n"), lambda x: (F.trim(x) != "") & ~F.startswith(x, F.lit("#")))
    rows = text.select(lines.alias("lines")).withColumn("head", F.split(F.get("lines", F.lit(0)), r"\s+")).where("size(head) > 11")
    names = ["score", "t_name", "t_size", "t_strand", "t_start", "t_end", "q_name", "q_size", "q_strand", "q_start", "q_end", "chain_id"]
    texts = {"t_name", "t_strand", "q_name", "q_strand"}
    headers = rows.select(*[F.get("head", F.lit(i)).cast("string" if n in texts else "long").alias(n) for i, n in enumerate(names)])
    blocks = rows.select(F.get("head", F.lit(11)).cast("long").alias("chain_id"), F.posexplode(F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))).alias("n", "line"))
    fields = F.split(F.trim("line"), r"\s+")
    sizes = blocks.select("chain_id", (F.col("n") + 1).cast("long").alias("block_no"), *[F.get(fields, F.lit(i)).cast("long").alias(c) for i, c in enumerate(["size", "dt", "dq"])])
    return headers, sizes


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(header, seq) of a FASTA file: lines joined; entries without sequence and lines with ``!`` go."""
    text = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    lines = F.split("value", r"\r?\n")
    kept = F.filter(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: ~F.contains(x, F.lit("!")))
    return text.select(F.trim(F.element_at(lines, 1)).alias("header"), F.regexp_replace(F.array_join(kept, ""), r"\s", "").alias("seq")).where("seq <> ''")


def paired_fasta(entries: DataFrame) -> DataFrame:
    """Reference and query sequence of each projection, from headers ``projection | kind | REFERENCE or QUERY``."""
    parts = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    rows = entries.select(F.element_at(parts, 1).alias("projection"), F.element_at(parts, 2).alias("kind"), F.element_at(parts, -1).alias("role"), "seq")
    role = lambda name: F.max(F.when(F.col("role") == name, F.col("seq")))
    return rows.groupBy("projection", "kind").agg(role("REFERENCE").alias("ref"), role("QUERY").alias("query"))


def read_isoforms(spark: SparkSession, path: str, transcripts: DataFrame | None = None) -> DataFrame:
    """(gene, transcript); with a list of transcripts only these, which also drops a header line."""
    rows = spark.read.csv(path, sep="\t", schema="gene string, transcript string")
    return rows if transcripts is None else rows.join(transcripts.select("transcript").distinct(), "transcript", "left_semi").select("gene", "transcript")


def read_minor_introns(spark: SparkSession, path: str, transcripts: DataFrame | None = None) -> DataFrame:
    """(transcript, exon, side) with exons from 1 and sides A or D; other rows are left out."""
    rows = spark.read.csv(path, sep="\t", schema="transcript string, exon string, side string")
    good = rows.select("transcript", F.try_to_number("exon", F.lit("999999")).cast("int").alias("exon"), "side").where("exon >= 1 AND side IN ('A', 'D')")
    return good if transcripts is None else good.join(transcripts.select("transcript").distinct(), "transcript", "left_semi")


def read_regions(df: DataFrame, column: str = "region") -> DataFrame:
    """Splits ``chrom:start-end`` texts; what has another shape becomes N:1-1."""
    shape = r"^(.+):(\d+)-(\d+)$"
    fits = F.col(column).rlike(shape)
    part = lambda i: F.regexp_extract(column, shape, i)
    return df.withColumns({"chrom": F.when(fits, part(1)).otherwise("N"), "s": F.when(fits, part(2)).otherwise("1").cast("long"), "e": F.when(fits, part(3)).otherwise("1").cast("long")})


def parse_pairs(text: str, inner: str = "double"):
    """A ``name=value,name=value,`` text as a map."""
    entries = F.filter(F.split(text, ","), lambda x: F.contains(x, F.lit("=")))
    return F.map_from_entries(F.transform(entries, lambda x: F.struct(F.substring_index(x, "=", 1), F.substring_index(x, "=", -1).cast(inner))))


def read_mutations(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(mutations, features) from ``# ``-led report lines: rows of eight fields, and gene, chain, ``KEY value``."""
    fields = F.split(F.regexp_replace("value", "^# ?", ""), "\t")
    rows = spark.read.text(path).where(F.startswith("value", F.lit("#"))).select(fields.alias("f"))
    names = ["gene", "chain", "exon", "position", "mclass", "mut", "masked", "mut_id"]
    mutations = rows.where(F.size("f") == 8).select(*[F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)])
    typed = mutations.withColumns({"exon": F.col("exon").cast("int"), "position": F.col("position").cast("int"), "masked": F.col("masked") == "masked"})
    pairs = rows.where(F.size("f") == 3).select(F.get("f", F.lit(0)).alias("gene"), F.get("f", F.lit(1)).alias("chain"), F.split(F.get("f", F.lit(2)), " ").alias("kv"))
    return typed, pairs.select("gene", "chain", F.element_at("kv", 1).alias("key"), F.element_at("kv", -1).alias("value"))


def number_repeats(lines: DataFrame, at: str, text: str, kinds: tuple[str, ...] = ("exon", "CDS")) -> DataFrame:
    """Numbers annotation lines of each kind within a gene; a line ``###`` ends one. Adds gene_no and number."""
    marked = running_totals(lines, [at], F.startswith(text, F.lit("###")).cast("long"), "gene_no")
    kind = F.get(F.split(text, "\t"), F.lit(2))
    kept = marked.withColumn("kind", kind).where(F.col("kind").isin(*kinds))
    return kept.withColumn("number", F.row_number().over(Window.partitionBy("gene_no", "kind").orderBy(at)))


def read_alignments(spark: SparkSession, path: str, marker: str = ">reference") -> DataFrame:
    """(projection, ref, query) from records of four lines: the marker, the reference, ``>projection`` and the query.

    Sequences of two lengths fail the job.
    """
    text = spark.read.option("lineSep", marker).text(path)
    lines = F.split("value", r"\r?\n")
    rows = text.select(F.get(lines, F.lit(1)).alias("ref"), F.get(lines, F.lit(2)).alias("name"), F.get(lines, F.lit(3)).alias("query")).where("name LIKE '>%'")
    same = F.length("ref") == F.length("query")
    checked = F.when(same, F.col("ref")).otherwise(F.raise_error(F.concat(F.lit("sequences of two lengths: "), "name")))
    return rows.select(F.trim(F.substring("name", 2, 10_000)).alias("projection"), checked.alias("ref"), "query")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(ref, que, score) of a substitution matrix: a heading line of letters, then a letter and its scores a line."""
    lines = spark.read.text(path).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("f"))
    scored = F.coalesce(F.get("f", F.lit(1)).rlike(r"^-?\d+$"), F.lit(False))
    # The heading has no number and is one line, so it may meet every other.
    letters = lines.where(~scored).agg(F.first("f").alias("heading"))
    rows = lines.where(scored).select(F.get("f", F.lit(0)).alias("ref"), F.posexplode(F.slice("f", 2, F.size("f") - 1)).alias("at", "score"))
    named = rows.join(F.broadcast(letters.select(F.posexplode("heading").alias("at", "que"))), "at")
    return named.select("ref", "que", F.col("score").cast("int").alias("score"))
