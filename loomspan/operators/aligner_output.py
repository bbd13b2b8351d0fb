"""Records of an exon aligner, parsed once, as the tables of an annotation.

A file has a section for each reference transcript (``#name``) with FASTA
entries of four kinds, told by their headers: proteins, codons, reference exons
and query exons. What cannot be read goes to a table of rejects, not into a
failed job.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.operators.loss import exon_mark
from loomspan.operators.projections import FIELDS
from loomspan.operators.runs import falling_runs
from loomspan.session import settle

#: The chain of projections that were joined from several loci.
JOINED = -1
REGION = r"^(.+):(\d+)-(\d+)$"


class Annotation(NamedTuple):
    """``tracks``: name, chrom, strand, part, start, end, blocks, exons (numbers from 1); ``exons``: every query exon with its mark;
    ``removed``: exons that are deleted or missing but placed (chrom, s, e, name, score); ``sequences``: projection, ref, query;
    ``proteins`` and ``codons``: header, seq; ``skipped``: name, reason; ``rejects``: transcript, header, reason."""

    tracks: DataFrame
    exons: DataFrame
    removed: DataFrame
    sequences: DataFrame
    proteins: DataFrame
    codons: DataFrame
    skipped: DataFrame
    rejects: DataFrame


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(transcript, nth, header, seq): the entries of every section; header null where a section's text does not begin with an entry.

    A section is one row of text, as long as one transcript's alignments; lines led by ! are left out.
    """
    text = spark.read.option("lineSep", "#").text(path).where("trim(value) <> ''")
    name = F.trim(F.regexp_extract("value", r"^([^\r\n]*)", 1))
    body = F.regexp_replace("value", r"^[^\r\n]*\s*", "")
    entries = text.select(name.alias("transcript"), F.posexplode(F.split(body, "(?:^|\\n)>")).alias("nth", "entry")).where("nth > 0 OR trim(entry) <> ''")
    lines = F.filter(F.split("entry", r"\r?\n"), lambda line: (F.trim(line) != "") & ~line.startswith("!"))
    rows = entries.select("transcript", "nth", F.split("entry", r"\r?\n")[0].alias("head"), lines.alias("lines"))
    header = F.when(F.col("nth") > 0, F.trim("head"))
    return rows.select("transcript", "nth", header.alias("header"), F.array_join(F.transform(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), lambda x: F.trim(x)), "").alias("seq"))


def tagged(entries: DataFrame) -> DataFrame:
    """Adds ``kind`` (protein, codon, ref_exon, query_exon or null), the fields of exons' headers, typed, and ``reason`` where an entry cannot be used."""
    parts = F.transform(F.split("header", r"\|"), lambda x: F.trim(x))
    # Filters on fields are not carried below a generator, where they would split the header once a field.
    rows = entries.withColumn("f", F.explode(F.array(parts)))
    role = F.element_at("f", -1)
    kind = F.when(F.size("f") == 3, F.when(F.get("f", F.lit(1)) == "PROT", "protein").when(F.get("f", F.lit(1)) == "CODON", "codon"))
    rows = rows.withColumn("kind", F.when(role == "query_exon", "query_exon").when(role == "reference_exon", "ref_exon").otherwise(kind))
    field = lambda i: F.get("f", F.lit(i))
    rows = rows.withColumns({"exon": field(1).try_cast("int"), "chain": field(2).try_cast("long")})
    query = {name: F.when(F.col("kind") == "query_exon", field(i)) for i, name in enumerate(FIELDS) if name in ("region", "gap", "class", "expected", "included", "paralog")}
    rows = rows.withColumns(query | {"identity": F.when(F.col("kind") == "query_exon", field(4).try_cast("double")), "score": F.when(F.col("kind") == "query_exon", field(5).try_cast("double"))})
    is_exon = F.col("kind").isin("query_exon", "ref_exon")
    wrong = (
        F.when(F.col("header").isNull(), "text before the first entry")
        .when(F.col("kind").isNull(), "unknown kind of entry")
        .when((F.col("kind") == "query_exon") & (F.size("f") != len(FIELDS)), "wrong number of fields")
        .when((F.col("kind") == "ref_exon") & (F.size("f") != 4), "wrong number of fields")
        .when(is_exon & (F.col("exon").isNull() | F.col("chain").isNull()), "exon or chain is no number")
        .when((F.col("kind") == "query_exon") & (F.col("identity").isNull() | F.col("score").isNull()), "score is no number")
        .when(F.col("seq") == "", "no sequence")
    )
    return rows.withColumn("reason", wrong).drop("f")


def _projection() -> Column:
    return F.concat_ws(".", "transcript", F.col("chain").cast("string"))


def _mark() -> Column:
    return exon_mark(F.col("class"), F.coalesce(F.col("included") == "INC", F.lit(False)), F.col("identity"), F.col("score"))


def placed_exons(entries: DataFrame) -> DataFrame:
    """Query exons with chrom, a, b (as written), s, e, strand and ``mark`` (null: the exon is deleted or missing)."""
    a, b = F.regexp_extract("region", REGION, 2).try_cast("long"), F.regexp_extract("region", REGION, 3).try_cast("long")
    fits = F.col("region").rlike(REGION)
    rows = entries.where("kind = 'query_exon'").withColumns({"chrom": F.when(fits, F.regexp_extract("region", REGION, 1)), "s": F.when(fits, F.least(a, b)), "e": F.when(fits, F.greatest(a, b)), "strand": F.when(fits, F.when(a < b, "+").otherwise("-"))})
    return rows.withColumns({"projection": _projection(), "mark": _mark()})


def annotate_output(entries: DataFrame, excluded: DataFrame | None = None, reused: bool = True) -> Annotation:
    """The tables of an annotation from the entries of ``read_sections``; ``excluded``: transcripts to leave out.

    Entries are parsed and written once for all tables; without ``reused``, where few of them are
    wanted, nothing is written, and each table reads the entries anew and only what it needs of them.

    An exon with a mark is part of its projection's track; a projection's exons on a
    chromosome and strand are one track, or, joined from several loci, one wherever
    they do not go on in the strand's direction. In sequences an exon
    without a mark is its reference's bases against gaps. A projection whose
    exons are all without a mark, or unplaced, is skipped.
    """
    skipped = None
    allowed = late = lambda df: df
    if excluded is not None:
        names = excluded.select("transcript").distinct()
        skipped = entries.select("transcript").distinct().join(names, "transcript", "left_semi").select(F.col("transcript").alias("name"), F.lit("excluded").alias("reason"))
        # An anti join would be carried below the parsing, and shuffle the sections' whole texts.
        allowed = lambda df: df.join(names.withColumn("__out", F.lit(True)), "transcript", "left").where("__out IS NULL").drop("__out")
    known = tagged(entries)
    if reused:
        known = settle(allowed(known), "aligner-entries")
    else:
        late = allowed
    rejects = late(known.where("reason IS NOT NULL").select("transcript", "header", "reason"))
    good = known.where("reason IS NULL")

    exons = placed_exons(good)
    if reused:
        exons = settle(exons, "aligner-exons")
    kept = late(exons.where("mark IS NOT NULL AND chrom IS NOT NULL").select("transcript", "projection", "chain", "exon", "chrom", "strand", "s", "e"))
    # Parts begin in joined projections alone. With the transcript among the keys, rows stay where its join has put them.
    way = F.when(F.col("chain") == JOINED, F.when(F.col("strand") == "-", -F.col("s")).otherwise(F.col("s")))
    parted = falling_runs(kept.withColumn("__way", way), ["transcript", "projection", "chrom", "strand"], ["exon"], "__way")
    shape = [F.min("s").alias("start"), F.max("e").alias("end"), F.array_sort(F.collect_list(F.struct("s", "e"))).alias("blocks"), F.array_sort(F.collect_list(F.col("exon") + 1)).alias("exons")]
    tracks = parted.groupBy("transcript", F.col("projection").alias("name"), "chrom", "strand", "part").agg(*shape).select("name", "chrom", "strand", "part", "start", "end", "blocks", "exons")

    lost = late(exons.select("transcript", "projection", "mark", "chrom")).groupBy("projection").agg(F.count(F.when(F.col("mark").isNotNull() & F.col("chrom").isNotNull(), 1)).alias("n")).where("n = 0")
    lost = lost.select(F.col("projection").alias("name"), F.lit("all exons are deleted").alias("reason"))
    skipped = lost if skipped is None else skipped.unionByName(lost)

    removed = late(exons.where("mark IS NULL AND chrom IS NOT NULL").select("transcript", "exon", "chain", "chrom", "s", "e", "identity")).select(
        "chrom", "s", "e", F.concat_ws(".", "transcript", F.col("exon").cast("string"), F.col("chain").cast("string")).alias("name"), F.floor(F.col("identity") * 10).cast("long").alias("score")
    )
    of = F.col("kind") == "query_exon"
    both = good.where("kind IN ('ref_exon', 'query_exon')").withColumn("__mark", _mark()).where(~of | F.col("__mark").isNotNull())
    both = late(both.select("transcript", _projection().alias("projection"), "exon", F.when(~of, F.col("seq")).alias("ref"), F.when(of, F.col("seq")).alias("query")))
    met = both.groupBy("transcript", "projection", "exon").agg(F.collect_list("ref").alias("refs"), F.collect_list("query").alias("queries"))
    # Each of an exon's reference entries meets each of its query's.
    met = met.withColumn("any", F.size("queries") > 0).select("transcript", "projection", "exon", "any", F.explode_outer("refs").alias("ref"), "queries")
    met = met.select("transcript", "projection", "exon", "any", "ref", F.explode_outer("queries").alias("query"))
    bare = F.regexp_replace("ref", "-", "")
    pair = F.struct("exon", F.when(F.col("query").isNull(), bare).otherwise(F.col("ref")).alias("ref"), F.coalesce("query", F.regexp_replace(bare, ".", "-")).alias("query"))
    parts = met.groupBy("transcript", "projection").agg(F.array_sort(F.collect_list(F.when(F.col("ref").isNotNull(), pair))).alias("xs"), F.bool_or("any").alias("any")).where("any AND size(xs) > 0")
    text = lambda name: F.array_join(F.transform("xs", lambda x: x[name]), "").alias(name)
    sequences = parts.select("projection", text("ref"), text("query"))

    entry = lambda kind: late(good.where(F.col("kind") == kind).select("transcript", "header", "seq")).drop("transcript")
    table = late(exons.select("transcript", "exon", "chain", "region", "expected", "included", "identity", "score", "gap", "class", "paralog", F.coalesce("mark", F.lit("NA")).alias("mark")))
    return Annotation(tracks, table, removed, sequences, entry("protein"), entry("codon"), skipped, rejects)


def fragment_lines(tracks: DataFrame) -> DataFrame:
    """(chrom, start, end, name, first_exon, last_exon) of joined projections' tracks."""
    rows = tracks.where(F.col("name").endswith(f".{JOINED}"))
    return rows.select("chrom", "start", "end", "name", F.array_min("exons").alias("first_exon"), F.array_max("exons").alias("last_exon"))

