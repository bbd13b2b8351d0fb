"""One row for each annotated projection with all that a browser shows of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What stands for a table's columns where it lacks a projection.
UNDEFINED = "Undefined"
DEFAULTS = {"info": {"place": UNDEFINED, "class": UNDEFINED, "score": 0.0}, "features": {"ignore_m": 0.0, "intact_m": 0.0, "intact_codons": 0.0, "out_of_chain": 0.0}, "protein": {"ref": "", "query": ""}}


def merge_by_key(tables: dict[str, DataFrame], key: str) -> DataFrame:
    """A row per key of any table, with a struct of each table's other columns under its name (null where it lacks the key).

    The tables, with a row per key each, are put under each other and grouped:
    one exchange for all of them, instead of one or two for each join.
    """
    named = [df.select(key, F.struct(*[c for c in df.columns if c != key]).alias(name)) for name, df in tables.items()]
    rows = named[0]
    for df in named[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    return rows.groupBy(key).agg(*[F.first(name, ignorenulls=True).alias(name) for name in tables])


def rolled_up(df: DataFrame, key: str, order: list[str], into: str) -> DataFrame:
    """(key, into): each key's rows as an array of structs, in order of the named columns."""
    rest = [c for c in df.columns if c not in (key, *order)]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias(into))


def shown_tracks(tracks: DataFrame) -> DataFrame:
    """Tracks (with chrom and blocks) that lie on a chromosome and whose blocks don't overlap."""
    ordered = F.array_sort("blocks")
    clash = F.exists(F.sequence(F.lit(1), F.size("blocks") - 1), lambda i: F.get(ordered, i)["s"] < F.get(ordered, i - 1)["e"])
    return tracks.where(F.col("chrom").isNotNull() & (F.col("chrom") != "None")).where((F.size("blocks") < 2) | ~clash)


def annotation_rows(tracks: DataFrame, info: DataFrame, features: DataFrame, proteins: DataFrame, mutations: DataFrame, exons: DataFrame, links: DataFrame) -> DataFrame:
    """Every shown track (name, chrom, start, ...) with its projection's data.

    ``info``, ``features`` and ``proteins`` have a row per projection (``name``) and the
    columns of DEFAULTS, which fill in where one is missing; ``mutations`` (name, exon, mut_id, ...)
    and ``exons`` (name, exon, ...) are rolled up, to empty arrays where there are none;
    ``links`` (transcript, link) gives the reference's page, else its name.
    """
    nested = {"mutations": rolled_up(mutations, "name", ["exon", "mut_id"], "rows"), "exons": rolled_up(exons, "name", ["exon"], "rows")}
    merged = merge_by_key({"track": shown_tracks(tracks), "info": info, "features": features, "protein": proteins, **nested}, "name").where("track IS NOT NULL")
    filled = [F.coalesce(F.col(name)[c], F.lit(v)).alias(f"{name}_{c}") for name, columns in DEFAULTS.items() for c, v in columns.items()]

    def rows(name: str, df: DataFrame) -> Column:
        return F.coalesce(F.col(name)["rows"], F.array().cast(df.schema["rows"].dataType)).alias(name)

    transcript = F.regexp_extract("name", r"^(.*)\.[^.]*$", 1)
    found = merged.select("name", "track.*", *filled, *[rows(n, df) for n, df in nested.items()], transcript.alias("transcript"))
    return found.join(links.select("transcript", "link"), "transcript", "left").withColumn("link", F.coalesce("link", "transcript"))
