"""From aligned columns to places in a genome: exons of a query locus, or of several loci joined to one."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exon_spans(pairs: DataFrame, key: str, ref: str = "ref", query: str = "query") -> DataFrame:
    """The aligned exons of each pair: (key, exon from 0, first_at, n_bases, ref_seq, que_seq).

    An exon is the columns between blanks of the reference. ``first_at`` is
    the number of query letters before its first own letter, introns
    included (null if it has none), ``n_bases`` how many letters it has. Null texts have no exons.
    """
    made = T.StructType([T.StructField(key, pairs.schema[key].dataType)])
    for name, kind in (("exon", T.LongType()), ("first_at", T.LongType()), ("n_bases", T.LongType()), ("ref_seq", T.StringType()), ("que_seq", T.StringType())):
        made.add(name, kind)
    kinds = [pa.int64()] * 3 + [pa.string()] * 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [_exons_of(t, q) for t, q in zip(batch.column("ref").to_pylist(), batch.column("query").to_pylist(), strict=True)]
                row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in found]))
                flat = [x for rows in found for x in rows]
                yield pa.record_batch([batch.column("k").take(row), *[pa.array([x[i] for x in flat], kind) for i, kind in enumerate(kinds)]], made.names)

    rows = pairs.select(F.col(key).alias("k"), F.col(ref).cast("string").alias("ref"), F.col(query).cast("string").alias("query"))
    return rows.mapInArrow(cut, made)


def _exons_of(ref: str | None, query: str | None) -> list[tuple]:
    if ref is None or query is None:
        return []
    size = min(len(ref), len(query))
    shown = np.array([c != " " for c in ref[:size]], bool)
    edges = np.flatnonzero(np.diff(np.concatenate([[False], shown, [False]]).astype(np.int8)))
    found = []
    for exon, (a, b) in enumerate(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)):
        own = query[a:b]
        bases = len(own) - own.count("-")
        before = a - query[:a].count("-")
        found.append((exon, before if bases else None, bases, ref[a:b].replace(">", "-").upper(), own.upper()))
    return found


def _lifted(start: Column, end: Column, forward: Column, first: Column, bases: Column) -> tuple[Column, Column]:
    """Where bases ``first`` to ``first + bases`` of a locus begin and end in the genome, in the direction of reading."""
    return F.when(forward, start + first).otherwise(end - first), F.when(forward, start + first + bases).otherwise(end - first - bases)


def place_exons(spans: DataFrame, loci: DataFrame, key: str) -> DataFrame:
    """Adds chrom, s, e and strand to exons (key, exon, first_at, n_bases) of one locus each (key, chrom, start, end, forward).

    An inverted locus is read from its end. Exons without a base have no place (nulls).
    """
    rows = spans.join(loci.select(key, "chrom", "start", "end", "forward"), key)
    a, b = _lifted(F.col("start"), F.col("end"), F.col("forward"), F.col("first_at"), F.col("n_bases"))
    there = F.col("first_at").isNotNull()
    return rows.withColumns({
        "chrom": F.when(there, F.col("chrom")), "s": F.when(there, F.least(a, b)), "e": F.when(there, F.greatest(a, b)), "strand": F.when(there, F.when(F.col("forward"), "+").otherwise("-")),
    }).drop("start", "end", "forward")


def fragment_offsets(fragments: DataFrame, key: str) -> DataFrame:
    """Adds where each fragment (key, nth, start, end) begins and ends in the joined sequence: ``begins``, ``ends``."""
    size = F.col("end") - F.col("start")
    upto = F.sum(size).over(Window.partitionBy(key).orderBy("nth").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fragments.withColumn("ends", upto).withColumn("begins", upto - size)


def place_on_fragments(spans: DataFrame, fragments: DataFrame, key: str, split: bool = False) -> DataFrame:
    """Places exons of a sequence that was joined from fragments (key, nth, chain_id, chrom, start, end, forward, chrom_size).

    An exon belongs to the fragment that holds its first base, and has no
    place (nulls) if it would leave that one's chromosome, or if it has no base. With
    ``split`` an exon across borders is one row for each fragment it touches instead,
    with its own ``n_bases``. Adds nth, chain_id, chrom, s, e, strand.
    """
    parts = fragment_offsets(fragments, key).select(key, "nth", "chain_id", "chrom", "start", "end", "forward", "chrom_size", "begins", "ends")
    # An exon meets the fragments of its own projection alone, which are the chains of one gene.
    first, last = F.col("first_at"), F.col("first_at") + F.col("n_bases")
    touched = (first < F.col("ends")) & (last > F.col("begins")) if split else (first >= F.col("begins")) & (first < F.col("ends"))
    a = spans.withColumnRenamed(key, "__key")
    met = a.join(parts, (F.col("__key") == F.col(key)) & touched, "left").drop(key).withColumnRenamed("__key", key)
    begins = F.greatest(first, F.col("begins")) if split else first
    bases = F.least(last, F.col("ends")) - begins if split else F.col("n_bases")
    met = met.withColumn("n_bases", F.coalesce(bases, F.col("n_bases")))
    x, y = _lifted(F.col("start"), F.col("end"), F.col("forward"), begins - F.col("begins"), F.col("n_bases"))
    met = met.withColumns({"s": F.least(x, y), "e": F.greatest(x, y)})
    there = F.coalesce((F.col("s") > 0) & (F.col("e") <= F.col("chrom_size")), F.lit(False))
    strand = F.when(F.col("forward"), "+").otherwise("-")
    return met.withColumns({"strand": F.when(there, strand), **{c: F.when(there, F.col(c)) for c in ("chrom", "s", "e")}}).drop("start", "end", "forward", "chrom_size", "begins", "ends")


def clashing_exons(placed: DataFrame, key: str) -> DataFrame:
    """(key, exon) of exons that begin before another of their projection on the same chromosome has ended."""
    order = Window.partitionBy(key, "chrom").orderBy("s", "e", "exon").rowsBetween(Window.unboundedPreceding, -1)
    return placed.where("s IS NOT NULL").withColumn("__end", F.max("e").over(order)).where("s < __end").select(key, "exon")
