"""Exon-aware alignments of coding sequences: codon tables, exon status, split stops, safe deletions.

An alignment is two texts of one length. In the reference a blank is intron or
intergenic sequence, ``>`` a deleted intron, lower case a codon split between
exons, ``-`` an insertion in the query; in the query ``-`` is a deletion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.operators.intervals import overlap_join
from loomspan.operators.loss import exon_mark
from loomspan.operators.mutations import STOPS
from loomspan.operators.runs import bridged_pairs, disjoint_spans, whole_series

#: First and last exons shorter than this count as missing where deleted.
SHORT_END_EXON = 20
#: Letters of texts whose codons are made at once.
MOST_LETTERS = 1 << 18


def codon_table(pairs: DataFrame, key: str, ref: str = "ref", query: str = "query") -> DataFrame:
    """A row per codon: (key, codon from 1, ref_codon, que_codon, t_exon, q_exon, split, first_at, last_at).

    A codon has three letters of the reference; gaps within or before it belong
    to it, but gaps behind an exon's last whole codon are a codon of their own.
    ``t_exon`` (from 0) counts introns and deleted introns, ``q_exon`` introns
    alone; both are of the codon's last column. ``split`` is how many columns of
    the codon stand before the intron that splits it, else 0; ``first_at`` and
    ``last_at`` are the query's positions (null if it is all gaps). The state of
    a scan is counts over the columns before, taken where a pair of texts is read;
    null texts have no codons.
    """
    found = T.StructType([T.StructField(key, pairs.schema[key].dataType)])
    for name in ("codon", "ref_codon", "que_codon", "t_exon", "q_exon", "split", "first_at", "last_at"):
        found.add(name, T.StringType() if name.endswith("_codon") else T.LongType())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, refs, queries = (batch.column(c) for c in ("k", "ref", "query"))
            row = 0
            while row < batch.num_rows:
                first, size, tables = row, 0, []
                # The codons of a whole batch of texts would take many times its memory.
                while row < batch.num_rows and size < MOST_LETTERS:
                    ref, query = refs[row].as_py(), queries[row].as_py()
                    tables.append(_codons_of(ref, query))
                    size, row = size + len(ref or ""), row + 1
                of = pa.array(np.repeat(np.arange(first, row), [len(x[0]) for x in tables]))
                yield pa.record_batch([keys.take(of), *[pa.concat_arrays(x) for x in zip(*tables, strict=True)]], found.names)

    rows = pairs.select(F.col(key).alias("k"), F.col(ref).cast("string").alias("ref"), F.col(query).cast("string").alias("query"))
    return rows.mapInArrow(cut, found)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _parts(letters: np.ndarray, starts: np.ndarray) -> pa.Array:
    """The text cut at ``starts``, in upper case."""
    small = (letters >= ord("a")) & (letters <= ord("z"))
    letters = np.where(small, letters - 32, letters).astype(np.uint32)
    if len(letters) and letters.max() > 127:
        text = [x.upper() for x in letters.tobytes().decode("utf-32-le")]
        return pa.array(["".join(text[a:b]) for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(text)], strict=True)], pa.string())
    offsets = np.append(starts, len(letters)).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets.tobytes()), pa.py_buffer(letters.astype(np.uint8).tobytes()))


def _codons_of(ref: str | None, query: str | None) -> tuple[pa.Array, ...]:
    """The columns of ``codon_table`` for one pair."""
    if ref is None or query is None:
        ref = query = ""
    t, q = _letters(" " + ref), _letters("-" + query)
    t, q = t[: len(q)], q[: len(t)]
    blank, cut, letter = t == ord(" "), t == ord(">"), ((t | 32) >= ord("a")) & ((t | 32) <= ord("z"))
    begins = lambda here: here & ~np.concatenate([[False], here[:-1]])
    q_exon = np.cumsum(begins(blank)) - 1
    t_exon = q_exon + np.cumsum(begins(cut))
    place = np.cumsum(q != ord("-")) - 1
    shown = ~blank
    q_exon, t_exon, place, letter, t, q = (x[shown] for x in (q_exon, t_exon, place, letter, t, q))
    if not len(t):
        return tuple(pa.array([], pa.string() if n in (1, 2) else pa.int64()) for n in range(8))
    before = np.cumsum(letter) - letter
    base = before // 3
    # Gaps after an exon's last whole codon stand apart if the codon's first letter is in a later exon.
    opening = np.flatnonzero(letter & (before % 3 == 0))
    began = np.append(q_exon[opening], np.iinfo(np.int64).max)[np.minimum(base, len(opening))]
    apart = ~letter & (before % 3 == 0) & (q_exon < began)
    new = np.concatenate([[True], (base[1:] != base[:-1]) | (apart[1:] != apart[:-1])])
    starts = np.flatnonzero(new)
    ends = np.append(starts[1:], len(t))
    early = np.add.reduceat((q_exon < q_exon[ends - 1][np.cumsum(new) - 1]).astype(np.int64), starts)
    there = q != ord("-")
    gone = ~np.logical_or.reduceat(there, starts)
    first_at = np.minimum.reduceat(np.where(there, place, np.iinfo(np.int64).max), starts)
    last_at = np.maximum.reduceat(np.where(there, place, -1), starts)
    whole = lambda x, mask=None: pa.array(np.asarray(x, np.int64), pa.int64(), mask=mask)
    return (
        whole(np.arange(1, len(starts) + 1)), _parts(np.where(t == ord(">"), ord("-"), t), starts), _parts(q, starts),
        whole(t_exon[ends - 1]), whole(q_exon[ends - 1]), whole(early), whole(first_at, gone), whole(last_at, gone),
    )


def exon_status(exons: DataFrame) -> DataFrame:
    """Adds ``state`` to exons (class, in_gap, included, identity, score, is_missing): M missing, D deleted, I intact.

    Missing are exons known to be, of class M or beside an assembly gap; deleted
    those whose alignment deserves no mark.
    """
    missing = F.coalesce("is_missing", F.lit(False)) | (F.col("class") == "M") | F.coalesce("in_gap", F.lit(False))
    mark = exon_mark(F.col("class"), F.coalesce("included", F.lit(False)), F.coalesce("identity", F.lit(0)), F.coalesce("score", F.lit(0)))
    return exons.withColumn("state", F.when(missing, "M").when(mark.isNull(), "D").otherwise("I"))


def settle_deletions(exons: DataFrame, key: str, short_only: int | None = None, missing_too: bool = False) -> DataFrame:
    """Refines ``state`` of deleted exons (key, exon from 1, size, state): mD if the frame is kept, M if a short end.

    A deletion keeps the frame if the exon's size, or that of a series of
    exons deleted in a row, is whole codons (with ``short_only``, only if the exon
    is below that size). A short first or last exon is missing rather than
    deleted. With ``missing_too`` missing exons of whole codons get mD as well.
    """
    rows = exons.select(key, F.col("exon").cast("long").alias("exon"), F.col("size").cast("long").alias("size"), "state")
    gone = rows.where("state = 'D'").withColumn("run", F.col("exon") - F.row_number().over(Window.partitionBy(key).orderBy("exon")))
    series = disjoint_spans(whole_series(gone, [key, "run"], "exon", "size"), [key, "run"])
    kept = series.select(key, F.explode(F.sequence("first", "last")).alias("exon"), F.lit(True).alias("__kept"))
    of_key = Window.partitionBy(key)
    at_end = (F.col("exon") == F.min("exon").over(of_key)) | (F.col("exon") == F.max("exon").over(of_key))
    marked = rows.withColumn("__end", at_end).join(kept, [key, "exon"], "left")
    frame = (F.col("size") % 3 == 0) | F.coalesce("__kept", F.lit(False))
    if short_only is not None:
        frame = frame & (F.col("size") < short_only)
    states = ["D", "M"] if missing_too else ["D"]
    state = F.when(~F.col("state").isin(states), F.col("state")).when(F.col("__end") & (F.col("size") < SHORT_END_EXON), "M").when(frame, "mD").otherwise(F.col("state"))
    return marked.select(key, "exon", "size", state.alias("state"))


def split_stops(codons: DataFrame, exons: DataFrame, key: str) -> DataFrame:
    """Stops that arise where two intact exons meet across deleted ones: (key, left_exon, exon, stop).

    ``codons`` of ``codon_table``, ``exons`` with state (key, exon from 1). The
    codon split behind the first exon and the one split before the second give
    the joined bases.
    """
    pairs = bridged_pairs(exons.withColumn("state", F.when(F.col("state") == "mD", "D").otherwise(F.col("state"))), [key], "exon", "state")
    first = codons.groupBy(key, "t_exon").agg(F.min_by(F.struct("que_codon", "split"), "codon").alias("c"))
    left = first.select(key, F.col("t_exon").alias("left_exon"), F.col("c").alias("__l"))
    right = first.select(key, (F.col("t_exon") + 1).alias("right_exon"), F.col("c").alias("__r"))
    met = pairs.join(left, [key, "left_exon"]).join(right, [key, "right_exon"]).where("__l.split > 0 AND __r.split > 0")
    joined = F.concat(F.expr("substring(__l.que_codon, 1, __l.split)"), F.expr("substring(__r.que_codon, __r.split + 1)"))
    stop = F.get(F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length("joined"), F.lit(1)), F.lit(3)), lambda i: F.substring("joined", i, F.lit(3))), lambda c: c.isin(*STOPS)), F.lit(0))
    return met.withColumn("joined", joined).select(key, "left_exon", F.col("right_exon").alias("exon"), stop.alias("stop")).where("stop IS NOT NULL")


def out_of_chain_share(codons: DataFrame, missing: DataFrame, key: str) -> DataFrame:
    """Share of codons in exons (key, t_exon) that the chain does not reach."""
    known = missing.select(key, "t_exon").distinct().withColumn("__out", F.lit(1))
    joined = codons.join(known, [key, "t_exon"], "left")
    return joined.groupBy(key).agg((F.count("__out") / F.count(F.lit(1))).alias("out_of_chain"))


def exon_alignments(rows: DataFrame, exons: list[int], key: str = "species") -> DataFrame:
    """Joins aligned exons (key, exon, seq) to one sequence per key; exons without one are gaps of the exon's width."""
    widths = rows.groupBy("exon").agg(F.max(F.length("seq")).alias("__w"))
    full = rows.select(key).distinct().withColumn("exon", F.explode(F.array(*[F.lit(n).cast(rows.schema["exon"].dataType) for n in exons])))
    padded = full.join(widths, "exon", "left").join(rows, [key, "exon"], "left")
    text = F.rpad(F.coalesce("seq", F.lit("")), F.coalesce("__w", F.lit(0)), F.lit("-"))
    return padded.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("exon", text.alias("x")))).alias("xs")).select(key, F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("seq"))


def frame_states(codons: DataFrame, exons: DataFrame, mutations: DataFrame, key: str) -> DataFrame:
    """(key, states): a letter per codon for ``loss.intact_features``.

    ``exons``: key, exon (from 1), state; ``mutations``: key, codon, those that
    count. A codon of a deleted exon is lost, of one whose deletion keeps the
    frame deleted, of a missing one missing; else one of gaps alone is deleted
    and others intact. A mutation makes a codon that is not missing lost.
    """
    hit = mutations.select(key, "codon").distinct().withColumn("__hit", F.lit(True))
    states = exons.select(key, (F.col("exon") - 1).alias("t_exon"), F.col("state").alias("__exon"))
    joined = codons.join(states, [key, "t_exon"], "left").join(hit, [key, "codon"], "left")
    own = F.when(F.col("__exon") == "M", "M").when(F.col("__exon") == "mD", "D").when(F.col("__exon") == "D", "L").when(F.col("que_codon") == "---", "D").otherwise("I")
    letter = F.when(F.col("__hit") & (own != "M"), "L").otherwise(own)
    return joined.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("codon", letter.alias("x")))).alias("xs")).select(key, F.array_join(F.transform("xs", lambda x: x["x"]), "").alias("states"))


def whole_codon_exons(codons: DataFrame, key: str) -> DataFrame:
    """(key, t_exon, whole): whether every codon of an exon has three bases on either side and no gap."""
    whole = (F.length("ref_codon") == 3) & (F.length("que_codon") == 3) & ~F.contains("ref_codon", F.lit("-")) & ~F.contains("que_codon", F.lit("-"))
    return codons.groupBy(key, "t_exon").agg(F.bool_and(whole).alias("whole"))


def region_mark(expected_s: Column, expected_e: Column, s: Column, e: Column) -> Column:
    """INC if a predicted region shares a base with the expected one (ends in either order), else EXCL."""
    low, high = F.greatest(F.least(expected_s, expected_e), F.least(s, e)), F.least(F.greatest(expected_s, expected_e), F.greatest(s, e))
    return F.when(high > low, "INC").otherwise("EXCL")


def upgraded_class(kind: Column, whole: Column, covered: Column, same_length: Column) -> Column:
    """A+ for an exon of class A with whole codons, of one length, whose flanks the chain covers alike; else its class."""
    return F.when((kind == "A") & whole & covered & same_length, "A+").otherwise(kind)


def beside_gap(exons: DataFrame, gaps: DataFrame, keys: list[str], flank: int = 50, bin_size: int = 1024) -> DataFrame:
    """Adds ``in_gap``: whether an exon (keys, exon, s, e), widened by the flank, touches an assembly gap (keys, s, e)."""
    wide = exons.select(*keys, "exon", (F.col("s") - flank).alias("s"), (F.col("e") + flank).alias("e"))
    hit = overlap_join(wide, gaps.select(*keys, "s", "e"), keys, bin_size, closed=True).select(*keys, F.col("a_exon").alias("exon")).distinct().withColumn("in_gap", F.lit(True))
    return exons.join(hit, [*keys, "exon"], "left").withColumn("in_gap", F.coalesce("in_gap", F.lit(False)))
