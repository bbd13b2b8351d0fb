"""Nucleotide and protein sequences as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, bases in the order T, C, A, G.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"

CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}


def reverse_complement(seq: Column) -> Column:
    """Upper-cased; characters other than A, C, G, T, N and - go."""
    kept = F.regexp_replace(F.upper(seq), "[^ACGTN-]", "")
    return F.reverse(F.translate(kept, "ACGT", "TGCA"))


def codons(seq: Column, size: int = 3) -> Column:
    """The sequence cut into parts of ``size``, the last perhaps shorter; an empty one has none."""
    return F.regexp_extract_all(seq, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def translate(seq: Column) -> Column:
    """One letter per codon: * for a stop, - for a gap of three, X for any other that the code lacks."""
    table = F.create_map(*[F.lit(x) for pair in [*CODONS.items(), ("---", "-")] for x in pair])
    return F.array_join(F.transform(codons(F.upper(seq)), lambda c: F.coalesce(F.try_element_at(table, c), F.lit("X"))), "")


def _pairs(a: Column, b: Column) -> Column:
    return F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))


def identity_with_gaps(a: Column, b: Column) -> Column:
    """Percent of equal columns of an alignment; those with an N don't count, two gaps are equal."""
    shown = F.filter(F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda p: (p["x"] != "N") & (p["y"] != "N") & (p["x"] != "") & (p["y"] != ""))
    return F.coalesce(F.try_divide(F.size(F.filter(shown, lambda p: p["x"] == p["y"])) * 100, F.size(shown)), F.lit(0.0))


def identity_of_bases(a: Column, b: Column) -> Column:
    """Percent of equal columns among those with neither N nor gap."""
    shown = F.filter(
        F.zip_with(F.split(F.upper(a), ""), F.split(F.upper(b), ""), lambda x, y: F.struct(x.alias("x"), y.alias("y"))),
        lambda p: ~p["x"].isin("N", "-", "") & ~p["y"].isin("N", "-", ""),
    )
    return F.coalesce(F.try_divide(F.size(F.filter(shown, lambda p: p["x"] == p["y"])) * 100, F.size(shown)), F.lit(0.0))


def substitution_score(a: Column, b: Column, matrix: dict[str, int]) -> Column:
    """Sum of a matrix (keys of two letters) over an alignment: -1 for a gap, 0 for two gaps or unknown letters."""
    table = F.create_map(*[F.lit(x) for pair in matrix.items() for x in pair])

    def one(x: Column, y: Column) -> Column:
        both = (x == "-") & (y == "-")
        return F.when(both, 0).when((x == "-") | (y == "-"), -1).otherwise(F.coalesce(F.try_element_at(table, F.concat(x, y)), F.lit(0)))

    return F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), one), F.lit(0), lambda n, x: n + x)


def longest_unknown(seq: Column) -> Column:
    """Length of the longest run of N."""
    runs = F.split(F.regexp_replace(F.upper(seq), "[^N]+", " "), " ")
    return F.array_max(F.transform(runs, lambda r: F.length(r)))


def has_gap(seq: Column, size: int = 10) -> Column:
    """Whether there is a run of at least ``size`` unknown bases."""
    return seq.rlike(f"(?i)N{{{size},}}")


def projection_parts(name: Column) -> tuple[Column, Column]:
    """A projection's transcript and chain: what stands before and after the last dot."""
    return F.regexp_extract(name, r"^(.*)\.([^.]*)$", 1), F.regexp_extract(name, r"^(.*)\.([^.]*)$", 2)


def mutation_masked(codon: Column, codons: Column, starts: Column, mask_first: Column | bool = False) -> Column:
    """Whether a mutation at a codon (from 1) is masked by its place.

    In the last tenth always; in the middle never; in the first tenth if
    ``mask_first`` or if another start codon (``starts``: their numbers) at or
    behind it lies within that tenth.
    """
    left = F.floor(codons / 10)
    right = codons - left
    following = F.array_min(F.filter(starts, lambda n: n >= codon))
    flag = F.lit(mask_first) if isinstance(mask_first, bool) else mask_first
    early = flag | F.coalesce(following <= left, F.lit(False))
    return F.when(codon >= right, True).when(codon > left, False).otherwise(early)
