"""What an alignment needs: a memory model, and buckets of jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the model: states besides codons for each exon, per codon, and spare bytes.
STATES_PER_EXON, STATES_PER_CODON, SPARE_BYTES = 39, 6, 100_000


def states(sizes: Column) -> Column:
    """Model states of an array of exon sizes."""
    return F.aggregate(sizes, F.lit(0).cast("long"), lambda n, s: n + F.lit(STATES_PER_EXON) + F.lit(STATES_PER_CODON) * F.floor(s / 3))


def gigabytes(n_states: Column, ref_length: Column, query_length: Column) -> Column:
    """Memory of an alignment, rounded up, and a quarter."""
    n, r, q = (c.cast("double") for c in (n_states, ref_length, query_length))
    total = n * 32 + n * q * 4 + n * 304 + (q * 2 + r) * 8 + (q + r) * 2 + F.lit(SPARE_BYTES)
    return F.ceil(total / 1e9) + F.lit(0.25)


def bucket(value: Column, limits: Sequence[float]) -> Column:
    """The least limit that is not below the value; null beyond all."""
    return F.array_min(F.filter(F.array(*[F.lit(float(x)) for x in limits]), lambda x: x >= value))


def plan_jobs(jobs: DataFrame, fit: float, most: float = 500.0) -> DataFrame:
    """Adds ``gig`` and ``fits`` (fit, big or no) to jobs with sizes (exon sizes), r_len and q_len."""
    need = gigabytes(states(F.col("sizes")), F.col("r_len"), F.col("q_len"))
    return jobs.withColumn("gig", need).withColumn("fits", F.when(need <= fit, "fit").when(need <= most, "big").otherwise("no"))
