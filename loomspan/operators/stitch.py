"""Stitching fragmented orthologs: the best path over compatible chains of a transcript."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from heapq import heappop, heappush
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators.intervals import overlap_join

#: Bases that two neighbouring fragments may overlap, and how often an exon may be covered on average.
MOST_OVERLAP, MOST_COVERAGE = 250, 1.33


def best_path(chains: list[tuple[int, int, float, int]], most_overlap: int = MOST_OVERLAP) -> list[int]:
    """Ids of the path with the greatest sum of scores over (start, end, score, id).

    A chain follows another if it starts at or behind its end less the overlap
    and behind its start. Of equal paths that with the smaller ids counts.
    Chains are met in the order of their starts; those that may stand before the
    present one leave a heap, ordered by end, and only the best of them is kept.
    """
    total: dict[int, float] = {}
    before: dict[int, int | None] = {}

    def path(n: int | None) -> list[int]:
        out: list[int] = []
        while n is not None:
            out.append(n)
            n = before[n]
        return out[::-1]

    def better(n: int, other: int | None) -> bool:
        return other is None or total[n] > total[other] or (total[n] == total[other] and path(n) < path(other))

    open_: list[tuple[int, int]] = []
    best: int | None = None
    for start, group in groupby(sorted(chains, key=lambda c: (c[0], c[1], c[3])), key=lambda c: c[0]):
        while open_ and open_[0][0] <= start + most_overlap:
            n = heappop(open_)[1]
            best = n if better(n, best) else best
        added = []
        for _, end, score, n in group:
            follows = best is not None and total[best] > 0
            total[n] = score + (total[best] if follows else 0.0)
            before[n] = best if follows else None
            added.append((end, n))
        for item in added:
            heappush(open_, item)
    top: int | None = None
    for n in total:
        top = n if better(n, top) else top
    return path(top)


def stitch_fragments(scores: DataFrame, chains: DataFrame, exons: DataFrame, least_score: float = 0.5, fragments_only: bool = True) -> DataFrame:
    """(transcript, path of chain ids with commas, n_chains) of transcripts that lie on several chains.

    ``scores``: transcript, chain_id, score; ``chains``: chain_id, chrom, s, e;
    ``exons``: transcript, chrom, exon, s, e. Considered are transcripts with at
    least two chains of at least ``least_score``, none of which meets all exons,
    and with no more than MOST_COVERAGE chains on an exon on average.
    """
    kept = scores.where(F.col("score") >= least_score).join(chains, "chain_id")
    met = overlap_join(kept, exons, ["chrom", "transcript"], 1 << 16).select("transcript", F.col("a_chain_id").alias("chain_id"), F.col("b_exon").alias("exon")).distinct()
    n_exons = exons.groupBy("transcript").agg(F.count_distinct("exon").alias("n_exons"))
    each = met.groupBy("transcript", "chain_id").agg(F.count(F.lit(1)).alias("n_met"))
    totals = each.groupBy("transcript").agg(F.sum("n_met").alias("all_met"), F.max("n_met").alias("most_met"))
    several = kept.groupBy("transcript").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Transcripts none of whose chains meets an exon have no row in totals, and an average of 0.
    suited = several.join(n_exons, "transcript").join(totals, "transcript", "left").where((F.coalesce("most_met", F.lit(0)) < F.col("n_exons")) & (F.coalesce("all_met", F.lit(0)) / F.col("n_exons") <= MOST_COVERAGE))
    rows = kept.join(suited.select("transcript"), "transcript", "left_semi").groupBy("transcript").agg(F.collect_list(F.struct("s", "e", "score", "chain_id")).alias("chains"))
    kind = scores.schema["transcript"].dataType.simpleString()

    def solve(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            paths = [best_path([(c["s"], c["e"], c["score"], c["chain_id"]) for c in found]) for found in batch["chains"]]
            yield pd.DataFrame({"transcript": batch["transcript"], "path": [",".join(map(str, p)) for p in paths], "n_chains": [len(p) for p in paths]})

    found = rows.mapInPandas(solve, f"transcript {kind}, path string, n_chains bigint")
    return found.where("n_chains > 1") if fragments_only else found
