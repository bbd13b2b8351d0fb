import random

import pytest
from pyspark.sql import functions as F

from loomspan.operators import chains, intervals, runs


def table(spark, rows, names="k id s e"):
    return spark.createDataFrame(rows, names.split())


def random_rows(seed, n, longest=400):
    rng = random.Random(seed)
    rows = [(rng.randrange(3), i, s := rng.randrange(2000), s + rng.choice([1, 5, 60, longest])) for i in range(n)]
    return [*rows, (1, n, 0, 5000)]


@pytest.mark.parametrize("closed", [False, True])
@pytest.mark.parametrize("bin_size", [1, 7, 64, 4096])
def test_overlap_join_matches_brute_force(spark, bin_size, closed):
    a, b = random_rows(1, 60), random_rows(2, 60)
    got = intervals.overlap_join(table(spark, a), table(spark, b), ["k"], bin_size, closed=closed).select("a_id", "b_id").collect()
    meets = (lambda x, y: x[2] <= y[3] and y[2] <= x[3]) if closed else (lambda x, y: x[2] < y[3] and y[2] < x[3])
    assert sorted(map(tuple, got)) == sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and meets(x, y))


def test_overlap_join_has_no_cross_product_and_ignores_nulls(spark):
    a = table(spark, [(1, 1, 0, 5), (None, 2, 0, 5), (1, 3, None, 5), (1, 4, 7, 7)])
    joined = intervals.overlap_join(a, table(spark, [(1, 9, 3, 8)]), ["k"], 4)
    assert [r["a_id"] for r in joined.collect()] == [1]
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_skipped_reasons(spark):
    a = table(spark, [(1, 1, 0, 5), (1, 2, 50, 60), (2, 3, 0, 5)])
    got = {(r["id"], r["reason"]) for r in intervals.skipped(a, table(spark, [(1, 9, 3, 8)]), ["k"], 16).collect()}
    assert got == {(2, "no intersecting chains"), (3, "chromosome is not aligned")}


def test_abutting_intervals(spark):
    rows = table(spark, [(1, 1, 0, 5), (1, 2, 5, 8)])
    assert intervals.union_intervals(rows, ["k"]).count() == 2
    assert [tuple(r) for r in intervals.union_intervals(rows, ["k"], merge_adjacent=True).select("s", "e").collect()] == [(0, 8)]


def test_union_matches_positions(spark):
    rows = random_rows(5, 80)
    got = intervals.union_intervals(table(spark, rows), ["k"]).collect()
    for k in range(3):
        covered = {p for r in rows if r[0] == k for p in range(r[2], r[3])}
        islands = [(r["s"], r["e"]) for r in got if r["k"] == k]
        assert {p for s, e in islands for p in range(s, e)} == covered
        assert sum(e - s for s, e in islands) == len(covered)


def test_all_overlapping_tracks_count(spark):
    """A track that only touches a block's start does not hide later ones."""
    tracks = table(spark, [(1, 1, 0, 1000), (1, 2, 10, 100), (1, 3, 150, 200)])
    got = intervals.overlap_totals(tracks, table(spark, [(1, 9, 100, 300)]), ["k"], ["id"], 64).collect()
    assert {r["a_id"]: r["bases"] for r in got} == {1: 200, 3: 50}


def test_coverage_counts_bases_once(spark):
    tracks = table(spark, [(1, 1, 0, 100), (1, 2, 500, 510)])
    blocks = table(spark, [(1, 1, 10, 30), (1, 2, 20, 40)])
    assert {r["id"]: (r["span"], r["covered"]) for r in intervals.coverage(tracks, blocks, ["k"], "id", 32).collect()} == {1: (100, 30), 2: (10, 0)}


def test_runs_and_clusters(spark):
    df = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 9, 10)], "k string, n int")
    assert sorted(tuple(r) for r in runs.runs(df, ["k"], "n", 2).select("first", "last").collect()) == [(1, 3), (9, 10)]
    assert sorted(tuple(r) for r in runs.gap_clusters(df, ["k"], "n", 2).select("first", "last").collect()) == [(1, 3), (7, 10)]


def test_bridged_pairs_skip_missing(spark):
    states = "IDDIIDMDIDI"
    df = spark.createDataFrame([("a", i, s) for i, s in enumerate(states)], "k string, n int, st string")
    assert sorted(tuple(r)[1:] for r in runs.bridged_pairs(df, ["k"], "n", "st").collect()) == [(0, 3), (8, 10)]


@pytest.fixture(scope="module")
def blocks(spark):
    # Target 100-110, 120-140, 150-155; query 10-20, 25-45, 45-50.
    rows = [(1, 1, 100, 110, 10, 20), (1, 2, 120, 140, 25, 45), (1, 3, 150, 155, 45, 50)]
    return spark.createDataFrame(rows, "chain_id long, block_no long, t_start long, t_end long, q_start long, q_end long")


@pytest.mark.parametrize(
    ("s", "e", "shift", "want"),
    [
        (102, 108, 0, (12, 18)),  # within a block
        (112, 130, 0, (25, 35)),  # starts in a gap: next block's start
        (105, 145, 0, (15, 45)),  # ends in a gap: previous block's end
        (10, 20, 0, (10, 11)),  # before the chain: its first base
        (500, 600, 0, (49, 50)),  # behind it: its last
        (122, 130, 1, (10, 50)),  # widened by a block either way
        (122, 130, 2, (10, 50)),  # no further than the chain
    ],
)
def test_projection(spark, blocks, s, e, shift, want):
    region = spark.createDataFrame([(1, 7, s, e)], "chain_id long, region int, s long, e long")
    row = chains.project_ranges(blocks, region, shift=shift).first()
    assert (row["q_from"], row["q_to"]) == want


def test_projection_to_the_minus_strand(spark, blocks):
    region = spark.createDataFrame([(1, 7, 102, 108)], "chain_id long, region int, s long, e long")
    head = spark.createDataFrame([(1, "-", 1000)], "chain_id long, q_strand string, q_size long")
    row = chains.project_ranges(blocks, region, head).first()
    assert (row["q_from"], row["q_to"]) == (982, 988)


def test_score_filter_is_strict(spark):
    df = spark.createDataFrame([(1, 15000), (2, 15001)], "chain_id long, score long")
    assert [r["chain_id"] for r in chains.score_filter(df).collect()] == [2]


def test_decode(spark):
    raw = spark.createDataFrame([(1, 1, 10, 10, 5), (1, 2, 20, 10, 0), (1, 3, 5, None, None)], "chain_id long, block_no long, size long, dt long, dq long")
    head = spark.createDataFrame([(1, 100, 10)], "chain_id long, t_start long, q_start long")
    got = [tuple(r)[2:] for r in chains.decode_blocks(head, raw).orderBy("block_no").collect()]
    assert got == [(100, 110, 10, 20), (120, 140, 25, 45), (150, 155, 45, 50)]


def test_empty_tables(spark):
    none = table(spark, [(1, 1, 0, 5)]).where("k = 2")
    assert intervals.overlap_join(none, none, ["k"]).count() == 0
    assert intervals.union_intervals(none, ["k"]).count() == 0
    assert intervals.skipped(table(spark, [(1, 1, 0, 5)]), none, ["k"]).first()["reason"] == "chromosome is not aligned"
    assert none.select(F.col("k")).count() == 0


@pytest.mark.parametrize("adjacent", [False, True])
def test_union_of_one_key_in_many_ranges(spark, adjacent):
    rng = random.Random(11 + adjacent)
    rows = [("a" if rng.random() < 0.9 else None if rng.random() < 0.5 else "b", s := rng.randrange(3000), s + rng.choice([0, 1, 5, 9, 400 if rng.random() < 0.02 else 2])) for _ in range(700)]
    want = []
    for key in ("a", "b", None):
        own = sorted((s, e) for k, s, e in rows if k == key)
        for s, e in own:
            if want and want[-1][0] == key and (s <= want[-1][2] if adjacent else s < want[-1][2]):
                want[-1] = (key, want[-1][1], max(e, want[-1][2]), want[-1][3] + 1)
            else:
                want.append((key, s, e, 1))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = intervals.union_intervals(spark.createDataFrame(rows, "k string, s long, e long"), ["k"], merge_adjacent=adjacent)
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(want, key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_running_totals_need_no_single_task(spark):
    rows = [(i * 37 % 501, i % 4) for i in range(501)]
    found = runs.running_totals(spark.createDataFrame(rows, "at int, n int"), ["at"], F.col("n").cast("long"), "upto")
    assert "SinglePartition" not in found._jdf.queryExecution().executedPlan().toString()
    total, want = 0, {}
    for at, n in sorted(rows):
        total += n
        want[at] = total
    assert {r["at"]: r["upto"] for r in found.collect()} == want
    assert runs.running_totals(spark.createDataFrame([], "at int, n int"), ["at"], F.lit(1), "upto").count() == 0
