"""Rows of a browser's table, and the plan that merges them."""

from loomspan.operators import browser_tables as bt


def test_tables_meet_in_one_exchange(spark):
    tables = {f"t{i}": spark.createDataFrame([(k, f"{i}{k}") for k in range(i, 6)], "k int, v string") for i in range(5)}
    found = bt.merge_by_key(tables, "k")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {r["k"]: [r[f"t{i}"] and r[f"t{i}"]["v"] for i in range(5)] for r in found.collect()}
    assert got == {k: [f"{i}{k}" if k >= i else None for i in range(5)] for k in range(6)}


def test_tracks_without_place_or_with_overlapping_blocks_go(spark):
    rows = [("a", "c1", [(5, 9), (0, 3)]), ("b", "None", [(0, 3)]), ("c", "c1", [(0, 6), (5, 9)]), ("d", None, [(0, 1)]), ("e", "c2", [(0, 5), (5, 9)]), ("f", "c1", [(0, 9)])]
    df = spark.createDataFrame(rows, "name string, chrom string, blocks array<struct<s:int,e:int>>")
    assert {r["name"] for r in bt.shown_tracks(df).collect()} == {"a", "e", "f"}


def test_rows_have_placeholders(spark):
    tracks = spark.createDataFrame([("t.x.7", "c1", 1, [(1, 2)]), ("u.8", "c1", 5, [(5, 9)])], "name string, chrom string, start int, blocks array<struct<s:int,e:int>>")
    info = spark.createDataFrame([("u.8", "p", "I", 0.5), ("w.9", "p", "I", 0.5)], "name string, place string, class string, score double")
    features = spark.createDataFrame([("t.x.7", 0.1, 0.2, 0.3, 0.4)], "name string, ignore_m double, intact_m double, intact_codons double, out_of_chain double")
    proteins = spark.createDataFrame([], "name string, ref string, query string")
    mutations = spark.createDataFrame([("u.8", 2, "b", 1), ("u.8", 1, "a", 2)], "name string, exon int, mut_id string, position int")
    exons = spark.createDataFrame([("u.8", 1, 9)], "name string, exon int, size int")
    links = spark.createDataFrame([("u", "page")], "transcript string, link string")
    got = {r["name"]: r.asDict(True) for r in bt.annotation_rows(tracks, info, features, proteins, mutations, exons, links).collect()}
    assert set(got) == {"t.x.7", "u.8"}
    a, b = got["t.x.7"], got["u.8"]
    assert (a["link"], a["info_class"], a["features_intact_m"], a["protein_query"], a["mutations"], a["exons"]) == ("t.x", bt.UNDEFINED, 0.2, "", [], [])
    assert (b["link"], b["info_class"], b["features_intact_m"]) == ("page", "I", 0.0)
    assert [m["mut_id"] for m in b["mutations"]] == ["a", "b"] and b["exons"] == [{"exon": 1, "size": 9}]
