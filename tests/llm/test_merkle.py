"""Merkle manifests against a plain version that hashes node by node."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from loomspan.llm import merkle

FIELDS = ["doc_id", "source", "text"]


def digest(text):
    return sha256(text.encode()).hexdigest()


def leaf_of(values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The levels of a tree, leaves first."""
    levels = [list(nodes)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])
    return levels


def siblings(levels, at, fanout):
    path = []
    for below in levels[:-1]:
        first = at - at % fanout
        path.append(([*below[first:at]], [*below[at + 1 : first + fanout]]))
        at //= fanout
    return path


def brute(rows, fanout, change):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for name in names:
        ordered = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        groups[name] = ordered
        trees[name] = tree([leaf_of(r) for r in ordered], fanout)
    crown = tree([trees[n][-1][0] for n in names], fanout)
    found = []
    for k, name in enumerate(names):
        for at, row in enumerate(groups[name]):
            path = siblings(trees[name], at, fanout) + siblings(crown, k, fanout)
            folded = leaf_of(change(row))
            for before, after in path:
                folded = digest("".join([*before, folded, *after]))
            proof = digest("".join("".join(b + a) for b, a in path))
            found.append((row[0], leaf_of(row), trees[name][-1][0], crown[-1][0], proof, folded, folded == crown[-1][0]))
    return found


def key(row):
    return tuple((v is not None, v if v is not None else 0) for v in row)


@pytest.mark.parametrize(("count", "fanout", "levels"), [(0, 3, 2), (1, 3, 2), (2, 2, 1), (40, 3, 1), (250, 3, 2), (250, 2, 3), (250, 3, 6)])
def test_equals_plain_hashing(spark, count, fanout, levels):
    rng = random.Random(count + fanout)
    names = ["web", "", None, "Bücher", "z" * 40] + ["web"] * 10
    rows = [(i * 7 % 1009, rng.choice(names), rng.choice([None, "", "a\nb", f"text {i}\n", "ä" * i])) for i in range(count)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumns({"grp": F.lit(1), "n": F.lit("x"), "pos": F.lit(None).cast("long")})
    offered = {"text": F.when(F.col("doc_id") % 3 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    got = merkle.merkle_manifest(docs, FIELDS, offered=offered, fanout=fanout, levels=levels)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    want = brute(rows, fanout, lambda r: (r[0], r[1], r[2] and r[2].replace("\n", "")) if r[0] % 3 == 0 else r)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    if count == 250:
        assert {r[-1] for r in want} == {True, False}


def test_null_and_repeated_ids_and_equal_rows(spark):
    rows = [(None, "a", "x"), (None, "a", "x"), (None, "a", None), (5, "a", "p"), (5, "a", "q"), (5, "a", "p"), (1, None, "s"), (2, "b", "s" * 300_000)]
    got = merkle.merkle_manifest(spark.createDataFrame(rows, "doc_id long, source string, text string"), FIELDS, levels=1)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(brute(rows, 3, lambda r: r), key=key)
    assert all(r["verified"] for r in got.collect())


def test_blocks_of_one_tree_go_up_all_levels():
    import numpy as np

    leaves = np.frombuffer("".join(digest(str(i)) for i in range(10)).encode(), np.uint8).reshape(-1, 64)
    assert [len(x) for x in merkle.hash_block(leaves[9:], False, 3, 2)] == [1, 1, 1]
    assert [len(x) for x in merkle.hash_block(leaves, True, 3, 2)] == [10, 4, 2, 1]
    assert [len(x) for x in merkle.hash_block(leaves[:1], True, 3, 2)] == [1]
