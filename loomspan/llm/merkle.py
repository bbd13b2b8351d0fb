"""A Merkle manifest of a dataset: a tree for each source, and one over the sources' roots.

Nodes are hashed in aligned blocks of FANOUT ** BLOCK_LEVELS: in a block the
hexadecimal digests are one contiguous numpy matrix of 64 bytes a row, which is
reshaped by the fanout and hashed row by row, level after level; where a node's
siblings are follows from its index. A block's root is a node of the next table
of nodes, so a source of any size takes a few passes of bounded groups."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomspan.llm.common import settle, table
from loomspan.session import settle_measured

FANOUT = 3
#: Levels that are hashed within one block: 729 nodes of 64 bytes.
BLOCK_LEVELS = 6
#: Bytes of a digest as text.
DIGEST = 64
#: Rows (some 60 bytes each) of counts that may be broadcast.
BROADCAST_COUNTS = 300_000

NODE = "grp string, pos long, n long, digest string"


def encoded(field: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = field.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def hash_up(digests: np.ndarray, fanout: int) -> np.ndarray:
    """The next level: each ``fanout`` consecutive rows, the last run fewer, become their digest."""
    whole = len(digests) // fanout
    made = [sha256(run).hexdigest() for run in digests[: whole * fanout].reshape(whole, fanout * DIGEST)]
    if len(digests) > whole * fanout:
        made.append(sha256(digests[whole * fanout :].reshape(-1)).hexdigest())
    return np.frombuffer("".join(made).encode(), np.uint8).reshape(-1, DIGEST)


def hash_block(digests: np.ndarray, alone: bool, fanout: int, levels: int) -> list[np.ndarray]:
    """All levels of a block, its nodes first. A block that is its whole tree
    ends at one node; one of several goes up all levels, as other nodes remain beside it."""
    made = [digests]
    while len(made[-1]) > 1 if alone else len(made) <= levels:
        made.append(hash_up(made[-1], fanout))
    return made


def sibling_paths(made: list[np.ndarray], tail: list[str], fanout: int) -> list[list[str]]:
    """For each node of a block: what stands before and what after it in its run,
    level by level, then ``tail``, which is the same of the block's root."""
    paths = [tail]
    for digests in reversed(made[:-1]):
        text, at = digests.tobytes().decode(), np.arange(len(digests))
        first = at - at % fanout
        last = np.minimum(first + fanout, len(digests))
        cuts = zip((first * DIGEST).tolist(), (at * DIGEST).tolist(), (last * DIGEST).tolist(), (at // fanout).tolist(), strict=True)
        paths = [[text[a:b], text[b + DIGEST : c], *paths[up]] for a, b, c, up in cuts]
    return paths


def fold(digest: str, path: list[str]) -> str:
    """The root that follows from a node's digest and its siblings."""
    for before, after in zip(path[::2], path[1::2], strict=True):
        digest = sha256((before + digest + after).encode()).hexdigest()
    return digest


def _matrix(nodes: pa.Table) -> np.ndarray:
    return np.frombuffer("".join(nodes["digest"].to_pylist()).encode(), np.uint8).reshape(-1, DIGEST)


def numbered(rows: DataFrame, group: str, order: list[str], label: str) -> DataFrame:
    """Adds ``pos``, each row's place from 0 within its group, and ``n``, the group's rows.

    Rows are range-partitioned on group and order, so a group of any size is
    spread over tasks; a row's place is its place in its part and the rows of
    its group in the parts before. Rows equal in all of these are numbered in any
    order. The result is settled.
    """
    keys = [F.col(group), *[F.col(c) for c in order], F.col("__tie")]
    # Ties have a key of their own, so that many equal rows don't meet in one range.
    dealt = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__tie")
    placed = settle(dealt.withColumn("__at", F.monotonically_increasing_id()), f"{label}-placed")
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__rows"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        group,
        "__part",
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first")).alias("__shift"),
        F.sum("__rows").over(Window.partitionBy(group)).alias("n"),
    )
    counts, seen = settle_measured(counts, f"{label}-counts", rows=F.count(F.lit(1)))
    few = seen["rows"] <= BROADCAST_COUNTS
    found = placed.join(F.broadcast(counts) if few else counts, [group, "__part"])
    return found.withColumn("pos", F.col("__at") + F.col("__shift")).drop("__at", "__part", "__shift")


def climb(nodes: DataFrame, fanout: int, levels: int, label: str) -> list[DataFrame]:
    """Tables of nodes, each of the roots of the blocks of the one before; in the
    last every tree is one node. A tree that has ended stays in the table in
    which it did (``n`` = 1) and is in none after it."""
    block = fanout**levels

    def roots(key: tuple, nodes: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("pos")
        n = nodes["n"][0].as_py()
        root = hash_block(_matrix(nodes), n <= block, fanout, levels)[-1]
        return pa.table({"grp": [key[0].as_py()], "pos": [key[1].as_py()], "n": [-(-n // block)], "digest": [root.tobytes().decode()]})

    nodes, seen = settle_measured(nodes, f"{label}-0", most=F.max("n"))
    made, most = [nodes], seen["most"] or 0
    while most > 1:
        above = made[-1].where("n > 1").select("grp", "pos", "n", "digest", F.expr(f"pos div {block}").alias("block")).groupBy("grp", "block").applyInArrow(roots, NODE)
        above, seen = settle_measured(above, f"{label}-{len(made)}", most=F.max("n"))
        made.append(above)
        most = seen["most"] or 0
    return made


def descend(tables: list[DataFrame], tails: DataFrame, fanout: int, levels: int, schema: str, leaf_rows: Callable[[pa.Table, list, str], pa.Table]) -> DataFrame:
    """From the trees' tops down to the nodes of ``tables[0]``: ``leaf_rows`` makes
    the result, of this schema, from a block's nodes, their paths and their tree's root.

    ``tails``: of each tree ``grp``, its root ``top`` and the siblings above that
    (``path``). Each block meets the path of its root in a cogroup, so a path is
    shuffled once for a block, not for a row.
    """
    block = fanout**levels
    inner = "grp string, pos long, top string, path array<string>"

    def down(out: Callable[[pa.Table, list, str], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
            nodes = nodes.sort_by("pos")
            made = hash_block(_matrix(nodes), nodes["n"][0].as_py() <= block, fanout, levels)
            return out(nodes, sibling_paths(made, above["path"][0].as_py(), fanout), above["top"][0].as_py())

        return paths

    def inner_rows(nodes: pa.Table, paths: list[list[str]], top: str) -> pa.Table:
        return pa.table({"grp": nodes["grp"], "pos": nodes["pos"], "top": pa.array([top] * len(paths), pa.string()), "path": pa.array(paths, pa.list_(pa.string()))})

    found = None
    for depth in range(len(tables) - 1, -1, -1):
        # Trees that ended before have no blocks here, but a lone leaf is one.
        nodes = tables[depth].where("n > 1") if depth else tables[depth]
        # The block that is its whole tree has its path from outside, the others from the table above.
        above = nodes.where(f"pos = 0 and n <= {block}").select("grp").join(tails, "grp").select(F.col("grp").alias("of"), F.lit(0).cast("long").alias("under"), "top", "path")
        if found is not None:
            above = above.unionByName(found.select(F.col("grp").alias("of"), F.col("pos").alias("under"), "top", "path"))
        out, made = (inner_rows, inner) if depth else (leaf_rows, schema)
        nodes = nodes.withColumn("block", F.expr(f"pos div {block}"))
        found = nodes.groupBy("grp", "block").cogroup(above.groupBy("of", "under")).applyInArrow(down(out), made)
        if depth:
            found = settle(found, "merkle-paths")
    return found


def merkle_manifest(
    docs: DataFrame, fields: list[str], id_col: str = "doc_id", group_col: str = "source", offered: dict[str, Column] | None = None, fanout: int = FANOUT, levels: int = BLOCK_LEVELS
) -> DataFrame:
    """A leaf for each row, a tree for each group over its leaves by ascending id,
    and a tree over the groups' roots in order of their names (null first, else by
    UTF-8 bytes); then each row's inclusion proof, checked.

    A leaf is the SHA-256 (lowercase hex) of the fields one after another, each
    as ``encoded`` has it. While a tree has several nodes, every ``fanout``
    consecutive ones become the SHA-256 of their digests' text, the last run even
    if it is one node. The proof is the siblings level by level from leaf to root,
    left to right. ``offered`` replaces fields in the copy of a row that is
    checked against the proof: what a holder of the data would present.

    Returns for each row: the id, ``leaf``, ``subroot``, ``root``,
    ``proof_sha256`` (of the joined siblings; of nothing, where a row is all there
    is), ``folded_root`` (from the offered leaf and the proof) and ``verified``
    (that it equals ``root``). A null field differs from an empty one. Null ids come
    first in their group; rows that repeat an id follow each other by their leaves,
    and equal rows by chance, which no digest shows. Other columns are not read.
    An empty table gives an empty result. Whole texts, of any length, are hashed where they are
    scanned; digests alone are shuffled, in blocks of at most fanout ** levels.
    """
    leaf = F.sha2(F.concat(*[encoded(docs[c]) for c in fields]), 256)
    shown = F.sha2(F.concat(*[encoded((offered or {}).get(c, docs[c])) for c in fields]), 256)
    # A prefix tells a null group from an empty one, and sorts before all names.
    grp = F.coalesce(F.concat(F.lit("="), docs[group_col].cast("string")), F.lit(""))
    rows = settle(docs.select(grp.alias("grp"), docs[id_col].alias("id"), leaf.alias("digest"), shown.alias("shown")), "merkle-leaves")
    trees = climb(numbered(rows, "grp", ["id", "digest"], "merkle"), fanout, levels, "merkle-level")

    tops = trees[0].where("n = 1").select("grp", "digest")
    for nodes in trees[1:]:
        tops = tops.unionByName(nodes.where("n = 1").select("grp", "digest"))
    crown = numbered(tops.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest"), "all", ["name"], "merkle-crown")
    crown = climb(crown.withColumnRenamed("all", "grp"), fanout, levels, "merkle-crown-level")
    top = crown[-1].where("n = 1").select("digest").first()
    root = top["digest"] if top else ""

    def crown_rows(nodes: pa.Table, paths: list[list[str]], _: str) -> pa.Table:
        return pa.table({"grp": nodes["name"], "top": nodes["digest"], "path": pa.array(paths, pa.list_(pa.string()))})

    def leaf_rows(nodes: pa.Table, paths: list[list[str]], top: str) -> pa.Table:
        folded = [fold(shown, path) for shown, path in zip(nodes["shown"].to_pylist(), paths, strict=True)]
        proofs = [sha256("".join(path).encode()).hexdigest() for path in paths]
        text = {"subroot": [top] * len(paths), "proof_sha256": proofs, "folded_root": folded}
        return pa.table({id_col: nodes["id"], "leaf": nodes["digest"], **{c: pa.array(v, pa.string()) for c, v in text.items()}})

    spark = docs.sparkSession
    above = spark.createDataFrame([("", root, [])], "grp string, top string, path array<string>")
    tails = settle(descend(crown, above, fanout, levels, "grp string, top string, path array<string>", crown_rows), "merkle-tails")
    made = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), *[T.StructField(c, T.StringType()) for c in ("leaf", "subroot", "proof_sha256", "folded_root")]])
    found = descend(trees, tails, fanout, levels, made, leaf_rows)
    return found.select(id_col, "leaf", "subroot", F.lit(root).alias("root"), "proof_sha256", "folded_root", (F.col("folded_root") == root).alias("verified"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    touched = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    text = F.when(touched, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle_manifest(docs, ["doc_id", "source", "lang", "n_chars", "text"], offered={"text": text})


#: Names of texts are encoded as in ``encoded``; ``crc`` is the reflected CRC-32, a byte at a time from a table that is computed first.
SQL = """
WITH RECURSIVE
bits AS (
  SELECT b.i AS i, list_reduce(list_concat([b.i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v
  FROM (SELECT unnest(range(256)) AS i) AS b),
crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits),
named AS (
  SELECT doc_id, source, concat(
      coalesce(concat(strlen(CAST(doc_id AS VARCHAR)), ':', CAST(doc_id AS VARCHAR)), '-'),
      coalesce(strlen(source) || ':' || source, '-'),
      coalesce(strlen(lang) || ':' || lang, '-'),
      coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-')) AS head,
    text,
    xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d))),
      lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1])), 4294967295) AS crc
  FROM documents, crc_table),
offers AS (
  SELECT *, CASE WHEN crc % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS offered FROM named),
leaves AS (
  SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(offered) || ':' || offered, '-')) AS shown FROM offers),
nodes AS (
  SELECT source, 0 AS depth, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM leaves
  UNION ALL
  SELECT source, depth + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3 FROM nodes WHERE n > 1 GROUP BY source, depth, pos // 3, n),
crown AS (
  SELECT 0 AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, digest, count(*) OVER () AS n, source FROM nodes WHERE n = 1
  UNION ALL
  SELECT depth + 1, pos // 3, sha256(string_agg(digest, '' ORDER BY pos)), (n + 2) // 3, NULL FROM crown WHERE n > 1 GROUP BY depth, pos // 3, n),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM leaves),
runs AS (SELECT source, depth, pos // 3 AS run, list(digest ORDER BY pos) AS digests FROM nodes GROUP BY source, depth, pos // 3),
crown_runs AS (SELECT depth, pos // 3 AS run, list(digest ORDER BY pos) AS digests FROM crown GROUP BY depth, pos // 3),
crown_top AS (SELECT max(depth) AS top, max(digest) FILTER (WHERE n = 1) AS root FROM crown),
tops AS (SELECT source, max(depth) AS top, max(digest) FILTER (WHERE n = 1) AS subroot FROM nodes GROUP BY source),
walk AS (
  SELECT p.doc_id, p.source, p.pos AS seat, p.leaf, p.pos, 0 AS depth, false AS up, p.shown AS digest, '' AS proof FROM placed p
  UNION ALL
  SELECT w.doc_id, w.source, w.seat, w.leaf,
    CASE WHEN NOT w.up AND w.depth = t.top THEN c.pos ELSE w.pos // 3 END,
    CASE WHEN NOT w.up AND w.depth = t.top THEN 0 ELSE w.depth + 1 END,
    w.up OR w.depth = t.top,
    CASE WHEN NOT w.up AND w.depth = t.top THEN w.digest ELSE sha256(array_to_string(list_concat(coalesce(r.digests, k.digests)[:w.pos % 3], [w.digest], coalesce(r.digests, k.digests)[w.pos % 3 + 2:]), '')) END,
    CASE WHEN NOT w.up AND w.depth = t.top THEN w.proof ELSE w.proof || array_to_string(list_concat(coalesce(r.digests, k.digests)[:w.pos % 3], coalesce(r.digests, k.digests)[w.pos % 3 + 2:]), '') END
  FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source CROSS JOIN crown_top g
  LEFT JOIN crown c ON NOT w.up AND w.depth = t.top AND c.depth = 0 AND c.source IS NOT DISTINCT FROM w.source
  LEFT JOIN runs r ON NOT w.up AND w.depth < t.top AND r.source IS NOT DISTINCT FROM w.source AND r.depth = w.depth AND r.run = w.pos // 3
  LEFT JOIN crown_runs k ON w.up AND k.depth = w.depth AND k.run = w.pos // 3
  WHERE NOT w.up OR w.depth < g.top)
SELECT w.doc_id, w.leaf, t.subroot, g.root, sha256(w.proof) AS proof_sha256, w.digest AS folded_root, w.digest = g.root AS verified
FROM walk w JOIN tops t ON w.source IS NOT DISTINCT FROM t.source CROSS JOIN crown_top g
WHERE w.up AND w.depth = g.top
"""
