"""Each stage of the pipeline against a plain version on its own input."""

import os
import random

import pytest
from plain_mixing import plain_copies

import corpus_pipeline
from loomspan.llm import decontaminate, quality, simhash

DATA = "/root/testdata/sf0.001"


def leave(rows, linked, first):
    """Of each component of linked rows the first."""
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if label[i] != label[j] and linked(i, j):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    groups = {}
    for r, x in zip(rows, label, strict=True):
        groups.setdefault(x, []).append(r)
    return [min(g, key=first) for g in groups.values()]


def write(spark, tmp, docs):
    rng = random.Random(1)
    sf = str(tmp)
    labels = [(i, int("%" not in (t or ""))) for i, t, *_ in docs if i is not None and rng.random() < 0.8]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "0 AS toxic").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{k}" for k in range(30))), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    rng = random.Random(3)
    word = lambda: rng.choice("abcdefgh") + str(rng.randrange(400))
    docs = []
    for i in range(240):
        words = [word() for _ in range(60)]
        if i % 6 == 0:
            words = [w + "%%%" for w in words]
        if i % 10 == 1:
            words[20:20] = [f"bench{k}" for k in range(30)]
        docs.append((i, " ".join(words), "en", f"s{i % 4}" if i % 5 else None, 1))
    docs += [(700 + i, " ".join([w if k != 30 else "changed" for k, w in enumerate(docs[10 * i + 2][1].split())]), "en", "s2", 1) for i in range(12)]
    docs += [(300 + i, docs[1 + 6 * i][1], "en", "s1", 1) for i in range(20)] + [(i, t, a, b, c) for i, t, a, b, c in docs[7:9]] + [(500, None, None, None, None), (501, "", "", "", 0), (None, docs[13][1], "en", "s2", 1)]
    return write(spark, tmp_path_factory.mktemp("tables"), docs)


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        got = [tuple(r) for r in out.select(*docs.columns).collect()]
        rows = [tuple(r) for r in docs.collect()]
        if name == "shard":
            assert out.columns == [*docs.columns, "size", "shard", "slot"]
            assert sorted(map(repr, got)) == sorted(map(repr, rows))
            placed, shards = out.collect(), {}
            assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in placed)
            for r in placed:
                shards.setdefault(r["shard"], []).append(r)
            sums = [sum(r["size"] for r in own) for own in shards.values()]
            assert len(shards) == corpus_pipeline.SHARDS and max(sums) - min(sums) <= 4 * max(r["size"] for r in placed)
            assert all(sorted(r["slot"] for r in own) == list(range(len(own))) for own in shards.values())
            homes = {}
            for r in placed:
                homes.setdefault(r["text"], set()).add(r["shard"])
            assert all(len(h) == 1 for h in homes.values())
            return
        assert out.columns == docs.columns
        if name == "quality":
            model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            want = [r for r in rows if quality.score_features(model, *quality.features(r[1])) >= corpus_pipeline.LEAST_QUALITY]
            assert not any("%" in (r[1] or "") for r in want)
        elif name == "near_duplicates":
            prints = [simhash.fingerprint(r[1]) & (2**64 - 1) for r in rows]
            first = lambda r: (r[0] is None, r[0] or 0)
            sets = [set(simhash.shingles(r[1]).tolist()) for r in rows]
            close = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 3 or (sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
            want = leave(rows, close, first)
            assert len(want) < len(leave(rows, lambda i, j: prints[i] == prints[j], first)) < len(rows)
        elif name == "decontaminate":
            bench = [f"bench{k}" for k in range(30)]
            runs = lambda t: any(sum(a == b for a, b in zip(bench[x : x + 13], t[y : y + 13], strict=True)) >= 10 for x in range(18) for y in range(len(t) - 12))
            want = [r for r in rows if not runs((r[1] or "").split())]
            assert len(want) < len(rows) and decontaminate.WINDOW == 13
        else:
            copies = plain_copies([(r[0], r[1], r[3]) for r in rows])
            want = [r for r, n in zip(rows, copies, strict=True) for _ in range(n)]
            assert len({n for n in copies}) > 1
        assert sorted(map(repr, got)) == sorted(map(repr, want)), name
        docs = spark.createDataFrame(out.collect(), docs.schema)


def test_empty_documents(spark, tmp_path):
    sf = write(spark, tmp_path, [(1, "a", "en", "s", 1)])
    none = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 9")
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, sf)
    assert none.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_registered_queries(spark):
    import duckdb

    from loomspan.llm.queries import QUERIES, SQL

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{DATA}/documents.parquet')")
    for name, sql in SQL.items():
        got = QUERIES[name](spark, DATA).toPandas()
        want = con.execute(sql).df()
        columns = sorted(want.columns)
        plain = lambda f: sorted(tuple(str(v) for v in row) for row in f[columns].astype(object).itertuples(index=False))
        assert sorted(got.columns) == columns and plain(got) == plain(want), name
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 11))
    assert corpus_pipeline.run(spark, DATA).count() > 0


def test_rows_without_an_id_of_their_own_stay(spark):
    """Null and repeated ids: only rows of one group collapse."""
    rng = random.Random(6)
    text = lambda: " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))
    one, other = text(), text()
    rows = [(None, text()) for _ in range(5)] + [(None, one), (1, one), (2, other), (2, other), (2, text()), (3, None), (None, ""), (None, other[:-1])]
    near = text()
    rows += [(None, near), (None, near), (None, near.replace(near.split()[30], "changed"))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(map(repr, [g for g in got if g[0] is not None])) == sorted(map(repr, [(1, one), (2, other), (2, rows[9][1]), (3, None)]))
    null = [t for i, t in got if i is None]
    assert len(null) == 6 and {t for _, t in rows[:5]} < set(null) and sum(" ".join(t.split()[:20]) == " ".join(near.split()[:20]) for t in null) == 1


def test_contaminated_and_clean_rows_without_an_id_of_their_own(spark, sf_dir):
    """A contaminated row of null or repeated id takes no other row of that id along."""
    bench = " ".join(f"bench{k}" for k in range(30))
    rows = [(None, f"some {bench} more"), (None, "clean one"), (None, "clean two"), (7, f"a {bench}"), (7, "clean seven"), (7, "clean seven"), (8, bench), (9, None), (None, None), (10, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for _ in range(2):  # reruns agree
        got = sorted(repr((r["doc_id"], r["text"])) for r in corpus_pipeline.drop_contaminated(spark, docs, sf_dir).collect())
        assert got == sorted(repr(r) for r in rows if "bench" not in (r[1] or ""))


def test_scoring_keeps_few_texts_and_words():
    """A worker that scored many texts of new words holds no more of them than the bounds say, and other bounds score alike."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(400)) for _ in range(400)]
    model = quality.Model(quality.np.random.default_rng(1).random(quality.BUCKETS).astype("float32"), 0.1)
    scorer, got = quality.Scorer(model), []
    for at in range(0, len(texts), quality.SCORED_TEXTS):
        got += scorer.scores(texts[at : at + quality.SCORED_TEXTS])
    assert len(scorer.known) <= 130_000 and got == quality.Scorer(model, 10**9).scores(texts)


def test_signatures_are_made_by_many_tasks(spark, monkeypatch):
    """A task makes the signatures of a bounded number of fingerprints, though a small file holds many."""
    seen, made = [], simhash._variants
    monkeypatch.setattr(simhash, "_variants", lambda nodes: seen.append(nodes.rdd.getNumPartitions()) or made(nodes))
    simhash.links(spark.range(50_000).select(simhash.F.xxhash64("id").alias("fp")).coalesce(1)).count()
    assert seen == [-(-50_000 // simhash.TASK_PRINTS)]


def test_few_python_workers(spark):
    """Pairs are compared once, by one worker a task, and no Python worker reads the small tables of sharding."""
    docs = spark.range(60).selectExpr("id AS doc_id", "id", "concat('a b c d e f g h i j ', id % 3) AS text")
    near = simhash._verified(docs.select("id", "text"), docs.selectExpr("id AS a", "id + 3 AS b"), 0.8, 5)
    plan = near._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("ArrowEvalPython") == 1 and near.count() == 57
    dealt = corpus_pipeline.shard_documents(docs.select("doc_id", "text"))
    assert "RDD" not in dealt._jdf.queryExecution().optimizedPlan().toString() and dealt.count() == 60
