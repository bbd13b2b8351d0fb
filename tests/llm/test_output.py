import os
import random
import zlib

import numpy as np
import pytest
from plain_mixing import plain_copies
from pyspark.sql import functions as F

from loomspan.llm import mixing, sharding, tokens
from loomspan.llm.common import word_count

EDGE = [(1, None, "a"), (2, "", "b"), (2, "", "b"), (None, "x y", None), (4, "é ü", "c"), (5, "w " * 60_000, "a"), (6, " \n", "b")]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*r, 9, 9, "clash") for r in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size int, shard int, target string")


@pytest.mark.parametrize("text", [None, "", " ", "a", " a ", "a\tb\nc\x0bd\x0ce\rf", "a b", "é  ü", "\x1f x"])
def test_word_count(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(word_count(F.col("t")).alias("n")).first()["n"]
    assert got == len((text or "").encode().split())


def check_shards(rows, shards, largest):
    sums = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(sums) - min(sums) <= 2 * largest
    assert all(sorted(s) == list(range(len(s))) for s in slots)


@pytest.mark.parametrize("hot", [0, 400])
@pytest.mark.parametrize("shards", [1, 3, 8])
def test_shards_are_even_and_slots_gapless(spark, hot, shards):
    rng = random.Random(hot)
    rows = [(i, "x" * rng.randrange(200)) for i in range(600)] + [(1000 + i, "one text with many copies") for i in range(hot)] + [(7, "again"), (7, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sharding.shard_documents(df, shards, least_ranges=16).collect()
    assert len(got) == len(rows) and sorted((r["doc_id"], r["text"]) for r in got) == sorted(rows)
    assert all(r["size"] == len(r["text"]) + 1 for r in got)
    check_shards(got, shards, 201)


def test_equal_texts_stay_together_and_ranges_have_no_ceiling(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, f"text {i // 3} " + "x" * rng.randrange(60)) for i in range(3000)] + [(9000 + i, "pair of one text") for i in range(2)]
    df = spark.createDataFrame([(i, rows[3 * (i // 3)][1] if i < 3000 else t) for i, t in rows], "doc_id long, text string")
    homes = {}
    got = sharding.shard_documents(df, 8).collect()
    for r in got:
        homes.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())
    check_shards(got, 8, 3 * 75)
    monkeypatch.setattr(sharding, "MOST_RANGES", 16)
    monkeypatch.setattr(sharding, "BROADCAST_CELLS", 5)
    many = sharding.shard_documents(df, 8, range_bytes=500, least_ranges=8).collect()
    assert len(many) == len(rows)
    check_shards(many, 8, 3 * 75)


def test_groups_stay_whole_unless_no_shard_has_room(spark, monkeypatch):
    """Groups of 3 % to 90 % of a shard are whole; one of two shards is parted; all is even but for a hundredth of a shard."""
    monkeypatch.setattr(sharding, "CELL_ROWS", 100)
    rng = random.Random(4)
    texts = [f"{i} " + "x" * rng.randrange(40) for i in range(4000)]
    groups = {"a" * 30: 700, "b" * 99: 120, "c" * 9: 300, "d" * 20: 60, "e" * 50: 900, None: 500}
    rows = list(enumerate(texts + [t for t, n in groups.items() for _ in range(n)]))
    rng.shuffle(rows)
    got = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8, least_ranges=16).collect()
    assert sorted((r["doc_id"], r["text"] or "") for r in got) == sorted((i, t or "") for i, t in rows)
    homes = {}
    for r in got:
        homes.setdefault(r["text"], set()).add(r["shard"])
    share = sum(r["size"] for r in got) / 8
    assert 2 * share > 51 * 900 > share > 31 * 700 and len(homes.pop("e" * 50)) == 2
    assert all(len(h) == 1 for h in homes.values())
    check_shards(got, 8, share / 100)


@pytest.mark.parametrize("groups", [[], [(1, 10, 1)], [(1, 10, 50), (2, 5, 7), (3, 900, 1)], [(k, 3, 40 + k) for k in range(30)]])
def test_placed_groups_cover_their_rows(groups):
    share = sum(z * n for _, z, n in groups) / 4 + 3
    pieces, room = sharding.place_groups(groups, 4, share)
    for key, size, rows in groups:
        own = sorted((a, b) for k, _, _, a, b, _ in pieces if k == key)
        assert own[0][0] == 0 and own[-1][1] == rows and all(x[1] == y[0] for x, y in zip(own, own[1:], strict=False))
    slots = {}
    for _, _, shard, first, end, base in pieces:
        slots.setdefault(shard, []).extend(range(base + first, base + end))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(room) == pytest.approx(4 * share - sum(z * n for _, z, n in groups))


def test_shards_of_edge_cases(spark, edge):
    got = sharding.shard_documents(edge)
    assert got.columns == ["doc_id", "text", "source", "target", "size", "shard", "slot"]
    rows = got.collect()
    assert len(rows) == len(EDGE) and sorted(r["size"] for r in rows) == sorted(len((t or "").encode()) + 1 for _, t, _ in EDGE)
    assert sharding.shard_documents(edge.where("doc_id = 77")).count() == 0
    again = sharding.shard_documents(edge).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_range_lookup(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 5, 16, 100):
        bounds = sorted(rng.randrange(-50, 50) for _ in range(n))
        keys = list(range(-55, 55))
        got = sharding.with_range(spark.createDataFrame([(k,) for k in keys], "k long"), "k", bounds, "r").collect()
        assert [r["r"] for r in got] == [sum(b <= k for b in bounds) for k in keys] == [sharding.range_of(k, bounds) for k in keys]


def fill(sizes, weights, cap):
    """Resharing the excess by weight, again and again."""
    total, targets, free = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        share = {i: left * weights[i] / sum(weights[j] for j in free) for i in free}
        over = {i for i in free if share[i] > cap * sizes[i]}
        if not over:
            for i in free:
                targets[i] = share[i]
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        free -= over
    return targets


@pytest.mark.parametrize("seed", range(5))
def test_targets_match_resharing(spark, seed):
    rng = random.Random(seed)
    sizes = {s: rng.choice([0, 1, 10, 1000, 50]) for s in [None, "a", "b", "é", "z", "C", "d"]}
    got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    want = fill([sizes[s] for s in order], [(5, 2, 1)[i % 3] for i in range(len(order))], 3)
    assert [got[s] for s in order] == pytest.approx(want) and sum(got.values()) == pytest.approx(sum(sizes.values()))


def test_mix_comes_near_its_targets_and_repeats_itself(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(1, 9)), rng.choice(["a"] * 6 + ["b", "c", "d", None])) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert len(got) == len(rows) and max(r["copies"] for r in got) <= 3 and all(r["taken"] == r["size"] * r["copies"] for r in got)
    for source in ("a", "b", "c", "d", None):
        own = [r for r in got if r["source"] == source]
        assert sum(r["taken"] for r in own) == pytest.approx(own[0]["target"], rel=0.01) and sum(r["size"] for r in own) == own[0]["source_size"]
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix_sources(df.repartition(7)).collect()))


def test_small_sources_of_long_rows_meet_their_targets(spark):
    """Each source's taken words are off its target by no more than half of one row; rows of null id don't share a draw."""
    rng = random.Random(5)
    rows = [(i if i % 3 else None, " ".join(["w"] * rng.randrange(1, 400)) + f" {i}", f"s{i % 23}") for i in range(700)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r["copies"] for r in got if r["doc_id"] is None and r["source"] == "s1"} == {r["copies"] for r in got if r["source"] == "s1"}
    for source in {r["source"] for r in got}:
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.75 * max(r["size"] for r in own)


def test_mix_equals_the_plain_version(spark):
    rng = random.Random(15)
    rows = [(rng.choice([i, i, i, 5, None]), " ".join(["w"] * rng.choice([0, 1, 2, 3, 9, 40])) + rng.choice(["", f" {i}"]), rng.choice([None, "", "a", "a", "a", "b", "é"])) for i in range(900)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    want = [(*r, n) for r, n in zip(rows, plain_copies(rows), strict=True)]
    assert sorted(((r["doc_id"], r["text"], r["source"], r["copies"]) for r in got), key=repr) == sorted(want, key=repr)


def test_sources_of_one_document_are_taken_as_often_as_their_rate_says(spark):
    rows = [(i, "w w", f"s{i:05d}") for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for turn, rate in enumerate((1.875, 0.75, 0.375)):
        copies = [r["copies"] for r in got if int(r["source"][1:]) % 3 == turn]
        assert all(r["target"] == 2 * rate for r in got if int(r["source"][1:]) % 3 == turn)
        assert abs(sum(copies) / 1000 - rate) < 0.07 and set(copies) == {int(rate), int(rate) + 1}


def test_parts_of_large_classes_keep_the_law(spark):
    """Any cells give each source its target to about a row; equal draws go together."""
    rng = random.Random(8)
    rows = [(i if i % 50 else 7, " ".join(["w"] * rng.choice([0, 1, 5, 5, 5, 90])), rng.choice("aaab")) for i in range(3000)]
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string"), cell_rows=40).collect()
    assert len(got) == 3000
    for source in "ab":
        own = [r for r in got if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 4 * 90
    again = {}
    for r in got:
        if r["doc_id"] == 7:
            again.setdefault((r["source"], r["size"]), set()).add(r["copies"])
    assert all(len(v) == 1 for v in again.values())


def test_targets_of_very_many_sources(spark):
    sizes = spark.range(60_000).select(F.format_string("s%06d", "id").alias("source"), (F.col("id") % 97 + 1).alias("source_size"))
    got = mixing.source_targets(sizes).agg(F.sum("target").alias("t"), F.sum("source_size").alias("s"), F.max(F.col("target") / F.col("source_size")).alias("most")).first()
    assert got["t"] == pytest.approx(got["s"]) and got["most"] <= 3


def test_mix_of_edge_cases(spark, edge):
    got = mixing.mix_sources(edge)
    assert sorted(got.columns) == sorted(["doc_id", "text", "source", "shard", "size", "source_size", "target", "copies", "taken"])
    rows = got.collect()
    assert len(rows) == len(EDGE) and all(r["taken"] == 0 for r in rows if not (r["text"] or "").split())
    assert mixing.mix_sources(edge.where("doc_id = 77")).count() == 0
    assert sum(r["target"] for r in mixing.mix_sources(edge.where("doc_id = 2")).collect()) == 0


BPE = pytest.importorskip("public_tokenizers").path
TEXTS = [
    "a b\n c", "  x", "x ", "<|endoftext|> q", "it's, \"ok\".\nNow\tz", "a\n\nb", "", None, "é, ñ.", "foo bar, baz", "12, 3.", "don't. we'll,", "\n", " ", "a" * 5000, "tab\tand more 　 x", "A!! B!! c*** d%%%",
    "x\r\ny", "ends.\nThe next, line", "mixed3digits 4ever,", "\x01 \x02 \x03", "emoji \U0001f600, and é́", "word " * 30_000,
]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_give_the_ids_of_whole_texts(name):
    with open(BPE(name), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read(), 2, "<u2", cached=40)
    texts = [t or "" for t in TEXTS]
    want = [e.ids + [2] for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.by_piece == (name == "byte_bpe_50k.json")
    for part in (texts, texts[::-1], texts[:1], [""]):
        ids, counts = encoder.encode(part)
        wanted = [want[texts.index(t)] for t in part]
        assert counts.tolist() == list(map(len, wanted)) and ids.tolist() == [i for w in wanted for i in w]


@pytest.mark.parametrize("parts", [None, 5])
def test_files_round_trip(spark, tmp_path, parts):
    rows = [(i * 3 % 101, t, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    folder = f"file:{tmp_path}/out"
    found = tokens.write_tokens(df, folder, BPE("byte_bpe_50k.json"), 2, parts=parts)
    got = tokens.read_tokens(spark, folder).orderBy(F.col("doc_id").asc_nulls_first()).collect()
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE("byte_bpe_50k.json"))
    at = 0
    for r, (i, t, _) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0])), strict=True):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert sum(p.tokens for p in found) == at and [p.base for p in found] == np.cumsum([0] + [p.tokens for p in found])[:-1].tolist()
    sizes = {p.name: os.path.getsize(f"{tmp_path}/out/{p.name}.bin") for p in found}
    assert all(sizes[p.name] == 2 * p.tokens for p in found)


def test_no_tokens(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert tokens.write_tokens(df, str(tmp_path / "none"), BPE("byte_bpe_50k.json"), 2) == []
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_files_that_cannot_be_mapped_are_read_by_ranges(tmp_path, monkeypatch):
    from pyarrow import fs

    values = np.arange(5000, dtype="<u2")
    (tmp_path / "x.bin").write_bytes(values.tobytes())
    local = tokens._File(fs.LocalFileSystem(), str(tmp_path / "x.bin"), "<u2")
    other = tokens._File(fs.SubTreeFileSystem(str(tmp_path), fs.LocalFileSystem()), "x.bin", "<u2")
    assert local.mapped is not None and other.mapped is None and local.size == other.size == 5000
    monkeypatch.setattr(tokens, "READ_IDS", 7)
    for a, z in ((0, 0), (0, 5000), (13, 44), (4990, 6000)):
        assert (local[a:z] == other[a:z]).all()
        assert tokens._crc32(other, a, min(z, 5000)) == zlib.crc32(values[a:z].astype("<u4").tobytes())


def test_width_follows_the_vocabulary(spark, tmp_path):
    import json

    wide = json.dumps({"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Whitespace"}, "post_processor": None, "decoder": None,
                       "model": {"type": "WordLevel", "vocab": {"a": 70_000, "b": 1, "?": 0}, "unk_token": "?"}})
    (tmp_path / "wide.json").write_text(wide)
    df = spark.createDataFrame([(1, "a b a"), (2, None)], "doc_id long, text string")
    tokens.write_tokens(df, str(tmp_path / "out"), str(tmp_path / "wide.json"), 2)
    assert tokens.read_manifest(str(tmp_path / "out"))[0] == "<u4"
    got = {r["doc_id"]: r["ids_crc32"] for r in tokens.read_tokens(spark, str(tmp_path / "out")).collect()}
    assert got == {1: zlib.crc32(np.array([70_000, 1, 70_000, 2], "<u4").tobytes()), 2: zlib.crc32(np.array([2], "<u4").tobytes())}
    for options in ({"width": "<u2"}, {"end_id": -1}):
        with pytest.raises(ValueError):
            tokens.write_tokens(df, str(tmp_path / "bad"), str(tmp_path / "wide.json"), **({"end_id": 2} | options))
