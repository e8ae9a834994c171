"""Sharding, spelling variants and importance resampling against brute force, published values and SQL."""
from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import documents, nothing, prose

from priorlake.llm import importance, queries, sharding, spelling
from priorlake.llm.shared import numbered

FOLDER = "/root/testdata/sf0.001"


def low(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)})


def crc(text):
    return zlib.crc32(text.encode())


def same_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{FOLDER}/{table}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda row: tuple(map(str, row))
    assert sorted(map(tuple, got.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


@pytest.mark.parametrize("name", ["op11_sharding", "op12_spelling_variants", "op13_importance_resampling"])
def test_queries_equal_their_sql(spark, name):
    same_as_sql(spark, name)


def test_numbers_of_ties_and_groups(spark):
    rows = spark.range(0, 3000, 1, 7).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 5)).alias("g"), F.lit(1).alias("tie"), "id")
    got = numbered(rows, ["g"], ["tie", "id"], "numbers", "place").collect()
    groups = {}
    for r in sorted(got, key=lambda r: r["id"]):
        assert r["place"] == groups.get(r["g"], 0)
        groups[r["g"]] = r["place"] + 1
    assert sum(groups.values()) == 3000
    assert sorted(r["place"] for r in numbered(rows, [], ["tie", "id"], "numbers", "place").collect()) == list(range(3000))


# --- sharding


def jump(key, shards):
    last, stop = -1, 0
    while stop < shards:
        last = stop
        key = (key * sharding.FACTOR + 1) % 2**64
        stop = int((last + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return last


def jump_of(doc_id, shards):
    return jump(int(hashlib.md5(("" if doc_id is None else str(doc_id)).encode()).hexdigest()[:16], 16), shards)


@pytest.mark.parametrize("key, shards, shard", [(1, 1, 0), (42, 57, 43), (0xDEAD10CC, 1, 0), (0xDEAD10CC, 666, 361), (256, 1024, 520)])
def test_jump_of_published_keys(spark, key, shards, shard):
    assert jump(key, shards) == shard
    assert spark.range(1).select(sharding.jump(F.lit(key >> 32), F.lit(key & 0xFFFFFFFF), shards)["last"]).first()[0] == shard


def test_jump_equals_the_loop_and_moves_only_into_new_shards(spark):
    keys = spark.range(3000)
    for shards in (1, 2, 7, 40, 1000):
        rows = keys.select("id", sharding.shard_columns(F.col("id"), shards).alias("s")).select("id", "s.*").collect()
        for r in rows:
            assert r["shard"] == jump_of(r["id"], shards) and r["grown"] == jump_of(r["id"], shards + 1)
            assert r["grown"] in (r["shard"], shards)
        moved = sum(r["grown"] != r["shard"] for r in rows) / len(rows)
        assert abs(moved - 1 / (shards + 1)) < 0.03
    sizes = Counter(jump_of(k, 40) for k in range(3000))
    assert len(sizes) == 40 and max(sizes.values()) < 2 * 3000 / 40


def test_walks_longer_than_the_first_steps(spark, monkeypatch):
    monkeypatch.setattr(sharding.math, "log", lambda n: 0.0)  # four steps only, so that many rows need the rest
    rows = spark.range(500).select("id", sharding.shard_columns(F.col("id"), 5000).alias("s")).select("id", "s.*").collect()
    assert all(r["shard"] == jump_of(r["id"], 5000) for r in rows)


def test_shards_of_awkward_rows(spark, tmp_path):
    docs = documents(spark, [(20, "long " * 400_000)])
    rows = sharding.sharded(docs).collect()
    texts = docs.select("doc_id", "text").collect()
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 16, crc(t or "")) for i, t in texts)
    for r in rows:
        assert r["shard"] == jump_of(r["doc_id"], 40) and r["grown_shard"] == jump_of(r["doc_id"], 41) and r["law"] == "key"
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    assert sharding.sharded(nothing(spark)).count() == 0
    with pytest.raises(ValueError):
        sharding.sharded(docs, 0)
    path = str(tmp_path / "shards")
    sharding.write_shards(docs, path, 5, 2)
    back = spark.read.parquet(path)
    assert back.count() == docs.count() and set(docs.columns) < set(back.columns)
    assert all(r["shard"] == jump_of(r["doc_id"], 5) for r in back.collect())


def test_repeated_rows_of_one_id_get_places_of_their_own(spark):
    docs = spark.range(0, 4000, 1, 9).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.lit("same").alias("text"), F.lit("x").alias("shard"))
    rows = sharding.sharded(docs, 8).collect()
    hot = jump_of(None, 8)
    assert sorted(r["slot"] for r in rows if r["shard"] == hot) == list(range(sum(r["shard"] == hot for r in rows)))


# --- spelling variants


def words_of(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[a-zÀ-ÿ]+", low(text)):
            h = crc(f"{'' if doc_id is None else doc_id}:{run}")
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_of(rows):
    n = words_of(rows)
    out = {}
    for w in n:
        near = sorted((x for x in n if x != w and abs(len(x) - len(w)) < 2 and one_edit(w, x)), key=lambda x: (-n[x], x))
        form = near[0] if near and n[near[0]] >= 2 * n[w] else None
        out[w] = [form, n[w], len(near), n.get(form)]
    for w, row in out.items():
        root = w
        while out[root][0]:
            root = out[root][0]
        row.insert(1, root)
    return {w: tuple(row) for w, row in out.items()}


def misspelt(seed=5):
    rng = random.Random(seed)
    base = ["river", "stone", "lights", "waterfall", "gréen", "àéîõüÿ", "bookkeeper", "aaaaa", "abcde" * 14, "é" * 70]
    rows = []
    for doc_id in range(120):
        words = []
        for _ in range(60):
            w = rng.choice(base)
            for _ in range(rng.choice([0, 0, 0, 1, 1, 2])):
                k = rng.randrange(len(w))
                w = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abzÿé") + w[k:], w[:k] + rng.choice("abzÿé") + w[k + 1 :]])
            words.append(rng.choice([w, w.upper() if w.isascii() else w]))
        rows.append((doc_id, rng.choice([" ", ", ", "1", "\n", "日"]).join(words)))
    return rows


@pytest.mark.parametrize("filter_bytes, letters", [(32 << 20, 1 << 17), (2600, 300)])
def test_variants_equal_all_pairs(spark, monkeypatch, filter_bytes, letters):
    monkeypatch.setattr(spelling, "FILTER_BYTES", filter_bytes)
    monkeypatch.setattr(spelling, "EDIT_LETTERS", letters)
    rows = misspelt()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    if filter_bytes < 10_000:
        made = list(spelling.filters(spelling.vocabulary(docs), filter_bytes))
        assert len(made) > 1 and all(f.blocks.nbytes <= filter_bytes for f in made)
    got = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.variant_groups(docs).collect()}
    want = variants_of(rows)
    assert got == want
    assert any(row[1] not in (w, row[0]) for w, row in want.items())  # a chain of forms


def test_filters_have_no_false_negatives_and_few_false_positives(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(rng.randint(5, 9))) for _ in range(20_000)})
    vocab = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    [known] = spelling.filters(vocab)
    e = spelling.Edits(words)
    assert len(known.perhaps(e.hash, spelling.lengths_of(e.size))) == len(words)
    other = sorted({"".join(rng.choice("ijklmnop") for _ in range(rng.randint(5, 9))) for _ in range(20_000)})
    e = spelling.Edits(other)
    assert len(known.perhaps(e.hash, spelling.lengths_of(e.size))) < 0.01 * len(other)


def test_edit_hashes_are_those_of_the_edited_words():
    words = ["abcabc", "éaaz", "z" * 200]
    e = spelling.Edits(words)
    at, hashes = e.deletions()
    edited = [words[w][:k] + words[w][k + 1 :] for w, k in zip(e.word[at], e.place[at])]
    assert (spelling.Edits(edited).hash == hashes).all() and len(set(edited)) == len(edited)
    at, hashes = e.replacements(0xFF, np.arange(len(e.letter)))
    assert (spelling.Edits([words[w][:k] + "ÿ" + words[w][k + 1 :] for w, k in zip(e.word[at], e.place[at])]).hash == hashes).all()


def test_words_of_awkward_rows(spark, monkeypatch):
    docs = documents(spark, [(21, "ÉCOLE école× école " * 30), (22, "long" * 30_000 + " " + "éé" * 20_000)] + [(30 + k, "wörter" * 9 + "A" * 7) for k in range(3)])
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = words_of(rows)
    for size in (4 << 20, 50):
        monkeypatch.setattr(spelling, "SLICE_BYTES", size)
        got = {r["word"]: r["n"] for r in spelling.vocabulary(docs).collect()}
        assert got == want
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(spelling, "SLICE_BYTES", size)
        text = "école 日本 naïveŁéé x".encode().lower()
        assert [r for a, b in spelling.text_slices(text) for r in spelling.RUN.findall(text, a, b)] == spelling.RUN.findall(text)
    assert spelling.variant_groups(nothing(spark)).count() == 0
    alone = spelling.variant_groups(spark.createDataFrame([(1, "single single single " * 2)], "doc_id long, text string")).collect()
    assert [tuple(r) for r in alone if r["word"] == "single"] in ([("single", None, "single", 6, 0, None)], [])


# --- importance resampling


def features_of(text, longest):
    words = re.findall("[^\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+", low(text))
    return words, [" ".join(words[k : k + n]) for n in range(1, longest + 1) for k in range(len(words) - n + 1)]


def drawn_of(rows, target, longest=1, buckets=10_000, least=20, percent=10):
    bucket = lambda f: crc(f) % buckets
    found = [features_of(t, longest) for _, t in rows]
    source = Counter(bucket(f) for _, fs in found for f in fs)
    goal = Counter(bucket(f) for t in target for f in features_of(t, longest)[1])
    s_all, t_all = sum(source.values()), sum(goal.values())
    gain = lambda b: math.floor(1000 * math.log((goal[b] + 1) * float(s_all + buckets) / ((source[b] + 1) * float(t_all + buckets))))
    out = []
    for (doc_id, _), (words, fs) in zip(rows, found):
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in fs)
        out.append([doc_id, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(words) >= least])
    fit = sorted((k for k, r in enumerate(out) if r[4]), key=lambda k: (-out[k][3], out[k][0] is None, out[k][0] or 0, k))
    ranks = {k: place + 1 for place, k in enumerate(fit[: percent * len(fit) // 100])}
    return [(*r[:4], ranks.get(k)) for k, r in enumerate(out)]


@pytest.mark.parametrize("longest, buckets, slice_bytes", [(1, 10_000, 4 << 20), (3, 70_000, 40)])
def test_draw_equals_brute_force(spark, monkeypatch, longest, buckets, slice_bytes):
    monkeypatch.setattr(importance, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(importance, "CUTS", 3)
    rng = random.Random(8)
    docs = documents(spark, [(100 + k % 90, prose(rng, rng.randint(0, 60)) + rng.choice(["", " É日", " X-1"])) for k in range(180)] + [(400, "very long words " * 20_000)])
    target = ["stone light walks", None, "", "GREEN houses é日", prose(rng, 50)]
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id int, text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    for percent in (10, 100, 57):
        want = drawn_of(rows, target, longest, buckets, 20, percent)
        got = importance.resample(docs, goal, percent, 20, longest, buckets)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)


def test_draw_among_ties_and_nulls(spark):
    docs = spark.range(0, 2000, 1, 8).select(F.when(F.col("id") % 3 > 0, F.col("id") % 50).alias("doc_id"), F.lit("one two three " * 7).alias("text"), F.lit(0).alias("score"), F.lit("x").alias("rank"))
    goal = spark.createDataFrame([("one two",)], "text string")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for percent in (10, 70, 95):
        got = importance.resample(docs, goal, percent).collect()
        want = drawn_of(rows, ["one two"], percent=percent)
        key = lambda r: tuple(map(str, r))
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, percent * 20 + 1))


def test_draw_of_nothing(spark):
    docs, goal = documents(spark), spark.createDataFrame([], "item_id int, text string")
    assert importance.resample(nothing(spark), goal).count() == 0
    got = importance.resample(docs, goal, least_words=10**6).collect()
    assert len(got) == docs.count() and all(r["rank"] is None for r in got)
    assert {r["weight"] for r in got if r["n_features"] == 0} == {0}


@pytest.mark.parametrize("values", [[5], [3, 3, 3, 3], list(range(-50, 50)), [-(2**63), 2**63 - 1, 0, 0, 1], [None, 2, None, 1]])
def test_bisection_finds_every_order_statistic(spark, monkeypatch, values):
    monkeypatch.setattr(importance, "CUTS", 3)
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    known = sorted(v for v in values if v is not None)
    for most in {1, 2, len(known) // 2 + 1, len(known)} - {0}:
        if most <= len(known):
            value, below = importance.bisected(rows, "v", most)
            assert value == known[most - 1] and below == sum(v < value for v in known)
    assert importance.bisected(rows, "v", len(known) + 1) is None and importance.bisected(rows, "v", 0) is None
