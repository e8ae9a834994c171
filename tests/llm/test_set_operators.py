"""Duplicate, mixing, chat and pipeline operators against brute force and SQL."""
from __future__ import annotations

import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from samples import documents, nothing, prose

import corpus_pipeline
from priorlake.llm import chat_quotes, embedding_dedup, mixing, ngram_join, queries, shared, stages, suffix_dedup, suffix_merge
from priorlake.llm.shared import components, local_components

FOLDER = "/root/testdata/sf0.001"


def reach(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(1)
    links = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 140)] + [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    links += [(rng.randint(300, 360), rng.randint(300, 360)) for _ in range(40)]
    df = spark.createDataFrame([*links, (5, 5), (None, 7)], "a long, b long")
    nodes = {n for a, b in links if a != b for n in (a, b)}
    want = reach(nodes, links)
    assert {r["node"]: r["component"] for r in components(df).collect()} == want
    assert components(df.limit(0)).count() == 0
    pairs = np.array([(a, b) for a, b in links])
    label = local_components(400, pairs[:, 0], pairs[:, 1])
    assert all(label[n] == c for n, c in want.items())


def shingles(text):
    words = (text or "").encode().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def check_join(rows, texts):
    """rows by id against all pairs; texts: distinct ids only."""
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    tops = reach(sets, links)
    for i in sets:
        assert rows[i]["n_links"] == sum(i in p for p in links), i
        assert rows[i]["component_id"] == tops[i] and rows[i]["kept"] == (tops[i] == i)


def near_copies(seed=2, groups=6, size=9):
    rng = random.Random(seed)
    texts = {}
    for g in range(groups):
        base = prose(rng, 150).split()
        for k in range(size):
            words = list(base)
            for _ in range(k % 4):
                words[rng.randrange(len(words))] = f"w{rng.randrange(1000)}"
            texts[g * 100 + k] = " ".join(words)
    return texts


@pytest.mark.parametrize("chunk", [3, 512])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(ngram_join, "BUCKET_CHUNK", chunk)
    monkeypatch.setattr(ngram_join, "GROUP_CHUNK", chunk)
    texts = near_copies()
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_join({r["doc_id"]: r for r in ngram_join.ngram_join(df).collect()}, texts)


def test_ngram_join_of_awkward_rows(spark):
    docs = documents(spark)
    rows = ngram_join.ngram_join(docs).collect()
    by_id = {r["doc_id"]: r for r in rows}
    assert len(rows) == docs.count()
    assert by_id[2]["class_id"] == 1 and by_id[3]["component_id"] == 1 and by_id[8]["component_id"] == 7
    assert by_id[5]["n_links"] == by_id[12]["n_links"] == 0 and by_id[1]["n_links"] == 4
    assert ngram_join.ngram_join(nothing(spark)).count() == 0


def test_signatures_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(list(near_copies().values()) + [None, "", "a", "b c d", "é " * 500])
    whole = ngram_join.signatures(texts, 20)
    monkeypatch.setattr(ngram_join, "SLICE_BYTES", 300)
    parts = ngram_join.signatures(texts, 20)
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def test_forest_recall():
    levels = ngram_join.forest_levels(0.8, 20, 5, 0.9999)
    d = levels[-1]
    assert levels[0] == 5 and levels == sorted(levels, reverse=True) and 1 - (1 - 0.8**d) ** 20 >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** 20
    assert ngram_join.forest_levels(0.8, 20, 3, 0.9999) == [3] and ngram_join.forest_levels(0.3, 1, 3, 0.9999) == [3, 2, 1]


def test_prefixes_of_one_component_stay_closed(spark):
    rows = [(0, [1, 2, 3], 0), (1, [1, 2, 3], 0), (2, [1, 2, 9], 2), (3, [7, 8, 9], 3), (4, [7, 8, 9], 3), (5, [5, 5, 5], 5)]
    labels = spark.createDataFrame([(r, np.array(v, "<u4").tobytes(), c) for r, v, c in rows], "rid long, signature binary, component long")
    assert not ngram_join.open_prefixes(labels, 3, 1, 3).count()  # found deep, in one component
    assert {r["rid"] for r in ngram_join.open_prefixes(labels, 2, 1, 3).collect()} == {0, 1, 2}  # 3 and 4 are not regrouped
    got = {r["rid"]: r["group"] for r in ngram_join.forest_components(labels.select("rid", "signature"), [3, 2], 1, 3).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 3}
    deep = {r["rid"]: r["group"] for r in ngram_join.forest_components(labels.select("rid", "signature"), [3], 1, 3).collect()}
    assert deep == {0: 0, 1: 0, 3: 3, 4: 3}


def vectors_frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def make_vectors(seed=3, n=120, d=24):
    rng = np.random.default_rng(seed)
    out = []
    for k in range(n):
        v = rng.normal(size=d)
        for j in range(1 + (k % 5 == 0) * 6):
            out.append((v + (0.3 if j else 0) * rng.normal(size=d)) * rng.uniform(0.5, 2))
    return np.array(out, dtype=np.float32)


@pytest.mark.parametrize("chunk", [16, 16_384])
def test_embedding_join_equals_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(embedding_dedup, "CHUNK", chunk)
    x = make_vectors()
    df = vectors_frame(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])
    rows = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(df, cell_rows=chunk * 2).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    close = u @ u.T >= 0.9
    np.fill_diagonal(close, False)
    tops = reach(range(len(x)), list(zip(*np.nonzero(close), strict=True)))
    assert close.sum() > 50
    for i in range(len(x)):
        assert rows[i]["n_links"] == close[i].sum() and rows[i]["component_id"] == tops[i]


def test_rough_distances_miss_no_pair():
    rng = np.random.default_rng(4)
    x, y = (embedding_dedup.unit(rng.normal(size=(n, 8))) for n in (300, 500))
    y[:300] = x + rng.normal(size=x.shape) * 1e-4
    a, b = embedding_dedup.sides_of_distance(x, y)
    assert a.dtype == b.dtype == np.float32
    assert np.abs(a @ b.T - ((x[:, None] - y[None]) ** 2).sum(2)).max() < embedding_dedup.ROUGH / 2


def test_embedding_rows_that_link_with_nothing(spark):
    a = [1.0, 0.0, 2.0]
    rows = [(1, a, 1), (2, a, 2), (3, [2.0, 0.0, 4.0], 1), (4, None, 1), (5, [0.0, 0.0, 0.0], 1), (6, [1.0, None, 2.0], 1), (7, [float("nan"), 0.0, 2.0], 1), (8, [float("inf"), 0.0, 1.0], 1), (9, [], 1), (10, [1.0], 1), (None, a, 1)]
    out = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_dedup.embedding_dedup(vectors_frame(spark, rows)).collect()}
    assert out[1] == (3, 1, True) and out[2] == (3, 1, False) and out[3] == (3, 1, False) and out[None] == (3, 1, False)
    assert all(out[k] == (0, k, True) for k in range(4, 11))
    assert embedding_dedup.embedding_dedup(vectors_frame(spark, rows).limit(0)).count() == 0


def test_embeddings_of_each_length_link_among_themselves(spark):
    rng = np.random.default_rng(8)
    rows = [(1, [1.0, 0.0, 2.0], 0), (2, [1.0, 0.0, 2.0], 0), (3, [1.0, 2.0], 0), (4, [1.0, 2.0], 0), (5, [1.0, 2.1], 0), (6, [3.0], 0), (7, [4.0], 0), (8, [-4.0], 0)]
    for k, n in enumerate((5, 12, 12, 24)):
        base = rng.normal(size=n)
        rows += [(100 * (k + 1) + i, [float(c) for c in base + rng.normal(size=n) * 0.25], 0) for i in range(12)]
    frame = vectors_frame(spark, rows).withColumn("rid", F.lit(1)).withColumn("d", F.lit("x")).withColumn("cell", F.lit(None).cast("int"))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(frame).collect()}
    close = []
    for i, a, _ in rows:
        for j, b, _ in rows:
            if i != j and len(a) == len(b) and np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b) >= 0.9:
                close.append((i, j))
    tops = reach([i for i, _, _ in rows], close)
    assert got[1]["n_links"] == 1 and got[3]["n_links"] == 2 and got[6]["n_links"] == 1 and got[8]["n_links"] == 0
    for i, _, _ in rows:
        assert got[i]["n_links"] == sum(a == i for a, _ in close) and got[i]["component_id"] == tops[i]


def test_near_pairs_of_sparse_and_dense_tiles(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 64)
    rng = np.random.default_rng(11)
    heart = rng.normal(size=24)
    x = np.concatenate([rng.normal(size=(300, 24)), heart + 0.3 * rng.normal(size=(200, 24))])
    units = embedding_dedup.unit(x[rng.permutation(len(x))])
    units = np.concatenate([units, units[:150]])  # tiles of other shapes
    images, close = embedding_dedup.fronts(units, 0.9), units @ units.T >= 0.9
    for own, other in ((range(450), range(450, 650)), (range(650), range(650))):
        got = [(int(a), int(b)) for p, q in embedding_dedup.near_pairs(units, images, own, other, 0.9) for a, b in zip(p, q, strict=True)]
        want = {(a, b) for a, b in zip(*np.nonzero(close), strict=True) if a in own and b in other and (own != other or a < b)}
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000


def test_chunks_meet_once_and_few_at_a_time(spark):
    # Vectors of k components are cut into k chunks.
    rows = [(100 * k + n, 1, [1.0 + n] * k) for k in range(1, 8) for n in range(25)]
    classes = spark.createDataFrame(rows, "rid long, size long, vector array<float>")
    lengths = spark.createDataFrame([(k, k) for k in range(1, 8)], "d int, _k int")
    met = {}
    for shift in (1, 2, 3):
        dealt = embedding_dedup.met(classes, lengths, shift, 5).withColumn("part", F.spark_partition_id()).collect()
        assert len(dealt) <= 2 * len(rows)
        tasks = {}
        for r in dealt:
            tasks.setdefault((r["d"], r["task"]), []).append(r)
        for members in tasks.values():
            assert len({r["part"] for r in members}) == 1
            home, guests = ([r["rid"] for r in members if r["home"] == side] for side in (True, False))
            for a in home:
                for b in guests + [c for c in home if shift == 1 and a < c]:
                    met[min(a, b), max(a, b)] = met.get((min(a, b), max(a, b)), 0) + 1
    assert met == {(100 * k + a, 100 * k + b): 1 for k in range(1, 8) for a in range(25) for b in range(a + 1, 25)}


def test_embedding_join_keeps_few_copies_on_disk(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x[1000:1400] = x[:400] + 0.2 * rng.normal(size=(400, 64))
    x[1990:] = x[0]
    frame = spark.createDataFrame([(i, [float(c) for c in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").localCheckpoint()
    sizes = []

    def watched(df, name, write=embedding_dedup.stored):
        out = write(df, name)
        sizes.append(sum(f.stat().st_size for f in tmp_path.rglob("*.parquet")))
        return out

    monkeypatch.setattr(embedding_dedup, "stored", watched)
    monkeypatch.setattr(embedding_dedup, "CHUNK", 300)
    monkeypatch.setattr(shared, "shared_dir", lambda spark: str(tmp_path))
    got = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(frame, cell_rows=300).collect()}
    assert max(sizes) < 3 * x.nbytes
    u = embedding_dedup.unit(x.astype(float))
    close = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    tops = reach(range(len(x)), list(zip(*np.nonzero(close), strict=True)))
    assert close.sum() > 800 and all(got[i]["n_links"] == close[i].sum() and got[i]["component_id"] == tops[i] for i in range(len(x)))


@pytest.mark.parametrize("pile", [0, 4])
def test_piled_links_fold(spark, monkeypatch, pile):
    monkeypatch.setattr(embedding_dedup, "CHUNK", 12)
    monkeypatch.setattr(embedding_dedup, "PILE", pile)
    monkeypatch.setattr(embedding_dedup, "PILED_TABLES", 2)
    x = make_vectors(seed=6, n=40)
    rows = {r["vec_id"]: r for r in embedding_dedup.embedding_dedup(vectors_frame(spark, [(i, [float(c) for c in v], 0) for i, v in enumerate(x)])).collect()}
    u = embedding_dedup.unit(x.astype(float))
    close = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    tops = reach(range(len(x)), list(zip(*np.nonzero(close), strict=True)))
    assert close.any() and all(rows[i]["n_links"] == close[i].sum() and rows[i]["component_id"] == tops[i] for i in range(len(x)))


def covered(texts: list[bytes], length: int) -> list[np.ndarray]:
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - length + 1):
            seen[t[k : k + length]] = seen.get(t[k : k + length], 0) + 1
    out = []
    for t in texts:
        c = np.zeros(len(t), bool)
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                c[k : k + length] = True
        out.append(c)
    return out


def repeated_texts(seed=4):
    rng = random.Random(seed)
    shared = [prose(rng, 90) for _ in range(4)]
    texts = []
    for k in range(40):
        parts = [prose(rng, rng.randint(5, 40))]
        for s in rng.sample(shared, rng.randint(0, 3)):
            a = rng.randint(0, 200)
            parts += [s[a : a + rng.randint(150, 420)], prose(rng, rng.randint(0, 20))]
        texts.append("".join(parts) if k % 3 else "é".join(parts))
    return [*texts, texts[0], "xy" * 300, "z" * 199, "z" * 200, "q" * 260, "", prose(rng, 10)]


@pytest.mark.parametrize("hot", [1, 4096])
def test_suffix_dedup_equals_all_windows(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_STRINGS", hot)
    monkeypatch.setattr(suffix_merge, "RANGE_STRINGS", 40)
    monkeypatch.setattr(suffix_merge, "RUN_STRINGS", 7)
    texts = repeated_texts()
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(-1, None, 1)], "doc_id long, text string, digest int").repartition(5)
    raw = [t.encode() for t in texts]
    rows = {r["doc_id"]: r for r in suffix_dedup.suffix_dedup(df).collect()}
    for i, (t, c) in enumerate(zip(raw, covered(raw, 200), strict=True)):
        assert rows[i]["n_removed"] == c.sum() and rows[i]["n_spans"] == (c & ~np.append(False, c[:-1])).sum()
        assert bytes(rows[i]["kept"]) == np.frombuffer(t, np.uint8)[~c].tobytes()
    assert rows[-1]["n_bytes"] == 0 and suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    assert suffix_dedup.suffix_dedup(documents(spark)).count() == documents(spark).count()


def test_loser_tree_merges_with_right_prefixes():
    rng = random.Random(6)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 12))).encode() for _ in range(300)]
    runs = []
    for k in range(7):
        own = sorted(set(strings[k::7]))
        shared, lengths, rests = suffix_merge.front_coded(own)
        runs.append(suffix_merge.Run(shared.tobytes(), lengths.tobytes(), np.ones(len(own), np.int64).tobytes(), rests))
    out = list(suffix_merge.LoserTree(runs))
    assert [s for s, _, _ in out] == sorted(s for k in range(7) for s in set(strings[k::7]))
    assert all(n == suffix_merge.common(a, b) for (a, _, _), (b, n, _) in zip(out[:-1], out[1:], strict=True))


def same_as_sql(query, sql, spark, folder, **frames):
    got = query.toPandas()
    db = duckdb.connect()
    for name, frame in frames.items():
        db.register(name, frame)
    want = db.sql(sql).df()[list(got.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False)))
    assert [k.replace(".0", "") for k in key(got)] == [k.replace(".0", "") for k in key(want)]


def test_mixing_meets_its_targets(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = mixing.labelled(docs)
    rates = mixing.cell_probabilities(labels)
    cells = labels.groupBy(*mixing.DIMENSIONS).agg(F.sum("n_tokens").alias("tokens"))
    for d in mixing.DIMENSIONS:
        goal = {r[d]: r["target"] for r in mixing.tempered(cells, d).collect()}
        got = {r[d]: r["w"] for r in rates.groupBy(d).agg(F.sum("weight").alias("w")).collect()}
        assert all(abs(got[k] - v) < 1e-3 for k, v in goal.items())
    expected = rates.agg(F.sum(F.col("tokens") * F.col("probability"))).first()[0]
    total = rates.agg(F.sum("tokens")).first()[0]
    assert abs(expected / total - mixing.SHARE) < 1e-6
    assert rates.where("probability > 1 or probability < 0").isEmpty()


def test_raking_writes_plans_of_one_sum_and_one_join(spark, monkeypatch):
    """A sweep in one plan read its cells eight times, and its broadcasts filled the driver; weights are those of plain raking."""
    rows = [(s, l, t, (i * 37 + j * 11 + k * 5) % 23) for i, s in enumerate("abc") for j, l in enumerate("xy") for k, t in enumerate("pqr")]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    goals = {d: spark.createDataFrame(list(zip(names, shares)), f"{d} string, target double") for d, names, shares in (("source", "ab", (0.7, 0.3)), ("lang", "xy", (0.4, 0.6)), ("topic", "pqr", (0.2, 0.3, 0.5)))}
    plans, write = [], mixing.stored
    monkeypatch.setattr(mixing, "stored", lambda df, name: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or write(df, name))
    got = {(r["source"], r["lang"], r["topic"]): r["weight"] for r in mixing.raked(cells, goals, 3).collect()}
    assert max(p.count("Aggregate") for p in plans) == 1 and max(p.count("Join") for p in plans[1:]) == 1
    weight, targets = {r[:3]: float(r[3]) for r in rows}, [dict(r[:2] for r in goals[d].collect()) for d in mixing.DIMENSIONS]
    for _ in range(3):
        for at, goal in enumerate(targets):
            sums = {v: sum(w for key, w in weight.items() if key[at] == v) for v in {key[at] for key in weight}}
            weight = {key: w * (goal.get(key[at], 0.0) / sums[key[at]] if sums[key[at]] > 0 else 0.0) for key, w in weight.items()}
    assert got.keys() == weight.keys() and all(got[k] == pytest.approx(w, rel=1e-9, abs=1e-12) for k, w in weight.items())


def test_mixing_draws_rows_without_an_id_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id")))
    out = mixing.mixing(docs).where("doc_id is null").collect()
    kept = sum(r["kept"] for r in out)
    wanted, spread = sum(r["probability"] for r in out), sum(r["probability"] * (1 - r["probability"]) for r in out) ** 0.5
    assert 0 < kept < len(out) and abs(kept - wanted) < 4 * spread + 1
    named = docs.withColumn("_row_key", F.lit("own")).withColumn("_Row_Key_", F.lit(7))
    rows, key = stages.keyed(named)
    assert key == "_row_key__" and {r["_row_key"] for r in rows.collect()} == {"own"}


def test_mixing_of_awkward_rows(spark):
    docs = documents(spark)
    out = mixing.mixing(docs).collect()
    assert len(out) == docs.count() and all(r["kept"] is not None for r in out)
    assert len({r["kept"] for r in out if r["doc_id"] == 11}) == 1
    assert mixing.mixing(nothing(spark)).count() == 0
    stage = stages.mixing_stage(spark, docs, FOLDER)
    assert stage.columns == docs.columns and stage.count() == sum(r["kept"] for r in out)


CHATS = [
    (1, 0, "user", "Hello there.\n\nHow are you?"), (1, 1, "assistant", "> how   are YOU?\nFine."), (1, 2, "user", "Other topic"),
    (1, 3, "user", "> > How are you?\n> Fine.\nGood to hear\n\n> Other topic\nyes"), (1, 4, "assistant", "> nothing said\nok"),
    (1, 4, "assistant", "> nothing said\nok"), (2, 0, "user", None), (None, 0, "user", ">q"), (None, None, "user", "q"), (3, 0, "user", ""), (2, 5, "a", ">\n> \n>x\n>>y"),
]


def test_quotes_link_and_order(spark):
    df = spark.createDataFrame(CHATS, "conv_id long, turn long, role string, text string").withColumn("thread", F.lit(1)).withColumn("own", F.lit("x"))
    rows = {(r["conv_id"], r["turn"]): r for r in chat_quotes.reply_ordered(df).collect()}
    assert rows[1, 1]["reply_to"] == 0 and rows[1, 1]["text"] == "Fine." and rows[1, 1]["position"] == 1
    assert rows[1, 3]["reply_to"] == 2 and rows[1, 3]["thread"] == 2 and rows[1, 3]["n_linked"] == 3
    assert rows[1, 4]["reply_to"] is None
    pdf = df.toPandas()
    for c in ("conv_id", "turn"):
        pdf[c] = pdf[c].astype("Int64")
    same_as_sql(chat_quotes.reply_ordered(df), chat_quotes.SQL, spark, FOLDER, conversations=pdf)
    assert chat_quotes.reply_ordered(df.limit(0)).count() == 0


def test_random_quoted_threads_equal_sql(spark):
    rng = random.Random(8)
    rows, said = [], {}
    for conv in range(6):
        for turn in range(25):
            lines = [prose(rng, 4)]
            for _ in range(rng.choice([0, 1, 2])):
                if said.get(conv):
                    lines.append(rng.choice(["> ", ">> ", " >"]) + rng.choice(said[conv]))
            rng.shuffle(lines)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), "\n".join(lines)))
            said.setdefault(conv, []).append(next(x for x in lines if not x.lstrip().startswith(">")))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    same_as_sql(chat_quotes.reply_ordered(df), chat_quotes.SQL, spark, FOLDER, conversations=df.toPandas())


def test_pipeline_stages_take_effect(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [docs]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(corpus_pipeline.stored(stage(spark, kept[-1], FOLDER), "stage"))
        assert kept[-1].columns == docs.columns
    ids = [{r["doc_id"] for r in k.select("doc_id").collect()} for k in kept]
    rules = {r["doc_id"] for r in queries.op5_quality_rules(spark, FOLDER).where("kept").collect()}
    assert ids[1] == rules
    texts = {r["doc_id"]: r["text"] for r in kept[1].collect()}
    rows = {r["doc_id"]: r for r in ngram_join.ngram_join(kept[1]).collect()}
    check_join(rows, texts)
    assert ids[2] == {i for i, r in rows.items() if r["kept"]} and ids[3] == ids[2] and ids[4] < ids[3]
    from priorlake.llm.secret_scan import find_secrets

    assert not [i for i, t in ((r["doc_id"], r["text"]) for r in kept[3].collect()) if find_secrets(t)[0]]
    last = corpus_pipeline.STAGES[-1][1](spark, kept[4], FOLDER)
    final = {r["doc_id"]: r for r in kept[4].collect()}
    import hashlib

    for r in last.collect():
        assert r["decoded_sha256"] == hashlib.sha256(final[r["doc_id"]]["text"].encode()).hexdigest() and r["n_tokens"] * 4 == len(r["ids"])


def test_pipeline_runs_on_awkward_rows(spark):
    docs = documents(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER), "stage")
    empty = nothing(spark)
    for _, stage in corpus_pipeline.STAGES:
        empty = corpus_pipeline.stored(stage(spark, empty, FOLDER), "stage")
    assert empty.count() == 0


def test_stages_judge_rows_not_ids(spark):
    """Ids are null or shared; a bad or repeated row costs no other row, and a group keeps one row."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = [r["doc_id"] for r in queries.op5_quality_rules(spark, FOLDER).where("kept").orderBy("doc_id").limit(6).collect()]
    texts = [r["text"] for r in docs.where(F.col("doc_id").isin(good)).orderBy("doc_id").collect()]
    rows = [(None, texts[0]), (None, "bad"), (None, texts[1]), (7, texts[2]), (7, "bad"), (7, texts[3]), (8, texts[4])]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, tag long").repartition(3)
    kept = stages.quality_stage(spark, df, FOLDER)
    assert kept.columns == df.columns and sorted(r["tag"] for r in kept.collect()) == [0, 2, 3, 5, 6]

    rng = random.Random(8)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    rows = [
        (None, a), (None, a), (None, a + " more"),  # no id at all: one stays
        (5, b), (5, b), (None, b), (9, b + " more"),  # one of the two rows of id 5 stays
        (9, c), (4, d), (9, d + " more"),  # c has the id of dropped copies and stays
        (3, e), (3, prose(rng, 120)), (None, None), (None, None), (2, ""), (2, " "),
    ]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, tag long").repartition(3)
    kept = stages.near_duplicate_stage(spark, df, FOLDER)
    tags = {r["tag"] for r in kept.collect()}
    assert kept.columns == df.columns and len(tags & {0, 1, 2}) == 1 and len(tags & {3, 4}) == 1
    assert tags - {0, 1, 2, 3, 4} == {7, 8, 10, 11, 12, 13, 14, 15}
