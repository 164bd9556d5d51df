"""Tokens, packing, token store, nearest neighbours: round trips and brute force."""

import random
import zlib

import numpy as np
import pytest
from pagemill.llm import ann, packing, queries, token_store, tokens
from pagemill.llm.common import staging_path
from pyspark.sql import functions as F

PATH = queries.tokenizer_path()


@pytest.fixture(scope="module")
def cache():
    return tokens.WordCache(PATH)


def ids_of(cache, text):
    return np.array(cache.tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def test_words_give_the_tokenizers_ids(cache):
    rng = random.Random(8)
    parts = ["Hello", "don't", "it's,", "x1", "0", "a0b", "...", "é,", "naïve!!", "ÀB", "Σας", "日本語", "e\u0301", "\u0301", " \u00a0 ", "\x1c", "'s", "a'b", "<|endoftext|>", "a|>b", "\n\t", "\x85", "İ", "ß$", "—,"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", "\n"]) for _ in range(rng.randint(0, 12))) for _ in range(500)] + [None, "", " "]
    assert cache.by_word
    for text, data in zip(texts, cache.encode_batch(texts)):
        assert data == ids_of(cache, text)[:-1].tobytes(), text


def documents(spark, n=120):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices(["alpha", "beta", "Gamma,", "delta9", "épsilon"], k=rng.choice([0, 3, 50, 400, 1500])))) for i in range(n)]
    rows += [(n, None), (n + 1, rows[4][1]), (n + 1, rows[4][1]), (None, "lost")]
    return rows, spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int").repartition(6)


def test_packing(spark, cache):
    rows, frame = documents(spark)
    pieces = packing.pack(frame, PATH, open_windows=4, merge_width=2).toPandas()
    lengths = pieces.groupby("sequence_id").length.sum()
    assert lengths.max() <= 2048
    assert sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) < 0.01 * lengths.sum()
    for _, sequence in pieces.groupby("sequence_id"):
        sequence = sequence.sort_values("offset")
        assert sequence.offset.tolist() == [0, *np.cumsum(sequence.length)[:-1]]
    for row in pieces.itertuples():
        assert zlib.crc32(row.ids) == row.ids_crc32 and len(row.ids) == 4 * row.length
    single = {i: t for i, t in rows if i is not None and i <= 120}
    for i, text in single.items():
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert b"".join(own.ids) == ids_of(cache, text).tobytes()
        assert own.start.tolist() == [0, *np.cumsum(own.length)[:-1]] and set(own.doc_tokens) == {own.length.sum()}
    assert pieces[pieces.doc_id == 121].length.sum() == 2 * len(ids_of(cache, rows[4][1]))
    assert packing.pack(frame.limit(0), PATH).count() == 0


def test_store_round_trip(spark, cache):
    rows, frame = documents(spark)
    path = staging_path(spark, "store")
    token_store.write_store(frame, path, PATH, mean=64)
    got = token_store.read_digests(spark, path).orderBy(F.col("doc_id").asc_nulls_first(), "start").collect()
    at = 0
    for (i, text), row in zip(sorted(rows, key=lambda r: (r[0] is not None, r[0])), got, strict=True):
        ids = ids_of(cache, text)
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    rebuilt = sorted((r.doc_id if r.doc_id is not None else -1, r.ids) for r in token_store.read_documents(spark, path).collect())
    assert rebuilt == sorted((i if i is not None else -1, ids_of(cache, t).tolist()) for i, t in rows)
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'")
    assert chunks.count() == chunks.select("hash").distinct().count()


def test_store_notices_damage(spark):
    _, frame = documents(spark, 10)
    path = staging_path(spark, "store")
    token_store.write_store(frame, path, PATH)
    chunks = spark.read.parquet(f"{path}/objects").where("kind = 'chunk'").drop("kind")
    chunks.withColumn("payload", F.concat("payload", F.lit(b"\0\0"))).write.parquet(f"{path}/damaged/objects/kind=chunk")
    with pytest.raises(Exception, match="does not match"):
        token_store.read_chunks(spark, f"{path}/damaged").collect()


def test_empty_store(spark):
    path = staging_path(spark, "store")
    token_store.write_store(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_store.read_digests(spark, path).count() == 0


def test_cuts_cover_and_move_with_content():
    ids = np.random.default_rng(0).integers(0, 49000, 20000).astype(np.uint32)
    ends = token_store.cut(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(ids) and sizes.max() <= 1024 and sizes[:-1].min() >= 64
    moved = token_store.cut(np.concatenate([ids[:100], ids]))
    shared = {e - 100 for e in moved} & set(ends)
    assert len(shared) > 0.8 * len(ends)
    assert token_store.cut(ids[:1]) == [1]


def test_crc_of_concatenation():
    rng = random.Random(1)
    for n in (0, 1, 4, 1000):
        a, b = rng.randbytes(37), rng.randbytes(n)
        assert token_store.crc32_concat(zlib.crc32(a), zlib.crc32(b), n) == zlib.crc32(a + b)


@pytest.mark.parametrize("cells", [{}, {"cell_rows": 40, "query_rows": 3, "sample_rows": 300}])
def test_nearest_against_brute_force(spark, cells):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    vectors = (centres[rng.integers(0, 20, 600)] + 0.6 * rng.standard_normal((600, 16))).tolist()
    vectors[7] = vectors[3]
    vectors[9] = vectors[3]
    vectors[250] = (2 * np.array(vectors[100])).tolist()
    rows = list(enumerate(vectors)) + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1150, [1.0, 2.0]), (None, vectors[0]), (1201, [None] + [1.0] * 15)]
    frame = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(5)
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0, p=0.99, **cells).toPandas()
    V = np.array(vectors)
    N = V / np.linalg.norm(V, axis=1)[:, None]
    hit = 0
    for q in range(0, 600, 50):
        scores = N @ N[q]
        scores[q] = -9
        order = np.lexsort((np.arange(600), -np.round(scores, 12)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(own.score, [scores[i] for i in own.vec_id], atol=1e-12)
        hit += len(set(order) & set(own.vec_id))
    assert hit / 60 >= 0.95
    assert set(got.query_id) == set(range(0, 600, 50))  # 1150 has no candidate of its length


def test_nearest_stops_early(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((50, 64))
    vectors = centres[rng.integers(0, 50, 3000)] + 0.5 * rng.standard_normal((3000, 64))
    frame = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>, id int").repartition(4)
    unit = vectors / np.linalg.norm(vectors, axis=1)[:, None]
    scores = []
    for cell_rows in (5000, 500):
        got = ann.nearest(frame, F.col("vec_id") % 100 == 0, cell_rows=cell_rows).toPandas()
        hits = 0
        for q, own in got.groupby("query_id"):
            near = unit @ unit[q]
            near[q] = -9
            hits += len(set(np.argsort(-near)[:5]) & set(own.vec_id))
        assert len(got) == 150 and hits >= 0.9 * 150
        assert got.groupby("query_id").verified.max().mean() < 0.2 * 3000
        scores.append({(r.query_id, r.vec_id): r.score for r in got.itertuples()})
    shared = scores[0].keys() & scores[1].keys()
    assert shared and all(scores[0][x] == scores[1][x] for x in shared)  # to the last bit


def test_nearest_ties_and_few(spark):
    frame = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(0, 12)] + [(50, [1.0, 0.0])], "vec_id long, embedding array<float>").repartition(3)
    got = ann.nearest(frame, F.col("vec_id") == 50).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
    few = ann.nearest(frame.where("vec_id in (1, 50)"), F.col("vec_id") == 50).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in few] == [(1, 1, 1.0)]
    assert ann.nearest(frame.limit(0), F.col("vec_id") == 50).count() == 0


def test_chi_square_bound():
    draws = np.random.default_rng(0).chisquare(8, 200_000)
    assert abs((draws <= ann.chi_square_bound(8, 0.97)).mean() - 0.97) < 0.003


def test_block_verifies_all_within_the_radius():
    rng = np.random.default_rng(3)
    vectors, ids, k, m = rng.standard_normal((3000, 32)), rng.permutation(3000), 5, 12
    queries = rng.standard_normal((150, 32))
    own, queries[0] = np.full(150, -1), vectors[17]
    own[0] = ids[17]
    unit, asked = vectors / ann.norms_of(vectors)[:, None], queries / ann.norms_of(queries)[:, None]
    points, stop = asked @ ann.projection(32, m), ann.chi_square_bound(m, 0.93)
    away = ((points[:, None] - unit @ ann.projection(32, m)) ** 2).sum(axis=2)
    worst = np.where(np.arange(150) % 3, 0.55, -2.0)
    for i, (found, scores, verified) in enumerate(ann.Block(ids, vectors, m).search(own, queries, points, k, stop, worst)):
        cosines = np.where(ids == own[i], -9, unit @ asked[i])
        order = np.argsort(-cosines)
        if worst[i] > 0:
            inside = (away[i] <= stop * (2 - 2 * worst[i])) & (ids != own[i])
            assert found.tolist() == [ids[j] for j in order if inside[j] and cosines[j] >= worst[i]][:k] and abs(verified - inside.sum()) <= 2
        else:
            assert len(found) == k and (scores <= np.sort(cosines)[::-1][:k] + 1e-12).all() and k <= verified < 3000
        assert np.allclose(scores, [cosines[np.flatnonzero(ids == x)[0]] for x in found], atol=1e-12)
