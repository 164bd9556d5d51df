import numpy as np
import xxhash
from pagemill.functions import similarity as sim
from pagemill.functions import text as tx
from pagemill.operators import cache
from pagemill.plans import cache_queries, text_queries
from pyspark.sql import functions as F

BASE = "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf"
TEXTS = [BASE, BASE + " again", "abc", "", None, "grüße aus köln 😀😀 ok", BASE.replace("e", "é"), "".join(map(chr, range(200, 5000)))]


def plain(text, digest):
    return sim.minima(np.array([digest(text[i : i + 5].encode()) for i in sim.distinct_windows(text).tolist()], np.uint64), 16)


def test_signer_against_each_text_alone():
    for digest in (sim.md5_hash, xxhash.xxh32_intdigest):
        for rows in (0, 3, 1000):  # how many permuted values are kept changes nothing
            sign = sim.Signer(digest, 16, rows)
            for _ in range(3):
                assert sign(TEXTS).tolist() == [plain(t or "", digest) for t in TEXTS]
            assert len(sign.codes) <= rows


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    return str(path)


def rows_moved(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_versions_do_not_move(spark, tmp_path):
    at = documents(spark, tmp_path, [(i, f"{BASE} {i} " * 9, "en", "s", 0) for i in range(20)] + [(50, None, "fr", "s", 0), (51, "ab", "de", "s", 0)])
    exact, anchors = text_queries.jaccard_exact(spark, at), cache_queries.change_anchor(spark, at)
    assert rows_moved(exact) == 0 and rows_moved(anchors) == 0
    before, after = text_queries._versions(spark, at)
    assert sorted(map(tuple, exact.collect())) == sorted(map(tuple, sim.exact_jaccard(sim.shingle_rows(before), sim.shingle_rows(after)).collect()))
    versions = None
    for number, share in enumerate((0.0, 0.005, 0.01, 0.1)):
        own = before.select(F.col("doc_id").cast("string").alias("url"), F.lit(number).alias("version"), tx.normalise(tx.replaced_words(F.col("text"), F.col("doc_id"), share)).alias("text"))
        versions = own if versions is None else versions.unionByName(own)
    assert sorted(map(tuple, anchors.collect())) == sorted(map(tuple, cache.anchors(versions).collect()))


def test_repeated_ids_are_one_document(spark, tmp_path):
    at = documents(spark, tmp_path, [(1, BASE, "en", "s", 0), (1, "another text of the same id", "en", "s", 0), (2, BASE, "de", "s", 0)])
    assert [r.doc_id for r in text_queries.jaccard_exact(spark, at).orderBy("doc_id").collect()] == [1, 2]
    assert cache_queries.change_anchor(spark, at).count() == 12


def test_steps_sign_known_documents_only(spark, tmp_path):
    at = documents(spark, tmp_path, [(1, BASE * 9, "en", "s", 0), (2, BASE * 9, "de", "s", 0), (3, "ab", "fr", "s", 0)])
    rows = cache_queries.classify_cache_step(spark, at)
    assert rows._jdf.queryExecution().executedPlan().toString().count("Join") <= 2  # requests and cache; once more, if the plan is printed twice
    assert {r.url: r.action != "miss" for r in rows.collect()} == {"1": True, "2": False}


def test_change_grid_signs_once(spark):
    versions = spark.createDataFrame([(0.1, BASE * 3, BASE * 3 + " end"), (0.5, BASE * 3, "nothing alike at all")], "share double, before string, after string")
    got = {(r.threshold, r.share): (r.detected, r.n) for r in sim.change_grid(versions, [0.5, 0.99]).collect()}
    assert got == {(0.5, 0.1): (0.0, 1), (0.5, 0.5): (1.0, 1), (0.99, 0.1): (1.0, 1), (0.99, 0.5): (1.0, 1)}


def test_replaced_words_of_any_share(spark):
    row = spark.createDataFrame([(5, "a b c d")], "doc_id long, text string").select(*[tx.replaced_words(F.col("text"), F.col("doc_id"), s) for s in (0.0, 1.0)]).first()
    assert row[0] == "a b c d" and all(w.startswith("zz") for w in row[1].split())
