"""The pipeline against plain Python over a small corpus with planted cases."""

import random
import zlib
from itertools import combinations

import corpus_pipeline
import numpy as np
from pagemill.llm import jaccard, queries, tokens

from tests.llm.test_dedup_ops import plain_containment, plain_lines

WORDS = {
    "en": "the house and garden with river that was there when people came home from work on monday",
    "de": "das haus und der garten mit einem fluss dort wenn leute am montag von arbeit nach hause kommen",
}


def corpus():
    rng = random.Random(12)
    rows = []
    for i in range(60):
        lang = "en" if i % 3 else "de"
        lines = [" ".join(rng.choices(WORDS[lang].split(), k=40)) for _ in range(3)]
        rows.append([i, "\n".join(lines), lang, "src", 0])
    shared = "this boilerplate line stands in many documents"
    for i in (1, 5, 9, 13):
        rows[i][1] += "\n" + shared
    rows[20][1] = rows[2][1]  # exact copy
    rows[22][1] = rows[2][1].replace("\n", " ") + " end"
    item = "a benchmark question nobody should ever see in training data at all today"
    rows[30][1] = rows[30][1].replace("\n", f" {item} ", 1)
    rows += [[100, None, "en", "src", 0], [101, "12 34 !!", None, "src", 0]]
    return rows, item


def test_pipeline(spark, tmp_path):
    rows, item = corpus()
    spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()

    docs = [(r[0], r[1]) for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    docs = [(i, t) for i, _, t in plain_lines(docs)]
    sets = {i: set(jaccard.shingle_set(t).tolist()) for i, t in docs}
    root = {i: i for i in sets}
    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            low, high = sorted((root[a], root[b]))
            root = {i: low if r == high else r for i, r in root.items()}
    docs = [(i, t) for i, t in docs if root[i] == i]
    gone = {d for d, _, _ in plain_containment(docs, [(1, item)])}
    docs = [(i, t) for i, t in docs if i not in gone]
    assert len(docs) < 60 and 30 not in dict(docs) and 20 not in dict(docs)
    assert set(pieces.doc_id) == {i for i, _ in docs}
    cache = tokens.WordCache(queries.tokenizer_path())
    for i, text in docs:
        ids = np.array(cache.tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.length.sum() == len(ids)
        for r in own.itertuples():
            assert zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32


def test_stages_keep_the_columns(spark, tmp_path):
    rows, item = corpus()
    docs = spark.createDataFrame([tuple(r) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 11)]
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
