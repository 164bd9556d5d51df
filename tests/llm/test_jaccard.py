"""The near-dedup stage against all pairs in plain Python."""

import random

import corpus_pipeline
import numpy as np
from pagemill.llm import jaccard, simhash


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))}


def plain_classes(docs, limit):
    """doc_id -> smallest id of its class."""
    sets = {i: shingles(t) for i, t in docs}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= limit:
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in sets}


def edited(rng, text, edits):
    parts = text.split()
    for at in rng.sample(range(len(parts)), edits):
        parts[at] = f"w{rng.randrange(10**6)}"
    return " ".join(parts)


def corpus():
    rng = random.Random(31)
    docs = []
    for _ in range(40):
        text = " ".join(f"w{rng.randrange(3000)}" for _ in range(rng.choice([8, 60, 200])))
        docs += [text, edited(rng, text, max(1, len(text.split()) // 60)), edited(rng, text, max(1, len(text.split()) // 25))]
    base = " ".join(f"w{rng.randrange(3000)}" for _ in range(120))
    docs += [edited(rng, base, rng.randint(0, 4)) for _ in range(150)]  # a dense group: few of its pairs are made
    docs += [docs[0], docs[0].upper(), "one two", "One  two", None, ""]
    return list(enumerate(docs))


def test_near_copies_go(spark):
    docs = corpus()
    classes = plain_classes(docs, 0.8)
    far = [(i, j) for i, j in classes.items() if i != j and bin(simhash.fingerprint(docs[i][1]) ^ simhash.fingerprint(docs[j][1])).count("1") > 4]
    assert len(far) > 30  # the fingerprints of the corpus' near copies differ in more than four bits
    rows = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_dedup(spark, rows.repartition(5), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(classes.values()))


def test_candidates_come_from_the_fingerprint_index(spark, monkeypatch):
    asked, index = [], simhash.near_pairs
    monkeypatch.setattr(simhash, "near_pairs", lambda prints, distance: asked.append(prints.count()) or index(prints, distance))
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text), (2, text + " end"), (3, text.upper()), (4, "something else"), (5, None)]
    kept = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == [1, 4, 5]
    assert asked == [len({simhash.fingerprint(t) for _, t in rows})]


def test_fingerprint_pairs(spark):
    signed = [0, 1, 0b11111, 1 << 40, -1]
    rows = [(fp, 10 * i + j) for i, fp in enumerate(signed) for j in range(2)]
    got = {tuple(r) for r in jaccard._simhash_pairs(spark.createDataFrame(rows, "fp long, node long"), 4).collect()}
    assert {(10 * i, 10 * i + 1) for i in range(5)} <= got
    up = {10 * i: 10 * i for i in range(5)}
    for a, b in got:
        if a % 10 == b % 10 == 0:
            low, high = sorted((up[a], up[b]))
            up = {n: low if r == high else r for n, r in up.items()}
    assert up == {0: 0, 10: 0, 20: 0, 30: 0, 40: 40}


def test_rows_with_null_ids_and_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(50))
    rows = spark.createDataFrame([(None, text), (7, text), (7, text), (3, text + " end"), (9, "other"), (9, "other"), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.text or "") for r in jaccard.one_of_each(rows).collect())
    assert got == [(0, ""), (3, text + " end"), (9, "other")]
    assert jaccard.one_of_each(rows.limit(0)).count() == 0


def test_shingle_set():
    assert len(jaccard.shingle_set("a b c d e f")) == 2 and len(jaccard.shingle_set("a b")) == 1
    assert np.array_equal(jaccard.shingle_set("A  b\nc"), jaccard.shingle_set("a b c"))


def test_similar_pairs_against_brute_force(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    rng = np.random.default_rng(3)
    base = [set(rng.integers(0, 60, 20).tolist()) for _ in range(6)]
    sets = [b - set(rng.choice(sorted(b), rng.integers(0, 4), replace=False).tolist()) for b in base for _ in range(8)] + [{1000}, {1000}, {1001}]
    values, sizes = np.concatenate([sorted(s) for s in sets]).astype(np.int64), np.array([len(s) for s in sets])
    a, b = jaccard.similar_pairs(values, sizes, 0.8)
    assert all(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for i, j in zip(a, b))

    def classes(pairs):
        root = list(range(len(sets)))
        for i, j in pairs:
            low, high = sorted((root[i], root[j]))
            root = [low if r == high else r for r in root]
        return root

    every = [(i, j) for i in range(len(sets)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert classes(zip(a, b)) == classes(every) and len(a) < len(every)


def test_large_bands_give_the_same_classes(spark, monkeypatch):
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(60)]
    texts = []
    for i in range(150):  # one text with a few words changed: some pairs reach 0.8, most do not
        words = base[:]
        for at in rng.choice(60, rng.integers(0, 5), replace=False):
            words[at] = f"other{rng.integers(0, 3)}"
        texts.append(" ".join(words))
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = []
    for small, block in ((10_000, 1000), (4, 20)):
        monkeypatch.setattr(jaccard, "SMALL", small)
        monkeypatch.setattr(jaccard, "BLOCK_NODES", block)
        kept.append(sorted(r.doc_id for r in jaccard.one_of_each(rows).collect()))
    assert kept[0] == kept[1] and 1 < len(kept[0]) < 150
