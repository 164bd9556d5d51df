"""Line runs, SimHash index, decontamination: against plain Python."""

import random
from collections import defaultdict

import numpy as np
import xxhash
from pagemill.llm import decontaminate, graph, jaccard, line_runs, simhash
from pyspark.sql import functions as F

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def line_key(line):
    return line.strip(" \t\n\x0b\x0c\r").translate(UPPER)


def plain_lines(docs):
    holders = defaultdict(set)
    for doc_id, text in docs:
        for line in (text or "").split("\n"):
            holders[line_key(line)].add(doc_id)
    out = []
    for doc_id, text in docs:
        lines = (text or "").split("\n")
        out.append((doc_id, len(lines), "\n".join(x for x in lines if not (len(line_key(x)) >= 20 and len(holders[line_key(x)]) >= 3 and max(holders[line_key(x)]) != doc_id))))
    return sorted(out)


def test_drop_repeats(spark):
    rng = random.Random(4)
    pool = ["x" * 19, "É" * 20, "a line that is long enough", "  A LINE that is long enough\t", "another rather long line \x85", "short", "", "yet another long line here"]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.randint(1, 6)))) for i in range(80)] + [(100, None), (101, "")]
    rows = spark.createDataFrame([(i, t, "clash") for i, t in docs], "doc_id long, text string, key string").repartition(5)
    kept = line_runs.drop_repeats(rows)
    got = sorted(tuple(r) for r in kept.select("doc_id", "`__n_lines`", "`__kept`").collect())
    assert got == plain_lines(docs)


def test_drop_repeats_edges(spark):
    schema = "doc_id long, text string"
    assert line_runs.drop_repeats(spark.createDataFrame([], schema)).count() == 0
    line = "a line that is long enough"
    rows = spark.createDataFrame([(None, line), (1, line), (2, line), (2, line)], schema)
    got = sorted((r[0] or 0, r[1]) for r in line_runs.drop_repeats(rows).select("doc_id", "`__n_dropped`").collect())
    assert got == [(0, 1), (1, 1), (2, 0), (2, 0)]
    # Two documents hold the line, one of them in two rows.
    again = line_runs.drop_repeats(rows.where("doc_id is not null").withColumns({"id": F.lit(1), "gone": F.lit("x"), "__kept": F.lit(3), "keep0": F.lit(4)}))
    assert sorted((r.doc_id, r["__kept"], r["__n_dropped"], r.id, r.gone, r.keep0) for r in again.collect()) == [(1, line, 0, 1, "x", 4)] + [(2, line, 0, 1, "x", 4)] * 2
    names = spark.createDataFrame([("b", line), ("a", line), ("c", line), ("c", "other")], "doc_id string, text string")
    assert sorted((r.doc_id, r["__n_dropped"]) for r in line_runs.drop_repeats(names).collect()) == [("a", 1), ("b", 1), ("c", 0), ("c", 0)]


def test_runs_compact_and_batches_drop_seen_lines(spark):
    runs = line_runs.LineRuns(spark, fanout=2)
    kept = []
    for batch in ([(1, "first line of some length\nold line of some length")], [(2, "old line of some length\nnew line of some length")], [(3, "new line of some length\nfirst line of some length\nlast line of some length")]):
        frame = spark.createDataFrame(batch, "doc_id long, text string")
        kept += [r[0] for r in line_runs.dedup_batch(runs, frame).select("`__kept`").collect()]
    assert kept == ["first line of some length\nold line of some length", "new line of some length", "last line of some length"]
    assert [len(level) for level in runs.levels] == [1, 1]
    assert {r.n for r in runs.merged().collect()} == {1, 2}


def plain_fingerprint(text):
    words = (text or "").translate(UPPER).encode().split()
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for n in (0, 1, 3, 4, 5, 40):
        text = " ".join(rng.choice(["Aé", "b", "CC", "d\td"]) for _ in range(n))
        assert simhash.fingerprint(text) == plain_fingerprint(text)
    assert simhash.fingerprint(None) == 0


def test_every_four_positions_hold_a_triple():
    from itertools import combinations

    assert len(simhash.TRIPLES) == 20
    assert all(any(set(t) <= set(q) for t in simhash.TRIPLES) for q in combinations(range(8), 4))


def plain_classes(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if bin(a ^ prints[j]).count("1") <= 4:
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    groups = defaultdict(set)
    for i, p in enumerate(prints):
        groups[find(i)].add(p)
    return sorted(map(sorted, groups.values()))


def test_near_pairs_connect_exactly(spark):
    rng = random.Random(9)
    prints = []
    for _ in range(40):
        seed = rng.getrandbits(64)
        prints.append(seed)
        for _ in range(rng.randint(0, 12)):  # chains of small steps, some too large
            seed ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 6)))
            prints.append(seed)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    for block in (20_000, 4):  # the small block size sends postings through the pairs of blocks
        roots = {r.node & (1 << 64) - 1: r.root for r in graph.components(simhash.near_pairs(frame, block=block)).collect()}
        groups = defaultdict(set)
        for p in prints:
            groups[roots.get(p, p)].add(p)
        assert sorted(map(sorted, groups.values())) == plain_classes(prints)


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5)], "a long, b long").repartition(7)
    roots = {r.node: r.root for r in graph.components(edges).collect()}
    assert roots == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert graph.components(edges.limit(0)).count() == 0


def test_spanning_pairs_are_few():
    values = np.array([1 << i for i in range(20)], np.uint64)
    a, b = graph.spanning_pairs(values, 4)
    assert len(a) == 19 and len(set(a) | set(b)) == 20


def test_near_duplicates_rows(spark):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(5, text), (3, text), (None, text), (7, None), (8, ""), (9, "else where now then"), (9, "else where now then")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, fp string")
    got = sorted((r.doc_id or 0, r.component_id) for r in simhash.near_duplicates(frame).collect())
    assert got == [(0, 3), (3, 3), (5, 3), (7, 7), (8, 7), (9, 9), (9, 9)]
    kept = simhash.one_of_each(frame)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 7, 9] and kept.columns == frame.columns
    assert simhash.near_duplicates(frame.limit(0)).count() == 0 == simhash.one_of_each(frame.limit(0)).count()


def grams(text, width=5):
    words = decontaminate.words_of(text)
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def plain_containment(docs, items):
    out = []
    for item, phrase in items:
        width = min(5, len(decontaminate.words_of(phrase)))
        own = grams(phrase, width) if width else set()
        out += [(d, item, len(own & grams(t, width))) for d, t in docs if own and len(own & grams(t, width)) >= 0.8 * len(own)]
    return sorted(out)


def test_containment_against_brute_force(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for i in range(30)] + [(90, None), (91, ""), (92, "one two three")]
    docs = []
    for i in range(60):
        words = rng.choices(vocabulary, k=rng.randint(0, 80))
        _, item = rng.choice(items[:30])
        part = item.split()
        if rng.random() < 0.5 and part:
            part[rng.randrange(len(part))] = "zzz"
        docs.append((i, " ".join(words + part + words).upper().replace(" ", "*** ")))
    docs += [(100, None), (101, ""), (102, "one two three")]
    docs += [(103, "long " * 3000 + "One, TWO - three" + " w1" * 200_000), (104, "Straße İstanbul ΟΔΟΣ one"), (105, "w2 w3")]
    items += [(93, "strasse İSTANBUL"), (94, "ΟΔΟΣ"), (95, "w2 w3"), (95, "w2 w3")]
    expected = plain_containment(docs, items)
    assert {(103, 92), (104, 94), (105, 95)} <= {(d, i) for d, i, _ in expected}
    frame = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.find_contaminated(frame, bench)
    assert sorted((r.doc_id, r.item_id, r.shared) for r in got.collect()) == expected
    # A bitmap that is far too small only sends more rows to the joins.
    monkeypatch.setattr(decontaminate, "MOST_BITS", 1 << 15)
    monkeypatch.setattr(decontaminate, "GROUP", 2)
    got = decontaminate.find_contaminated(frame.unionByName(frame), bench)
    assert sorted((r.doc_id, r.item_id, r.shared) for r in got.collect()) == sorted(expected + expected)
    kept = decontaminate.without_contaminated(frame, bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({d for d, _ in docs} - {d for d, _, _ in expected})
    assert decontaminate.find_contaminated(frame.limit(0), bench).count() == 0 == decontaminate.find_contaminated(frame, bench.limit(0)).count()


def test_sketches_are_the_way_to_candidates(spark):
    """Few pairs are verified: an item whose sketch a text misses is never compared with it."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(40)]
    docs = [(i, " ".join(rng.choices(words, k=300)) + " " + (items[i][1] if i < 10 else " ".join(items[i % 40][1].split()[:9]))) for i in range(80)]
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    numbered = decontaminate.item_sketches(bench, "text", "item_id", 5, 0.8)
    sketches = numbered.select("number", "width", "least", F.explode("sketch").alias("h"))
    met = decontaminate._met(frame, "text", "doc_id", decontaminate.Probe(sketches))
    pairs = decontaminate.candidates(met, sketches).count()
    assert decontaminate.find_contaminated(frame, bench).count() == 10 <= pairs < 80 < 80 * 40
    sharing = sum(bool(grams(t) & grams(x)) for _, t in docs for _, x in items)
    assert pairs < sharing  # fewer than share a shingle at all


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "a b c d e f g", 5, 6, 7)], "doc_id long, text string, key int, hash int, row int")
    bench = spark.createDataFrame([(1, "b c d e f", "x")], "item_id long, text string, words string")
    assert [r.doc_id for r in decontaminate.find_contaminated(frame, bench).collect()] == [1]
    kept = decontaminate.without_contaminated(frame, bench)
    assert kept.columns == frame.columns and kept.count() == 0


def test_large_postings_are_grouped_by_a_fourth_byte(monkeypatch):
    rng = np.random.default_rng(4)
    prints = np.unique(rng.integers(0, 1 << 64, 300, np.uint64) & ~np.uint64(0xFFFFFF) | np.uint64(0x123456))
    flips = prints[rng.integers(0, len(prints), 60)] ^ (np.uint64(1) << rng.integers(24, 64, 60).astype(np.uint64))
    prints = np.unique(np.concatenate([prints, flips]))
    groups = list(simhash._tallied(prints, (0, 1, 2), 4))
    assert sum(len(g) ** 2 for g in groups) < len(prints) ** 2 / 10
    near = {(a, b) for i, a in enumerate(prints.tolist()) for b in prints.tolist()[i + 1 :] if (a ^ b).bit_count() <= 4}
    assert near and all(any(a in g and b in g for g in map(set, (g.tolist() for g in groups))) for a, b in near)


def test_one_of_each_with_clashing_names(spark):
    names = "doc_id long, text string, __hash int, hash int, id int, fp int, __fp int"
    rows = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5) for i, t in ((2, "a b c d e f"), (1, "A b  c d e f"), (3, None), (None, "x"), (4, ""))], names)
    for one_of_each in (simhash.one_of_each, jaccard.one_of_each):
        kept = one_of_each(rows)
        assert kept.columns == rows.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3]
