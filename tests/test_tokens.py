import random

from pagemill.operators import entities, extract, held, patterns, tokens
from pyspark.sql import functions as F

SCHEMA = "doc_id int, pos int, elem_id int, tag string, sent_id int, form string, lemma string"


def token_rows(spark, docs):
    rows = []
    for doc_id, words in docs.items():
        sent = 0
        for pos, word in enumerate(words):
            rows.append((doc_id, pos, 0, "p", sent, word, word))
            sent += word == "."
    return spark.createDataFrame(rows, SCHEMA)


def walk(words, pattern, mode):
    """Plain restatement: from each start, the nearest next lemma within reach, never going back."""
    steps, gap, wild = [], 0, False
    for part in pattern:
        if part[0] == "*":
            gap, wild = int(part[1:]), True
        else:
            steps.append((part, gap, wild))
            gap, wild = 0, False
    found = []
    for start in range(len(words) - len(pattern) + 1):
        if words[start] != steps[0][0]:
            continue
        at, end = start, 0
        for lemma, reach, after_gap in steps[1:]:
            if mode == "strict":
                options = [q for q in range(at + 1, min(len(words), at + 2 + reach)) if words[q] == lemma]
            else:
                stop = next((q for q in range(at, len(words)) if words[q] == "."), len(words))
                options = [q for q in range(at, stop) if words[q] == lemma]
            if not options:
                at = None
                break
            at = options[0]
            end = at if after_gap else end
        if at is not None and at < len(words) - 1:
            found.append((start, at if mode == "sentence" else end))
    return sorted(found)


def test_patterns_against_walk(spark):
    rng = random.Random(5)
    docs = {i: [rng.choice("abc.") for _ in range(rng.randint(1, 25))] for i in range(60)}
    rows = token_rows(spark, docs).persist()
    for pattern, mode in ((["a", "*2", "b", "*1", "c"], "strict"), (["a", "b"], "strict"), (["a", "*3", "a", "b"], "strict"), (["a", "b", "c"], "sentence")):
        got = sorted((r.doc_id, r.start, r.end) for r in patterns.matches(rows, pattern, mode).collect())
        assert got == sorted((d, s, e) for d, words in docs.items() for s, e in walk(words, pattern, mode)), (pattern, mode)


def test_match_on_last_token_does_not_count(spark):
    assert patterns.matches(token_rows(spark, {1: ["a", "b"]}), ["a", "b"]).count() == 0
    assert patterns.matches(token_rows(spark, {1: ["a", "b", "x"]}), ["a", "b"]).collect()[0].end == 0


def test_no_going_back(spark):
    words = ["a", "b", "b", "c", "x"]
    assert patterns.matches(token_rows(spark, {1: words}), ["a", "*2", "b", "c"]).count() == 0


ELEMENTS = "doc_id int, elements array<struct<elem_id:int,tag:string,text:string>>"


def test_annotation_agrees_with_windows(spark):
    rng = random.Random(5)
    docs = [(i, [(e, rng.choice(["p", "h1", "li", None]), " ".join(rng.choices(["a", ".", "b!", "", "Č"], k=rng.randint(0, 6)))) for e in range(rng.randint(0, 8))]) for i in range(40)]
    rows = tokens.annotate(spark.createDataFrame(docs, ELEMENTS)).persist()
    ranges = tokens.with_sections(rows.drop("sec_start", "sec_end"))
    fields = ("doc_id", "pos", "sec_start", "sec_end")
    assert sorted(map(str, rows.select(*fields).collect())) == sorted(map(str, ranges.select(*fields).collect()))
    for pattern, mode in ((["a", "*2", "b"], "strict"), (["a", "b"], "sentence")):
        own = patterns.matches(rows, pattern, mode).collect()
        assert sorted(own) == sorted(patterns.matches(rows.drop("last", "stop"), pattern, mode).collect())
    rows.unpersist()


def upper_annotator():
    made.append(1)
    return lambda texts: [([t.upper()], [t], ["if_1"]) for t in texts]


made = []


def test_annotators_are_made_once_and_asked_once_a_text(spark):
    rows = tokens.annotate(spark.createDataFrame([(1, [(0, "p", "x"), (1, "p", "x")]), (2, [(0, "p", "y")])], ELEMENTS), factory=upper_annotator)
    assert sorted((r.doc_id, r.form, r.lemma, r.ne, r.tag) for r in rows.collect()) == [(1, "X", "x", "if_1", "p")] * 2 + [(2, "Y", "y", "if_1", "p")]


def test_sections(spark):
    rows = tokens.annotate(spark.createDataFrame([(1, [(0, "p", "x y"), (1, "h2", "t u"), (2, "p", "v w .")]), (2, None), (None, [(0, "p", None)])], ELEMENTS))
    assert sorted((r.sec_start, r.sec_end) for r in tokens.section_ranges(rows).collect()) == [(0, 2), (2, 6)]
    held = {r.pos: r.sec_start for r in tokens.with_sections(rows).collect()}
    assert held == {0: 0, 1: 0, 2: 2, 3: 2, 4: 2, 5: 2, 6: None}


def test_detokenise(spark):
    rows = spark.createDataFrame([(1, 0, "a", "No", None), (1, 1, "b", None, r"\n\t"), (1, 2, "c", None, None), (1, 3, "d", None, r"\s")], "doc_id int, pos int, form string, space_after string, spaces_after string")
    assert tokens.detokenise(rows).first().text == "ab\n\tc d"


def test_entities(spark):
    rows = spark.createDataFrame([(1, 0, 0, "Firma", "if_1"), (1, 1, 0, "s.r.o.", "if_1-A_2"), (1, 5, 0, "Praha", "A_3")], "doc_id int, pos int, elem_id int, form string, ne string")
    found = entities.groups(rows).persist()
    assert sorted((r.ent_type, r.start, r.end, r.text) for r in found.collect()) == [("A", 1, 1, "s.r.o."), ("A", 5, 5, "Praha"), ("if", 0, 1, "Firma s.r.o.")]
    ranges = spark.createDataFrame([(1, 0, 6, 3)], "doc_id int, from_pos int, to_pos int, p int")
    near = entities.closest(entities.in_ranges(found, ranges, ["A"]), "p", ["doc_id"]).collect()
    assert [r.text for r in near] == ["s.r.o."]  # both two away: the earlier
    assert entities.in_ranges(found, ranges, ["if"], [" firma S.R.O.".strip()]).count() == 0


ENTITIES = "doc_id int, ent_type string, ne_id string, elem_id int, start int, end int, text string, sec_start int"


def policy(spark, text, names=()):
    words = text.split()
    rows = tokens.with_sections(token_rows(spark, {1: words}))
    marks = [(1, kind, str(i), 0, words.index(w), words.index(w), w, 0) for i, (kind, w) in enumerate(names)]
    return rows, spark.createDataFrame(marks, ENTITIES)


def test_controller_and_duration(spark):
    rows, found = policy(spark, "Firma Praha být správce váš osobní údaj po doba 3 léta . osobní údaj zpracovávat po doba 12 léta konec a b c d e f", [("if", "Firma"), ("A", "Praha")])
    got = extract.controller(rows, found).first()
    assert (got.company, got.address) == ("Firma", "Praha")
    got = extract.duration(rows, extract.rule_sentences(rows, extract.DURATION), ["po", "doba", "*1", "léta"], "doba").first()
    assert (got.amount, got.text) == (12, "po doba 12 léta")


def test_duration_without_number(spark):
    rows, _ = policy(spark, "a b c d e osobní údaj zpracovávat po doba nezbytný nutný x y z w")
    got = extract.duration(rows, extract.rule_sentences(rows, extract.DURATION), ["po", "doba", "*1", "léta"], "doba").first()
    assert (got.amount, got.text) == (0, "e osobní údaj zpracovávat po doba nezbytný nutný x y")


def test_company_without_address_then_with(spark):
    rows, found = policy(spark, "správce osobní údaj Alfa zpracování osobní údaj Beta Brno konec", [("if", "Alfa"), ("io", "Beta"), ("A", "Brno")])
    assert extract.controller(rows, found).first().company == "Alfa"


def test_third_parties_keep_place_of_last_and_span_of_first(spark):
    words = "předávat osobní údaj Alfa Beta Alfa konec".split()
    rows = tokens.with_sections(token_rows(spark, {1: words}))
    found = spark.createDataFrame([(1, "if", str(i), 0, p, p, words[p], 0) for i, p in enumerate((3, 4, 5))], ENTITIES)
    assert [(r.text, r.start) for r in extract.third_parties(rows, found).orderBy("ord").collect()] == [("Beta", 4), ("Alfa", 3)]


def test_sections_stand_in_for_missing_parties(spark):
    rows, found = policy(spark, "předávat osobní údaj a příjemce osobní údaj konec dnes", [("if", "konec")])
    got = extract.third_parties(rows, found.where("false")).orderBy("ord").collect()
    assert [(r.ord, r.text, r.start) for r in got] == [(i, "předávat osobní údaj a příjemce osobní údaj konec", 0) for i in (0, 1)]
    assert extract.third_parties(rows.where("pos > 4"), found.where("false")).count() == 0


def test_categories(spark):
    rows, _ = policy(spark, "zpracovávat jméno a datum narození . jiný adresa konec")
    got = extract.categories(rows).select("category").distinct().collect()
    assert sorted(r.category for r in got) == ["Datum narození", "Jméno"]


def test_ngram_misses_last(spark):
    rows = token_rows(spark, {1: ["a", "b", "a", "b"]})
    assert [r.start for r in tokens.ngram_starts(rows, ["a", "b"]).collect()] == [0]


def test_annotate_distinct(spark):
    seen = tokens.annotate_distinct(spark.createDataFrame([(1, "x"), (2, "x")], "i int, text string"), lambda t: t.withColumn("n", F.length("text")))
    assert sorted(tuple(r) for r in seen.select("i", "n").collect()) == [(1, 1), (2, 1)]


def test_packs_in_a_row_agree_with_token_tables(spark):
    rng = random.Random(8)
    words = ["a", "b", "c", "Firma", "12", ".", "g", "Č"]
    texts = [[(e, rng.choice(["p", "h1", None, None]), " ".join(rng.choices(words, k=rng.randint(0, 14)))) for e in range(rng.randint(0, 7))] for _ in range(200)]
    docs = spark.createDataFrame([*enumerate(texts), (None, [(0, "p", "a b a b c")]), (300, None)], ELEMENTS)
    packs = dict(
        controller_rules=["a *1 b", "b *2 c"], party_rules=["b *2 a", "c *1 c"], duration_rules=["a *3 c", "b a"], access_rules=["a b"], delete_rules=["c *1 a *1 b"],
        deadline_rules=["g a", "a *2 a"], starts=["a", "b"], named={"x": "c", "y": "a g"}, unit=("b", "*2", "c"), word="a",
    )
    marks = lambda forms, first: [{"Firma": f"if_{p // 2}-A_{p // 3}", "g": f"io_{p}", "Č": f"A_{p // 3}"}.get(form) for p, form in enumerate(forms, first)]
    rows = tokens.annotate(docs)
    half, third = [(F.col("pos") / n).cast("int").cast("string") for n in (2, 3)]
    ne = F.when(F.col("form") == "Firma", F.concat(F.lit("if_"), half, F.lit("-A_"), third)).when(F.col("form") == "g", F.concat(F.lit("io_"), F.col("pos").cast("string")))
    rows = rows.withColumn("ne", ne.when(F.col("form") == "Č", F.concat(F.lit("A_"), third))).persist()
    expected = extract.extractions(rows, entities.groups(rows), **packs).collect()
    found = held.extractions(docs, marker=marks, **packs).collect()
    assert sorted(found) == sorted(expected) and len({r.type for r in found}) == 8
    rows.unpersist()


def test_extractions_move_no_rows(spark, tmp_path):
    import __spark_entry__

    spark.createDataFrame([(1, "Firma of the world in the end of"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["extract_all"](spark, str(tmp_path))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_repeated_ids_are_extracted_too(spark, tmp_path):
    import __spark_entry__

    text = "one of the many of them in the town of Rome . all that"
    spark.createDataFrame([(1, text), (2, text), (2, text)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["extract_all"](spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} == {1, 2} and {r.type for r in found if r.doc_id == 1} <= {r.type for r in found if r.doc_id == 2}


def test_coverage_stages_no_tokens(spark, tmp_path, monkeypatch):
    import __spark_entry__
    from pagemill.plans import token_queries

    monkeypatch.setattr(token_queries, "staged", lambda *a: 1 / 0)
    spark.createDataFrame([(1, "one of the many of them"), (2, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = __spark_entry__.queries()["coverage_report"](spark, str(tmp_path)).collect()
    assert {r.type: (r.n_pages, r.share) for r in found}["lhuta"] == (1, 0.5)
