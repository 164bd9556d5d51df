from pagemill.functions import text as tx
from pagemill.sources import files, html


def test_nested_blocks_own_their_text_only():
    rows = html.elements_of("<ul><li>a<ul><li>b</li></ul>c</li></ul><p>d <b>e</b></p>")
    assert [(r["elem_id"], r["tag"], r["text"]) for r in rows] == [(0, "ul", "ac"), (1, "ul", "b"), (2, "p", "d e")]


def test_paragraph_inside_list_item():
    rows = html.elements_of("<ul><li>x <p>y</p> z</li></ul>")
    assert [(r["tag"], r["text"]) for r in rows] == [("ul", "x z"), ("p", "y")]


def test_comments_scripts_and_entities():
    source = "<p>a<!-- note -->b &lt;i&gt;</p><script>var x='</p>'</script>"
    assert html.elements_of(source)[0]["text"] == "ab <i>"
    assert html.paragraphs_of(source) == "a\n note \nb <i>"
    assert html.text_of(source) == "ab <i>"


def test_unclosed_and_empty():
    assert html.elements_of(None) == [] == html.elements_of("")
    assert [r["text"] for r in html.elements_of("<p>one<br><p>two")] == ["one", "two"]


def test_with_elements_keeps_other_columns(spark):
    rows = html.with_elements(spark.createDataFrame([("u", "<h1>t</h1><p>x</p>", 5), ("v", None, 6)], "url string, html string, extra int"))
    assert [tuple(r) for r in rows.orderBy("elem_id").collect()] == [("u", 5, 0, "h1", "t"), ("u", 5, 1, "p", "x")]


def test_directory_scan_and_stream(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>á</p>", encoding="utf-8")
    (tmp_path / "b.txt").write_text("no")
    assert [tuple(r) for r in files.html_directory(spark, str(tmp_path)).collect()] == [("a.html", "<p>á</p>")]
    stream = files.html_stream(spark, str(tmp_path)).writeStream.format("memory").queryName("pages_in").trigger(availableNow=True).start()
    stream.awaitTermination(60)
    assert spark.table("pages_in").count() == 1


def test_lemma_dump(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id int, pos int, lemma string")
    files.write_lemma_text(rows, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out" / "doc_id=1")).first()[0] == "a b "


def test_conllu(spark):
    text = "# text\n1\tDobrý\tdobrý\tA\t_\t_\t0\t_\t_\tSpaceAfter=No|NE=if_1\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n\n1\tden\tden\tN\t_\t_\t0\t_\t_\t_"
    rows = files.parse_conllu(spark.createDataFrame([(7, text)], "doc_id int, conllu string")).orderBy("pos").collect()
    assert [(r.sent_id, r.pos, r.form, r.space_after, r.ne) for r in rows] == [(0, 0, "Dobrý", "No", "if_1"), (1, 1, "den", None, None)]


def test_text_functions(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([("a b\nc d e f\ng", "A  B c")], "x string, y string").select(
        tx.trim_start(F.col("x"), 3), tx.trim_start(F.col("x"), 9), tx.normalise(F.col("y")), tx.char_shingles(F.lit("abcabc"), 3), tx.char_shingles(F.lit("ab"), 3)
    )
    assert list(row.first()) == ["c d e fg", "ga bc d e fg", "a b c", ["abc", "bca", "cab"], []]


def test_sentences(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(tx.clean_sentences(tx.sentences(F.lit("One.  Two!\nThree   more? End"))), tx.sentence_pieces(F.array(F.lit(" a b  c  d e "), F.lit("x"))))
    assert list(row.first()) == [["One.", "Two!", "End"], ["a b", "d e", "x"]]


def test_blocks(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([([1, 2, 3],), ([],)], "ids array<int>").select(tx.blocks(F.col("ids"), 8, 9, 2)).collect()
    assert [r[0] for r in rows] == [[[8, 1, 2, 9], [8, 3, 9]], []]
