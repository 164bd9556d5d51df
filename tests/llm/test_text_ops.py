"""Extraction, personal data, language, URL rules: edge cases and plain restatements."""

import math
import random
import re
import time

import numpy as np
import pytest
from pagemill.llm import html_density, langid, pii, url_rules
from pyspark.sql import functions as F

PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header>Top</header><nav><a href=x>Menu</a></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div>
<article><h1>Head &amp; shoulders</h1><p>First  long paragraph with <b>bold</b> words<br>and more.<p>Second paragraph, unclosed
<div class="share-buttons">Share</div><ul><li>Item one<li>Item two</ul></article>
<form><input><label>Mail</label></form><section id="comments"><p>Reader says hi to everybody here and writes a lot of text.</p></section>
<aside>More</aside><script>var x="<p>no</p>"</script><footer>&copy; Foot</footer></body></html>"""


def test_main_text():
    assert html_density.main_text(PAGE) == "Head & shoulders\n\nFirst long paragraph with bold words and more.\n\nSecond paragraph, unclosed\n\nItem one\n\nItem two"


@pytest.mark.parametrize("source,text", [(None, ""), ("", ""), ("<p></p>", ""), ("just text", "just text"), ("<b>a</b> <i>b", "a b"), ("a <", "a <"), ("<p>x<!-- y", "x")])
def test_main_text_edges(source, text):
    assert html_density.main_text(source) == text


def test_main_text_without_article():
    body = "<div>" + "".join(f"<p>Paragraph number {i} has quite a few words in it.</p>" for i in range(5)) + "</div>"
    links = "<div>" + "".join(f"<a href=/{i}>link {i}</a> " for i in range(9)) + "</div>"
    text = html_density.main_text(f"<body>{links}{body}</body>")
    assert "link" not in text and text.count("Paragraph") == 5


@pytest.mark.parametrize("before,after", [('<div class="content-sidebar-wrap">', "</div>"), ('<div class="has-sidebar">', '</div><div class="related"><article>Teaser</article></div>')])
def test_hinted_wrapper_of_the_article_stays(before, after):
    page = f'<body>{before}<article><p>The whole story stands here.</p></article><div class="sidebar">Side</div>{after}</body>'
    assert html_density.main_text(page) == "The whole story stands here."


def test_headings_and_sections_named_by_a_hint_word_stay():
    page = """<article><h2 id="Related_work">Related work</h2><p id="notice-period">Three months.</p>
<section id="Social_policy"><p>It is strict.</p></section><section id="comments"><p>Reader says hi, and hi, and hi to all.</p></section></article>"""
    assert html_density.main_text(page) == "Related work\n\nThree months.\n\nIt is strict."


LONG = "".join(f"<p>Paragraph number {i} of the story has quite a few words in it.</p>" for i in range(5))
STORY = "\n\n".join(f"Paragraph number {i} of the story has quite a few words in it." for i in range(5))


@pytest.mark.parametrize("name", ["content has-sidebar", "no-sidebar", "post search-result", "main-content ad-free", "with-comments", "sidebar"])
@pytest.mark.parametrize("tag", ["div", "section"])
def test_class_of_a_wrapper_does_not_empty_the_page(name, tag):
    assert html_density.main_text(f'<body><{tag} class="{name}">{LONG}</{tag}></body>') == STORY
    assert html_density.main_text(f'<body><div class="{name}"><div class="ad">Buy now</div><article>{LONG}</article></div></body>') == STORY


def test_density_decides():
    # Not the first article: a list of links, then the story in two articles of the same kind.
    teasers = "<article>" + "".join(f'<p><a href="/{i}">Teaser {i}</a></p>' for i in range(6)) + "</article>"
    second = LONG.replace("story", "sequel")
    text = html_density.main_text(f"<body>{teasers}<article>{LONG}</article><article>{second}</article></body>")
    assert text == STORY + "\n\n" + STORY.replace("story", "sequel")
    # Captions and remarks of the article stay, thin text outside of it does not.
    page = f"<body><div>a<br>b <i>c</i> <i>d</i></div><article>By me<h1>Title</h1><div>{LONG}</div><p>End.</p></article></body>"
    assert html_density.main_text(page) == f"By me\n\nTitle\n\n{STORY}\n\nEnd."
    # Comments longer than the article, hidden and header parts.
    page = f'<body><article><header><h1>Top</h1></header>{LONG}</article><div id="comments">{second * 3}</div><p hidden>x</p><div aria-hidden="true">y</div><p style="display:none">z</p></body>'
    assert html_density.main_text(page) == STORY


def plain_densities(page, dead, hinted):
    """The same by recursion over a tree, from the definition."""
    children = {}
    for i in range(1, len(page.tag)):
        children.setdefault(page.parent[i], []).append(i)
    texts = {}
    for _, node, text in page.segments:
        texts.setdefault(node, []).append(text)

    def sizes(i, link):
        if dead[i]:
            return 0, 0, 0, 0
        link = link or hinted[i] or page.tag[i] == "a"
        own = sum(len(re.sub(r"\s", "", t)) for t in texts.get(i, []))
        below = [(sizes(c, link), page.tag[c] == "a", dead[c]) for c in children.get(i, [])]
        live = [(s, a) for s, a, gone in below if not gone]
        return (
            own + sum(s[0] for s, _ in live),
            sum(s[1] + 1 for s, _ in live),
            own * link + sum(s[2] for s, _ in live),
            sum(s[3] + a for s, a in live),
        )

    whole = sizes(0, False)
    up = {c: i for i, cs in children.items() for c in cs}
    linked = lambda i: i in up and (hinted[up[i]] or page.tag[up[i]] == "a" or linked(up[i]))
    found = {}
    for i in range(len(page.tag)):
        c, t, lc, lt = sizes(i, linked(i))
        found[i] = 0.0 if dead[i] or c == lc else html_density.composite_density(c, t, lc, lt, whole[0], whole[2])
    return [found[i] for i in range(len(found))], [sum(found[c] for c in children.get(i, [])) for i in range(len(found))]


def test_densities_against_recursion(spark):
    pages = [r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html").collect()] + [PAGE]
    for source in pages:
        page = html_density._Page(source)
        dead, hinted = html_density._inherited(page, page.cut), html_density._inherited(page, page.hinted)
        density, sums, _ = html_density.densities(page, dead, hinted)
        plain, plain_sums = plain_densities(page, dead, hinted)
        assert density == pytest.approx(plain) and sums == pytest.approx(plain_sums)


@pytest.mark.parametrize("source", ["<div>" * 20000 + "text", "<a " * 200000, "<a \"'>" * 100001, "<p><i>" + "<div>" * 100000, "<!-- " * 100000, '<a b="' * 100000 + ">", "<script>" * 100000])
def test_main_text_is_linear(source):
    start = time.perf_counter()
    html_density.main_text(source)
    assert time.perf_counter() - start < 2
    assert html_density.main_text("<p>" + "word " * 200000).count("word") == 200000


def test_extract_rows(spark):
    rows = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "y"), (None, None, None, None)], "page_id long, url string, html string, text string")
    got = html_density.extract_main_text(rows).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_density.extract_main_text(rows.limit(0)).collect() == []


SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(digits) <= 19 and luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans_against_plain_regex(spark):
    rng = random.Random(11)
    alphabet = ["a@b.co", "x", ".", "@", "+", "1", "4111 1111 1111 1111", "-", " ", "10.0.0.1", "300.1.1.1", "+1 (415) 555-0123", "é𝒳", "\n", "_", "5500-0000-0000-0004", "0"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(400)]
    texts += [None, "", "9" * 5000, "a" * 50000 + "@b.c", "a@b.c_x@y.z", "1.2.3.4.5.6.7.8", "300.1.1.1.2.3.4.5", "+" + "1" * 9 + " ", "1.2.3.4. " * 2000, "a@b.co " * 300 + "é+1 (415) 555-0123 " * 300]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.s for r in pii.find_personal_data(rows).select("doc_id", pii.spans_text(F.col("base")).alias("s")).collect()}
    assert got == {i: base_spans(t) for i, t in enumerate(texts)}


def test_contexts_discover_further_spans(spark):
    texts = [f"please call me at +1 (415) 555-0{i}23 any time" for i in range(100, 106)] + ["please call me at 415-555-0177 any time", "order 415-555-0199 was sent", None]
    rows = spark.createDataFrame([(i % 8, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = [(r.doc_id, [texts[6][s.start : s.end] for s in r.found]) for r in pii.find_personal_data(rows).collect() if r.found]
    assert got == [(6, ["415-555-0177"])]


def test_contexts_discover_numbers_with_blanks(spark):
    numbers = ["030 555 0177", "(415) 555-0178", "0171 / 555 01 79"]
    texts = [f"please call me at +1 (415) 555-0{i}23 any time" for i in range(100, 106)] + [f"please call me at {n} any time" for n in numbers] + ["order 030 555 0199 was sent"]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted(texts[r.doc_id][s.start : s.end] for r in pii.find_personal_data(rows).collect() for s in r.found)
    assert got == sorted(numbers)


def test_general_patterns_discover_what_exact_ones_miss(spark):
    """Planted: eight seeds a cue in ever changing words; numbers beside the same cues, and as many beside other words."""
    rng = random.Random(6)
    filler = [f"word{c}" for c in "abcdefghijklmnopqrstuvwxyz"]
    say = lambda n: " ".join(rng.choices(filler, k=n))
    texts, planted = [], {}
    for cue in ("tel", "mobile"):
        texts += [f"{say(5)} {cue} +1 (415) 555-0{rng.randint(100, 999)} {say(4)}" for _ in range(8)]
        for number in ("(415) 555-0177", "415 555 0188", "415-555-0199", "030/555.01.77"):
            planted[len(texts)] = number
            texts.append(f"{say(5)} {cue} {number} {say(4)}")
    for number in ("415 555 0188", "415-555-0200", "2019 12 31 11", "4111 1111 1111 1112", "999.999.999.999"):
        texts += [f"{say(5)} {number} {say(4)}"] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.found] for r in pii.find_personal_data(rows).collect() if r.found}
    assert found == {i: [number] for i, number in planted.items()}  # recall and precision 1


def test_scores_against_a_plain_restatement(spark):
    rng = random.Random(7)
    edges = {(rng.randrange(2), rng.choice(["LR a _ b", "LL c d _", "*L e _", "*R _ f"]), f"v{rng.randrange(12)}") for _ in range(70)}
    seeds = {(k, f"v{i}") for k in range(2) for i in range(5)}
    rows = spark.createDataFrame([(k, p, v, (k, v) in seeds) for k, p, v in edges], "kind int, pattern string, value string, seed boolean")
    score, trust = {(k, v): float((k, v) in seeds) for k, _, v in edges}, {}
    for _ in range(2):
        for k, p in {e[:2] for e in edges}:
            own = [v for kk, pp, v in edges if (kk, pp) == (k, p)]
            needed = 3 * pii.GENERAL if p[0] == "*" else 3
            trust[k, p] = sum(score[k, v] for v in own) / len(own) * min(1, sum((k, v) in seeds for v in own) / needed)
        for k, v in score:
            score[k, v] = 1.0 if (k, v) in seeds else 1 - math.prod(max(1e-9, 1 - trust[kk, p]) for kk, p, vv in edges if (kk, vv) == (k, v))
    got = pii.score_graph(rows, 2, 3).collect()
    assert len(got) == len(edges)
    for r in got:
        assert r.trust == pytest.approx(trust[r.kind, r.pattern]) and r.score == pytest.approx(score[r.kind, r.value])


def test_personal_data_repeated_rows_and_empty_table(spark):
    rows = spark.createDataFrame([(1, "a@b.co"), (1, "a@b.co"), (None, "a@b.co")], "doc_id long, text string")
    assert pii.find_personal_data(rows).count() == 3
    assert pii.find_personal_data(rows.limit(0)).count() == 0


SAMPLE = {"en": "the house and the garden with a river that was there", "de": "das haus und der garten mit einem fluss der dort war", "fr": "la maison et le jardin avec une rivière qui était là"}


def training(spark, rng):
    rows = []
    for lang, text in SAMPLE.items():
        for _ in range(60):
            rows.append((len(rows), " ".join(rng.choices(text.split(), k=30)), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_language(spark):
    rng = random.Random(2)
    langs, model = langid.fit(training(spark, rng))
    assert langs == ["de", "en", "fr"]
    mixed = SAMPLE["de"] + " " + SAMPLE["de"] + " " + SAMPLE["fr"]
    one, two, *none = langid.judge([SAMPLE["en"], mixed, None, "123 !?", ""], langs, model)
    assert one[0] == ["en"] and two[0] == ["de", "fr"] and none == [([], [], 0.0)] * 3
    assert one[1][0] > 0.9 and 0.4 < two[1][0] < 0.85
    long = (SAMPLE["fr"] + " ") * 20000
    assert langid.judge([long], langs, model)[0][0] == ["fr"]
    rows = langid.identify(training(spark, rng).select("doc_id", "text"), langs, model)
    assert rows.where("lang_pred = 'en'").count() == 60


def plain_judgement(text, langs, model, rounds=8):
    """Expectation-maximisation and penalised selection for one text, from the definition."""
    bins, first, _ = langid._trigrams(text)
    words = np.split(bins, first[1:])
    like = []
    for word in words:
        logs = [sum(model[b, c] for b in word) for c in range(len(langs) + 1)]
        like.append([math.exp(x - max(logs)) for x in logs])

    def fit(use, part):
        for _ in range(rounds):
            total = [0.0] * len(use)
            for row in like:
                mixed = [row[c] * p for c, p in zip(use, part)]
                total = [t + x / sum(mixed) for t, x in zip(total, mixed)]
            part = [t / len(like) for t in total]
        return part

    every = list(range(len(langs) + 1))
    share = fit(every, [1 / len(every)] * len(every))
    order, best = sorted(every[:-1], key=lambda c: (-share[c], c)), (-math.inf, None)
    for k in range(1, len(langs) + 1):
        use = [*order[:k], len(langs)]
        part = [share[c] + 1e-6 for c in use]
        part = fit(use, [p / sum(part) for p in part])
        value = sum(math.log(sum(row[c] * p for c, p in zip(use, part))) for row in like) - k * math.log(len(like) + 1) / 2
        if value <= best[0]:
            break
        best = value, dict(zip(use, part))
    return {langs[c]: p for c, p in best[1].items() if c < len(langs)}, best[1][len(langs)]


def test_language_sets_against_a_plain_restatement(spark):
    rng = random.Random(3)
    langs, model = langid.fit(training(spark, rng))
    texts = []
    for _ in range(40):
        words = [w for lang in rng.sample(langs, rng.randint(1, 3)) for w in rng.choices(SAMPLE[lang].split(), k=rng.randint(1, 40))]
        texts.append(" ".join(words + ["xqzk vvjw"] * rng.randint(0, 10)))
    found = langid.judge(texts, langs, model)
    assert {len(names) for names, _, _ in found} >= {1, 2}
    for text, (names, parts, background) in zip(texts, found):
        plain, rest = plain_judgement(text, langs, model)
        assert dict(zip(names, parts)) == pytest.approx(plain, abs=1e-6) and background == pytest.approx(rest, abs=1e-6)


def test_language_with_clashing_names(spark):
    rng = random.Random(4)
    langs, model = langid.fit(training(spark, rng))
    rows = spark.createDataFrame([(1, SAMPLE["de"], 7, "x", 1, "k"), (None, None, 8, "y", 2, "k")], "doc_id long, text string, score int, lang_pred string, background int, keep0 string")
    got = langid.identify(rows, langs, model, keep=tuple(rows.columns)).collect()
    assert [(r.doc_id, r.lang_pred, r.keep0) for r in got] == [(1, "de", "k"), (None, "und", "k")]
    known = langid.in_known_language(rows, langs, model, 0.9)
    assert known.dtypes == rows.dtypes and [tuple(r) for r in known.collect()] == [(1, SAMPLE["de"], 7, "x", 1, "k")]


def test_language_without_labels(spark):
    rows = spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string")
    langs, model = langid.fit(rows)
    assert [r.lang_pred for r in langid.identify(rows.select("doc_id", "text"), langs, model).collect()] == ["und"]


def test_held_out_accuracy(spark):
    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    langs, model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 0))
    held = docs.where(langid.fold(F.col("doc_id")) == 0)
    judged = langid.identify(held, langs, model, keep=("doc_id", "lang"))
    assert judged.where("lang = lang_pred").count() / held.count() > 0.97


def judged(spark, urls, rules):
    rows = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return [(r.host, r.path, r.rule, r.verdict) for r in url_rules.judge_urls(rows, rules).orderBy("page_id").collect()]


@pytest.mark.parametrize("most_inline", [50_000, 0])
def test_url_rules(spark, monkeypatch, most_inline):
    monkeypatch.setattr(url_rules, "MAX_INLINE_RULES", most_inline)
    R = url_rules.UrlRule
    rules = [R("block", "net/"), R("allow", "example.net/en/"), R("block", "example.com"), R("block", "||ads.*.org^", True), R("block", "|ftp://", True), R("block", "*.exe|", True)]
    urls = [None, "", "x", "http://NET/", "http://a.net", "https://w.Example.NET/en/?q", "http://example.com", "http://notexample.com/", "x?a://b.net/", "http://ads.q.org/z", "http://bads.q.org/", "ftp://h/p", "http://h/a.EXE", "http://h/a.exe?x", "http://a\nb.net/"]
    verdicts = [(r, v) for _, _, r, v in judged(spark, urls, rules)]
    assert verdicts == [
        (None, "allow"), (None, "allow"), (None, "allow"), ("net/", "block"), (None, "allow"), ("example.net/en/", "allow"), ("example.com", "block"), (None, "allow"),
        ("net/", "block"), (None, "block"), (None, "allow"), (None, "block"), (None, "block"), (None, "allow"), ("net/", "block"),
    ]


def test_rarest_token_is_counted_over_the_table(spark):
    rows = spark.createDataFrame([(1, "http://a.b/"), (2, "http://a.c/"), (3, None)], "page_id long, url string")
    assert url_rules.token_counts(rows, ["a", "b", "z"]) == {"a": 2, "b": 1}
    assert url_rules.judge_urls(rows.limit(0), [url_rules.UrlRule("block", "b/")]).count() == 0
    assert url_rules.judge_urls(rows, []).where("verdict = 'allow'").count() == 3


def test_url_rules_with_clashing_names_and_hot_hosts(spark, monkeypatch):
    rules = [url_rules.UrlRule("block", "spam.example/"), url_rules.UrlRule("block", "||ads1.", pattern=True)] + [url_rules.UrlRule("block", f"||x{i}y.", pattern=True) for i in range(300)]
    rows = [(i % 50, f"http://{'spam.example' if i % 3 else f'x{i}y.org'}/{i}", "old", 1, "u") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, verdict string, site int, low string")
    got = []
    for most in (50_000, 0):
        monkeypatch.setattr(url_rules, "MAX_INLINE_RULES", most)
        judged_rows = url_rules.judge_urls(pages, rules, keep=tuple(pages.columns))
        assert judged_rows.columns == ["page_id", "url", "site", "low", "host", "path", "rule", "verdict", "pattern"]
        got.append(sorted(map(str, judged_rows.collect())))
    assert got[0] == got[1] and len(got[0]) == 400 and sum("verdict='block'" in r for r in got[0]) == 366
