"""Queries of block-wise classification, attribution, sentence selection, and span location."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import text as tx
from pagemill.operators import rationales as rat
from pagemill.operators import scorer, spans
from pagemill.plans.registry import query, table
from pagemill.plans.token_queries import SP, TOKENS, _annotated, _extracted, _tokens
from pagemill.runtime import ship
from pagemill.sources import html as src

_WORDS = f"ws AS (SELECT doc_id, list_filter(string_split_regex(text, '{SP}+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL)"
_WEIGHT = "(CAST('0x' || substr(md5(lemma), 1, 8) AS BIGINT)::DOUBLE / 2147483648.0 - 1.0)"
_BLOCKS = f"""bl AS (SELECT doc_id, pos // 510 AS block, count(*) AS n, sum(CAST(round({_WEIGHT} * 1000000) AS BIGINT))::BIGINT AS millionths FROM tok GROUP BY 1, 2),
    lg AS (SELECT doc_id, CAST(block AS INTEGER) AS block, n, millionths / 1000000 AS z FROM bl)"""
_SLOPES = " + ".join(f"{0.5 if i in (0, 25) else 1} * (1 / (1 + exp(-z * {i / 25!r}))) * (1 - 1 / (1 + exp(-z * {i / 25!r})))" for i in range(26))
_ATTR = f"""{TOKENS}, {_BLOCKS}, sl AS (SELECT doc_id, block, ({_SLOPES}) / 25 AS m FROM lg),
    att AS (SELECT t.doc_id, s.block, pos, sent_id, {_WEIGHT} * m AS attr FROM tok t JOIN sl s ON t.doc_id = s.doc_id AND t.pos // 510 = s.block)"""
# Ties at the cut: attributions are compared after rounding to twelve places on both sides.
_TOP = """rnd AS (SELECT doc_id, block, pos, sent_id, round(greatest(attr, 0), 12) AS a FROM att),
    cut AS (SELECT doc_id, round(quantile_cont(a, 0.9), 12) AS c FROM rnd GROUP BY doc_id),
    top AS (SELECT doc_id, pos, sent_id, CASE WHEN a < c THEN 0 ELSE a END AS attr FROM rnd JOIN cut USING (doc_id))"""


@query(
    f"""WITH {_WORDS} SELECT doc_id, len(w) AS n_ids, CAST(ceil(len(w) / 510) AS BIGINT) AS n_blocks, CASE WHEN len(w) = 0 THEN 0 ELSE len(w) - 510 * (ceil(len(w) / 510) - 1) + 2 END::BIGINT AS n_last
        FROM ws"""
)
def block_split(spark, sf_dir):
    ids = F.transform(tx.words(F.col("text")), lambda w: F.length(w))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", ids.alias("ids"))
    rows = rows.withColumn("blocks", tx.blocks(F.col("ids"), 101, 102))
    last = F.coalesce(F.size(F.try_element_at("blocks", F.lit(-1))), F.lit(0))
    return rows.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.size("blocks").cast("bigint").alias("n_blocks"), F.greatest(last, F.lit(0)).cast("bigint").alias("n_last")
    )


@query(f"WITH {TOKENS}, {_BLOCKS} SELECT doc_id, max(CASE WHEN z > 0 THEN 1 ELSE 0 END) >= 1 AS is_positive FROM lg GROUP BY doc_id")
def page_any_positive(spark, sf_dir):
    return rat.any_positive(rat.block_scores(_annotated(spark, sf_dir)))


@query(f"WITH {_ATTR} SELECT doc_id, block, pos, round(attr, 9) AS attr FROM att")
def ig_linear(spark, sf_dir):
    return rat.linear_attributions(_tokens(spark, sf_dir)).select("doc_id", "block", "pos", F.round("attr", 9).alias("attr"))


_PLAIN = f"""{TOKENS}, lg AS (SELECT doc_id, CAST(pos // 510 AS INTEGER) AS block, count(*) AS n, sum({_WEIGHT}) AS z FROM tok GROUP BY 1, 2)"""


@query(f"WITH {_PLAIN} SELECT doc_id, block, n, round(1 / (1 + exp(-z)), 9) AS probability, CAST(z > 0 AS INTEGER) AS prediction FROM lg")
def scorer_blocks(spark, sf_dir):
    """Blocks through the scorer interface."""
    rows = scorer.score_blocks(table(spark, sf_dir, "documents"))
    return rows.withColumn("probability", F.round("probability", 9))


@query(
    f"""WITH {_PLAIN}, sl AS (SELECT doc_id, block, ({_SLOPES}) / 25 AS m FROM lg)
        SELECT t.doc_id, s.block, pos, round({_WEIGHT} * m, 9) AS attr FROM tok t JOIN sl s ON t.doc_id = s.doc_id AND t.pos // 510 = s.block"""
)
def scorer_gradients(spark, sf_dir):
    """Integrated gradients through the scorer interface: embedding lookup, gradient of the softmax, path mean."""
    rows = scorer.block_attributions(table(spark, sf_dir, "documents"))
    return rows.withColumn("attr", F.round("attr", 9))


@query(
    """SELECT vec_id, list_transform(embedding[2:len(embedding) - 1], lambda x: (x::DOUBLE + 0.5) / 2) AS attr
       FROM embeddings"""
)
def attr_format(spark, sf_dir):
    vectors = F.transform("embedding", lambda x: F.array(x.cast("double"), F.lit(0.5)))
    return table(spark, sf_dir, "embeddings").select("vec_id", rat.token_attributions(vectors).alias("attr"))


def _top(spark, sf_dir):
    rows = rat.linear_attributions(_tokens(spark, sf_dir)).withColumn("attr", F.round(F.greatest("attr", F.lit(0.0)), 12))
    return rat.top_attributions(rows)


@query(f"WITH {_ATTR}, {_TOP} SELECT doc_id, pos, round(attr, 9) AS attr FROM top")
def attr_top_percent(spark, sf_dir):
    return _top(spark, sf_dir).select("doc_id", "pos", F.round("attr", 9).alias("attr"))


@query(f"WITH {_ATTR}, {_TOP} SELECT doc_id, sent_id, count(*) AS n, sum(CASE WHEN attr <> 0 THEN 1 ELSE 0 END)::BIGINT AS hits FROM top GROUP BY 1, 2")
def sentence_hits(spark, sf_dir):
    return rat.sentence_hits(_top(spark, sf_dir))


# Sentences and hits that need no floating-point logits: hits are words of six letters or more.
_HITS = "h AS (SELECT doc_id, sent_id, count(*) AS n, sum(CASE WHEN length(form) >= 8 THEN 1 ELSE 0 END)::BIGINT AS hits FROM tok GROUP BY 1, 2)"


@query(
    f"""WITH RECURSIVE {TOKENS}, {_HITS}, p AS (SELECT doc_id, list(hits / n) AS r FROM h GROUP BY doc_id),
        lv(doc_id, r, depth, cut) AS (SELECT doc_id, r, 0, CAST(0.2 AS DOUBLE) FROM p
          UNION ALL SELECT doc_id, r, depth + 1, CASE WHEN len(list_filter(r, lambda x: x >= cut)) > 6 THEN cut + CAST(0.025 AS DOUBLE) ELSE cut - CAST(0.025 AS DOUBLE) END
          FROM lv WHERE depth < 10 AND NOT (len(list_filter(r, lambda x: x >= cut)) BETWEEN 4 AND 6)),
        k AS (SELECT doc_id, max_by(cut, depth) AS cut FROM lv WHERE len(list_filter(r, lambda x: x >= cut)) > 0 GROUP BY doc_id)
        SELECT h.doc_id, sent_id FROM h JOIN k USING (doc_id) WHERE hits / n >= cut"""
)
def rationale_select(spark, sf_dir):
    rows = _annotated(spark, sf_dir).groupBy("doc_id", "sent_id").agg(F.count("*").alias("n"), F.sum((F.length("form") >= 8).cast("bigint")).alias("hits"))
    return rat.select_sentences(rows)


@query()
def rationales(spark, sf_dir):
    return rat.rationales(_tokens(spark, sf_dir))


_SIMPLE = f"""st AS (SELECT doc_id, list_filter(flatten(list_transform(string_split_regex(text, '{SP}+'),
    lambda x: [regexp_replace(x, '[.,!?;:]$', ''), regexp_extract(x, '[.,!?;:]$')])), lambda y: y <> '') AS toks FROM documents WHERE text IS NOT NULL)"""


@query(f"WITH {_SIMPLE} SELECT doc_id, len(toks) AS n_tokens, md5(array_to_string(toks, ' ')) AS digest FROM st")
def simple_tokens(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.simple_tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


# What is looked for: five tokens from the middle of the text, the third replaced.
_WANTED = "wt AS (SELECT doc_id, toks, list_concat(toks[len(toks) // 2 + 1 : len(toks) // 2 + 2], ['?'], toks[len(toks) // 2 + 4 : len(toks) // 2 + 5]) AS wanted FROM st WHERE len(toks) >= 10)"


def _wanted(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text", tx.simple_tokens(F.col("text")).alias("tokens")).where(F.size("tokens") >= 10)
    half = F.floor(F.size("tokens") / 2).cast("int")
    return rows.withColumn("wanted", F.concat(F.slice("tokens", half + 1, F.lit(2)), F.array(F.lit("?")), F.slice("tokens", half + 4, F.lit(2))))


@query(
    f"""WITH {_SIMPLE}, {_WANTED}, win AS (SELECT doc_id, wanted, unnest(range(0, len(toks) - 5)) AS i, toks FROM wt),
        sc AS (SELECT doc_id, i, len(list_intersect(list_distinct(toks[i + 1 : i + 5]), list_distinct(wanted))) / len(list_distinct(list_concat(toks[i + 1 : i + 5], wanted))) AS j FROM win),
        b AS (SELECT doc_id, i, j, row_number() OVER (PARTITION BY doc_id ORDER BY j DESC, i) AS rn FROM sc)
        SELECT doc_id, CAST(CASE WHEN j > 0 THEN i ELSE 0 END AS INTEGER) AS "at", j AS jaccard, j < 0.5 AS whole FROM b WHERE rn = 1"""
)
def span_locate(spark, sf_dir):
    return spans.located(_wanted(spark, sf_dir)).select("doc_id", "at", "jaccard", "whole")


_JOIN = "list_reduce(list_transform({x}, lambda t, k: CASE WHEN k > 1 AND regexp_matches(t, '^[\\p{{L}}\\p{{N}}]+$') THEN ' ' || t ELSE t END), lambda a, b: a || b)"


@query(
    f"""WITH {_SIMPLE}, {_WANTED}, x AS (SELECT doc_id, text, wanted FROM wt JOIN documents USING (doc_id)),
        k AS (SELECT doc_id, text, wanted, unnest([4, 3, 2, 1]) AS k FROM x),
        f AS (SELECT doc_id, text, k, {_JOIN.format(x="wanted[1:k]")} AS head, {_JOIN.format(x="wanted[len(wanted) - k + 1:]")} AS tail FROM k)
        SELECT doc_id, CAST(coalesce(max_by(instr(text, head) - 1, k) FILTER (WHERE instr(text, head) > 0), 0) AS INTEGER) AS start_offset,
          CAST(coalesce(max_by(instr(text, tail) - 1 + length(tail), k) FILTER (WHERE instr(text, tail) > 0), any_value(length(text)) - 1) AS INTEGER) AS end_offset
        FROM f GROUP BY doc_id"""
)
def span_offsets(spark, sf_dir):
    return spans.edge_offsets(_wanted(spark, sf_dir)).select("doc_id", "start_offset", "end_offset")


@query(
    """WITH f AS (SELECT user_id AS doc_id, event_type AS type, props AS text FROM events WHERE props IS NOT NULL AND props <> '')
       SELECT doc_id, type, array_to_string(list_sort(list_distinct(list(text))), ', ') AS short_text FROM f GROUP BY 1, 2"""
)
def entity_short_text(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return spans.short_texts(events.select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("type"), F.col("props").alias("text")))


@query()
def highlights(spark, sf_dir):
    """Extractions of the documents as highlight records."""
    found = _extracted(_tokens(spark, sf_dir)).where("type IN ('company', 'third_companies')")
    texts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("page"))
    rows = found.join(texts, "doc_id").withColumn("wanted", F.split("text", " "))
    rows = spans.edge_offsets(rows, "page", "wanted").groupBy("doc_id", "type").agg(F.array_sort(F.collect_set(F.struct("start_offset", "end_offset"))).alias("s"))
    return spans.highlight_records(rows.select("doc_id", "type", F.posexplode("s").alias("ord", "o")).select("doc_id", "type", "ord", "o.*"))


@query()
def analyze_pages(spark, sf_dir):
    """Pages with the first block of each element kind marked up."""
    ship(spark)
    pages = table(spark, sf_dir, "pages").select("url", "html")
    first = src.with_elements(pages).where("text <> '' AND tag IN ('h1', 'p')").groupBy("url", "tag").agg(F.min_by("text", "elem_id").alias("text"))
    marks = first.groupBy("url").agg(F.array_sort(F.collect_list(F.struct(F.concat("tag", F.lit("-start-0")).alias("value"), "text"))).alias("marks"))
    return spans.marked(pages.join(marks, "url", "left")).select("url", "html", F.size("marks").alias("n_marks"))
