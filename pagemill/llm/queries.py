"""The registered queries: each applies its operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import ann, decontaminate, html_density, langid, line_runs, packing, pii, simhash, token_store, url_rules
from pagemill.llm.common import staging_path, table

END_ID = 1
URL_RULES = [
    url_rules.UrlRule("block", "net/"),
    url_rules.UrlRule("allow", "example.net/en/"),
    url_rules.UrlRule("block", "example.com/de/"),
    url_rules.UrlRule("allow", "org/fr/"),
    url_rules.UrlRule("block", "||spam-farm.", pattern=True),
    url_rules.UrlRule("block", "||cheap-pills.", pattern=True),
    *(url_rules.UrlRule("block", f"||{name}{n}.", pattern=True) for name in ("adserver", "tracker") for n in range(100)),
]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract_main_text(table(spark, sf_dir, "pages"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_* count base spans; n_found counts what the method adds."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", _kind(rank))).cast("bigint").alias(f"n_{kind}") for rank, kind in enumerate(pii.KINDS)]
    every = F.array_sort(F.concat("base", "found"))
    return found.select(
        "doc_id",
        *counts,
        F.sha2(pii.spans_text(F.col("base")), 256).alias("base_sha256"),
        pii.spans_text(every).alias("spans"),
        F.size("found").cast("bigint").alias("n_found"),
    )


def _kind(rank: int):
    return lambda span: span["kind"] == rank


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, model = langid.fit(docs.where(langid.fold(F.col("doc_id")) != 0))
    judged = langid.identify(docs.select("doc_id", "text"), langs, model)
    held_out = F.coalesce(langid.fold(F.col("doc_id")) == 0, F.lit(False))
    return judged.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "languages", "proportions")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("__kept", 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=END_ID, with_ids=False)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = staging_path(spark, "token-store")
    token_store.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=END_ID)
    return token_store.read_digests(spark, path)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).drop("pattern")


QUERIES = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_pii,
        op3_language_id,
        op4_line_dedup,
        op5_simhash_near_dedup,
        op6_packing,
        op7_decontamination,
        op8_token_store,
        op9_nearest_neighbours,
        op10_url_filters,
    )
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

ORACLE_SQL = {
    "op4_line_dedup": f"""
        WITH parts AS (
          SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        numbered AS (
          SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM parts),
        keyed AS (
          SELECT doc_id, pos, lines[pos] AS line,
                 translate(trim(lines[pos], {_SPACE}), '{_UPPER}', '{_LOWER}') AS key FROM numbered),
        held AS (
          SELECT key, count(DISTINCT doc_id) AS n, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key),
        judged AS (
          SELECT k.doc_id, k.pos, k.line, coalesce(h.n >= 3 AND h.top <> k.doc_id, false) AS dropped
          FROM keyed k LEFT JOIN held h ON k.key = h.key)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM judged GROUP BY doc_id""",
    "op7_decontamination": """
        WITH words AS (
          SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM documents),
        grams AS (
          SELECT DISTINCT doc_id, array_to_string(w[pos : pos + 4], ' ') AS gram
          FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS pos FROM words WHERE len(w) >= 5)),
        item_words AS (
          SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS w FROM benchmark),
        item_grams AS (
          SELECT DISTINCT item_id, array_to_string(w[pos : pos + 4], ' ') AS gram
          FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS pos FROM item_words WHERE len(w) >= 5)),
        sizes AS (SELECT item_id, count(*) AS item_shingles FROM item_grams GROUP BY item_id),
        shared AS (
          SELECT doc_id, item_id, count(*) AS shared FROM grams JOIN item_grams USING (gram) GROUP BY doc_id, item_id),
        short AS (SELECT item_id, array_to_string(w, ' ') AS phrase FROM item_words WHERE len(w) BETWEEN 1 AND 4),
        lines AS (SELECT doc_id, ' ' || array_to_string(w, ' ') || ' ' AS line FROM words)
        SELECT doc_id, item_id, item_shingles, shared, shared / item_shingles AS containment
        FROM shared JOIN sizes USING (item_id) WHERE shared >= 0.8 * item_shingles - 1e-9
        UNION ALL
        SELECT doc_id, item_id, 1, 1, 1.0 FROM lines JOIN short ON contains(line, ' ' || phrase || ' ')""",
    "op10_url_filters": f"""
        WITH parts AS (
          SELECT page_id, translate(coalesce(url, ''), '{_UPPER}', '{_LOWER}') AS low, contains(coalesce(url, ''), '://') AS web,
                 substr(url, position('://' IN url) + 3) AS rest FROM pages),
        sites AS (
          SELECT page_id, low, CASE WHEN web THEN translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') ELSE '' END AS host,
                 CASE WHEN web THEN regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM parts),
        rules(rule, verdict) AS (
          VALUES ('net/', 'block'), ('example.net/en/', 'allow'), ('example.com/de/', 'block'), ('org/fr/', 'allow')),
        fits AS (
          SELECT page_id, max_by(rule, length(rule)) AS rule, max_by(verdict, length(rule)) AS verdict
          FROM sites JOIN (SELECT *, substr(rule, 1, position('/' IN rule) - 1) AS h, substr(rule, position('/' IN rule)) AS p FROM rules)
            ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
        SELECT s.page_id, host, path, rule,
               coalesce(verdict, CASE WHEN regexp_matches(low, '^[^:/?#]*://([^/?#]*\\.)?(spam-farm|cheap-pills|(adserver|tracker)([1-9][0-9]|[0-9]))\\.') THEN 'block' ELSE 'allow' END) AS verdict
        FROM sites s LEFT JOIN fits USING (page_id)""",
}
