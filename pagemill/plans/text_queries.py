"""Queries over pages and texts: scans, plain text, sentences, shingles, signatures, change detection."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagemill.functions import similarity as sim
from pagemill.functions import text as tx
from pagemill.plans.registry import query, table
from pagemill.runtime import ship
from pagemill.sources import html as src

SP = r"[ \t\n\r\f\v]"
SHARE = 0.1


@query("SELECT page_id, url, length(html) AS n_chars FROM pages")
def page_scan(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", F.length("html").cast("bigint").alias("n_chars"))


@query("SELECT 'ok' AS status")
def health(spark, sf_dir):
    return spark.sql("SELECT 'ok' AS status")


@query()
def block_elements(spark, sf_dir):
    return src.with_elements(table(spark, sf_dir, "pages").select("url", "html"))


@query()
def plaintext_html(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ship(spark)
    return pages.select("url", tx.normalise(src.plain_text(F.col("html"))).alias("text"))


@query()
def paragraph_text(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    ship(spark)
    return pages.select("url", tx.trim_start(src.paragraph_text(F.col("html")), 15).alias("text"))


@query(f"SELECT doc_id, regexp_replace(lower(text), '{SP}+', ' ', 'g') AS text FROM documents")
def plaintext_norm(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.normalise(F.col("text")).alias("text"))


@query(
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
          '(?is)<script\b[^>]*>.*?</script\s*>', '', 'g'), '(?is)<iframe\b[^>]*>.*?</iframe\s*>', '', 'g'),
          '(?is)<style\b[^>]*>.*?</style\s*>', '', 'g'), '(?is)<(?:link|meta)\b[^>]*>', '', 'g') AS html FROM pages"""
)
def strip_tags(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", src.strip_tags(F.col("html")).alias("html"))


@query(
    f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        f AS (SELECT doc_id, ls, list_position(list_transform(ls, lambda x:
                len(list_filter(string_split_regex(x, '{SP}+'), lambda w: w <> '')) > 15), true) AS i FROM l)
        SELECT doc_id, CASE WHEN i > 0 THEN array_to_string(ls[i:], '') ELSE ls[len(ls)] || array_to_string(ls, '') END AS text FROM f"""
)
def trim_start(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", tx.trim_start(F.col("text"), 15).alias("text"))


_SENTENCES = f"""s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?]){SP}+', '\\1' || chr(1), 'g'), chr(1)) AS ss
                       FROM documents WHERE text IS NOT NULL)"""


@query(f"WITH {_SENTENCES} SELECT doc_id, CAST(unnest(range(0, len(ss))) AS INTEGER) AS ord, unnest(ss) AS sentence FROM s")
def sentence_split(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("ord", "sentence"))


@query(
    f"""WITH {_SENTENCES},
        c AS (SELECT doc_id, list_transform(list_filter(ss, lambda x: NOT regexp_matches(x, '{SP}{{3}}')),
                lambda x: regexp_replace(x, '{SP}+', ' ', 'g')) AS cs FROM s)
        SELECT doc_id, CAST(unnest(range(0, len(cs))) AS INTEGER) AS ord, unnest(cs) AS sentence FROM c"""
)
def sentence_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(tx.clean_sentences(tx.sentences(F.col("text")))).alias("ord", "sentence"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, '.')))) AS i, unnest(string_split(text, '.')) AS x FROM documents),
        p AS (SELECT doc_id, i, string_split_regex(regexp_replace(x, '^{SP}+|{SP}+$', '', 'g'), '{SP}{{2,}}') AS ps FROM l),
        k AS (SELECT doc_id, i, CASE WHEN len(ps) > 1 THEN list_filter(ps, lambda y:
                len(list_filter(string_split_regex(y, '{SP}+'), lambda w: w <> '')) > 1) ELSE ps END AS ps FROM p)
        SELECT doc_id, sum(len(ps))::BIGINT AS n_pieces, sum(len(array_to_string(ps, '')))::BIGINT AS n_chars FROM k GROUP BY doc_id"""
)
def sentence_post(spark, sf_dir):
    pieces = tx.sentence_pieces(F.split("text", r"\."))
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", pieces.alias("p"))
    return docs.select("doc_id", F.size("p").cast("bigint").alias("n_pieces"), F.length(F.array_join("p", "")).cast("bigint").alias("n_chars"))


_NORM = f"n AS (SELECT doc_id, regexp_replace(lower(text), '{SP}+', ' ', 'g') AS t FROM documents)"
_SHINGLES = f"""{_NORM},
    sh AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS shingle FROM (SELECT doc_id, t, unnest(range(1, length(t) - 3)) AS i FROM n WHERE length(t) >= 5))"""
_HASH = "CAST('0x' || substr(md5(shingle), 1, 8) AS BIGINT)"


@query(f"WITH {_SHINGLES} SELECT doc_id, count(*) AS n_shingles FROM sh GROUP BY doc_id")
def shingle_count(spark, sf_dir):
    ship(spark)
    counts = table(spark, sf_dir, "documents").select("doc_id", sim.shingle_count(tx.normalise(F.col("text"))).alias("n_shingles"))
    return counts.where("n_shingles > 0")


@query(f"WITH {_SHINGLES} SELECT doc_id, min({_HASH}) AS low, max({_HASH}) AS high FROM sh GROUP BY doc_id")
def shingle_hash(spark, sf_dir):
    rows = sim.shingle_rows(table(spark, sf_dir, "documents"))
    h = sim.digest_hash(F.col("shingle"))
    return rows.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high"))


def _signature_sql(source: str) -> str:
    places = ", ".join(f"min((h * {a} + {b}) % {sim.PRIME})" for a, b in map(sim.permutation, range(sim.PERMUTATIONS)))
    return f"SELECT doc_id, [{places}] AS signature FROM (SELECT doc_id, {_HASH} % {sim.PRIME} AS h FROM {source}) GROUP BY doc_id"


@query(f"WITH {_SHINGLES}, sig AS ({_signature_sql('sh')}) SELECT doc_id, array_to_string(signature, ',') AS signature FROM sig")
def minhash_signature(spark, sf_dir):
    rows = sim.signatures(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.array_join(F.transform("signature", lambda x: x.cast("string")), ",").alias("signature"))


def repeated(docs) -> bool:
    """Whether several rows have one doc_id; if not, what is said of a document needs its own row only."""
    return not docs.groupBy("doc_id").count().where("count > 1").isEmpty()


def _versions(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs, docs.withColumn("text", tx.replaced_words(F.col("text"), F.col("doc_id"), SHARE))


_CHANGED = f"""w AS (SELECT doc_id, string_split(text, ' ') AS ws FROM documents),
    x AS (SELECT doc_id, unnest(range(0, len(ws))) AS i, unnest(ws) AS w FROM w),
    y AS (SELECT doc_id, i, w, md5(doc_id || ':' || i) AS d FROM x),
    z AS (SELECT doc_id, string_agg(CASE WHEN CAST('0x' || substr(d, 1, 4) AS BIGINT) < {int(SHARE * 65536)}
            THEN 'zz' || substr(d, 5, 6) ELSE w END, ' ' ORDER BY i) AS text FROM y GROUP BY doc_id),
    zn AS (SELECT doc_id, regexp_replace(lower(text), '{SP}+', ' ', 'g') AS t FROM z),
    zh AS (SELECT DISTINCT doc_id, substr(t, i, 5) AS shingle FROM (SELECT doc_id, t, unnest(range(1, length(t) - 3)) AS i FROM zn WHERE length(t) >= 5))"""
_BOTH = f"WITH {_SHINGLES}, {_CHANGED}, a AS ({_signature_sql('sh')}), b AS ({_signature_sql('zh')})"
_EQUAL = f"len(list_filter(range(1, {sim.PERMUTATIONS + 1}), lambda i: a.signature[i] = b.signature[i]))"


def _pairs(spark, sf_dir):
    before, after = map(sim.signatures, _versions(spark, sf_dir))
    return before.join(after.withColumnRenamed("signature", "after"), "doc_id")


@query(f"{_BOTH} SELECT doc_id, {_EQUAL} / {sim.PERMUTATIONS} AS jaccard FROM a JOIN b USING (doc_id)")
def minhash_jaccard(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", sim.estimate(F.col("signature"), F.col("after")).alias("jaccard"))


@query(f"{_BOTH} SELECT doc_id, {_EQUAL} / {sim.PERMUTATIONS} > 0.95 AS is_same FROM a JOIN b USING (doc_id)")
def same_document(spark, sf_dir):
    return _pairs(spark, sf_dir).select("doc_id", sim.same(F.col("signature"), F.col("after")).alias("is_same"))


@query(
    f"""WITH {_SHINGLES}, {_CHANGED},
        u AS (SELECT doc_id, shingle, max(l) AS l, max(r) AS r FROM
               (SELECT doc_id, shingle, 1 AS l, 0 AS r FROM sh UNION ALL SELECT doc_id, shingle, 0, 1 FROM zh) GROUP BY doc_id, shingle)
        SELECT doc_id, sum(l * r)::BIGINT AS shared, count(*) AS total, sum(l * r) / count(*) AS jaccard FROM u GROUP BY doc_id"""
)
def jaccard_exact(spark, sf_dir):
    before, after = _versions(spark, sf_dir)
    if repeated(before):
        return sim.exact_jaccard(sim.shingle_rows(before), sim.shingle_rows(after))
    changed = tx.replaced_words(F.col("text"), F.col("doc_id"), SHARE)
    return sim.version_jaccard(before.select("doc_id", tx.normalise(F.col("text")).alias("before"), tx.normalise(changed).alias("after")))


@query()
def change_grid(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    shares = (0.001, 0.01, 0.025, 0.05, 0.1, 0.2, 0.5)
    after = tx.replaced_versions(F.col("text"), F.col("doc_id"), shares)
    after = F.zip_with(F.array(*map(F.lit, shares)), after, lambda share, text: F.struct(share.alias("share"), tx.normalise(text).alias("after")))
    versions = docs.select(tx.normalise(F.col("text")).alias("before"), F.explode(after).alias("v")).select("v.share", "before", "v.after").where("before <> after")
    return sim.change_grid(versions, [0.8, 0.9, 0.95, 0.99])
