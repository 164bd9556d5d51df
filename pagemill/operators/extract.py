"""Rule packs: what a privacy policy says, as joins of patterns, sections, sentences and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagemill.operators import entities as ents
from pagemill.operators import patterns as pats
from pagemill.operators.tokens import whole_sentences

# The rule packs for Czech policies (lemmas; ``*n`` is a gap), entity types, and names that are no party.
CONTROLLER = ["správce *1 osobní údaj", "zpracování *1 osobní údaj", "souhlas *1 zpracování *1 osobní údaj *8 provozovatel"]
THIRD_PARTIES = ["předávat *2 osobní údaj", "kdo moci *2 údaj *3 zpřístupnit", "příjemce *1 osobní údaj"]
DURATION = [
    "osobní *3 údaj *3 zpracovávat *3 po *3 doba",
    "osobní *3 údaj *3 být *3 zpracovávaný *3 po *3 doba",
    "uchovávat *3 osobní *3 údaj *3 po *3 doba",
    "data *3 být *3 uchovaný *3 po *3 doba",
    "data *3 být *3 uchovávaný *3 po *3 doba",
    "uložený *3 po *3 doba *3 léta",
    "být *3 zpracovávaný *3 po *3 doba",
    "být *3 uložený *4 po *3 doba",
]
ACCESS = [
    "právo *3 přístup *5 osobní údaj",
    "přehled *3 osobní údaj",
    "potvrzení *4 osobní údaj",
    "potvrzení *4 zpracovávat *2 zpracovávat",
    "přístup *2 svůj *2 osobní údaj",
]
DELETE = ["právo *2 výmaz", "výmaz *2 osobní údaj", "osobní údaj *2 výmaz"]
DEADLINE = ["obdržet *4 žádost", "žádosti *4 lhůtu"]
CATEGORY_STARTS = ["zpracovávat", "osobní údaj", "ukládat"]
CATEGORIES = {
    "Jméno": "jméno",
    "Příjmení": "příjmení",
    "Datum narození": "datum narození",
    "Adresa": "adresa",
    "Průkaz": "průkaz totožnost",
    "IČ": "IČ",
    "DIČ": "DIČ",
    "Poloha": "lokační údaj",
    "SPZ": "SPZ",
    "Podpis": "podpis",
    "Datová schránka": "datový schránka",
}
PARTY_TYPES = ["if", "io"]
ADDRESS_TYPES = ["A"]
NO_PARTY = [
    "Evropského parlamentu",
    "Rady",
    "EU",
    "ES",
    "GDPR",
    "Pplk",
    "Úřadu pro ochranu osobních údajů",
    "Úřad pro ochranu osobních údajů",
    "Správce",
    "Provozovatel",
    "Vámi",
]
LABELS = {
    "company": "Správce údajů",
    "address": "Adresa správce",
    "third_companies": "Třetí strany",
    "duration": "Doba uchování",
    "access": "Právo přístupu",
    "delete": "Právo výmazu",
    "lhuta": "Lhůta žádosti",
    "druh": "Kategorie údajů",
}


def lemmas(rules: list[str]) -> list[list[str]]:
    return [rule.split() for rule in rules]


def _with_section(found: DataFrame, tokens: DataFrame, key: str) -> DataFrame:
    """(key, pattern_id, hit, from_pos, to_pos): matches with the section that holds their start, if there is one."""
    held = tokens.where(F.col("sec_start").isNotNull())
    held = held.select(key, F.col("pos").alias("hit"), F.col("sec_start").alias("from_pos"), F.col("sec_end").alias("to_pos"))
    return found.select(key, "pattern_id", F.col("start").alias("hit")).join(held, [key, "hit"])


def _found(tokens: DataFrame, rules: list[str], key: str, found: DataFrame | None) -> DataFrame:
    """Matches of a pack, unless they come with the call."""
    return pats.pack_matches(tokens, lemmas(rules), key=key) if found is None else found


def controller(tokens: DataFrame, entities: DataFrame, rules: list[str] = CONTROLLER, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """(key, company, company_start, address, address_start): one row a document that names a company.

    Of the hits in order, the first whose section has a company with an address decides; if none has, the first
    company. The company is the one nearest to the section's start, the address the one nearest to the company.
    """
    hits = _with_section(_found(tokens, rules, key, found), tokens, key).drop("pattern_id").distinct()
    party = ents.closest(ents.in_sections(entities, hits, PARTY_TYPES, NO_PARTY, key), "from_pos", [key, "hit"])
    party = party.select(key, "hit", "from_pos", "to_pos", F.col("text").alias("company"), F.col("start").alias("company_start"), F.expr("(start + end) div 2").alias("middle"))
    near = ents.closest(ents.in_sections(entities, party, ADDRESS_TYPES, key=key), "middle", [key, "hit"])
    near = near.select(key, "hit", F.col("text").alias("address"), F.col("start").alias("address_start"))
    order = Window.partitionBy(key).orderBy(F.col("address").isNull(), "hit")
    picked = party.join(near, [key, "hit"], "left").withColumn("__rank", F.row_number().over(order)).where("__rank = 1")
    return picked.select(key, "company", "company_start", "address", "address_start")


def third_parties(tokens: DataFrame, entities: DataFrame, rules: list[str] = THIRD_PARTIES, key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """(key, ord, text, start): parties of the hits' sections, each text once.

    Hits come rule by rule; a text has the place of its last mention and the span of its first. A document whose hits
    lead to no party has the text of each hit's section instead, in order of the hits.
    """
    hits = _with_section(_found(tokens, rules, key, found), tokens, key)
    rows = ents.in_sections(entities, hits, PARTY_TYPES, NO_PARTY, key)
    place = F.struct("pattern_id", "hit", "start", "ent_type", "ne_id")
    rows = rows.groupBy(key, "text").agg(F.max(place).alias("last"), F.min_by("start", place).alias("start"))
    order = Window.partitionBy(key).orderBy("last")
    parties = rows.select(key, (F.row_number().over(order) - 1).alias("ord"), "text", "start")
    lone = hits.join(rows.select(key).distinct(), key, "left_anti")
    words = tokens.withColumnRenamed("sec_start", "from_pos").join(lone.select(key, "from_pos").distinct(), [key, "from_pos"])
    texts = words.groupBy(key, "from_pos").agg(F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("rows"))
    texts = texts.select(key, "from_pos", F.array_join(F.col("rows.form"), " ").alias("text"))
    order = Window.partitionBy(key).orderBy("pattern_id", "hit")
    sections = lone.join(texts, [key, "from_pos"]).select(key, (F.row_number().over(order) - 1).alias("ord"), "text", F.col("from_pos").alias("start"))
    return parties.unionByName(sections)


def rule_sentences(tokens: DataFrame, rules: list[str], key: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """Sentences that hold the start or end of a match."""
    return whole_sentences(tokens, pats.hits(_found(tokens, rules, key, found), key), key)


def categories(tokens: DataFrame, starts: list[str] = CATEGORY_STARTS, named: dict[str, str] = CATEGORIES, key: str = "doc_id") -> DataFrame:
    """(key, category, sent_id, first, last, text) of the sentences that mention a category after a start."""
    rules = [f"{start} {suffix}".split() for suffix in named.values() for start in starts]
    names = F.array(*[F.lit(name) for name in named for _ in starts])
    found = pats.pack_matches(tokens, rules, "sentence", key).withColumn("category", F.get(names, F.col("pattern_id")))
    found = found.select(key, F.explode(F.array("start", "end")).alias("pos"), "category").distinct()
    marked = tokens.join(found, [key, "pos"]).select(key, "category", "sent_id").distinct()
    texts = whole_sentences(tokens, found, key)
    return marked.join(texts, [key, "sent_id"])


def duration(tokens: DataFrame, sentences: DataFrame, unit: list[str], word: str, key: str = "doc_id") -> DataFrame:
    """(key, amount, text): the largest number in a match of ``unit`` within a sentence, else (0, text around ``word``).

    ``sentences`` has key, sent_id, first, last.
    """
    sentences = sentences.select(key, "sent_id", "first", "last")
    found = pats.matches(tokens, unit, key=key).join(sentences, key)
    found = found.where((F.col("start") >= F.col("first")) & (F.col("start") <= F.col("last") - len(unit)))
    spans = found.select(key, "sent_id", F.col("start").alias("a"), (F.col("end") + 1).alias("b"))
    near = tokens.where(F.col("lemma") == word).select(key, "pos").join(sentences, key).where((F.col("pos") >= F.col("first")) & (F.col("pos") <= F.col("last") - 1))
    near = near.groupBy(key, "sent_id").agg(F.min("pos").alias("pos")).join(spans.select(key, "sent_id").distinct(), [key, "sent_id"], "left_anti")
    near = near.select(key, "sent_id", (F.col("pos") - 5).alias("a"), (F.col("pos") + 5).alias("b"), F.lit(True).alias("plain"))
    both = spans.withColumn("plain", F.lit(False)).unionByName(near)
    texts = both.join(tokens.select(key, "pos", "form"), key).where((F.col("pos") >= F.col("a")) & (F.col("pos") < F.col("b")))
    texts = texts.groupBy(key, "sent_id", "a", "b", "plain").agg(F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("rows"))
    texts = texts.select(key, "plain", F.array_join(F.col("rows.form"), " ").alias("text"))
    numbers = F.when(F.col("plain"), F.array(F.lit("0"))).otherwise(F.regexp_extract_all("text", F.lit(r"([0-9]+)"), F.lit(1)))
    rows = texts.select(key, "text", F.explode(numbers).alias("n")).select(key, F.struct(F.col("n").cast("bigint").alias("amount"), "text").alias("best"))
    return rows.groupBy(key).agg(F.max("best").alias("best")).select(key, "best.amount", "best.text")


def extractions(tokens: DataFrame, entities: DataFrame, key: str = "doc_id", controller_rules=CONTROLLER, party_rules=THIRD_PARTIES, duration_rules=DURATION, access_rules=ACCESS, delete_rules=DELETE, deadline_rules=DEADLINE, starts=CATEGORY_STARTS, named=CATEGORIES, unit=("po", "doba", "*1", "léta"), word="doba") -> DataFrame:
    """(key, type, text): all packs as one relation."""
    packs = [controller_rules, party_rules, duration_rules, access_rules, delete_rules, deadline_rules]
    # One chain of joins for all strict packs; each pack reads its own range of pattern numbers.
    every = pats.pack_matches(tokens, [r for pack in packs for r in lemmas(pack)], key=key).persist()
    own, low = [], 0
    for pack in packs:
        part = every.where(F.col("pattern_id").between(low, low + len(pack) - 1))
        own.append(part.withColumn("pattern_id", F.col("pattern_id") - low))
        low += len(pack)
    pick = controller(tokens, entities, controller_rules, key, own[0])
    one = lambda df, kind, text="text": df.select(key, F.lit(kind).alias("type"), F.col(text).alias("text"))
    long = rule_sentences(tokens, duration_rules, key, own[2])
    parts = [
        one(pick, "company", "company"),
        one(pick.where("address IS NOT NULL"), "address", "address"),
        one(third_parties(tokens, entities, party_rules, key, own[1]), "third_companies"),
        one(duration(tokens, long, list(unit), word, key), "duration"),
        one(rule_sentences(tokens, access_rules, key, own[3]), "access"),
        one(rule_sentences(tokens, delete_rules, key, own[4]), "delete"),
        one(rule_sentences(tokens, deadline_rules, key, own[5]), "lhuta"),
        one(categories(tokens, starts, named, key), "druh"),
    ]
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def labelled(found: DataFrame) -> DataFrame:
    """``type`` with its display label; types without one are left out."""
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    return found.withColumn("label", labels[F.col("type")]).where(F.col("label").isNotNull())


def coverage(found: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """(type, n_pages, share): pages with a non-empty value of each type, of all pages."""
    held = found.where(F.col("text") != "").groupBy("type").agg(F.countDistinct(key).alias("n_pages"))
    total = pages.agg(F.count("*").alias("total"))
    return held.join(F.broadcast(total)).select("type", "n_pages", (F.col("n_pages") / F.col("total")).alias("share"))
