"""Token tables: annotation, positions, sentences, sections, detokenising, and whole sentences of hits.

A token row is (key, pos, elem_id, tag, sent_id, form, lemma, ne, sec_start, sec_end, last, stop); ``pos`` runs over the
document, ``sent_id`` over its sentences, [sec_start, sec_end) is the token's section, ``last`` the document's last
position, ``stop`` the full stops so far. A document is annotated as a whole in one
Arrow pass without a shuffle; what needs its neighbours is settled there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagemill.runtime import ship

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
#: Words and single other characters of a text.
token_forms = re.compile(r"\w+|[^ \t\n\r\f\v\w]").findall

#: What an annotator says of one text: forms, lemmas, and entity marks such as ``if_3-A_4`` (None for no mark).
Annotation = tuple[list[str], list[str], list[str | None]]
#: An annotator maps a batch of texts to their annotations; a factory makes one, once in each Python worker.
Annotator = Callable[[list[str]], list[Annotation]]

_made: dict[Callable[[], Annotator], Annotator] = {}


def local_annotator() -> Annotator:
    """Words and single other characters; the lemma is the lower-cased form; no entities."""

    def annotate_texts(texts: list[str]) -> list[Annotation]:
        found = map(token_forms, texts)
        return [(forms, [form.lower() for form in forms], [None] * len(forms)) for forms in found]

    return annotate_texts


def line_elements(text: Column) -> Column:
    """Lines of a plain text as elements; without a tag, the number of their tokens decides."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda line, i: F.struct(i.alias("elem_id"), F.lit(None).cast("string").alias("tag"), line.alias("text")))


def section_bounds(n: int, starts: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Section [start, end) of each of ``n`` positions; ``starts`` ascending. The last position is in none (-1)."""
    starts = np.unique(np.array([0, *starts]))
    of = np.searchsorted(starts, np.arange(n), side="right") - 1
    first, end = starts[of], np.minimum(np.append(starts[1:], n)[of], n - 1)
    first[-1:], end[-1:] = -1, -1
    return first, end


def annotate(docs: DataFrame, key: str = "doc_id", elements: str = "elements", factory: Callable[[], Annotator] = local_annotator, heading_words: int = 4) -> DataFrame:
    """Token rows of documents: ``elements`` is an array of struct(elem_id, tag, text) in document order.

    A full stop ends a sentence, and so does the end of an element. Sections start at the first token of each heading
    element, and at the first token of all; an element without a tag is a heading if it has fewer than
    ``heading_words`` tokens. Each distinct text of a batch is annotated once. Null elements give no rows.
    """
    ship(docs.sparkSession)
    schema = f"{key} {dict(docs.dtypes)[key]}, pos int, elem_id int, tag string, sent_id int, form string, lemma string, ne string, sec_start int, sec_end int, last int, stop int"

    def run(batches):
        annotator = annotator_of(factory)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                yield _annotated(batch.slice(at, 64), annotator, heading_words, key)

    return docs.select(key, elements).mapInArrow(run, schema)


def annotator_of(factory: Callable[[], Annotator]) -> Annotator:
    """The annotator of this worker."""
    if factory not in _made:
        _made[factory] = factory()
    return _made[factory]


def read_documents(batch: pa.RecordBatch, annotator: Annotator, heading_words: int) -> Iterator[tuple[list, ...]]:
    """(forms, lemmas, marks, sizes, ids, tags) of each row: tokens of the document, then one value an element that has any."""
    documents = [[e for e in (own or []) if e["text"]] for own in batch.column(1).to_pylist()]
    texts = list(dict.fromkeys(e["text"] for own in documents for e in own))
    known = dict(zip(texts, annotator(texts), strict=True))
    for own in documents:
        forms, lemmas, marks, sizes, ids, tags = [], [], [], [], [], []
        for element in own:
            words, its_lemmas, its_marks = known[element["text"]]
            if words:
                forms += words
                lemmas += its_lemmas
                marks += its_marks
                sizes.append(len(words))
                ids.append(element["elem_id"])
                tags.append(element["tag"] or ("h1" if len(words) < heading_words else "p"))
        yield forms, lemmas, marks, sizes, ids, tags


def _annotated(batch: pa.RecordBatch, annotator: Annotator, heading_words: int, key: str) -> pa.RecordBatch:
    rows, whole = [], {c: [] for c in ("tag", "form", "lemma", "ne")}
    numbers = {c: [np.empty(0, np.int32)] for c in ("pos", "elem_id", "sent_id", "sec_start", "sec_end", "last", "stop")}
    for i, (forms, lemmas, marks, sizes, ids, tags) in enumerate(read_documents(batch, annotator, heading_words)):
        n = len(forms)
        if not n:
            continue
        firsts = np.cumsum([0, *sizes[:-1]])
        dots = np.fromiter((form == "." for form in forms), np.int32, n)
        stops, new = np.cumsum(dots), np.append(0, dots[:-1])
        new[firsts[1:]] = 1
        start, end = section_bounds(n, [at for at, tag in zip(firsts.tolist(), tags) if tag in HEADINGS])
        rows.append(np.full(n, i))
        whole["form"] += forms
        whole["lemma"] += lemmas
        whole["ne"] += marks
        for tag, size in zip(tags, sizes):
            whole["tag"] += [tag] * size
        for name, values in (("pos", np.arange(n)), ("elem_id", np.repeat(ids, sizes)), ("sent_id", np.cumsum(new)), ("sec_start", start), ("sec_end", end), ("last", np.full(n, n - 1)), ("stop", stops)):
            numbers[name].append(values.astype(np.int32))
    columns = {c: pa.array(v, pa.string()) for c, v in whole.items()}
    for name, parts in numbers.items():
        values = np.concatenate(parts)
        columns[name] = pa.array(values, pa.int32(), mask=values < 0)
    columns[key] = batch.column(0).take(pa.array(np.concatenate([np.empty(0, np.int64), *rows])))
    names = [key, "pos", "elem_id", "tag", "sent_id", "form", "lemma", "ne", "sec_start", "sec_end", "last", "stop"]
    return pa.RecordBatch.from_arrays([columns[n] for n in names], names)


def annotate_distinct(texts: DataFrame, annotator, text: str = "text") -> DataFrame:
    """Annotate each distinct text once and join the result back; ``annotator`` maps (text) to (text, ...)."""
    return texts.join(annotator(texts.select(text).distinct()), text, "left")


def detokenised(rows: Column) -> Column:
    """Text from an array of struct(form, space_after, spaces_after) in order."""
    decoded = lambda s: F.replace(F.replace(F.replace(F.replace(s, F.lit(r"\s"), F.lit("")), F.lit(r"\n"), F.lit("\n")), F.lit(r"\t"), F.lit("\t")), F.lit(r"\r"), F.lit("\r"))
    after = lambda t: F.when(t["space_after"] == "No", "").when(t["spaces_after"].isNotNull(), decoded(t["spaces_after"])).otherwise(" ")
    return F.array_join(F.transform(rows, lambda t: F.concat(t["form"], after(t))), "")


def detokenise(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, text) of token rows with space_after and spaces_after."""
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "form", "space_after", "spaces_after"))).alias("rows"))
    return rows.select(key, detokenised(F.col("rows")).alias("text"))


def with_sections(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """Tokens of another origin (key, pos, elem_id, tag) with their section [sec_start, sec_end), as ``annotate`` has it."""
    whole = Window.partitionBy(key)
    order, back = whole.orderBy("pos"), whole.orderBy(F.desc("pos"))
    first = F.coalesce(F.lag("elem_id").over(order) != F.col("elem_id"), F.lit(True)) & F.col("tag").isin(*HEADINGS)
    marked = tokens.withColumns({"last": F.max("pos").over(whole), "mark": F.when(first | (F.col("pos") == 0), F.col("pos"))})
    marked = marked.withColumn("sec_start", F.max("mark").over(order))
    # A running minimum from the end: a frame that looks ahead would be evaluated anew for every row.
    after = F.min("mark").over(back.rowsBetween(Window.unboundedPreceding, -1))
    marked = marked.withColumn("sec_end", F.least(F.coalesce(after, F.col("last")), F.col("last")))
    outside = F.col("pos") == F.col("last")
    none = F.lit(None).cast("int")
    return marked.withColumns({"sec_start": F.when(outside, none).otherwise(F.col("sec_start")), "sec_end": F.when(outside, none).otherwise(F.col("sec_end"))}).drop("last", "mark")


def section_ranges(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sec_start, sec_end) of the sections of token rows."""
    held = tokens.where(F.col("sec_start").isNotNull())
    return held.groupBy(key, "sec_start").agg(F.max("sec_end").alias("sec_end"))


def ngram_starts(tokens: DataFrame, lemmas: list[str], key: str = "doc_id") -> DataFrame:
    """(key, start) of an exact run of lemmas; runs that end on the last token are not reported."""
    order = Window.partitionBy(key).orderBy("pos")
    ahead = tokens.select(key, "pos", *[F.lead("lemma", i).over(order).alias(f"w{i}") for i in range(len(lemmas))], F.lead("pos", len(lemmas)).over(order).alias("more"))
    fits = F.col("more").isNotNull()
    for i, lemma in enumerate(lemmas):
        fits &= F.col(f"w{i}") == lemma
    return ahead.where(fits).select(key, F.col("pos").alias("start"))


def tokens_with_tags(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pairs): array of struct(form, elem_id) in document order."""
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "form", "elem_id"))).alias("rows"))
    return rows.select(key, F.transform("rows", lambda t: F.struct(t["form"].alias("form"), t["elem_id"].alias("elem_id"))).alias("pairs"))


def whole_sentences(tokens: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_id, first, last, text) of the sentences that hold a hit (key, pos)."""
    wanted = tokens.join(hits.select(key, "pos").distinct(), [key, "pos"], "left_semi").select(key, "sent_id").distinct()
    held = tokens.join(wanted, [key, "sent_id"], "left_semi")
    rows = held.groupBy(key, "sent_id").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("rows"))
    return rows.select(key, "sent_id", "first", "last", F.array_join(F.col("rows.form"), " ").alias("text"))
