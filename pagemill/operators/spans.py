"""Where an extracted fact stands in its page: token windows, character offsets, marked-up HTML."""

from __future__ import annotations

import html as entities
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import joined_tokens, let
from pagemill.runtime import ship

ATTRIBUTE = "data-element-id"
LEAST_JACCARD = 0.5
EDGE_TOKENS = 4


def best_window(tokens: Column, wanted: Column) -> Column:
    """struct(at, jaccard) of the first window of as many tokens with the largest set similarity.

    The window that would end on the last token is not tried; (0, 0.0) if there is none.
    """

    def search(pair: Column) -> Column:
        own, target, m = pair["tokens"], F.array_distinct(pair["wanted"]), F.size(pair["wanted"])

        def score(i: Column) -> Column:
            window = F.array_distinct(F.slice(own, i + 1, m))
            return F.struct((F.size(F.array_intersect(window, target)) / F.size(F.array_union(window, target))).alias("jaccard"), (-i).alias("minus"))

        count = F.size(own) - m
        none = F.struct(F.lit(0.0).alias("jaccard"), F.lit(0).alias("minus"))

        def of_hits(hits: Column) -> Column:
            # Only windows that hold a wanted token can score: those that start up to m - 1 before one.
            near = F.flatten(F.transform(hits, lambda p: F.sequence(F.greatest(p - m + 1, F.lit(0)), p)))
            starts = F.filter(F.array_distinct(near), lambda i: i < count)
            return F.coalesce(F.array_max(F.transform(starts, score)), none)

        positions = F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda p: F.array_contains(target, F.get(own, p)))
        best = F.when((count > 0) & (m > 0), let(positions, of_hits)).otherwise(none)
        return let(best, lambda b: F.struct(F.when(b["jaccard"] > 0, -b["minus"]).otherwise(0).alias("at"), b["jaccard"].alias("jaccard")))

    return let(F.struct(tokens.alias("tokens"), wanted.alias("wanted")), search)


def located(rows: DataFrame, tokens: str = "tokens", wanted: str = "wanted") -> DataFrame:
    """Adds at, jaccard and ``whole`` (the match is too weak: the span is the whole element)."""
    rows = rows.withColumn("__best", best_window(F.col(tokens), F.col(wanted)))
    whole = F.col("__best.jaccard") < LEAST_JACCARD
    return rows.withColumns({"at": F.col("__best.at"), "jaccard": F.col("__best.jaccard"), "whole": whole}).drop("__best")


def edge_offset(text: Column, wanted: Column, end: bool) -> Column:
    """Character offset of the first (or end of the last) tokens in a text: up to four tokens, fewer until found.

    Not found: 0 for the start, the last position for the end.
    """

    def search(pair: Column) -> Column:
        own, goal = pair["text"], pair["wanted"]

        def offset(k: Column) -> Column:
            words = joined_tokens(F.slice(goal, -k, k) if end else F.slice(goal, F.lit(1), k))
            at = F.position(words, own)
            return F.when(at > 0, at - 1 + (F.length(words) if end else F.lit(0)))

        sizes = F.sequence(F.least(F.lit(EDGE_TOKENS), F.size(goal)), F.lit(1))
        found = F.filter(F.transform(sizes, offset), lambda x: x.isNotNull())
        return F.coalesce(F.get(found, 0), F.length(own) - 1 if end else F.lit(0))

    return let(F.struct(text.alias("text"), wanted.alias("wanted")), search)


def edge_offsets(rows: DataFrame, text: str = "text", wanted: str = "wanted") -> DataFrame:
    return rows.withColumns(
        {"start_offset": edge_offset(F.col(text), F.col(wanted), False), "end_offset": edge_offset(F.col(text), F.col(wanted), True)}
    )


def short_texts(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, type, short_text): texts of each type, each once, joined by a comma in sorted order."""
    held = found.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy(key, "type")
    return held.agg(F.array_join(F.array_sort(F.collect_set("text")), ", ").alias("short_text"))


def highlight_records(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """One record an appearance (key, type, ord, start_offset, end_offset): which attribute values mark it."""
    value = F.concat(F.col("type"), F.lit("-start-"), F.col("ord").cast("string"))
    return found.select(key, F.lit(ATTRIBUTE).alias("attribute"), value.alias("attr_start_value"), value.alias("attr_end_value"), "start_offset", "end_offset", "type")


def marked(pages: DataFrame, html: str = "html", marks: str = "marks") -> DataFrame:
    """``html`` with the text of each mark wrapped in a span; ``marks``: array of struct(value, text).

    A mark goes to the first text run that holds its text; markup is never cut.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def wrap(sources: pd.Series, all_marks: pd.Series) -> pd.Series:
        return pd.Series([mark_up(s, m) for s, m in zip(sources, all_marks)], dtype=object)

    return pages.withColumn(html, wrap(html, marks))


def mark_up(source: str | None, marks) -> str:
    parts = re.split(r"(<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<[^>]*>)", source or "", flags=re.S | re.I)
    for mark in marks if marks is not None else []:
        wanted = mark["text"]
        for i in range(0, len(parts), 2):
            if wanted and wanted in entities.unescape(parts[i]):
                plain = entities.unescape(parts[i])
                at = plain.index(wanted)
                quoted = [entities.escape(p, quote=False) for p in (plain[:at], wanted, plain[at + len(wanted) :])]
                parts[i : i + 1] = [quoted[0], f'<span {ATTRIBUTE}="{entities.escape(mark["value"])}">', quoted[1], "</span>", quoted[2]]
                break
    return "".join(parts)
