"""Files: directories of pages, annotated text, lemma dumps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ten columns of the CoNLL-U format.
CONLLU = ("id", "form", "lemma", "upos", "xpos", "feats", "head", "deprel", "deps", "misc")


def html_directory(spark: SparkSession, path: str) -> DataFrame:
    """(url, html) of every ``*.html`` file below ``path``."""
    files = spark.read.option("pathGlobFilter", "*.html").option("recursiveFileLookup", "true").text(path, wholetext=True)
    return files.select(F.col("_metadata.file_name").alias("url"), F.col("value").alias("html"))


def html_stream(spark: SparkSession, path: str) -> DataFrame:
    """The same as an unbounded table: files that arrive in ``path``."""
    files = spark.readStream.option("pathGlobFilter", "*.html").option("wholetext", "true").schema("value string").text(path)
    return files.select(F.col("_metadata.file_name").alias("url"), F.col("value").alias("html"))


def misc_value(misc: Column, key: str) -> Column:
    """Value of one ``key=value`` pair of the misc column, null without it."""
    found = F.regexp_extract(misc, rf"(?:^|\|){key}=([^|]*)", 1)
    return F.when(found != "", found)


def parse_conllu(texts: DataFrame, key: str = "doc_id", conllu: str = "conllu") -> DataFrame:
    """Token rows (key, sent_id, pos, form, lemma, space_after, spaces_after, ne); ``pos`` runs over the text.

    Comment lines, multi-word ranges and empty nodes are no tokens.
    """
    sentences = F.filter(F.split(conllu, r"\n[ \t]*\n"), lambda s: s != "")
    lines = F.flatten(
        F.transform(
            sentences,
            lambda s, i: F.transform(
                F.filter(F.split(s, "\n"), lambda line: line.rlike(r"^[0-9]+\t")),
                lambda line: F.struct(i.alias("sent_id"), F.split(line, "\t").alias("f")),
            ),
        )
    )
    rows = texts.select(key, F.posexplode(lines).alias("pos", "row"))
    fields = [F.get("row.f", i).alias(CONLLU[i]) for i in (1, 2, 9)]
    rows = rows.select(key, F.col("row.sent_id").alias("sent_id"), "pos", *fields)
    return rows.select(
        key,
        "sent_id",
        "pos",
        "form",
        "lemma",
        misc_value(F.col("misc"), "SpaceAfter").alias("space_after"),
        misc_value(F.col("misc"), "SpacesAfter").alias("spaces_after"),
        misc_value(F.col("misc"), "NE").alias("ne"),
    )


def to_conllu(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, conllu) from token rows with sent_id, pos, form, lemma and misc."""
    line = F.concat_ws("\t", F.lit("1"), "form", "lemma", *[F.lit("_")] * 6, "misc")
    sentences = tokens.groupBy(key, "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("rows"))
    block = F.array_join(F.col("rows.line"), "\n")
    whole = sentences.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("sent_id", block.alias("block")))).alias("blocks"))
    return whole.select(key, F.array_join(F.col("blocks.block"), "\n\n").alias("conllu"))


def lemma_text(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lemmas): lemmas in order, each followed by a space."""
    rows = tokens.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "lemma"))).alias("rows"))
    return rows.select(key, F.concat(F.array_join(F.col("rows.lemma"), " "), F.lit(" ")).alias("lemmas"))


def write_lemma_text(tokens: DataFrame, path: str, key: str = "doc_id") -> None:
    """One folder of text files a key."""
    lemma_text(tokens, key).select(key, F.col("lemmas").alias("value")).write.partitionBy(key).text(path)
