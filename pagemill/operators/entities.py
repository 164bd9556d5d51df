"""Named entities of token tables: grouping, ranges, and the nearest one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def groups(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ent_type, ne_id, elem_id, start, end, text, sec_start) from a column ``ne`` such as ``if_3-A_4``.

    ``sec_start`` names the section that holds the entity's start; null for token tables without sections.
    """
    if "sec_start" not in tokens.columns:
        tokens = tokens.withColumn("sec_start", F.lit(None).cast("int"))
    rows = tokens.where(F.col("ne").isNotNull()).select(key, "elem_id", "pos", "form", "sec_start", F.explode(F.split("ne", "-")).alias("part"))
    rows = rows.select(key, "elem_id", "pos", "form", "sec_start", F.split("part", "_")[0].alias("ent_type"), F.split("part", "_")[1].alias("ne_id"))
    held = rows.groupBy(key, "ent_type", "ne_id", "elem_id").agg(
        F.min("pos").alias("start"),
        F.max("pos").alias("end"),
        F.min_by("sec_start", "pos").alias("sec_start"),
        F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("rows"),
    )
    return held.select(key, "ent_type", "ne_id", "elem_id", "start", "end", F.array_join(F.col("rows.form"), " ").alias("text"), "sec_start")


def _wanted(entities: DataFrame, types: list[str], blacklist: list[str]) -> DataFrame:
    wanted = entities.where(F.col("ent_type").isin(types))
    return wanted.where(~F.lower(F.trim("text")).isin([b.lower() for b in blacklist])) if blacklist else wanted


def in_ranges(entities: DataFrame, ranges: DataFrame, types: list[str], blacklist: list[str] = [], key: str = "doc_id") -> DataFrame:  # noqa: B006
    """Entities of given types that start in [from_pos, to_pos) of ``ranges``, without blacklisted texts."""
    wanted = _wanted(entities, types, blacklist).drop("sec_start")
    return ranges.join(wanted, key).where((F.col("start") >= F.col("from_pos")) & (F.col("start") < F.col("to_pos")))


def in_sections(entities: DataFrame, sections: DataFrame, types: list[str], blacklist: list[str] = [], key: str = "doc_id") -> DataFrame:  # noqa: B006
    """The same where [from_pos, to_pos) are sections: an equi-join on the section, not on the document."""
    wanted = _wanted(entities, types, blacklist).withColumnRenamed("sec_start", "from_pos")
    return sections.join(wanted, [key, "from_pos"])


def closest(found: DataFrame, position: str, by: list[str]) -> DataFrame:
    """Of each group ``by`` the entity whose start is nearest to ``position``; ties to the earlier start."""
    order = Window.partitionBy(*by).orderBy(F.abs(F.col("start") - F.col(position)), "start", "ent_type", "ne_id")
    return found.withColumn("__rank", F.row_number().over(order)).where("__rank = 1").drop("__rank")
