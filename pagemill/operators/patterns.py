"""Gap patterns over lemmas as chains of equi-joins.

A pattern is a list of lemmas and gaps ``*n`` (up to n other tokens before the next lemma). In ``strict`` mode a
lemma without a gap before it must follow at once; the nearest next occurrence counts and there is no going back. In
``sentence`` mode each next lemma may stand anywhere from the previous match on, up to a full stop.

Each step joins the matches so far with the tokens of the next lemma only: an equi-join on the document with the
distance as residual, and a minimum. Documents bound the join; lemma filters reach
the token scan, so only tokens of a pattern's lemmas move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Pattern = list[str]


def steps_of(pattern: Pattern) -> list[tuple[int, str, bool]]:
    """(gap, lemma, after a gap) of each lemma."""
    steps, gap, wild = [], 0, False
    for part in pattern:
        if part.startswith("*"):
            gap, wild = int(part[1:]), True
        else:
            steps.append((gap, part, wild))
            gap, wild = 0, False
    return steps


def pack_matches(tokens: DataFrame, patterns: list[Pattern], mode: str = "strict", key: str = "doc_id") -> DataFrame:
    """(key, pattern_id, start, end) of every match of every pattern.

    A match must not end on the document's last token, and must start early enough for the whole pattern, gaps
    counted as one token. ``end`` is the lemma after the last gap (0 without a gap) in strict mode, the last lemma
    in sentence mode. All patterns advance together: as many joins as the longest has lemmas, however many there are.
    """
    if mode not in ("strict", "sentence"):
        raise ValueError(mode)
    steps = [steps_of(p) for p in patterns]
    lemmas = sorted({lemma for own in steps for _, lemma, _ in own})
    if "last" not in tokens.columns:  # a token table of another origin
        whole = Window.partitionBy(key)
        stops = F.sum((F.col("lemma") == ".").cast("int")).over(whole.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
        tokens = tokens.withColumns({"last": F.max("pos").over(whole), "stop": stops if mode == "sentence" else F.lit(0)})
    own = tokens.where(F.col("lemma").isin(lemmas)).select(key, "pos", "lemma", "last", ("stop" if mode == "sentence" else F.lit(0).alias("stop")))
    firsts = F.array(*[_struct(pattern_id=i, lemma=s[0][1], size=len(p)) for i, (p, s) in enumerate(zip(patterns, steps))])
    found = own.select("*", F.explode(F.filter(firsts, lambda f: f["lemma"] == F.col("lemma"))).alias("p"))
    found = found.where(F.col("pos") <= F.col("last") + 1 - F.col("p.size"))
    found = found.select(key, F.col("p.pattern_id").alias("pattern_id"), F.col("pos").alias("start"), F.col("pos").alias("at"), F.lit(0).alias("end"), "last", "stop")
    nxt = own.select(F.col(key).alias("k"), F.col("lemma").alias("next_lemma"), F.col("pos").alias("next"), F.col("stop").alias("next_stop"))
    for number in range(1, max(map(len, steps))):
        wanted = F.array(*[_struct(gap=s[number][0], lemma=s[number][1], wild=s[number][2]) if number < len(s) else F.lit(None).cast("struct<gap:int,lemma:string,wild:boolean>") for s in steps])
        rows = found.withColumn("w", F.get(wanted, F.col("pattern_id"))).select("*", F.col("w.lemma").alias("want"))
        if mode == "strict":
            near = F.col("next").between(F.col("at") + 1, F.col("at") + 1 + F.col("w.gap"))
        else:
            near = (F.col("next") >= F.col("at")) & (F.col("next_stop") == F.col("stop"))
        rows = rows.join(nxt, (F.col(key) == F.col("k")) & (F.col("want") == F.col("next_lemma")) & near, "left")
        rows = rows.groupBy(key, "pattern_id", "start", "at", "end", "last", "stop", "want", F.col("w.wild").alias("wild")).agg(F.min("next").alias("next"))
        rows = rows.where(F.col("want").isNull() | F.col("next").isNotNull())  # finished patterns pass through
        at = F.coalesce("next", "at")
        moved = F.col("wild") if mode == "strict" else F.lit(True)
        rows = rows.withColumn("end", F.when(F.col("want").isNotNull() & moved, F.col("next")).otherwise(F.col("end")))
        found = rows.withColumn("at", at).select(key, "pattern_id", "start", "at", "end", "last", "stop")
    end = F.col("end") if mode == "strict" else F.col("at")
    found = found.where(F.col("at") < F.col("last"))
    return found.select(key, "pattern_id", F.col("start").cast("int").alias("start"), end.cast("int").alias("end"))


def _struct(**values) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def matches(tokens: DataFrame, pattern: Pattern, mode: str = "strict", key: str = "doc_id", first: int = 0) -> DataFrame:
    """(key, start, end) of every match of one pattern that starts at ``first`` or later."""
    return pack_matches(tokens, [pattern], mode, key).where(F.col("start") >= first).drop("pattern_id")


def hits(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, pos): starts and ends of matches."""
    return found.select(key, F.explode(F.array("start", "end")).alias("pos"))
