"""Personal data: fixed shapes plus bootstrapped contextual extraction. DataFrame expressions only.

Base spans come from four fixed patterns. They seed a pattern-instance graph: every seed, and every token that
looks like an identifier but fits no fixed pattern, is an instance (so is a number written in groups); the words around
it are its lexical patterns. Two are exact (word before and word after; the two words before), the others generalise
them: the word before alone, the word before that with any word between, the word after alone. What has a fixed shape
but failed its test (a card by its checksum, an address with parts above 255) is no instance.

In each round a pattern's score is the mean score of its distinct instances, discounted when few distinct seeds support
it (a general pattern needs ``GENERAL`` times the seeds of an exact one), and an instance's score combines its patterns
by noisy-or. Instances that end above ``accept`` in a pattern above ``trust`` become further spans of the pattern's
kind. The graph has one edge per distinct (pattern, instance), so its size follows the number of identifier-like
tokens, never their pairs; patterns and instances of many edges are dealt to several tasks where they are joined.

Positions without Python: the text is split at the matches, and lengths of pieces and matches add up to offsets
(code points). Patterns are written so that Java's matcher neither recurses nor rescans a run of characters.

Defined results: null text counts as empty; repeated rows each get their spans; a null ``doc_id`` is a value like
any other; extra columns are ignored. Context looks ``LEFT`` characters back and ``RIGHT`` ahead; that bounds the
context, not the text that is searched. Time and memory for a text are linear in its length; offsets of n matches take
n * BLOCK / 2 additions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import salted_join, staged

KINDS = ("email", "ip", "card", "phone")
#: Java forms of the four shapes. A start inside a run that would also match from the run's start is excluded
#: (``\G``: the end of the match before), possessive loops replace loops that cannot give anything back.
SHAPES = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # A maximal run of digits with single separators, if it has 13 to 19 digits.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Tokens that may be identifiers: bounded by white space, with a digit or an at sign.
CANDIDATE = r"(?<!\S)(?=[^\s0-9@]{0,79}+[0-9@])\S{6,80}+(?!\S)"
#: Maximal runs of digits with blanks and ().-/ between: numbers written in groups. Never fails once it has a digit.
GROUPED = r"(?<![^\s\"'<\[{,;:])\(?[0-9](?:[().\x20/-]{0,3}+[0-9])++"
LEFT, RIGHT = 80, 60
#: How many times the seeds of an exact pattern a general one needs.
GENERAL = 2
#: Matches whose lengths are summed in one go; see located().
BLOCK = 128


def located(text: Column, pattern: str) -> Column:
    """Matches as array of struct(start, end, value, before, after); offsets in code points, end exclusive."""
    kind = "array<struct<start:int,end:int,value:string,before:string,after:string>>"
    empty = F.array().cast(kind)
    total = lambda lengths: F.aggregate(lengths, F.lit(0), lambda acc, n: acc + n)

    def spans(matches: Column) -> Column:
        n = F.size(matches)
        blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))

        def of_pieces(pieces: Column) -> Column:
            rows = F.arrays_zip(matches.alias("value"), F.slice(pieces, F.lit(1), n).alias("left"), F.slice(pieces, F.lit(2), n).alias("right"))
            rows = rows.cast("array<struct<value:string,left:string,right:string>>")

            # Running sums in two levels: within a block, and over the blocks before.
            def of_lengths(lengths: Column) -> Column:
                def of_sums(sums: Column) -> Column:
                    def span(row: Column, i: Column) -> Column:
                        block = F.floor(i / BLOCK).cast("int")
                        at = F.get(sums, block) + total(F.slice(lengths, block * BLOCK + 1, i % BLOCK)) + F.length(row["left"])
                        return F.struct(
                            at.alias("start"),
                            (at + F.length(row["value"])).alias("end"),
                            row["value"].alias("value"),
                            F.substring(row["left"], -LEFT, LEFT).alias("before"),
                            F.substring(row["right"], 1, RIGHT).alias("after"),
                        )

                    return F.transform(rows, span)

                each = F.transform(blocks, lambda b: total(F.slice(lengths, b * BLOCK + 1, BLOCK)))
                return _let(_let(each, lambda e: F.transform(blocks, lambda b: total(F.slice(e, F.lit(1), b)))), of_sums)

            return _let(F.transform(rows, lambda r: F.length(r["left"]) + F.length(r["value"])), of_lengths)

        return F.when(n > 0, _let(F.split(text, pattern, -1), of_pieces)).otherwise(empty)

    # Matched once; only texts with a match are split too.
    return _let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""

    def weigh(acc: Column, place: Column) -> Column:
        digit = F.substr(number, F.length(number) - place + 1, F.lit(1)).cast("int")
        twice = F.when(digit > 4, digit * 2 - 9).otherwise(digit * 2)
        return acc + F.when(place % 2 == 0, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), weigh) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def _fits(kind: str, value: Column) -> Column:
    """Whether a token outside the fixed shapes can be an identifier of a kind at all."""
    return {
        "email": value.rlike(r"^[^@\s]+@[^@\s]+$"),
        "ip": value.rlike(r"^[0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{0,4}){2,7}$") | (value.rlike(r"^[0-9]{1,3}(?:,[0-9]{1,3}){3}$") & _valid("ip", F.translate(value, ",", "."))),
        "card": value.rlike(r"^[0-9](?:[./\x20-]?[0-9]){12,18}$") & luhn(digits(value)),
        "phone": value.rlike(r"^\(?[0-9](?:[().\x20/-]*[0-9]){6,14}$"),
    }[kind]


def _of_kind(test: Callable[[str, Column], Column], kind: str) -> Callable[[Column], Column]:
    return lambda span: test(kind, span["value"])


def _bounds(rank: int) -> Callable[[Column], Column]:
    return lambda span: F.struct(F.lit(rank).alias("kind"), span["start"].alias("start"), span["end"].alias("end"))


def _occurrences(rank: int, seed: bool) -> Callable[[Column], Column]:
    return lambda span: _occurrence(span, rank, seed)


def _occurrence(span: Column, rank: int, seed: bool) -> Column:
    """Instance with its lexical patterns; digits in context words become 0."""
    word = lambda c: F.regexp_replace(F.lower(c), "[0-9]", "0")
    left = F.split(F.trim(F.regexp_replace(span["before"], r"\s+", " ")), " ", -1)
    right = F.element_at(F.split(F.trim(F.regexp_replace(span["after"], r"\s+", " ")), " ", -1), 1)
    one, two = F.element_at(left, -1), F.coalesce(F.try_element_at(left, F.lit(-2)), F.lit("^"))
    return F.struct(
        F.lit(rank).alias("kind"),
        F.lit(seed).alias("seed"),
        span["start"].alias("start"),
        span["end"].alias("end"),
        F.lower(span["value"]).alias("value"),
        F.array(
            F.concat_ws(" ", F.lit("LR"), word(one), F.lit("_"), word(right)),
            F.concat_ws(" ", F.lit("LL"), word(two), word(one), F.lit("_")),
            F.concat_ws(" ", F.lit("*L"), word(one), F.lit("_")),
            F.concat_ws(" ", F.lit("*S"), word(two), F.lit("* _")),
            F.concat_ws(" ", F.lit("*R _"), word(right)),
        ).alias("patterns"),
    )


def _spans(text: Column) -> tuple[Column, Column]:
    """(base spans as struct(kind, start, end) in order, occurrences of seeds and candidates)."""
    base, seen = [], []
    for rank, kind in enumerate(KINDS):
        # A cheap test first: most texts have none of a kind.
        may = {
            "email": F.contains(text, F.lit("@")),
            "ip": text.rlike(r"[0-9]\.[0-9]"),
            "card": text.rlike(r"[0-9][\x20-]?[0-9]"),
            "phone": F.contains(text, F.lit("+")),
        }[kind]
        valid, seed, bounds = _of_kind(_valid, kind), _occurrences(rank, True), _bounds(rank)
        found = F.filter(located(F.when(may, text).otherwise(""), SHAPES[kind]), valid)
        seen.append(F.transform(found, seed))
        base.append(F.transform(found, bounds))
    return F.concat(*base), F.concat(*seen)


def _candidates(text: Column) -> Column:
    """Occurrences of identifier-like tokens that are no base span themselves, one for each kind that they fit."""

    def bare(span: Column) -> Column:
        lead = F.length(F.regexp_extract(span["value"], r"^[\"'<\[{,;:]*", 0))
        core = F.regexp_replace(span["value"], r"^[\"'<\[{,;:]+|[\"'>\]},;:.!?*$%&#|]+$", "")
        start = span["start"] + lead
        return F.struct(
            start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"), span["before"].alias("before"), span["after"].alias("after")
        )

    tokens = F.transform(located(F.when(text.rlike("[0-9@]"), text).otherwise(""), CANDIDATE), bare)
    groups = located(F.when(text.rlike(r"[0-9][().\x20/-]{0,2}\x20[().\x20/-]{0,2}[0-9]"), text).otherwise(""), GROUPED)
    whole = lambda g: F.contains(g["value"], F.lit(" ")) & ~g["after"].rlike(r"^[\w@]")
    # The word after starts behind the punctuation that ends the run, as it does for a token.
    ended = lambda g: F.struct(g["start"].alias("start"), g["end"].alias("end"), g["value"].alias("value"), g["before"].alias("before"), F.regexp_replace(g["after"], r"^[\"'>\]},;:.!?]+", "").alias("after"))
    tokens = F.concat(tokens, F.transform(F.filter(groups, whole), ended))
    shaped = lambda k, v: v.rlike(SHAPES[k])
    card = lambda v: v.rlike(r"^[0-9 -]{13,}$") & F.length(digits(v)).between(13, 19) & luhn(digits(v))
    ip = lambda v: v.rlike(r"^[0-9.]{7,}$") & _valid("ip", v)
    free = F.filter(tokens, lambda t: ~(shaped("email", t["value"]) | ip(t["value"]) | card(t["value"])))
    each = [F.transform(F.filter(free, _of_kind(_fits, kind)), _occurrences(rank, False)) for rank, kind in enumerate(KINDS)]
    return F.concat(*each)


def score_graph(edges: DataFrame, rounds: int, support: int) -> DataFrame:
    """Edges (kind, pattern, value, seed) with the scores of their pattern and instance after ``rounds`` rounds."""
    scores = edges.groupBy("kind", "value").agg(F.max(F.col("seed").cast("double")).alias("score"))
    needed = F.when(F.col("pattern").startswith("*"), support * GENERAL).otherwise(support)
    for _ in range(rounds):
        held = salted_join(edges, scores, ["kind", "value"], "pattern")
        patterns = held.groupBy("kind", "pattern").agg((F.avg("score") * F.least(F.lit(1.0), F.sum(F.col("seed").cast("double")) / F.first(needed))).alias("trust"))
        held = salted_join(edges, patterns, ["kind", "pattern"], "value")
        scores = held.groupBy("kind", "value").agg(
            F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("trust"), F.lit(1e-9)))))).alias("score")
        )
    return salted_join(salted_join(edges, patterns, ["kind", "pattern"], "value"), scores, ["kind", "value"], "pattern")


def find_personal_data(
    docs: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = 2, support: int = 3, accept: float = 0.8, trust: float = 0.6
) -> DataFrame:
    """Per row: ``key``, ``base`` and ``found``, arrays of struct(kind, start, end) sorted by kind and start."""
    own = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    base, seeds = _spans(F.col("text"))
    own = own.select("key", F.xxhash64("text").alias("hash"), "text", base.alias("base"), seeds.alias("seeds"))
    own = own.select("key", "hash", "base", F.concat("seeds", _candidates(F.col("text"))).alias("seen"))
    own = staged(own, "pii")
    seen = own.select("key", "hash", F.explode("seen").alias("o")).select("key", "hash", "o.*")
    edges = seen.select("kind", F.explode("patterns").alias("pattern"), "value", "seed")
    edges = staged(edges.groupBy("kind", "pattern", "value").agg(F.max("seed").alias("seed")), "pii-edges")
    good = score_graph(edges, rounds, support).where((~F.col("seed")) & (F.col("trust") >= trust) & (F.col("score") >= accept))
    good = staged(good.select("kind", "pattern", "value"), "pii-found")
    hits = seen.where(~F.col("seed")).select("key", "hash", "kind", "start", "end", "value", F.explode("patterns").alias("pattern"))
    hits = salted_join(hits, good, ["kind", "pattern", "value"], "hash", how="left_semi")
    hits = hits.groupBy(F.col("key").alias("k"), F.col("hash").alias("h")).agg(F.collect_set(F.struct("kind", "start", "end")).alias("found"))
    none = F.array().cast("array<struct<kind:int,start:int,end:int>>")
    joined = own.select("key", "hash", "base").join(hits, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
    touches = lambda s: F.exists("base", lambda b: (b["start"] < s["end"]) & (b["end"] > s["start"]))
    found = F.filter(F.coalesce("found", none), lambda s: ~touches(s))
    return joined.select(F.col("key").alias(key), "base", F.array_sort(found).alias("found"))


def spans_text(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
