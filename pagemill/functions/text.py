"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it.
SPACE = r"(?U)\s"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where ``body`` uses it inside other lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def normalise(text: Column, lowercase: bool = True) -> Column:
    """Runs of white space to one space, optionally lower-cased; not trimmed."""
    return F.regexp_replace(F.lower(text) if lowercase else text, SPACE + "+", " ")


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def trim_start(text: Column, longer_than: int) -> Column:
    """From the first line with more than ``longer_than`` words, lines run together.

    Without such a line: the last line, then all lines.
    """
    lines = F.split(text, "\n")
    first = F.array_position(F.transform(lines, lambda line: F.size(words(line)) > longer_than), True)
    found = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "")
    return F.when(first > 0, found).otherwise(F.concat(F.element_at(lines, -1), F.array_join(lines, "")))


def sentences(text: Column) -> Column:
    """Split after ``.``, ``!`` or ``?`` before white space."""
    return F.split(text, rf"(?<=[.!?]){SPACE}+")


def clean_sentences(parts: Column) -> Column:
    """Without sentences that hold three white-space characters in a row; the rest collapsed."""
    kept = F.filter(parts, lambda s: ~s.rlike(SPACE + "{3}"))
    return F.transform(kept, lambda s: F.regexp_replace(s, SPACE + "+", " "))


def sentence_pieces(parts: Column) -> Column:
    """Trimmed sentences cut at double white space; of several pieces only those of more than one word stay."""

    def pieces(sentence: Column) -> Column:
        cut = F.split(F.regexp_replace(sentence, rf"^{SPACE}+|{SPACE}+$", ""), SPACE + "{2,}")
        return F.when(F.size(cut) > 1, F.filter(cut, lambda p: F.size(words(p)) > 1)).otherwise(cut)

    return F.flatten(F.transform(parts, pieces))


def char_shingles(text: Column, k: int = 5) -> Column:
    """Distinct runs of k characters; empty for shorter texts. Characters are cut once, not by position."""
    none = F.array().cast("array<string>")

    def runs(chars: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.size(chars) - k + 1), lambda i: F.array_join(F.slice(chars, i, k), ""))
        return F.when(F.size(chars) >= k, F.array_distinct(every)).otherwise(none)

    return let(F.split(text, ""), runs)


def replaced_versions(text: Column, key: Column, shares: list[float]) -> Column:
    """One version of the text for each share, with about that share of its words replaced.

    Which words are replaced, and by what, follows from a digest of key and position; a digest is taken once for all
    shares, and its first digits are compared as text.
    """

    def part(value: Column, at: Column) -> Column:
        digest = F.md5(F.concat_ws(":", key.cast("string"), at.cast("string")).cast("binary"))
        return F.struct(value.alias("word"), digest.alias("digest"))

    def version(parts: Column, share: float) -> Column:
        below = int(share * 65536)
        chosen = lambda p: F.lit(True) if below > 65535 else F.substring(p["digest"], 1, 4) < F.lit(f"{below:04x}")
        return F.array_join(F.transform(parts, lambda p: F.when(chosen(p), F.concat(F.lit("zz"), F.substring(p["digest"], 5, 6))).otherwise(p["word"])), " ")

    return let(F.transform(F.split(text, " "), part), lambda parts: F.array(*[version(parts, share) for share in shares]))


def replaced_words(text: Column, key: Column, share: float) -> Column:
    """The version of the text for one share."""
    return F.get(replaced_versions(text, key, [share]), 0)


def blocks(ids: Column, first: int, last: int, size: int = 510) -> Column:
    """Ids in runs of ``size``, each between the two special ids; no run without ids."""
    none = F.array().cast("array<array<int>>")

    def runs(own: Column) -> Column:
        last_block = F.ceil(F.size(own) / size).cast("int") - 1
        cut = lambda b: F.concat(F.array(F.lit(first)), F.slice(own, b * size + 1, size), F.array(F.lit(last)))
        return F.when(F.size(own) > 0, F.transform(F.sequence(F.lit(0), last_block), cut)).otherwise(none)

    return let(ids, runs)


def tokens(text: Column) -> Column:
    """Words and single other characters."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^ \t\n\r\f\x0B\p{L}\p{N}_]"), F.lit(0))


def simple_tokens(text: Column) -> Column:
    """White-space pieces with one trailing punctuation mark cut off as a token of its own."""
    return F.filter(
        F.flatten(F.transform(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: F.array(F.regexp_replace(w, r"[.,!?;:]$", ""), F.regexp_extract(w, r"[.,!?;:]$", 0)))),
        lambda t: t != "",
    )


def joined_tokens(parts: Column) -> Column:
    """Tokens as text: a space only before tokens of letters and digits."""
    return F.aggregate(
        F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))),
        F.coalesce(F.get(parts, 0), F.lit("")),
        lambda acc, t: F.concat(acc, F.when(t.rlike(r"^[\p{L}\p{N}]+$"), F.lit(" ")).otherwise(""), t),
    )


def host_of(url: Column) -> Column:
    return F.regexp_extract(url, r"://([^/?#]*)", 1)
