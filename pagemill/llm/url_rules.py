"""URL filtering by pattern rules that are indexed by their rarest literal token. Built-in expressions only.

A rule is either ``host/path`` (fits the host, its subdomains, and paths with that prefix) or a pattern in which
``||`` anchors at a host label, ``|`` at either end, ``*`` stands for anything and ``^`` for a separator or the end.
Every rule is filed under one of its literal tokens: the one that the fewest URLs of the table hold, counted over
the whole table. A URL's own tokens fetch the rules filed under them, and only these run their regular expression.
Rules without a whole token are tried on every URL.

Up to ``MAX_INLINE_RULES`` rules the index is a constant inside the plan (hashed buckets, so a fetch costs the same for
few and many rules): no row leaves its partition, so hot hosts cannot skew anything; the only exchange is the token
count, which is summed before it moves. Larger lists are a table that the URLs' tokens are joined with, rows of one
token dealt to several tasks; the verdicts are the same.

Defined results: null URLs and URLs without ``://`` have empty host and path, fit no ``host/path`` rule and get the
default verdict unless a pattern fits; repeated rows are judged alike; among fitting rules of a class the longest
wins, equal lengths go to the lexically smallest; ``host/path`` rules go before patterns; kept columns named like a
result give way to it.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import salted_join, staged

MAX_INLINE_RULES = 50_000
RESULTS = ("host", "path", "rule", "verdict", "pattern")
_ENTRY = "token string, rule string, regex string, rank int, len int, verdict string"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    text: str
    pattern: bool = False

    @property
    def regex(self) -> str:
        """Regular expression over host and path for host/path rules, over the lower-cased URL for patterns."""
        if not self.pattern:
            host, slash, path = self.text.partition("/")
            return rf"^(?:[^/]*\.)?{_quote(host.lower())}" + (_quote(slash + path) if slash else r"(?:/|\z)")
        body, out = self.text.lower(), ""
        if body.startswith("||"):
            body, out = body[2:], r"^[^:/?#]*://(?:[^/?#]*\.)?"
        elif body.startswith("|"):
            body, out = body[1:], "^"
        tail = ""
        if body.endswith("|"):
            body, tail = body[:-1], r"\z"
        for part in re.split(r"([*^])", body):
            out += {"*": "(?s:.*)", "^": r"(?:[^a-z0-9_.%-]|\z)"}.get(part, _quote(part))
        return out + tail

    @property
    def tokens(self) -> list[str]:
        """Literal tokens that every fitting URL holds as whole tokens (bounded on both sides)."""
        if not self.pattern:
            body = self.text.lower()
            bounded = "/" + body + ("*" if "/" in body and not body.endswith("/") else "")
        else:
            body = self.text.lower()
            front = "^" if body.startswith("|") else "*"
            back = "^" if body.endswith("|") else "*"
            bounded = front + body.strip("|") + back
        return sorted(set(re.findall(r"(?<![a-z0-9*])[a-z0-9]+(?![a-z0-9*])", bounded)))


def _quote(text: str) -> str:
    return re.sub(r"([^A-Za-z0-9_])", r"\\\1", text)


def ascii_lower(column: Column) -> Column:
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.filter(F.split(ascii_lower(url), "[^a-z0-9]+"), lambda t: t != ""))


def token_counts(pages: DataFrame, vocabulary: list[str], url: str = "url") -> dict[str, int]:
    """In how many rows each token of the rules occurs; as many numbers as the rules have tokens."""
    if not vocabulary:
        return {}
    known = F.from_json(F.lit(json.dumps(vocabulary)), "array<string>")
    held = pages.select(F.explode(F.array_intersect(url_tokens(F.col(url)), known)).alias("token"))
    return {r["token"]: r["n"] for r in held.groupBy("token").agg(F.count("*").alias("n")).collect()}


def judge_urls(
    pages: DataFrame, rules: list[UrlRule], default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)
) -> DataFrame:
    """Columns ``keep``, host, path, rule (the host/path rule that decides, else null), pattern (likewise), verdict."""
    if len({r.text for r in rules}) != len(rules):
        raise ValueError("two rules have the same text")
    keep = tuple(c for c in keep if c not in RESULTS)
    held = pages.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), F.col(url).alias("url"))
    held = held.select("*", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    held = held.withColumn("site", F.concat("host", "path")).withColumn("low", ascii_lower(F.col("url")))
    entries = _filed(pages, rules, url)
    held = _best_inline(held, entries) if len(rules) <= MAX_INLINE_RULES else _best_joined(held, entries)
    best = F.col("best")
    return held.select(
        *(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)),
        "host",
        "path",
        F.when(best["rank"] == -1, best["rule"]).alias("rule"),
        F.coalesce(best["verdict"], F.lit(default)).alias("verdict"),
        F.when(best["rank"] == 0, best["rule"]).alias("pattern"),
    )


def _filed(pages: DataFrame, rules: list[UrlRule], url: str) -> list[dict]:
    """One entry a rule, under its rarest token; without a whole token under the empty one."""
    counts, entries = token_counts(pages, sorted({t for r in rules for t in r.tokens}), url), []
    for rule in sorted(rules, key=lambda r: r.text):
        rarest = min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t), default="")
        entries.append({"token": rarest, "rule": rule.text, "regex": rule.regex, "rank": int(not rule.pattern), "len": len(rule.text), "verdict": rule.verdict})
    return entries


def _fits(entry: Column) -> Column:
    return F.coalesce(F.regexp_like(F.when(entry["rank"] == 1, F.col("site")).otherwise(F.col("low")), entry["regex"]), F.lit(False))


def _ordered(entry: Column) -> Column:
    """The smallest of these is the entry that decides."""
    return F.struct((-entry["rank"]).alias("rank"), (-entry["len"]).alias("len"), entry["rule"].alias("rule"), entry["verdict"].alias("verdict"))


def _best_inline(held: DataFrame, entries: list[dict]) -> DataFrame:
    """``held`` with ``best``: the index is a constant of the plan."""
    buckets: list[list[dict]] = [[] for _ in range(1 << max(2, len(entries).bit_length()))]
    for entry in entries:
        if entry["token"]:
            buckets[_bucket(entry["token"], len(buckets))].append(entry)
    always = [entry for entry in entries if not entry["token"]]
    index = F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<{_typed(_ENTRY)}>>>")
    rest = F.from_json(F.lit(json.dumps(always)), f"array<struct<{_typed(_ENTRY)}>>")
    fetched = F.flatten(
        F.transform(
            F.coalesce(url_tokens(F.col("url")), F.array().cast("array<string>")),
            lambda t: F.filter(F.get(index, _bucket_column(t, len(buckets))), lambda e: e["token"] == t),
        )
    )
    return held.withColumn("best", F.array_min(F.transform(F.filter(F.concat(fetched, rest), _fits), _ordered)))


def _best_joined(held: DataFrame, entries: list[dict]) -> DataFrame:
    """``held`` with ``best``: the index is a table. Rows are written once, so their numbers are fixed."""
    spark = held.sparkSession
    held = staged(held.withColumn("row", F.monotonically_increasing_id()), "urls")
    names = [f.split()[0] for f in _ENTRY.split(", ")]
    rules = staged(spark.createDataFrame([tuple(e[n] for n in names) for e in entries], _ENTRY), "url-rules")
    # The empty token stands for the rules that every URL has to try.
    asked = held.select("row", "site", "low", F.explode(F.concat(url_tokens(F.coalesce("url", F.lit(""))), F.array(F.lit("")))).alias("token"))
    entry = F.struct(*names[1:])
    found = salted_join(asked, rules, "token", "row").withColumn("entry", entry).where(_fits(F.col("entry")))
    best = found.groupBy("row").agg(F.min(_ordered(F.col("entry"))).alias("best"))
    return held.join(best, "row", "left")


def _typed(fields: str) -> str:
    return fields.replace(" ", ":").replace(",:", ",")


def _bucket(token: str, count: int) -> int:
    import zlib

    return zlib.crc32(token.encode()) % count


def _bucket_column(token: Column, count: int) -> Column:
    return F.pmod(F.crc32(token.cast("binary")), F.lit(count)).cast("int")
