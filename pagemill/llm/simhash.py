"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most four bits share at least four bytes in
place: that is the guaranteed minimum of matches. Postings of one (position, byte) would hold 1/256 of all
fingerprints each, so the tally would grow with the square of the input; the index is therefore kept on triples of
positions, chosen so that every four positions hold one of them (20 of 56 triples do). Within a posting, pairs need one
more shared byte to reach the minimum: a large posting is grouped by each further positional byte, and only members of
one group are compared, so comparisons are those of an index on four bytes. What reaches the minimum is verified by its
bit distance.

Equal fingerprints are one node, so copies never make pairs. A posting returns pairs that span its linked groups
rather than all pairs; which documents are connected is the same. Postings above ``block`` members are split into
pairs of blocks by a hash, so that no task holds more than two blocks of one posting.

Defined results: null and empty texts have fingerprint zero and link like others; rows with a null id link and get
the smallest non-null id reachable (null if there is none); repeated rows get the same class; extra columns are
ignored; texts of fewer words than a shingle count as one shingle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, free_name, salted_join, staged
from pagemill.llm.graph import components, spanning_pairs

#: Every four of eight positions hold one of these triples (three groups; within a group, or two and one of the next).
GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def _triples() -> list[tuple[int, int, int]]:
    group = {p: g for g, ps in enumerate(GROUPS) for p in ps}
    chosen = []
    for triple in combinations(range(8), 3):
        held = sorted(group[p] for p in triple)
        one = len(set(held)) == 1
        two = len(set(held)) == 2 and (next(g for g in held if held.count(g) == 1) - next(g for g in held if held.count(g) == 2)) % 3 == 1
        if one or two:
            chosen.append(triple)
    return chosen


TRIPLES = _triples()
#: Postings up to this size are compared directly.
SMALL = 64


def fingerprint(text: str | None, words: int = 4) -> int:
    """64-bit SimHash over word shingles; a bit is set if over half the shingle hashes have it."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[:-words].tolist()] if len(parts) >= words else [0]
    stops = (ends[words - 1 :] - 1).tolist() if len(parts) >= words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, stops)), "<u8", len(stops))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4) -> DataFrame:
    """(id, fp) of every row; fp is the fingerprint as a signed long."""

    def run(slices):
        for rows in slices:
            found = [fingerprint(t, words) for t in rows["text"]]
            yield {"id": rows["id"], "fp": [f - (1 << 64) if f >> 63 else f for f in found]}

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {dict(docs.dtypes)[key]}, fp bigint", 64)


def _postings(prints: DataFrame) -> DataFrame:
    """(posting, fp): the posting's number packs its triple and the three bytes."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = [
        (F.lit(i) * F.lit(1 << 24) + byte(a) * F.lit(1 << 16) + byte(b) * F.lit(1 << 8) + byte(c)).cast("bigint")
        for i, (a, b, c) in enumerate(TRIPLES)
    ]
    return prints.select("fp", F.explode(F.array(*keys)).alias("posting"))


def _tallied(prints: np.ndarray, triple: tuple[int, ...], shared: int) -> Iterator[np.ndarray]:
    """Groups of a posting's members in which every pair shares a further positional byte; small postings as they are.

    Members already share the bytes of ``triple``: the group adds the byte that the minimum of ``shared`` needs.
    """
    if len(prints) <= SMALL or shared <= len(triple):
        yield prints
        return
    for position in set(range(8)) - set(triple):
        value = prints >> np.uint64(8 * position) & np.uint64(255)
        order = np.argsort(value, kind="stable")
        for members in np.split(prints[order], np.flatnonzero(np.diff(value[order])) + 1):
            if len(members) > 1:
                yield members


def _linked(postings: DataFrame, distance: int, shared: int) -> DataFrame:
    """Spanning pairs of each posting; rows come sorted by (posting, part), a posting part may cross Arrow slices."""

    def run(slices):
        held_key, held = np.empty((0, 2), np.int64), np.empty(0, np.uint64)

        def pairs(keys, prints):
            out_a, out_b = [], []
            cut = np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1
            firsts = np.append(0, cut)
            sizes = np.diff(np.append(firsts, len(keys)))
            pair = firsts[sizes == 2]
            a, b = prints[pair], prints[pair + 1]
            out_a.append(a)
            out_b.append(b)
            for first, size in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own = np.unique(prints[first : first + size])
                for members in _tallied(own, TRIPLES[int(keys[first, 0]) >> 24], shared):
                    i, j = spanning_pairs(members, distance)
                    out_a.append(members[i])
                    out_b.append(members[j])
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            same = (a ^ b).view(np.uint8).reshape(-1, 8) == 0
            near = (same.sum(axis=1) >= shared) & (np.bitwise_count(a ^ b) <= distance) & (a != b)
            return {"a": a[near].view(np.int64).tolist(), "b": b[near].view(np.int64).tolist()}

        for rows in slices:
            key = np.array([rows["posting"], rows["part"]], np.int64).T
            held_key = np.concatenate([held_key, key])
            held = np.concatenate([held, np.array(rows["fp"], np.int64).view(np.uint64)])
            last = np.flatnonzero(np.any(held_key != held_key[-1], axis=1))
            if len(last):
                upto = last[-1] + 1
                yield pairs(held_key[:upto], held[:upto])
                held_key, held = held_key[upto:], held[upto:]
        if len(held):
            yield pairs(held_key, held)

    return arrow_map(postings, run, "a bigint, b bigint", slice_rows=10_000)


def near_pairs(prints: DataFrame, distance: int = 4, block: int = 20_000) -> DataFrame:
    """Pairs (a, b) that connect all distinct fingerprints within ``distance`` bits (at most 4)."""
    if not 0 <= distance <= 4:
        raise ValueError("the index guarantees distances up to 4")
    postings = _postings(prints)
    large = postings.groupBy("posting").agg(F.count("*").alias("n")).where(F.col("n") > block)
    large = staged(large.select("posting", F.ceil(F.col("n") / (block // 2)).cast("int").alias("blocks")), "postings-large")
    if large.isEmpty():
        dealt = postings.withColumn("part", F.lit(0).cast("bigint"))
    else:
        own = F.pmod(F.hash("fp"), F.col("blocks"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        dealt = postings.join(large, "posting", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        dealt = dealt.select("posting", "fp", "blocks", own.alias("own"), other.alias("other"))
        part = F.least("own", "other").cast("bigint") * F.col("blocks") + F.greatest("own", "other")
        dealt = dealt.select("posting", "fp", part.alias("part"))
    dealt = dealt.select("posting", "part", "fp").repartition("posting", "part").sortWithinPartitions("posting", "part")
    return _linked(dealt, distance, 8 - distance)


def _classes(rows: DataFrame, distance: int) -> DataFrame:
    """(fp, root) of every distinct fingerprint of ``rows``."""
    distinct = staged(rows.select("fp").distinct(), "simhash-distinct")
    roots = components(near_pairs(distinct, distance))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """Per row: ``key``, fp (signed long) and component_id, the smallest key of its class."""
    rows = staged(fingerprints(docs, text, key, words), "simhash")
    lows = rows.groupBy("fp").agg(F.min("id").alias("low"))
    classes = staged(_classes(rows, distance).join(lows, "fp"), "simhash-classes")
    lows = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(lows, "root").select(F.col("fp").alias("__fp"), "component_id")
    return salted_join(rows, classes.withColumnRenamed("__fp", "fp"), "fp", "id").select(F.col("id").alias(key), "fp", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with one row of each class: the smallest non-null key, then the smallest hash of the text.

    The rows to drop are few beside the table, so they are what is joined; texts move only if Spark finds the drop
    list too large to broadcast.
    """
    name_of_hash = free_name(docs, "__hash")
    hashed = docs.withColumn(name_of_hash, F.xxhash64(text))
    kind = dict(docs.dtypes)[key]

    def run(slices):
        for rows in slices:
            found = [fingerprint(t, words) for t in rows["text"]]
            yield {"id": rows["id"], "hash": rows["hash"], "fp": [f - (1 << 64) if f >> 63 else f for f in found]}

    base = hashed.select(F.col(key).alias("id"), F.col(name_of_hash).alias("hash"), F.col(text).alias("text"))
    rows = staged(arrow_map(base, run, f"id {kind}, hash bigint, fp bigint", 64), "simhash")
    name = F.struct(F.col("id").isNull().alias("none"), "id", "hash")
    tops = rows.groupBy("fp").agg(F.min(name).alias("top"))
    classes = staged(_classes(rows, distance).join(tops, "fp"), "simhash-classes")
    stay = classes.groupBy("root").agg(F.min("top").alias("stay"))
    classes = classes.join(stay, "root").select(F.col("fp").alias("__fp"), "stay")
    gone = salted_join(rows, classes.withColumnRenamed("__fp", "fp"), "fp", "hash").where(~F.struct("id", "hash").eqNullSafe(F.struct("stay.id", "stay.hash")))
    gone = staged(gone.select("id", "hash").distinct(), "gone")
    kept = hashed.join(gone, hashed[key].eqNullSafe(gone["id"]) & (hashed[name_of_hash] == gone["hash"]), "left_anti").drop(name_of_hash)
    if not rows.groupBy("id", "hash").count().where("count > 1").isEmpty():  # whole rows repeat
        kept = kept.dropDuplicates([key, text])
    return kept
