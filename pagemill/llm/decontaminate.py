"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Test items are partitioned by their number of distinct word shingles. An item's sketch holds its smallest shingle
hashes, as many as its size partition needs: a document with at least ``threshold`` of an item's n shingles misses
at most n - ceil(threshold * n) of them, so any one more than that must meet the document. A document's sketch holds
its shingle hashes up to the largest hash of any item's sketch. Sketches are the only way to a candidate: a document
and an item that share a sketch hash, if the document is large enough for the item's partition. No true pair is
overlooked. Every candidate is then verified by exact containment of its shingles, compared as words.

Items are a table, never gathered on the driver, and documents are read once however many items there are. What a
pass over the documents needs of the items is a Bloom filter of their sketch hashes of at most ``MOST_BITS`` bits; it
spares documents that meet no sketch the joins, and where it is too small for the items, only more rows reach them. Joins
between few rows and many are salted, so an item that a third of all documents hold gathers nowhere.

Words are runs of letters, digits and underscores, lower-cased, so decorations between words do not hide a passage. An
item of fewer words than a shingle is one shingle of its own length.

Defined results: null texts, empty texts and texts without a word match nothing on either side; repeated rows are judged
one by one; repeated items each match; extra columns are ignored; an empty side gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import arrow_map, row_numbers, salted_join, staged

_WORDS = re.compile(r"\w+").findall
_GAP = re.compile(r"\W").search
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
#: Characters whose words are hashed at once.
SEGMENT = 300_000
MOST_BITS = 1 << 27
#: Bits of the filter for each sketch hash, as long as ``MOST_BITS`` allows it, and where in a hash its places start.
BITS, PLACES = 64, (0, 12, 24, 36)
#: Items that are verified at once against one document.
GROUP = 256


def words_of(text: str | None) -> list[str]:
    return _WORDS(text.lower()) if text else []


_word_characters = np.empty(0, bool)


def _is_word(codes: np.ndarray) -> np.ndarray:
    global _word_characters
    if not len(_word_characters):
        _word_characters = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)
    return _word_characters[codes]


def _hash_words(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, position of each word)."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = _is_word(codes)
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, stops = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    if not len(starts):
        return np.empty(0, np.uint64), starts
    sizes = stops - starts
    firsts = np.cumsum(sizes) - sizes
    letters = (codes[inside].astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
    letters ^= letters >> np.uint64(32)
    powers = np.cumprod(np.full(int(sizes.max()), np.uint64(0x100000001B3)))
    value = np.add.reduceat(letters * powers[np.arange(len(letters)) - np.repeat(firsts, sizes)], firsts)
    value = (value ^ value >> np.uint64(31)) * _FACTOR
    return value ^ value >> np.uint64(29), starts


def word_hashes(texts: list[str | None]) -> list[np.ndarray]:
    """A hash of each word of each text. Short texts are hashed together, long ones in parts cut between words."""
    out: list[list[np.ndarray]] = [[] for _ in texts]
    held: list[tuple[int, str]] = []

    def flush() -> None:
        found, starts = _hash_words("\n".join(part for _, part in held))
        ends = np.searchsorted(starts, np.cumsum([len(part) + 1 for _, part in held])).tolist()
        for (i, _), a, b in zip(held, [0, *ends], ends):
            out[i].append(found[a:b])
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        low, at = (text or "").lower(), 0
        while at < len(low):
            cut = _GAP(low, at + SEGMENT) if len(low) - at > SEGMENT else None
            end = cut.start() if cut else len(low)
            held.append((i, low[at:end]))
            size, at = size + end - at, end
            if size >= SEGMENT:
                flush()
                size = 0
    if held:
        flush()
    return [np.concatenate(parts) if parts else np.empty(0, np.uint64) for parts in out]


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` words, in order."""
    n = max(0, len(words) - width + 1)
    value = np.full(n, width, np.uint64)
    for k in range(width):
        value = (value ^ words[k : n + k]) * _FACTOR
        value ^= value >> np.uint64(29)
    return value


def _signed(values: np.ndarray) -> list[int]:
    return values.view(np.int64).tolist()


def _least(threshold: float, n: int) -> int:
    return math.ceil(threshold * n - 1e-9)


def item_sketches(items: DataFrame, text: str, key: str, width: int, threshold: float) -> DataFrame:
    """(number, item, words, width, least, sketch): ``least`` shingles a document of the item's partition has."""

    def run(slices):
        numbers = row_numbers()
        for rows in slices:
            columns: dict[str, list] = {k: [] for k in ("number", "item", "words", "width", "least", "sketch")}
            for item, value, hashes in zip(rows["item"], rows["text"], word_hashes(rows["text"])):
                if not len(hashes):
                    continue
                own = min(width, len(hashes))
                found = np.unique(shingle_hashes(hashes, own))
                largest = 1 << (len(found) - 1).bit_length()  # of the size partition
                sketch = found[: largest - _least(threshold, largest) + 1]
                smallest = largest // 2 + 1 if largest > 1 else 1
                row = (next(numbers), item, " ".join(words_of(value)), own, _least(threshold, smallest), _signed(sketch))
                for column, cell in zip(columns.values(), row, strict=True):
                    column.append(cell)
            yield columns

    schema = f"number bigint, item {dict(items.dtypes)[key]}, words string, width int, least int, sketch array<bigint>"
    return staged(arrow_map(items.select(F.col(key).alias("item"), F.col(text).alias("text")), run, schema, 64), "items")


class Probe:
    """What a pass over the documents knows of all sketches: widths, the largest hash, and a Bloom filter."""

    def __init__(self, sketches: DataFrame):
        """``sketches``: (h, width) rows."""
        facts = sketches.agg(F.count("*"), F.collect_set("width"), F.max(_unsigned("h"))).first()
        self.widths: list[int] = sorted(facts[1])
        self.largest = np.uint64((facts[2] or 0) + (1 << 63))
        bits = min(MOST_BITS, 1 << max(20, (BITS * facts[0]).bit_length()))
        places = F.explode(F.array(*(F.shiftrightunsigned("h", shift).bitwiseAND(F.lit(bits - 1)) for shift in PLACES)))
        words = sketches.select(places.alias("place")).groupBy(F.shiftright("place", 15).alias("at"))
        words = words.agg(F.bitmap_construct_agg(F.col("place").bitwiseAND(F.lit(32767))).alias("bits"))
        self.bitmap, self.mask = np.zeros(bits // 8, np.uint8), np.uint64(bits - 1)
        for row in words.toLocalIterator():  # at most MOST_BITS / 8 bytes in all
            self.bitmap[row["at"] * 4096 : (row["at"] + 1) * 4096] = np.frombuffer(row["bits"], np.uint8)

    def meets(self, hashes: np.ndarray) -> np.ndarray:
        """The distinct hashes of a document's sketch that some item's sketch may hold."""
        own = hashes[hashes <= self.largest]
        for shift in PLACES:
            at = own >> np.uint64(shift) & self.mask
            own = own[self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1 == 1]
        return np.unique(own)


def _unsigned(name: str):
    """An order-preserving signed form of an unsigned 64-bit hash."""
    return F.col(name).bitwiseXOR(F.lit(-(1 << 63)).cast("bigint"))


def _met(docs: DataFrame, text: str, key: str, probe: Probe) -> DataFrame:
    """(row, key, hash, n, text, met) of every document whose sketch may meet an item's."""
    shared = docs.sparkSession.sparkContext.broadcast(probe)

    def run(slices):
        known, numbers = shared.value, row_numbers()
        for rows in slices:
            columns: dict[str, list] = {k: [] for k in ("row", "key", "hash", "n", "text", "met")}
            for own, name, value, words in zip(rows["key"], rows["hash"], rows["text"], word_hashes(rows["text"])):
                met = [known.meets(shingle_hashes(words, w)) for w in known.widths]
                if any(map(len, met)):
                    for column, cell in zip(columns.values(), (next(numbers), own, name, len(words), value, _signed(np.concatenate(met))), strict=True):
                        column.append(cell)
            yield columns

    schema = f"row bigint, key {dict(docs.dtypes)[key]}, hash bigint, n bigint, text string, met array<bigint>"
    base = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.col(text).alias("text"))
    return staged(arrow_map(base, run, schema, 128), "met")


def candidates(met: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (row, number) pairs of a document and an item that share a sketch hash and whose sizes allow it."""
    asked = met.select("row", "n", F.explode("met").alias("h"))
    found = salted_join(asked, sketches, "h", "row").where(F.col("n") - F.col("width") + 1 >= F.col("least"))
    return found.select("row", "number").distinct()


class ItemGroup:
    """A few items, ready to be looked for in a text by their words."""

    def __init__(self, items: list[tuple[object, str, int]]):
        self.word_ids: dict[str, int] = {}
        self.items = []
        for name, words, width in items:
            ids = [self.word_ids.setdefault(w, len(self.word_ids) + 1) for w in words.split(" ")]
            self.items.append((name, width, set(zip(*(ids[k : len(ids) - width + 1 + k] for k in range(width))))))

    def shared(self, text: str) -> Iterator[tuple[object, int, int]]:
        """(item, its shingles, those that the text holds)."""
        get = self.word_ids.get
        ids = np.array([get(w, 0) for w in words_of(text)], np.int64)
        held: dict[int, set] = {}
        for width in {width for _, width, _ in self.items}:
            n = max(0, len(ids) - width + 1)
            known = np.logical_and.reduce([ids[k : n + k] > 0 for k in range(width)])
            wanted = set().union(*(grams for _, w, grams in self.items if w == width))
            held[width] = {gram for i in np.flatnonzero(known).tolist() if (gram := tuple(ids[i : i + width].tolist())) in wanted}
        for name, width, grams in self.items:
            yield name, len(grams), len(grams & held[width])


def _verified(met: DataFrame, pairs: DataFrame, items: DataFrame, threshold: float, kinds: tuple[str, str]) -> DataFrame:
    """(row, key, hash, item, item_shingles, shared) of the candidates that hold true."""
    whole = Window.partitionBy("row")
    pairs = pairs.withColumn("part", F.pmod(F.xxhash64("number"), F.ceil(F.count("*").over(whole) / GROUP)))
    named = salted_join(pairs, items.select("number", "item", "words", "width"), "number", "row")
    groups = named.groupBy("row", "part").agg(F.collect_list(F.struct("item", "words", "width")).alias("items"))
    joined = groups.join(met.select("row", "key", "hash", "text"), "row").select("row", "key", "hash", "text", "items")

    def run(slices):
        names = ("row", "key", "hash", "item", "item_shingles", "shared")
        for rows in slices:
            out = []
            for row, key, name, text, items in zip(*(rows[c] for c in ("row", "key", "hash", "text", "items"))):
                group = ItemGroup([(i["item"], i["words"], i["width"]) for i in items])
                out += [(row, key, name, item, n, shared) for item, n, shared in group.shared(text) if shared >= threshold * n - 1e-9]
            yield {c: [r[i] for r in out] for i, c in enumerate(names)}

    schema = f"row bigint, key {kinds[0]}, hash bigint, item {kinds[1]}, item_shingles bigint, shared bigint"
    return arrow_map(joined, run, schema, 32)


def _found(docs: DataFrame, items: DataFrame, text: str, key: str, item_text: str, item_key: str, width: int, threshold: float) -> DataFrame:
    kinds = dict(docs.dtypes)[key], dict(items.dtypes)[item_key]
    items = item_sketches(items, item_text, item_key, width, threshold)
    sketches = items.select("number", "width", "least", F.explode("sketch").alias("h"))
    met = _met(docs, text, key, Probe(sketches))
    return _verified(met, candidates(met, sketches), items, threshold, kinds)


def find_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(key, item key, item_shingles, shared, containment) for every document and item it contains."""
    found = _found(docs, items, text, key, item_text, item_key, width, threshold)
    return found.select(
        F.col("key").alias(key), F.col("item").alias(item_key), "item_shingles", "shared", (F.col("shared") / F.col("item_shingles")).alias("containment")
    )


def without_contaminated(
    docs: DataFrame, items: DataFrame, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """``docs`` without the rows that contain an item. Few go, so they are what is joined; ids may repeat or be null."""
    found = _found(docs, items, text, key, item_text, item_key, width, threshold)
    gone = staged(found.select(F.col("key").alias("__gone_key"), F.col("hash").alias("__gone_hash")).distinct(), "contaminated")
    return docs.join(gone, docs[key].eqNullSafe(gone["__gone_key"]) & (F.xxhash64(docs[text]) == gone["__gone_hash"]), "left_anti")
