"""Shingle signatures and their similarity."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.functions.text import char_shingles, normalise
from pagemill.runtime import ship

PRIME = (1 << 31) - 1
PERMUTATIONS = 512
SHINGLE = 5


def permutation(i: int) -> tuple[int, int]:
    """Multiplier and shift of permutation i: powers of two generators modulo the prime."""
    return pow(48271, i + 1, PRIME), pow(16807, i + 1, PRIME)


def digest_hash(shingle: Column) -> Column:
    """32 bits of an md5, which any SQL engine has."""
    return F.conv(F.substring(F.md5(shingle.cast("binary")), 1, 8), 16, 10).cast("bigint")


def shingle_rows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, shingle), distinct within a document."""
    return docs.select(key, F.explode(char_shingles(normalise(F.col(text)))).alias("shingle"))


def distinct_windows(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Starts of the distinct runs of k characters, each once, in order of the runs' codes."""
    codes = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
    if len(codes) < k:
        return np.empty(0, np.int64)
    _, ranks = np.unique(codes, return_inverse=True)
    base = int(ranks.max()) + 1
    n, size, value = len(codes) - k + 1, base, ranks[: len(codes) - k + 1].astype(np.uint64)
    for i in range(1, k):
        if size * base >= 1 << 63:  # too many characters for one number: number the runs so far
            _, value = np.unique(value, return_inverse=True)
            value, size = value.astype(np.uint64), int(value.max()) + 1
        value, size = value * np.uint64(base) + ranks[i : i + n].astype(np.uint64), size * base
    return np.unique(value, return_index=True)[1]


@lru_cache(4)
def _factors(permutations: int) -> tuple[np.ndarray, np.ndarray]:
    a, b = np.array([permutation(i) for i in range(permutations)], np.uint64).T
    return a[:, None].copy(), b[:, None].copy()


def minima(hashes: np.ndarray, permutations: int = PERMUTATIONS) -> list[int]:
    """Smallest permuted value of 32-bit hashes, by permutation; the prime without hashes.

    Blocks are small enough for the processor's cache. The prime is 2**31 - 1, so a remainder is a sum of bit fields.
    """
    a, b = _factors(permutations)
    prime, bits = np.uint64(PRIME), np.uint64(31)
    hashes, low = np.unique(hashes % prime), np.full(permutations, PRIME, np.uint64)
    value, high = np.empty((permutations, 128), np.uint64), np.empty((permutations, 128), np.uint64)
    for at in range(0, len(hashes), 128):
        own = hashes[None, at : at + 128]
        x, y = value[:, : own.shape[1]], high[:, : own.shape[1]]
        np.multiply(a, own, out=x)
        x += b
        for _ in range(2):
            np.right_shift(x, bits, out=y)
            x &= prime
            x += y
        if (x >= prime).any():  # at most the prime and one more are left
            x[x >= prime] -= prime
        np.minimum(low, x.min(axis=1), out=low)
    return low.astype(np.int64).tolist()


def _permuted(hashes: np.ndarray, permutations: int) -> np.ndarray:
    """(hashes, permutations): permuted values of hashes below the prime. A sum of two bit fields is below twice the prime."""
    a, b = _factors(permutations)
    value = hashes[:, None] * a.T
    value += b.T
    high = value >> np.uint64(31)
    value &= np.uint64(PRIME)
    value += high
    low = value.astype(np.uint32)
    return np.minimum(low, low - np.uint32(PRIME))  # what is below the prime wraps around to something larger


def md5_hash(shingle: bytes) -> int:
    """``digest_hash`` in Python."""
    return int.from_bytes(hashlib.md5(shingle).digest()[:4], "big")


class Signer:
    """Minima of many texts in one process.

    Shingles are numbers (five ranks of characters), hashed once a batch. Permuted values of shingles that several texts
    of a batch hold are kept, for ``rows`` shingles at most; those of all others are computed when they are met, so the
    bound changes no result. Texts with a character beyond the first 4,095 different ones go another way.
    """

    def __init__(self, digest, permutations: int = PERMUTATIONS, rows: int = 65_536):
        self.digest, self.permutations, self.rows = digest, permutations, rows
        self.rank, self.chars = np.zeros(0x110000, np.uint64), [0]
        self.codes, self.slots = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.table = np.empty((rows, permutations), np.uint32)

    def windows(self, text: str | None) -> np.ndarray | None:
        """Sorted distinct shingle numbers; None if a character has no rank."""
        points = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4")
        if len(points) < SHINGLE:
            return np.empty(0, np.uint64)
        ranks = self.rank[points]
        if not ranks.all():
            new = np.unique(points[ranks == 0]).tolist()
            if len(self.chars) + len(new) > 4096:
                return None
            self.rank[new] = np.arange(len(self.chars), len(self.chars) + len(new), dtype=np.uint64)
            self.chars += new
            ranks = self.rank[points]
        n = len(points) - SHINGLE + 1
        value = ranks[:n].copy()
        for i in range(1, SHINGLE):
            value <<= np.uint64(12)
            value |= ranks[i : i + n]
        value.sort()
        return value[np.append(True, value[1:] != value[:-1])]

    def _hashes(self, codes: np.ndarray) -> np.ndarray:
        shifts = np.arange(12 * (SHINGLE - 1), -1, -12, dtype=np.uint64)
        points = np.array(self.chars, "<u4")[(codes[:, None] >> shifts & np.uint64(4095)).astype(np.int64)]
        text, digest = points.tobytes().decode("utf-32-le", "surrogatepass"), self.digest
        found = (digest(text[i : i + SHINGLE].encode("utf-8", "surrogatepass")) for i in range(0, len(text), SHINGLE))
        return np.fromiter(found, np.uint64, len(codes)) % np.uint64(PRIME)

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        """(texts, permutations); the prime where a text has no shingle."""
        out = np.full((len(texts), self.permutations), PRIME, np.uint32)
        own = [self.windows(text) for text in texts]
        for i in [i for i, found in enumerate(own) if found is None]:
            text = texts[i]
            hashes = [self.digest(text[j : j + SHINGLE].encode("utf-8", "surrogatepass")) for j in distinct_windows(text).tolist()]
            out[i], own[i] = minima(np.array(hashes, np.uint64), self.permutations), np.empty(0, np.uint64)
        codes, of, held_by = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
        slot, hashes = np.full(len(codes), -1), np.zeros(len(codes), np.uint64)
        if len(self.codes):
            at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            slot = np.where(self.codes[at] == codes, self.slots[at], -1)
        missing = np.flatnonzero(slot < 0)
        hashes[missing] = self._hashes(codes[missing])
        new = missing[held_by[missing] > 1][: self.rows - len(self.codes)]
        if len(new):
            slot[new] = np.arange(len(self.codes), len(self.codes) + len(new))
            for first in range(0, len(new), 128):
                part = new[first : first + 128]
                self.table[slot[part]] = _permuted(hashes[part], self.permutations)
            every, slots = np.append(self.codes, codes[new]), np.append(self.slots, slot[new])
            order = np.argsort(every)
            self.codes, self.slots = every[order], slots[order]
        first = 0
        for low, found in zip(out, own):
            mine, first = of[first : first + len(found)], first + len(found)
            slots = slot[mine]
            kept, rest = slots[slots >= 0], hashes[mine[slots < 0]]
            for i in range(0, len(kept), 256):
                np.minimum(low, self.table[kept[i : i + 256]].min(axis=0), out=low)
            for i in range(0, len(rest), 128):
                np.minimum(low, _permuted(rest[i : i + 128], self.permutations).min(axis=0), out=low)
        return out


_signers: dict[tuple, Signer] = {}


def signer(digest, permutations: int = PERMUTATIONS) -> Signer:
    """The process's own."""
    key = digest.__name__, permutations
    if key not in _signers:
        _signers[key] = Signer(digest, permutations)
    return _signers[key]


def signatures(docs: DataFrame, key: str = "doc_id", text: str = "text", permutations: int = PERMUTATIONS) -> DataFrame:
    """(key, signature) of documents with a shingle: one Arrow pass from text to signature, no shuffle.

    Signatures are over the md5 hashes of ``digest_hash``, which SQL can restate.
    """
    ship(docs.sparkSession)

    def run(batches):
        sign = signer(md5_hash, permutations)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(1).to_pylist()
                held = np.flatnonzero([len(t or "") >= SHINGLE for t in texts])
                if len(held):
                    found = sign([texts[i] for i in held])
                    offsets = pa.array(np.arange(0, found.size + 1, permutations, dtype=np.int32))
                    signature = pa.ListArray.from_arrays(offsets, pa.array(found.ravel().astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(held)), signature], [key, "signature"])

    schema = f"{key} {dict(docs.dtypes)[key]}, signature array<int>"
    return docs.select(key, normalise(F.col(text)).alias("text")).mapInArrow(run, schema)


def shingle_count(text: Column) -> Column:
    """Number of distinct shingles."""

    @F.pandas_udf("bigint")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([len(distinct_windows(t)) for t in column.fillna("")], dtype="int64")

    return run(text)


def estimate(a: Column, b: Column) -> Column:
    """Share of equal places of two signatures."""
    equal = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda acc, x: acc + x)
    return equal / F.size(a)


def same(a: Column, b: Column, threshold: float = 0.95) -> Column:
    return estimate(a, b) > threshold


def signature_of(text: str | None, permutations: int = PERMUTATIONS) -> list[int]:
    """Production signature: unsigned 32-bit xxHash of the shingles of a normalised text."""
    found = [xxhash.xxh32_intdigest(text[i : i + SHINGLE].encode("utf-8", "surrogatepass")) for i in distinct_windows(text).tolist()]
    return minima(np.array(found, np.uint64), permutations)


def signature(text: Column, permutations: int = PERMUTATIONS) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(column: pd.Series) -> pd.Series:
        return pd.Series([signature_of(t, permutations) for t in column], dtype=object)

    return run(text)


def exact_jaccard(left: DataFrame, right: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, shared, total, jaccard) of two sets of shingle rows."""
    both = left.select(key, "shingle", F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, "shingle", F.lit(0).alias("l"), F.lit(1).alias("r")))
    held = both.groupBy(key, "shingle").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    sums = held.groupBy(key).agg(F.sum(F.col("l") * F.col("r")).alias("shared"), F.count("*").alias("total"))
    return sums.withColumn("jaccard", F.col("shared") / F.col("total"))


def version_jaccard(versions: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of ``exact_jaccard`` for (key, before, after), normalised texts of one row a key: nothing moves."""
    ship(versions.sparkSession)

    def run(batches):
        sign = signer(xxhash.xxh32_intdigest, 1)
        for batch in batches:
            keys, shared, total = [], [], []
            for i, (before, after) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                a, b = sign.windows(before), sign.windows(after)
                if a is None or b is None:
                    a, b = ({t[i : i + SHINGLE] for i in range(len(t) - SHINGLE + 1)} for t in (before or "", after or ""))
                    both, every = len(a & b), len(a | b)
                else:
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    every = len(a) + len(b) - both
                if every:
                    keys.append(i)
                    shared.append(both)
                    total.append(every)
            share = np.array(shared, float) / np.array(total, float)
            columns = [batch.column(0).take(pa.array(keys, pa.int64())), pa.array(shared, pa.int64()), pa.array(total, pa.int64()), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, [key, "shared", "total", "jaccard"])

    schema = f"{key} {dict(versions.dtypes)[key]}, shared bigint, total bigint, jaccard double"
    return versions.select(key, "before", "after").mapInArrow(run, schema)


def change_grid(versions: DataFrame, thresholds: list[float], permutations: int = 128) -> DataFrame:
    """Share of changed documents found changed. ``versions``: share, before, after (normalised texts).

    A text that several rows of a batch hold, such as the version before, is signed once.
    """
    ship(versions.sparkSession)

    def run(batches):
        sign = signer(xxhash.xxh32_intdigest, permutations)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                before, after = part.column(1).to_pylist(), part.column(2).to_pylist()
                texts = list(dict.fromkeys(before + after))
                place = {t: i for i, t in enumerate(texts)}
                found = sign(texts)
                equal = (found[[place[t] for t in before]] == found[[place[t] for t in after]]).sum(axis=1) / permutations
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(equal)], ["share", "j"])

    rows = versions.select("share", "before", "after").mapInArrow(run, f"share {dict(versions.dtypes)['share']}, j double")
    grid = rows.select("share", "j", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    return grid.groupBy("threshold", "share").agg(F.avg((F.col("j") <= F.col("threshold")).cast("double")).alias("detected"), F.count("*").alias("n"))
