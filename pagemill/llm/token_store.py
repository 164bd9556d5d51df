"""Content-addressed store of token ids.

A rolling hash over the last ``SPAN`` ids cuts each id stream into chunks (at a content-defined place, between
``smallest`` and ``largest`` ids), so an edit changes the chunks around it only. A chunk's address is the first 16
bytes of the SHA-256 of its bytes; each chunk is stored once. A document is a recipe, the list of its chunk
addresses, with the Merkle root over them.

Layout below ``path``:
  objects  kind 'chunk': hash binary(16), width tinyint (bytes an id), payload binary (little-endian ids);
           kind 'recipe': key, n_tokens, hashes binary (16 bytes a chunk), root binary(16), as encoded
  recipes  the recipes in ascending key order, with part, row and the ids before it within its part
  parts    ids before each part

Reading back verifies every chunk against its address, every recipe against its root and length. Checksums of
documents come from the checksums of the chunks read (crc32 combines), so payloads need not move again.

Chunks repeated within a task fall away before the shuffle, so copies of one text cannot gather in one task. The
order over all documents comes from a range partitioning and one number a part, not from a single task.

Defined results: null and empty texts hold the end id only; rows with a null key come first; repeated rows and keys
are stored row by row (equal keys ordered by root); extra columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagemill.llm.common import arrow_map, arrow_schema, map_batches, small_batches
from pagemill.llm.tokens import DTYPE, encode_rows

SPAN = 8
ADDRESS = 16


def address(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:ADDRESS]


def merkle_root(hashes: list[bytes]) -> bytes:
    """Root of a binary hash tree; an odd node moves up unchanged."""
    level = hashes or [address(b"")]
    while len(level) > 1:
        level = [address(level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def places(ids: np.ndarray, mean: int = 256) -> np.ndarray:
    """Ends of id positions whose last SPAN ids allow a cut, ascending."""
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(32)
    rolling = np.zeros(len(ids), np.uint64)
    for back in range(SPAN):  # a window sum with a factor by distance: the same for the same last SPAN ids
        rolling[back:] += mixed[: len(ids) - back] * np.uint64(2 * back + 1)
    rolling ^= rolling >> np.uint64(29)
    return np.flatnonzero(rolling & np.uint64(mean - 1) == 0) + 1


def cut_all(streams: list[np.ndarray], mean: int = 256, smallest: int = 64, largest: int = 1024) -> list[list[int]]:
    """Ends of the chunks of each id stream; ``mean`` is a power of two.

    Places are found over all streams at once. Near a stream's start they depend on the stream before, but no cut is
    made there, as ``smallest`` exceeds the span.
    """
    if smallest < SPAN:
        raise ValueError("the smallest chunk must not be shorter than the span")
    ends = np.cumsum([len(s) for s in streams])
    found = places(np.concatenate(streams), mean) if streams else ends
    first = np.searchsorted(found, ends - [len(s) for s in streams], side="right").tolist()
    stop = np.searchsorted(found, ends, side="left").tolist()
    found, out, begin = found.tolist(), [], 0
    for a, b, end in zip(first, stop, ends.tolist()):
        own, last = [], begin
        for place in [*found[a:b], end]:
            while place - last > largest:
                last += largest
                own.append(last - begin)
            if place - last >= smallest or place == end:
                if place > last:
                    own.append(place - begin)
                last = place
        out.append(own)
        begin = end
    return out


def cut(ids: np.ndarray, mean: int = 256, smallest: int = 64, largest: int = 1024) -> list[int]:
    return cut_all([ids], mean, smallest, largest)[0]


def packed(ids: np.ndarray) -> tuple[int, bytes]:
    """(bytes an id, payload)."""
    width = 2 if int(ids.max(initial=0)) < 1 << 16 else 4
    return width, ids.astype(f"<u{width}").tobytes()


def _sliced(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary array whose values end at byte ``ends`` of ``data``, without a Python object each."""
    offsets = np.append(0, ends).astype("<i4")
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _payloads(ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(bytes an id, payload) of the chunks that end at ``ends`` in one id stream."""
    widths = np.where(np.maximum.reduceat(ids, np.append(0, ends[:-1])) < 1 << 16, 2, 4)
    if (widths == 2).all():
        return widths, _sliced(ids.astype("<u2"), 2 * ends)
    return widths, pa.array([packed(part)[1] for part in np.split(ids, ends[:-1])], pa.binary())


def write_store(docs: DataFrame, path: str, tokenizer_path: str, text: str = "text", key: str = "doc_id", end_id: int = 1, mean: int = 256) -> None:
    kind_of_key = dict(docs.dtypes)[key]
    schema = f"kind string, hash binary, width tinyint, payload binary, key {kind_of_key}, n_tokens bigint, hashes binary, root binary"
    out = arrow_schema(schema)

    def rows_of(kind: str, n: int, **columns: pa.Array) -> pa.RecordBatch:
        columns["kind"] = pa.array([kind] * n, pa.string())
        return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) if f.name in columns else pa.nulls(n, f.type) for f in out], schema=out)

    def encode(batches):
        sent: set[bytes] = set()
        for batch in small_batches(batches, 128):
            streams = encode_rows(tokenizer_path, batch.column("text").to_pylist(), end_id)
            cuts, sizes = cut_all(streams, mean), np.array(list(map(len, streams)))
            ends = np.concatenate([np.array(c) + first for c, first in zip(cuts, np.cumsum(sizes) - sizes)])
            widths, payloads = _payloads(np.concatenate(streams), ends)
            hashes = [address(bytes((w,)) + p) for w, p in zip(widths.tolist(), payloads.to_pylist())]
            fresh = []
            for i, name in enumerate(hashes):
                if name not in sent:
                    sent.add(name)
                    fresh.append(i)
            if len(sent) > 500_000:
                sent.clear()
            if fresh:
                at = pa.array(fresh)
                yield rows_of("chunk", len(fresh), hash=pa.array(hashes, pa.binary()).take(at), width=pa.array(widths).take(at), payload=payloads.take(at))
            counts = np.cumsum(list(map(len, cuts)))
            roots = [merkle_root(hashes[a:b]) for a, b in zip([0, *counts.tolist()], counts.tolist())]
            names = [address(root + str(own).encode()) for root, own in zip(roots, batch.column("key").to_pylist())]
            recipes = _sliced(np.frombuffer(b"".join(hashes), np.uint8), ADDRESS * counts)
            yield rows_of("recipe", len(roots), hash=pa.array(names), key=batch.column("key"), n_tokens=pa.array(sizes), hashes=recipes, root=pa.array(roots))

    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    # Chunks that several tasks met sit side by side in hash order; the first of them stays.
    before = F.lag("hash").over(Window.partitionBy("hash").orderBy("kind"))
    dealt = map_batches(base, encode, schema).withColumn("again", before.isNotNull())
    once = dealt.where((F.col("kind") == "recipe") | ~F.col("again")).drop("again")
    once.write.option("compression", "zstd").parquet(f"{path}/objects")
    _write_order(docs.sparkSession, path, kind_of_key)


def _objects(spark: SparkSession, path: str, kind: str, schema: str) -> DataFrame:
    return spark.read.schema(f"{schema}, kind string").parquet(f"{path}/objects").where(F.col("kind") == kind).drop("kind")


def _write_order(spark: SparkSession, path: str, kind_of_key: str) -> None:
    schema = f"key {kind_of_key}, n_tokens bigint, hashes binary, root binary"
    recipes = _objects(spark, path, "recipe", schema)
    ordered = recipes.repartitionByRange("key", "root").sortWithinPartitions("key", "root")

    def number(slices):
        part, row, before = TaskContext.get().partitionId(), 0, 0
        for rows in slices:
            starts = before + np.cumsum([0, *rows["n_tokens"]])
            n = len(rows["key"])
            yield rows | {"part": [part] * n, "row": list(range(row, row + n)), "before": starts[:-1].tolist()}
            row, before = row + n, int(starts[-1])

    numbered = arrow_map(ordered, number, f"{schema}, part int, row bigint, before bigint", slice_rows=8192)
    numbered.write.option("compression", "zstd").parquet(f"{path}/recipes")
    sizes = spark.read.parquet(f"{path}/recipes").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    starts = np.cumsum([0, *(r["n"] for r in sizes)]).tolist()
    parts = spark.createDataFrame([(r["part"], s) for r, s in zip(sizes, starts)], "part int, part_start bigint")
    parts.coalesce(1).write.parquet(f"{path}/parts")


# Arithmetic of crc32 over concatenations: polynomials modulo the crc polynomial, bits reflected.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    bit, product = 1 << 31, 0
    while a:
        if a & bit:
            product ^= b
            a ^= bit
        bit >>= 1
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return product


@lru_cache(64)
def _doubling(k: int) -> np.ndarray:
    """Tables (by byte of a checksum) of the effect of 2**k zero bytes."""
    power = 1 << 30  # x
    for _ in range(k + 3):
        power = _times(power, power)
    out = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            out[byte, 1 << bit : 2 << bit] = out[byte, : 1 << bit] ^ np.uint32(_times(power, 1 << (8 * byte + bit)))
    return out


def crc32_shift(crcs: np.ndarray, n_bytes: np.ndarray) -> np.ndarray:
    """Effect of ``n_bytes`` further zero bytes on each checksum, as far as it concerns concatenation."""
    crcs, k = crcs.astype(np.uint32), 0
    while n_bytes.any():
        at = np.flatnonzero(n_bytes & 1)
        own, tables = crcs[at], _doubling(k)
        crcs[at] = tables[0][own & 255] ^ tables[1][own >> 8 & 255] ^ tables[2][own >> 16 & 255] ^ tables[3][own >> 24]
        n_bytes, k = n_bytes >> 1, k + 1
    return crcs


def crc32_concat(first: int, second: int, n_second: int) -> int:
    """crc32 of a concatenation from the crc32 of both and the bytes of the second."""
    return int(crc32_shift(np.array([first]), np.array([n_second]))[0]) ^ second


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(hash, crc, n) of every chunk as read and verified; crc over its ids as unsigned 32-bit numbers."""

    def check(batches):
        for batch in small_batches(batches, 4096):
            crcs, sizes = [], []
            for name, width, data in zip(*(batch.column(c).to_pylist() for c in ("hash", "width", "payload"))):
                if address(bytes((width,)) + data) != name:
                    raise ValueError(f"chunk {name.hex()} does not match its address")
                ids = np.frombuffer(data, f"<u{width}")
                crcs.append(zlib.crc32(ids.astype(DTYPE)))
                sizes.append(len(ids))
            columns = [batch.column("hash"), pa.array(crcs, pa.int64()), pa.array(sizes, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["hash", "crc", "n"])

    return map_batches(_objects(spark, path, "chunk", "hash binary, width tinyint, payload binary"), check, "hash binary, crc bigint, n int")


def _recipe_chunks(recipes: DataFrame) -> DataFrame:
    """(part, row, at, hash): one row a chunk of a document."""
    steps = F.sequence(F.lit(0), (F.length("hashes") / ADDRESS).cast("int") - 1)
    named = F.transform(steps, lambda i: F.substring(F.col("hashes"), i * ADDRESS + 1, F.lit(ADDRESS)))
    return recipes.select("part", "row", F.posexplode(named).alias("at", "hash"))


def read_digests(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, start, n_tokens, ids_crc32, root) of every document, verified from the files."""
    recipes, parts = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/parts")
    whole = _recipe_chunks(recipes).join(read_chunks(spark, path), "hash", "left")
    whole = whole.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("at", "crc", "n"))).alias("chunks"))
    # ``parts`` has one row for each write task of the recipes.
    named = recipes.join(F.broadcast(parts), "part").select("part", "row", "key", F.expr("part_start + before AS start"), "n_tokens", "root", "hashes")
    joined = named.join(whole, ["part", "row"]).drop("part", "row")
    joined = joined.select("key", "start", "n_tokens", "root", "hashes", F.col("chunks.crc").alias("crc"), F.col("chunks.n").alias("n"))
    kind_of_key = dict(recipes.dtypes)["key"]
    schema = f"key {kind_of_key}, start bigint, n_tokens bigint, ids_crc32 bigint, root binary"
    names = [f.split()[0] for f in schema.split(", ")]

    def combine(batches):
        for batch in small_batches(batches, 1024):
            crcs, sizes = (batch.column(c).flatten() for c in ("crc", "n"))
            counts = batch.column("crc").value_lengths().to_numpy()
            firsts = np.cumsum(counts) - counts
            n_tokens = batch.column("n_tokens").to_numpy()
            whole = not crcs.null_count and (np.add.reduceat(sizes.to_numpy(), firsts) == n_tokens).all()
            for root, hashes in zip(batch.column("root").to_pylist(), batch.column("hashes").to_pylist()):
                if not whole or merkle_root([hashes[i : i + ADDRESS] for i in range(0, len(hashes), ADDRESS)]) != root:
                    raise ValueError(f"recipe {root.hex()} or one beside it cannot be rebuilt")
            ends = np.cumsum(sizes.to_numpy())
            after = np.repeat(ends[firsts + counts - 1], counts) - ends  # ids of the document behind each chunk
            found = np.bitwise_xor.reduceat(crc32_shift(crcs.to_numpy(), 4 * after), firsts)
            columns = [batch.column(c) for c in names if c != "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*columns[:3], pa.array(found.astype(np.int64)), *columns[3:]], names)

    out = map_batches(joined, combine, schema)
    return out.select(F.col("key").alias(key), "start", "n_tokens", "ids_crc32", F.hex("root").alias("root"))


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """(key, ids array) of every document, rebuilt from its chunks."""
    recipes = spark.read.parquet(f"{path}/recipes")
    chunks = _objects(spark, path, "chunk", "hash binary, width tinyint, payload binary")
    whole = _recipe_chunks(recipes).join(chunks, "hash")
    whole = whole.groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("at", "width", "payload"))).alias("chunks"))
    joined = recipes.select("part", "row", "key").join(whole, ["part", "row"])
    joined = joined.select("key", F.col("chunks.width").alias("width"), F.col("chunks.payload").alias("payload"))

    def rebuild(slices):
        for rows in slices:
            ids = [np.concatenate([np.frombuffer(p, f"<u{w}") for w, p in zip(ws, ps)]).tolist() for ws, ps in zip(rows["width"], rows["payload"])]
            yield {"key": rows["key"], "ids": ids}

    out = arrow_map(joined, rebuild, f"key {dict(recipes.dtypes)['key']}, ids array<bigint>", 256)
    return out.select(F.col("key").alias(key), "ids")
