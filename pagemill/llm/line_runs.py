"""Line deduplication with levelled sorted runs of line hashes.

A run is a table bucketed by line hash and sorted within its buckets: ``key`` (128-bit hash) and ``n`` (documents that
hold the line). A new batch is summed into a run of its own, which is merge-anti-joined with all runs before it, bucket
by bucket without a shuffle: what none of them holds is new with this batch. Then the batch's run joins level 0; when a
level holds ``fanout`` runs they are compacted into one run of the next level, so a line hash is rewritten only a
logarithmic number of times.

Two decisions come from the anti-join. ``dedup_batch`` keeps a line in the batch that brought it first. ``drop_repeats``
keeps it in the largest id: batches are ranges of ids and come from the largest ids down, so the batch that is the first
to bring a line holds its largest id. After the last batch the merged runs tell which lines enough documents hold.

Only (hash, id) pairs are exploded, never texts, and repeats within a document fall away before the shuffle; a line that
a third of all documents hold is summed before it moves, and its rows are dealt to several tasks where they meet the
decision. Texts move once, to meet their drop list.

Defined results: null and empty texts are one empty line; lines whose key is shorter than ``min_length`` code points
always stay; rows that share an id are one document and are treated alike, rows with a null id too (the least of all
ids); other columns pass through untouched, but columns named like the three results give way to them.
"""

from __future__ import annotations

import uuid

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, salted_join, staged, staging_path

_SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None, min_length: int) -> tuple[list[str], list[bytes | None]]:
    """Lines of a text and the hash of each line's key, None for short keys."""
    lines = (text or "").split("\n")
    hashes: list[bytes | None] = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(_SPACE)
        long = len(key) >= 4 * min_length or len(key) >= min_length and len(key.decode("utf-8", "surrogatepass")) >= min_length
        hashes.append(xxhash.xxh3_128_digest(key) if long else None)
    return lines, hashes


def keyed_lines(docs: DataFrame, text: str, key: str, min_length: int) -> DataFrame:
    """(id, line hash), each hash once a row."""

    def run(slices):
        for rows in slices:
            ids, keys = [], []
            for one, value in zip(rows["id"], rows["text"]):
                own = set(line_keys(value, min_length)[1]) - {None}
                ids += [one] * len(own)
                keys += own
            yield {"id": ids, "key": keys}

    return arrow_map(docs.select(F.col(key).alias("id"), F.col(text).alias("text")), run, f"id {dict(docs.dtypes)[key]}, key binary")


class LineRuns:
    """The runs of one corpus, in the shared folder."""

    def __init__(self, spark: SparkSession, fanout: int = 3, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        #: As many as a shuffle has partitions: then a batch's sums lie in buckets as they come.
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[str] = []

    def _write(self, run: DataFrame, level: int) -> DataFrame:
        name = f"pagemill_lines_{uuid.uuid4().hex}"
        path = staging_path(self.spark, f"lines-run{level}")
        run.write.bucketBy(self.buckets, "key").sortBy("key").option("compression", "zstd").option("path", path).saveAsTable(name, format="parquet")
        self.tables.append(name)
        return self.spark.table(name)

    @staticmethod
    def _merged(runs: list[DataFrame]) -> DataFrame:
        both = runs[0].select("key", "n")
        for run in runs[1:]:
            both = both.unionByName(run.select("key", "n"))
        return both if len(runs) == 1 else both.groupBy("key").agg(F.sum("n").alias("n"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (id, key) rows; returns (key, top) of the lines new with it, top being the largest id in it."""
        run = self._write(lines.groupBy("key").agg(F.count_distinct(F.struct("id")).alias("n"), F.max("id").alias("top")), 0)
        new = run.select("key", "top")
        for level in self.levels:
            for old in level:
                new = new.join(old.select("key").hint("merge"), "key", "left_anti")
        new, level = staged(new, "lines-new"), 0
        while True:
            if len(self.levels) <= level:
                self.levels.append([])
            self.levels[level].append(run)
            if len(self.levels[level]) < self.fanout:
                return new
            run, self.levels[level] = self._write(self._merged(self.levels[level]), level + 1), []
            level += 1

    def merged(self) -> DataFrame | None:
        """(key, n) of all lines so far."""
        runs = [run for level in self.levels for run in level]
        return self._merged(runs) if runs else None

    def close(self) -> None:
        """Forget the tables; their files go with the application."""
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.tables, self.levels = [], []


RESULTS = ("__kept", "__n_lines", "__n_dropped")


def _without(docs: DataFrame, drops: DataFrame, text: str, key: str, min_length: int) -> DataFrame:
    """``docs`` with __kept, __n_lines and __n_dropped; ``drops`` holds the (id, key) rows to drop."""
    names = [c for c in docs.columns if c not in RESULTS]
    kinds = dict(docs.dtypes)
    drops = drops.groupBy("id").agg(F.collect_set("key").alias("gone"))
    renamed = docs.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(names)))
    own, value_of = f"keep{names.index(key)}", f"keep{names.index(text)}"
    joined = renamed.join(drops, F.col(own).eqNullSafe(F.col("id")), "left").drop("id")

    def run(slices):
        for rows in slices:
            kept, n_lines, n_dropped = [], [], []
            for value, gone in zip(rows[value_of], rows.pop("gone")):
                if gone:
                    gone = set(map(bytes, gone))
                    lines, keys = line_keys(value, min_length)
                    stay = [x for x, k in zip(lines, keys) if k not in gone]
                    kept.append("\n".join(stay))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                else:
                    kept.append(value or "")
                    n_lines.append(kept[-1].count("\n") + 1)
                    n_dropped.append(0)
            yield rows | {"kept": kept, "n_lines": n_lines, "n_dropped": n_dropped}

    schema = ", ".join([*(f"keep{i} {kinds[c]}" for i, c in enumerate(names)), "kept string, n_lines bigint, n_dropped bigint"])
    out = arrow_map(joined, run, schema)
    return out.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(names)), *(F.col(c[2:]).alias(c) for c in RESULTS))


def _batch_of(docs: DataFrame, key: str, batches: int) -> Column:
    """Number of a row's batch by its ``id``: ranges of ids of about equal size, the largest ids first, null ids last."""
    ids = docs.select(F.col(key).alias("id")).where(F.col("id").isNotNull()).repartitionByRange(batches, "id")
    firsts = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.min("id").alias("first")).select("first").collect()
    batch = F.lit(0)
    for first in sorted((r["first"] for r in firsts), reverse=True):
        batch = batch + F.when(F.col("id") >= F.lit(first), 0).otherwise(1)
    return F.least(batch, F.lit(batches - 1))


def drop_repeats(
    docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = 20, min_docs: int = 3, batches: int = 4, fanout: int = 3
) -> DataFrame:
    """Lines held by ``min_docs`` documents or more stay only in the largest id. Adds __kept, __n_lines, __n_dropped."""
    lines = staged(keyed_lines(docs, text, key, min_length).withColumn("batch", _batch_of(docs, key, batches)), "lines", "batch")
    runs, new = LineRuns(docs.sparkSession, fanout), None
    for batch in range(batches):
        fresh = runs.add(lines.where(F.col("batch") == batch).drop("batch"))
        new = fresh if new is None else new.unionByName(fresh)
    common = runs.merged().where(F.col("n") >= min_docs).join(new, "key").select("key", "top")
    common = staged(common, "lines-common")
    runs.close()
    held = salted_join(lines.select("id", "key"), common, "key", "id")
    return _without(docs, held.where(~F.col("id").eqNullSafe(F.col("top"))).select("id", "key"), text, key, min_length)


def dedup_batch(runs: LineRuns, docs: DataFrame, text: str = "text", key: str = "doc_id", min_length: int = 20) -> DataFrame:
    """One batch against all before it: lines that the runs hold go; within the batch the largest id keeps a line."""
    lines = staged(keyed_lines(docs, text, key, min_length), "lines-batch")
    stays = runs.add(lines).withColumnRenamed("key", "held")
    drops = lines.join(stays, (F.col("key") == F.col("held")) & F.col("id").eqNullSafe(F.col("top")), "left_anti")
    return _without(docs, drops, text, key, min_length)
