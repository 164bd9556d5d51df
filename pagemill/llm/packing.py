"""Bounded-space online packing of token ids into windows of fixed length.

Each partition keeps ``open_windows`` open. A document's full windows leave at once; its rest goes to the open
window that it fills best. When none fits and none is free, the fullest takes as much of the rest as it has room
for (if that room is at least ``min_fragment``, else it is padded) and is emitted. What is still open at the end of
a partition is a leftover. Leftovers of ``merge_width`` partitions meet in one task and are packed by the same rule,
again and again until one task holds fewer windows than that; its last window is cut at powers of two, so it needs
no padding.

State is bounded: open windows of one partition, or of ``merge_width`` partitions. Tasks read their input in scan
order and write once to the shared folder, so a lost executor cannot change a sequence that others have seen.

Defined results: null and empty texts give one piece with the end id; repeated rows are packed one by one; an empty
table gives no pieces; other columns are ignored. Piece rows: key, start, length, doc_tokens, sequence_id, offset,
ids_crc32, and ids (binary) if ``with_ids``.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, staged
from pagemill.llm.tokens import DTYPE, encode_rows

_FIELDS = "start bigint, length bigint, doc_tokens bigint, level int, part bigint, number bigint, offset bigint, ids_crc32 bigint, open boolean, ids binary"
Piece = tuple  # (key, start, ids, doc_tokens)


class Packer:
    """Windows of one task. ``done`` collects (number, pieces) of emitted windows."""

    def __init__(self, window: int, open_windows: int, min_fragment: int):
        self.window, self.limit, self.min_fragment = window, open_windows, min_fragment
        self.open: dict[int, list[Piece]] = {}
        self.room: list[tuple[int, int]] = []  # (room left, number), sorted
        self.done: list[tuple[int, list[Piece]]] = []
        self.next = 0

    def _fresh(self) -> int:
        self.next += 1
        return self.next - 1

    def add(self, piece: Piece) -> None:
        key, start, ids, total = piece
        while len(ids) >= self.window:
            self.done.append((self._fresh(), [(key, start, ids[: self.window], total)]))
            start, ids = start + self.window, ids[self.window :]
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                room, number = self.room.pop(at)
            elif len(self.room) < self.limit:
                room, number = self.window, self._fresh()
                self.open[number] = []
            else:
                room, number = self.room.pop(0)
                if room < self.min_fragment:
                    self.done.append((number, self.open.pop(number)))
                    continue
            size = min(room, len(ids))
            self.open[number].append((key, start, ids[:size], total))
            start, ids = start + size, ids[size:]
            if room == size:
                self.done.append((number, self.open.pop(number)))
            else:
                insort(self.room, (room - size, number))

    def close(self) -> None:
        """Emit what is open: windows are filled up from the emptiest, the last is cut at powers of two."""
        pieces = [p for _, number in self.room for p in self.open[number]]
        self.open, self.room = {}, []
        left, now, size = sum(len(p[2]) for p in pieces), [], 0
        goal = self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)
        for key, start, ids, total in pieces:
            while len(ids):
                take = min(goal - size, len(ids))
                now.append((key, start, ids[:take], total))
                start, ids, size, left = start + take, ids[take:], size + take, left - take
                if size == goal:
                    self.done.append((self._fresh(), now))
                    now, size = [], 0
                    goal = self.window if left >= self.window else 1 << max(0, left.bit_length() - 1)

    def rows(self, level: int, part: int, with_ids: bool, rest: bool = False) -> dict[str, list]:
        """Emitted windows as columns; with ``rest`` also the open ones, which keep their ids."""
        columns: dict[str, list] = {k: [] for k in ("key", *(f.split()[0] for f in _FIELDS.split(", ")))}
        windows = [(n, ps, False) for n, ps in self.done] + ([(n, ps, True) for n, ps in sorted(self.open.items())] if rest else [])
        for number, pieces, is_open in windows:
            offset = 0
            for key, start, ids, total in pieces:
                data = ids.tobytes()
                row = (key, start, len(ids), total, level, part, number, offset, zlib.crc32(data), is_open, data if with_ids or is_open else None)
                for column, value in zip(columns.values(), row, strict=True):
                    column.append(value)
                offset += len(ids)
        self.done = []
        return columns


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    text: str = "text",
    key: str = "doc_id",
    end_id: int = 1,
    window: int = 2048,
    open_windows: int = 64,
    min_fragment: int = 16,
    merge_width: int = 16,
    with_ids: bool = True,
) -> DataFrame:
    if window & (window - 1):
        raise ValueError("the window must be a power of two")
    schema = f"key {dict(docs.dtypes)[key]}, {_FIELDS}"

    def first(slices):
        part, packer = TaskContext.get().partitionId(), Packer(window, open_windows, min_fragment)
        for rows in slices:
            for own, ids in zip(rows["key"], encode_rows(tokenizer_path, rows["text"], end_id)):
                packer.add((own, 0, ids, len(ids)))
            yield packer.rows(0, part, with_ids)
        yield packer.rows(0, part, with_ids, rest=True)

    def merging(level: int, last: bool):
        def merge(slices):
            now, packer = None, None

            def finish():
                if last:
                    packer.close()
                return packer.rows(level, now, with_ids, rest=True)

            for rows in slices:
                for group, *piece, data in zip(rows["group"], rows["key"], rows["start"], rows["doc_tokens"], rows["ids"]):
                    if group != now:
                        if packer:
                            yield finish()
                        now, packer = group, Packer(window, open_windows, min_fragment)
                    packer.add((piece[0], piece[1], np.frombuffer(data, DTYPE), piece[2]))
                if packer:
                    yield packer.rows(level, now, with_ids)
            if packer:
                yield finish()

        return merge

    base = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    done, level = staged(arrow_map(base, first, schema, slice_rows=64), "packed"), 0
    parts = done.where("open").agg(F.max("part")).first()[0]
    rest = done.where("open")
    done = done.where("not open")
    while parts is not None:
        level, parts = level + 1, parts // merge_width
        grouped = rest.withColumn("group", F.floor(F.col("part") / merge_width)).repartition(int(parts) + 1, "group")
        grouped = grouped.sortWithinPartitions("group", "part", "number", "offset").select("group", "key", "start", "doc_tokens", "ids")
        merged = staged(arrow_map(grouped, merging(level, parts == 0), schema, slice_rows=256), "packed-rest")
        done, rest = done.unionByName(merged.where("not open")), merged.where("open")
        if parts == 0:
            break
    number = F.shiftleft(F.col("level").cast("bigint"), 56) + F.shiftleft("part", 28) + F.col("number")
    names = ("start", "length", "ids_crc32", "doc_tokens")
    return done.select(F.col("key").alias(key), *names, number.alias("sequence_id"), "offset", *(["ids"] if with_ids else []))
