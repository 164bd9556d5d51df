"""Connected components by alternating large-star and small-star steps; nothing is collected to the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map, discard, salted_join, staged


def _forest(edges: DataFrame) -> DataFrame:
    """Edges of each partition replaced by its own spanning stars: far fewer edges and rounds later."""

    def run(slices):
        up: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while (nxt := up.setdefault(top, top)) != top:
                top = nxt
            while up[x] != top:
                up[x], x = top, up[x]
            return top

        def stars():
            low: dict[int, int] = {}
            for x in up:
                r = root(x)
                low[r] = min(low.get(r, x), x)
            pairs = [(x, low[root(x)]) for x in up if x != low[root(x)]]
            up.clear()
            return {"a": [p[0] for p in pairs], "b": [p[1] for p in pairs]}

        for rows in slices:
            for a, b in zip(rows["a"], rows["b"]):
                up[root(a)] = root(b)
            if len(up) > 2_000_000:
                yield stars()
        if up:
            yield stars()

    return arrow_map(edges, run, "a bigint, b bigint", slice_rows=8192)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (``a``, ``b`` longs); root is the component's smallest node.

    Hubs are safe: neighbour minima are summed up before the shuffle, and a hub's edges are dealt to several tasks in
    the join back.
    """
    now = staged(_forest(edges.where("a <> b")).distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))
        large = salted_join(both.where("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = salted_join(large, low, "a", "b")
        before = now
        now = staged(small.select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").unionByName(low.select("a", F.col("low").alias("b"))).distinct(), "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == mark:
            break
        mark = state
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def spanning_pairs(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that span the components of 64-bit values linked at ``distance`` or fewer bits.

    Breadth-first over what is not reached yet, so a dense group costs one comparison a member and gives one
    pair a member, not all pairs.
    """
    left = np.arange(len(values))
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= distance
            if near.any():
                hits = left[near]
                a.append(np.full(len(hits), at))
                b.append(hits)
                queue.extend(hits.tolist())
                left = left[~near]
    none = np.empty(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)
