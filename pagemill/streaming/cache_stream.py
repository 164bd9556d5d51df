"""The classify cache over an unbounded sequence of page versions: state by URL, anchored at the accepted version."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.functions.similarity import signature_of
from pagemill.runtime import ship


def classify_stream(versions: DataFrame, threshold: float = 0.95) -> DataFrame:
    """``versions``: url, version, text (normalised). Emits (url, version, action) as they come.

    The state of a URL is the signature of its last accepted version (4 KB), so it does not grow with its history.
    Within a micro-batch versions are taken in their order.
    """
    ship(versions.sparkSession)

    def step(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = list(state.get[0]) if state.exists else None
        rows = pd.concat(list(batches)).sort_values("version")
        actions = []
        for text in rows["text"]:
            now = signature_of(text)
            if anchor is None:
                action, anchor = "miss", now
            elif sum(a == b for a, b in zip(anchor, now)) / len(now) > threshold:
                action = "hit"
            else:
                action, anchor = "changed", now
            actions.append(action)
        state.update((anchor,))
        yield pd.DataFrame({"url": key[0], "version": rows["version"].tolist(), "action": actions})

    return versions.groupBy("url").applyInPandasWithState(
        step, "url string, version int, action string", "signature array<bigint>", "append", GroupStateTimeout.NoTimeout
    )
