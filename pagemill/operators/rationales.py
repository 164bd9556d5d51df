"""Block-wise classification, attribution of a linear scorer, and the sentences that explain a decision."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameters of the selection.
TOP_PERCENT = 10
LEAST, MOST = 4, 6
FIRST, STEP, DEPTH = 0.2, 0.025, 10


def weight(token: Column) -> Column:
    """Weight in [-1, 1) of a token for the positive class: the local scorer, from a digest of the token."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(2147483648.0) - F.lit(1.0)


def any_positive(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, is_positive) from one prediction (0 or 1) a block."""
    return blocks.groupBy(key).agg((F.max("prediction") >= 1).alias("is_positive"))


def block_scores(tokens: DataFrame, key: str = "doc_id", size: int = 510) -> DataFrame:
    """(key, block, n, logit, prediction): the linear scorer over runs of ``size`` tokens."""
    rows = tokens.withColumn("block", F.floor(F.col("pos") / size).cast("int")).groupBy(key, "block")
    # Weights are summed as whole millionths, so the sum does not depend on the order of rows.
    rows = rows.agg(F.count("*").alias("n"), F.sum(F.round(weight(F.col("lemma")) * 1000000).cast("bigint")).alias("millionths"))
    return rows.withColumn("logit", F.col("millionths") / 1000000).withColumn("prediction", (F.col("logit") > 0).cast("int"))


def integrated_gradients(x: np.ndarray, gradient, steps: int = 25, method: str = "trapezoid") -> np.ndarray:
    """Attribution of each input from a zero baseline; ``gradient`` maps points (n, d) to gradients (n, d)."""
    if method == "trapezoid":
        g = gradient(np.linspace(0, 1, steps + 1)[:, None] * x)
        return x * ((g[:-1] + g[1:]) / 2).mean(axis=0)
    if method == "gauss":
        nodes, weights = np.polynomial.legendre.leggauss(steps)
        return x * (weights[:, None] / 2 * gradient((nodes[:, None] + 1) / 2 * x)).sum(axis=0)
    raise ValueError(method)


def linear_attributions(tokens: DataFrame, key: str = "doc_id", steps: int = 25, size: int = 510) -> DataFrame:
    """(key, block, pos, attr): integrated gradients of the linear scorer's sigmoid, in closed form.

    On the way from zero to the input a block's logit grows in proportion, so the gradient at step i is the weight
    times the sigmoid's slope at i/steps of the logit.
    """
    scores = block_scores(tokens, key, size).select(key, "block", F.col("logit").alias("z"))
    slope = lambda i: _slope(F.col("z") * F.lit(i / steps))
    mean = (slope(0) + slope(steps)) / 2
    for i in range(1, steps):
        mean = mean + slope(i)
    scores = scores.withColumn("mean_slope", mean / steps)
    rows = tokens.withColumn("block", F.floor(F.col("pos") / size).cast("int"))
    return rows.join(scores, [key, "block"]).select(key, "block", "pos", "sent_id", (weight(F.col("lemma")) * F.col("mean_slope")).alias("attr"))


def _slope(z: Column) -> Column:
    p = 1 / (1 + F.exp(-z))
    return p * (1 - p)


def token_attributions(vectors: Column) -> Column:
    """Mean over each token's vector, without the first and the last token."""
    means = F.transform(vectors, lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x) / F.size(v))
    return F.slice(means, F.lit(2), F.greatest(F.size(means) - 2, F.lit(0)))


def top_attributions(rows: DataFrame, key: str = "doc_id", percent: float = TOP_PERCENT) -> DataFrame:
    """``attr`` with negatives and all below the page's percentile set to 0; exact percentile over the page."""
    cuts = rows.groupBy(key).agg(F.percentile(F.greatest("attr", F.lit(0.0)), 1 - percent / 100).alias("cut"))
    value = F.greatest("attr", F.lit(0.0))
    return rows.join(cuts, key).withColumn("attr", F.when(value < F.col("cut"), 0.0).otherwise(value)).drop("cut")


def sentence_hits(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_id, n, hits) from attributions."""
    return rows.groupBy(key, "sent_id").agg(F.count("*").alias("n"), F.sum((F.col("attr") != 0).cast("bigint")).alias("hits"))


def select_sentences(hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, sent_id) of the sentences that explain a page.

    The threshold on hits/n starts at FIRST and moves by STEP: up while more than MOST sentences pass, down while
    fewer than LEAST. The first level with LEAST to MOST counts; without one, the last non-empty of DEPTH + 1 levels.

    Thresholds are the running sums of floating-point steps. What a level selects depends on the page's sorted
    ratios only, so the search folds over one array a page; no recursion over the table.
    """
    ratio = F.col("hits") / F.col("n")
    pages = hits.groupBy(key).agg(F.sort_array(F.collect_list(ratio)).alias("ratios"))
    start = F.struct(F.lit(FIRST).alias("at"), F.lit(None).cast("double").alias("kept"), F.lit(False).alias("done"))

    def level(state: Column, _: Column) -> Column:
        n = F.size(F.filter(F.col("ratios"), lambda r: r >= state["at"]))
        good = n.between(LEAST, MOST)
        kept = F.when(state["done"] | (n == 0), state["kept"]).otherwise(state["at"])
        at = F.when(n > MOST, state["at"] + STEP).otherwise(state["at"] - STEP)
        return F.struct(F.when(state["done"] | good, state["at"]).otherwise(at).alias("at"), kept.alias("kept"), (state["done"] | good).alias("done"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(DEPTH)), start, level, lambda s: s["kept"])
    cuts = pages.select(key, found.alias("threshold")).where(F.col("threshold").isNotNull())
    return hits.join(cuts, key).where(ratio >= F.col("threshold")).select(key, "sent_id")


def rationales(tokens: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ord, sent_id, text): selected sentences in document order."""
    attributions = linear_attributions(tokens, key)
    chosen = select_sentences(sentence_hits(top_attributions(attributions, key), key), key)
    held = tokens.join(chosen, [key, "sent_id"], "left_semi").groupBy(key, "sent_id").agg(F.sort_array(F.collect_list(F.struct("pos", "form"))).alias("rows"))
    order = Window.partitionBy(key).orderBy("sent_id")
    return held.select(key, (F.row_number().over(order) - 1).alias("ord"), "sent_id", F.array_join(F.col("rows.form"), " ").alias("text"))
