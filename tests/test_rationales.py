import random

import numpy as np
from pagemill.operators import rationales as rat
from pagemill.operators import scorer, spans
from pyspark.sql import functions as F


def search(ratios):
    """Recursive restatement of the threshold search."""

    def level(at, depth):
        if depth < 0:
            return None
        now = [i for i, r in enumerate(ratios) if r >= at]
        if 4 <= len(now) <= 6:
            return now
        new = level(at + 0.025 if len(now) > 6 else at - 0.025, depth - 1)
        return new if new else now

    return level(0.2, 10)


def test_selection_against_recursion(spark):
    rng = random.Random(3)
    pages = {i: [(rng.randint(1, 12), rng.random()) for _ in range(rng.randint(1, 30))] for i in range(150)}
    rows = [(i, s, n, int(p**3 * n)) for i, sents in pages.items() for s, (n, p) in enumerate(sents)]
    got: dict[int, list] = {i: [] for i in pages}
    for r in rat.select_sentences(spark.createDataFrame(rows, "doc_id int, sent_id int, n int, hits int")).collect():
        got[r.doc_id].append(r.sent_id)
    for i, sents in pages.items():
        assert sorted(got[i]) == search([h / n for j, s, n, h in rows if j == i]), i


def test_top_attributions_is_numpy_percentile(spark):
    values = [0.5, -1.0, 0.1, 0.7, 0.2, 0.9, 0.0, 0.3, 0.4, 0.6, 0.8]
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "doc_id int, pos int, attr double")
    got = [r.attr for r in rat.top_attributions(rows).orderBy("pos").collect()]
    clipped = np.maximum(values, 0)
    assert got == np.where(clipped < np.percentile(clipped, 90), 0, clipped).tolist()


def test_integrated_gradients_sum_to_the_difference():
    w = np.array([0.3, -0.2, 0.9])
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    gradient = lambda x: (sigmoid(x @ w) * (1 - sigmoid(x @ w)))[:, None] * w
    x = np.array([1.0, 2.0, 3.0])
    for method, places in (("trapezoid", 1e-3), ("gauss", 1e-9)):
        assert abs(rat.integrated_gradients(x, gradient, 25, method).sum() - (sigmoid(x @ w) - 0.5)) < places


def test_token_attributions(spark):
    row = spark.createDataFrame([([[1.0, 1.0], [2.0, 4.0], [5.0, 5.0]],), ([[1.0]],)], "v array<array<double>>").select(rat.token_attributions(F.col("v"))).collect()
    assert [r[0] for r in row] == [[3.0], []]


def test_span_location(spark):
    rows = spark.createDataFrame([(list("abcdefg"), list("cd")), (list("ab"), list("ab")), (list("abc"), list("xy"))], "tokens array<string>, wanted array<string>")
    assert [(r["at"], r.jaccard, r.whole) for r in spans.located(rows).collect()] == [(2, 1.0, False), (0, 0.0, True), (0, 0.0, True)]


def test_edge_offsets_shorten(spark):
    rows = spark.createDataFrame([("Hello, big world", ["Hello", ",", "big", "moon"]), ("abc", ["x", "y"])], "text string, wanted array<string>")
    assert [(r.start_offset, r.end_offset) for r in spans.edge_offsets(rows).collect()] == [(0, 15), (0, 2)]


def test_mark_up():
    assert spans.mark_up("<p>a &amp; b<!-- b --></p>", [{"value": "x-start-0", "text": "& b"}]) == '<p>a <span data-element-id="x-start-0">&amp; b</span><!-- b --></p>'
    assert spans.mark_up(None, None) == ""


class TwoLayers:
    """A scorer of three classes whose logits are not linear."""

    mix = np.array([[0.3, -0.2], [0.1, 0.5], [-0.4, 0.2]])

    def embed(self, tokens):
        return np.array([[len(t), t.count("a")] for t in tokens], float)

    def logits(self, embeddings):
        return np.tanh(embeddings).sum(axis=1) @ self.mix.T

    def logit_gradient(self, embeddings):
        return (1 - np.tanh(embeddings) ** 2)[:, None] * self.mix[None, :, None, :]


def test_probability_gradient_and_completeness():
    own, x = TwoLayers(), TwoLayers().embed(["a", "bab", "c", "aa"]) / 3
    got = scorer.probability_gradient(own, x[None], 2)[0]
    for i in np.ndindex(x.shape):
        step = np.zeros_like(x)
        step[i] = 1e-6
        up, down = (scorer.softmax(own.logits(y[None]))[0, 2] for y in (x + step, x - step))
        assert abs((up - down) / 2e-6 - got[i]) < 1e-8
    total = 2 * scorer.attributions(own, x, 2, 400).sum()  # two dimensions are averaged
    change = scorer.softmax(own.logits(x[None]))[0, 2] - scorer.softmax(own.logits(0 * x[None]))[0, 2]
    assert abs(total - change) < 1e-5


def test_scored_blocks(spark):
    rows = spark.createDataFrame([(1, "a " * 600), (2, None), (None, "A b."), (3, " ")], "doc_id int, text string")
    got = sorted((r.doc_id or 0, r.block, r.n, r.prediction) for r in scorer.score_blocks(rows, factory=TwoLayers).collect())
    assert [g[:3] for g in got] == [(0, 0, 3), (1, 0, 510), (1, 1, 90)]
    assert sorted((r.doc_id or 0, r.pos) for r in scorer.block_attributions(rows, factory=TwoLayers).where("doc_id IS NULL").collect()) == [(0, 0), (0, 1), (0, 2)]
