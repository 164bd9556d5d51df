"""Language identification by multilingual mixture inference.

Every word is drawn from one of the learned languages or from a uniform background. A language's word likelihood
is the product of its letter-trigram probabilities (word edges included). Expectation-maximisation finds the
proportions of each text; the language set is chosen by likelihood less half a logarithm of the word count for
every language (the Bayesian information criterion), along the nested sets of the largest proportions.

The model is a table of hashed trigram counts by language, at most ``BINS`` rows a language, learned from at most
about ``sample_docs`` labelled texts a language (chosen by a hash of key and text, so alike on every run).

Defined results: null texts and texts without a letter are ``und`` with score 0; without any labelled row every
text is ``und``; equal proportions go to the first language by name; repeated rows are judged alike; extra columns
are ignored. Memory follows the longest text, with about 100 bytes a character of a slice of ``SLICE`` characters.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagemill.llm.common import arrow_map

BINS = 1 << 16
SLICE = 400_000
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether a code point is a letter; planes beyond the third count as letters."""
    return np.fromiter((chr(i).isalpha() for i in range(0x30000)), bool, 0x30000)


def _trigrams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trigram bins, one for each letter; index of each word's first letter; position of each word)."""
    codes = np.frombuffer(("\n" + text.lower() + "\n").encode("utf-32-le", "surrogatepass"), "<u4")
    letter = _letters()[np.minimum(codes, 0x2FFFF)]
    codes = np.where(letter, codes, 32).astype(np.uint32)
    at = np.flatnonzero(letter)
    mixed = codes[at - 1] * np.uint32(0x9E3779B1) ^ codes[at] * np.uint32(0x85EBCA77) ^ codes[at + 1] * np.uint32(0xC2B2AE3D)
    first = np.flatnonzero(~letter[at - 1])
    return (mixed ^ mixed >> np.uint32(15)) * np.uint32(0x2C1B3C6D) >> np.uint32(16), first, at[first]


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample_docs: int = 2000) -> tuple[list[str], np.ndarray]:
    """(languages by name, log probabilities: BINS rows, a column a language and the background's last)."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    sizes = {r[0]: r[1] for r in known.groupBy(lang).count().collect()}
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BINS, 1))
    shares = F.create_map(*[F.lit(x) for k in langs for x in (k, int(1e6 * min(1.0, sample_docs / sizes[k])))])
    sample = known.where(F.pmod(F.xxhash64(key, text), F.lit(1_000_000)) < F.element_at(shares, F.col(lang)))

    def count(slices):
        totals: dict[str, np.ndarray] = {}
        for rows in slices:
            for one, name in zip(rows["text"], rows["lang"]):
                for at in range(0, len(one), SLICE):
                    bins = _trigrams(one[at : at + SLICE])[0]
                    totals[name] = totals.get(name, 0) + np.bincount(bins, minlength=BINS)
        for name, n in totals.items():
            held = np.flatnonzero(n)
            yield {"lang": [name] * len(held), "bin": held.tolist(), "n": n[held].tolist()}

    rows = arrow_map(sample.select(F.col(text).alias("text"), F.col(lang).alias("lang")), count, "lang string, bin int, n bigint", 64)
    found = rows.groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BINS, len(langs) + 1), 0.05)
    np.add.at(counts, (found["bin"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy().astype(str))), found["n"].to_numpy())
    counts[:, -1] = 1
    return langs, np.log(counts / counts.sum(axis=0))


def _mixture(like: np.ndarray, owner: np.ndarray, firsts: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of each text from its words' likelihoods (scaled by word), by expectation-maximisation."""
    words = np.diff(np.append(firsts, len(owner)))[:, None]
    share = np.full((len(firsts), like.shape[1]), 1 / like.shape[1])
    for _ in range(rounds):
        part = like * share[owner]
        part /= part.sum(axis=1, keepdims=True) + 1e-300
        share = np.add.reduceat(part, firsts, axis=0) / words
    return share


def _language_sets(like: np.ndarray, firsts: np.ndarray, sizes: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of each text over the language set of the best penalised likelihood; the background always stays.

    The sets of a text are nested: its k languages of the largest proportions. They grow as long as that pays, so one
    language is compared with two for every text.
    """
    n_langs = share.shape[1] - 1
    order = np.argsort(-share[:, :-1], axis=1, kind="stable")
    best, chosen = np.full(len(firsts), -np.inf), share.copy()
    live = np.arange(len(firsts))
    for k in range(1, n_langs + 1):
        words = np.repeat(firsts[live] - np.cumsum(sizes[live]) + sizes[live], sizes[live]) + np.arange(sizes[live].sum())
        starts, owner = np.cumsum(sizes[live]) - sizes[live], np.repeat(np.arange(len(live)), sizes[live])
        use = np.column_stack([order[live, :k], np.full(len(live), n_langs)])
        own = np.take_along_axis(like[words], use[owner], axis=1)
        part = np.take_along_axis(share[live], use, axis=1) + 1e-6
        part /= part.sum(axis=1, keepdims=True)
        for _ in range(rounds):
            mixed = own * part[owner]
            mixed /= mixed.sum(axis=1, keepdims=True) + 1e-300
            part = np.add.reduceat(mixed, starts, axis=0) / sizes[live][:, None]
        value = np.add.reduceat(np.log((own * part[owner]).sum(axis=1) + 1e-300), starts) - k * np.log(sizes[live] + 1) / 2
        pays = value > best[live]
        live, use, part = live[pays], use[pays], part[pays]
        if not len(live):
            break
        best[live] = value[pays]
        chosen[live] = 0
        chosen[live[:, None], use] = part
    return chosen


def judge(texts: list[str | None], langs: list[str], model: np.ndarray, rounds: int = 8) -> list[tuple[list[str], list[float], float]]:
    """(languages from the largest proportion on, their proportions, the background's proportion) of each text."""
    out: list[tuple[list[str], list[float], float]] = [([], [], 0.0)] * len(texts)
    likes, sizes = [], []
    for text in texts:
        n = 0
        at = 0
        while langs and text and at < len(text):
            end = min(len(text), at + SLICE)
            while end < len(text) and end < at + 2 * SLICE and text[end].isalpha():
                end += 1
            bins, first, _ = _trigrams(text[at:end])
            if len(first):
                likes.append(np.add.reduceat(model[bins], first, axis=0))
                n += len(first)
            at = end
        sizes.append(n)
    held = [i for i, n in enumerate(sizes) if n]
    if held:
        like = np.concatenate(likes)
        like = np.exp(like - like.max(axis=1, keepdims=True))
        n = np.array([sizes[i] for i in held])
        firsts = np.cumsum(n) - n
        shares = _mixture(like, np.repeat(np.arange(len(held)), n), firsts, rounds)
        shares = _language_sets(like, firsts, n, shares, rounds)
        for i, share in zip(held, shares.tolist()):
            own = sorted((-x, name) for x, name in zip(share, langs) if x > 0) or [(0.0, langs[0])]
            out[i] = ([name for _, name in own], [-x for x, _ in own], share[-1])
    return out


_FIELDS = "lang_pred string, score double, background double, languages array<string>, proportions array<double>"
NAMES = tuple(f.split()[0] for f in _FIELDS.split(", "))


def _judged(docs: DataFrame, langs: list[str], model: np.ndarray, text: str, keep: tuple[str, ...]) -> DataFrame:
    """Columns keep0, keep1 and so on, and the judgement under its own names."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, model))
    kinds = dict(docs.dtypes)

    def run(slices):
        known, table = shared.value
        for rows in slices:
            found = judge(rows.pop("judged"), known, table)
            yield rows | {
                "lang_pred": [names[0] if names else UNDETERMINED for names, _, _ in found],
                "score": [min(1.0, parts[0] / total) if (total := sum(parts)) > 0 else 0.0 for _, parts, _ in found],
                "background": [background for _, _, background in found],
                "languages": [names for names, _, _ in found],
                "proportions": [parts for _, parts, _ in found],
            }

    renamed = docs.select(*(F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)), F.col(text).alias("judged"))
    schema = ", ".join([*(f"keep{i} {kinds[c]}" for i, c in enumerate(keep)), _FIELDS])
    return arrow_map(renamed, run, schema, slice_rows=64)


def identify(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep``, then lang_pred, score, background, languages and proportions.

    One pass, no shuffle; the model (about 0.5 MB a language) is broadcast. A kept column of one of these names gives way.
    """
    keep = tuple(c for c in keep if c not in NAMES)
    judged = _judged(docs, langs, model, text, keep)
    return judged.select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)), *NAMES)


def in_known_language(docs: DataFrame, langs: list[str], model: np.ndarray, most_background: float, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, that are in a learned language but for ``most_background`` of their words."""
    judged = _judged(docs, langs, model, text, tuple(docs.columns))
    known = (F.col("lang_pred") != UNDETERMINED) & (F.col("background") <= most_background)
    return judged.where(known).select(*(F.col(f"keep{i}").alias(c) for i, c in enumerate(docs.columns)))


def fold(key: Column) -> Column:
    """Fold 0 to 4 of a document, by the crc32 of its key as text."""
    return F.crc32(key.cast("string").cast("binary")) % 5
