"""Language identification as a mixture over a document's words.

Training counts hashed character n-grams (one to three letters, word borders included) of every
language. A word's likelihood under a language is the product over its n-grams; a document is a
bag of words, each drawn from one language of an unknown mixture. Expectation maximisation
estimates the mixture's proportions. The language set starts with all languages and loses its
weakest member as long as the penalised likelihood (one penalty of ``log(words)`` per language)
does not fall. The prediction is the language with the largest proportion, its score that
proportion.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, text_blocks

BUCKETS = 1 << 15
# letters of a run without a border (scripts without spaces)
WORD = 16
ROUNDS = 8
# share of the training counts by which unseen n-grams are smoothed
SMOOTH = 0.5
# least likelihood of a word beside its best language
FLOOR = 1e-30
BLOCK = 1 << 18
UNKNOWN = "und"
HELD_OUT = 2


class Grams:
    """Cuts texts into words and words into hashed n-grams."""

    def __init__(self):
        self.known = np.zeros(0x110000, dtype=np.int8)  # 1 letter, -1 none, 0 not asked yet

    def is_letter(self, codes: np.ndarray) -> np.ndarray:
        for c in np.unique(codes[self.known[codes] == 0]).tolist():
            self.known[c] = 1 if chr(c).isalpha() else -1
        return self.known[codes] > 0

    def cut(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Buckets of all n-grams, the first n-gram of each word, the text of each word."""
        codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4") for t in texts]
        sizes = np.array([len(c) for c in codes])
        all_codes = np.concatenate([*codes, np.zeros(0, dtype="<u4")]).astype(np.int64)
        text = np.repeat(np.arange(len(texts)), sizes)
        at = np.nonzero(self.is_letter(all_codes))[0]
        code, text = all_codes[at], text[at]
        if not len(at):
            none = np.zeros(0, dtype=np.int64)
            return none, none, none
        fresh = np.ones(len(at), dtype=bool)
        fresh[1:] = (np.diff(at) > 1) | (text[1:] != text[:-1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        fresh |= (np.arange(len(at)) - first) % WORD == 0
        last = np.append(fresh[1:], True)
        one = np.where(fresh, 0, np.concatenate([[0], code[:-1]]))
        two = np.where(fresh | np.concatenate([[True], fresh[:-1]]), 0, np.concatenate([[0, 0], code])[: len(code)])
        after = np.where(last, 0, np.append(code[1:], 0))
        grams = np.stack(
            [
                _bucket(code, 1),
                _bucket(one * 0x1FFFFF + code, 2),
                _bucket((two * 0x1FFFFF + one) * 0x1FFFFF + code, 3),
                _bucket(code * 0x1FFFFF + after, 4),
            ],
            axis=1,
        )
        starts = np.nonzero(fresh)[0]
        return grams.ravel(), starts * 4, text[starts]


def _bucket(values: np.ndarray, order: int) -> np.ndarray:
    mixed = (values.astype(np.uint64) * np.uint64(8) + np.uint64(order)) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)).astype(
        np.int64
    ) % BUCKETS


class Model:
    """Languages and the log-likelihood of every bucket under each."""

    def __init__(self, langs: list[str], scores: np.ndarray):
        self.langs, self.scores = langs, scores


def held_out() -> Column:
    """True for documents that training must not see."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(-1)) == HELD_OUT


def train(docs: DataFrame) -> Model:
    """Counts the n-grams of all texts with a language that are not held out.

    Each task adds up its own texts by language and bucket before anything is shuffled; what
    reaches the driver is one count per language and bucket (at most ``BUCKETS`` per language).
    """
    bounded_batches(docs.sparkSession)
    rows = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, sums = Grams(), {}
        for b in batches:
            for lang, part in b.groupby("lang")["text"]:
                total = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for _, block in text_blocks(part.tolist(), BLOCK):
                    total += np.bincount(grams.cut(block)[0], minlength=BUCKETS)
        for lang, total in sums.items():
            seen = np.nonzero(total)[0]
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": total[seen]})

    counts = rows.select("lang", "text").mapInPandas(count, "lang string, bucket int, n long")
    table = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(table["lang"].unique())
    sums = np.zeros((BUCKETS, len(langs)))
    for k, lang in enumerate(langs):
        own = table[table["lang"] == lang]
        sums[own["bucket"].to_numpy(), k] = own["n"].to_numpy()
    sums += SMOOTH
    return Model(langs, np.log(sums / sums.sum(0)).astype(np.float32) if langs else sums)


def mixtures(like: np.ndarray, starts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Proportions (documents x languages) of the selected language sets.

    ``like`` holds each word's likelihoods scaled by its largest, ``starts`` each document's first
    word, ``words`` its number of words.
    """
    doc = np.repeat(np.arange(len(starts)), words)
    mix = np.full((len(starts), like.shape[1]), 1 / like.shape[1])

    def fit(mix: np.ndarray, only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.repeat(only, words[only])
        if len(only) == len(starts):
            sub, at = like, starts
        else:
            chosen = np.zeros(len(starts), dtype=bool)
            chosen[only] = True
            sub = like[chosen[doc]]
            at = np.concatenate([[0], np.cumsum(words[only])[:-1]])
        for _ in range(ROUNDS):
            # expected words of each language: its proportion times the sum of likelihood ratios
            ratio = sub / np.einsum("ij,ij->i", sub, mix[rows])[:, None]
            mix[only] *= np.add.reduceat(ratio, at, axis=0) / words[only, None]
        value = np.add.reduceat(np.log(np.einsum("ij,ij->i", sub, mix[rows])), at)
        return mix, value - (mix[only] > 0).sum(1) * np.log(words[only] + 1.0)

    everyone = np.arange(len(starts))
    mix, value = fit(mix, everyone)
    active = everyone
    while True:
        active = active[(mix[active] > 0).sum(1) > 1]
        if not len(active):
            return mix
        fewer = mix.copy()
        weakest = np.where(fewer[active] > 0, fewer[active], np.inf).argmin(1)
        fewer[active, weakest] = 0
        fewer[active] /= fewer[active].sum(1, keepdims=True)
        fewer, without = fit(fewer, active)
        better = without >= value[active]
        active = active[better]
        mix[active] = fewer[active]
        value[active] = without[better]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language of every text and its proportion; ``und`` and 0 where there is no letter."""
    grams = Grams()
    names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    limit = max(1 << 12, BLOCK // max(1, len(model.langs) // 4))
    for first, block in text_blocks(texts, limit) if model.langs else ():
        buckets, starts, text = grams.cut(block)
        if not len(starts):
            continue
        logs = np.add.reduceat(model.scores[buckets], starts, axis=0)
        like = np.exp((logs - logs.max(1, keepdims=True)).astype(np.float64)) + FLOOR
        have, at, words = np.unique(text, return_index=True, return_counts=True)
        mix = mixtures(like, at, words)
        best = mix.argmax(1)
        for d, k, p in zip(have + first, best, mix[np.arange(len(best)), best], strict=True):
            names[d], scores[d] = model.langs[k], min(float(p), 1.0)
    return names, scores


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, held_out, lang_pred, score.

    Nothing but the text decides. A text that is null or has no letter is ``und`` with score 0,
    and so is every text if the model has no language. Repeated rows each get their row, other
    columns are ignored, no rows give no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.scores))

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, scores = predict(Model(*shared.value), texts.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    rows = docs.select("doc_id", held_out().alias("held_out"), language("text").alias("l"))
    return rows.select("doc_id", "held_out", "l.*")


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that have a language: null texts and those without a letter go.

    All columns stay. A model without languages, from which nothing can be predicted, rejects the
    same rows.
    """
    if not model.langs:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.scores))

    @F.pandas_udf("string")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(predict(Model(*shared.value), texts.tolist())[0])

    return docs.where(language("text") != UNKNOWN)
