"""Language identification of mixed texts by expectation-maximisation.

A model is a table of n-gram counts per language. A document is taken as drawn
from a mixture of languages: expectation-maximisation estimates the proportions
from the n-gram likelihoods, and languages join the set, the likeliest first,
only while the likelihood gains more than a penalty per language.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import per_process, text_of

UNDETERMINED = "und"
BUCKETS = 1 << 15


@dataclass(frozen=True)
class Settings:
    """``smoothing`` n-grams are added to each bucket of a language; a language must gain
    ``penalty`` * ln(n-grams) / 2 in log-likelihood and hold ``least_share`` of the text."""
    order: int = 3
    buckets: int = BUCKETS
    smoothing: float = 0.5
    penalty: float = 8.0
    least_share: float = 0.03
    rounds: int = 30
    tolerance: float = 1e-4


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: whether it is a letter, and its lower case (one code point)."""
    points = range(0x110000)
    letter = np.fromiter((chr(p).isalpha() for p in points), dtype=bool, count=0x110000)
    lower = np.arange(0x110000, dtype=np.uint32)
    for p in np.flatnonzero(letter):
        small = chr(p).lower()
        if len(small) == 1:
            lower[p] = ord(small)
    return letter, lower


def grams(text: str, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram buckets of a whole text and their counts; words have blank edges."""
    letter, lower = per_process(("letters",), _letters)
    points = np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)
    is_letter = letter[points]
    if not is_letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    spaced = np.concatenate([[0], np.where(is_letter, lower[points], 0), [0]]).astype(np.uint64)
    spaced = spaced[np.concatenate([[True], (spaced[1:] != 0) | (spaced[:-1] != 0)])]  # one blank between words
    with np.errstate(over="ignore"):
        code = np.zeros(len(spaced) - settings.order + 1, dtype=np.uint64)
        for i in range(settings.order):
            code = code * np.uint64(0x9E3779B97F4A7C15) + spaced[i:len(spaced) - settings.order + 1 + i]
        code ^= code >> np.uint64(31)
        code *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (code >> np.uint64(32)).astype(np.int64) % settings.buckets
    return np.unique(bucket, return_counts=True)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_likelihood: np.ndarray  # buckets x languages

    def mixture(self, bucket, count, chosen, settings: Settings) -> tuple[np.ndarray, float]:
        """Proportions of the ``chosen`` languages and the log-likelihood under them."""
        logs = self.log_likelihood[bucket][:, chosen]
        top = logs.max(axis=1, keepdims=True)
        likely, total = np.exp(logs - top), count.sum()
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(settings.rounds if len(chosen) > 1 else 0):
            weighted = likely * share
            new = (weighted / weighted.sum(axis=1, keepdims=True) * count[:, None]).sum(axis=0) / total
            done = np.abs(new - share).max() < settings.tolerance
            share = new
            if done:
                break
        return share, float((count * (np.log((likely * share).sum(axis=1)) + top[:, 0])).sum())

    def predict(self, text: str, settings: Settings) -> tuple[str, float, str]:
        """(likeliest language, its proportion, all chosen as "lang:share,...")."""
        bucket, count = grams(text, settings)
        if not len(bucket) or not self.languages:
            return UNDETERMINED, 0.0, ""
        order = np.argsort(-(count @ self.log_likelihood[bucket]), kind="stable")
        if len(order) > 1:  # after the single best, in the order of their share of the full mixture
            share, _ = self.mixture(bucket, count, np.arange(len(order)), settings)
            rest = [i for i in np.argsort(-share, kind="stable") if i != order[0]]
            order = np.array([order[0], *rest])
        cost = settings.penalty * np.log(count.sum() + 1) / 2
        chosen, share, best = order[:1], np.ones(1), self.mixture(bucket, count, order[:1], settings)[1]
        for size in range(2, len(order) + 1):
            new_share, value = self.mixture(bucket, count, order[:size], settings)
            if value - best <= cost or new_share[-1] < settings.least_share:
                break
            chosen, share, best = order[:size], new_share, value
        ranked = sorted(zip(-share, [self.languages[i] for i in chosen]))
        return ranked[0][1], float(min(-ranked[0][0], 1.0)), ",".join(f"{n}:{-s:.3f}" for s, n in ranked)


def gram_counts(docs: DataFrame, text: Column, lang: Column, settings: Settings = Settings()) -> DataFrame:
    """(lang, bucket, n) over all given documents; tasks add up before the shuffle."""
    def count(batches):
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch["text"], batch["lang"]):
                bucket, n = grams(text, settings)
                if lang not in totals:
                    totals[lang] = np.zeros(settings.buckets, dtype=np.int64)
                totals[lang][bucket] += n
        for lang, total in totals.items():
            seen = np.flatnonzero(total)
            yield pd.DataFrame({"lang": lang, "bucket": seen, "n": total[seen]})

    return (docs.select(text.alias("text"), lang.cast("string").alias("lang")).filter("lang is not null")
            .mapInPandas(count, "lang string, bucket long, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
          settings: Settings = Settings()) -> Model:
    """The model of all given labelled documents.

    It has at most ``buckets`` numbers per language however many documents
    there are, and is fetched in that form.
    """
    rows = gram_counts(docs, text_of(text_col), F.col(lang_col), settings).toPandas()
    languages = tuple(sorted(rows["lang"].unique()))
    table = np.full((settings.buckets, len(languages)), settings.smoothing)
    at = rows["lang"].map({name: i for i, name in enumerate(languages)}).to_numpy()
    if len(rows):
        np.add.at(table, (rows["bucket"].to_numpy(), at), rows["n"].to_numpy())
    return Model(languages, np.log(table / table.sum(axis=0, keepdims=True)) if languages else table)


def identified(text: Column, shared, settings: Settings = Settings()) -> Column:
    """Struct lang_pred, score, languages for a text column; ``shared`` is a broadcast Model."""
    @F.pandas_udf("struct<lang_pred: string, score: double, languages: string>")
    def identify(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t or "", settings) for t in texts],
                            columns=["lang_pred", "score", "languages"])

    return identify(text)


def held_out(id_col: str) -> Column:
    """Documents no model learns from: a quarter, by the checksum of the id as text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                      settings: Settings = Settings()) -> DataFrame:
    """Learn from the documents that are not held out, predict all.

    Returns id, held_out, lang_pred, score (the proportion of lang_pred) and all
    chosen languages. Null texts and texts without letters are ``und`` with
    score 0, as is everything if no document has a language. A null id is not
    held out. Equal shares go to the name that sorts first; other columns are
    not looked at; an empty table gives no rows. A text of any length counts whole, by at
    most ``buckets`` numbers.
    """
    model = docs.sparkSession.sparkContext.broadcast(
        train(docs.filter(~held_out(id_col)), text_col, lang_col, settings))
    return docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                       identified(text_of(text_col), model, settings).alias("found")
                       ).select(id_col, "held_out", "found.*")


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                    least: float = 0.3, settings: Settings = Settings()) -> DataFrame:
    """The documents with one main language (``least`` of the text), with all their columns.

    If no document to learn from has a language, nothing can be told apart and all with
    letters stay. Null texts and texts without letters go; repeated rows stay or go together;
    columns may have any names; an empty table stays empty.
    """
    learnt = train(docs.filter(~held_out(id_col)), text_col, lang_col, settings)
    if not learnt.languages:
        return docs.filter(text_of(text_col).rlike(r"\p{L}"))
    model = docs.sparkSession.sparkContext.broadcast(learnt)
    found = identified(text_of(text_col), model, settings)
    return docs.filter((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least))
