"""Language identification by rank-order profiles.

A profile is a language's most frequent character n-grams in order of frequency. A document's own ranking is compared
with each profile: every n-gram adds the distance between its two places, and a fixed maximum where the profile lacks
it. The language of the smallest sum is predicted. n-grams are hashed to 2^16 places, letters only, with a mark at
either end of a word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from curbflow.llm.common import annotate, binary, columns, remainder, slices, table, unused

ORDERS = (1, 2, 3, 4)
PLACES = 1 << 16
#: n-grams of a profile, and of a document's ranking.
PROFILE = 400
#: Languages counted in a task before the counts are passed on.
HELD = 64
UNKNOWN = "und"
#: Score under which the filter takes a text for no learned language.
MIN_SCORE = 0.10
_ODD = np.uint32(0x9E3779B1)


@cache
def letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str) -> np.ndarray:
    """Places of the n-grams of all orders; a word's ends count as a character, its inside holds letters only."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[points]
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    before = np.concatenate([[False], letter[:-1]])
    line = np.where(letter, points, 0)[letter | before]  # runs of other characters shrink to one mark
    line = np.concatenate([[0], line, [0]]).astype(np.uint32)
    inside = line > 0
    found = []
    for n in ORDERS:
        last = len(line) - n + 1
        if last <= 0:
            break
        good = inside[:last].copy() if n == 1 else np.ones(last, dtype=bool)
        code = np.full(last, n, dtype=np.uint32)
        for k in range(n):
            code = code * _ODD + line[k : last + k]
            if 0 < k < n - 1:
                good &= inside[k : last + k]
        if n == 2:
            good &= inside[:last] | inside[1 : last + 1]
        code ^= code >> np.uint32(15)
        found.append((code * _ODD >> np.uint32(16))[good])
    return np.concatenate(found).astype(np.int64)


def ranking(places: np.ndarray, most: int = PROFILE) -> np.ndarray:
    """The most frequent places, most frequent first; ties by place."""
    if len(places) < PLACES // 16:
        own, counts = np.unique(places, return_counts=True)
    else:
        counts = np.bincount(places, minlength=PLACES)
        own = np.flatnonzero(counts)
        counts = counts[own]
    key = counts.astype(np.int64) * PLACES + (PLACES - 1 - own)
    if len(key) > most:
        key = np.partition(key, len(key) - most)[-most:]
    return PLACES - 1 - np.sort(key)[::-1] % PLACES


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-gram counts of each language: one row for each language and place of a task."""
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], ["lang", "place", "n"])
        held.clear()

    for whole in batches:
        for batch in slices(whole, "text"):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                counts = held.setdefault(lang, np.zeros(PLACES, dtype=np.int64))
                counts += np.bincount(ngrams(text or ""), minlength=PLACES)
            if len(held) > HELD:
                yield from out()
    yield from out()


def learn(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles from all rows of docs (lang, text) with a lang: language -> places in order of frequency."""
    counts = docs.filter(F.col("lang").isNotNull()).select("lang", "text").mapInArrow(count, "lang string, place long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "place")
    top = counts.groupBy("lang", "place").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= PROFILE)
    profiles: dict[str, list[int]] = {}
    for row in top.orderBy("lang", "rank").collect():  # PROFILE rows for each language
        profiles.setdefault(row["lang"], []).append(row["place"])
    return profiles


def predictor(profiles: dict[str, list[int]]):
    names = sorted(profiles)
    ranks = np.full((len(names), PLACES), PROFILE, dtype=np.int32)
    for row, name in zip(ranks, names, strict=True):
        row[profiles[name]] = np.arange(len(profiles[name]))

    def predict(texts: list[bytes | None]) -> list[list]:
        langs, scores = [], []
        for text in texts:
            own = ngrams((text or b"").decode("utf-8", "replace"))
            if not len(own) or not names:
                langs.append(UNKNOWN)
                scores.append(0.0)
                continue
            order = ranking(own)
            apart = np.abs(ranks[:, order] - np.arange(len(order))).sum(axis=1)
            best = int(apart.argmin())
            langs.append(names[best])
            scores.append(max(0.0, 1.0 - float(apart[best]) / (PROFILE * len(order))))
        return [langs, scores]

    return predict


def identify(docs: DataFrame, train: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those passed) with lang_pred and lang_score (0 to 1: one less the mean distance).

    train: the rows (lang, text) to learn from. Null texts and texts without a letter are `und` with score 0, and so is
    every text if nothing can be learned. Ties go to the first language in the alphabet. Very long texts are read whole.
    Repeated rows are predicted alike; an empty table gives no rows. Columns of docs called like the new ones give way.
    """
    return annotate(docs, predictor(learn(train)), "lang_pred string, lang_score double", passed)


def op7_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, docs.filter(remainder("doc_id", 3) != 1), ["doc_id", "text"])
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def keep_identified(docs: DataFrame, train: DataFrame) -> DataFrame:
    """Rows whose text is in one of the learned languages: not `und`, and near enough to the profile.

    Columns of docs stay as they are, whatever their names. Null texts and texts without a letter go.
    """
    lang, score = unused(docs, "lang_pred"), unused(docs, "lang_score")
    found = annotate(docs, predictor(learn(train)), f"{lang} string, {score} double")
    return found.filter((F.col(lang) != UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(columns(docs.columns))
