"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's chance of being toxic is a logistic function of its words; a document's is the noisy-or of its sentences,
one minus the product of their chances of being clean. Maximising the likelihood of the document labels teaches the
word weights which sentences are to blame, and scoring returns them.
"""

from __future__ import annotations

from array import array
from math import exp, log1p

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import annotate, columns, few_by_hash, fitting_texts, prepare, remainder, table, unused

#: Bounds of the sample of labelled documents that the weights are fitted on: documents, and bytes of all their texts.
FIT_DOCS, FIT_BYTES = 6000, 16 << 20
#: A word counts as itself and as its first bytes of these lengths, which inflected forms share.
STEMS = (3, 4, 5, 6, 7, 8)
#: Documents of the sample that must hold a feature for it to get a weight, and features at most: those that tell the labels apart best.
MIN_DOCS, MAX_FEATURES = 5, 4000
#: Words whose weight a task remembers at a time.
REMEMBERED = 150_000
#: Documents whose features are counted at a time.
COUNTED = 500
ROUNDS, RATE = 150, 0.1
#: Pull of every word weight towards zero, which leaves most at zero: words that only happen to be near the others.
SPARSITY = 2e-4
START_BIAS = -6.0
#: What a toxic document counts against a clean one, of which there are several times as many.
TOXIC_WEIGHT = 3.0
THRESHOLD = 0.5

#: Lower case; sentence ends to line feeds, other ASCII marks and blanks to spaces. Lengths stay as they are.
_CLEAN = bytes(
    10 if chr(i) in ".!?\n\r" else i if i >= 128 or chr(i).isalnum() or chr(i) == "'" else 32 for i in range(256)
).translate(bytes(i + 32 if 65 <= i <= 90 else i for i in range(256)))

Model = tuple[float, dict[bytes, float]]


def sentences(text: bytes | None) -> list[bytes]:
    """Sentences, blank ones too, so that their places in the text can be summed up."""
    return (text or b"").translate(_CLEAN).split(b"\n")


def features(word: bytes) -> list[bytes]:
    """The word, and its stems marked by a trailing star (which no word holds)."""
    return [word, *[word[:n] + b"*" for n in STEMS if n <= len(word)]]


def telling(seen: np.ndarray, bad: np.ndarray, names: list[bytes], n: int, positive: int) -> list[int]:
    """The features that tell toxic from clean documents best, by the chi-squared statistic.

    seen, bad: documents, and toxic ones, that hold each feature.
    """
    if not 0 < positive < n:
        return []
    expected = seen * positive / n
    statistic = (bad - expected) ** 2 / (expected * (1 - positive / n) + 1e-9)
    return sorted(np.flatnonzero(seen >= MIN_DOCS).tolist(), key=lambda f: (-statistic[f], names[f]))[:MAX_FEATURES]


def fit(texts: list[bytes], toxic: list[int]) -> Model:
    """Bias and feature weights by full-batch Adam on the noisy-or likelihood, with a proximal step for sparsity.

    Without rows: the start bias alone. Words and features are numbered, and counted in arrays, some documents at a time.
    """
    number: dict[bytes, int] = {}
    flat, sizes, owner = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        for s in [set(s.split()) for s in sentences(text) if s.strip()] or [set()]:
            flat.extend(number.setdefault(w, len(number)) for w in s)
            sizes.append(len(s))
            owner.append(d)
    if not owner:
        return START_BIAS, {}
    flat, owner, y = np.array(flat, dtype=np.int64), np.array(owner, dtype=np.int64), np.array(toxic, dtype=float)
    at = np.repeat(np.arange(len(owner)), np.array(sizes))
    names: dict[bytes, int] = {}
    listed, starts = array("i"), [0]  # the features of every word
    for word in number:
        listed.extend(names.setdefault(f, len(names)) for f in features(word))
        starts.append(len(listed))
    listed, starts = np.array(listed, dtype=np.int64), np.array(starts)

    def spread(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The features of these words, and the place of each one's word."""
        count = starts[words + 1] - starts[words]
        place = np.repeat(np.arange(len(words)), count)
        first = np.repeat(starts[words] - np.concatenate([[0], np.cumsum(count)[:-1]]), count)
        return listed[np.arange(len(place)) + first], place

    seen, bad = np.zeros(len(names)), np.zeros(len(names))
    edges = np.searchsorted(owner[at], np.arange(0, len(texts) + COUNTED, COUNTED))
    for low, high in zip(edges, edges[1:], strict=False):
        feature, place = spread(flat[low:high])
        doc, feature = np.divmod(np.unique(owner[at[low:high]][place] * len(names) + feature), len(names))
        seen += np.bincount(feature, minlength=len(names))
        bad += np.bincount(feature, weights=y[doc], minlength=len(names))
    texts_of = list(names)
    chosen = telling(seen, bad, texts_of, len(texts), int((y > 0).sum()))
    words = [texts_of[f] for f in chosen]
    slot = np.full(len(names), -1)
    slot[chosen] = np.arange(len(chosen))
    useful = np.zeros(len(number), dtype=bool)
    useful[np.repeat(np.arange(len(number)), np.diff(starts))[slot[listed] >= 0]] = True
    kept = np.flatnonzero(useful[flat])
    feature, place = spread(flat[kept])
    of, at = slot[feature], at[kept][place]
    of, at = of[of >= 0], at[of >= 0]
    docs = range(len(texts))
    theta = np.zeros(len(words) + 1)
    theta[-1] = START_BIAS
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, ROUNDS + 1):
        z = theta[-1] + np.bincount(at, weights=theta[of], minlength=len(owner))
        p = 1 / (1 + np.exp(-z))
        clean = np.bincount(owner, weights=np.logaddexp(0, z), minlength=len(docs))  # minus log of the chance of a clean document
        chance = np.maximum(-np.expm1(-clean), 1e-12)
        pull = np.where(y > 0, -TOXIC_WEIGHT * (1 - chance) / chance, 1.0)
        slope = p * pull[owner] / len(docs)
        grad = np.append(np.bincount(of, weights=slope[at], minlength=len(words)), slope.sum())
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        pace = RATE / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        theta -= pace * first / (1 - 0.9**step)
        theta[:-1] = np.sign(theta[:-1]) * np.maximum(np.abs(theta[:-1]) - pace[:-1] * SPARSITY, 0)
    return float(theta[-1]), {w: float(t) for w, t in zip(words, theta, strict=False) if abs(t) > 1e-3}


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits on a bounded sample of docs that have a label (doc_id, toxic); a repeated label counts as its smallest."""
    named = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("toxic").alias("toxic"))
    # Only as many labelled ids as are wanted are looked up; of those, all sizes are known before any text is fetched.
    wanted = F.broadcast(few_by_hash(named, FIT_DOCS))
    sizes = docs.select("doc_id", F.octet_length("text").alias("n_bytes")).join(wanted, "doc_id").groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"), F.min("toxic").alias("toxic"))
    rows = fitting_texts(docs, sizes, FIT_BYTES)
    return fit([r["text"].encode() for r in rows], [r["toxic"] for r in rows])


def scorer(model: Model):
    """Texts -> document scores and the offending sentences (start and length in code points, score)."""
    bias, weights = model
    base = np.logaddexp(0, bias)
    remembered: dict[bytes, float] = {}

    def weight(word: bytes) -> float:
        if len(remembered) >= REMEMBERED:
            remembered.clear()
        remembered[word] = found = sum(weights.get(f, 0.0) for f in features(word))
        return found

    def score(texts: list[bytes | None]) -> list[list]:
        scores, blamed = [], []
        for text in texts:
            clean, at, found = 0.0, 0, []
            for s in sentences(text):
                if words := set(s.split()):
                    z = bias
                    for word in words:
                        known = remembered.get(word)
                        z += weight(word) if known is None else known
                    clean += z + log1p(exp(-z)) if z > 0 else log1p(exp(z))
                    if z >= 0:
                        start, length = (len(x.decode("utf-8", "replace")) for x in (text[:at], text[at : at + len(s)]))
                        found.append({"start": start, "length": length, "score": 1 / (1 + exp(-z))})
                at += len(s) + 1
            scores.append(float(-np.expm1(-(clean or base))))
            blamed.append(found)
        return [scores, blamed]

    return score


def toxicity(docs: DataFrame, model: Model, passed: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those passed) with toxic_score and offending array<struct<start, length, score>>.

    Null, empty and blank texts count as one sentence without words. Texts are read whole; repeated rows score alike;
    an empty table gives no rows. Other columns pass through, but for those called toxic_score or offending.
    """
    return annotate(docs, scorer(model), "toxic_score double, offending array<struct<start: long, length: long, score: double>>", passed)


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(remainder("doc_id", 5) != 0))
    found = toxicity(docs, model, ["doc_id", "text"])
    score = F.col("toxic_score")
    return found.select(
        "doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"), F.get("offending", F.lit(0))["start"].alias("first_start"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows whose text scores below the threshold, by a model of the labels outside the held-out fold.

    Columns of docs stay as they are, whatever their names. Null, empty and blank texts stay; without labels all rows do.
    """
    prepare(docs.sparkSession)
    judge, score = scorer(train(docs, labels.filter(remainder("doc_id", 5) != 0))), unused(docs, "toxic_score")
    found = annotate(docs, lambda texts: judge(texts)[:1], f"{score} double")
    return found.filter(F.col(score) < THRESHOLD).select(columns(docs.columns))
