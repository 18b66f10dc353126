"""Quality classifier from weak labels.

Heuristic labellers each vote good, bad or nothing on a text. Expectation-maximisation over all documents estimates, for
either class, how often each labeller votes which way, without any given labels; that turns a pattern of votes into a
posterior. The posteriors of a bounded sample train a linear scorer over hashed words and word shapes, which then judges
every document, also where labellers abstain.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from curbflow.llm.common import Store, annotate, binary, few_by_hash, fitting_texts, prepare, slices, table

#: Votes.
NONE, BAD, GOOD = 0, 1, 2
#: Bounds of the sample that the scorer is fitted on: documents, and bytes of all their texts.
FIT_DOCS, FIT_BYTES = 4000, 12 << 20
PLACES = 1 << 18
EM_ROUNDS, FIT_ROUNDS, RATE, DECAY = 60, 80, 0.3, 1e-6
#: Share of good documents that EM starts from.
PRIOR = 0.85
THRESHOLD = 0.5

_SHAPE = bytes(ord("X") if 65 <= i <= 90 else ord("x") if 97 <= i <= 122 or i >= 128 else ord("9") if 48 <= i <= 57 else i for i in range(256))
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_SYMBOLS = b"#*$%&|<>{}[]=~^_\\+@"
_RUN = re.compile(rb"[^A-Za-z0-9\x80-\xff\s]{2,}(?=\s|$)")


def vote(value: float, bad_low: float, good_low: float, good_high: float, bad_high: float) -> int:
    """Bad outside the outer limits, good inside the inner ones, nothing in between."""
    if value < bad_low or value > bad_high:
        return BAD
    return GOOD if good_low <= value <= good_high else NONE


def votes(text: bytes, packer: zstandard.ZstdCompressor) -> list[int]:
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [BAD] + [NONE] * 8
    upper, lower = (size - len(text.translate(None, x)) for x in (_UPPER, _LOWER))
    symbols = size - len(text.translate(None, _SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    bare = sum(1 for w in words if not re.search(rb"[A-Za-z0-9\x80-\xff]", w)) if symbols else 0
    few = n < 20
    return [
        vote(n, 1, 20, 1e12, 1e12),
        vote(symbols / n, 0, 0, 0.05, 0.25),
        vote(upper / max(1, upper + lower), 0, 0, 0.15, 0.40),
        vote(bare / n, 0, 0, 0.02, 0.15),
        NONE if size < 256 else vote(len(packer.compress(text)) / size, 0.22, 0.33, 0.75, 0.95),
        NONE if len(lines) < 4 else vote(1 - len(set(lines)) / len(lines), 0, 0, 0.1, 0.4),
        vote((size - n) / n, 2.0, 3.0, 9.0, 14.0),
        vote(len(_RUN.findall(text)) / n, 0, 0, 0.05, 0.2),
        NONE if few else vote(sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, 0, 0, 0.05, 0.2),
    ]


LABELLERS = 9


def pattern(own: list[int]) -> int:
    """The votes as digits to base three."""
    code = 0
    for v in own:
        code = 3 * code + v
    return code


def digits(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // 3 ** np.arange(LABELLERS - 1, -1, -1) % 3


def cast_votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=1)
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = [t or b"" for t in binary(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([pattern(votes(t, packer)) for t in texts], pa.int64())], ["doc_id", "n_bytes", "pattern"])


def estimate(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray]:
    """EM over vote patterns: share of good documents, and chances[class, labeller, vote] (classes: bad, good)."""
    own = digits(patterns)
    # An abstention says which kind of text it is, not how good: only votes cast count, with chance one for none.
    # A bad document has few of the faults that are looked for; a good one hardly any.
    chances = np.stack([np.array([[1.0, 0.25, 0.75]] * LABELLERS), np.array([[1.0, 0.01, 0.99]] * LABELLERS)])
    share = PRIOR
    for _ in range(EM_ROUNDS):
        weight = posterior(patterns, share, chances) * counts
        both = np.stack([counts - weight, weight])
        share = float(weight.sum() / max(1, counts.sum()))
        share = min(0.999, max(0.001, share))
        for k in range(LABELLERS):
            cast = np.stack([np.bincount(own[:, k], weights=w, minlength=3)[1:] for w in both]) + 1.0
            chances[:, k, 1:] = cast / cast.sum(axis=1, keepdims=True)
    return share, chances


def posterior(patterns: np.ndarray, share: float, chances: np.ndarray) -> np.ndarray:
    """Chance that a document with these votes is good."""
    own = digits(patterns)
    log = np.log(np.array([1 - share, share])) + np.log(chances[:, np.arange(LABELLERS), own]).sum(axis=2).T
    return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def places(text: bytes) -> np.ndarray:
    """Hashed places of the words, of the last three marks of their shapes, and of repeats of the word before."""
    words = text.split()
    shapes = [s[-3:] for s in text.translate(_SHAPE).split()]
    again = [b"\x01"] * sum(a == b for a, b in zip(words, words[1:], strict=False))
    found = np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)), np.fromiter(map(zlib.crc32, shapes + again), dtype=np.int64, count=len(shapes) + len(again))
    return np.concatenate([found[0] % (PLACES // 2), PLACES // 2 + found[1] % (PLACES // 2)])


def fit(texts: list[bytes], target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer of mean-pooled places, by full-batch Adam on soft labels, classes balanced."""
    own = [places(t) for t in texts]
    size = np.array([len(x) for x in own], dtype=np.int64)
    of = np.concatenate([np.empty(0, dtype=np.int64), *own])
    doc = np.repeat(np.arange(len(own)), size)
    scale = 1 / np.maximum(1, size)
    theta, first, second = (np.zeros(PLACES + 1) for _ in range(3))
    balance = np.where(target > 0.5, 0.5 / max(1e-9, (target > 0.5).mean()), 0.5 / max(1e-9, (target <= 0.5).mean())) if len(target) else target
    for step in range(1, FIT_ROUNDS + 1 if len(own) else 1):
        z = theta[-1] + 8 * scale * np.bincount(doc, weights=theta[of], minlength=len(own))
        slope = balance * (1 / (1 + np.exp(-z)) - target) / len(own)
        grad = np.append(np.bincount(of, weights=(8 * scale * slope)[doc], minlength=PLACES), slope.sum())
        grad[:-1] += DECAY * theta[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.99 * second + 0.01 * grad**2
        theta -= RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-4)
    return theta[:-1].astype(np.float32), float(theta[-1])


def quality(docs: DataFrame, passed: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those passed) with quality_score (0 to 1), posterior, n_votes and kept.

    Votes are counted over all documents, of which there are at most 3^9 patterns; the scorer is fitted on a bounded
    sample by hash of the id. kept: a score of one half or more. Null, empty and blank texts get a bad vote, no features
    and are not kept. Texts are read whole, repeated rows judged alike; an empty table gives no rows. Columns of docs
    called like the new ones give way.
    """
    store = Store(prepare(docs.sparkSession))
    kind = docs.schema["doc_id"].dataType.simpleString()
    cast = store.put(docs.select("doc_id", "text").mapInArrow(cast_votes, f"doc_id {kind}, n_bytes long, pattern long"))
    rows = cast.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    share, chances = estimate(np.array([r["pattern"] for r in rows], dtype=np.int64), np.array([r["n"] for r in rows], dtype=float))
    sizes = cast.filter("doc_id IS NOT NULL AND n_bytes > 0").groupBy("doc_id").agg(F.max("n_bytes").alias("n_bytes"))
    sample = sorted(r["text"].encode() for r in fitting_texts(docs, few_by_hash(sizes, FIT_DOCS), FIT_BYTES))
    store.close()
    packer = zstandard.ZstdCompressor(level=1)
    target = posterior(np.array([pattern(votes(t, packer)) for t in sample], dtype=np.int64), share, chances) if sample else np.empty(0)
    weights, bias = fit(sample, target)

    def score(texts: list[bytes | None]) -> list:
        own = [t or b"" for t in texts]
        packer = zstandard.ZstdCompressor(level=1)
        cast = [votes(t, packer) for t in own]
        z = np.array([bias + 8 * float(weights[p].mean()) if len(p := places(t)) else -30.0 for t in own])
        scores = 1 / (1 + np.exp(-z))
        return [scores, posterior(np.array([pattern(v) for v in cast], dtype=np.int64), share, chances), [sum(x != NONE for x in v) for v in cast], scores >= THRESHOLD]

    return annotate(docs, score, "quality_score double, posterior double, n_votes long, kept boolean", passed)


def op6_quality(spark, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"), ["doc_id", "text"])
    return found.select("doc_id", F.col("quality_score").alias("score"), "posterior", "n_votes", "kept")
