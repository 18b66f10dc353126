"""Quality rules: counts of words, symbols, lines and repeated word windows, and compression bands.

Zstandard's compressed share of a text is small where it repeats itself and near or above one where it is random. Both
the whole text and fixed chunks of it must lie within a band whose limits depend on the length, since short texts
compress badly whatever they say.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame

from curbflow.llm.common import binary, slices, table

SYMBOLS = b"#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
LEVEL = 3
CHUNK_BYTES = 4096
#: A last chunk below this is judged with the whole text only.
MIN_CHUNK_BYTES = 1024
#: Bytes from which a band holds, lowest share, highest share: of whole texts, and of chunks.
WHOLE_BANDS = ((0, 0.0, 9.0), (256, 0.25, 0.95), (512, 0.22, 0.85), (1024, 0.20, 0.75), (4096, 0.17, 0.70), (16384, 0.15, 0.68))
CHUNK_BANDS = ((1024, 0.15, 0.80), (4096, 0.15, 0.75))
#: Share of chunks outside their band above which a text is rejected.
MAX_BAD_CHUNKS = 0.25

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunks double"
_ODD = np.uint64(0x9E3779B97F4A7C15)


def band(n: int, bands: tuple) -> tuple[float, float]:
    low, high = 0.0, 9.0
    for least, a, b in bands:
        if n >= least:
            low, high = a, b
    return low, high


def compression(text: bytes, packer: zstandard.ZstdCompressor) -> tuple[float, float, bool]:
    """Whole ratio, share of chunks outside their band, and whether both lie within the limits. Empty: (1, 0, True)."""
    if not text:
        return 1.0, 0.0, True
    ratio = len(packer.compress(text)) / len(text)
    low, high = band(len(text), WHOLE_BANDS)
    bad = judged = 0
    for at in range(0, len(text), CHUNK_BYTES):
        chunk = text[at : at + CHUNK_BYTES]
        if len(chunk) >= MIN_CHUNK_BYTES:
            a, b = band(len(chunk), CHUNK_BANDS)
            judged += 1
            bad += not a <= len(packer.compress(chunk)) / len(chunk) <= b
    share = bad / judged if judged else 0.0
    return ratio, share, low <= ratio <= high and share <= MAX_BAD_CHUNKS


def repeated_words(words: list[list[bytes]]) -> np.ndarray:
    """For each text, its words that lie in a window of eight words found twice or more in that text."""
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    total = int(counts.sum())
    out = np.zeros(len(words), dtype=np.int64)
    if total < WINDOW:
        return out
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter((digest(w) for text in words for w in text), dtype=np.uint64, count=total)
    key = np.zeros(total - WINDOW + 1, dtype=np.uint64)
    for k in range(WINDOW):
        key = key * _ODD + h[k : total - WINDOW + 1 + k]
    ends = np.cumsum(counts)
    text = np.repeat(np.arange(len(words)), counts)
    inside = np.arange(len(key)) + WINDOW <= ends[text[: len(key)]]
    at = np.flatnonzero(inside)
    if not len(at):
        return out
    key = key[at]
    key ^= key >> np.uint64(29)
    key = (key + text[at].astype(np.uint64)) * _ODD
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(total + 1, dtype=np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(step[:-1]) > 0)])
    return covered[ends] - covered[ends - counts]


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=LEVEL)
    for whole in batches:
        for batch in slices(whole, "text"):
            texts = [t or b"" for t in binary(batch.column("text"))]
            points = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_pylist()
            words = [t.split() for t in texts]  # bytes: splits on the six ASCII blanks only
            repeats = repeated_words(words).tolist()
            rows = []
            for text, n_points, own, repeat in zip(texts, points, words, repeats, strict=True):
                lines = [x for x in text.split(b"\n") if x.strip()]
                failed = len(own) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(own)
                ratio, bad, good = compression(text, packer)
                rows.append((len(own), n_points - len(text) + sum(map(len, own)), len(text) - len(text.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeat, failed, good and not failed, ratio, bad))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunks"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], ["doc_id", *names])


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base_failed, kept, the whole ratio and the share of bad chunks.

    Null and empty texts have no words and fail the base rule. Texts are read whole, whatever their length. Repeated
    rows are judged alike. Other columns of the input are not read. An empty table gives no rows.
    """
    return docs.select("doc_id", "text").mapInArrow(judge, SCHEMA)


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
