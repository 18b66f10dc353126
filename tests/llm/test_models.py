"""The learned operators' queries against slow versions, their folds and schemas, and held-out accuracy; the pipeline by hand."""

import collections
import math
import re
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from conftest import DATA

from curbflow.llm import language, near_duplicates, packing, quality_model, toxicity
from curbflow.llm.common import remainder, table

LARGE = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


# 6 Quality


def slow_em(votes, rounds):
    """EM over documents one by one, each labeller's votes cast apart from the others' given the class."""
    share = quality_model.PRIOR
    bad = [{0: [1.0, 0.25, 0.75], 1: [1.0, 0.01, 0.99]} for _ in range(quality_model.LABELLERS)]

    def chance_good(own):
        good, poor = share, 1 - share
        for k, v in enumerate(own):
            good, poor = good * bad[k][1][v], poor * bad[k][0][v]
        return good / (good + poor)

    for _ in range(rounds):
        weights = [chance_good(own) for own in votes]
        share = min(0.999, max(0.001, sum(weights) / len(votes)))
        for k in range(quality_model.LABELLERS):
            for kind in (0, 1):
                cast = [1.0, 1.0]
                for own, w in zip(votes, weights):
                    if own[k]:
                        cast[own[k] - 1] += w if kind else 1 - w
                bad[k][kind] = [1.0, cast[0] / sum(cast), cast[1] / sum(cast)]
    return [chance_good(own) for own in votes]


def test_quality_query(spark):
    packer = zstandard.ZstdCompressor(level=1)
    texts = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    ids = sorted(texts)
    posteriors = dict(zip(ids, slow_em([quality_model.votes((texts[i] or "").encode(), packer) for i in ids], quality_model.EM_ROUNDS)))
    rows = {r.doc_id: r for r in quality_model.op6_quality(spark, DATA).collect()}
    assert sorted(rows) == ids
    for i in ids:
        assert rows[i].posterior == pytest.approx(posteriors[i], abs=1e-6)
        assert rows[i].n_votes == sum(v != quality_model.NONE for v in quality_model.votes((texts[i] or "").encode(), packer)) and rows[i].kept == (rows[i].score >= 0.5)
    # the scorer by hand, from the posteriors of the same sample
    sample = sorted(t.encode() for t in texts.values() if t)
    target = np.array([posteriors[i] for i in sorted((i for i in ids if texts[i]), key=lambda i: texts[i].encode())])
    weights, bias = quality_model.fit(sample, target)
    for i in ids:
        words = (texts[i] or "").encode().split()
        shapes = [s[-3:] for s in (texts[i] or "").encode().translate(quality_model._SHAPE).split()] + [b"\x01"] * sum(a == b for a, b in zip(words, words[1:]))
        half = quality_model.PLACES // 2
        own = [weights[zlib.crc32(w) % half] for w in words] + [weights[half + zlib.crc32(s) % half] for s in shapes]
        z = bias + 8 * sum(map(float, own)) / len(own) if own else -30.0
        assert rows[i].score == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-3)


def test_quality_accuracy(spark):
    labels = table(spark, LARGE, "labels")
    rows = quality_model.op6_quality(spark, LARGE).join(labels, "doc_id").collect()
    assert sum(r.kept == (r.quality == 1) for r in rows) >= 0.93 * len(rows) > 0


# 7 Language


def slow_language(texts, langs):
    """Profiles and distances with lists and dictionaries."""
    counts = collections.defaultdict(collections.Counter)
    for text, lang in zip(texts, langs):
        counts[lang].update(language.ngrams(text or "").tolist())
    most = lambda c: [p for p, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[: language.PROFILE]]
    profiles = {lang: {p: k for k, p in enumerate(most(c))} for lang, c in sorted(counts.items())}

    def predict(text):
        own = most(collections.Counter(language.ngrams(text or "").tolist()))
        if not own:
            return "und", 0.0
        apart = {lang: sum(abs(ranks.get(p, language.PROFILE) - k) for k, p in enumerate(own)) for lang, ranks in profiles.items()}
        best = min(sorted(apart), key=apart.__getitem__)
        return best, max(0.0, 1 - apart[best] / (language.PROFILE * len(own)))

    return predict


def test_language_query(spark):
    docs = {r.doc_id: r for r in table(spark, DATA, "documents").collect()}
    learned = [r for r in docs.values() if fold(r.doc_id, 3) != 1 and r.lang is not None]
    predict = slow_language([r.text for r in learned], [r.lang for r in learned])
    found = language.op7_language(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    rows = {r.doc_id: r for r in found.collect()}
    assert rows.keys() == docs.keys()
    for i, r in rows.items():
        lang, score = predict(docs[i].text)
        assert r.held_out == (fold(i, 3) == 1) and (r.lang_pred, r.score) == (lang, pytest.approx(score)) and 0 <= r.score <= 1


def test_language_held_out_accuracy(spark):
    rows = language.op7_language(spark, LARGE).filter("held_out").join(table(spark, LARGE, "documents").filter("lang IS NOT NULL"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows) > 0


def test_language_ties_go_to_the_first():
    profiles = {"b": [1, 2, 3], "a": [1, 2, 3]}
    assert language.predictor(profiles)([b"some text", b"123"])[0] == ["a", "und"]


# 8 Toxicity


def slow_toxicity(model, text):
    """Noisy-or of the sentences, one word at a time."""
    bias, weights = model
    clean, any_words = 1.0, False
    for sentence in re.split(r"[.!?\n\r]", "".join(c.lower() if c.isascii() else c for c in text or "")):
        words = set(re.sub(r"[\x00-\x7f]", lambda m: m[0] if m[0].isalnum() or m[0] == "'" else " ", sentence).encode().split())
        if words:
            any_words = True
            z = bias + sum(weights.get(f, 0.0) for w in words for f in [w, *[w[:n] + b"*" for n in toxicity.STEMS if n <= len(w)]])
            clean *= 1 - 1 / (1 + math.exp(-z))
    return 1 - clean if any_words else 1 / (1 + math.exp(-bias))


def test_toxicity_query(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    found = toxicity.op8_toxicity(spark, DATA)
    assert found.dtypes[:4] == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    rows, texts = {r.doc_id: r for r in found.collect()}, {r.doc_id: r.text for r in docs.collect()}
    assert rows.keys() == texts.keys()
    for i, r in rows.items():
        assert r.held_out == (fold(i, 5) == 0) and r.predicted == int(r.score >= 0.5)
        assert r.score == pytest.approx(slow_toxicity(model, texts[i]), abs=1e-9)
    # held-out labels are not looked at
    other = toxicity.train(docs, labels.withColumn("toxic", 1 - labels.toxic).filter(remainder("doc_id", 5) == 0))
    assert other != model


def test_toxicity_held_out_accuracy(spark):
    rows = toxicity.op8_toxicity(spark, LARGE).filter("held_out").join(table(spark, LARGE, "labels"), "doc_id").collect()
    toxic, clean = [r for r in rows if r.toxic == 1], [r for r in rows if r.toxic == 0]
    assert sum(r.predicted for r in toxic) >= 0.8 * len(toxic) > 0 and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_long_texts_take_part_in_fitting(spark):
    words = " ".join(f"plain{i % 90} and more" for i in range(4000))
    rows = [(i, f"{words} {'grubnot villain' if i % 4 == 0 else 'friend'}.") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(40)], "doc_id long, toxic int")
    assert len(rows[0][1]) > 60_000
    _, weights = toxicity.train(docs, labels)
    assert weights.get(b"grubnot", 0) > 0 or weights.get(b"grub*", 0) > 0


# Pipeline


def slow_print(text):
    words = [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_pipeline_by_hand(spark):
    import corpus_pipeline

    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, labels.filter(remainder("doc_id", 5) != 0))
    left = {i for i, r in rows.items() if slow_toxicity(model, r.text) < 0.5}
    learned = [rows[i] for i in left if fold(i, 3) != 1 and rows[i].lang is not None]
    predict = slow_language([r.text for r in learned], [r.lang for r in learned])
    left = {i for i in left if predict(rows[i].text)[0] != "und" and predict(rows[i].text)[1] >= language.MIN_SCORE}
    prints = {i: slow_print(rows[i].text) for i in left}
    groups, seen = [], set()
    for i in sorted(left):
        if i not in seen:
            stack, group = [i], {i}
            while stack:
                u = stack.pop()
                near = {v for v in left - group if (prints[u] ^ prints[v]).bit_count() <= near_duplicates.RADIUS}
                group |= near
                stack.extend(near)
            seen |= group
            groups.append(group)
    left = {min(g) for g in groups}
    found = corpus_pipeline.run(spark, DATA).collect()
    assert {r.doc_id for r in found} == left and len(left) > 0.5 * len(rows)
    tokens = packing.tokens(packing.vocabulary())
    pieces = collections.defaultdict(dict)
    for r in found:
        pieces[r.doc_id][r.piece] = r
    for i, own in pieces.items():
        ids = np.append(tokens.ids(rows[i].text or ""), packing.END_ID).astype("<u4")
        at = 0
        for k in sorted(own):
            assert own[k].start == at and own[k].ids_crc32 == zlib.crc32(ids[at : at + own[k].length].tobytes())
            at += own[k].length
        assert at == len(ids)
    toxic = {r.doc_id for r in labels.filter("toxic = 1").collect()}
    assert len(toxic & left) <= 0.2 * len(toxic)
