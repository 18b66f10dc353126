"""Odd tables: clashing names, repeated ids, very long texts; what is left in the shared folder."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from curbflow.llm import common, language, near_duplicates, packing, quality_model, quality_rules, toxicity

CLASHES = "doc_id long, text string, Toxic_Score string, offending int, lang_pred int, LANG_SCORE string, quality_score int, kept string, posterior int, n_votes int, fp string, label string, component string, row int, n int, place int, piece int, length string, score double, n_words int"


@pytest.fixture(scope="module")
def clashing(spark):
    texts = [None, "", "one two three four five", "one two three four five", "eins zwei drei vier fünf sechs"]
    return spark.createDataFrame([(i, t, "s", 1, 2, "t", 3, "u", 4, 5, "v", "w", "x", 6, 7, 8, 9, "y", 0.5, 10) for i, t in enumerate(texts)], CLASHES)


def test_clashing_names(clashing, spark):
    names, train = clashing.columns, spark.createDataFrame([("en", "one two three"), ("de", "eins zwei drei")], "lang string, text string")
    rows = toxicity.toxicity(clashing, (-5.0, {b"two": 9.0})).collect()
    assert [r.doc_id for r in rows if r.toxic_score > 0.5] == [2, 3] and "Toxic_Score" not in rows[0].asDict()
    assert {r.doc_id: r.lang_pred for r in language.identify(clashing, train).collect()} == {0: "und", 1: "und", 2: "en", 3: "en", 4: "de"}
    assert quality_model.quality(clashing).count() == 5
    for own in (toxicity.keep_clean(clashing, spark.createDataFrame([], "doc_id long, toxic int")), language.keep_identified(clashing, train), near_duplicates.keep_first(clashing)):
        assert own.columns == names
        assert all(r["Toxic_Score"] == "s" and r["LANG_SCORE"] == "t" and r["row"] == 6 for r in own.collect())
    assert sorted(r.doc_id for r in near_duplicates.keep_first(clashing).collect()) == [0, 2, 4]
    assert quality_rules.quality_rules(clashing).count() == packing.pack(clashing).select("doc_id").distinct().count() == 5


def test_repeated_ids_in_several_groups(spark):
    a, b, c = "alpha beta gamma delta", "one two three four", "rot grün blau gelb"
    rows = [(1, a, 1), (1, b, 2), (2, b, 3), (3, a, 4), (3, c, 5), (1, a, 0), (None, a, 6), (None, "quite alone here", 8), (None, "quite alone here", 7)]
    kept = near_duplicates.keep_first(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()
    assert sorted((r.doc_id or 0, r.text, r.n) for r in kept) == [(0, "quite alone here", 7), (1, a, 0), (1, b, 2), (3, c, 5)]


def test_batches_are_bounded_by_bytes(spark):
    rows = spark.range(0, 64, 1, 1).select(F.lit(None).cast("long").alias("doc_id"), F.expr("repeat('word ', 400000)").alias("text"))
    sizes = common.prepare(spark) and rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches), "n long").collect()
    assert len(sizes) >= 8 and max(r.n for r in sizes) <= 2 * common.BATCH_BYTES
    assert {r.n_words for r in quality_rules.quality_rules(rows.limit(3)).collect()} == {400_000}


def test_fitting_texts(spark):
    docs = spark.createDataFrame([(i, "x" * (10 * i)) for i in range(30)] + [(5, "a"), (50, None), (None, "y")], "doc_id long, text string")
    few = docs.groupBy("doc_id").agg(F.max(F.octet_length("text")).alias("n_bytes"), F.lit(1).alias("mark"))
    rows = common.fitting_texts(docs, few, 1000)
    assert 500 < sum(len(r.text) for r in rows) <= 1000 and all(r.mark == 1 for r in rows) and [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    assert common.fitting_texts(docs, few, 250)[-1].doc_id <= 25 and common.fitting_texts(docs, few.limit(0), 1000) == []
    assert {r.doc_id: r.text for r in common.fitting_texts(docs, few, 10**6)}[5] == "a"


def test_stores_are_closed(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i} and more {i // 2}") for i in range(20)], "doc_id long, text string")
    with common.closing_others():
        assert near_duplicates.keep_first(docs).count() and common.Store.open_stores
        folders = [s.folder.removeprefix("file://") for s in common.Store.open_stores]
    import os

    assert folders and not any(map(os.path.exists, folders[-1:]))
    store = common.Store(spark)
    table = store.put(docs)
    assert common.sweep(spark) == 0 and table.count() == 20
    store.drop(table)
    store.close()
