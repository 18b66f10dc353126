"""The corpus pipeline: toxic documents go, then those in no known language, then near copies; the rest is packed.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of docs, whatever their names. Null, empty and blank texts pass the first stage
and go in the second, where they are in no language; repeated rows are near copies of each other; an empty table stays
empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from curbflow.llm import language, near_duplicates, packing, toxicity
from curbflow.llm.common import Store, closing_others, remainder, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: drops documents whose score reaches one half."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: drops documents without a letter, or too far from every language learned from docs."""
    return language.keep_identified(docs, docs.filter(remainder("doc_id", 3) != 1))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: keeps the document with the smallest doc_id of each group of near duplicates."""
    return near_duplicates.keep_first(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: places of all pieces in sequences."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("language", drop_unidentified), ("near_duplicates", drop_near_copies), ("packing", pack)]

#: SQL can express neither the learned models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage has left in the shared folder goes once the next one's input is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        store = Store(spark)
        with closing_others(store):
            docs = store.put(stage(spark, docs, sf_dir))
        if before:
            before.close()
        before = store
    return STAGES[-1][1](spark, docs, sf_dir)
