"""What the operators of this subpackage share: reading tables, writing intermediate results, Arrow batches."""

from __future__ import annotations

import atexit
import os
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

ROOT = str(Path(__file__).resolve().parents[2])
#: Rows and bytes of an Arrow batch; batches are cut again by bytes where texts are long.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20
#: Bytes of text that one vectorised step handles at a time.
SLICE_BYTES = 2 << 20


def prepare(spark: SparkSession) -> SparkSession:
    """Make Python workers find this package, run single-threaded and get bounded Arrow batches."""
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS"):
        env[name] = "1"
    # Workers serve task after task: memory that one has freed must go back to the system.
    env |= {"TOKENIZERS_PARALLELISM": "false", "ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": "1048576", "MALLOC_MMAP_THRESHOLD_": "262144"}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spark


#: How the folders of intermediate tables are called.
_FOLDER = "tables-"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; a temporary one where it is unset (local tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def _delete(spark: SparkSession, path: str) -> None:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(jsc.hadoopConfiguration()).delete(target, True)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    try:
        _delete(spark, path)
    except Exception:  # the session may have ended before the interpreter does
        return


class Store:
    """Intermediate tables, written once to the shared folder so that a lost executor costs no recomputation.

    Tables that no result reads are dropped as soon as they have served. Those that a returned DataFrame reads stay until
    close(), the end of a `closing_others` block around the call, or the end of the driver's interpreter; what a killed
    driver leaves is swept by `sweep`.
    """

    open_stores: ClassVar[list[Store]] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/{_FOLDER}{uuid.uuid4().hex}"
        atexit.register(_delete_at_exit, spark, self.folder)
        self.count = 0
        self.open_stores.append(self)

    def put(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.folder}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._curbflow_table = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        """Deletes tables that put() returned."""
        for table in tables:
            if table is not None:
                _delete(self.spark, table._curbflow_table)

    def close(self) -> None:
        _delete(self.spark, self.folder)
        self.open_stores.remove(self)


@contextmanager
def closing_others(*kept: Store) -> Iterator[None]:
    """On leaving, closes all stores that were opened inside, but for `kept`: for results that have been written."""
    before = list(Store.open_stores)
    try:
        yield
    finally:
        for store in [s for s in Store.open_stores if s not in before and s not in kept]:
            store.close()


def sweep(spark: SparkSession, hours: float = 72) -> int:
    """Deletes tables that drivers left in the shared folder longer ago than so many hours; how many."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(shared_folder(spark))
    system, swept = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), 0
    for status in system.listStatus(root):
        if status.getPath().getName().startswith(_FOLDER) and status.getModificationTime() < 1000 * (time.time() - 3600 * hours):
            swept += bool(system.delete(status.getPath(), True))
    return swept


def binary(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, null as None."""
    return column.cast(pa.large_binary()).to_pylist()


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows whose texts hold about `most` bytes; a longer text gets a run of its own."""
    lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths.tolist()):
        if held and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def remainder(column: str, n: int):
    """crc32 of the id as text, modulo n; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def unused(df: DataFrame, name: str) -> str:
    """The name, or a longer one that no column of df has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def columns(names) -> list:
    """Columns of these very names, whatever characters they hold."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def annotate(docs: DataFrame, score, added: str, passed: list[str] | None = None) -> DataFrame:
    """docs (all columns, or those passed) with columns computed from whole texts.

    score: list of UTF-8 texts (null as None) -> list of columns, in the order of the DDL string `added`. A column of docs
    that is called like an added one, in whatever case, gives way to it. Texts arrive in runs of about SLICE_BYTES.
    """
    new = StructType.fromDDL(added)
    replaced = {n.lower() for n in new.names}
    kept = docs.select(columns(c for c in passed or docs.columns if c.lower() not in replaced))
    if "text" not in kept.columns:
        raise ValueError("the text column must be passed")
    kinds = [to_arrow_type(f.dataType) for f in new.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                found = score(binary(batch.column("text")))
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], [*batch.schema.names, *new.names])

    return kept.mapInArrow(run, StructType([*kept.schema.fields, *new.fields]))


def few_by_hash(df: DataFrame, most: int) -> DataFrame:
    """At most `most` rows, those with the smallest hashes of doc_id: the same at every partitioning.

    A threshold that lets about half as many again through comes first, so that no task or driver sorts more than that.
    """
    total = df.count()
    share = min(1.0, (1.5 * most + 100) / max(1, total))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id"), 11) / F.lit(float(1 << 53))
    return df.withColumn("_unit", unit).filter(F.col("_unit") <= share).orderBy("_unit", "doc_id").limit(most).drop("_unit")


def fitting_texts(docs: DataFrame, few: DataFrame, most_bytes: int) -> list[Row]:
    """Whole texts (doc_id, text, other columns of few) of a bounded sample, for fitting a classifier on the driver.

    few: doc_id, n_bytes and what else is wanted, a bounded number of rows, one for each id. They are taken in order of
    the hashes of their ids, each that fits into what is left of most_bytes, whatever its length. Repeated ids of docs
    give their smallest text once. Rows come in order of their ids.
    """
    rows = few.filter(F.col("doc_id").isNotNull() & (F.col("n_bytes") <= most_bytes)).withColumn("_hash", F.xxhash64("doc_id")).collect()
    chosen, left = [], most_bytes
    for row in sorted(rows, key=lambda r: (r["_hash"], r["doc_id"])):
        if row["n_bytes"] <= left:
            chosen.append(row)
            left -= row["n_bytes"]
    if not chosen:
        return []
    ids = docs.sparkSession.createDataFrame([(r["doc_id"],) for r in chosen], StructType([docs.schema["doc_id"]]))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= most_bytes).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    by_id = {r["doc_id"]: r["text"] for r in texts.collect()}
    names = [c for c in few.columns if c not in ("doc_id", "n_bytes")]
    return [Row(doc_id=r["doc_id"], text=by_id[r["doc_id"]], **{c: r[c] for c in names}) for r in sorted(chosen, key=lambda r: r["doc_id"]) if r["doc_id"] in by_id]
