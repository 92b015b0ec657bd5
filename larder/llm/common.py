"""What the text operators share: reading documents, batching texts, a folder all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches()
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Spark's own switch: the shuffle files of a query go when the query ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes that a Python worker is sent at once, and Spark's own number of them.
BATCH_BYTES, MANY_BYTES, FEW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "2m"


def small_batches() -> None:
    """Batches for Python workers of 2 MB, or of one row that is longer, instead of 64 MB: several are alive at once on either side.

    Operators that send texts to Python call this when they are planned, since the setting counts when a query runs. A
    session whose owner has set another size keeps it; results do not depend on it.
    """
    spark = SparkSession.active()
    if spark.conf.get(BATCH_BYTES) == MANY_BYTES:
        spark.conf.set(BATCH_BYTES, FEW_BYTES)


def whole_row(df: DataFrame) -> Column:
    """All columns of a row as a struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def shared_folder(spark: SparkSession) -> str:
    """A fresh folder under spark.checkpoint.dir, which all executors see.

    Where that is unset, a local master may use a temporary folder; on a cluster nothing is shared then, so
    that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="larder-")
        spark.conf.set("spark.checkpoint.dir", base)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(base)
    folder = f"{base.rstrip('/')}/larder-{uuid.uuid4().hex}"
    _FOLDERS.append(folder)
    return folder


#: Folders of this process, in the order in which they were asked for.
_FOLDERS: list[str] = []


@contextmanager
def folders_of(spark: SparkSession) -> Iterator[None]:
    """Removes at its end the folders that were asked for within it: what a stage kept on its way to a written result."""
    begin = len(_FOLDERS)
    try:
        yield
    finally:
        for folder in _FOLDERS[begin:]:
            remove_folder(spark, folder)
        del _FOLDERS[begin:]


def written(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table once and read it back: the lineage ends in files that outlive any executor, so the shuffle
    files that led to it are removed as soon as it is there."""
    path = f"{folder}/{name}.parquet"
    spark = df.sparkSession
    with settings(spark, {SHUFFLE_CLEANUP: "true"}):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """Settings of the session for the time of a job; afterwards they are as they were."""
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Tables:
    """Written tables of one run, in a shared folder of its own."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = shared_folder(spark)
        self.names: dict[int, tuple[DataFrame, str]] = {}
        self.step = 0

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.step += 1
        name = f"{self.step:02d}-{name}"
        table = written(df, self.folder, name)
        self.names[id(table)] = (table, name)
        return table

    def drop(self, *tables: DataFrame | None) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            if id(table) in self.names:
                _, name = self.names.pop(id(table))
                remove_folder(self.spark, f"{self.folder}/{name}.parquet")

    def drop_all_but(self, *tables: DataFrame) -> None:
        kept = {id(t) for t in tables}
        self.drop(*[t for t, _ in list(self.names.values()) if id(t) not in kept])

    def remove(self) -> None:
        self.names.clear()
        remove_folder(self.spark, self.folder)


def remove_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables through Spark's own file system client."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back() -> None:
    """Memory that a finished task has freed goes back to the system: Python workers live on beside the next stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def in_chunks(texts: Iterable[str], most_chars: int) -> Iterator[list[str]]:
    """Consecutive texts with at most so many characters together; a longer text is a chunk of its own."""
    chunk: list[str] = []
    held = 0
    for text in texts:
        if chunk and held + len(text) > most_chars:
            yield chunk
            chunk, held = [], 0
        chunk.append(text)
        held += len(text)
    if chunk:
        yield chunk


def per_text(make: Callable[[], Callable[[list[str]], list[tuple]]], schema: T.StructType, most_chars: int = 4_000_000) -> Callable[[Column], Column]:
    """A vectorised UDF from texts to a struct.

    ``make`` runs once in each Python worker's task and returns a function from a list of texts to a list of
    tuples in the order of ``schema``. Nulls arrive as empty strings. Memory is bounded by ``most_chars`` and
    the longest single text.
    """
    small_batches()
    names = schema.fieldNames()

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        work = make()
        for batch in batches:
            rows: list[tuple] = []
            for chunk in in_chunks(("" if x is None else x for x in batch), most_chars):
                rows += work(chunk)
            yield pd.DataFrame(rows, columns=names, dtype=object)
        work = None
        give_back()

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, schema)


def record_batch(schema: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    """Rows as a record batch; none are a batch without rows."""
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for (_, t), c in zip(schema, columns)], names=[n for n, _ in schema])


def salted_lookup(left: DataFrame, right: DataFrame, keys: list[str], spread_by: Column, salts: int = 64) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row a key, where both have the key.

    A key that holds a third of ``left`` is dealt to ``salts`` tasks: rows get a salt, each salt that a key has in ``left``
    gets its own copy of the row of ``right`` (so many a key at most), and rows meet it on key and salt.
    """
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int"))
    copies = salted.select(*keys, "_salt").distinct().join(right, keys)
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")
