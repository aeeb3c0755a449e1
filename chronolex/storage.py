"""Reading input tables and writing intermediate ones where every executor can see them."""

from __future__ import annotations

import gc
import json
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """The Parquet table of that name under sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Folders of local sessions that name none, by application.
LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir); where none is named, a local session gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = LOCAL.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="chronolex-")
        LOCAL[spark.sparkContext.applicationId] = found
    return found.rstrip("/")


#: Rows of a batch handed to Python, where the session has Spark's own number: texts are long, and few fill a batch.
BATCH_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's rows of an Arrow batch from Spark's 10,000, which may hold much of a worker's memory."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(setting) == "10000":
        spark.conf.set(setting, str(BATCH_ROWS))


def materialise(df: DataFrame, label: str, compression: str | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, label)
    small_batches(spark)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/chronolex/{label}-{uuid.uuid4().hex}"


def discard(*tables: DataFrame) -> None:
    """Remove tables that materialise wrote, once nothing that is still to be computed reads them.

    Shuffle files go when the driver's garbage collector finds their plans; it is asked to look, as a driver that has
    memory to spare may not do so for long while executors' disks fill.
    """
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            hadoop = table.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            hadoop.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    gc.collect()
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


@contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files are removed when it is over, not when the driver's collector finds its plan.

    A frame that is computed twice inside shuffles twice.
    """
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Rows become the whole content of the partitions they name in the table at path; its other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_report(report: dict, uri: str) -> None:
    """A small report as JSON, under its name only once it is whole."""
    files, path = fs.FileSystem.from_uri(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    temporary = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(temporary) as f:
        f.write(json.dumps(report, ensure_ascii=False, sort_keys=True, indent=1).encode())
    files.move(temporary, path)
