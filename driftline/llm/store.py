"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: With it, a query's shuffle files go when it ends; without it, they stay until the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of a few numbers that one task writes, about.
ROWS = 1 << 14
#: A gathered table has a writer for so many shuffle partitions.
GATHER = 8


def shared_dir(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which Hadoop deletes when the session's JVM ends.

    Where that is unset, a temporary folder serves on a local master (tests); on a cluster it is an error.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not context.master.startswith(("local[", "local")) or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="driftline-")
        spark.conf.set("spark.checkpoint.dir", base)
    name = f"{base.rstrip('/')}/driftline-{uuid.uuid4().hex}"
    folder = context._jvm.org.apache.hadoop.fs.Path(name)
    files = folder.getFileSystem(context._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    return f"{name}/data"


def stored(df: DataFrame, *partition_by: str, rows: int | None = None, gathered: bool = False) -> DataFrame:
    """``df`` written as Parquet into the shared folder and read back: lineage ends here, no executor's loss costs it, and its shuffles leave the disk.

    ``rows``: about how many there are, of a few numbers each. They are then written by a task for each ``ROWS``,
    whatever the number of shuffle partitions: a task that writes costs a tenth of a second even without rows.
    ``gathered``: rows of a few numbers, how many isn't known, come from many tasks with work to do (texts, trees).
    These keep their number; the rows go by a shuffle to a writer for each ``GATHER`` partitions. A file in a local folder
    has the executor start several processes (chmod), and until such a child has its own program it shows the whole JVM's memory as its own.
    """
    spark = df.sparkSession
    if gathered:
        df = df.repartition(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // GATHER))
    if rows is not None:
        df = df.coalesce(max(1, -(-rows // ROWS)))
    path = shared_dir(spark)
    writer = df.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false")
    writer = writer.partitionBy(*partition_by) if partition_by else writer
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    return spark.read.schema(spark.read.parquet(path).schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Deletes the folder of a table that ``stored`` made and that nothing reads any more; other tables' files stay."""
    context = table.sparkSession.sparkContext
    hadoop = context._jvm.org.apache.hadoop.fs.Path
    found = {m[0] for f in table.inputFiles() if (m := re.match(r".*/driftline-[0-9a-f]{32}(?=/data/)", f))}
    for name in found:
        folder = hadoop(context._jvm.java.net.URI(name))
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
