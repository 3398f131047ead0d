"""Tables of a folder, and tables kept in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a temporary folder in local mode (tests); on a cluster that is an error, since
    executors would write where neither the driver nor one another can read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="marketloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables that this process has stored and not discarded.
_STORED: list[str] = []


def kept(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Writes a table to the shared folder and reads it back: lineage ends here, and a lost executor costs nothing before it.

    group_rows: rows of a Parquet row group, for tables whose rows have megabytes. A writer holds a group in memory (and looks at
    its size only after a hundred rows), and a reader decodes a whole one (up to 4,096 rows) at a time.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer if group_rows is None else writer.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    _STORED.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def registered(path: str) -> str:
    """A folder of a query's own, to be deleted by discard() too."""
    _STORED.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the tables stored so far and returns their number. To be called when the results built on them have been written."""
    paths = [_STORED.pop() for _ in range(len(_STORED))]
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for path in paths:
        at = hadoop(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)
