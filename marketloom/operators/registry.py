"""A write-once registry: an id that was added is never added again or changed, also by writers that run at the same time.

Rows are staged in a folder of their own. A commit is one small file with the next number, put in place by a rename that fails if
the file is there (a hard link on a local disk; HDFS renames so; a store without such a rename must not be used by several
writers). A writer that comes second finds the number taken, reads what the other has added, leaves those ids out and tries
the next number, so uniqueness holds of what is committed. What is staged and not committed is never read: a writer that dies leaves
no trace in the table, and a reader sees a commit whole or not at all.

The driver holds a row a commit, never ids. Repeated equal rows of a batch count once; rows of one id that differ, and null ids,
are an error. Empty batches commit nothing. Extra columns are kept; all batches have the columns of the first.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.operators.evidence import active, dependencies


class Taken(ValueError):
    """An id is in the registry, or is given to two different rows."""


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def commits(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and folder of each commit, in order."""
    at, fs = _hadoop(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    rows = spark.read.schema("version long, folder string").json(f"{path}/commits").collect()
    return sorted((r.version, r.folder) for r in rows)


def read(spark: SparkSession, path: str, schema: str, version: int | None = None) -> DataFrame:
    """The registry, or what it was after a commit (0: nothing)."""
    folders = [f"{path}/data/{folder}" for n, folder in commits(spark, path) if version is None or n <= version]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _put(spark: SparkSession, text: str, target: str) -> bool:
    """Puts a file in place with its content; False, and nothing done, if there is one."""
    name, (at, fs) = f"{target.rsplit('/', 2)[0]}/staged-{uuid.uuid4().hex}", _hadoop(spark, target)
    fs.mkdirs(at.getParent())
    url = urlparse(fs.makeQualified(at).toString())
    if url.scheme == "file":
        source = unquote(urlparse(fs.makeQualified(_hadoop(spark, name)[0]).toString()).path)
        with open(source, "x", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(source, unquote(url.path))
        except FileExistsError:
            return False
        finally:
            os.unlink(source)
        return True
    return _renamed(spark, text, name, at, fs)


def _renamed(spark: SparkSession, text: str, name: str, at, fs) -> bool:
    source, _ = _hadoop(spark, name)
    out = fs.create(source, False)
    out.write(bytearray(text.encode()))
    out.close()
    files = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else fs.getUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        files.rename(source, at, plain)
    except Exception as e:
        fs.delete(source, False)
        if fs.exists(at):
            return False
        raise e
    return True


def register(rows: DataFrame, path: str, key: str, strict: bool = True) -> DataFrame:
    """Adds rows whose id (the column key) is not there and returns them as stored. strict: Taken is raised, and nothing added, if
    any id is there already; else such rows are left out.

    A batch that is registered again adds nothing, so a run that was cut can be repeated.
    """
    spark, schema = rows.sparkSession, rows.schema
    batch = f"{path}/batches/{uuid.uuid4().hex}"
    rows.distinct().write.parquet(batch)
    staged = spark.read.schema(schema).parquet(batch)
    bad = staged.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col(key).isNull() | (F.col("n") > 1)).take(1)
    if bad:
        raise Taken(f"{key} {bad[0][0]!r} is null or given to rows that differ")
    while True:
        done = commits(spark, path)
        known = [f"{path}/data/{folder}" for _, folder in done]
        old = spark.read.schema(schema).parquet(*known).select(key) if known else None
        if strict and old is not None and (hit := staged.join(old, key, "left_semi").select(key).take(1)):
            raise Taken(f"{key} {hit[0][0]!r} is registered")
        folder = uuid.uuid4().hex
        (staged if old is None else staged.join(old, key, "left_anti").select(*schema.names)).write.parquet(f"{path}/data/{folder}")
        added = spark.read.schema(schema).parquet(f"{path}/data/{folder}")
        number = done[-1][0] + 1 if done else 1
        if added.isEmpty() or _put(spark, json.dumps({"version": number, "folder": folder}), f"{path}/commits/{number:010d}.json"):
            return added


def edges(claims: DataFrame) -> DataFrame:
    """from, to, type of the dependencies of published claims that are neither superseded nor retracted."""
    shown = active(claims).filter(F.col("status") == "published")
    return dependencies(shown).select(F.col("parent").alias("from"), F.col("child").alias("to"), F.lit("depends_on").alias("type"))
