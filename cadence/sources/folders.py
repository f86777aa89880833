"""Folders of any file system that Spark writes to: what is committed, and an atomic marker.

Spark's own writers make and commit the data; these few calls of the same Hadoop client only look at
and remove whole folders, on the driver, a handful per job.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

DONE = "_SUCCESS"          # written by Spark's committer when a folder is complete


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def committed(spark: SparkSession, path: str) -> bool:
    """A Spark writer has finished the folder."""
    return exists(spark, f"{path}/{DONE}")


def numbered(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """The numbers ``n`` of the entries ``<prefix><n>`` of a folder, in order."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix) and n[len(prefix):].isdigit())


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file that must not exist yet; False if another writer was first."""
    fs, where = _at(spark, path)
    jvm = spark.sparkContext._jvm
    try:
        out = fs.create(where, False)
    except Exception as e:  # the client's own exception class differs by file system
        if fs.exists(where):
            return False
        raise e
    out.write(bytearray(text, "utf-8"))
    out.close()
    return True


def text_of(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())
