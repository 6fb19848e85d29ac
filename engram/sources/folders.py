"""Folders of a table on shared storage: which are complete, remove, move."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names inside a folder; none where it does not exist."""
    folder, files = _at(spark, path)
    return sorted(f.getPath().getName() for f in files.listStatus(folder)) if files.exists(folder) else []


def is_complete(spark: SparkSession, path: str) -> bool:
    return "_SUCCESS" in names(spark, path)


def numbered(spark: SparkSession, path: str, name: str) -> list[int]:
    """Numbers N of the complete folders ``path``/``name``=N, ascending."""
    found = [n for n in names(spark, path) if n.startswith(f"{name}=")]
    return sorted(int(n.split("=")[1]) for n in found if is_complete(spark, f"{path}/{n}"))


def remove(spark: SparkSession, path: str) -> None:
    folder, files = _at(spark, path)
    files.delete(folder, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put the folder ``source`` in the place of ``target``."""
    old, files = _at(spark, source)
    new, _ = _at(spark, target)
    files.mkdirs(new.getParent())
    files.delete(new, True)
    if not files.rename(old, new):
        raise OSError(f"cannot move {source} to {target}")
