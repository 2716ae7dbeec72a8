"""Files of shared storage through Spark's own file-system layer, from the driver: metadata only, no contents."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """(file system, path) of a path in any store that Spark knows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def numbered(spark: SparkSession, folder: str) -> list[int]:
    """The sub-folders of a folder that are named by a number."""
    fs, p = _path(spark, folder)
    names = [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(x) for x in names if x.isdigit())


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote; nothing if it isn't there."""
    fs, p = _path(spark, path)
    fs.delete(p, True)


def part_files(spark: SparkSession, folder: str) -> list[str]:
    """The part files of a written table by partition number."""
    fs, p = _path(spark, folder)
    names = [(f.getPath().getName(), f.getPath().toString()) for f in fs.listStatus(p) if f.getPath().getName().startswith("part-")]
    return [path for _, path in sorted(names, key=lambda x: int(x[0].split("-")[1]))]


def order_by_time(spark: SparkSession, files: list[str], step_ms: int = 1000) -> None:
    """Give files modification times in the order of the list, the last one keeping its own: a file stream takes its
    input by modification time. Raises where the store doesn't hold the times."""
    if not files:
        return
    fs, last = _path(spark, files[-1])
    end = fs.getFileStatus(last).getModificationTime() // step_ms * step_ms
    for i, name in enumerate(files):
        at = end - (len(files) - 1 - i) * step_ms
        _, p = _path(spark, name)
        fs.setTimes(p, at, -1)
        if fs.getFileStatus(p).getModificationTime() != at:
            raise RuntimeError(f"the store of {name} does not hold modification times; replay from another one")
