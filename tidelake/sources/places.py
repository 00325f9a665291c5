"""Names in the shared file system, looked up and moved by the driver through Spark's own file API."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError


def _path(spark, name: str):
    return spark._jvm.org.apache.hadoop.fs.Path(name)


def _system(spark, name: str):
    return _path(spark, name).getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark, name: str) -> bool:
    return _system(spark, name).exists(_path(spark, name))


def delete(spark, name: str) -> None:
    _system(spark, name).delete(_path(spark, name), True)


def found(spark, pattern: str) -> list[str]:
    """All places that match a glob pattern."""
    matches = _system(spark, pattern).globStatus(_path(spark, pattern))
    return [status.getPath().toString() for status in matches or []]


def move_new(spark, source: str, target: str) -> bool:
    """Give a folder its name in one step; False if that name is taken.

    One step on HDFS and on local disks. Object stores copy, so readers may see part of a
    folder there.
    """
    _system(spark, target).mkdirs(_path(spark, target).getParent())
    names = spark._jvm.org.apache.hadoop.fs
    context = names.FileContext.getFileContext(_path(spark, target).toUri(), spark._jsc.hadoopConfiguration())
    strict = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(_path(spark, source), _path(spark, target), strict)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True
