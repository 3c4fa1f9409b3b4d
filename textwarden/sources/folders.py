"""Folders of partitioned tables through Hadoop's file system: listed, never read."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote

from pyspark.sql import SparkSession

Folder = tuple[dict[str, str], str]


def _system(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _inside(spark: SparkSession, path: str) -> list:
    fs, place = _system(spark, path)
    return [s for s in fs.listStatus(place) if not s.getPath().getName().startswith(("_", "."))] if fs.exists(place) else []


def partitions(spark: SparkSession, path: str, *columns: str) -> Iterator[Folder]:
    """(values, folder) of all folders column=value/column=value below a table's folder, as text."""
    if not columns:
        yield {}, path
        return
    for status in _inside(spark, path):
        name, _, value = status.getPath().getName().partition("=")
        if status.isDirectory() and name == columns[0]:
            decoded = unquote(value)  # as Spark writes special characters
            for values, folder in partitions(spark, status.getPath().toString(), *columns[1:]):
                yield {name: decoded, **values}, folder


def files_in(spark: SparkSession, folder: str) -> dict[str, int]:
    """Size of every data file right in a folder."""
    return {s.getPath().toString(): s.getLen() for s in _inside(spark, folder) if s.isFile()}


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, place = _system(spark, path)
    return bool(fs.exists(place)) and bool(fs.getFileStatus(place).isDirectory())


def remove(spark: SparkSession, folder: str) -> None:
    """Delete a folder with all that is in it; one that is gone already is fine."""
    fs, place = _system(spark, folder)
    fs.delete(place, True)


def read_text(spark: SparkSession, file: str) -> str | None:
    """A small file as text, or None where there is none."""
    fs, place = _system(spark, file)
    if not fs.exists(place):
        return None
    stream = fs.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, file: str, text: str) -> None:
    """Write a small file: first beside its place, then moved there, so it is never seen half written."""
    fs, place = _system(spark, file)
    aside = _system(spark, f"{place.getParent()}/.{place.getName()}.new")[1]
    stream = fs.create(aside, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs.delete(place, False)
    fs.rename(aside, place)
