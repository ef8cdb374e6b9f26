"""Scans: CSV folders and files, line sets, key columns of label sources, Parquet tables.

Rows are read by Spark alone, so any store that Spark can open works.  Only the
names of the files and the first line of each are looked at on the driver.
"""

from __future__ import annotations

import csv
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions import strip_whitespace

#: First bytes of a large-file pointer that stands in for real rows.
POINTER_PREFIX = "version https://git-lfs.github.com/spec/"
#: Different headers that the files of one folder may have; each is one scan of the plan.
MAX_HEADERS = 200


class InvalidExtractError(ValueError):
    """The file holds a large-file pointer instead of rows."""


def first_lines(spark: SparkSession, path: str, glob: str | None = "*.csv") -> dict[str, str]:
    """The first line of every file directly in ``path`` that fits ``glob`` (of ``path`` itself without one), by file, in name order."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path) if glob is None else jvm.org.apache.hadoop.fs.Path(path, glob)
    fs, out = where.getFileSystem(conf), {}
    for status in fs.globStatus(where) or []:
        if status.isFile():
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(status.getPath()), "UTF-8"))
            out[status.getPath().toString()] = (lines.readLine() or "").removeprefix("\ufeff")
            lines.close()
    return dict(sorted(out.items()))


def _reject_pointers(heads: Mapping[str, str]) -> None:
    for path, line in heads.items():
        if line.startswith(POINTER_PREFIX):
            raise InvalidExtractError(f"{path}: a large-file pointer, no rows; fetch the real file first")


def pointer_files(spark: SparkSession, path: str, glob: str = "*.csv") -> DataFrame:
    """(file, is_pointer) of every file directly in ``path``."""
    rows = [(f, line.startswith(POINTER_PREFIX)) for f, line in first_lines(spark, path, glob).items()]
    return spark.createDataFrame(rows, "file string, is_pointer boolean")


def _by_header(
    spark: SparkSession, heads: Mapping[str, str], schema: StructType | None, load_order: str | None
) -> DataFrame:
    """One scan per different header, joined by lower-cased column name; what a file lacks is null."""
    files: dict[tuple[str, ...], list[str]] = {}
    for path, line in heads.items():
        names = tuple(c.strip().lower() for c in next(csv.reader([line]), []))
        if names:  # an empty file has no rows
            files.setdefault(names, []).append(path)
    if len(files) > MAX_HEADERS:
        raise ValueError(f"{len(files)} different headers; at most {MAX_HEADERS} can be united")
    kinds = {f.name.lower(): f for f in schema} if schema is not None else None
    if kinds is None:
        wanted = list(dict.fromkeys(c for names in files for c in names))
        kinds = {c: StructField(c, StringType()) for c in wanted}
    order = [load_order] if load_order else []
    out = spark.createDataFrame([], StructType([StructField(c, f.dataType) for c, f in kinds.items()]))
    if load_order:
        out = out.withColumn(load_order, F.lit(None).cast("struct<file: string, block: bigint, row: bigint>"))
    for names, paths in files.items():
        own = StructType([StructField(c, kinds[c].dataType if c in kinds else StringType()) for c in names])
        df = spark.read.option("header", True).schema(own).csv(paths)
        if load_order:
            place = F.struct(
                F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
            )
            df = df.withColumn(load_order, place)
        out = out.unionByName(df.select(*[F.col(f"`{c}`") for c in names if c in kinds], *order), allowMissingColumns=True)
    return out.select(*[F.col(f"`{c}`") for c in kinds], *order)


def read_csv_directory(
    spark: SparkSession, path: str, schema: StructType | None = None, *, glob: str = "*.csv", check_pointers: bool = True, load_order: str | None = None
) -> DataFrame:
    """Union by name of the CSV files directly in ``path`` (subfolders are not read), header lower-cased.

    Files may order, omit or add columns: a missing one is null, one outside
    ``schema`` is not read.  Without a schema every column of any file is
    there, as text.  No file gives an empty frame.  ``load_order`` names a
    column to add for keep-first semantics: file, then place in the file.
    """
    heads = first_lines(spark, path, glob)
    if check_pointers:
        _reject_pointers(heads)
    return _by_header(spark, heads, schema, load_order)


def read_csv_file(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """One CSV file (or the part files of a written folder), by the names of its header."""
    heads = first_lines(spark, path, None) or first_lines(spark, path)
    if not heads:
        raise FileNotFoundError(path)
    _reject_pointers(heads)
    return _by_header(spark, heads, schema, None)


def read_line_set(spark: SparkSession, path: str, glob: str = "*.csv", name: str = "address") -> DataFrame:
    """Distinct stripped lines over all files; there is no header, every line is a member."""
    _reject_pointers(first_lines(spark, path, glob))
    lines = spark.read.option("pathGlobFilter", glob).text(path)
    return lines.select(strip_whitespace("value").alias(name)).distinct()


def key_sets(sources: Iterable[tuple[DataFrame, str]], name: str = "address") -> DataFrame:
    """One key column of each source (its own spelling), set-unioned."""
    out = None
    for df, column in sources:
        one = df.select(F.col(column).cast("string").alias(name))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("key_sets needs at least one source")
    return out.distinct()


def literal_set(spark: SparkSession, values: Iterable[str], *, lower: bool = False, name: str = "address") -> DataFrame:
    """Inline rows, duplicates collapse; ``lower`` normalises their case first."""
    rows = sorted({v.lower() if lower else v for v in values})
    return spark.createDataFrame([(v,) for v in rows], StructType([StructField(name, StringType())]))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tables(spark: SparkSession, sf_dir: str, *names: str) -> Mapping[str, DataFrame]:
    return {name: read_table(spark, sf_dir, name) for name in names}
