"""Delimited sources and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.operators.sets import union_all
from kinweave.session import cut


def _csv(spark: SparkSession, sep: str, multi_line: bool):
    return (
        spark.read.option("header", True).option("sep", sep).option("quote", '"')
        .option("escape", '"').option("encoding", "UTF-8").option("multiLine", multi_line)
        .option("inferSchema", False)
    )


def read_persons(
    spark: SparkSession, path: str | list[str], sep: str = ";", multi_line: bool = False
) -> DataFrame:
    """Person table: header, quoted long text, every column a string.

    ``multi_line`` declares that quoted values may hold line breaks: each file is then read
    by one task, as the format requires; else files are read in splits.
    """
    return _csv(spark, sep, multi_line).csv(path)


def read_all_string(spark: SparkSession, path: str, sep: str = ";", multi_line: bool = False) -> DataFrame:
    """Delimited file without type guessing."""
    return read_persons(spark, path, sep, multi_line)


def existing(spark: SparkSession, pattern: str) -> list[str]:
    """Files that match a glob, on any file system Spark can reach."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(p)
    return sorted(str(s.getPath().toString()) for s in (found or []))


def read_partitioned(
    spark: SparkSession, glob: str, path_regex: str, col: str = "pais", override: bool = False,
    sep: str = ";", multi_line: bool = False, same_header: bool = False,
) -> DataFrame:
    """All files of a glob, united by column name, with a value taken from the path.

    A value in the file wins unless ``override``. Files with the same header are one scan;
    ``same_header`` skips the look at the header of every file.
    """
    files = existing(spark, glob)
    if not files:
        raise FileNotFoundError(glob)
    by_header: dict[tuple, list[str]] = {}
    for f in files[:1] if same_header else files:
        by_header.setdefault(tuple(_csv(spark, sep, False).csv(f).columns), []).append(f)
    if same_header:
        by_header = {header: files for header in by_header}
    parts = []
    for header, files in by_header.items():
        df = read_persons(spark, files, sep, multi_line)
        from_path = F.try_url_decode(F.regexp_extract(F.col("_metadata.file_path"), path_regex, 1))
        keep = F.col(col) if col in header and not override else F.lit(None)
        parts.append(df.withColumn(col, F.coalesce(keep, from_path)))
    return union_all(parts)


def read_first_existing(spark: SparkSession, paths: list[str], sep: str = ";", multi_line: bool = False) -> DataFrame:
    """The first path that exists."""
    for p in paths:
        if existing(spark, p):
            return read_persons(spark, p, sep, multi_line)
    raise FileNotFoundError(", ".join(paths))


def write_table(df: DataFrame, path: str, fmt: str = "csv", skip_empty: bool = True, sep: str = ",") -> bool:
    """Write a result unless it is empty; tells whether it was written."""
    if skip_empty:
        df = cut(df)  # computed once for the test and the files
        if df.isEmpty():
            return False
    w = df.write.mode("overwrite")
    if fmt == "csv":
        w = w.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    w.format(fmt).save(path)
    return True


def write_by_country(
    df: DataFrame, path: str, col: str = "pais", fmt: str = "csv", sep: str = ";", only_given: bool = False,
) -> None:
    """One directory per country (S06); the rebalance splits a country too large for a task.

    ``only_given`` replaces the countries that ``df`` holds and leaves the directories of all others as they are.
    """
    w = df.hint("rebalance", F.col(col)).write.mode("overwrite").partitionBy(col)
    w = w.option("partitionOverwriteMode", "dynamic" if only_given else "static")
    if fmt == "csv":
        w = w.option("header", True).option("sep", sep).option("quote", '"').option("escape", '"')
    w.format(fmt).save(path)


def manifest(df: DataFrame, key: str) -> DataFrame:
    """Rows per partition."""
    return df.groupBy(key).agg(F.count("*").alias("filas"))


def read_csv_table(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Comma-separated intermediate result (S08); ``write_table`` quotes line breaks, so they are expected."""
    return read_persons(spark, path, ",", multi_line)
