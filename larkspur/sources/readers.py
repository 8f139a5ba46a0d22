"""Readers by file format, the registry that picks one by suffix, and the upload guard."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Callable
from functools import reduce
from typing import Any
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.functions.scalars import file_format, file_name, file_suffix
from larkspur.functions.types import col
from larkspur.sources.excel import read_workbooks
from larkspur.sources.infer import apply_schema, kinds, type_choices
from larkspur.sources.splits import split_csv, split_json

MAX_MB = 50  # fixed value: the largest upload
MISSING = "\u0000"  # stands for an empty field, so that a quoted empty string stays a string
BAD_RECORD = "__bad_record"

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}


def register_reader(extensions: list[str], reader: Reader | None = None) -> Callable:
    """Make `reader(spark, path, **options)` the reader of these suffixes; also a decorator."""

    def add(function: Reader) -> Reader:
        for extension in extensions:
            READERS[extension.lower()] = function
        return function

    return add(reader) if reader else add


def supported_extensions() -> list[str]:
    return sorted(READERS)


def read_any(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Read by the suffix of `path`, whatever its case."""
    extension = posixpath.splitext(path.rstrip("/"))[1].lower()
    if extension not in READERS:
        raise ValueError(f"Unsupported file format: {extension}")
    return READERS[extension](spark, path, **options)


# --- delimited text -----------------------------------------------------------------------------


def text_options(sep: str) -> dict[str, str]:
    """How fields are written: doubled quotes inside quotes, no mark for null, fields of any length."""
    return {"sep": sep, "escape": '"', "nullValue": MISSING, "emptyValue": "", "maxCharsPerColumn": "-1"}


def raw_text(
    spark: SparkSession, paths: list[str], header: list[str], sep: str, multi_line: bool, with_path: bool = False
) -> DataFrame:
    """Delimited files with a known header: every column as text, plus BAD_RECORD for ragged rows, and `__path` if wanted.

    Files of any size are read by ranges; with `multi_line` each range finds out whether it begins inside a quoted field.
    """
    if multi_line:
        return split_csv(spark, paths, header, sep, BAD_RECORD, text_options(sep), with_path)
    fields = [T.StructField(c, T.StringType()) for c in [*header, BAD_RECORD]]
    read = spark.read.schema(T.StructType(fields)).option("header", True).options(**text_options(sep))
    rows = read.option("columnNameOfCorruptRecord", BAD_RECORD).csv(paths)
    return rows.withColumn("__path", F.col("_metadata.file_path")) if with_path else rows


def too_long(header: list[str], sep: str) -> Column:
    """True for a ragged row with more fields than the header; a shorter row just has nulls."""
    unquoted = F.regexp_replace(col(BAD_RECORD), r'"(?:[^"]++|"")*+"', "")
    separators = F.length(unquoted) - F.length(F.replace(unquoted, F.lit(sep), F.lit("")))
    return F.coalesce(separators >= len(header), F.lit(False))


def spans_lines(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether a quoted field may hold a line break: a line then has an odd number of quotes.

    The data decides for files of any size, because only files without such fields can be split among tasks.
    """
    quotes = F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))
    return spark.read.text(path).where(quotes % 2 == 1).limit(1).count() > 0


def first_lines(spark: SparkSession, path: str | list[str], of: Callable[[Column], Column] | None = None) -> DataFrame:
    """(file, line): the first line of every file that is not blank, or what `of` makes of it; nothing else of it moves."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    lines = lines.withColumn("at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    lines = lines.withColumn("value", of(F.col("value"))) if of else lines
    return lines.groupBy("file").agg(F.min_by("value", F.struct("start", "at")).alias("line"))


def _literal(file: str) -> str:
    """A listed path as a reader takes it: not URL-encoded, and no character acts as a wildcard."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file))


def read_csv(
    spark: SparkSession, path: str, sep: str = ",", infer: bool = True, multi_line: bool | None = None
) -> DataFrame:
    """Delimited text with a header; types are inferred from all rows.

    A row with more fields than the header is an error, one with fewer is filled with nulls. Files of a folder may have their
    columns in different orders; they are then put together by name.
    `multi_line` forces or forbids line breaks inside quoted fields; by default the data decides.
    """
    if multi_line is None:
        multi_line = spans_lines(spark, path)
    names = spark.read.option("header", True).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    heads = first_lines(spark, path).withColumn("line", F.regexp_replace("line", "\r$", ""))
    alike = heads.groupBy("line").agg(F.min("file").alias("first"), F.count("*").alias("files")).orderBy("first").collect()
    if not alike:
        raise ValueError(f"no columns in {path}")
    parts, header = [], []
    for row in alike:
        # a single header needs no list of files
        files = [path] if len(alike) == 1 else [_literal(r["file"]) for r in heads.where(F.col("line") == row["line"]).collect()]
        own = names.csv(files[0]).columns
        if not own:
            raise ValueError(f"no columns in {path}")
        header += [c for c in own if c not in header]
        parts.append(raw_text(spark, files, own, sep, multi_line).withColumn("__long", too_long(own, sep)))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    looked_at = raw.select(*kinds(header), "__long")
    found = looked_at.agg(type_choices(header).alias("types"), F.count_if("__long").alias("long")).first()
    if found["long"]:
        raise ValueError(f"{found['long']} rows of {path} have more fields than the header")
    table = raw.drop(BAD_RECORD, "__long")
    return apply_schema(table, dict(zip(header, found["types"]))) if infer else table


@register_reader([".csv"])
def _csv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return read_csv(spark, path, **options)


@register_reader([".tsv"])
def read_tsv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    return read_csv(spark, path, sep="\t", **options)


# --- other formats ------------------------------------------------------------------------------


@register_reader([".xlsx"])
def read_excel(spark: SparkSession, path: str) -> DataFrame:
    """The first sheet of all workbooks matching `path`, which share one header."""
    return read_workbooks(spark.read.format("binaryFile").load(path))


@register_reader([".parquet"])
def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@register_reader([".json", ".jsonl", ".ndjson"])
def read_json(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Flat JSON records, one per line or as one array per file; each file's first character tells which.

    Something that is no record is an error, as in delimited text.
    """
    if multi_line is None:
        listed = first_lines(spark, path, lambda line: F.ltrim(line).startswith("[")).withColumnRenamed("line", "listed")
        kinds_found = [r["listed"] for r in listed.select("listed").distinct().orderBy("listed").collect()] or [False]
    else:
        kinds_found = [multi_line]
    parts = []
    for kind in kinds_found:
        # files of one kind need no list
        files = path if len(kinds_found) == 1 else [_literal(r["file"]) for r in listed.where(F.col("listed") == kind).collect()]
        if kind:  # arrays become lines first, by ranges
            files = split_json(spark, files)
        part = spark.read.option("columnNameOfCorruptRecord", BAD_RECORD).json(files)
        if BAD_RECORD in part.columns:
            raise ValueError(f"{path} holds something that is not a JSON record")
        parts.append(part)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def sql_options(
    url: str, table: str, partition_column: str | None = None, bounds: tuple | None = None, partitions: int = 8,
    fetch_size: int = 10_000, **properties: str,
) -> dict[str, str]:
    """Options of a JDBC read; with a partition column the table is read in parallel ranges."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size), **properties}
    if partition_column:
        if bounds is None:
            raise ValueError("a partitioned read needs the bounds of its column")
        options |= {
            "partitionColumn": partition_column,
            "lowerBound": str(bounds[0]),
            "upperBound": str(bounds[1]),
            "numPartitions": str(partitions),
        }
    return options


def read_sql(
    spark: SparkSession, url: str, table: str, partition_column: str | None = None, bounds: tuple | None = None,
    partitions: int = 8, **properties: str,
) -> DataFrame:
    """A table of a SQL database over JDBC; filters and columns are pushed to the database.

    The bounds of the partition column only shape the ranges, they drop no rows; without them the
    database is asked for its minimum and maximum.
    """
    if partition_column and bounds is None:
        extent = f"(SELECT MIN({partition_column}) AS low, MAX({partition_column}) AS high FROM {table}) extent"
        row = spark.read.format("jdbc").options(**sql_options(url, extent, **properties)).load().first()
        bounds = (row[0], row[1]) if row[0] is not None else None
        partition_column = partition_column if bounds else None
    options = sql_options(url, table, partition_column, bounds, partitions, **properties)
    return spark.read.format("jdbc").options(**options).load()


# --- guard --------------------------------------------------------------------------------------


def guard_files(spark: SparkSession, paths: str | list[str], max_mb: int = MAX_MB) -> DataFrame:
    """Check files before reading: one row per file with its error code, null when it may be read.

    Only file metadata is read. Codes: missing_filename, unsupported_format, file_too_large.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return checked_files(files.select("path", "modificationTime", "length"), max_mb)


def checked_files(files: DataFrame, max_mb: int = MAX_MB) -> DataFrame:
    name, path = file_name(F.col("path")), F.col("path")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    error = (
        F.when(F.trim(name) == "", "missing_filename")
        .when(~file_suffix(path).isin(supported_extensions()) | (stem == ""), "unsupported_format")
        .when(F.col("length") > max_mb * 1024 * 1024, "file_too_large")
    )
    return files.select(
        "path",
        name.alias("original_name"),
        file_format(path).alias("file_format"),
        F.col("length").alias("file_size"),
        F.col("modificationTime").alias("modified"),
        error.alias("error"),
    )
