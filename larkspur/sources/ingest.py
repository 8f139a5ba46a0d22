"""Bulk ingest: files become typed, profiled, catalogued datasets.

Files with the same format, header and types are handled together: one read, one write and one
profile per such group, keyed by dataset, so that thousands of small files cost a few jobs.
"""

from __future__ import annotations

import csv
import io
import logging
import re
import sys
import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark import cloudpickle, inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.scalars import stable_id
from larkspur.functions.types import col
from larkspur.operators.profile import profile, sample_values
from larkspur.session import cut_lineage, shared_path
from larkspur.sources.catalog import Catalog
from larkspur.sources.excel import cell_types, typed_cells, workbook_cells
from larkspur.sources.infer import kinds, type_choices
from larkspur.sources.readers import BAD_RECORD, MAX_MB, READERS, checked_files, first_lines, raw_text, spans_lines, too_long
from larkspur.sources.splits import json_records, with_paths

log = logging.getLogger(__name__)

# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FILES_PER_GROUP = 5_000  # paths handed to one read
GROUPS_AT_A_TIME = 6  # groups whose jobs run side by side
SEPARATORS = {"csv": ",", "tsv": "\t"}  # fixed values: text formats and their separators
JSON = ("json", "jsonl", "ndjson")  # fixed values
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


@dataclass
class _File:
    id: str
    path: str
    original_name: str
    file_format: str
    file_size: int
    status: str = "pending"
    error: str | None = None
    storage_path: str = ""
    row_count: int | None = None
    header: tuple[str, ...] = ()
    variant: str = ""

    def fail(self, error: object) -> None:
        self.status, self.error = "failed", str(error)


def ingest(
    spark: SparkSession, paths: str | list[str], catalog: Catalog, workspace_id: str, max_mb: int = MAX_MB,
    samples: bool = False,
) -> DataFrame:
    """Ingest all files under `paths`; returns their rows of the `datasets` table.

    A file that is refused or cannot be read gets status `failed` with the reason; the others go on.
    With `samples`, the most frequent values of every column are catalogued too.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return ingest_files(files.drop("content"), catalog, workspace_id, max_mb, samples=samples)


def ingest_files(
    files: DataFrame, catalog: Catalog, workspace_id: str, max_mb: int = MAX_MB, batch: str | None = None,
    samples: bool = False,
) -> DataFrame:
    """Ingest listed files (path, modificationTime, length). Only this listing reaches the driver.

    The id of a dataset follows from its path, time and size, and a batch replaces itself when it is
    repeated, so replaying a batch changes nothing.
    """
    batch = batch or uuid.uuid4().hex
    key = stable_id(F.col("path"), F.unix_micros("modified"), F.col("file_size"))
    checked = checked_files(files, max_mb).withColumn("id", key)
    listed = []
    for r in sorted(checked.collect(), key=lambda r: r["path"]):
        file = _File(r["id"], r["path"], r["original_name"], r["file_format"], r["file_size"])
        if r["error"]:
            file.fail(r["error"])
        listed.append(file)

    def take(number: int, group: list[_File]) -> None:
        for name, landed in _load(catalog, group, f"{batch}_{number}"):
            columns = [c for c in landed.columns if c != "dataset_id"]
            values = sample_values(landed, columns, by=["dataset_id"]) if samples else None
            catalog.write_columns(profile(landed, columns, ["dataset_id"]), values, name)

    groups = list(_groups(catalog.spark, [f for f in listed if f.status == "pending"], max_mb))
    with ThreadPoolExecutor(GROUPS_AT_A_TIME) as pool:
        work = inheritable_thread_target(catalog.spark)(take)
        list(pool.map(work, range(len(groups)), groups))
    _write_empty(catalog, [f for f in listed if f.status == "ready" and not f.row_count], f"{batch}_empty")

    mine = F.split_part("batch_id", F.lit("_"), F.lit(1)) == batch
    rows = [
        (f.id, workspace_id, f.original_name, f.storage_path, f.file_size, f.file_format, f.status, f.error, f.row_count)
        for f in listed
    ]
    schema = (
        "id string, workspace_id string, original_name string, storage_path string, file_size bigint, "
        "file_format string, status string, error string, row_count bigint"
    )
    columns = catalog.read("dataset_columns", with_batch=True).where(mine)
    catalog.write_datasets(catalog.spark.createDataFrame(rows, schema), columns, batch)
    return catalog.read("datasets", with_batch=True).where(F.col("batch_id") == batch).drop("batch_id")


# --- grouping -----------------------------------------------------------------------------------


def _contents(spark: SparkSession, files: list[_File], max_mb: int) -> DataFrame:
    found = spark.read.format("binaryFile").load([_literal(f.path) for f in files])
    return found.where(F.col("length") <= max_mb * 1024 * 1024)


def _chunks(files: list[_File]) -> Iterable[list[_File]]:
    return (files[i : i + FILES_PER_GROUP] for i in range(0, len(files), FILES_PER_GROUP))


def _groups(spark: SparkSession, files: list[_File], max_mb: int) -> Iterator[list[_File]]:
    """Learn the header of every file, then hand out the files that can be read together."""
    by_format = defaultdict(list)
    for f in files:
        by_format[f.file_format].append(f)
    for file_format, members in sorted(by_format.items()):
        for chunk in _chunks(members):
            if file_format == "xlsx":
                yield chunk  # headers come with the cells
                continue
            try:
                _learn_headers(spark, file_format, chunk, max_mb)
            except Exception as error:  # noqa: BLE001
                for f in chunk:
                    f.fail(error)
            alike = defaultdict(list)
            for f in chunk:
                if f.status == "pending":
                    alike[f.variant, f.header].append(f)
            yield from (alike[k] for k in sorted(alike))


def _learn_headers(spark: SparkSession, file_format: str, files: list[_File], max_mb: int) -> None:
    known = {f.path: f for f in files}
    if file_format in SEPARATORS:
        for path, line in _first_of(spark, files):
            known[path].header = header_names(line.removeprefix("\ufeff").removesuffix("\r"), SEPARATORS[file_format])
        for file in files:
            if not file.header:
                file.fail("the file is empty")
    elif file_format in JSON:
        for path, line in _first_of(spark, files):
            known[path].variant = "array" if line.lstrip("\ufeff \t\r").startswith("[") else "lines"
        for variant in ("array", "lines"):
            members = [f for f in files if f.variant == variant]
            if members:
                keys = F.explode(F.json_object_keys("value"))
                named = _json_values(spark, members, variant).select("path", keys.alias("name"))
                for r in named.groupBy("path").agg(F.array_sort(F.collect_set("name")).alias("names")).collect():
                    known[r["path"]].header = tuple(r["names"])
        for file in files:
            if not file.header:
                file.fail("no JSON records")
    elif file_format == "parquet":
        found = _contents(spark, files, max_mb).select("path", "content")
        for r in found.mapInPandas(_parquet_schemas, "path string, names array<string>, kinds string").collect():
            known[r["path"]].header, known[r["path"]].variant = tuple(r["names"] or ()), r["kinds"]
    else:  # a reader registered by the user takes one file at a time
        for f in files:
            f.variant = f.path


def _first_of(spark: SparkSession, files: list[_File]) -> list[tuple[str, str]]:
    """(path, first line that is not blank) of every file; one row a file reaches the driver."""
    lines = first_lines(spark, [_literal(f.path) for f in files])
    return [(r["path"], r["line"]) for r in lines.select(_decoded(F.col("file")).alias("path"), "line").collect()]


def _json_values(spark: SparkSession, files: list[_File], variant: str) -> DataFrame:
    """(path, value): one record a row, files being read by ranges."""
    paths = [_literal(f.path) for f in files]
    if variant == "array":
        return with_paths(spark, paths, json_records(spark, paths)).withColumn("path", _decoded(F.col("path")))
    return spark.read.text(paths).where(F.trim("value") != "").select(_source_path().alias("path"), "value")


def _parquet_schemas(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow.parquet as pq

    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                schema = pq.read_schema(io.BytesIO(content))
                names, kinds = schema.names, ",".join(str(t) for t in schema.types)
            except Exception:  # noqa: BLE001 - the read itself will report the damage
                names, kinds = [], path
            yield pd.DataFrame({"path": [path], "names": [names], "kinds": [kinds]})


def header_names(line: str, sep: str) -> tuple[str, ...]:
    """Column names of a header line; blanks are numbered and repeats get a suffix."""
    names: list[str] = []
    for i, name in enumerate(next(csv.reader([line], delimiter=sep), [])):
        name = base = name or f"_c{i}"
        repeat = 0
        while name in names:
            name, repeat = f"{base}_duplicated_{repeat}", repeat + 1
        names.append(name)
    return tuple(names)


# --- loading ------------------------------------------------------------------------------------


def _load(catalog: Catalog, files: list[_File], name: str) -> Iterator[tuple[str, DataFrame]]:
    """Land a group; if the group fails, its files are tried one by one."""
    try:
        parts = list(_land(catalog, files, name))
    except Exception as error:  # noqa: BLE001 - reported per file
        if len(files) == 1:
            log.warning("ingest of %s failed: %s", files[0].path, error)
            files[0].fail(error)
            return
        for i, f in enumerate(files):
            if f.status != "failed":
                f.status = "pending"
                yield from _load(catalog, [f], f"{name}_{i}")
        return
    yield from parts


def _land(catalog: Catalog, files: list[_File], name: str) -> Iterator[tuple[str, DataFrame]]:
    """Write the typed tables of a group, one folder per dataset, and read them back."""
    for i, (members, typed) in enumerate(_typed(catalog.spark, files[0].file_format, files)):
        path = f"{catalog.path('data')}/{name}_{i}"
        typed.write.partitionBy("dataset_id").mode("overwrite").parquet(path)
        for f in members:
            f.status, f.storage_path = "ready", f"{path}/dataset_id={f.id}"
        kept = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in typed.schema if x.name != "dataset_id")
        yield f"{name}_{i}", catalog.spark.read.schema(f"{kept}, dataset_id string").parquet(path)


def _with_id(spark: SparkSession, df: DataFrame, path_column: str, files: list[_File]) -> DataFrame:
    """Replace the path by the dataset id; the list of a group's files is short and is broadcast."""
    ids = spark.createDataFrame([(f.path, f.id) for f in files], "__known string, dataset_id string")
    same = col(path_column) == F.col("__known")
    return df.join(F.broadcast(ids), same, "inner").drop("__known", path_column)


def _typed(spark: SparkSession, file_format: str, files: list[_File]) -> Iterator[tuple[list[_File], DataFrame]]:
    if file_format in SEPARATORS:
        yield from _typed_text(spark, SEPARATORS[file_format], files)
    elif file_format == "xlsx":
        yield from _typed_workbooks(spark, files)
    else:
        paths = [_literal(f.path) for f in files]
        if file_format == "parquet":
            df = spark.read.parquet(*paths).withColumn("__path", _source_path())
        elif file_format in JSON:
            lines = paths
            if files[0].variant == "array":  # as lines, a folder for each file, whose name tells the path
                lines = shared_path(spark, "json-lines")
                named = _with_id(spark, _json_values(spark, files, "array"), "path", files)
                named.select("value", F.concat(F.lit("of "), "dataset_id").alias("__id")).write.partitionBy("__id").text(lines)
            df = spark.read.option("columnNameOfCorruptRecord", BAD_RECORD).json(lines)
            if BAD_RECORD in df.columns:
                raise ValueError("something in the file is not a JSON record")
            if files[0].variant == "array":
                df = df.withColumn("__id", F.substring("__id", 4, 1000))
                paths_of = spark.createDataFrame([(f.id, f.path) for f in files], "__id string, __path string")
                df = df.join(F.broadcast(paths_of), "__id").drop("__id")  # the list of a group's files is short
            else:
                df = df.withColumn("__path", _source_path())
        else:
            df = READERS[f".{file_format}"](spark, paths[0])
            df = df.withColumn("__path", F.lit(files[0].path))
        table = _with_id(spark, df, "__path", files)
        counts = {r["dataset_id"]: r["count"] for r in table.groupBy("dataset_id").count().collect()}
        for f in files:
            f.row_count = counts.get(f.id, 0)
            if not f.row_count:
                f.status, f.header = "ready", f.header or tuple(df.drop("__path").columns)
        if counts:
            yield [f for f in files if f.row_count], table


def _decoded(path: Column) -> Column:
    """The path as the file listing writes it; the metadata column has it URL-encoded."""
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _source_path() -> Column:
    return _decoded(F.col("_metadata.file_path"))


def _literal(path: str) -> str:
    """A path in which no character acts as a wildcard."""
    return re.sub(r"([\\*?\[\]{}])", r"\\\1", path)


def _by_types(files: list[_File], found: dict[str, list[str]]) -> Iterator[tuple[list[str], list[_File]]]:
    alike = defaultdict(list)
    for f in files:
        alike[tuple(found[f.path])].append(f)
    for types in sorted(alike):
        yield list(types), alike[types]


def _typed_text(spark: SparkSession, sep: str, files: list[_File]) -> Iterator[tuple[list[_File], DataFrame]]:
    header = list(files[0].header)

    paths = [_literal(f.path) for f in files]
    raw = raw_text(spark, paths, header, sep, spans_lines(spark, paths), with_path=True)
    raw = raw.withColumn("__path", _decoded(F.col("__path")))
    looked_at = raw.select("__path", *kinds(header), too_long(header, sep).alias("__long"))
    facts = looked_at.groupBy("__path").agg(
        type_choices(header).alias("types"),
        F.count_if("__long").alias("long"),
        F.count("*").alias("rows"),
    )
    found = {r["__path"]: r for r in facts.collect()}
    if not found.keys() <= {f.path for f in files}:
        raise ValueError("a source path was not recognised")
    filled = []
    for f in files:
        f.row_count = found[f.path]["rows"] if f.path in found else 0
        if not f.row_count:
            f.status = "ready"  # a header without rows
        elif found[f.path]["long"]:
            f.row_count = None
            f.fail(f"{found[f.path]['long']} rows have more fields than the header")
        else:
            filled.append(f)
    for types, members in _by_types(filled, {p: r["types"] for p, r in found.items()}):
        table = _with_id(spark, raw.drop(BAD_RECORD), "__path", members)
        yield members, table.select(
            *[col(c).cast(t).alias(c) for c, t in zip(header, types)], "dataset_id"
        )


def _typed_workbooks(spark: SparkSession, files: list[_File]) -> Iterator[tuple[list[_File], DataFrame]]:
    content = spark.read.format("binaryFile").load([_literal(f.path) for f in files])
    cells = cut_lineage(workbook_cells(content), "workbooks")
    heads = {r["path"]: r for r in cells.where("cells IS NULL").select("path", "header", "error").collect()}
    alike = defaultdict(list)
    for f in files:
        if heads[f.path]["error"]:
            f.fail(heads[f.path]["error"])
        else:
            f.header = tuple(heads[f.path]["header"])
            alike[f.header].append(f)
    for header, members in sorted(alike.items()):
        rows = _with_id(spark, cells.where(F.col("cells").isNotNull()), "path", members)
        facts = rows.groupBy("dataset_id").agg(cell_types(len(header)).alias("types"), F.count("*").alias("rows"))
        found = {r["dataset_id"]: r for r in facts.collect()}
        for f in members:
            f.row_count = found[f.id]["rows"] if f.id in found else 0
            if not f.row_count:
                f.status = "ready"
        filled = [f for f in members if f.row_count]
        for types, part in _by_types(filled, {f.path: found[f.id]["types"] for f in filled}):
            mine = rows.where(F.col("dataset_id").isin([f.id for f in part]))
            yield part, typed_cells(mine, list(header), types, ["dataset_id"])


def _write_empty(catalog: Catalog, files: list[_File], batch: str) -> None:
    """Columns of datasets that have a header but no rows."""
    rows = [(f.id, i, c, "String", True, 0, 0) for f in files for i, c in enumerate(f.header)]
    if rows:
        schema = (
            "dataset_id string, position int, column_name string, data_type string, is_nullable boolean, "
            "null_count bigint, unique_count bigint"
        )
        catalog.append("dataset_columns", catalog.spark.createDataFrame(rows, schema), batch)
