"""Large text files read by byte ranges, although a record may hold the very character that records are cut at.

Spark deals a text file to tasks by byte ranges, each with whole lines. In delimited text a line break may lie inside a quoted
field; in a JSON array the end of an object may be that of an inner one, or lie inside a string. What a range begins with depends on all
ranges before it. So every range first tells what it does to each state that it may begin in; windows over ranges, one small row each,
compose these effects, and then each task knows the state at its first line. It puts together the records that lie in its range. A
record across ranges leaves a fragment in each, and these few are joined by file and position.

Tasks get the states of ranges as one table, some 24 bytes for a range of 128 MB. The work is two scans of the text; the records are
kept in the shared folder.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import cut_lineage, shared_path

# Executors need no installed copy of this module: its functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: What a row that a task puts out is: a whole record, or a part of one that crosses ranges.
RECORD, HEAD, TAIL, INNER, FIRST = 0, 1, 2, 3, 4

_QUOTE, _BACKSLASH = ord('"'), "\\"


def _bytes(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, and where each text begins and the last one ends."""
    lines = lines.cast(pa.large_string())
    bounds = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + len(lines) + 1]
    held = lines.buffers()[2]
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.empty(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


# --- what a line does to the state ------------------------------------------------------------------------


@dataclass(frozen=True)
class Delimited:
    """Delimited text; the state is 1 inside a quoted field.

    A quote at the start of a field opens it, any other one outside of quotes is part of the text; inside, a quote closes the field
    unless it is doubled. So a quote at the start of a field turns the state round, and any other one leaves it at 0.
    """

    sep: str
    end: str = "\n"

    #: columns of a range's effect: the state after it if it begins with 0, and with 1
    effect = ("out0", "out1")

    def after(self, lines: pa.Array, state: tuple[int, ...]) -> np.ndarray:
        """State after every line, one column each."""
        data, bounds = _bytes(pc.replace_substring(lines, '""', ""))
        at = np.flatnonzero(data == _QUOTE)
        line = np.searchsorted(bounds, at, side="right") - 1
        turns = (at == bounds[line]) | (data[np.maximum(at - 1, 0)] == ord(self.sep))
        count = np.cumsum(turns)
        reset = np.maximum.accumulate(np.where(turns, -1, np.arange(len(at))))
        since = np.where(reset >= 0, count - count[np.maximum(reset, 0)], count + state[0]) & 1
        last = np.searchsorted(line, np.arange(len(lines)), side="right") - 1
        return np.where(last >= 0, np.append(since, 0)[last], state[0])[:, None]

    def ends(self, states: np.ndarray) -> np.ndarray:
        """Whether a record ends with the line."""
        return states[:, 0] == 0

    def crossed(self, start: int, state: tuple[int, ...]) -> bool:
        """Whether a range that begins in this state begins inside a record."""
        return state[0] == 1

    def begin(self) -> list[tuple[int, ...]]:
        """States that a range may begin in."""
        return [(0,), (1,)]

    def found(self, finals: list[tuple[int, ...]]) -> tuple[int, ...]:
        return finals[0][0], finals[1][0]

    def entries(self, ranges: DataFrame) -> DataFrame:
        """State at the start of every range, as array.

        A range whose result does not depend on its start sets the state; others keep it or turn it round.
        """
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        up_to = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
        fixed = F.col("out0") == F.col("out1")
        turned = ranges.withColumn("turns", F.sum(F.when(fixed, 0).otherwise(F.col("out0"))).over(up_to))
        set_at = F.last(F.when(fixed, F.struct("out0", "turns")), ignorenulls=True).over(before)
        turns = F.coalesce(F.last("turns").over(before), F.lit(0)) - F.coalesce(set_at["turns"], F.lit(0))
        return turned.withColumn("state", F.array(((F.coalesce(set_at["out0"], F.lit(0)) + turns) % 2).cast("long")))


@dataclass(frozen=True)
class JsonArray:
    """The objects of a JSON array, cut at closing braces; the state is 1 inside a string, and the depth of open brackets."""

    end: str = "}"

    #: columns of a range's effect: whether it turns the string state, and what it adds to the depth for either state
    effect = ("turn", "deeper0", "deeper1")

    def after(self, lines: pa.Array, state: tuple[int, ...]) -> np.ndarray:
        if pc.any(pc.match_substring(lines, _BACKSLASH)).as_py():
            lines = pc.replace_substring_regex(lines, r"(?s)\\.", "")
        data, bounds = _bytes(lines)
        inside = (np.cumsum(data == _QUOTE) + state[0]) & 1
        opens = (data == ord("{")) | (data == ord("["))
        step = (opens.astype(np.int64) - ((data == ord("}")) | (data == ord("]")))) * (1 - inside)
        depth = np.concatenate([[0], np.cumsum(step)])[bounds[1:]]
        string = np.concatenate([[state[0]], inside])[bounds[1:]]
        closed = np.cumsum(string == 0)  # the brace that the line was cut at
        return np.stack([string, state[1] + depth - closed], axis=1)

    def ends(self, states: np.ndarray) -> np.ndarray:
        return (states[:, 0] == 0) & (states[:, 1] == 1)

    def crossed(self, start: int, state: tuple[int, ...]) -> bool:
        return start > 0 and tuple(state) != (0, 1)

    def begin(self) -> list[tuple[int, ...]]:
        return [(0, 0), (1, 0)]

    def found(self, finals: list[tuple[int, ...]]) -> tuple[int, ...]:
        return finals[0][0], finals[0][1], finals[1][1]

    def entries(self, ranges: DataFrame) -> DataFrame:
        before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
        string = F.coalesce(F.sum("turn").over(before), F.lit(0)) % 2
        known = ranges.withColumn("string", string)
        deeper = F.when(F.col("string") == 0, F.col("deeper0")).otherwise(F.col("deeper1"))
        depth = F.coalesce(F.sum(deeper).over(before), F.lit(0))
        return known.withColumn("state", F.array(F.col("string").cast("long"), depth.cast("long")))


Format = Delimited | JsonArray


# --- ranges -----------------------------------------------------------------------------------------------


def _lines(spark: SparkSession, paths: list[str], form: Format) -> DataFrame:
    """(value, file, start): all lines in order, with the file and the first byte of their range."""
    read = spark.read.option("lineSep", form.end).text(paths)
    return read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """First and next row of the parts of a batch that lie in one range."""
    if not batch.num_rows:
        return
    file, start = (np.asarray(batch.column(c), dtype=np.int64) for c in ("file", "start"))
    cuts = (np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1).tolist()
    yield from zip([0, *cuts], [*cuts, batch.num_rows], strict=True)


def ranges(spark: SparkSession, paths: list[str], form: Format) -> DataFrame:
    """(file, start, state): one row per range with the state at its start; the file as a hash of its path."""
    names = ("file", "start", *form.effect)

    def effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, states, rows = None, [], []
        for batch in batches:
            for low, high in _runs(batch):
                part = batch.slice(low, high - low)
                at = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                if at != held:
                    rows += [(*held, *form.found(states))] if held else []
                    held, states = at, form.begin()
                states = [tuple(form.after(part.column("value"), s)[-1].tolist()) for s in states]
        rows += [(*held, *form.found(states))] if held else []
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], pa.schema([(n, pa.int64()) for n in names]))

    lines = _lines(spark, paths, form)
    if isinstance(form, Delimited):  # lines without quotes keep the state, but their ranges must be there
        lines = lines.withColumn("value", F.when(F.contains("value", F.lit('"')), F.col("value")).otherwise(""))
    found = lines.withColumn("file", F.xxhash64("file")).mapInArrow(effects, ", ".join(f"{n} long" for n in names))
    return form.entries(found).select("file", "start", "state")


@dataclass
class States:
    """States at the start of ranges, as sorted arrays: what every task holds."""

    file: np.ndarray
    start: np.ndarray
    state: np.ndarray

    @classmethod
    def of(cls, found: list[tuple[int, int, list[int]]]) -> States:
        found = sorted(found)
        columns = zip(*found, strict=True) if found else ([], [], [])
        file, start, state = (np.array(c, dtype=np.int64) for c in columns)
        return cls(file, start, state)

    def at(self, file: int, start: int) -> tuple[int, ...]:
        low, high = np.searchsorted(self.file, [file, file + 1]) if file < 2**63 - 1 else (np.searchsorted(self.file, file), len(self.file))
        return tuple(self.state[low + np.searchsorted(self.start[low:high], start)].tolist())


def _pieces(lines: DataFrame, form: Format, states: States, header: bool) -> DataFrame:
    """Rows (file, start, kind, value): records and fragments of all ranges.

    With `header` the first record of a file is left out; if it crosses ranges its fragment is marked FIRST.
    """
    schema = pa.schema([("file", pa.int64()), ("start", pa.int64()), ("kind", pa.int32()), ("value", pa.string())])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, kept, crossed, skip = None, (), [], False, False

        def rest() -> Iterator[pa.RecordBatch]:
            """What is left of a range: the start of a record that goes on in the next, or all of it lies in one."""
            if held and kept:
                kind = INNER if crossed else FIRST if skip else TAIL
                yield rows([form.end.join(kept)], [kind])

        def rows(values, kinds) -> pa.RecordBatch:
            count = len(values)
            columns = [pa.array(np.full(count, x)) for x in held]
            values = values if isinstance(values, pa.Array) else pa.array(values, pa.string())
            return pa.RecordBatch.from_arrays([*columns, pa.array(kinds, pa.int32()), values], schema=schema)

        for batch in batches:
            for low, high in _runs(batch):
                part = batch.slice(low, high - low)
                at = (part.column("file")[0].as_py(), part.column("start")[0].as_py())
                if at != held:
                    yield from rest()
                    held, state, kept = at, states.at(*at), []
                    crossed, skip = form.crossed(at[1], state), header and at[1] == 0
                values = part.column("value")
                after = form.after(values, state)
                state = tuple(after[-1].tolist())
                stops = np.flatnonzero(form.ends(after)) + 1
                if not len(stops):
                    kept += values.to_pylist()
                    continue
                whole = values.slice(0, int(stops[-1]))
                if len(stops) < len(whole):
                    whole = pc.binary_join(pa.ListArray.from_arrays(np.concatenate([[0], stops]).astype(np.int32), whole), form.end)
                if kept:
                    whole = pa.concat_arrays([pa.array([form.end.join([*kept, whole[0].as_py()])], pa.string()), whole.slice(1)])
                kept = values.slice(int(stops[-1])).to_pylist()
                kinds = np.full(len(whole), RECORD, dtype=np.int32)
                if crossed:
                    kinds[0], crossed = HEAD, False
                if skip:
                    present = np.flatnonzero(np.asarray(pc.not_equal(pc.utf8_trim_whitespace(whole), "")))
                    if len(present):
                        whole, kinds, skip = whole.slice(int(present[0]) + 1), kinds[int(present[0]) + 1 :], False
                if len(whole):
                    yield rows(whole, kinds)
        yield from rest()

    given = lines.select("value", F.xxhash64("file").alias("file"), "start")
    return given.mapInArrow(put, "file long, start long, kind int, value string")


def _joined(fragments: DataFrame, form: Format) -> DataFrame:
    """Records out of their fragments: a tail, any inner parts, and the head of the last range."""
    later = F.col("kind").isin(TAIL, FIRST)
    order = Window.partitionBy("file").orderBy("start", later.cast("int"))
    numbered = fragments.withColumn("number", F.sum(later.cast("int")).over(order)).withColumn("later", later)
    parts = F.array_sort(F.collect_list(F.struct("start", "later", "value")))
    grouped = numbered.groupBy("file", "number").agg(
        F.array_join(F.transform(parts, lambda p: p["value"]), form.end).alias("value"),
        F.max((F.col("kind") == FIRST).cast("int")).alias("first"),
        F.max((F.col("kind") == HEAD).cast("int")).alias("ended"),
    )
    return grouped.where("first = 0")


@dataclass
class Records:
    """All records of some files: `whole` lie within a range, `crossing` across ranges; both as (file, value, ended).

    What a file ends with, if no record, is among the crossing ones, `ended` being false.
    """

    whole: DataFrame
    crossing: DataFrame
    files: int

    @property
    def all(self) -> DataFrame:
        return self.whole.unionByName(self.crossing)


def records(spark: SparkSession, paths: list[str], form: Format, header: bool = False) -> Records:
    """The records of the files as text, without the first one of each if that is its header.

    Records are kept in the shared folder, since readers look at them twice at least: for types, then for values.
    """
    found = [(r["file"], r["start"], r["state"]) for r in ranges(spark, paths, form).collect()]
    pieces = cut_lineage(_pieces(_lines(spark, paths, form), form, States.of(found), header), "records")
    whole = pieces.where(F.col("kind") == RECORD).select("file", "value", F.lit(True).alias("ended"))
    crossing = _joined(pieces.where(F.col("kind") != RECORD), form).select("file", "value", (F.col("ended") == 1).alias("ended"))
    return Records(whole, crossing, len({f for f, _, _ in found}))


def with_paths(spark: SparkSession, paths: list[str], rows: DataFrame) -> DataFrame:
    """The files' paths in `path`, in place of their hashes in `file`; only the listing is read for them."""
    listed = spark.read.format("binaryFile").load(paths).select(F.col("_metadata.file_path").alias("path"))
    return rows.join(listed.withColumn("file", F.xxhash64("path")), "file").drop("file")


# --- formats ----------------------------------------------------------------------------------------------


def split_csv(
    spark: SparkSession, paths: list[str], columns: list[str], sep: str, bad_record: str, options: dict[str, str],
    with_path: bool = False,
) -> DataFrame:
    """Rows of delimited files with a header: every column as text, `bad_record` for ragged rows, and `__path` if wanted.

    Records end with a line feed, with or without a carriage return before it. A field that is never closed holds the rest of the file.
    """
    value = F.col("value")
    bare = F.replace(F.left(value, F.length(value) - 1), F.lit("\r\n"), F.lit("\n"))
    text = records(spark, paths, Delimited(sep), header=True).all.withColumn("value", F.when(value.endswith("\r"), bare).otherwise(value))
    schema = ", ".join(f"{_quoted(c)} string" for c in [*columns, bad_record])
    parsed = F.from_csv("value", schema, {**options, "columnNameOfCorruptRecord": bad_record})
    rows = text.where(F.trim("value") != "").select(parsed.alias("__row"), "file")
    if not with_path:
        return rows.select("__row.*")
    return with_paths(spark, paths, rows).select("__row.*", F.col("path").alias("__path"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _object(value: Column) -> Column:
    """The object of an element without what stands before it; anything else stays as it is, and is no JSON."""
    return F.when(value.rlike(r"^\s*[\[,]\s*\{"), F.concat(F.ltrim(F.regexp_replace(value, r"^\s*[\[,]", "")), F.lit("}"))).otherwise(value)


def json_records(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, value): the records of files that hold one array each, a line each.

    Line breaks between the tokens of a record become spaces; strings cannot hold them. Something that is no record stays in its line;
    a file whose array is not closed is an error.
    """
    found = records(spark, paths, JsonArray())
    end = ~F.col("ended") & F.col("value").rlike(r"^\s*\[?\s*\]\s*$")
    closed = found.crossing.where(end).select("file").distinct().count()
    if closed < found.files:
        raise ValueError(f"{found.files - closed} files end with something that is not a JSON record")
    text = F.when(F.col("ended"), _object(F.col("value"))).otherwise(F.col("value"))
    return found.all.where(~end).select("file", F.translate(text, "\r\n", "  ").alias("value"))


def split_json(spark: SparkSession, paths: list[str]) -> str:
    """A folder of JSON lines with the records of files that hold one array each."""
    folder = shared_path(spark, "json-lines")
    json_records(spark, paths).select("value").write.text(folder)
    return folder
