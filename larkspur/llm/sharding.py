"""Shards of near-equal bytes by histogram sort.

Rows are ordered by a hash of their text, then by a hash of the whole row, then by their place in the table, so equal texts
lie side by side. Splitters are found by counting: each pass counts the exact bytes and rows between evenly spaced probes inside
every bracket that still holds an unmet boundary, and keeps the probe's bracket around it, until a probe is near enough.
Then the rows move once. Brackets and splitters are sorted arrays that tasks search, however many there are.

Null ids are values like others, null texts count one byte; an empty table gives no rows. Rows that agree in all columns are told
apart by their place, so a boundary may fall between them; which of them lies on which side says nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, table, utf8_bytes

SHARDS = 8
#: Share of a shard that a boundary may be off, bytes of one task, and the most tasks: beyond 1 TB their bytes grow instead.
TOLERANCE = 0.01
TASK_BYTES = 32 << 20
MOST_PARTS = 1 << 15
#: Probes of a pass: this many, or so many for each goal if that is more. The driver gets one row for each.
PROBES, PROBES_PER_GOAL = 1 << 12, 8
HALF, WIDTH, PLACE_BITS = 1 << 63, 128, 24


def key_columns(df: DataFrame, text: str) -> tuple[Column, Column]:
    """The two halves of a row's key: hash of the text; hash of the row, whose last bits are those of its place."""
    plain = [field(f.name) for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    place = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << PLACE_BITS) - 1)
    return F.xxhash64(field(text)), F.xxhash64(*plain).bitwiseAND(-(1 << PLACE_BITS)).bitwiseOR(place)


def _sortable(hi: np.ndarray, lo: np.ndarray, shift: int = 0) -> np.ndarray:
    """Keys as 16 bytes whose order is that of the signed pairs; the last `shift` bits are cleared."""
    halves = np.empty((len(hi), 2), dtype=">u8")
    for i, (half, clear) in enumerate(((hi, max(0, shift - 64)), (lo, min(shift, 64)))):
        unsigned = np.asarray(half, dtype=np.int64).view(np.uint64) ^ np.uint64(HALF)
        halves[:, i] = (unsigned >> np.uint64(clear)) << np.uint64(clear) if clear < 64 else 0
    return halves.view("S16").ravel()


def _packed(keys: list[int]) -> np.ndarray:
    return np.array([k.to_bytes(16, "big") for k in keys], dtype="S16")


def count_probes(keys: DataFrame, prefixes: list[int], shift: int, step: int) -> Iterator[tuple[int, int, int, int]]:
    """(bracket, digit, bytes, rows) of the rows inside brackets, which are sorted prefixes of the key without its last `shift` bits.

    A digit is the next `step` bits; bits of one pass lie in one half of the key.
    """
    starts = _packed([p << shift for p in prefixes])
    half, last = (0, shift - step - 64) if shift > 64 else (1, shift - step)

    @F.pandas_udf("long")
    def probe(hi: pd.Series, lo: pd.Series) -> pd.Series:
        own = _sortable(hi.to_numpy(), lo.to_numpy(), shift)
        bracket = np.minimum(np.searchsorted(starts, own), len(starts) - 1)
        part = (hi, lo)[half].to_numpy().view(np.uint64) ^ np.uint64(HALF)
        digit = (part >> np.uint64(last)) & np.uint64((1 << step) - 1)
        return pd.Series(np.where(starts[bracket] == own, (bracket << step) + digit.astype(np.int64), -1))

    found = keys.select(probe("hi", "lo").alias("at"), "size").where("at >= 0")
    for row in found.groupBy("at").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect():
        yield row["at"] >> step, row["at"] & ((1 << step) - 1), row["bytes"], row["rows"]


def find_splitters(keys: DataFrame, goals: list[tuple[float, float]]) -> list[tuple[int, int]]:
    """For each goal (bytes below, bytes it may be off), in rising order: the smallest key on its right, and the rows below.

    `keys` has hi, lo and size. All open brackets of a pass are equally wide; together they have some PROBES probes.
    """
    found: dict[int, tuple[int, int]] = {}
    waiting = {0: list(range(len(goals)))} if goals else {}  # goals by the bracket they fall into
    below = {0: (0, 0)}  # bytes and rows below a bracket
    bits = (max(PROBES, PROBES_PER_GOAL * len(goals)) - 1).bit_length()
    shift = WIDTH
    while waiting:
        prefixes = sorted(waiting)
        step = min(max(1, bits - (len(prefixes) - 1).bit_length()), shift % 64 or 64)
        counts: dict[int, list[tuple[int, int, int]]] = {p: [] for p in prefixes}
        for bracket, digit, size, rows in count_probes(keys, prefixes, shift, step):
            counts[prefixes[bracket]].append((digit, size, rows))
        shift -= step
        inner, inner_below = {}, {}
        for prefix, members in waiting.items():
            digits, sizes, rows = (np.array(c, dtype=np.int64) for c in zip(*sorted(counts[prefix]), strict=True))
            high, high_rows = np.cumsum(sizes) + below[prefix][0], np.cumsum(rows) + below[prefix][1]
            for goal in members:
                target, off = goals[goal]
                # the bin that the goal falls into; a goal at the very end belongs to the last one
                i = min(int(np.searchsorted(high, target, side="right")), len(high) - 1)
                child, end, end_rows = (prefix << step) | int(digits[i]), int(high[i]), int(high_rows[i])
                low, low_rows = end - int(sizes[i]), end_rows - int(rows[i])
                key, size, before = (child, low, low_rows) if target - low <= end - target else (child + 1, end, end_rows)
                if abs(size - target) <= off or shift == 0:
                    found[goal] = (key << shift, before)
                else:
                    inner.setdefault(child, []).append(goal)
                    inner_below[child] = (low, low_rows)
        waiting, below = inner, inner_below
    return [found[i] for i in range(len(goals))]


def place(splitters: list[int]):
    """Number of splitters that a key has reached. One past the last key is reached by none."""
    edges = _packed([s for s in splitters if s >> WIDTH == 0])

    @F.pandas_udf("int")
    def part(hi: pd.Series, lo: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, _sortable(hi.to_numpy(), lo.to_numpy()), side="right").astype(np.int32))

    return part


def shard_by_bytes(
    df: DataFrame, shards: int = SHARDS, text: str = "text", tolerance: float = TOLERANCE, task_bytes: int = TASK_BYTES
) -> DataFrame:
    """All rows with `size` (UTF-8 bytes and one), `shard` and `slot` (place in the shard, from 0).

    Shards are cut into parts of about `task_bytes` (more if there would be over MOST_PARTS), so one task never holds a whole
    shard. A shard's bytes differ from the mean by `tolerance` and one row at most, also where ids, texts or whole rows repeat.
    Equal texts stay in one shard, unless their bytes exceed the tolerance where a boundary falls. Texts of any length are one
    row each. Columns named like the three new ones are replaced. `df` is computed once: rows are kept with their keys.
    """
    spark = df.sparkSession
    hi, lo = key_columns(df, text)
    row = F.struct(*[field(c) for c in df.columns])
    keyed = Scratch(spark, "shards").keep(df.select(row.alias("row"), hi.alias("hi"), lo.alias("lo"), (utf8_bytes(field(text)) + 1).alias("size")))
    keys = keyed.select("hi", "lo", "size")
    total = keys.agg(F.sum("size")).first()[0] or 0
    parts = max(1, min(-(-total // (shards * task_bytes)), MOST_PARTS // shards))
    share = total / (shards * parts)
    goals = [(share * i, min(share / 4, tolerance * total / shards)) for i in range(1, shards * parts)]
    splitters = find_splitters(keys, goals) if total else []
    starts = [0, *(rows for _, rows in splitters)]
    offsets = [(i, rows - starts[i - i % parts]) for i, rows in enumerate(starts)]  # rows of the shard before a part
    part = place([key for key, _ in splitters])("hi", "lo")
    moved = keyed.withColumn("part", part).repartitionById(len(starts), F.col("part"))
    order = Window.partitionBy("part").orderBy("hi", "lo")
    numbered = moved.withColumn("place", F.row_number().over(order) - 1)
    joined = numbered.join(F.broadcast(spark.createDataFrame(offsets, "part int, offset long")), "part")
    new = {
        "size": F.col("size"),
        "shard": F.floor(F.col("part") / parts).cast("int"),
        "slot": (F.col("offset") + F.col("place")).cast("long"),
    }
    kept = [F.col("row")[c].alias(c) for c in df.columns if c not in new]
    return joined.select(*kept, *[c.alias(n) for n, c in new.items()])


def op1_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    sharded = shard_by_bytes(table(spark, sf_dir, "documents"))
    return sharded.select(
        "doc_id",
        "size",
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op1_histogram_sort": op1_histogram_sort}
ORACLE: dict[str, str] = {}
