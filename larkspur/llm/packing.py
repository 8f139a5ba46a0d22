"""Pack token pieces into sequences of a fixed length by a configuration linear program.

Only the number of pieces of each length matters, at most one number per length. A configuration says how many pieces of each length
share a sequence. Multiplicative weights solve the program that covers every piece with the fewest configurations: a knapsack dynamic
program over the prices gives, for every length, the best configuration that holds it; those within `NEAR` of the best of all are used
for their pieces, and the prices of what they cover shrink, until every length is covered exactly. Prices also bound the program
from below, so its gap is known; while it is over `GAP`, lengths in poor configurations gain weight and are covered anew. Rounding takes the whole part of every use, then once those with the largest
remainders while their pieces last; the program is solved anew for the rest, and what a solution's rounding cannot place any more is filled
largest first. So the program's work does not depend on the number of pieces.

Pieces are numbered within their length by prefix sums over ranges of a random key, a hash of id and text; the number tells the sequence
and the place in it.

A null or empty text is a document of its end id alone; a text of any length is cut into pieces. An empty table gives no rows. Rows that
agree in all columns are packed as separate pieces. Other columns than the id and the text are not read.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, field, give_back, lean, random_key, running_sums, slices, table
from larkspur.llm.tokens import encoder, vocabulary_path

SEQUENCE = 2048
END_ID = 0
RATE = 1.0  # how fast the price of a length falls as its pieces are covered
STEP = 1.0  # the share of a length's pieces that one use of a configuration covers at most
NEAR = 0.1  # configurations this close to the highest price are used before lengths are priced anew
GAP = 0.01  # the program is solved when its value is this close to its bound, or after so many passes
PASSES = 20
GAIN = 0.5  # how fast a length gains weight whose configurations are poor
MOST_TURNS = 40  # the program is solved at most this often for what rounding left

#: Bytes of text that are encoded together: a worker takes some 150 MB for these, beside a JVM that earlier stages have filled.
CHUNK_BYTES = 1_000_000

PIECES = "doc_id long, piece int, start long, length long, key long, ids binary"

log = logging.getLogger(__name__)


# --- pieces -----------------------------------------------------------------------------------------------


def pieces(
    df: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID,
    most: int = SEQUENCE,
) -> DataFrame:
    """Documents as ids with an end id; those of more than `most` ids are cut, the last piece being shorter.

    One row per piece: doc_id, piece, start, length, a random key, and its ids (unsigned 32-bit, little-endian).
    """
    vocabulary = vocabulary or vocabulary_path()

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for part in (p for batch in batches for p in slices(batch, CHUNK_BYTES)):
            flat, lengths = encode(part.column("text"))
            flat = np.insert(flat, np.cumsum(lengths), end_id).astype("<u4")
            lengths = lengths + 1
            count = -(-lengths // most)
            row = np.repeat(np.arange(len(lengths)), count)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * most
            length = np.minimum(lengths[row] - start, most)
            reach = np.cumsum(length)
            body = [flat[a:b].tobytes() for a, b in zip((reach - length).tolist(), reach.tolist(), strict=True)]
            arrays = [
                part.column("id").take(pa.array(row)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                part.column("key").take(pa.array(row)),
                pa.array(body, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in PIECES.split(", ")])
            give_back()

    named = df.select(field(key).cast("long").alias("id"), field(text).alias("text"), random_key("pack", field(key), field(text)).alias("key"))
    return named.mapInArrow(cut, PIECES)


# --- configurations ---------------------------------------------------------------------------------------


def best_within(lengths: np.ndarray, prices: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every room up to `room`: the highest price, the length taken last, and the part of the room that is used."""
    best = np.zeros(room + 1)
    choice, used = np.full(room + 1, -1), np.zeros(room + 1, dtype=np.int64)
    fits = np.searchsorted(lengths, np.arange(room + 1), side="right")  # lengths ascend
    for size in range(1, room + 1):
        best[size], used[size] = best[size - 1], used[size - 1]
        if fits[size]:
            values = best[size - lengths[: fits[size]]] + prices[: fits[size]]
            top = int(values.argmax())
            if values[top] > best[size]:
                best[size], choice[size], used[size] = values[top], top, size
    return best, choice, used


def knapsack(lengths: np.ndarray, prices: np.ndarray, room: int) -> np.ndarray:
    """How many of each length to take, as often as wished, for the highest price within `room`."""
    _, choice, used = best_within(lengths, prices, room)
    taken, size = np.zeros(len(lengths), dtype=np.int64), int(used[room])
    while size > 0:
        taken[choice[size]] += 1
        size = int(used[size - lengths[choice[size]]])
    return taken


@dataclass
class Solution:
    """Uses of configurations, as ((place of the length, pieces), ...), that cover every piece once; no program needs less than `bound`."""

    uses: dict[tuple[tuple[int, int], ...], float]
    bound: float

    @property
    def value(self) -> float:
        return sum(self.uses.values())

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def halves_bound(lengths: np.ndarray, counts: np.ndarray, room: int) -> float:
    """Prices that need no search: a piece that leaves less than a small length counts as a whole sequence, less than that as nothing."""
    best = 0.0
    for small in (0, *lengths[2 * lengths <= room].tolist()):
        whole, part = lengths > room - small, (lengths >= small) & (lengths <= room - small)
        best = max(best, float(counts[whole].sum() + counts[part] @ lengths[part] / room))
    return best


def fractional(lengths: np.ndarray, counts: np.ndarray, room: int, base: np.ndarray | None = None, gap: float = GAP) -> tuple[Solution, np.ndarray]:
    """The covering program by multiplicative weights: the solution and the weights it began with.

    Weights begin as `base`, or the lengths. After a pass that is not within `gap` of the bound, a length whose pieces lie in configurations
    of less than the highest price gains weight by that ratio, and the next pass begins from there.
    """
    base = lengths.astype(float) if base is None else base
    found, kept, least = None, base, halves_bound(lengths, counts, room)
    for _ in range(PASSES):
        solution = covering(lengths, counts, room, base)
        if found is None or solution.value < found.value:
            found, kept = Solution(solution.uses, max(solution.bound, found.bound if found else least)), base
        else:
            found.bound = max(found.bound, solution.bound)
        if found.gap <= gap:
            break
        highest = float(best_within(lengths, base, room)[0][room])
        short = np.zeros(len(lengths))
        for config, times in solution.uses.items():
            ratio = math.log(highest / sum(base[j] * n for j, n in config))
            for j, n in config:
                short[j] += ratio * n * times / counts[j]
        base = base * np.exp(GAIN * short)
    return found, kept


def covering(
    lengths: np.ndarray, counts: np.ndarray, room: int, base: np.ndarray, rate: float = RATE, step: float = STEP, near: float = NEAR
) -> Solution:
    """One pass of the covering program, from given weights.

    A length's price is its weight times exp(-rate * covered share), and nothing once it is covered. Prices only fall, so a configuration
    that is within `near` of an earlier highest price by the present prices is as near to the highest price now.
    """
    left, total = counts.astype(float), counts.astype(float)
    prices, whole, uses, bound = base.copy(), base.copy(), {}, 0.0
    while True:
        live = np.flatnonzero(left > 0)
        if not len(live):
            return Solution(uses, bound)
        best, choice, used = best_within(lengths[live], prices[live], room)
        # lengths that are covered cost nothing here; with the weights of all, the prices are a solution of the dual program
        highest = best[room] if len(live) == len(lengths) else best_within(lengths, whole, room)[0][room] if not uses else None
        if highest:
            bound = max(bound, float(total @ whole) / float(highest))
        found = []
        values = prices[live] + best[room - lengths[live]]
        for at in np.flatnonzero(values >= (1 - near) * values.max()).tolist():
            place = int(live[at])
            config, size = {place: 1}, int(used[room - lengths[place]])
            while size > 0:
                other = int(live[choice[size]])
                config[other] = config.get(other, 0) + 1
                size = int(used[size - lengths[other]])
            config = tuple(sorted((j, min(n, math.ceil(left[j]))) for j, n in config.items()))
            found.append((sum(prices[j] * n for j, n in config), at, config))
        found.sort(reverse=True)
        floor = (1 - near) * found[0][0]
        for _, _, config in found:
            if any(left[j] <= 0 for j, _ in config) or sum(prices[j] * n for j, n in config) < floor:
                continue
            times = min(min(left[j], max(step * total[j], min(1.0, total[j]))) / n for j, n in config)
            uses[config] = uses.get(config, 0.0) + times
            for j, n in config:
                left[j] -= times * n
                whole[j] = base[j] * math.exp(-rate * (1 - left[j] / total[j]))
                if left[j] < 1e-9 * total[j]:
                    left[j] = 0.0
                prices[j] = whole[j] if left[j] else 0.0


def filling(lengths: np.ndarray, left: np.ndarray, room: int) -> np.ndarray:
    """One sequence out of what is left, the largest piece first, then ever the largest that fits."""
    taken, at = np.zeros(len(lengths), dtype=np.int64), len(lengths) - 1
    while room > 0:
        at = min(at, int(np.searchsorted(lengths, room, side="right")) - 1)
        while at >= 0 and left[at] == taken[at]:
            at -= 1
        if at < 0:
            break
        number = min(int(left[at] - taken[at]), room // int(lengths[at]))
        taken[at] += number
        room -= number * int(lengths[at])
        at -= room > 0 and left[at] == taken[at]
    return taken


def rounded(solution: Solution, counts: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Whole uses: the whole part of each, then one more of those with the largest remainders, while their pieces last."""
    left, chosen = counts.copy(), {}
    uses = {config: math.floor(times + 1e-9) for config, times in solution.uses.items()}
    rests = sorted(solution.uses, key=lambda c: (uses[c] - solution.uses[c], c))
    for config, most in [*uses.items(), *((c, 1) for c in rests)]:
        times = min(most, *(int(left[j]) // n for j, n in config))
        if times > 0:
            chosen[config] = chosen.get(config, 0) + times
            for j, n in config:
                left[j] -= n * times
    found = []
    for config, times in chosen.items():
        dense = np.zeros(len(counts), dtype=np.int64)
        for j, n in config:
            dense[j] = n
        found.append((dense, times))
    return found


def configurations(lengths: np.ndarray, counts: np.ndarray, room: int = SEQUENCE) -> list[tuple[np.ndarray, int]]:
    """Whole configurations (pieces per length) and how many sequences use each; together they hold every piece."""
    left, chosen = counts.copy(), []
    total = filled = 0
    weights = None
    for turn in range(MOST_TURNS):
        live = np.flatnonzero(left)
        if not len(live):
            break
        if not turn:
            solution, weights = fractional(lengths, counts, room)
            log.info("configuration program: value %.1f, bound %.1f, gap %.4f", solution.value, solution.bound, solution.gap)
            # a sequence that leaves more room than the program does on average is better filled with what is left
            loose = room - float(left @ lengths) / solution.value
        else:
            solution = covering(lengths[live], left[live], room, weights[live])
        took = 0
        for part, times in rounded(solution, left[live]):
            if room - int(part @ lengths[live]) <= loose:
                config = np.zeros(len(lengths), dtype=np.int64)
                config[live] = part
                chosen.append((config, times))
                left = left - config * times
                took += times
        total += took
        if not took:
            break
    while left.any():
        config = filling(lengths, left, room)
        inside = config > 0
        times = int((left[inside] // config[inside]).min())
        chosen.append((config, times))
        left = left - config * times
        filled += times
    log.info("%d sequences of the program's configurations, %d filled largest first", total, filled)
    return chosen


def assignment(lengths: np.ndarray, chosen: list[tuple[np.ndarray, int]]) -> np.ndarray:
    """Rows (length, first number, times, first sequence, pieces per sequence, offset of the first), by length and number."""
    next_number, rows, sequence = np.zeros(len(lengths), dtype=np.int64), [], 0
    for config, times in chosen:
        offset = 0
        for at in np.flatnonzero(config)[::-1]:
            each = int(config[at])
            rows.append((int(lengths[at]), int(next_number[at]), times, sequence, each, offset))
            next_number[at] += each * times
            offset += each * int(lengths[at])
        sequence += times
    return np.array(sorted(rows), dtype=np.int64).reshape(-1, 6)


def pack(cut: DataFrame, room: int = SEQUENCE) -> DataFrame:
    """Pieces (with doc_id, piece, length and key) with the `sequence_id` and `offset` of each.

    The driver gets one count per length, and tasks get the assignment: at most a few rows per length and configuration.
    """
    spark = cut.sparkSession
    scratch = Scratch(spark, "pack")
    narrow = scratch.keep(cut.select("length", "key").withColumn("one", F.lit(1).cast("long")))
    found = narrow.groupBy("length").count().orderBy("length").collect()
    lengths = np.array([r["length"] for r in found], dtype=np.int64)
    counts = np.array([r["count"] for r in found], dtype=np.int64)
    plan = assignment(lengths, configurations(lengths, counts, room))
    many = int(counts.sum()) + 1
    bounds = plan[:, 0] * many + plan[:, 1]  # length, then number: one sorted line
    numbered = running_sums(
        cut.withColumn("one", F.lit(1).cast("long")), narrow, ["length"], "key", ["doc_id", "piece"], "one", "number", many
    ).drop("one", "key")

    @lean
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (np.asarray(batch.column(c), dtype=np.int64) for c in ("length", "number"))
            _, first, _, sequence, each, offset = plan[np.searchsorted(bounds, length * many + number, side="right") - 1].T
            over, within = np.divmod(number - first, each)
            new = [pa.array(sequence + over, pa.int64()), pa.array(offset + within * length, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "sequence_id", "offset"])

    new = [T.StructField(name, T.LongType()) for name in ("sequence_id", "offset")]
    schema = T.StructType([*numbered.schema.fields, *new])
    return numbered.mapInArrow(place, schema).drop("number")


def pack_documents(df: DataFrame) -> DataFrame:
    """Pieces of all documents with their ids and their places."""
    scratch = Scratch(df.sparkSession, "pieces")
    cut = scratch.keep(pieces(df))  # texts are encoded once
    return pack(cut).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids."""
    packed = pack_documents(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


QUERIES = {"op10_pack_sequences": op10_pack_sequences}
ORACLE: dict[str, str] = {}
