"""Mixture-controlled packing: deficit round-robin over source queues fills every window to target token proportions.

Each source is a queue of its documents' ids, in the order of the table's partitions. A window takes from every queue what its quantum and the
deficit it carries allow, and hands what is left of the window to the queues that are owed most; the rest of a document
goes on in the next window. Without weights the target is each source's share of all tokens, which holds to the last window; with
weights, queues that end leave their part to the others.

Windows are worked off in blocks, one task each. Where a block begins follows from the numbers of tokens alone: in a fluid
schedule, which serves all queues at once in proportion to their weights, every block boundary has a time, and a queue's whole tokens served by then are behind the
boundary. So a task knows its part of each queue, its place among the windows (one may begin in a block and end in the next) and the
deficits that the blocks before it leave. It holds `block` windows of ids, whatever the size of a source or text.

Padding: only the last window can be short; it becomes sequences of falling powers of two, which need no padding, so there is none.

At most `queues` sources have a queue of their own, the largest; others share one. A null source is a source. A null or empty text is a document of its
end id alone, texts of any length are cut freely, rows without an id and repeated rows are packed like others, an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bytetokens import encoder, vocabulary_path
from larkspur.llm.common import KEY_BITS, Scratch, field, lean, running_sums, slices, table
from larkspur.llm.tokens import CHUNK_BYTES

SEQUENCE = 2048
END_ID = 1
#: Windows of a block: about a million ids, whose arrays one task holds.
BLOCK = 512
QUEUES = 256
#: Bytes of ids that a partition of blocks may have.
PART_BYTES = 64_000_000

DOCUMENTS = "part int, number int, source string, id long, n long, inside long, ids binary"
SEGMENTS = "block long, queue int, position long, id long, start long, n long, ids binary"
PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


# --- documents as ids -------------------------------------------------------------------------------------


def encoded(df: DataFrame, text: str, key: str, source: str, vocabulary: str, end_id: int) -> DataFrame:
    """Documents as ids, two bytes each if the vocabulary allows.

    `part` and `number` name the task and the source within it; `inside` counts the ids of that source before the document in its task.
    """

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part = encoder(vocabulary), TaskContext.get().partitionId()
        kind, sources, before = id_kind(max(coder.size, end_id + 1)), {}, {}
        for rows in (s for batch in batches for s in slices(batch, CHUNK_BYTES)):
            flat, lengths = coder(rows.column("text"))
            flat, lengths = np.insert(flat, np.cumsum(lengths), end_id).astype(kind), lengths + 1
            numbers, inside = [], []
            for name, length in zip(rows.column("source").to_pylist(), lengths.tolist(), strict=True):
                number = sources.setdefault(name, len(sources))
                numbers.append(number)
                inside.append(before.get(number, 0))
                before[number] = inside[-1] + length
            ids = [b.tobytes() for b in np.split(flat, np.cumsum(lengths)[:-1])] if len(lengths) else []
            arrays = [
                pa.array([part] * len(ids), pa.int32()), pa.array(numbers, pa.int32()), rows.column("source"), rows.column("id"),
                pa.array(lengths, pa.int64()), pa.array(inside, pa.int64()), pa.array(ids, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in DOCUMENTS.split(", ")])

    named = df.select(
        field(key).cast("long").alias("id"), field(text).cast("string").alias("text"), field(source).cast("string").alias("source")
    )
    return named.mapInArrow(encode, DOCUMENTS)


def id_kind(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


# --- the schedule -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Schedule:
    """What every block serves of each queue: tokens and weight by queue, and the number of blocks; integers of any size."""

    tokens: tuple[int, ...]
    weights: tuple[int, ...]
    blocks: int

    @cached_property
    def total(self) -> int:
        return sum(self.tokens)

    @cached_property
    def ends(self) -> tuple[list[Fraction], list[int], list[int], list[Fraction]]:
        """Queues by the time they end: that time, tokens of those ended before, weight of the rest, all tokens served at that time."""
        order = sorted(range(len(self.tokens)), key=lambda q: Fraction(self.tokens[q], self.weights[q]))
        times = [Fraction(self.tokens[q], self.weights[q]) for q in order]
        ended = [0, *accumulate(self.tokens[q] for q in order)]
        weight = [sum(self.weights) - w for w in [0, *accumulate(self.weights[q] for q in order)]]
        served = [ended[j] + weight[j] * t for j, t in enumerate(times)]
        return times, ended, weight, served

    def fluid(self, block: int) -> list[Fraction]:
        """Tokens of each queue that a fluid schedule has served when the block begins."""
        _, ended, weight, served = self.ends
        goal = Fraction(block * self.total, self.blocks)
        j = bisect_right(served, goal)
        if not weight[j]:
            return [Fraction(t) for t in self.tokens]
        time = (goal - ended[j]) / weight[j]
        return [min(Fraction(t), w * time) for t, w in zip(self.tokens, self.weights, strict=True)]

    def served(self, block: int) -> list[int]:
        """Whole tokens of each queue before the block."""
        return [int(f) for f in self.fluid(block)]

    def block_of(self, queue: int, position: np.ndarray) -> np.ndarray:
        """Blocks of the tokens at these positions of a queue: the last one that begins with no more than these served."""
        times, ended, weight, _ = self.ends
        own = self.weights[queue]
        limits = [-(-t.numerator * own // t.denominator) for t in times]  # the token that is served when a queue ends
        after = [int(p) + 1 for p in position]
        at = [bisect_right(limits, p) for p in after]
        goals = [ended[j] * own + weight[j] * p for j, p in zip(at, after, strict=True)]
        return np.array([(g * self.blocks - 1) // (self.total * own) for g in goals], dtype=np.int64)


def rooms(start: int, end: int, total: int, window: int) -> list[tuple[int, int, int]]:
    """(sequence, offset, room) of all windows between two positions; the short one at the very end falls into powers of two."""
    bounds, at = [], start
    whole = total // window * window
    while at < min(end, whole):
        stop = min(end, whole, at // window * window + window)
        bounds.append((at // window, at % window, stop - at))
        at = stop
    tail, sequence, rest = whole, total // window, total % window
    while rest and tail < end:
        size = 1 << (rest.bit_length() - 1)
        low, high = max(tail, start), min(tail + size, end)
        if low < high:
            bounds.append((sequence, low - tail, high - low))
        tail, sequence, rest = tail + size, sequence + 1, rest - size
    return bounds


def round_robin(budget: np.ndarray, weights: np.ndarray, owed: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Tokens of each window (rows) from each queue (columns).

    `owed` are the deficits at the start. A queue's quantum is its weight's part of the room; it sends whole tokens as far as its
    deficit and budget go. The rest of the room goes round, one token each, to the queues that are owed most.
    """
    left, owed = budget.astype(np.int64), owed.astype(np.float64)
    taken = np.zeros((len(room), len(budget)), dtype=np.int64)
    for w, size in enumerate(room.tolist()):
        open_weights = np.where(left > 0, weights, 0.0)
        owed = owed + size * open_weights / open_weights.sum()
        take = np.minimum(np.floor(np.maximum(owed, 0)).astype(np.int64), left)
        while (over := int(take.sum()) - size) > 0:  # queues that are ahead leave less to the others
            back = np.argsort(owed - take, kind="stable")
            take[back[take[back] > 0][:over]] -= 1
        while (rest := size - int(take.sum())) > 0:
            turn = np.argsort(take - owed, kind="stable")
            take[turn[take[turn] < left[turn]][:rest]] += 1
        left -= take
        owed -= take
        taken[w] = take
    return taken


# --- blocks -----------------------------------------------------------------------------------------------


def segments(documents: DataFrame, schedule: Schedule, size: int) -> DataFrame:
    """Documents cut where blocks begin: block, queue, position in the queue, and the ids."""

    def split(rows: pa.RecordBatch) -> Iterator[tuple]:
        queue, position, n = (np.asarray(rows.column(c), dtype=np.int64) for c in ("queue", "position", "n"))
        first, last = np.empty(len(n), dtype=np.int64), np.empty(len(n), dtype=np.int64)
        for q in np.unique(queue).tolist():
            own = queue == q
            first[own], last[own] = schedule.block_of(q, position[own]), schedule.block_of(q, position[own] + n[own] - 1)
        bounds: dict[int, list[int]] = {}
        ids, names = rows.column("ids"), rows.column("id").to_pylist()
        for i, (q, p, length, a, b) in enumerate(zip(*(x.tolist() for x in (queue, position, n, first, last)), strict=True)):
            body = ids[i].as_py()
            for block in range(a, b + 1):
                for x in (block, block + 1):
                    if x not in bounds:
                        bounds[x] = schedule.served(x)
                low, high = max(p, bounds[block][q]), min(p + length, bounds[block + 1][q])
                if low < high:
                    yield block, q, low, names[i], low - p, length, body[(low - p) * size : (high - p) * size]

    @lean
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        for rows in (s for batch in batches for s in slices(batch, CHUNK_BYTES, "ids")):
            found = list(split(rows))
            if found:
                arrays = [pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    return documents.mapInArrow(cut, SEGMENTS)


def fill(block: pa.Table, schedule: Schedule, window: int, kind: str) -> pa.Table:
    """The pieces of one block's windows."""
    number = block.column("block")[0].as_py()
    fluid, start, end = schedule.fluid(number), schedule.served(number), schedule.served(number + 1)
    budget = np.array([e - s for s, e in zip(start, end, strict=True)], dtype=np.int64)
    weights = np.array([float(w) for w in schedule.weights])
    owed = np.array([float(f - s) for f, s in zip(fluid, start, strict=True)])
    moving = np.where(budget > 0, weights, 0)
    owed -= owed.sum() * moving / moving.sum()  # the boundary lies where whole tokens end, a little before the fluid's time
    place = rooms(sum(start), sum(end), schedule.total, window)
    sequence, first, room = (np.array(x, dtype=np.int64) for x in zip(*place, strict=True))
    taken = round_robin(budget, weights, owed, room)
    before = first[:, None] + np.cumsum(taken, axis=1) - taken  # where a queue's part of a window begins
    ordered = block.sort_by([("queue", "ascending"), ("position", "ascending")]).combine_chunks()
    queue, position, begin = (np.asarray(ordered.column(c), dtype=np.int64) for c in ("queue", "position", "start"))
    body = ordered.column("ids").combine_chunks()
    flat = np.frombuffer(b"".join(body.to_pylist()), dtype=kind).astype("<u4")
    row, length, at, offset = [], [], [], []
    for q in np.unique(queue).tolist():
        own = np.flatnonzero(queue == q)
        reach = start[q] + np.cumsum(taken[:, q])
        cuts = np.union1d(position[own], np.append(start[q], reach))[:-1]
        of = own[np.searchsorted(position[own], cuts, side="right") - 1]
        w = np.searchsorted(reach, cuts, side="right")
        row.append(of)
        length.append(np.diff(cuts, append=end[q]))
        at.append(np.stack([cuts - position[of] + begin[of], sequence[w]]))
        offset.append(before[w, q] + cuts - (reach[w] - taken[w, q]))
    row, length, at, offset = np.concatenate(row), np.concatenate(length), np.concatenate(at, axis=1), np.concatenate(offset)
    # pieces follow each other as the ids do
    bounds = np.concatenate([[0], np.cumsum(length) * 4]).astype(np.int32)
    ids = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(flat.tobytes())])
    taken_rows = ordered.select(["id", "n"]).take(pa.array(row)).combine_chunks()
    arrays = [
        taken_rows.column("id"), pa.array(at[0]), pa.array(length), taken_rows.column("n"), pa.array(at[1]), pa.array(offset), ids
    ]
    return pa.table(arrays, names=[x.split()[0] for x in PIECES.split(", ")])


# --- whole jobs -------------------------------------------------------------------------------------------


def queue_sizes(
    documents: DataFrame, weights: dict[str | None, int] | None, queues: int
) -> tuple[list[tuple[str | None, int]], list[int], list[int]]:
    """Sources with a queue of their own (name, queue), tokens by queue and weight by queue; the last queue is shared."""
    sizes = documents.groupBy("source").agg(F.sum("n").alias("n"))
    if weights is not None:
        named = sizes.where(F.col("source").isin([s for s in weights if s is not None]) | (F.col("source").isNull() & F.lit(None in weights)))
    else:
        named = sizes.orderBy(F.desc("n"), F.asc_nulls_first("source")).limit(queues - 1)
    own = sorted(((r["source"], r["n"]) for r in named.collect()), key=lambda x: (x[0] is None, x[0] or ""))
    rest = (documents.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in own)
    tokens = [n for _, n in own] + [rest] * (rest > 0)
    shares = list(tokens) if weights is None else [weights[s] for s, _ in own] + [1] * (rest > 0)
    return [(s, q) for q, (s, _) in enumerate(own)], tokens, shares


def pack_mixture(
    df: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: dict[str | None, int] | None = None,
    vocabulary: str | None = None, end_id: int = END_ID, window: int = SEQUENCE, block: int = BLOCK, queues: int = QUEUES,
) -> DataFrame:
    """Pieces of all documents (doc_id, start, length, doc_tokens) with their sequence, offset, and ids (unsigned 32-bit, little-endian).

    `weights` are positive whole numbers by source; sources without one share a queue of weight 1. Without `weights` every window
    gets the sources' shares of all tokens.
    """
    spark = df.sparkSession
    if weights is not None and len(weights) >= queues:
        raise ValueError(f"weights for {len(weights)} sources; at most {queues - 1} can have a queue of their own")
    vocabulary = vocabulary or vocabulary_path()
    kind = id_kind(max(encoder(vocabulary).size, end_id + 1))
    scratch = Scratch(spark, "mixpack")
    documents = scratch.keep(encoded(df, text, key, source, vocabulary, end_id))
    own, tokens, shares = queue_sizes(documents, weights, queues)
    if not tokens:
        return spark.createDataFrame([], PIECES)
    schedule = Schedule(tuple(tokens), tuple(shares), -(-sum(tokens) // (block * window)))
    # where each task's part of a queue begins: one row per task and source
    names = spark.createDataFrame(own or [("", -1)], "name string, queue int")  # fewer rows than `queues`
    parts = documents.groupBy("part", "number", "source").agg(F.sum("n").alias("n"))
    parts = parts.join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left").select(
        "part", "number", F.coalesce("queue", F.lit(len(tokens) - 1)).alias("queue"), "n"
    )
    count = 1 + (documents.agg(F.max("part")).first()[0] or 0)
    parts = scratch.keep(parts.withColumn("key", F.col("part").cast("long") * (2**KEY_BITS // count)))  # so that parts keep their order
    placed = running_sums(parts, parts, ["queue"], "key", ["number"], "n", "before", parts.count())
    placed = scratch.keep(placed.select("part", "number", "queue", "before"))
    positioned = documents.join(placed, ["part", "number"]).select(
        "id", "queue", (F.col("before") + F.col("inside")).alias("position"), "n", "ids"
    )
    size = np.dtype(kind).itemsize
    spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-schedule.total * size // PART_BYTES))
    dealt = segments(positioned, schedule, size).repartition(min(schedule.blocks, spread), "block")
    return dealt.groupBy("block").applyInArrow(lambda rows: fill(rows, schedule, window, kind), PIECES)


def op12_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in windows of 2048 ids, each with every source's share."""
    packed = pack_mixture(table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op12_mixture_packing": op12_mixture_packing}
ORACLE: dict[str, str] = {}
