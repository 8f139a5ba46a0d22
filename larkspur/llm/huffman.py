"""Token ids in files of canonical length-limited Huffman codes.

File format: a table whose rows are blocks. A block holds whole documents, in ascending id order, and can be
decoded alone: its documents' ids and lengths, the coded bits (most significant first, padded to whole 32-bit words, one word
spare), and the bit offset of every 256th id, so that a reader starts anywhere. `file` and `block` give the order, `first` the
ids of the file before the block. The code needs only the
length of every id's code word (a row of its own table), as canonical codes follow from the lengths.

Null texts are empty texts, so their documents hold the end id alone; null document ids come first. An empty table gives no blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, table
from larkspur.llm.tokens import encoder, vocabulary_path

END_ID = 2
BLOCK_IDS = 65_536
CHECKPOINT = 256
#: Code words are at most this long, or two bits more than a plain code of the ids in use needs.
SHORTEST_LIMIT = 12

RAW = "file int, block long, first long, doc_ids array<bigint>, lengths array<bigint>, ids binary"
CODED = "file int, block long, first long, doc_ids array<bigint>, lengths array<bigint>, bits binary, checkpoints binary"
RAW_NAMES, CODED_NAMES = ([x.split()[0] for x in schema.split(", ")] for schema in (RAW, CODED))


# --- the code ---------------------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, limit: int | None = None) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits, 0 for ids that do not occur (package-merge).

    Level by level, leaves and pairs of the level below are merged by weight; the cheapest 2n - 2 items of the top level
    say how many of the lightest leaves each level uses, and each use is one bit.
    """
    lengths = np.zeros(len(counts), dtype=np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        lengths[used] = 1
        return lengths
    limit = limit or max(SHORTEST_LIMIT, int(n - 1).bit_length() + 2)
    if n > 1 << limit:
        raise ValueError(f"{n} ids do not fit codes of {limit} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[used].astype(np.float64)
    levels, below = [], np.empty(0)
    for _ in range(limit):
        pairs = below[: len(below) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order < n)
        below = both[order]
    need, depth = 2 * n - 2, np.zeros(n, dtype=np.uint8)
    for is_leaf in reversed(levels):
        chosen = int(is_leaf[:need].sum())
        depth[:chosen] += 1
        need = 2 * (need - chosen)
    lengths[used] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code words in order of length, then id."""
    codes = np.zeros(len(lengths), dtype=np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        size = lengths[order].astype(np.int64)
        top = int(size[-1])
        room = np.left_shift(1, top - size)  # of the top-bit code space
        codes[order] = ((np.cumsum(room) - room) >> (top - size)).astype(np.uint64)
    return codes


class Decoder:
    """Looks up as many bits as the longest code has: the id, and how many of the bits are its own."""

    def __init__(self, lengths: np.ndarray):
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        size = lengths[order].astype(np.int64)
        self.bits = int(size[-1]) if len(order) else 1
        room = np.left_shift(1, self.bits - size)
        self.ids = np.zeros(1 << self.bits, dtype=np.int32)
        self.own = np.ones(1 << self.bits, dtype=np.int64)
        self.ids[: room.sum()] = np.repeat(order, room)
        self.own[: room.sum()] = np.repeat(size, room)

    def __call__(self, words: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of many runs at once: run i starts at bit offsets[i] of `words` and has counts[i] ids, at most 256."""
        out = np.empty((len(offsets), CHECKPOINT), dtype=np.int32)
        at, full = offsets.astype(np.int64), int(counts.min()) if len(counts) else 0
        wide, keep = words.astype(np.uint64), np.uint64((1 << self.bits) - 1)
        shift = np.uint64(64 - self.bits)
        live = np.arange(len(offsets))
        for i in range(int(counts.max()) if len(counts) else 0):
            if i >= full:
                still = counts[live] > i
                live, at = live[still], at[still]
            word = at >> 5
            both = (wide[word] << np.uint64(32)) | wide[word + 1]
            peek = ((both >> (shift - (at & 31).astype(np.uint64))) & keep).astype(np.int64)
            out[live, i] = self.ids[peek]
            at = at + self.own[peek]
        return out[np.arange(CHECKPOINT) < counts[:, None]]


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """The coded bits of a block and its checkpoints."""
    size = lengths[ids].astype(np.int64)
    reach = np.cumsum(size)
    at = reach - size
    total = int(reach[-1]) if len(reach) else 0
    words = np.zeros(total // 32 + 2, dtype=np.uint64)
    if total:
        shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)
        word = at >> 5
        first = np.flatnonzero(np.diff(word, prepend=-1))
        sums = np.add.reduceat(shifted, first)  # bits of different ids never overlap
        words[word[first]] += sums >> np.uint64(32)
        words[word[first] + 1] += sums & np.uint64(0xFFFFFFFF)
    return words.astype("<u4").tobytes(), at[::CHECKPOINT].astype("<u8").tobytes()


# --- jobs -------------------------------------------------------------------------------------------------


def raw_blocks(df: DataFrame, text: str, key: str, vocabulary: str, end_id: int, block_ids: int) -> DataFrame:
    """Texts in ascending id order, as blocks of uncoded ids."""

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file, block, before = encoder(vocabulary), TaskContext.get().partitionId(), 0, 0
        docs: list[int | None] = []
        sizes: list[np.ndarray] = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            lists = [pa.array([docs], pa.list_(pa.int64())), pa.array([np.concatenate(sizes)], pa.list_(pa.int64()))]
            body = np.concatenate(ids).astype("<u4").tobytes()
            place = [pa.array([file], pa.int32()), pa.array([block], pa.int64()), pa.array([before], pa.int64())]
            return pa.RecordBatch.from_arrays([*place, *lists, pa.array([body], pa.binary())], names=RAW_NAMES)

        for batch in batches:
            flat, lengths = encode(batch.column("text"))
            ends = np.cumsum(lengths)
            flat, lengths = np.insert(flat, ends, end_id), lengths + 1
            reach, names, first, done = np.cumsum(lengths), batch.column("id").to_pylist(), 0, 0
            while first < len(names):
                # documents up to the one that fills the block
                last = int(np.searchsorted(reach, done + block_ids - held)) + 1
                last = min(last, len(names))
                docs += names[first:last]
                sizes.append(lengths[first:last])
                ids.append(flat[done : reach[last - 1]])
                held += int(reach[last - 1]) - done
                first, done = last, int(reach[last - 1])
                if held >= block_ids:
                    yield flush()
                    block, before, held, docs, sizes, ids = block + 1, before + held, 0, [], [], []
        if docs:
            yield flush()

    named = df.select(field(key).cast("long").alias("id"), field(text).alias("text"))
    ordered = named.repartitionByRange("id", F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))
    return ordered.mapInArrow(tokenize, RAW)


def count_ids(blocks: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs: summed per task, then over tasks; the result is as long as the vocabulary."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for body in batch.column("ids"):
                found += np.bincount(np.frombuffer(body.as_buffer(), dtype="<u4"), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(found[at], pa.int64())], names=["id", "n"])

    rows = blocks.select("ids").mapInArrow(tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, dtype=np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def write_coded(
    df: DataFrame, path: str, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, end_id: int = END_ID,
    block_ids: int = BLOCK_IDS,
) -> None:
    """Encode all texts and write `path`/blocks and `path`/code."""
    spark, vocabulary = df.sparkSession, vocabulary or vocabulary_path()
    scratch = Scratch(spark, "ids")
    raw = scratch.keep(raw_blocks(df, text, key, vocabulary, end_id, block_ids), "zstd")
    counts = count_ids(raw, max(encoder(vocabulary).size, end_id + 1))
    lengths = code_lengths(counts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = canonical(lengths)
        for batch in batches:
            for i in range(batch.num_rows):
                bits, marks = encode_block(np.frombuffer(batch.column("ids")[i].as_buffer(), dtype="<u4"), codes, lengths)
                kept = [batch.column(c).slice(i, 1) for c in CODED_NAMES[:-2]]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([bits], pa.binary()), pa.array([marks], pa.binary())], names=CODED_NAMES)

    raw.mapInArrow(encode, CODED).write.option("compression", "none").parquet(f"{path}/blocks")
    scratch.drop(raw)
    code = [(lengths.tobytes(), CHECKPOINT)]
    spark.createDataFrame(code, "lengths binary, checkpoint int").coalesce(1).write.parquet(f"{path}/code")


def read_coded(spark: SparkSession, path: str) -> DataFrame:
    """Documents of such files: doc_id, start (ids before it), ids (unsigned 32-bit, little-endian) and n_tokens."""
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    code = spark.read.parquet(f"{path}/code").first()
    if code["checkpoint"] != CHECKPOINT:
        raise ValueError(f"checkpoints every {code['checkpoint']} ids")
    lengths = np.frombuffer(code["lengths"], dtype=np.uint8)
    # the driver gets one number per file
    ids = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    files = blocks.groupBy("file").agg(F.max(F.col("first") + ids).alias("n")).orderBy("file").collect()
    sums = np.cumsum([0, *(r["n"] for r in files)]).tolist()
    starts = spark.createDataFrame([(r["file"], s) for r, s in zip(files, sums, strict=False)], "file int, file_start long")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for batch in batches:
            for i in range(0, batch.num_rows, 16):
                yield from documents(batch.slice(i, 16), decoder)

    def documents(batch: pa.RecordBatch, decoder: Decoder) -> Iterator[pa.RecordBatch]:
        words, offsets, counts, base = [], [], [], 0
        sizes = [np.asarray(x.values, dtype=np.int64) for x in batch.column("lengths")]
        for i in range(batch.num_rows):
            part = np.frombuffer(batch.column("bits")[i].as_buffer(), dtype="<u4")
            words.append(part)
            marks = np.frombuffer(batch.column("checkpoints")[i].as_buffer(), dtype="<u8").astype(np.int64)
            offsets.append(marks + 32 * base)
            count = np.full(len(marks), CHECKPOINT, dtype=np.int64)
            count[-1] = sizes[i].sum() - CHECKPOINT * (len(marks) - 1)
            counts.append(count)
            base += len(part)
        ids = decoder(np.concatenate(words), np.concatenate(offsets), np.concatenate(counts)).astype("<u4")
        of = np.concatenate(sizes)
        reach = np.cumsum(of)
        body = [ids[a:b].tobytes() for a, b in zip(reach - of, reach, strict=True)]
        start = np.concatenate([f + np.cumsum(s) - s for f, s in zip(batch.column("start").to_pylist(), sizes, strict=True)])
        yield pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([x.values for x in batch.column("doc_ids")]),
                pa.array(start, pa.int64()),
                pa.array(of, pa.int64()),
                pa.array(body, pa.binary()),
            ],
            names=["doc_id", "start", "n_tokens", "ids"],
        )

    located = blocks.join(F.broadcast(starts), "file").withColumn("start", F.col("first") + F.col("file_start"))
    return located.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids binary")


def op3_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents' ids, as read back from the coded files."""
    path = Scratch(spark, "coded").root
    write_coded(table(spark, sf_dir, "documents"), path)
    return read_coded(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op3_huffman_ids": op3_huffman_ids}
ORACLE: dict[str, str] = {}
