"""Language-model scores by a hashed maximum-entropy model with a class-factored softmax.

P(word | history) = P(class | history) P(word | class). The frequent words and the end are classes of their own; all others are dealt to
`SURFACES` classes by their last two letters, so a word's class is known without a table. P(class | history) is a softmax over
the summed weights of hashed features: the word before, the word before that (a skip feature), and both (an n-gram feature), and a bias.
Within a class of many words, bits of the word's hash lead down levels of at most `FAN` branches, as many as the counted vocabulary asks for; at every
level a softmax over the branches sums weights of the same hashed features, taken together with the node, and the branches' logarithmic
counts. Words of one leaf (`PER_LEAF` on average at most, up to `MOST_BITS` bits) have their shares of its tokens. A Good-Turing share of a class is kept for words never
seen.

Training counts all words of all training documents, then takes `ROUNDS` rounds of gradient steps that each use their own part of
the training documents, all of them once: tasks step through their documents in batches from common weights, and the weights' changes
are averaged by how often each feature was met. Scoring adds log probabilities in numpy batches. Words that are not frequent enough
for the table that tasks hold (`TABLE` words at most) are counted by a join.

A word is known by 58 bits of its hash and its class. Null texts are empty and have the end alone; a null id counts as training.
Without training documents the model is uniform over classes. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, lean, table

SURFACES = 64
CLASSES = 128
#: Weights per kind of feature; words that tasks hold a table of; tokens of one gradient step; rounds; and the step.
FEATURES = 4096
TABLE = 300_000
STEP_TOKENS = 4096
ROUNDS = 2
RATE = 0.5
BLOCK = 512
#: Tokens, of all rounds, for a training task of its own; and from which on there are more tasks than cores.
LEAST_GROUP = 4_000_000
MOST_GROUP = 32_000_000
#: Tokens whose logits stay in a core's cache; largest logit whose exponential is taken as it is, and least odds; rows summed one by one when so few are left.
NEAR = 512
REACH = 80
LEAST = np.finfo(np.float32).tiny
FEW = 16
#: Branches of a node within a class, in bits; words of a leaf on average; most bits of all levels (a table of 64 MB); bits of the rows of weights a kind.
FAN_BITS = 6
FAN = 1 << FAN_BITS
PER_LEAF = 2
MOST_BITS = 18
INNER_BITS = (12, 14)
#: Bytes of text whose words are counted at once, and whose tokens are trained on or scored at once.
CHUNK_BYTES = 4_000_000
MODEL_BYTES = 1_000_000
#: Leaves whose sums move as one row.
LEAVES = 1 << 16

END, BEFORE = np.int64(SURFACES), np.int64(2 * SURFACES)
ROWS = 3 * FEATURES + 1
_MIX = np.uint64(0x9E3779B97F4A7C15)


# --- tokens -----------------------------------------------------------------------------------------------


def _slices(batch: pa.RecordBatch, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    reach = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column("text")), 0), dtype=np.int64))
    cuts = (np.searchsorted(reach, np.arange(most, reach[-1], most)) + 1).tolist() if len(reach) else []
    bounds = sorted({0, *cuts, batch.num_rows})
    return (batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False))


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, the key number of every token (each text closes with the end), and tokens per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = pc.list_flatten(lists).dictionary_encode()
    lower = pc.ascii_lower(coded.dictionary)
    words = lower.to_numpy(zero_copy_only=False)
    if len(words):
        last = pc.utf8_slice_codeunits(lower, -2).dictionary_encode()
        surface = pd.util.hash_array(last.dictionary.to_numpy(zero_copy_only=False), categorize=False)[np.asarray(last.indices)] % np.uint64(SURFACES)
        keys = (pd.util.hash_array(words, categorize=False) & ~np.uint64(2 * SURFACES - 1)) | surface
        keys = np.where(keys < np.uint64(4 * SURFACES), keys + np.uint64(4 * SURFACES), keys).view(np.int64)
    else:
        keys = np.empty(0, dtype=np.int64)
    code = np.asarray(coded.indices, dtype=np.int64)
    of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    real = (words != "")[code] if len(words) else np.empty(0, dtype=bool)
    code, of = code[real], of[real]
    counts = np.bincount(of, minlength=len(texts))
    code = np.insert(code, np.cumsum(counts), len(keys))
    keys, again = np.unique(np.append(keys, END), return_inverse=True)  # words that differ in case alone are one
    return keys, again[code], counts + 1


class Tables:
    """What tasks hold: frequent words with counts, words with a class of their own, shares within classes, and tokens of each leaf."""

    def __init__(
        self, frequent: np.ndarray, counts: np.ndarray, own: np.ndarray, per_class: np.ndarray, unseen: np.ndarray, total: int, kinds: int, leaves: np.ndarray
    ):
        self.frequent, self.counts, self.own = frequent, counts, own  # sorted keys, their counts, sorted keys with own classes
        self.per_class, self.unseen = per_class, unseen
        self.total, self.scale = total, np.log10(total + 0.5 * (kinds + 1))
        self.leaves, self.levels = leaves, levels_for(kinds)
        self.bits = sum(self.levels)
        self.inner = 1 << min(max(INNER_BITS[0], int(np.ceil(np.log2(max(kinds, 1) / 16)))), INNER_BITS[1])
        # logarithmic counts of the branches of all nodes, level by level; a branch without words is next to impossible
        self.priors = []
        for level, own_bits in enumerate(self.levels):
            sums = leaves.reshape(SURFACES << sum(self.levels[: level + 1]), -1).sum(axis=1).reshape(-1, 1 << own_bits)
            self.priors.append(np.log(np.maximum(sums, 1e-26)).astype(np.float32))

    def classes(self, keys: np.ndarray) -> np.ndarray:
        """Class of each distinct key: its own, or that of its surface."""
        found = (keys & (SURFACES - 1)).astype(np.int64)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, keys), len(self.own) - 1)
            found = np.where(self.own[at] == keys, SURFACES + at, found)
        return found

    def count(self, keys: np.ndarray) -> np.ndarray:
        """Count of each distinct key, -1 if it is not in the table."""
        if not len(self.frequent):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.frequent, keys), len(self.frequent) - 1)
        return np.where(self.frequent[at] == keys, self.counts[at], -1)

    def within(self, keys: np.ndarray, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 of (1 - unseen share) P(word | leaf) of words that were seen."""
        share = (1 - self.unseen[classes]) * counts / np.maximum(self.leaves[nodes(keys, self.bits)], 1)
        return np.log10(np.where(classes >= SURFACES, 1.0, np.maximum(share, 1e-300)))


def levels_for(kinds: int) -> list[int]:
    """Bits of the branches of each level within a class, for so many distinct words."""
    bits = min(max(1, int(np.ceil(np.log2(max(kinds, 1) / (SURFACES * PER_LEAF))))), MOST_BITS)
    return [min(FAN_BITS, bits - at) for at in range(0, bits, FAN_BITS)]


def nodes(keys: np.ndarray, bits: int) -> np.ndarray:
    """Node of each key: its surface, then so many of the highest bits of its hash."""
    found = keys & (SURFACES - 1)
    if bits:
        found = (found << bits) | (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
    return found


def contexts(keys: np.ndarray, code: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """The three features of every token, as hashes."""
    first = np.cumsum(counts) - counts
    value = keys[code].view(np.uint64)
    one, two = np.roll(value, 1), np.roll(value, 2)
    one[first] = np.uint64(BEFORE)
    two[first] = np.uint64(BEFORE)
    second = first[counts > 1] + 1
    two[second] = np.uint64(BEFORE + 1)
    return [mixed(one), mixed(two ^ np.uint64(0x5BD1E995)), mixed(one * np.uint64(3) + two * _MIX)]


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    x ^= x >> np.uint64(31)
    return x * _MIX


def histories(features: list[np.ndarray]) -> np.ndarray:
    """Rows of the weights of classes."""
    return np.stack([(x >> np.uint64(40)).astype(np.int64) % FEATURES + kind * FEATURES for kind, x in enumerate(features)]).T


def branches(tables: Tables, features: list[np.ndarray], keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each level within classes: rows of the inner weights, logarithmic counts of the branches, and the branch taken, of every token."""
    at = 0
    for level, bits in enumerate(tables.levels):
        node = nodes(keys, at)
        at += bits
        salt = (node + (level + 1) * 0x632BE5AB).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        # tables.inner is a power of two
        rows = [(mixed(x ^ salt) >> np.uint64(40)).astype(np.int64) & (tables.inner - 1) for x in features]
        yield np.stack([x + kind * tables.inner for kind, x in enumerate(rows)]).T, node, nodes(keys, at) & ((1 << bits) - 1)


def picked(weights: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """The first `width` weights of some rows."""
    if width == weights.shape[1]:
        return weights.take(rows, axis=0)
    return heads(weights, width)[rows].view(weights.dtype).reshape(-1, width)


def heads(weights: np.ndarray, width: int) -> np.ndarray:
    """The first `width` weights of each row as one value, which numpy moves as a whole."""
    return np.ndarray(len(weights), np.dtype((np.void, weights.itemsize * width)), weights, 0, weights.strides[:1])


def branch_logits(weights: np.ndarray, rows: np.ndarray, priors: np.ndarray, node: np.ndarray) -> np.ndarray:
    found = priors.take(node, axis=0)
    for kind in range(3):
        found += picked(weights, rows[:, kind], priors.shape[1])
    return found


def class_logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    found = weights.take(rows[:, 0], axis=0)
    found += weights.take(rows[:, 1], axis=0)
    found += weights.take(rows[:, 2], axis=0)
    found += weights[-1]
    return found


def log_softmax(logits: np.ndarray) -> np.ndarray:
    logits -= logits.max(axis=1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(axis=1, keepdims=True))
    return logits


def softmax(logits: np.ndarray, out: np.ndarray, scale: float = 1.0) -> None:
    """Probabilities times `scale`. Rows are lowered by their largest logit if their exponentials leave single precision."""
    with np.errstate(over="ignore"):
        sums = np.einsum("ij->i", np.exp(logits, out=out))
    if len(sums) and not (sums.min() > 1e-30 and sums.max() < 1e30):
        sums = np.einsum("ij->i", np.exp(logits - logits.max(axis=1, keepdims=True), out=out))
    out *= (np.float32(scale) / sums)[:, None]


class Odds:
    """What scoring looks up: exponentials of all weights, taken once. The odds of a token's classes, and of a node's branches, are products of rows.

    Where a product could leave single precision, logits are added up instead.
    """

    def __init__(self, weights: list[np.ndarray], tables: Tables):
        self.weights, self.priors = weights, tables.priors
        # a branch without words counts 1e-26, which is in reach of any other branch of its node, or is no word's
        self.classes = self.inner = self.nodes = None
        if 4 * np.abs(weights[0]).max() < REACH:
            self.classes = np.exp(weights[0])
            self.classes[2 * FEATURES : 3 * FEATURES] *= self.classes[-1]
        if 3 * np.abs(weights[1]).max() + max(x.max() for x in tables.priors) < REACH:
            inner = np.exp(weights[1])
            self.inner = [np.ascontiguousarray(inner[:, : x.shape[1]]) for x in tables.priors]
            self.nodes = [np.exp(x) for x in tables.priors]

    def class_logs(self, rows: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """log P(class | history)."""
        if self.classes is None:
            return log_softmax(class_logits(self.weights[0], rows))[np.arange(len(goal)), goal]
        return goal_logs([self.classes.take(rows[:, kind], axis=0) for kind in range(3)], goal)

    def branch_logs(self, level: int, rows: np.ndarray, node: np.ndarray, goal: np.ndarray) -> np.ndarray:
        """log P(branch | node, history)."""
        if self.inner is None:
            return log_softmax(branch_logits(self.weights[1], rows, self.priors[level], node))[np.arange(len(goal)), goal]
        return goal_logs([self.nodes[level].take(node, axis=0), *(self.inner[level].take(rows[:, kind], axis=0) for kind in range(3))], goal)


def goal_logs(factors: list[np.ndarray], goal: np.ndarray) -> np.ndarray:
    """Log probability of one column of each row, from factors of the odds; these are used up."""
    found, last, at = factors[0], factors[-1], np.arange(len(goal))
    for x in factors[1:-1]:
        found *= x
    return np.log(np.maximum(found[at, goal] * last[at, goal], LEAST)) - np.log(np.maximum(np.einsum("ij,ij->i", found, last), LEAST))


def path_logs(odds: Odds, tables: Tables, features: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """log P(leaf | class, history) of every token."""
    logs = np.zeros(len(keys))
    for a in range(0, len(keys), STEP_TOKENS):
        part = slice(a, a + STEP_TOKENS)
        for level, (rows, node, goal) in enumerate(branches(tables, [x[part] for x in features], keys[part])):
            for b in range(0, len(goal), NEAR):
                at = slice(b, b + NEAR)
                logs[a + b : a + b + len(goal[at])] += odds.branch_logs(level, rows[at], node[at], goal[at])
    return logs


def learn(weights: np.ndarray, met: np.ndarray, rows: np.ndarray, classes: np.ndarray, rate: float) -> None:
    """Gradient steps over the tokens, in place; `met` counts how often each row was used."""
    room = np.empty((STEP_TOKENS, weights.shape[1]), dtype=weights.dtype)
    for a in range(0, len(rows), STEP_TOKENS):
        part, goal = rows[a : a + STEP_TOKENS], classes[a : a + STEP_TOKENS]
        steps = room[: len(part)]
        for b in range(0, len(part), NEAR):
            softmax(class_logits(weights, part[b : b + NEAR]), steps[b : b + NEAR], -rate / 5)
        steps[np.arange(len(part)), goal] += rate / 5
        descend(weights, met, part, steps)
        weights[-1] += 0.5 * steps.mean(axis=0)
        met[-1] += len(part)


def descend(weights: np.ndarray, met: np.ndarray, rows: np.ndarray, steps: np.ndarray) -> None:
    """A step of the first weights, as many as columns, of all three kinds of features. `steps` are those of tokens whose row is met once."""
    width = steps.shape[1]
    used, times, slope = row_sums(rows.T.ravel(), steps)  # each kind has rows of its own
    again = int(np.searchsorted(-times, -1))
    slope[:again] *= (5 / (times[:again] + 4)).astype(np.float32)[:, None]
    slope += picked(weights, used, width)
    whole = heads(weights, width)
    whole[used] = slope.view(whole.dtype)[:, 0]
    met[used] += times


def by_counting(numbers: np.ndarray) -> np.ndarray:
    """Stable order of numbers from 0; numpy sorts 16 bits by counting."""
    return np.argsort(numbers.astype(np.uint16) if len(numbers) and numbers.max() < 1 << 16 else numbers, kind="stable")


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the most frequent first, how often each occurs, and the sums of its values. `rows` may go over the values several times."""
    order = by_counting(rows)
    dealt, order = rows[order], order % max(len(values), 1)
    start = np.flatnonzero(np.append(True, dealt[1:] != dealt[:-1])) if len(rows) else np.empty(0, dtype=np.int64)
    times = np.diff(np.append(start, len(rows)))
    often = by_counting(len(rows) - times)
    start, times = start[often], times[often]
    sums = values.take(order[start], axis=0)
    # rows that occur again are the first ones, so each further occurrence is added to a shorter head
    shorter = np.searchsorted(-times, -np.arange(1, times[0])).tolist() if len(times) else []
    for again, head in enumerate(shorter, start=1):
        if head < FEW:
            for place in range(head):
                sums[place] += values.take(order[start[place] + again : start[place] + times[place]], axis=0).sum(axis=0)
            break
        sums[:head] += values.take(order[start[:head] + again], axis=0)
    return dealt[start], times, sums


def learn_within(weights: np.ndarray, met: np.ndarray, tables: Tables, features: list[np.ndarray], keys: np.ndarray, rate: float) -> None:
    """Gradient steps for the branches within classes, in place."""
    for a in range(0, len(keys), STEP_TOKENS):
        part = slice(a, a + STEP_TOKENS)
        for level, (rows, node, goal) in enumerate(branches(tables, [x[part] for x in features], keys[part])):
            priors = tables.priors[level]
            steps = np.empty((len(goal), priors.shape[1]), dtype=weights.dtype)
            for b in range(0, len(goal), NEAR):
                at = slice(b, b + NEAR)
                softmax(branch_logits(weights, rows[at], priors, node[at]), steps[at], -rate / 5)
            steps[np.arange(len(goal)), goal] += rate / 5
            descend(weights, met, rows, steps)


# --- jobs -------------------------------------------------------------------------------------------------


def count_words(training: DataFrame) -> DataFrame:
    """(key, n): how often each token occurs in the training texts."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _slices(batch):
                keys, code, _ = tokens(part.column("text"))
                times = np.bincount(code, minlength=len(keys))
                kept = times > 0
                yield pa.RecordBatch.from_arrays([pa.array(keys[kept]), pa.array(times[kept])], names=["key", "n"])

    return training.select("text").mapInArrow(lean(tally), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))


def make_tables(counts: DataFrame, most: int) -> tuple[Tables, int]:
    """Tables for the tasks, and the count from which on words are in them.

    The driver gets one row per eighth of a power of two, then the words over the count that this gives: `most` at most.
    """
    level = F.floor(F.log2("n") * 8).cast("int")
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("kinds"), F.sum("n").alias("total"), F.min("n").alias("least"))
    held, least, total, kinds = 0, None, 0, 0
    for row in levels.orderBy(F.desc("level")).collect():
        total, kinds, held = total + row["total"], kinds + row["kinds"], held + row["kinds"]
        if held <= most:
            least = row["least"]
    least = least or 1 << 62
    rows = counts.where(F.col("n") >= least).toArrow().sort_by("key")
    frequent, times = (rows.column(c).to_numpy().astype(np.int64) for c in ("key", "n"))
    order = np.lexsort((frequent, -times))
    words = order[frequent[order] != END][: CLASSES - SURFACES - 1]
    own = np.sort(np.append(frequent[words], END))
    alone = counts.where(~F.col("key").isin([int(k) for k in own]))
    sums = alone.groupBy(F.pmod("key", F.lit(SURFACES)).cast("int").alias("c"))
    sums = sums.agg(F.sum("n").alias("n"), F.sum((F.col("n") == 1).cast("long")).alias("once")).collect()
    per_class, once = np.zeros(CLASSES), np.zeros(CLASSES)
    for row in sums:
        per_class[row["c"]], once[row["c"]] = row["n"], row["once"]
    unseen = np.minimum((once + 0.5) / (per_class + 1), 0.5)
    unseen[SURFACES:] = 0
    at = np.searchsorted(frequent, own)
    for number, (key, place) in enumerate(zip(own, at, strict=True)):
        if place < len(frequent) and frequent[place] == key:
            per_class[SURFACES + number] = times[place]
    bits = sum(levels_for(kinds))
    leaves = leaf_sums(alone, bits)
    return Tables(frequent, times, own, per_class, unseen, total, kinds, leaves), least


def leaf_sums(counts: DataFrame, bits: int) -> np.ndarray:
    """Tokens of every leaf. Tasks put `LEAVES` neighbours into one row of floats, so the driver gets 4 bytes a leaf and no row for each."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            leaf, n = np.asarray(batch.column("leaf")), np.asarray(batch.column("n"))
            for block in np.unique(leaf // LEAVES).tolist():
                mine = leaf // LEAVES == block
                blocks.setdefault(block, np.zeros(LEAVES))
                np.add.at(blocks[block], leaf[mine] % LEAVES, n[mine])
        for block, sums in blocks.items():
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([sums.astype("<f4").tobytes()], pa.binary())], names=["block", "sums"])

    summed = counts.groupBy(leaf_of(F.col("key"), bits).alias("leaf")).agg(F.sum("n").alias("n"))
    dealt = summed.repartition(F.floor(F.col("leaf") / LEAVES)).mapInArrow(put, "block long, sums binary")
    leaves = np.zeros(max(SURFACES << bits, LEAVES), dtype=np.float32)
    for batch in dealt.toArrow().to_batches():
        for block, sums in zip(batch.column("block").to_pylist(), batch.column("sums"), strict=True):
            leaves[block * LEAVES : (block + 1) * LEAVES] = np.frombuffer(sums.as_buffer(), dtype="<f4")
    return leaves[: SURFACES << bits]


def leaf_of(key: Column, bits: int) -> Column:
    """nodes(key, bits) of keys in a table."""
    return F.pmod(key, F.lit(SURFACES)) * (1 << bits) + F.shiftrightunsigned(key, 64 - bits)


def groups_for(total: int, cores: int) -> int:
    """Tasks that train at once on `total` tokens: all cores, unless that leaves less than `LEAST_GROUP` a task; more where `MOST_GROUP` asks for them.

    Each sends its changes of all weights, so what a round moves follows the tokens, not the number of files or partitions.
    """
    return max(1, min(cores, total // LEAST_GROUP), total // MOST_GROUP)


def train_round(training: DataFrame, weights: list[np.ndarray], tables: Tables, rate: float) -> list[np.ndarray]:
    """New weights (of classes, and within them) after one pass over `training`: all tasks start from `weights`; changes are averaged by use."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, met = [w.copy() for w in weights], [np.zeros(len(w), dtype=np.int64) for w in weights]
        for batch in batches:
            for part in _slices(batch, MODEL_BYTES):
                keys, code, counts = tokens(part.column("text"))
                features, goal = contexts(keys, code, counts), tables.classes(keys)[code]
                learn(own[0], met[0], histories(features), goal, rate)
                many = goal < SURFACES
                learn_within(own[1], met[1], tables, [x[many] for x in features], keys[code[many]], rate)
        for number in range(len(weights)):
            for block in range(0, len(weights[number]), BLOCK):
                at = slice(block, block + BLOCK)
                if met[number][at].any():
                    change = (own[number][at] - weights[number][at]).astype(kinds[number])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([met[number][at].astype("<i8").tobytes()], pa.binary())],
                        names=["number", "block", "change", "met"],
                    )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], list[np.ndarray]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                at, met = (row["number"], row["block"]), np.frombuffer(row["met"], dtype="<i8")
                change = np.frombuffer(row["change"], dtype=kinds[row["number"]]).astype(np.float64)
                parts = change.reshape(len(met), -1) * met[:, None], met
                sums[at] = [a + b for a, b in zip(sums[at], parts, strict=True)] if at in sums else list(parts)
        for (number, block), (change, met) in sums.items():
            arrays = [pa.array([number], pa.int32()), pa.array([block], pa.int32()), pa.array([change.tobytes()], pa.binary()), pa.array([met.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["number", "block", "change", "met"])

    kinds = "<f4", "<f2"  # the larger table's changes move as halves
    schema = "number int, block int, change binary, met binary"
    blocks = training.select("text").coalesce(groups_for(tables.total, training.sparkSession.sparkContext.defaultParallelism)).mapInArrow(lean(step), schema)
    # sums are taken as batches come; a block is one vector, whatever the number of tasks
    new = [w.copy() for w in weights]
    for batch in blocks.repartition("number", "block").mapInArrow(add, schema).toArrow().to_batches():
        for number, block, total, times in zip(*(batch.column(c) for c in ("number", "block", "change", "met")), strict=True):
            met = np.frombuffer(times.as_buffer(), dtype=np.int64)
            change = np.frombuffer(total.as_buffer()).reshape(len(met), -1)
            at = slice(block.as_py(), block.as_py() + len(met))
            new[number.as_py()][at] += (change / np.maximum(met, 1)[:, None]).astype(np.float32)
    return new


def score_texts(df: DataFrame, weights: list[np.ndarray], tables: Tables) -> DataFrame:
    """id, held_out, n_tokens, what is known of n_known, base_score and score, and the words that are not in the table.

    `rare` lists such words' keys, `times` how often each occurs, `paths` the sum of log10 (1 - unseen share) P(leaf | class, history) / tokens of the
    leaf of these: what a word that was seen lacks is its count.
    """

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        odds = Odds(weights, tables)
        for batch in batches:
            for part in _slices(batch, MODEL_BYTES):
                keys, code, counts = tokens(part.column("text"))
                classes, times = tables.classes(keys), tables.count(keys)
                inside = times >= 0
                base = np.where(inside, np.log10(np.maximum(times, 0) + 0.5) - tables.scale, 0.0)
                word = np.where(inside, tables.within(keys, classes, np.maximum(times, 1)), 0.0)
                features, goal = contexts(keys, code, counts), classes[code]
                rows = histories(features)
                logs = np.empty(len(code))
                for a in range(0, len(code), NEAR):
                    logs[a : a + NEAR] = odds.class_logs(rows[a : a + NEAR], goal[a : a + NEAR])
                many, paths = goal < SURFACES, np.zeros(len(code))
                paths[many] = path_logs(odds, tables, [x[many] for x in features], keys[code[many]]) / np.log(10)
                of = np.repeat(np.arange(part.num_rows), counts)
                sums = [np.bincount(of, weights=w, minlength=part.num_rows) for w in (inside[code], base[code], word[code] + logs / np.log(10) + np.where(inside[code], paths, 0.0))]
                # the other words of each text, each once
                far = ~inside[code]
                pairs, again, many = np.unique(of[far] * len(keys) + code[far], return_inverse=True, return_counts=True)
                leaf = np.log10((1 - tables.unseen[classes]) / np.maximum(tables.leaves[nodes(keys, tables.bits)], 1))
                path = np.bincount(again, weights=paths[far] + np.where(classes < SURFACES, leaf, 0.0)[code[far]], minlength=len(pairs))
                ends = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(keys)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"),
                        part.column("held_out"),
                        pa.array(counts, pa.int64()),
                        pa.array(sums[0].astype(np.int64)),
                        pa.array(sums[1]),
                        pa.array(sums[2]),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[pairs % len(keys)])),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(many.astype(np.int64))),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(path)),
                    ],
                    names=["id", "held_out", "n_tokens", "n_known", "base_score", "score", "rare", "times", "paths"],
                )

    schema = (
        "id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<bigint>, times array<bigint>, paths array<double>"
    )
    return df.mapInArrow(lean(judge), schema)


def is_held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 1, F.lit(False))


def score(
    df: DataFrame, text: str = "text", key: str = "doc_id", rounds: int = ROUNDS, rate: float = RATE, most: int = TABLE
) -> DataFrame:
    """One row per row of `df`: the key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    scratch = Scratch(spark, "maxent")
    rows = df.select(field(key).cast("long").alias("id"), field(text).alias("text"), is_held_out(field(key)).alias("held_out"))
    training = rows.where("NOT held_out")
    counts = scratch.keep(count_words(training))
    tables, least = make_tables(counts, most)
    weights = [np.zeros((ROWS, CLASSES), dtype=np.float32), np.zeros((3 * tables.inner, FAN), dtype=np.float32)]
    weights[0][-1] = np.log((tables.per_class + 1) / (tables.per_class.sum() + CLASSES))
    for turn in range(rounds):
        weights = train_round(training.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == turn), weights, tables, rate)

    # numbers are drawn once, as the table is written
    judged = scratch.keep(score_texts(rows, weights, tables).withColumn("row", F.monotonically_increasing_id()))
    pairs = judged.select("row", F.explode(F.arrays_zip("rare", "times", "paths")).alias("w"))
    pairs = pairs.select("row", F.col("w.rare").alias("key"), F.col("w.times").alias("times"), F.col("w.paths").alias("path"))
    # frequent words are not among these, so no key has more rows than a rare word's count allows
    joined = pairs.join(counts.where(F.col("n") < least), "key", "left")
    shares = spark.createDataFrame([(i, float(tables.unseen[i])) for i in range(SURFACES)], "c int, unseen double")
    classed = joined.withColumn("c", F.pmod("key", F.lit(SURFACES)).cast("int")).join(F.broadcast(shares), "c")
    seen = F.coalesce("n", F.lit(0))
    inside = F.when(F.col("key") == int(END), 1.0).when(seen > 0, seen).otherwise(F.col("unseen"))
    path = F.when(seen > 0, F.col("path")).otherwise(0.0)
    added = classed.groupBy("row").agg(
        F.sum(F.when(seen > 0, F.col("times")).otherwise(0)).alias("more_known"),
        F.sum(F.col("times") * (F.log10(seen + 0.5) - F.lit(float(tables.scale)))).alias("more_base"),
        F.sum(F.col("times") * F.log10(inside) + path).alias("more_score"),
    )
    whole = judged.drop("rare", "times", "paths").join(added, "row", "left").na.fill(0, ["more_known", "more_base", "more_score"])
    return whole.select(
        F.col("id").alias(key),
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.col("more_known")).alias("n_known"),
        F.lit(int(tables.total)).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.col("more_base")).alias("base_score"),
        (F.col("score") + F.col("more_score")).alias("score"),
    )


def op8_maxent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents."""
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op8_maxent_scores": op8_maxent_scores}
ORACLE: dict[str, str] = {}
