"""Quality classifier from weak labels.

Heuristic labellers look at every document and say good, bad, or nothing. A document's votes are a pattern, and only the number of
documents of each pattern matters, so expectation-maximisation runs over all documents on a table of at most
3 ** len(LABELLERS) rows: it estimates each labeller's accuracy on good and on bad documents and how common bad ones
are. The posterior of a document's pattern is its label in the training of a linear scorer over hashed words and word shapes:
distributed gradients over a bounded sample (`SAMPLE` documents with the smallest hashes). All documents are scored.

Null and empty texts get votes for good only (nothing in them is odd), have no features, and score by the bias alone. Repeated rows score alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import Scratch, field, lean, random_key, slices, table

BUCKETS = 1 << 14
SAMPLE = 20_000
STEPS = 15
RATE = 0.3
RIDGE = 1e-6
THRESHOLD = 0.5
FALSE_ALARMS = 0.002
CHUNK_BYTES = 2_000_000

#: Labellers: measure, bad from (at least), good up to (at most); between the two they say nothing.
LABELLERS = (
    ("bare_marks", 0.08, 0.01),  # words without a letter or digit
    ("symbols", 0.04, 0.005),  # share of characters that are symbols
    ("capitals", 0.50, 0.12),  # share of letters that are capital
    ("same_again", 0.10, 0.02),  # words equal to the one before
    ("loud_ends", 0.10, 0.02),  # words that end in two marks or more
    ("top_word", 0.30, 0.15),  # share of the most frequent word
    ("few_words", 0.85, 0.75),  # words that occurred before in the text
    ("unended", 0.995, 0.97),  # words without a full stop or comma at their end
)


# --- words of a batch -------------------------------------------------------------------------------------


class Words:
    """Words of texts as numbers into the distinct ones, and each text's words."""

    def __init__(self, texts: pa.Array):
        lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        coded = pc.list_flatten(lists).dictionary_encode()
        self.distinct = coded.dictionary
        code = np.asarray(coded.indices, dtype=np.int64)
        of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
        empty = np.asarray(pc.equal(self.distinct, ""), dtype=bool) if len(self.distinct) else np.empty(0, dtype=bool)
        real = ~empty[code]
        self.code, self.of = code[real], of[real]
        self.texts = len(texts)
        self.counts = np.bincount(self.of, minlength=self.texts)

    def matches(self, pattern: str) -> np.ndarray:
        return np.asarray(pc.match_substring_regex(self.distinct, pattern), dtype=bool)

    def share(self, of_word: np.ndarray) -> np.ndarray:
        """Sum over each text's words of a number per distinct word."""
        return np.bincount(self.of, weights=of_word[self.code], minlength=self.texts)


def measures(words: Words) -> np.ndarray:
    """One row per text, one column per labeller."""
    n = np.maximum(words.counts, 1)
    distinct = words.distinct
    length = np.asarray(pc.utf8_length(distinct), dtype=np.float64)
    symbols = np.asarray(pc.count_substring_regex(distinct, r"[#*$%&|<>!]"), dtype=np.float64)
    capital = np.asarray(pc.count_substring_regex(distinct, r"\p{Lu}"), dtype=np.float64)
    letters = np.asarray(pc.count_substring_regex(distinct, r"\p{L}"), dtype=np.float64)
    same = (words.code[1:] == words.code[:-1]) & (words.of[1:] == words.of[:-1])
    again = np.bincount(words.of[1:][same], minlength=words.texts)
    pairs, times = np.unique(words.of * max(len(distinct), 1) + words.code, return_counts=True)
    top = np.zeros(words.texts)
    np.maximum.at(top, pairs // max(len(distinct), 1), times)
    few, enough = words.counts < 5, words.counts >= 20  # capitals and frequent words say little in short texts
    return np.stack(
        [
            words.share(~words.matches(r"[\p{L}\p{N}]")) / n,
            words.share(symbols) / np.maximum(words.share(length), 1),
            np.where(few, 0.2, words.share(capital) / np.maximum(words.share(letters), 1)),
            again / n,
            words.share(words.matches(r"[\p{L}\p{N}][!-/:-@\[-`{-~]{2,}$")) / n,
            np.where(enough, top / n, 0.2),
            np.where(enough, 1 - np.bincount(pairs // max(len(distinct), 1), minlength=words.texts) / n, 0.8),
            np.where(enough, 1 - words.share(words.matches(r"[.,]$")) / n, 0.98),
        ],
        axis=1,
    )


def votes(values: np.ndarray) -> np.ndarray:
    """1 for bad, -1 for good, 0 for nothing."""
    bad = values >= np.array([x[1] for x in LABELLERS])
    good = values <= np.array([x[2] for x in LABELLERS])
    return bad.astype(np.int8) - good.astype(np.int8)


def shapes(distinct: pa.Array) -> np.ndarray:
    """Words with every letter run as a or A and digit run as 0: what marks they carry, and how they are written."""
    out = pc.replace_substring_regex(distinct, r"\p{Lu}+", "A")
    out = pc.replace_substring_regex(out, r"[\p{Ll}\p{Lo}]+", "a")
    return pc.replace_substring_regex(out, r"[0-9]+", "0").to_numpy(zero_copy_only=False)


def features(words: Words, buckets: int) -> np.ndarray:
    """For each word of each text, the buckets of the word, of its shape, and of whether it is the word before again."""
    text = words.distinct.to_numpy(zero_copy_only=False)
    if not len(text):
        return np.empty((0, 3), dtype=np.int64)
    word = pd.util.hash_array(text, categorize=False) % np.uint64(buckets)
    shape = pd.util.hash_array(shapes(words.distinct) + "\x00", categorize=False) % np.uint64(buckets)
    same = np.zeros(len(words.code), dtype=np.int64)
    same[1:] = (words.code[1:] == words.code[:-1]) & (words.of[1:] == words.of[:-1])
    again = (pd.util.hash_array(np.array(["\x00new", "\x00again"], dtype=object), categorize=False) % np.uint64(buckets))[same]
    return np.stack([word[words.code], shape[words.code], again], axis=1).astype(np.int64)


# --- expectation-maximisation -----------------------------------------------------------------------------


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of "bad" for each pattern of votes, each labeller's P(vote | class), and the share of bad documents.

    Saying nothing is no evidence. A small prior keeps both votes possible. Starts from "any vote for bad", and holds labellers
    to few false alarms (`FALSE_ALARMS`): a kind of badness that few of them see would else pass as good.
    """
    total = max(float(counts.sum()), 1.0)
    one_hot = np.stack([patterns == v for v in (-1, 1)], axis=2).astype(np.float64)  # pattern, labeller, vote
    posterior = np.where((patterns > 0).any(axis=1), 0.95, 0.05)
    prior, likely = 0.5, np.full((2, patterns.shape[1], 2), 0.5)
    for _ in range(rounds):
        weight = np.stack([(1 - posterior) * counts, posterior * counts])
        prior = float(np.clip(weight[1].sum() / total, 1e-4, 1 - 1e-4))
        likely = np.einsum("cp,plv->clv", weight, one_hot) + 1e-4 * total
        likely /= likely.sum(axis=2, keepdims=True)
        likely[0, :, 1] = np.minimum(likely[0, :, 1], FALSE_ALARMS)
        likely[0, :, 0] = 1 - likely[0, :, 1]
        logs = np.einsum("plv,clv->cp", one_hot, np.log(likely)) + np.log([[1 - prior], [prior]])
        fresh = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -50, 50)))
        if np.abs(fresh - posterior).max(initial=0) < 1e-9:
            break
        posterior = fresh
    return posterior, likely, prior


# --- jobs -------------------------------------------------------------------------------------------------


def voted(df: DataFrame, text: str, key: str) -> DataFrame:
    """The pattern of votes (three to the power of the labeller, plus one) of every row, with the key."""
    powers = 3 ** np.arange(len(LABELLERS))

    @lean
    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CHUNK_BYTES):
                cast = votes(measures(Words(part.column("text")))).astype(np.int64) + 1
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(cast @ powers)], names=["id", "pattern"])

    return df.select(field(key).cast("long").alias("id"), field(text).alias("text")).mapInArrow(vote, "id long, pattern long")


def posteriors(patterns: DataFrame) -> dict[int, float]:
    """Posterior of "bad" for every pattern that occurs."""
    rows = patterns.groupBy("pattern").count().orderBy("pattern").collect()
    codes = np.array([r["pattern"] for r in rows], dtype=np.int64)
    counts = np.array([r["count"] for r in rows], dtype=np.float64)
    cast = codes[:, None] // 3 ** np.arange(len(LABELLERS)) % 3 - 1
    return dict(zip(codes.tolist(), estimate(cast, counts)[0].tolist(), strict=True)) if len(rows) else {}


def train(df: DataFrame, text: str, key: str, learned: dict[int, float], buckets: int, sample: int, steps: int) -> np.ndarray:
    """Weights of the hashed features and, last, the bias: full-batch gradients over the sample, summed over tasks."""
    spark = df.sparkSession
    scratch = Scratch(spark, "weaklabels")
    powers = 3 ** np.arange(len(LABELLERS))
    ids = df.select(field(key).cast("long").alias("id"), field(text).alias("text"), random_key("weak", field(key)).alias("r"))
    # a hash bound chosen for about `sample` rows is met before texts move; the sample is exact after it
    rows = df.count()
    bound = int(min(1.0, 1.3 * (sample + 100) / max(rows, 1)) * (1 << 60))
    chosen = ids.where(F.col("r") < bound).orderBy("r", "id").limit(sample).drop("r")

    @lean
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, CHUNK_BYTES):
                words = Words(part.column("text"))
                cast = (votes(measures(words)).astype(np.int64) + 1) @ powers
                found = features(words, buckets).astype("<i4")
                ends = np.cumsum(words.counts)
                body = [found[a:b].tobytes() for a, b in zip((ends - words.counts).tolist(), ends.tolist(), strict=True)]
                label = [learned.get(c, 0.5) for c in cast.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(body, pa.binary()), pa.array(label, pa.float64())], names=["body", "label"])

    kept = scratch.keep(chosen.select("text").repartition(8).mapInArrow(hashed, "body binary, label double"))
    weights, moment, spread = np.zeros(buckets + 1), np.zeros(buckets + 1), np.zeros(buckets + 1)
    for step in range(1, steps + 1):

        @lean
        def gradient(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            total, seen = np.zeros(buckets + 1), 0
            for batch in batches:
                sizes, flat = _flat(batch.column("body"))
                of = np.repeat(np.arange(batch.num_rows), sizes)
                per = 1 / np.maximum(sizes, 1)
                margin = np.bincount(of, weights=weights[flat], minlength=batch.num_rows) * per * SCALE + weights[-1]
                error = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) - np.asarray(batch.column("label"))
                total[:-1] += np.bincount(flat, weights=(error * per * SCALE)[of], minlength=buckets)
                total[-1] += error.sum()
                seen += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([seen], pa.int64())], names=["sum", "n"])

        parts = kept.mapInArrow(gradient, "sum binary, n long").collect()  # one vector of fixed length per task of the bounded sample
        count = max(sum(r["n"] for r in parts), 1)
        slope = sum((np.frombuffer(r["sum"]) for r in parts), np.zeros(buckets + 1)) / count + RIDGE * weights
        moment = 0.8 * moment + 0.2 * slope
        spread = 0.95 * spread + 0.05 * slope**2
        weights = weights - RATE * (moment / (1 - 0.8**step)) / (np.sqrt(spread / (1 - 0.95**step)) + 1e-6)
    scratch.drop(kept)
    return weights


#: Features are shares of a text's words and shapes; this makes them large enough to learn from.
SCALE = 10.0


def _flat(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.asarray(pc.binary_length(bodies), dtype=np.int64) // 4
    return sizes, np.frombuffer(b"".join(bodies.to_pylist()), dtype="<i4").astype(np.int64)


def classify(
    df: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, sample: int = SAMPLE, steps: int = STEPS,
    threshold: float = THRESHOLD, carry: list[str] | None = None,
) -> DataFrame:
    """All rows with `weak_label` (posterior of "good" from the votes), `score` (P(good) by the scorer) and `kept`.

    `carry` names the columns to return besides (all): they pass through the tasks that score, a text only once.
    """
    learned = posteriors(voted(df, text, key))
    weights = train(df, text, key, learned, buckets, sample, steps)
    powers = 3 ** np.arange(len(LABELLERS))
    new = ["weak_label", "score", "kept"]
    rest = [c for c in (df.columns if carry is None else carry) if c not in new]
    whole = text in rest
    held = df.select(F.struct(*[field(c) for c in rest]).alias("__row"), *([] if whole else [field(text).alias("text")]))

    @lean
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if whole:
                batch = batch.append_column("text", pc.struct_field(batch.column("__row"), rest.index(text)))
            for part in slices(batch, CHUNK_BYTES):
                words = Words(part.column("text"))
                cast = (votes(measures(words)).astype(np.int64) + 1) @ powers
                sums = np.bincount(words.of, weights=weights[features(words, buckets)].sum(axis=1), minlength=words.texts)
                margin = sums / np.maximum(3 * words.counts, 1) * SCALE + weights[-1]
                good = 1 / (1 + np.exp(np.clip(margin, -30, 30)))
                weak = [1 - learned.get(c, 0.5) for c in cast.tolist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__row"), pa.array(weak, pa.float64()), pa.array(good), pa.array(good >= threshold)],
                    names=["__row", *new],
                )

    schema = T.StructType([held.schema["__row"]])  # not as text, where names with dots or spaces would have to be quoted
    schema = schema.add("weak_label", "double").add("score", "double").add("kept", "boolean")
    judged = held.mapInArrow(judge, schema)
    return judged.select("__row.*", *new)


def op9_weak_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document."""
    return classify(table(spark, sf_dir, "documents"), carry=["doc_id"]).select("doc_id", "weak_label", "score", "kept")


QUERIES = {"op9_weak_labels": op9_weak_labels}
ORACLE: dict[str, str] = {}
