"""Quality rules: a hashed n-gram likelihood ratio between a trusted sample and the whole corpus.

Word unigrams and bigrams fall into `BUCKETS` hash buckets. Two multinomials over the buckets are counted, one over the trusted
documents and one over all documents, each with one added to every count. A document's score is the mean log ratio of its n-grams, so
long and short texts compare; it is kept if the score is at least `THRESHOLD` and the base rules hold.

Everything is SQL functions. The trusted side is a bounded sample (`TRUSTED` documents with the smallest hashes among those
labelled good), whose ids are broadcast; the corpus side counts every n-gram of every document. The driver gets one number per bucket.

Null and empty texts have no words, fail the base rules, and score zero. Without trusted documents both multinomials differ only by
smoothing; with an empty table there are no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import SPACE, field, random_key, table

BUCKETS = 1 << 14
TRUSTED = 20_000
#: Mean log ratio; a document that is like the trusted ones lies near or over zero, junk well under it.
THRESHOLD = -0.07
MIN_WORDS = 50


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def ngram_buckets(words: Column, buckets: int) -> Column:
    """Buckets of all words and all pairs of neighbours. `words` must be a plain column: it is looked up for every pair."""
    one = F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(
        F.slice(words, 2, F.greatest(F.size(words), F.lit(1))),
        lambda w, i: F.pmod(F.xxhash64(F.get(words, i), w), F.lit(buckets)).cast("int"),
    )
    return F.concat(one, two)


def base_measures(df: DataFrame, text: str, words: str) -> DataFrame:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every row.

    Windows of three words are compared by hash. Only texts where a hash repeats sort their windows to find which.
    """
    body = F.coalesce(field(text), F.lit(""))
    w = field(words)
    lines = F.filter(F.split(body, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    windows = F.transform(
        F.slice(w, 3, F.greatest(F.size(w), F.lit(1))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x)
    )
    found = df.withColumns(
        {
            "n_words": F.size(w).cast("long"),
            "word_chars": (F.length(body) - F.regexp_count(body, F.lit(SPACE))).cast("long"),
            "n_symbols": F.regexp_count(body, F.lit(r"[#*$%&|<>]")).cast("long"),
            "__lines": lines,
            "__windows": windows,
        }
    )
    pairs = F.sort_array(F.transform("__windows", lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    some = F.size(F.array_distinct("__windows")) < F.size("__windows")
    found = found.withColumns(
        {
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
            "__sorted": F.when(some, pairs).otherwise(none),
        }
    ).drop("__lines", "__windows")
    at = F.col("__sorted")
    again = F.filter(at, lambda e, i: (F.get(at, i - 1)["h"] == e["h"]) | F.coalesce(F.get(at, i + 1)["h"] == e["h"], F.lit(False)))
    covered = F.flatten(F.transform(again, lambda e: F.array(e["i"], e["i"] + 1, e["i"] + 2)))
    return found.withColumn("n_repeat_words", F.size(F.array_distinct(covered)).cast("long")).drop("__sorted")


def trusted_ids(labels: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` ids of documents labelled good."""
    good = labels.where("quality = 1").select(field(key).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return good.orderBy(random_key("trusted", F.col("id")), "id").limit(most)


def log_ratios(df: DataFrame, trusted: DataFrame, text: str, key: str, buckets: int) -> str:
    """log(trusted / corpus) of every bucket, comma-separated."""
    marked = df.select(field(key).cast("long").alias("id"), words_of(field(text)).alias("words"))
    marked = marked.join(F.broadcast(trusted.withColumn("good", F.lit(1))), "id", "left")
    grams = marked.select(F.coalesce("good", F.lit(0)).alias("good"), F.explode(ngram_buckets(F.col("words"), buckets)).alias("bucket"))
    # one row per task and bucket moves, however often a bucket occurs
    counts = grams.groupBy("bucket").agg(F.count("*").alias("corpus"), F.sum("good").alias("target"))
    every = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    full = every.join(F.broadcast(counts), "bucket", "left").na.fill(0, ["corpus", "target"])
    one = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("bucket", "corpus", "target"))), lambda x: F.concat_ws(":", x["corpus"], x["target"])), ",")
    sums = full.agg(one.alias("all"), F.sum("corpus").alias("corpus"), F.sum("target").alias("target"))
    ratio = F.transform(
        F.split("all", ","),
        lambda x: F.log((F.split_part(x, F.lit(":"), F.lit(2)).cast("double") + 1) / (F.col("target") + buckets))
        - F.log((F.split_part(x, F.lit(":"), F.lit(1)).cast("double") + 1) / (F.col("corpus") + buckets)),
    )
    return sums.select(F.array_join(F.transform(ratio, lambda x: x.cast("string")), ",")).first()[0]


def judge(
    df: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", buckets: int = BUCKETS, trusted: int = TRUSTED,
    threshold: float = THRESHOLD,
) -> DataFrame:
    """All rows with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score and kept."""
    weights = F.split(F.lit(log_ratios(df, trusted_ids(labels, key, trusted), text, key, buckets)), ",").cast("array<double>")
    held = df.select(F.struct(*[field(c) for c in df.columns]).alias("__row"), field(text).alias("__text"))
    held = held.withColumn("__words", words_of(F.col("__text")))
    measured = base_measures(held, "__text", "__words")
    measured = measured.withColumn("__grams", ngram_buckets(F.col("__words"), buckets))
    total = F.aggregate("__grams", F.lit(0.0), lambda a, b: a + F.get(weights, b))
    count = F.size("__grams")
    measured = measured.withColumn("score", F.when(count > 0, total / count).otherwise(F.lit(0.0)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured = measured.withColumn("base_failed", failed)
    measured = measured.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= threshold))
    new = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    # a filter on the verdict stays above this step: pushed below, it would repeat every measure for each use of it
    closed = measured.select("__row", F.explode(F.array(F.struct(*new))).alias("__found"))
    return closed.select(*[F.col("__row")[c].alias(c) for c in df.columns if c not in new], "__found.*")


def op2_likelihood_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base measures and verdict for every document."""
    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score"
    )


QUERIES = {"op2_likelihood_ratio": op2_likelihood_ratio}
ORACLE: dict[str, str] = {}
