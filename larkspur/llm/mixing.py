"""Mix sources to target weights.

Every row gets a hash of its id and text in place of a random key. Within each source the rows are ranged by that key, prefix sums of their sizes
are added up over the ranges, and the mix takes the rows before the source's budget: whole epochs first, then the rows
whose middle lies before what is left. So a source is off its budget by half a row at most, and reruns agree.

A null source is a source, the last one; a null text has no words. Rows without words take part but add nothing. Sources
are few enough for the driver (their weights are a setting); rows are not. Rows without an id, or with one id, have keys of their own
as long as their texts differ; rows that agree in both share a key, and those with more words come later, in any order among
equals, which have equal results in sum. An empty table gives no rows. Other columns stay, unless they are named like a new one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, n_words, random_key, running_sums, table

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
SALT = "mix-1"


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> dict[str | None, float]:
    """Words to take from each source: all sizes shared by weight, no source over `most` times its own.

    Sources follow each other by code point, null last, and take the weights in turn. What a source cannot take is shared
    again by weight; with the sources in order of size by weight this needs one walk.
    """
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode())  # UTF-8 keeps the order of code points
    names += [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, shares = sum(sizes.values()), sum(weight.values())
    found: dict[str | None, float] = {}
    for s in sorted(names, key=lambda s: sizes[s] / weight[s]):
        cap = most * sizes[s]
        if cap * shares <= weight[s] * left:
            found[s] = float(cap)
            left, shares = left - cap, shares - weight[s]
        else:
            found |= {x: weight[x] * left / shares for x in names if x not in found}
            break
    return found


def mix(
    df: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
    most: int = MOST_EPOCHS, salt: str = SALT,
) -> DataFrame:
    """All rows with `size` (words), `source_size`, `target`, `copies` (how often the mix takes the row) and `taken`."""
    spark = df.sparkSession
    ready = df.select(
        F.struct(*[field(c) for c in df.columns]).alias("row"),
        field(source).cast("string").alias("source"),
        n_words(field(text)).alias("size"),
        random_key(salt, field(key), field(text)).alias("key"),
        F.coalesce(field(key).cast("long"), F.lit(0)).alias("id"),
    )
    scratch = Scratch(spark, "mix")
    kept = scratch.keep(ready.drop("row"))  # for all sums; whole rows move only once, below
    totals = kept.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    sizes = {r["source"]: r["size"] for r in totals}
    wanted = targets(sizes, weights, most)
    config = []
    for number, (name, size) in enumerate(sizes.items()):
        epochs = min(most, int(wanted[name] // size)) if size else 0
        config.append((name, number, size, wanted[name], epochs, wanted[name] - epochs * size))
    schema = "name string, sid int, source_size long, target double, epochs int, rest double"
    plan = spark.createDataFrame(config, schema)
    # one row per source, which the driver holds already
    planned = [x.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("name"))).drop("name", "source") for x in (ready, kept)]
    summed = running_sums(*planned, ["sid"], "key", ["id", "size"], "size", "before", sum(r["n"] for r in totals))
    in_rest = (F.col("before") + F.col("size") / 2 <= F.col("rest")) & (F.col("rest") > 0)
    copies = F.col("epochs") + in_rest.cast("int")
    new = {
        "size": F.col("size"),
        "source_size": F.col("source_size"),
        "target": F.col("target"),
        "copies": copies,
        "taken": F.col("size") * copies,
    }
    return summed.select(*[F.col("row")[c].alias(c) for c in df.columns if c not in new], *[c.alias(n) for n, c in new.items()])


def repeated(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mix itself: each row as often as it is taken."""
    return mixed.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*map(field, columns))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes from every document."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {"op4_mix_sources": op4_mix_sources}
ORACLE = {
    "op4_mix_sources": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || coalesce(text, '')), 1, 15) AS BIGINT) AS key
  FROM documents),
sources AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sources),
ordered AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM ranked),
walked AS (
  SELECT *, CAST((SELECT sum(source_size) FROM sources) AS BIGINT)
      - coalesce(CAST(sum(3 * source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS left_over,
    CAST(sum(w) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS shares FROM ordered),
capped AS (SELECT *, 3 * source_size * shares <= w * left_over AS is_capped FROM walked),
edge AS (SELECT left_over, shares FROM capped WHERE NOT is_capped ORDER BY place LIMIT 1),
goals AS (
  SELECT source, source_size, CASE WHEN is_capped THEN CAST(3 * source_size AS DOUBLE)
    ELSE CAST(w * (SELECT left_over FROM edge) AS DOUBLE) / CAST((SELECT shares FROM edge) AS DOUBLE) END AS target FROM capped),
cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(3, CAST(floor(target / source_size) AS BIGINT)) ELSE 0 END AS epochs FROM goals),
summed AS (
  SELECT s.doc_id, s.size, c.source_size, c.target, c.epochs, c.target - c.epochs * c.source_size AS rest,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.key, coalesce(s.doc_id, 0), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN cut c ON s.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (epochs + CASE WHEN before + size / 2 <= rest AND rest > 0 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM summed"""
}
