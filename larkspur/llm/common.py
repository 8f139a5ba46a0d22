"""What several operators share: words, tables, scratch space, and prefix sums in groups of any size."""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.session import shared_path

if TYPE_CHECKING:
    import pyarrow as pa

#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"

#: Random keys have this many bits.
KEY_BITS = 60


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """A column of that exact name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def n_words(text: Column) -> Column:
    """Number of words; none for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def random_key(salt: str, *values: Column) -> Column:
    """A repeatable 60-bit number in place of a random one; nulls count as empty."""
    parts = [F.coalesce(v.cast("string"), F.lit("")) for v in values]
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(salt), *parts)), 1, 15), 16, 10).cast("long")


def give_back() -> None:
    """Hand back the memory that Arrow and the C library keep for later."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The function over batches; at its end the worker hands back the memory that Arrow and the C library keep for later.

    Python workers live on between tasks and stages, beside a JVM that needs the room.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        give_back()

    return run


def slices(batch: pa.RecordBatch, most: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `most` bytes of text; a part ends with the text that passes a multiple of it."""
    import numpy as np
    import pyarrow.compute as pc

    reach = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    cuts = (np.searchsorted(reach, np.arange(most, reach[-1], most)) + 1).tolist() if len(reach) else []
    bounds = sorted({0, *cuts, batch.num_rows})
    return (batch.slice(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False))


class Scratch:
    """Intermediate tables in the shared folder, so that a lost executor costs no recompute."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark = spark
        self.root = shared_path(spark, purpose)

    def keep(self, df: DataFrame, compression: str = "lz4_raw") -> DataFrame:
        path = f"{self.root}/{uuid.uuid4().hex}"
        df.write.option("compression", compression).parquet(path)
        kept = self.spark.read.schema(df.schema).parquet(path)
        kept._scratch_path = path
        return kept

    def drop(self, kept: DataFrame) -> None:
        """Delete a table that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(kept._scratch_path)
        path.getFileSystem(conf).delete(path, True)


def bits_for(rows: int, per_bucket: int = 500, most: int = 20) -> int:
    """Bits of the key that deal `rows` rows to buckets of about `per_bucket`; over 2**most buckets they grow instead."""
    return min(most, max(0, math.ceil(math.log2(max(1, rows / per_bucket)))))


def running_sums(
    df: DataFrame, narrow: DataFrame, by: list[str], key: str, order: list[str], value: str, out: str, rows: int
) -> DataFrame:
    """Add the sum of `value` over a group's rows before each row, in the order of `key`, then `order`.

    A plain window would put a whole group into one task. The key is random with 60 bits, so its
    highest bits cut every group into ranges of like size: each range is summed, the sums of the ranges before
    are added up, and rows are ordered within their range alone. `narrow` has the same rows, for the sums.
    """
    cut = F.shiftright(field(key), KEY_BITS - bits_for(rows)).cast("int")
    before = Window.partitionBy(*by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = narrow.groupBy(*by, cut.alias("__bucket")).agg(F.sum(value).alias("__sum"))
    starts = sums.select(*by, "__bucket", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*by, "__bucket").orderBy(key, *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = df.withColumn("__bucket", cut).withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(starts, [*by, "__bucket"])
    return joined.withColumn(out, (F.col("__start") + F.col("__inside")).cast("long")).drop("__start", "__inside", "__bucket")
