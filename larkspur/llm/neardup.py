"""Near duplicates: universal hash minima in bands, signatures checked, links confirmed on full sets, components by stars.

Texts with equal words are one vertex. Vertices that agree in a band of their minima meet in a bucket:

* a bucket of up to `SMALL` vertices gives all its pairs, at most SMALL / 2 for each of its vertices;
* vertices of larger buckets are met again by their rarest shingles, which is exact: two sets over the threshold share a
  shingle among the first n - ceil(t n) + 1 of either, in any fixed order. Here rare shingles come first, so that copies with
  changes of their own do not meet. A shingle's vertices that cannot reach the threshold from its place in them are passed over.
  Up to SMALL vertices give all pairs; more are held against a centre, and those not linked to it against all of them.

Pairs whose signatures are far below the threshold are dropped (five standard deviations), the rest is counted on
the full sets. No group is gathered in one task, and nothing is cut off.

Null and empty texts, and those of white space, have an empty set and are linked with nothing. Shorter texts than a shingle are one
shingle. Rows may repeat and ids may be null: a component's id is the smallest id in it, null if it has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from larkspur.llm.common import Scratch, field, lean, table
from larkspur.llm.components import components

SHINGLE = 3
PERCENT = 85
BANDS, ROWS = 32, 5
SMALL = 48
#: Signatures hold eight bits of each minimum; with 160 of them 0.15 is five standard deviations at the threshold.
MARGIN = 0.15
#: Bytes of text that are hashed together, bits of the table of shingle counts, and bits of the table of wanted texts.
CHUNK_BYTES = 4_000_000
COUNT_BITS = 20
WANTED_BITS = 25

_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


# --- in a task --------------------------------------------------------------------------------------------


def _mixed(state: np.ndarray, more: np.ndarray | np.uint64) -> np.ndarray:
    state = (state ^ more) * _MIX[0]
    state ^= state >> np.uint64(32)
    state *= _MIX[1]
    state ^= state >> np.uint64(29)
    return state


def shingles(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, words per text, shingle hashes (repeats included), and shingles per text."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    coded = pc.list_flatten(lists).dictionary_encode()
    words = pc.ascii_lower(coded.dictionary).to_numpy(zero_copy_only=False)
    hashes = pd.util.hash_array(words, categorize=False) if len(words) else np.empty(0, dtype=np.uint64)
    hashes[words == ""] = 0  # where white space begins or ends a text
    each = hashes[np.asarray(coded.indices)]
    of = np.repeat(np.arange(len(texts)), np.asarray(pc.list_value_length(lists), dtype=np.int64))
    real = each != 0
    each, of = each[real], of[real]
    n_words = np.bincount(of, minlength=len(texts))
    first = np.cumsum(n_words) - n_words
    # every position starts a shingle but the last ones of a text; short texts have one
    span = np.minimum(n_words, width)
    starts = np.arange(len(each)) - first[of]
    begins = starts <= (n_words - span)[of]
    at, owner = np.flatnonzero(begins), of[begins]
    state = np.full(len(at), _MIX[2], dtype=np.uint64) + span[owner].astype(np.uint64)
    for i in range(width):
        inside = i < span[owner]
        state = np.where(inside, _mixed(state, each[np.minimum(at + i, max(len(each) - 1, 0))]), state) if len(at) else state
    return each, n_words, state, np.bincount(owner, minlength=len(texts))


def _parts(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about CHUNK_BYTES of text."""
    reach = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0), dtype=np.int64))
    cuts = (np.searchsorted(reach, np.arange(CHUNK_BYTES, reach[-1], CHUNK_BYTES)) + 1).tolist() if len(reach) else []
    bounds = sorted({0, *cuts, len(texts)})
    return zip(bounds, bounds[1:], strict=False)


class Minima:
    """Minima of universal hash functions, as band keys and as bytes."""

    def __init__(self, bands: int, rows: int):
        random = np.random.default_rng(20240607)
        self.bands, self.rows = bands, rows
        self.factors = random.integers(1, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.terms = random.integers(0, 2**63, bands * rows, dtype=np.uint64)

    def __call__(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Band keys and signature bytes of every text that has shingles, in order."""
        some = counts > 0
        starts = (np.cumsum(counts) - counts)[some]
        keys = np.empty((len(starts), self.bands), dtype=np.uint64)
        signs = np.empty((len(starts), self.bands * self.rows), dtype=np.uint8)
        for band in range(self.bands):
            state = np.full(len(starts), np.uint64(band) + _MIX[2], dtype=np.uint64)
            for i in range(band * self.rows, (band + 1) * self.rows):
                values = flat * self.factors[i]
                values += self.terms[i]
                least = np.minimum.reduceat(values, starts)
                signs[:, i] = (least >> np.uint64(24)).astype(np.uint8)
                state = _mixed(state, least)
            keys[:, band] = state
        return keys, signs


def _distinct(flat: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(counts).tolist()
    return [np.unique(flat[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


# --- jobs -------------------------------------------------------------------------------------------------


def signatures(df: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """id, text_key, same (digest of the words; null if there are none), n_shingles, bands and signature of every row.

    `df` has id, text_key and text.
    """

    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        minima = Minima(bands, rows)
        for batch in batches:
            for a, b in _parts(batch.column("text")):
                part = batch.slice(a, b - a)
                words, n_words, flat, counts = shingles(part.column("text"), width)
                keys, signs = minima(flat, counts)
                ends = np.cumsum(n_words).tolist()
                same = [
                    hashlib.blake2b(words[x:y].tobytes(), digest_size=16).digest() if y > x else None
                    for x, y in zip([0, *ends[:-1]], ends, strict=True)
                ]
                sizes = np.array([len(s) for s in _distinct(flat, counts)], dtype=np.int64)
                some = np.concatenate([[0], np.cumsum(counts > 0)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(some * bands, pa.int32()), pa.array(keys.ravel().view(np.int64)))
                body = signs.tobytes()
                step = bands * rows
                signed = [body[i * step : (i + 1) * step] if c else None for i, c in zip(some[:-1].tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("text_key"), pa.array(same, pa.binary()), pa.array(sizes), lists, pa.array(signed, pa.binary())],
                    names=["id", "text_key", "same", "n_shingles", "bands", "signature"],
                )

    schema = "id long, text_key long, same binary, n_shingles long, bands array<bigint>, signature binary"
    return df.mapInArrow(sign, schema)


def all_pairs(lists: DataFrame, column: str) -> DataFrame:
    """The pairs of short lists, each once."""
    pairs = F.expr(f"flatten(transform({column}, (x, i) -> transform(slice({column}, i + 2, size({column})), y -> struct(x AS a, y AS b))))")
    return lists.select(F.explode(pairs).alias("p")).select("p.a", "p.b")


def similar_signatures(pairs: DataFrame, vertices: DataFrame, least: float) -> DataFrame:
    """Pairs whose signatures agree in a share of at least `least`, chance agreement of bytes taken off."""

    @lean
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint8) for c in ("sa", "sb"))
                share = (one == two).reshape(batch.num_rows, -1).mean(axis=1)
                keep = (share - 1 / 256) / (1 - 1 / 256) >= least
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], names=["a", "b"])

    signed = vertices.select("v", "signature")
    joined = pairs.join(signed.select(F.col("v").alias("a"), F.col("signature").alias("sa")), "a")
    joined = joined.join(signed.select(F.col("v").alias("b"), F.col("signature").alias("sb")), "b")
    return joined.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long")


def wanted_texts(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(v, text) for the wanted (v, text_key), moving hardly any other text.

    A table of 2**WANTED_BITS bits, 4 MB whatever the input, tells which texts may be wanted; the join decides.
    """
    place = F.pmod(F.col("text_key"), F.lit(1 << WANTED_BITS))
    bits = wanted.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page"))
    bits = bits.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    placed = texts.select("text_key", "text", F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit"))
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit DIV 8 AS INT) + 1, 1)")), 16, 10).cast("int")
    maybe = placed.join(F.broadcast(bits), "page").where(F.expr("1").cast("int") == byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")).cast("boolean").cast("int"))
    once = maybe.groupBy("text_key").agg(F.first("text").alias("text"))  # copies are dropped before they move
    return once.join(wanted.select("v", "text_key"), "text_key").select("v", "text")


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(v, n, items): the distinct shingles of (v, text)."""

    @lean
    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _parts(batch.column("text")):
                part = batch.slice(a, b - a)
                _, _, flat, counts = shingles(part.column("text"), width)
                sets = _distinct(flat, counts)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                flat = np.concatenate(sets).view(np.int64) if sets else np.empty(0, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("v"), pa.array(sizes), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["v", "n", "items"]
                )

    return texts.mapInArrow(collect, "v long, n long, items array<bigint>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold."""
    joined = pairs.join(sets.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("items").alias("ia")), "a")
    joined = joined.join(sets.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("items").alias("ib")), "b")
    common = F.size(F.array_intersect("ia", "ib"))
    near = joined.where("100 * least(na, nb) >= %d * greatest(na, nb)" % percent).withColumn("common", common)
    return near.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def rare_first(sets: DataFrame, percent: int) -> DataFrame:
    """(item, v, place, n): the shingles of each set that two sets over the threshold cannot both avoid, rarest first.

    Rarity is counted in a table of 2**COUNT_BITS numbers; shingles that share a number only weaken the order.
    """
    size = 1 << COUNT_BITS

    @lean
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for batch in batches:
            found += np.bincount(np.asarray(pc.list_flatten(batch.column("items"))) & (size - 1), minlength=size)
        at = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[at])], names=["slot", "n"])

    rows = sets.select("items").mapInArrow(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, dtype=np.int32)
    counts[rows["slot"].to_numpy(dtype=np.int64)] = np.minimum(rows["n"].to_numpy(dtype=np.int64), 2**31 - 1)

    @lean
    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, places = [], []
            for x in batch.column("items"):
                own = np.asarray(x.values)
                keep = len(own) - -(-percent * len(own) // 100) + 1
                order = np.lexsort((own, counts[own & (size - 1)]))[:keep]
                items.append(own[order])
                places.append(np.arange(1, keep + 1))
            many = np.array([len(x) for x in items], dtype=np.int64)
            row = pa.array(np.repeat(np.arange(batch.num_rows), many))
            if len(row):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(items)), batch.column("v").take(row), pa.array(np.concatenate(places)), batch.column("n").take(row)],
                    names=["item", "v", "place", "n"],
                )

    return sets.mapInArrow(first, "item long, v long, place long, n long")


def _needed(n: Column, m: Column, percent: int) -> Column:
    """Common shingles that sets of n and m need."""
    return F.ceil(percent * (n + m) / (100 + percent) - 1e-9)


def rare_pairs(sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Pairs of vertices that share a rare shingle from where they can still reach the threshold, and links found on the way."""
    met = scratch.keep(rare_first(sets, percent))
    least = met.groupBy("item").agg(F.min("n").alias("n_min"), F.count("*").alias("many")).where("many > 1")
    smallest = F.greatest("n_min", F.ceil(percent * F.col("n") / 100))
    able = met.join(least, "item").where(1 + F.col("n") - F.col("place") >= _needed(F.col("n"), smallest, percent))
    able = scratch.keep(able.select("item", "v", "place", "n"))
    sizes = able.groupBy("item").agg(F.count("*").alias("many"), F.min(F.struct("place", "n", "v")).alias("centre")).where("many > 1")
    sized = able.join(sizes, "item")
    few = sized.where(F.col("many") <= SMALL).groupBy("item").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    direct = all_pairs(few.select("vs").distinct(), "vs").distinct()
    # dense shingles: all against the centre, and who is not linked to it against all
    dense = scratch.keep(sized.where(F.col("many") > SMALL).select("item", "v", "place", "n", F.col("centre.v").alias("centre")))
    star = dense.where("v != centre").select(F.least("v", "centre").alias("a"), F.greatest("v", "centre").alias("b")).distinct()
    links = scratch.keep(confirmed(star, sets, percent))
    linked = links.select("a", "b")
    keyed = dense.withColumn("a", F.least("v", "centre")).withColumn("b", F.greatest("v", "centre"))
    loose = keyed.where("v != centre").join(linked, ["a", "b"], "left_anti").select("item", "v", "place", "n")
    other = dense.select("item", F.col("v").alias("w"), F.col("place").alias("w_place"), F.col("n").alias("m"))
    room = 1 + F.least(F.col("n") - F.col("place"), F.col("m") - F.col("w_place"))
    near = (room >= _needed(F.col("n"), F.col("m"), percent)) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m"))
    rest = loose.join(other, "item").where((F.col("v") != F.col("w")) & near)
    rest = rest.select(F.least("v", "w").alias("a"), F.greatest("v", "w").alias("b")).distinct()
    return direct.unionByName(rest).distinct(), links


def labelled_rows(df: DataFrame, text: str, key: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """One row per row of `df`: id, text_key, n_shingles, label and component_id.

    The label tells components apart, whatever ids their rows have; it is null for texts without words, which are linked with nothing.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    named = df.select(field(key).cast("long").alias("id"), F.xxhash64(field(text)).alias("text_key"), field(text).alias("text"))
    signed = scratch.keep(signatures(named, width, bands, rows))
    classes = signed.where("same IS NOT NULL").groupBy("same")
    vertices = classes.agg(
        F.min("id").alias("first_id"),
        F.min("text_key").alias("text_key"),
        F.first("bands").alias("bands"),
        F.first("signature").alias("signature"),
    )
    # numbers are drawn once, as the table is written
    vertices = scratch.keep(vertices.withColumn("v", F.monotonically_increasing_id()))

    met = vertices.select("v", F.explode("bands").alias("bucket"))
    buckets = scratch.keep(met.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1"))
    sized = scratch.keep(met.join(buckets, "bucket"))
    few = sized.where(F.col("many") <= SMALL).groupBy("bucket").agg(F.sort_array(F.collect_list("v")).alias("vs"))
    pairs = all_pairs(few.select("vs").distinct(), "vs").distinct()
    likely = scratch.keep(similar_signatures(pairs, vertices, percent / 100 - MARGIN))
    crowd = scratch.keep(sized.where(F.col("many") > SMALL).select("v").distinct())
    scratch.drop(sized)
    scratch.drop(buckets)

    ends = likely.select(F.explode(F.array("a", "b")).alias("v")).unionByName(crowd).distinct()
    wanted = scratch.keep(vertices.select("v", "text_key").join(ends, "v"))
    sets = scratch.keep(full_sets(wanted_texts(named.select("text_key", "text"), wanted), width))
    rare, links = rare_pairs(sets.join(crowd, "v", "left_semi"), percent, scratch)
    checked = scratch.keep(similar_signatures(rare, vertices, percent / 100 - MARGIN))
    found = confirmed(likely.unionByName(checked).distinct(), sets, percent).unionByName(links)
    labels = components(found.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    scratch.drop(sets)

    labelled = vertices.select("same", "first_id", "v").join(labels.withColumnRenamed("vertex", "v"), "v", "left")
    labelled = labelled.select("same", "first_id", F.coalesce("label", "v").alias("label"))
    first = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named_classes = labelled.join(first, "label").select("same", "label", "component_id")
    out = signed.select("id", "text_key", "same", "n_shingles").join(named_classes, "same", "left")
    component = F.when(F.col("same").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select("id", "text_key", "n_shingles", "label", component.alias("component_id"))


def near_duplicates(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row per row of `df`: the key, text_key (xxhash64 of the text), n_shingles, component_id and kept."""
    out = labelled_rows(df, text, key, width, percent, bands, rows)
    out = out.select(F.col("id").alias(key), "text_key", "n_shingles", "component_id")
    return out.withColumn("kept", field(key).eqNullSafe(F.col("component_id")))


def deduplicated(
    df: DataFrame, text: str = "text", key: str = "doc_id", width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row of each component, with all columns of `df`; of rows with an equal id and text one stays.

    Components are told apart by their labels, as ids may be null or repeat. The row with the smallest id stays, those without one come last.
    """
    found = labelled_rows(df, text, key, width, percent, bands, rows)
    smallest = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "text_key")).alias("least")
    chosen = found.where("label IS NOT NULL").groupBy("label").agg(smallest)
    chosen = chosen.select(F.col("least.id").alias("__id"), F.col("least.text_key").alias("__text_key"))
    # texts without words are components of their own
    lone = found.where("label IS NULL").select(F.col("id").alias("__id"), F.col("text_key").alias("__text_key"))
    chosen = chosen.unionByName(lone).distinct()
    keyed = df.select(F.struct(*[field(c) for c in df.columns]).alias("__row"), field(key).cast("long").alias("__id"), F.xxhash64(field(text)).alias("__text_key"))
    none = F.lit(-(2**63))
    left = keyed.withColumn("__key", F.coalesce("__id", none)).drop("__id")
    right = chosen.select(F.coalesce("__id", none).alias("__key"), "__text_key")
    joined = left.join(right, ["__key", "__text_key"], "left_semi")
    place = F.row_number().over(Window.partitionBy("__key", "__text_key").orderBy(F.xxhash64("__row")))
    return joined.withColumn("__place", place).where("__place = 1").select("__row.*")


def op7_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


QUERIES = {"op7_minhash_components": op7_minhash_components}
ORACLE: dict[str, str] = {}
