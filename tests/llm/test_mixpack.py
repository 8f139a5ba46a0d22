"""Mixture packing: the schedule, the round-robin, ids against the library, and whole tables with their edges."""

import random
from functools import cache
from zlib import crc32

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from larkspur.llm import mixpack
from larkspur.llm.bytetokens import encoder, vocabulary_path

CLASHES = ["part", "number", "n", "inside", "ids", "id", "queue", "position", "block", "key", "before", "name", "start", "a.b", "a b.c"]
PARTS = [
    "a", "b", "don't", "'s", " ", "  ", "\n", "\t", "\r\n", ".", ",", "!?", "1", "23", "é", "日本", "\xa0", "\x0b", "<|endoftext|>", "'",
    "'ll", "_", "😀", "\x85", "\x1c", "​", "\x00", " .", "x,", "I'M", " the", " cat", "　",
]


WHOLE = Tokenizer.from_file(vocabulary_path())


@cache
def library(text):
    return [*WHOLE.encode(text or "", add_special_tokens=False).ids, mixpack.END_ID]


def test_tokens_match_the_library():
    dice = random.Random(3)
    texts = ["".join(dice.choice(PARTS) for _ in range(dice.randint(0, 30))) for _ in range(5000)] + ["", None, "  ", "\n\n "]
    flat, lengths = encoder(vocabulary_path())(pa.array(texts))
    want = [WHOLE.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert lengths.tolist() == [len(w) for w in want]
    assert flat.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("seed", range(24))
def test_schedule(seed):
    dice = random.Random(seed)
    count = dice.randint(1, 6)
    tokens = tuple(dice.randint(1, 400) for _ in range(count))
    weights = tokens if seed % 2 else tuple(dice.randint(1, 5) for _ in range(count))
    plan = mixpack.Schedule(tokens, weights, dice.randint(1, max(1, sum(tokens) // 8)))
    served = [plan.served(b) for b in range(plan.blocks + 1)]
    assert served[0] == [0] * count
    assert served[-1] == list(tokens)
    for q in range(count):
        own = [s[q] for s in served]
        assert own == sorted(own)
        want = [max(b for b in range(plan.blocks) if own[b] <= p) for p in range(tokens[q])]
        assert plan.block_of(q, np.arange(tokens[q])).tolist() == want


def test_schedule_of_a_large_corpus():
    plan = mixpack.Schedule((3 * 10**13, 7, 2 * 10**12 + 1), (3 * 10**13, 7, 2 * 10**12 + 1), 3 * 10**7)
    for q, tokens in enumerate(plan.tokens):
        for position in (0, tokens // 3, tokens - 1):
            block = int(plan.block_of(q, np.array([position]))[0])
            assert plan.served(block)[q] <= position < plan.served(block + 1)[q]


def test_rooms():
    assert mixpack.rooms(0, 40, 40, 16) == [(0, 0, 16), (1, 0, 16), (2, 0, 8)]
    assert mixpack.rooms(5, 47, 47, 16) == [(0, 5, 11), (1, 0, 16), (2, 0, 8), (3, 0, 4), (4, 0, 2), (5, 0, 1)]
    assert mixpack.rooms(20, 30, 99, 16) == [(1, 4, 10)]
    assert mixpack.rooms(33, 38, 39, 16) == [(2, 1, 3), (3, 0, 2)]


def test_round_robin_carries_deficits():
    budget = np.array([700, 200, 97, 3])
    taken = mixpack.round_robin(budget, budget.astype(float), np.zeros(4), np.array([10] * 100))
    assert taken.sum(axis=1).tolist() == [10] * 100
    assert taken.sum(axis=0).tolist() == budget.tolist()
    reach = np.cumsum(taken, axis=0) - np.outer(np.arange(10, 1001, 10), budget / 1000)
    assert np.abs(reach).max() <= 1.5  # a queue of 3 in 1,000 waits for its turn and gets it


def test_round_robin_starts_from_what_is_owed():
    taken = mixpack.round_robin(np.array([50, 50]), np.array([1.0, 1.0]), np.array([-3.0, 3.0]), np.array([10] * 10))
    assert taken[0].tolist() == [2, 8]
    assert taken[1:9].tolist() == [[5, 5]] * 8
    assert taken.sum(axis=0).tolist() == [50, 50]


def check(df, packed, window):
    """Every id once, at its place; sequences gapless, all full but powers of two at the end."""
    rows = packed.toPandas()
    docs = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert len(rows) == 0 or (rows.length > 0).all()
    assert (rows.ids.map(len) == 4 * rows.length).all()
    found = {}
    for r in rows.itertuples():
        at = None if r.doc_id != r.doc_id else int(r.doc_id)
        found.setdefault(at, []).append((int(r.start), r.ids, int(r.doc_tokens)))
    for at in set(d for d, _ in docs):
        want = [library(t) for d, t in docs if d == at]
        assert sum(len(w) for w in want) == sum(len(p[1]) // 4 for p in found[at])
        if len(want) == 1:
            pieces = sorted(found[at])
            assert np.frombuffer(b"".join(p[1] for p in pieces), "<u4").tolist() == want[0]
            assert [p[0] for p in pieces] == [0, *np.cumsum([len(p[1]) // 4 for p in pieces])[:-1].tolist()]
            assert {p[2] for p in pieces} == {len(want[0])}
    rows = rows.sort_values(["sequence_id", "offset"])
    assert (rows.groupby("sequence_id").length.cumsum() - rows.length == rows.offset).all()
    sizes = rows.groupby("sequence_id").length.sum()
    assert sizes.index.tolist() == list(range(len(sizes)))
    full = int(sizes.sum()) // window
    assert (sizes[:full] == window).all()
    assert all(s & (s - 1) == 0 for s in sizes[full:])
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    dice = random.Random(5)
    words = ["the", "cat", "sat", "don't", "on", "a", "mat", "12", "día", "ñandú,"]
    rows = []
    for i in range(160):
        text = " ".join(dice.choice(words) for _ in range(dice.choice([0, 1, 3, 40, 300])))
        rows.append((i, text, None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 4}"))
    rows += [(500, None, "s1"), (501, "", None), (502, "cat \xa0 sat " * 20000, "s2"), (None, "a cat", "hot"), (None, None, None)]
    rows += [rows[4], rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    for name in CLASHES:
        df = df.withColumn(name, F.lit(name))
    return df.cache()


@pytest.mark.parametrize(("window", "block"), [(2048, 512), (64, 8), (64, 1), (16, 3)])
def test_whole_tables(docs, window, block):
    rows = check(docs, mixpack.pack_mixture(docs, window=window, block=block), window)
    source = {r["doc_id"]: r["source"] for r in docs.where("doc_id is not null").collect()}
    known = rows[rows.doc_id.notna()].assign(source=lambda r: r.doc_id.map(lambda d: source[int(d)] or "none"))
    share = known.groupby("source").length.sum() / rows.length.sum()
    full = int(rows.length.sum()) // window
    table = known.pivot_table(index="sequence_id", columns="source", values="length", aggfunc="sum", fill_value=0)
    table = table.reindex(range(full), fill_value=0)
    reach = np.cumsum(table.to_numpy(), axis=0) - np.outer(np.arange(1, full + 1) * window, share[table.columns])
    assert np.abs(reach).max() < 12  # deficits of a token or two, and the two rows without an id


def test_weights(docs):
    rows = check(docs, mixpack.pack_mixture(docs, window=64, block=8, weights={"hot": 5, "s1": 2, None: 1}), 64)
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    first = rows[(rows.sequence_id < 4) & rows.doc_id.notna()]
    got = first.groupby(first.doc_id.map(lambda d: source[int(d)] or "none").map(lambda s: s if s in ("hot", "s1") else "rest")).length.sum()
    assert abs(got["hot"] - 4 * 64 * 5 / 9) < 8
    assert abs(got["s1"] - 4 * 64 * 2 / 9) < 4


def test_sources_beyond_the_queues_share_one(docs):
    check(docs, mixpack.pack_mixture(docs, window=64, block=8, queues=3), 64)
    with pytest.raises(ValueError, match="queue of their own"):
        mixpack.pack_mixture(docs, weights={"a": 1, "b": 1, "c": 1}, queues=3)


def test_nothing_to_pack(docs):
    assert mixpack.pack_mixture(docs.where("doc_id = -1")).collect() == []


def test_query_has_the_checksums(spark, sf001):
    row = mixpack.op12_mixture_packing(spark, sf001).orderBy("doc_id", "start").first()
    text = spark.read.parquet(f"{sf001}/documents.parquet").where(f"doc_id = {row['doc_id']}").first()["text"]
    ids = np.array(library(text)[: row["length"]], dtype="<u4").tobytes()
    assert (row["start"], row["ids_crc32"], row["doc_tokens"]) == (0, crc32(ids), len(library(text)))
