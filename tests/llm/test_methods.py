"""Each method against brute force, a round trip, or held-out labels."""

import bisect
import heapq
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from conftest import TESTDATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from larkspur.llm import components, hnsw, huffman, maxent, mixing, neardup, packing, queries, rules, sharding, tokens, weaklabels
from larkspur.llm.common import Scratch

SF = str(TESTDATA / "sf0.01")


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


# --- tokens -----------------------------------------------------------------------------------------------


def test_tokens_match_the_library(texts, monkeypatch):
    monkeypatch.setattr(tokens, "CHUNK_BYTES", 50_000)
    monkeypatch.setattr(tokens, "REMEMBERED", 3000)
    encode, library = tokens.Encoder(tokens.vocabulary_path()), Tokenizer.from_file(tokens.vocabulary_path())
    odd = ["", None, "It's Ünïcode Ǆ ǅ İstanbul ſtraße ΣΑΣ éa", "<|endoftext|>x", "a'b 's I'LL x'd", "100 1,000 a1b2", "ﬁ ﬂ Å\x0b\x0c日本語"]
    every = odd + [texts[i] for i in sorted(texts)[:250]]
    flat, lengths = encode(pa.array(["skipped", *every])[1:])
    ends = np.cumsum(lengths)
    for text, a, b in zip(every, ends - lengths, ends, strict=True):
        assert flat[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids


# --- op1 --------------------------------------------------------------------------------------------------


def test_shards_are_even_and_grouped(spark):
    rows = queries.QUERIES["op1_histogram_sort"](spark, SF).collect()
    sizes, largest = Counter(), max(r["size"] for r in rows)
    for r in rows:
        sizes[r["shard"]] += r["size"]
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and all(abs(s - mean) <= largest + 0.01 * mean for s in sizes.values())
    shards = defaultdict(set)
    for r in rows:
        shards[r["text_crc32"]].add(r["shard"])
    assert sum(len(s) > 1 for s in shards.values()) <= 7  # a group lies on both sides of a boundary at most


def test_hot_group_is_cut(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "same text").otherwise(F.col("id").cast("string")).alias("text"))
    sizes = [r["s"] for r in sharding.shard_by_bytes(df, 8, task_bytes=2000).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)


def test_equal_rows_are_cut(spark):
    """A third of the rows have neither id nor text, another third are one document without an id: both are cut."""
    df = spark.range(6000, numPartitions=5).select(
        F.when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, "the same text " * 8).when(F.col("id") % 3 == 2, F.col("id").cast("string")).alias("text"),
        F.create_map(F.lit("a"), F.lit(1)).alias("a map"),
    )
    rows = sharding.shard_by_bytes(df, 8, task_bytes=3000).collect()
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert len(rows) == 6000 and len(sizes) == 8 and max(sizes.values()) <= 1.025 * min(sizes.values()) + 113
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_many_parts_are_data(spark):
    """Thousands of parts: splitters at the bytes asked for, counts below them exact, the plan no longer than for a few."""
    df = spark.range(30000, numPartitions=4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    hi, lo = sharding.key_columns(df, "text")
    keys = df.select(hi.alias("hi"), lo.alias("lo"), (F.octet_length("text") + 1).cast("long").alias("size")).cache()
    exact = sorted(((r["hi"] + (1 << 63)) << 64 | (r["lo"] + (1 << 63)), r["size"]) for r in keys.collect())
    total = sum(s for _, s in exact)
    goals = [(total * i / 4000, 97.0) for i in range(1, 4000)]
    found = sharding.find_splitters(keys, goals)
    order, reach = [k for k, _ in exact], np.cumsum([0, *(s for _, s in exact)])
    for (key, rows), (target, _) in zip(found, goals, strict=True):
        assert bisect.bisect_left(order, key) == rows and abs(reach[rows] - target) <= 97
    placed = keys.select("hi", "lo", sharding.place([k for k, _ in found])("hi", "lo").alias("part"))
    for r in placed.sample(0.02, 3).collect():
        own = (r["hi"] + (1 << 63)) << 64 | (r["lo"] + (1 << 63))
        assert r["part"] == bisect.bisect_right([k for k, _ in found], own)
    sharded = sharding.shard_by_bytes(df, 8, task_bytes=1000)
    assert len(sharded._jdf.queryExecution().toString()) < 20000
    assert sharded.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("gapless")).where("gapless").count() == 8


# --- op2 --------------------------------------------------------------------------------------------------


def test_rules_against_brute_force(spark, texts, labels):
    found = {r["doc_id"]: r for r in queries.QUERIES["op2_likelihood_ratio"](spark, SF).collect()}
    size = rules.BUCKETS

    def signed(value):
        return value - (1 << 64) if value >> 63 else value

    def grams(text):
        w = [x.encode() for x in words(text)]
        one = [signed(xxhash.xxh64_intdigest(x, seed=42)) % size for x in w]
        return one + [signed(xxhash.xxh64_intdigest(b, seed=xxhash.xxh64_intdigest(a, seed=42))) % size for a, b in zip(w, w[1:])]

    corpus, target = np.ones(size), np.ones(size)
    every = {i: grams(t) for i, t in texts.items()}
    for i, g in every.items():
        np.add.at(corpus, g, 1)
        if labels.get(i) == 1:
            np.add.at(target, g, 1)
    ratio = np.log(target / target.sum()) - np.log(corpus / corpus.sum())
    for i, text in texts.items():
        w, r = words(text), found[i]
        windows = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        inside = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if words(x)]
        base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        score = ratio[every[i]].mean() if every[i] else 0.0
        assert r["score"] == pytest.approx(score, abs=1e-9)
        assert r["base_failed"] == (len(w) < 50 or 100 * len(inside) > 50 * len(w))
        if abs(score - rules.THRESHOLD) > 1e-6:
            assert r["kept"] == (not r["base_failed"] and score >= rules.THRESHOLD)


# --- op3 --------------------------------------------------------------------------------------------------


def plain_cost(counts):
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        both = heapq.heappop(heap) + heapq.heappop(heap)
        cost += both
        heapq.heappush(heap, both)
    return cost


def test_code_lengths():
    random = np.random.default_rng(1)
    counts = random.zipf(1.3, 500).clip(max=10**6)
    assert int(counts @ huffman.code_lengths(counts, 40)) == plain_cost(counts)
    for limit in (9, 10, 12):
        lengths = huffman.code_lengths(counts, limit)
        assert lengths.max() <= limit and sum(2.0 ** -float(x) for x in lengths) == 1
    steps = np.array([2**i for i in range(30)])
    assert huffman.code_lengths(steps, 6).max() == 6
    assert huffman.code_lengths(np.array([0, 7, 0])).tolist() == [0, 1, 0]
    with pytest.raises(ValueError):
        huffman.code_lengths(np.ones(20), 4)


@pytest.mark.parametrize("size", [0, 1, 255, 256, 257, 5000])
def test_block_round_trip(size):
    random = np.random.default_rng(size)
    ids = random.zipf(1.2, size).clip(max=900).astype(np.int64)
    lengths = huffman.code_lengths(np.bincount(ids, minlength=901))
    bits, marks = huffman.encode_block(ids, huffman.canonical(lengths), lengths)
    at = np.frombuffer(marks, dtype="<u8").astype(np.int64)
    counts = np.minimum(size - np.arange(len(at)) * huffman.CHECKPOINT, huffman.CHECKPOINT)
    assert huffman.Decoder(lengths)(np.frombuffer(bits, dtype="<u4"), at, counts).tolist() == ids.tolist()


# --- op4 --------------------------------------------------------------------------------------------------


def test_targets_by_rounds():
    random = np.random.default_rng(3)
    for _ in range(50):
        sizes = {f"s{i:02d}": int(x) for i, x in enumerate(random.integers(0, 1000, 9))} | {None: int(random.integers(0, 50))}
        names = sorted(s for s in sizes if s) + [None]
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
        left, open_, want = float(sum(sizes.values())), set(names), {}
        while open_:
            share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
            over = [s for s in open_ if share[s] > 3 * sizes[s]]
            if not over:
                want |= share
                break
            for s in over:
                want[s] = 3.0 * sizes[s]
                left -= want[s]
                open_.remove(s)
        assert mixing.targets(sizes) == pytest.approx(want)


# --- op5 --------------------------------------------------------------------------------------------------


def test_nearest_against_brute_force(spark):
    random = np.random.default_rng(5)
    vectors = random.normal(size=(3000, 16)) * random.uniform(0.2, 3, (3000, 1))
    vectors[100:900] = vectors[7]  # a common vector
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9020, [0.0] * 16), (9040, [float("nan")] + [1.0] * 15), (9060, [None] + [1.0] * 15), (9080, []), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    found = defaultdict(list)
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0, shard_points=700).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(found) == set(range(0, 3000, 20))
    hits = 0
    for q in found:
        scores = vectors @ vectors[q]
        scores[q] = -np.inf
        want = np.lexsort((np.arange(3000), -scores))[:20].tolist()
        hits += len({v for v, _ in found[q]} & set(want))
        assert len(found[q]) == 20 and [s for _, s in found[q]] == pytest.approx([scores[v] for v, _ in found[q]])
    assert hits / (20 * len(found)) >= 0.9


@pytest.mark.parametrize("longer", [1e4, 1e6])
def test_one_very_long_vector(spark, longer):
    random = np.random.default_rng(6)
    vectors = random.normal(size=(1500, 16))
    vectors[3] *= longer
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    hits = 0
    for r in hnsw.nearest(df, F.col("vec_id") % 20 == 0).collect():
        scores = vectors @ vectors[r["query_id"]]
        scores[r["query_id"]] = -np.inf
        hits += scores[r["vec_id"]] >= np.sort(scores)[-20] - 1e-9
    assert hits / (20 * 75) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    rows = hnsw.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 20, 5.0), (0, 2, 1, 4.0), (20, 1, 0, 5.0), (20, 2, 1, 4.0)]
    assert not hnsw.nearest(df.limit(0), F.lit(True)).collect()


# --- op7 --------------------------------------------------------------------------------------------------


def shingle_set(text, width):
    w = words(lower(text))
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width, percent):
    sets, parent = {i: shingle_set(t, width) for i, t in texts.items()}, {i: i for i in texts}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(sets)
    where = defaultdict(list)
    for i in ids:
        common = Counter(j for s in sets[i] for j in where[s])
        for j, n in common.items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
        for s in sets[i]:
            where[s].append(i)
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("settings", [{}, corpus_pipeline.NEAR])
def test_components_against_brute_force(spark, texts, settings):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    want = brute_components(texts, settings.get("width", 3), settings.get("percent", 85))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df, **settings).collect()}
    assert found == want


def test_crowded_buckets(spark, monkeypatch):
    """One large group of near copies, met by rare shingles."""
    random = np.random.default_rng(11)
    stem = [f"w{i}" for i in range(150)]
    texts = {}
    for i in range(250):
        body = list(stem)
        for at in random.choice(150, random.integers(0, 14), replace=False):
            body[at] = f"x{random.integers(10**6)}"
        texts[i] = " ".join(body)
    texts |= {1000 + i: " ".join(f"y{x}" for x in random.integers(0, 400, 90)) for i in range(100)}
    monkeypatch.setattr(neardup, "SMALL", 6)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in neardup.near_duplicates(df).collect()}
    assert found == brute_components(texts, 3, 85)


def test_connected_components(spark, tmp_path):
    random = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in random.integers(0, 300, (160, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    df = spark.createDataFrame(edges, "u long, v long")
    found = {r["vertex"]: r["label"] for r in components.components(df, Scratch(spark, "cc")).collect()}
    parent = {x: x for e in edges for x in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        parent[b] = a
    assert found == {x: root(x) for e in edges for x in e if e[0] != e[1]}


# --- op8 --------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("most", [maxent.TABLE, 500])
def test_scores_against_brute_force(spark, texts, most):
    rows = maxent.score(spark.read.parquet(f"{SF}/documents.parquet"), most=most).collect()
    every = {i: [*words(lower(t)), None] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    counts = Counter(w for i, x in every.items() if not held[i] for w in x)
    n, v = sum(counts.values()), len(counts)
    base = sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for i, x in every.items() if held[i] for w in x)
    for r in rows:
        x = every[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(x), sum(counts[w] > 0 for w in x), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in x))
    assert sum(r["score"] for r in rows if r["held_out"]) > base  # log probabilities of held-out texts


def test_class_model_sums_to_one():
    random = np.random.default_rng(0)
    weights = random.normal(size=(maxent.ROWS, maxent.CLASSES)).astype(np.float32)
    found = maxent.log_softmax(maxent.class_logits(weights, random.integers(0, maxent.FEATURES, (50, 3))))
    assert np.exp(found).sum(axis=1) == pytest.approx(1, abs=1e-4)


def test_history_tells_words_of_a_class_apart(spark):
    """Words with equal counts and last letters, each after a word of its own: the true follower scores over another."""
    random = np.random.default_rng(5)
    filler = [f"f{i}" for i in range(maxent.CLASSES)]  # frequent: they have the classes of their own
    texts = []
    for _ in range(600):
        pairs = random.permutation(80)
        texts.append(" ".join(" ".join(random.choice(filler, 4)) + f" c{p}qq w{p}zz" for p in pairs))
    test = [i for i in range(10_000, 10_400) if zlib.crc32(str(i).encode()) % 5 == 1][:40]
    true = [(i, " ".join(f"f1 f2 c{p}qq w{p}zz" for p in range(80))) for i in test[:20]]
    other = [(i, " ".join(f"f1 f2 c{p}qq w{(p + 7) % 80}zz" for p in range(80))) for i in test[20:]]
    df = spark.createDataFrame([*enumerate(texts), *true, *other], "doc_id long, text string").repartition(2)
    for most in (maxent.TABLE, 200):  # words that tasks hold, and words that are joined
        scores = {r["doc_id"]: r["score"] for r in maxent.score(df, most=most).collect()}
        assert np.mean([scores[i] for i in test[:20]]) > np.mean([scores[i] for i in test[20:]]) + 80 * 0.1


# --- op9 --------------------------------------------------------------------------------------------------


def test_classifier_agrees_with_labels(spark, labels):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op9_weak_labels"](spark, SF).collect()}
    good = [rows[i]["kept"] for i, q in labels.items() if q == 1]
    bad = [rows[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(good) >= 0.99 and np.mean(bad) <= 0.25


def test_estimated_accuracies():
    random = np.random.default_rng(4)
    truth = random.random(20_000) < 0.2
    cast = np.where(random.random((20_000, 5)) < 0.3, 0, np.where(truth[:, None], 1, -1))
    missed = truth[:, None] & (random.random(cast.shape) < [0.1, 0.2, 0.3, 0.4, 0.4])
    cast = np.where(missed & (cast != 0), -1, cast)
    patterns, place, counts = np.unique(cast, axis=0, return_inverse=True, return_counts=True)
    posterior, likely, prior = weaklabels.estimate(patterns, counts.astype(float))
    assert prior == pytest.approx(0.2, abs=0.03)
    assert likely[1, :, 0] == pytest.approx([0.1, 0.2, 0.3, 0.4, 0.4], abs=0.05)
    assert np.mean((posterior[place.ravel()] > 0.5) == truth) > 0.95


# --- op10 -------------------------------------------------------------------------------------------------


def test_packing_is_as_good_as_best_fit(spark):
    rows = queries.QUERIES["op10_pack_sequences"](spark, SF).collect()
    held, lengths = Counter(), sorted((r["length"] for r in rows), reverse=True)
    for r in rows:
        held[r["sequence_id"]] += r["length"]
    room: list[int] = []
    for length in lengths:
        fits = [i for i, x in enumerate(room) if x >= length]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= length
        else:
            room.append(packing.SEQUENCE - length)
    assert max(held.values()) <= packing.SEQUENCE and len(held) <= len(room)


@pytest.mark.parametrize("times", [1, 7, 10**6])
def test_program_beats_largest_first(times):
    """Halves, and quarters of three kinds: largest first needs 11 sequences where 9 are enough."""
    lengths, counts = np.array([492, 522, 532, 1034]), np.array([12, 6, 6, 6]) * times
    chosen = packing.configurations(lengths, counts)
    assert (sum(c * n for c, n in chosen) == counts).all() and all(c @ lengths <= packing.SEQUENCE for c, _ in chosen)
    left, greedy = counts.copy(), 0
    while left.any():
        config = packing.filling(lengths, left, packing.SEQUENCE)
        number = int((left[config > 0] // config[config > 0]).min())
        left, greedy = left - config * number, greedy + number
    assert sum(n for _, n in chosen) == 9 * times and greedy == 11 * times


def test_program_is_solved(texts):
    """The solution covers every piece once, is within 1 % of its bound, and nearly all sequences come from it."""
    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    sizes = [len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for t in texts.values()]
    cut = [x for n in sizes for x in [packing.SEQUENCE] * (n // packing.SEQUENCE) + [n % packing.SEQUENCE] * (n % packing.SEQUENCE > 0)]
    lengths, counts = np.unique(cut, return_counts=True)
    solution, _ = packing.fractional(lengths, counts, packing.SEQUENCE)
    covered = np.zeros(len(lengths))
    for config, times in solution.uses.items():
        assert sum(int(lengths[j]) * n for j, n in config) <= packing.SEQUENCE
        for j, n in config:
            covered[j] += n * times
    assert covered == pytest.approx(counts) and -1e-9 <= solution.gap <= 0.01
    taken = sum(config * times for config, times in packing.rounded(solution, counts))
    assert (taken <= counts).all() and taken @ lengths >= 0.8 * (counts @ lengths)


@pytest.mark.parametrize("seed", range(12))
def test_any_lengths_are_packed(seed):
    random = np.random.default_rng(seed)
    lengths, counts = np.unique(random.integers(1, 41, random.integers(1, 300)), return_counts=True)
    chosen = packing.configurations(lengths, counts, 40)
    assert (sum(c * n for c, n in chosen) == counts).all() and all(c @ lengths <= 40 and n > 0 for c, n in chosen)
    solution, _ = packing.fractional(lengths, counts, 40)
    assert solution.gap <= 0.05 and sum(n for _, n in chosen) <= solution.bound * 1.03 + 2


def test_packed_ids_match_the_library(spark, texts):
    """start, piece, length and checksum of every piece, from whole texts encoded by the library; ids are carried."""
    tokenizer, want = Tokenizer.from_file(tokens.vocabulary_path()), set()
    for i, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID], dtype="<u4")
        for piece, start in enumerate(range(0, len(ids), packing.SEQUENCE)):
            part = ids[start : start + packing.SEQUENCE]
            want.add((i, piece, start, len(part), zlib.crc32(part.tobytes())))
    rows = queries.QUERIES["op10_pack_sequences"](spark, SF).collect()
    assert len(rows) == len(want) and {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows} == want


def test_rows_without_ids_are_dealt(spark):
    """A third of the rows without an id, a third with one id: the keys of the mix and of packing still differ."""
    df = spark.range(3000).selectExpr("CASE id % 3 WHEN 0 THEN NULL WHEN 1 THEN 5 ELSE id END AS doc_id", "concat('text ', id) AS text", "'s' AS source")
    assert packing.pieces(df).select("key").distinct().count() == 3000
    mixed = mixing.mix(df)
    assert mixed.count() == 3000 and mixed.agg({"taken": "sum"}).first()[0] == 6000


def test_knapsack():
    lengths, prices = np.array([3, 4, 7]), np.array([3.0, 4.5, 7.6])
    assert packing.knapsack(lengths, prices, 14).tolist() == [0, 0, 2]  # 15.2 against 15.0 for [2, 2, 0]


# --- pipeline ---------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, texts, labels):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, scratch = docs.columns, Scratch(spark, "stages")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = scratch.keep(stage(spark, docs, SF))
        assert after.columns == columns
        before, now = Counter(r["doc_id"] for r in docs.collect()), Counter(r["doc_id"] for r in after.collect())
        if name == "near duplicates":
            want = brute_components({i: texts[i] for i in before}, 5, 80)
            assert sorted(now) == sorted({c for _, c in want.values()}) and set(now.values()) == {1}
        elif name == "source mix":
            assert set(now) <= set(before) and max(now.values()) <= 3
        else:
            assert set(now) <= set(before)
            gone = [i for i in before if i not in now and labels.get(i) == 1 and len(words(texts[i])) >= 50]
            assert len(gone) <= 0.01 * len(before)
        docs = after
    rows = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())


@pytest.mark.parametrize("bits", [1, 12])
def test_leaf_sums_come_in_blocks(spark, monkeypatch, bits):
    """The driver gets a row for many leaves, none for each word or leaf."""
    monkeypatch.setattr(maxent, "LEAVES", 1 << 10)
    counts = spark.range(3000).select((F.col("id") * 0x9E3779B97F4A7 - 2**62).alias("key"), (F.col("id") % 9 + 1).alias("n"))
    want = np.zeros(maxent.SURFACES << bits, dtype=np.float32)
    for r in counts.collect():
        want[maxent.nodes(np.array([r["key"]]), bits)[0]] += r["n"]
    got = []
    arrow = type(counts).toArrow
    monkeypatch.setattr(type(counts), "toArrow", lambda df: got.append(arrow(df)) or got[-1])
    assert np.array_equal(maxent.leaf_sums(counts, bits), want)
    assert sum(t.num_rows for t in got) <= max(1, (maxent.SURFACES << bits) >> 10)


# --- op8, steps and scores --------------------------------------------------------------------------------


def test_row_sums_against_plain_addition():
    random = np.random.default_rng(7)
    for rows in (random.zipf(1.4, 3000) % 500, np.zeros(3000, dtype=np.int64), random.integers(0, 1 << 20, 3000), np.empty(0, dtype=np.int64)):
        values = random.normal(size=(max(len(rows) // 3, 1), 5)).astype(np.float32)
        want = np.zeros((int(rows.max(initial=0)) + 1, 5))
        np.add.at(want, rows, np.tile(values, (3, 1))[: len(rows)])
        used, times, sums = maxent.row_sums(rows, values)
        assert (np.diff(times) <= 0).all() and dict(zip(used.tolist(), times.tolist(), strict=True)) == Counter(rows.tolist())
        assert sums == pytest.approx(want[used], abs=1e-3)


@pytest.mark.parametrize("size", [1.0, 60.0])
def test_odds_are_those_of_the_logits(size):
    """Small weights are looked up as exponentials; large ones leave single precision and are added up."""
    random = np.random.default_rng(8)
    kinds = 2_000_000
    leaves = random.integers(0, 9, maxent.SURFACES << sum(maxent.levels_for(kinds))).astype(np.float32)
    none = np.empty(0, dtype=np.int64)
    tables = maxent.Tables(none, none, none, np.ones(maxent.CLASSES), np.zeros(maxent.CLASSES), 10, kinds, leaves)
    weights = [(random.random(s) * 2 - 1).astype(np.float32) * np.float32(size) for s in ((maxent.ROWS, maxent.CLASSES), (3 * tables.inner, maxent.FAN))]
    odds, at = maxent.Odds(weights, tables), np.arange(700)
    assert (odds.classes is None) == (odds.inner is None) == (size > 20)
    rows, goal = random.integers(0, maxent.FEATURES, (700, 3)) + np.arange(3) * maxent.FEATURES, random.integers(0, maxent.CLASSES, 700)
    logits = (weights[0][rows].astype(float).sum(axis=1) + weights[0][-1])
    want = logits - np.log(np.exp(logits - logits.max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)) - logits.max(axis=1, keepdims=True)
    assert odds.class_logs(rows, goal) == pytest.approx(want[at, goal], abs=1e-4 * size)
    out = np.empty((700, maxent.CLASSES), dtype=np.float32)
    maxent.softmax(maxent.class_logits(weights[0], rows), out)
    assert out == pytest.approx(np.exp(want), abs=1e-4)


def test_training_does_not_follow_partitions(spark, texts):
    """Few tokens are trained on by few tasks, however many partitions hold them, so that what moves follows the tokens."""
    rows = [(texts[i],) for i in sorted(texts)[:60]]
    frames = [spark.createDataFrame(spark.sparkContext.parallelize(rows, n), "text string") for n in (1, 12)]
    tables, _ = maxent.make_tables(maxent.count_words(frames[0]), maxent.TABLE)
    start = [np.zeros((maxent.ROWS, maxent.CLASSES), dtype=np.float32), np.zeros((3 * tables.inner, maxent.FAN), dtype=np.float32)]
    one, many = (maxent.train_round(df, start, tables, 0.5) for df in frames)
    assert all(np.abs(a - b).max() < 1e-3 and np.abs(a).max() > 0 for a, b in zip(one, many, strict=True))
    assert maxent.groups_for(1000, 8) == 1 and maxent.groups_for(10**8, 8) == 8 and maxent.groups_for(10**10, 8) > 8
