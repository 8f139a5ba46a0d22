"""Nulls, empty and long texts, ties, repeated rows, empty tables, and columns with names like the operators' own."""

import re
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from larkspur.llm import huffman, licenses, maxent, mixing, neardup, packing, rules, sharding, weaklabels

PROSE = "The cat sat on the mat, and the dog lay by the door of a house in town. "
TEXTS = [
    None, "", " \t\n ", "one", "two words", PROSE * 4, PROSE * 4, PROSE.upper() * 4, "x " * 400, "día niño über façade Ünï ß",
    PROSE * 2000, "Licensed under the MIT License.", "a | b | c | d | e | f | g", "<|endoftext|> don't 1,000 ﬁ 日本語\x0b\x0c tab",
]
CLASHES = [
    "size", "row", "key", "id", "hi", "lo", "part", "shard", "slot", "kept", "score", "v", "bucket", "target", "copies", "words",
    "digest", "license", "pattern", "held_out", "length", "number", "weak_label", "n_words", "text_key", "before", "sid", "r", "a.b", "a b.c", "a`b",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 5 == 4 else f"s{i % 3}") for i, t in enumerate(TEXTS)]
    rows += [(None, PROSE, "s0"), (None, None, None), rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit(c) for c in CLASHES}).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(5, 1), (6, 1), (None, 1), (8, 0), (99, None)], "doc_id long, quality int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def run_all(df, labels, path):
    """Every operator over documents, as lists of rows."""
    huffman.write_coded(df, path)
    return {
        1: sharding.shard_by_bytes(df).collect(),
        2: rules.judge(df, labels).collect(),
        3: huffman.read_coded(df.sparkSession, path).collect(),
        4: mixing.mix(df).collect(),
        6: licenses.scan(df, licenses.known_licenses(df.sparkSession)).collect(),
        7: neardup.near_duplicates(df).collect(),
        8: maxent.score(df).collect(),
        9: weaklabels.classify(df).collect(),
        10: packing.pack(packing.pieces(df)).collect(),
    }


@pytest.fixture(scope="module")
def found(docs, labels, tmp_path_factory):
    return run_all(docs, labels, str(tmp_path_factory.mktemp("coded")))


def test_every_row_is_there(docs, found):
    ids = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    for number, rows in found.items():
        if number == 10:
            rows = [r for r in rows if r["piece"] == 0]
        assert Counter(r["doc_id"] for r in rows) == ids, number


def test_other_columns_stay(found):
    assert all(r["digest"] == "digest" and r["bucket"] == "bucket" for n in (1, 2, 4, 9) for r in found[n])


def test_sizes_and_slots(found):
    assert all(r["size"] == len((r["text"] or "").encode()) + 1 for r in found[1])
    for shard in {r["shard"] for r in found[1]}:
        assert sorted(r["slot"] for r in found[1] if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in found[1])))


def test_rules_of_empty_texts(found):
    for r in found[2]:
        assert r["n_words"] == len(words(r["text"]))
        if not words(r["text"]):
            assert r["base_failed"] and not r["kept"] and r["score"] == 0


def test_ids_read_back(docs, found):
    from tokenizers import Tokenizer

    from larkspur.llm.tokens import vocabulary_path

    tokenizer = Tokenizer.from_file(vocabulary_path())
    want = Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, huffman.END_ID]
        want[r["doc_id"], len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))] += 1
    assert Counter((r["doc_id"], r["n_tokens"], zlib.crc32(r["ids"])) for r in found[3]) == want
    ordered = sorted(found[3], key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == [sum(x["n_tokens"] for x in ordered[:i]) for i in range(len(ordered))]


def test_mix_keeps_to_budgets(found):
    for source in {r["source"] for r in found[4]}:
        rows = [r for r in found[4] if r["source"] == source]
        assert rows[0]["source_size"] == sum(r["size"] for r in rows)
        assert all(r["taken"] <= 3 * r["size"] for r in rows)
        assert abs(sum(r["taken"] for r in rows) - rows[0]["target"]) <= max(r["size"] for r in rows) / 2


def test_licenses(found):
    by_id = {r["doc_id"]: r for r in found[6]}
    assert by_id[11]["license"] == "MIT" and by_id[11]["line_licenses"] == "MIT" and by_id[0]["digest"] is None


def test_components(found):
    rows = {r["doc_id"]: r for r in found[7] if r["doc_id"] is not None}
    assert rows[0]["n_shingles"] == rows[1]["n_shingles"] == rows[2]["n_shingles"] == 0 and rows[1]["kept"] and rows[2]["kept"]
    assert rows[3]["n_shingles"] == rows[4]["n_shingles"] == 1
    assert rows[5]["component_id"] == rows[6]["component_id"] == rows[7]["component_id"] == 5 and not rows[7]["kept"]


def test_scores(found):
    for r in found[8]:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1)
        assert r["score"] < 0 and r["score"] > -1e7


def test_packing_holds_all(found):
    sequences = {}
    for r in found[10]:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048


def test_empty_tables(docs, labels, tmp_path):
    assert not any(run_all(docs.limit(0), labels.limit(0), str(tmp_path)).values())


def test_deduplicated_rows(docs):
    kept = neardup.deduplicated(docs)
    assert kept.columns == docs.columns
    found = Counter(r["doc_id"] for r in kept.select("doc_id").collect())
    assert found[5] == 1 and found[6] == 0 and found[7] == 0 and found[0] == 1


def test_deduplicated_without_ids(spark):
    """Unrelated texts stay, whether their ids are null or repeat; near copies go, and one with an id goes before one without."""
    prose = [" ".join(f"{w}{i}" for i in range(60)) for w in "abcdefg"]
    near = [p + " end" for p in prose]
    rows = [(None, p) for p in prose[:4]] + [(7, p) for p in prose[4:6]] + [(None, near[0]), (None, near[4]), (8, near[1]), (7, prose[6]), (9, near[6])]
    rows += [(None, None), (None, ""), (7, ""), (None, prose[2]), (7, prose[5])]
    kept = [(r[0], r[1]) for r in neardup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    want = [(None, prose[2]), (None, prose[3]), (8, near[1]), *[(7, p) for p in prose[4:7]], (None, None), (None, ""), (7, "")]
    first = [x for x in kept if x in [(None, prose[0]), (None, near[0])]]
    assert len(first) == 1 and Counter(x for x in kept if x not in first) == Counter(want)


def test_whole_licenses(spark):
    """Whole licences wrapped, re-cased and re-spelled, under copyright lines of any form, and texts that are not quite licences."""
    lines = ["Copyright (c) 2020 A. Person", "Copyright by A. Person 2020", "Copyright: 2020 A. Person", "Copyright The Project Authors", "Copyright A. Person, 2019-2021", "© 2020"]
    rows, want = [], {}

    def add(text, name):
        want[len(rows)] = name
        rows.append((len(rows), text))

    for name, texts in licenses.whole_licenses().items():
        for text in texts:
            paragraphs = [" ".join(p.split()) for p in re.split(r"\n\s*\n", re.sub(r"(?mi)^\W*copyright \(c\).*$", "", text))]
            add(text, name)
            for width in (40, 48, 61, 79, 10**6):
                add("\n\n".join(textwrap.fill(p, width, break_long_words=False, break_on_hyphens=False) for p in paragraphs).upper(), name)
    texts = licenses.whole_licenses()
    for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause"):
        for line in lines:
            add(f"{line}\n\n{texts[name][0]}", name)
    add(texts["MIT"][0].replace("sublicense", "sub-license").replace("MERCHANTABILITY", "MERCHANTIBILITY"), "MIT")
    add(texts["Apache-2.0"][0].replace("License", "Licence").replace("[yyyy] [name of copyright owner]", "2020 A. Person"), "Apache-2.0")
    add(texts["MIT"][0].replace("without restriction", "with restriction"), None)
    found = {r["doc_id"]: r["license"] for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string"), licenses.known_licenses(spark)).collect()}
    assert {i: (want[i], found[i], rows[i][1][:60]) for i in want if found[i] != want[i]} == {}
