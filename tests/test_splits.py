"""Files read by byte ranges against readers that take a whole file in one task."""

import csv
import io
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.sources import readers, splits


@pytest.fixture
def ranges_of(spark):
    """Make Spark cut files into ranges of so many bytes."""
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")
    before = {k: spark.conf.get(k, None) for k in settings}

    def cut(size):
        for key, value in zip(settings, (size, 0, 1), strict=True):
            spark.conf.set(key, value)

    yield cut
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


FIELDS = ["", "x", "two words", "a,b", 'say "hi"', "line\nbreak", "three\n\nlines\n", '"', '""', '\n"\n', ",", '","', "é\n日本", " ", "y" * 90]


def body_of(seed, rows, quoting=csv.QUOTE_MINIMAL, end="\n", sep=","):
    dice, out = random.Random(seed), io.StringIO()
    writer = csv.writer(out, quoting=quoting, lineterminator=end, delimiter=sep)
    writer.writerow(["id", "a", "b,c"])
    table = [[str(i), dice.choice(FIELDS), dice.choice(FIELDS) * dice.randint(1, 3)] for i in range(rows)]
    writer.writerows(table)
    return out.getvalue(), table


def whole_files(spark, path, header, sep=","):
    """The reader that takes a file in one task."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*header, readers.BAD_RECORD]])
    read = spark.read.schema(schema).option("header", True).option("multiLine", True).options(**readers.text_options(sep))
    return read.option("columnNameOfCorruptRecord", readers.BAD_RECORD).csv(path)


def sorted_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", [11, 900])
@pytest.mark.parametrize(("quoting", "end", "sep"), [(csv.QUOTE_MINIMAL, "\n", ","), (csv.QUOTE_ALL, "\r\n", "\t")])
def test_ranges_give_the_rows_of_whole_files(spark, ranges_of, tmp_path, size, quoting, end, sep):
    rows = 25 if size < 50 else 200
    for name in ("one", "two"):
        text, _ = body_of(name, rows, quoting, end, sep)
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    header = ["id", "a", "b,c"]
    want = sorted_rows(whole_files(spark, str(tmp_path), header, sep))
    ranges_of(size)
    found = readers.raw_text(spark, [str(tmp_path)], header, sep, multi_line=True)
    assert sorted_rows(found) == want
    assert len(want) == 2 * rows


def test_rows_are_what_was_written(spark, ranges_of, tmp_path):
    text, table = body_of(9, 500, csv.QUOTE_ALL)
    (tmp_path / "t.csv").write_text(text)
    ranges_of(256)
    found = readers.read_csv(spark, str(tmp_path / "t.csv"))
    assert found.dtypes == [("id", "bigint"), ("a", "string"), ("b,c", "string")]
    assert [[str(r[0]), *r[1:]] for r in sorted(found.collect(), key=lambda r: r[0])] == table


def test_a_range_is_a_task(spark, ranges_of, tmp_path):
    text, table = body_of(4, 3000)
    (tmp_path / "t.csv").write_text(text)
    ranges_of(len(text.encode()) // 10)
    form = splits.Delimited(",")
    states = splits.ranges(spark, [str(tmp_path)], form)
    assert states.count() in (10, 11)
    assert {tuple(r["state"]) for r in states.collect()} == {(0,), (1,)}
    lines = splits._lines(spark, [str(tmp_path)], form)
    assert lines.rdd.getNumPartitions() in (10, 11)


@pytest.mark.parametrize(
    "text",
    [
        'a,b\n1,5" pipe\n2,"x\ny"\n3,7" pipe\n', 'a,b\n1,"x"y,z"\n2,"p\nq"\n', 'a,b\n1,"x"" y"\n2,""\n3,"""q"""\n4,"r\n""s"""\n',
        '\n\na,b\n\n1,"x\n\ny"\n\n', 'a,b\n1,x"\n2,"y\nz"', 'a,b\n"1\n2","3\n4",5\n6\n',
    ],
)
@pytest.mark.parametrize("size", [5])
def test_stray_quotes_and_breaks(spark, ranges_of, tmp_path, text, size):
    (tmp_path / "t.csv").write_text(text)
    want = sorted_rows(whole_files(spark, str(tmp_path), ["a", "b"]).drop(readers.BAD_RECORD))
    ranges_of(size)
    found = readers.raw_text(spark, [str(tmp_path)], ["a", "b"], ",", multi_line=True)
    assert sorted_rows(found.drop(readers.BAD_RECORD)) == want


def test_a_field_that_is_never_closed(spark, ranges_of, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n0,x\n1,"never\nclosed\n2,x\n')
    ranges_of(6)
    assert sorted_rows(readers.read_csv(spark, str(tmp_path / "t.csv"))) == [(0, "x"), (1, "never\nclosed\n2,x")]


def test_a_field_over_many_ranges(spark, ranges_of, tmp_path):
    long = "\n".join(f"line {i}" for i in range(400))
    (tmp_path / "t.csv").write_text(f'a,b\n1,"{long}"\n2,x\n3,"{long}"\n')
    ranges_of(100)
    found = sorted_rows(readers.read_csv(spark, str(tmp_path / "t.csv")))
    assert found == [(1, long), (2, "x"), (3, long)]


def test_a_header_over_lines_and_an_empty_table(spark, ranges_of, tmp_path):
    (tmp_path / "one.csv").write_text('"a\nb",c\n1,"x\ny"\n')
    (tmp_path / "none.csv").write_text('"a\nb",c\n')
    ranges_of(3)
    assert sorted_rows(readers.raw_text(spark, [str(tmp_path)], ["a", "c"], ",", multi_line=True).drop(readers.BAD_RECORD)) == [("1", "x\ny")]


@pytest.mark.parametrize("size", [9, 400])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_by_ranges(spark, ranges_of, tmp_path, size, indent):
    dice = random.Random(size)
    texts = ["", "x", "}", "{", "},{", '"', '\\"}', "\\", "[{]", "a\nb", "é}日", "]"]
    rows = 12 if size < 10 else 120
    records = [
        {"id": i, "t": dice.choice(texts) * dice.randint(0, 3), "o": {"p": dice.choice(texts), "l": [{"q": 1}, {"q": dice.choice(texts)}]}}
        for i in range(rows)
    ]
    for name, part in (("one", records[: rows // 2]), ("two", records[rows // 2 :]), ("none", [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(part, indent=indent, ensure_ascii=dice.random() < 0.5))
    want = sorted_rows(spark.read.option("multiLine", True).json(str(tmp_path)))
    ranges_of(size)
    found = readers.read_json(spark, str(tmp_path))
    assert sorted_rows(found) == want
    assert [r["id"] for r in found.orderBy("id").collect()] == list(range(rows))


@pytest.mark.parametrize("text", ['[{"a": 1}, 2, {"a": 3}]', '[{"a": 1}, {"a": ]', '[{"a": 1} {"a": 2}]', '[{"a": 1}, {"a": 2'])
def test_what_is_no_record_is_an_error(spark, ranges_of, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    ranges_of(6)
    with pytest.raises(ValueError, match="not a JSON record"):
        readers.read_json(spark, str(tmp_path))


def test_effects_compose():
    """A state carried through pieces of a text is the state of the whole."""
    dice = random.Random(1)
    for form, letters in ((splits.Delimited(","), ['"', ",", "x", '""']), (splits.JsonArray(), ['"', "{", "[", "]", '\\"', "x", "}"])):
        for _ in range(200):
            lines = ["".join(dice.choice(letters) for _ in range(dice.randint(0, 6))) for _ in range(dice.randint(1, 8))]
            if isinstance(form, splits.JsonArray):
                lines = "}".join(lines).split("}")
            for state in form.begin():
                want = form.after(pa.array(lines), state)
                steps, at = [], state
                for line in lines:
                    at = tuple(form.after(pa.array([line]), at)[0].tolist())
                    steps.append(at)
                assert np.array_equal(want, np.array(steps)), (lines, state)


def test_arrays_that_come_to_one_task(spark, tmp_path):
    """Every array has a file of its own, however many a task writes."""
    from larkspur.plans import queries

    path = str(tmp_path / "arrays.json")
    rows = spark.range(120_000).withColumn("text", F.concat(F.lit('a "b" [c] \n}'), F.col("id").cast("string")))
    queries.as_arrays(rows, path)  # seven arrays
    assert sum(p.stat().st_size > 0 for p in (tmp_path / "arrays.json").glob("part-*")) == 7
    found = readers.read_json(spark, path)
    assert found.exceptAll(rows.select(*found.columns)).count() == 0 and found.count() == 120_000
