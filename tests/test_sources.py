import datetime as dt
import shutil
import zipfile

import pytest
from conftest import PEOPLE
from pyspark.sql import functions as F

from larkspur.sources import infer, readers
from larkspur.sources.excel import read_workbooks
from larkspur.sources.workbook_writer import as_workbooks, workbook


@pytest.fixture
def write(tmp_path):
    def put(name, content):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return put


def test_people_csv(spark, write):
    df = readers.read_any(spark, write("people.csv", PEOPLE))
    assert df.dtypes == [("name", "string"), ("age", "bigint"), ("city", "string")]
    assert df.count() == 4 and df.where("age IS NULL").first()["name"] == "Carol"


def test_ten_thousand_rows(spark, write):
    path = write("big.csv", "id,v\n" + "".join(f"{i},{i / 4}\n" for i in range(10_000)))
    df = readers.read_csv(spark, path)
    assert df.count() == 10_000 and df.dtypes == [("id", "bigint"), ("v", "double")]


def test_type_broken_late(spark, write):
    path = write("late.csv", "v\n" + "1\n" * 10_500 + "x\n")
    assert readers.read_csv(spark, path).dtypes == [("v", "string")]


@pytest.mark.parametrize(
    "values, expected",
    [
        (["1", "-2", "+3"], "bigint"),
        (["1", "2.5", "1e3", ".5", "7."], "double"),
        (["true", "false"], "boolean"),
        (["true", "1"], "string"),
        ([" 1 "], "string"),
        (["1d"], "string"),
        (["t", "yes"], "string"),
        (["2024-01-01"], "string"),
        (["99999999999999999999"], "double"),
        (["1", None], "bigint"),
        ([None, None], "string"),
        (["NaN", "inf", "-inf"], "double"),
        (["1", ""], "string"),
    ],
)
def test_inference(spark, values, expected):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert infer.infer_schema(df) == {"v": expected}


def test_quotes_breaks_and_empty_fields(spark, write):
    path = write("q.csv", 'a,b,c\n1,"say ""hi"", ok",x\n2,"two\nlines",\n3,"",y\n4,,z\n5\n')
    got = {r["a"]: (r["b"], r["c"]) for r in readers.read_csv(spark, path).collect()}
    assert got == {1: ('say "hi", ok', "x"), 2: ("two\nlines", None), 3: ("", "y"), 4: (None, "z"), 5: (None, None)}


def test_splittable_files(spark, write):
    plain, broken = write("plain.csv", "a,b\n1,x\n2,y\n"), write("broken.csv", 'a,b\n1,"x\ny"\n')
    assert not readers.spans_lines(spark, plain) and readers.spans_lines(spark, broken)
    assert readers.read_csv(spark, plain).count() == 2
    assert readers.read_csv(spark, broken).collect()[0]["b"] == "x\ny"


def test_too_many_fields_is_an_error(spark, write):
    with pytest.raises(ValueError, match="more fields"):
        readers.read_csv(spark, write("long.csv", "a,b\n1,2\n3,4,5\n"))
    assert readers.read_csv(spark, write("ok.csv", 'a,b\n1,"x,y"\n2\n')).count() == 2


def test_tsv_json_parquet(spark, write, tmp_path):
    df = readers.read_any(spark, write("t.TSV", "a\tb\n1\tx,y\n"))
    assert [tuple(r) for r in df.collect()] == [(1, "x,y")]
    assert readers.read_any(spark, write("l.json", '{"a":1,"b":"x"}\n{"a":2}\n')).dtypes == [("a", "bigint"), ("b", "string")]
    assert readers.read_any(spark, write("a.json", '[{"a":1},\n {"a":2}]')).count() == 2
    path = str(tmp_path / "p.parquet")
    df.write.parquet(path)
    assert readers.read_any(spark, path).collect() == df.collect()


def test_registry(spark, write):
    assert {".csv", ".tsv", ".xlsx", ".parquet", ".json"} <= set(readers.supported_extensions())
    assert readers.supported_extensions() == sorted(readers.supported_extensions())
    with pytest.raises(ValueError, match="Unsupported file format: .unknown"):
        readers.read_any(spark, "data.unknown")

    @readers.register_reader([".PSV"])
    def read_psv(session, path):
        return readers.read_csv(session, path, sep="|")

    try:
        assert readers.read_any(spark, write("x.psv", "a|b\n1|2\n")).collect()[0]["b"] == 2
    finally:
        del readers.READERS[".psv"]


def test_guard(spark, write, tmp_path):
    for name, content in {"ok.csv": "a\n1\n", "data.unknown": "random", "big.csv": "a\n" + "1\n" * 600_000, ".csv": "a\n"}.items():
        write(f"in/{name}", content)
    found = {r["original_name"]: (r["file_format"], r["error"]) for r in readers.guard_files(spark, str(tmp_path / "in"), 1).collect()}
    assert found["ok.csv"] == ("csv", None)
    assert found["data.unknown"] == ("unknown", "unsupported_format")
    assert found["big.csv"] == ("csv", "file_too_large")
    files = spark.createDataFrame([("file:/x/", None, 1)], "path string, modificationTime timestamp, length bigint")
    assert readers.checked_files(files).first()["error"] == "missing_filename"


def test_excel_types(spark, write):
    book = workbook(
        ["id", "when", "day", "ok", "text", "num", "mixed", "id", None],
        [
            [1, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 2, 29), True, "é<&> z", 1.5, 1, 7, None],
            [2, None, None, False, None, 2, "x", 8, None],
            [None] * 9,
        ],
    )
    df = readers.read_any(spark, write("x.xlsx", book))
    assert df.dtypes == [
        ("id", "bigint"), ("when", "timestamp_ntz"), ("day", "date"), ("ok", "boolean"), ("text", "string"),
        ("num", "double"), ("mixed", "string"), ("id_0", "bigint"), ("__UNNAMED__8", "string"),
    ]
    first, second = df.orderBy("id").collect()
    assert tuple(first)[:6] == (1, dt.datetime(2024, 1, 2, 3, 4, 5), dt.date(2024, 2, 29), True, "é<&> z", 1.5)
    assert tuple(second)[:7] == (2, None, None, False, None, 2.0, "x")


def test_excel_shared_strings_and_references(spark, tmp_path):
    """Parts as spreadsheet programs write them: shared strings, cell references, gaps, custom date format."""
    from larkspur.sources import workbook_writer as W

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    parts = dict(W.PARTS)
    parts["xl/sharedStrings.xml"] = f"<sst {main}><si><t>name</t></si><si><r><t>An</t></r><r><t>na</t></r></si><si><t>day</t></si></sst>"
    parts["xl/styles.xml"] = (
        f'<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm\\-dd"/></numFmts>'
        '<cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>'
    )
    parts["xl/worksheets/sheet1.xml"] = (
        f'<worksheet {main}><sheetData><row r="1"/><row r="2"><c r="B2" t="s"><v>0</v></c><c r="D2" t="s"><v>2</v></c></row>'
        '<row r="3"><c r="B3" t="s"><v>1</v></c><c r="D3" s="1"><v>45292</v></c></row></sheetData></worksheet>'
    )
    with zipfile.ZipFile(tmp_path / "s.xlsx", "w") as book:
        for name, text in parts.items():
            book.writestr(name, text)
    row = readers.read_excel(spark, str(tmp_path / "s.xlsx")).first()
    assert row.asDict() == {"name": "Anna", "__UNNAMED__1": None, "day": dt.date(2024, 1, 1)}


def test_many_workbooks(spark, write, tmp_path, sf001):
    table = spark.read.parquet(f"{sf001}/orders.parquet")
    back = read_workbooks(as_workbooks(table))
    assert back.dtypes == table.dtypes and back.exceptAll(table).count() == 0 and back.count() == table.count()
    write("w/a.xlsx", workbook(["a"], [[1]]))
    write("w/b.xlsx", workbook(["a"], [[2.5]]))
    assert sorted(r["a"] for r in readers.read_excel(spark, str(tmp_path / "w" / "*.xlsx")).collect()) == [1.0, 2.5]
    write("w/c.xlsx", workbook(["b"], [[3]]))
    with pytest.raises(ValueError, match="share one header"):
        readers.read_excel(spark, str(tmp_path / "w" / "*.xlsx"))
    with pytest.raises(ValueError, match="BadZipFile"):
        readers.read_excel(spark, write("bad.xlsx", b"not a zip"))


def test_sql_options():
    plain = readers.sql_options("jdbc:x:y", "t", user="u")
    assert plain == {"url": "jdbc:x:y", "dbtable": "t", "fetchsize": "10000", "user": "u"}
    parallel = readers.sql_options("jdbc:x:y", "t", "id", (0, 100), 4)
    assert (parallel["partitionColumn"], parallel["lowerBound"], parallel["upperBound"], parallel["numPartitions"]) == ("id", "0", "100", "4")
    with pytest.raises(ValueError):
        readers.sql_options("jdbc:x:y", "t", "id")


def test_long_field_of_a_ragged_row(spark, write):
    body = 'a,b\n1,2\n3,4,"' + "x" * 1_000_000 + '"\n'
    with pytest.raises(ValueError, match="more fields"):
        readers.read_csv(spark, write("long_field.csv", body))


def test_headers_in_different_orders(spark, write, tmp_path):
    write("turned/one.csv", "a,b\n1,x\n")
    write("turned/two.csv", "b,a\ny,2\n")
    rows = readers.read_csv(spark, str(tmp_path / "turned")).select("a", "b").collect()
    assert sorted(map(tuple, rows)) == [(1, "x"), (2, "y")]


def test_json_of_both_kinds(spark, write, tmp_path):
    (tmp_path / "both").mkdir()
    write("both/one.json", '[{"a": 1}, {"a": 2}]')
    write("both/two.json", '{"a": 3}\n{"a": 4, "b": "x"}\n')
    assert sorted(r["a"] for r in readers.read_json(spark, str(tmp_path / "both")).collect()) == [1, 2, 3, 4]
    with pytest.raises(ValueError, match="not a JSON record"):
        readers.read_json(spark, write("broken.json", '{"a": 1}\nnothing\n'))
