import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))

from larkspur.session import build_session  # noqa: E402

TESTDATA = Path(os.environ.get("TESTDATA", "/root/testdata"))
PEOPLE = "name,age,city\nAlice,30,Hanoi\nBob,25,Saigon\nCarol,,Hanoi\nDave,40,Saigon\n"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "larkspur-tests",
        "local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("shared")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf001():
    return str(TESTDATA / "sf0.001")


@pytest.fixture
def people(spark):
    rows = [("Alice", 30, "Hanoi"), ("Bob", 25, "Saigon"), ("Carol", None, "Hanoi"), ("Dave", 40, "Saigon")]
    return spark.createDataFrame(rows, "name string, age bigint, city string")
