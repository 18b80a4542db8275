"""Queries against their SQL on rows that the provided tables do not hold."""

import datetime

import duckdb
import pytest

import __spark_entry__
from postloom.functions import text


@pytest.fixture
def both(spark, tmp_path):
    """A function of a query's name, a table's name and its rows: the rows that Spark and DuckDB give."""

    def run(name: str, table: str, rows: list, schema: str) -> tuple[list, list]:
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{table}.parquet")
        con = duckdb.connect()
        con.execute("set threads = 1")
        con.execute(f"create view {table} as from read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        got = __spark_entry__.queries()[name](spark, str(tmp_path)).collect()
        return sorted(map(tuple, got), key=str), sorted(con.execute(__spark_entry__.oracle_sql()[name]).fetchall(), key=str)

    return run


@pytest.mark.parametrize(
    ("said", "source", "reason"),
    [
        ("thin of end with\nthat with of the", "src1", "title_mismatch"),  # resembles a role by the ratio only
        ("ta deale", "src3", "title_mismatch"),
        (None, "src1", "passed"),
        (None, "src3", "excluded_company"),
        ("thing", "SRC3", "few_skills"),
        ("thing that with of the", None, "passed"),
        ("thİng that wİth of the", "src1", "passed"),
        ("\U00010428thing", "src1", "title_mismatch"),  # beside a letter beyond U+FFFF
        ("thing, \U00010428lead", "src1", "few_skills"),
        ("\U0001f600thing, lead", "src1", "seniority"),
    ],
)
def test_rule_cascade_reasons(both, said, source, reason):
    got, want = both("rule_cascade_reasons", "documents", [(1, said, source, "en")], "doc_id long, text string, source string, lang string")
    assert got == want == [(reason, 1)]


def test_words_beside_letters_beyond_the_basic_plane(spark):
    title = "chef \U00010428head \U0001f600lead_ vṕ the sr-dev"
    assert spark.createDataFrame([(title,)], "t string").select(text.title_words("t")).first()[0] == ["chef", "sr", "dev"]


def test_span_union_years(both):
    at = lambda *x: datetime.datetime(*x)
    rows = [
        (1, at(1995, 1, 1)), (1, at(1995, 1, 1)), (1, at(1995, 4, 1)), (1, at(1995, 7, 1)), (1, None),
        (2, None), (3, None), (3, None), (4, at(1969, 12, 31, 23)), (4, at(1970, 3, 31)), (None, None), (None, at(1999, 1, 1)),
    ]
    got, want = both("span_union_years", "orders", rows, "o_custkey long, o_orderdate timestamp_ntz")
    assert got == want == sorted([(1, 2, 270), (2, 1, None), (3, 2, None), (4, 1, 180), (None, 1, 90)], key=str)
