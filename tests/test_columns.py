"""Column expressions against the edge rows that matter, and against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from oresieve.functions import columns as C
from oresieve.functions import constants as K


def values(spark, rows, expression):
    df = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, v string")
    return [r[0] for r in df.orderBy("k").select(expression).collect()]


@pytest.mark.parametrize(
    ("pattern", "expression", "rows"),
    [
        (re.compile(K.TEST_FILE), C.is_test_file, ["test_a.py", "x/test_a.py", "x/test_.py", "x/my_test_a.py", "x/Test_a.py", "t/test_a.pyc", "a/test_b.py\r", "x_test.py", ""]),
        (re.compile(K.DEP_FILE, re.I), C.is_dep_file, ["requirements.txt", "a/Requirements-dev.TXT", "dev-requirements.txt", "requirements/x.txt", "setup.py", "a/setup.cfg", "pyproject.toml", "xsetup.py"]),
        (re.compile(K.MOCK_PATTERN, re.I), C.names_mock, ["dispatch(x)", "a = 1", "MagicMock()", "# Fixture", ""]),
        (re.compile(K.CALL_PATTERN, re.I), C.names_call, ["asyncio.run(x)", "cfg.Stream", "parse_streams", "a.b", "x.chat.completions.create()"]),
    ],
)
def test_patterns_agree_with_python(spark, pattern, expression, rows):
    assert values(spark, rows, expression(F.col("v"))) == [bool(pattern.search(r)) for r in rows]


def test_dependency_edges(spark):
    yes = ["opik", "opik==1", "opik!=1", "opik[a]", "x[opik]", "OPIK>=1", "# opik note", "a\nopik\nb", '"opik"']
    no = ["opik~=1", "opik;m", "opik-x", "opik.x", "opik@git", "(opik", "=opik", "/opik"]
    assert values(spark, yes + no, C.depends_on(F.col("v"), "opik")) == [True] * len(yes) + [False] * len(no)
    assert values(spark, ["arize-phoenix>=4", "phoenix"], C.depends_on(F.col("v"), K.EVALUATOR_PACKAGES["phoenix"])) == [True, False]


def test_days_are_periods_of_24_hours(spark):
    rows = [("2024-01-01T12:00:00Z", "2024-01-31T11:59:59Z", 29), ("2024-01-01T12:00:00Z", "2024-01-31T12:00:00Z", 30), ("2024-01-02T00:00:00Z", "2024-01-01T23:00:00Z", -1), (None, "2024-01-01T00:00:00Z", None), ("bad", "2024-01-01T00:00:00Z", None)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    got = df.select(C.whole_days(C.moment(F.col("a")), C.moment(F.col("b"))).alias("d"), "want").collect()
    assert all(r.d == r.want for r in got)


def test_round_is_pythons(spark):
    rows = [x / 1000 for x in range(1000, 9000, 50)] + [2.675, 1.005, -0.5, 1e9 + 0.05]
    df = spark.createDataFrame([(x,) for x in rows], "x double")
    assert [r[0] for r in df.select(C.py_round(F.col("x"), 1)).collect()] == [round(x, 1) for x in rows]
    assert df.where("false").select(C.py_round(F.col("x"), 1)).collect() == []


def test_numbers_are_pythons(spark):
    rows = [0.0, -0.0, 0.001, -9.99e-4, 1e-5, 2.5, 48.0, -300.1, 9999999.0, 1e7, 1e7 + 0.5, 123456789.25, 1e15, 1e15 + 0.5, 9999999999999998.0, 1e16, 1e23, 2e23, 5e-324, 1.7976931348623157e308, float("inf"), float("-inf"), float("nan")]
    rows += [n / 100 for n in range(-1000, 1000)] + [7.0 ** n / 3 for n in range(-40, 40)]
    df = spark.createDataFrame([(k, x) for k, x in enumerate([*rows, None])], "k int, x double")
    assert [r[0] for r in df.orderBy("k").select(C.number_text(F.col("x"))).collect()] == [*map(repr, rows), None]
    assert df.where("false").select(C.number_text(F.col("x"))).collect() == []


def test_small_helpers(spark):
    df = spark.createDataFrame([("a/b_c/x", None, "", ["t", "u"]), ("solo", [], None, None)][:1], "n string, t string, e string, l array<string>")
    r = df.select(
        C.owner_of(F.col("n")), C.repo_of(F.col("n")), C.safe_name(F.col("n")), C.or_default(F.col("t"), "main"), C.or_default(F.col("e"), "main"),
        C.or_default(F.col("e"), "main", True), C.joined(F.col("l")), C.flag_text(F.lit(True)), C.number_text(F.lit(48.0)), C.number_text(F.lit(12345678.0)),
        C.last_page(F.lit('<u?per_page=1&page=57>; rel="last"')), C.last_page(F.lit("x")), C.search_query(F.lit("k")),
    ).first()
    assert list(r) == ["a", "b_c/x", "a_b_c_x", "main", "", "main", "t,u", "True", "48.0", "12345678.0", 57, None, '"k" language:Python stars:>10 pushed:>2025-04-14']
    assert len(K.APPLICATION_TERMS) == 49 and len(K.MODEL_MODULES) == 19 and len(K.EVALUATOR_MODULES) == 7
