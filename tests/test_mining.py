"""Search, filters, source analysis, documents, dependencies, state and streams on small hand-made tables."""

import json

from pyspark.sql import functions as F

from oresieve.functions import schemas
from oresieve.functions import source_code
from oresieve.functions.source_code import register
from oresieve.operators import analysis, dependencies, enrich, extraction, report, search
from oresieve.operators.state import State, last_wins, remaining, upserted
from oresieve.plans import pipelines
from oresieve.sources import sinks, snapshots
from oresieve.streaming import incremental

BODY = 'import openai\n@patch("x")\ndef test_x(c):\n    c.chat.completions.create()\n\nclass T:\n    async def test_m(self):\n        self.dispatch()\n\ndef test_x(c):\n    return c.attr.stream\n'


def hit(name, term, seq, page=1, pos=0, **more):
    item = dict(full_name=name, stargazers_count=50, language="Python", created_at="2024-01-01T00:00:00Z", pushed_at="2025-06-01T00:00:00Z", fork=False, archived=False, disabled=False) | more
    return {"run_id": "r", "term": term, "term_seq": seq, "page": page, "pos": pos, "item": item}


def hits(spark, rows):
    return spark.read.schema(schemas.SEARCH_HITS).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def test_first_wins_exclusion_and_flags(spark):
    rows = hits(spark, [hit("a/b", "t2", 1, stargazers_count=9), hit("a/b", "t1", 0, stargazers_count=5), hit("X/y", "t1", 0, pos=1), hit("f/g", "t1", 0, pos=2, fork=True), hit("f/g", "t2", 1, pos=3)])
    known = spark.createDataFrame([("x/Y",)], "full_name string")
    found = {r.full_name: r for r in search.first_wins(search.active(search.excluded(rows, known))).collect()}
    assert {*found} == {"a/b", "f/g"}
    assert found["a/b"]["item"].stargazers_count == 5 and found["a/b"].matched_frameworks == "t1, t2" and found["f/g"].matched_frameworks == "t2"
    assert search.application_queries(spark).count() == 49 and search.framework_queries(spark).count() == 5
    assert search.qualified(rows).count() == 3
    many = hits(spark, [hit(f"r/{k}", "t", 0, k // 100 + 1, k % 100) for k in range(301)])
    assert snapshots.capped(many).count() == 300
    assert search.first_wins(rows.where("false")).count() == 0


def tables(spark):
    contributors = spark.createDataFrame([("a/b", f"c{k}") for k in range(120)] + [("c/d", "x")], schemas.CONTRIBUTORS)
    entries = spark.createDataFrame([("a/b", "main", "blob", "tests/test_a.py"), ("a/b", "main", "blob", "test_b.py"), ("a/b", "main", "tree", "test_c.py"), ("a/b", "main", "blob", "pkg/setup.cfg")], schemas.TREE_ENTRIES)
    return contributors, entries


def test_pipelines_with_reasons(spark):
    contributors, entries = tables(spark)
    rows = hits(spark, [hit("a/b", "t1", 0), hit("c/d", "t1", 0, pos=1), hit("e/f", "t1", 0, pos=2, created_at="2025-05-30T00:00:00Z")])
    known = spark.createDataFrame([], "full_name string")
    commits = spark.createDataFrame([("a/b", 900), ("c/d", 900), ("e/f", 3)], "full_name string, total_commits long")
    v1 = {r.full_name: r for r in pipelines.applications_v1(rows, known, contributors, commits, entries).collect()}
    assert v1["a/b"].drop_reason is None and v1["a/b"].contributors_count == 100 and v1["c/d"].drop_reason == "contributors" and v1["e/f"].drop_reason == "lifetime"
    assert v1["a/b"].commits_per_month == round(900 / (v1["a/b"].lifetime_days / 30.44), 2)
    counted = snapshots.contributor_counts(contributors)
    v2 = pipelines.applications_v2(rows, known, counted, commits, entries)
    assert {r.drop_reason: r.n for r in enrich.drop_counts(v2).collect()} == {"keep": 1, "contributors": 1, "lifetime": 1}
    files = spark.createDataFrame([("a/b", "main", "tests/test_a.py", 200, BODY)], schemas.FILES)
    dates = spark.createDataFrame([("a/b", "main", "s", "2025-06-01")], schemas.COMMITS)
    fw = pipelines.frameworks(rows, contributors, dates, entries, files).collect()
    assert [(r.full_name, r.contributors_count, r.test_file_count, r.test_function_count) for r in fw] == [("a/b", 120, 2, 3)]


def test_functions_of_a_file():
    rows = [*source_code.test_functions(BODY)]
    assert [(r[0], r[1], r[2]) for r in rows] == [(0, "test_x", False), (1, "test_x", False), (2, "test_m", True)]
    assert rows[0][5] == "def test_x(c):\n    c.chat.completions.create()"
    assert [*source_code.test_functions("def test_(:")][0][-1] is False and [*source_code.test_functions("")] == [] and [*source_code.test_functions(None)] == []
    assert [*source_code.test_functions("x = '\x00'")][0][-1] is False
    assert [*source_code.test_functions("def test_a():\n  f()", ["openai"])][0][7] == []


def test_analysis_and_documents(spark):
    register(spark)
    files = spark.createDataFrame([("a/b", "main", "t/test_a.py", 200, BODY), ("a/b", "main", "venv/test_v.py", 200, BODY), ("a/b", "main", "test_e.py", 200, "x = ("), ("c/d", "main", "test_z.py", 404, None)], schemas.FILES)
    repositories = spark.createDataFrame([("a/b", "https://h/a/b", 5), ("c/d", None, 9)], "full_name string, html_url string, stars long")
    summary, tests, documents = pipelines.analysed(repositories, files)
    assert [(r.full_name, r.test_file_count, r.test_function_count, r.llm_test_count) for r in summary.collect()] == [("c/d", 0, 0, 0), ("a/b", 2, 3, 2)]
    assert [(r.file, r.test_function) for r in tests.collect()] == [("t/test_a.py", "test_x"), ("t/test_a.py", "test_x")]
    one, two = "def test_x(c):\n    c.chat.completions.create()", "def test_x(c):\n    return c.attr.stream"
    head = "# a/b\n# 2 LLM-backed test functions across 2 test files\n# Source: https://h/a/b\n\n# --- t/test_a.py ---\n\n"
    assert [r.content for r in documents.collect()] == [f"{head}{one}\n\n{two}\n\n"]
    listed, framework = pipelines.framework_tests(files)
    assert listed.count() == 2
    assert framework.first().content == f"# a/b\n# 2 test functions with real LLM calls\n# Source: https://github.com/a/b\n\n\n# --- t/test_a.py ---\n\n{one}\n\n{one}\n\n"
    assert analysis.failed_clone(repositories).first().clone_status == "failed"
    assert spark.sql("select py_imports('import a.b, c') as x").first().x == ["a", "c"]
    tagged = analysis.tagged(analysis.extracted(analysis.test_files(files)).where("parse_ok"), {"s": "stream", "c": "create"})
    assert sorted(r.tags for r in tagged.collect()) == ["", "c", "s"]
    assert extraction.framework_documents(spark.createDataFrame([], "full_name string, path string, source string, seq int")).count() == 0


def test_dependencies(spark):
    apps = spark.createDataFrame([("a/b", "main"), ("c/d", None), ("n/o", "main"), ("p/q", "main")], "full_name string, default_branch string")
    fws = spark.createDataFrame([("a/b", "main")], "full_name string, default_branch string")
    files = spark.createDataFrame(
        [("a/b", "main", "setup.py", 200, "x\nragas>=1"), ("a/b", "main", "requirements.txt", 200, "opik\nragas"), ("c/d", "main", "setup.cfg", 200, "none"), ("n/o", "main", "sub/setup.py", 200, "'deepeval'"), ("p/q", "main", "z/setup.py", 200, "")],
        schemas.FILES,
    )
    entries = spark.createDataFrame([("n/o", "main", "blob", "sub/setup.py"), ("p/q", "main", "blob", "z/setup.py")], schemas.TREE_ENTRIES)
    state = spark.createDataFrame([], schemas.DEP_STATE)
    both = dependencies.categorised(Applications=apps, Frameworks=fws)
    verdicts, _ = dependencies.root_check(spark, both, files, state)
    got = sorted((r.category, r.full_name, r.verdict, r.frameworks, r.dep_files) for r in verdicts.collect())
    assert got == [("Applications", "a/b", "hit", "opik,ragas", "requirements.txt,setup.py")] * 2 + [("Applications", "c/d", "none", "", ""), ("Applications", "n/o", "no_deps", "", ""), ("Applications", "p/q", "no_deps", "", "")]
    found, bare, new = pipelines.evaluators(spark, apps, fws, files, entries, state)
    assert [(r.full_name, r.frameworks, r.dep_files) for r in found.collect()] == [("a/b", "opik,ragas", "requirements.txt,setup.py"), ("n/o", "deepeval", "sub/setup.py")]
    assert bare.count() == 0 and new.count() == 4
    assert dependencies.match_map(dependencies.matches(files)).where("full_name = 'a/b'").first().matches == {"opik": ["requirements.txt"], "ragas": ["requirements.txt", "setup.py"]}


def test_reports_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a/b", "1150", 3, None, True, 'q"u,\n'), ("c/d", "x", 4, 1, None, ""), ("e/f", "2000", 4, 1, False, "é")], "full_name string, stars string, contributors_count int, test_file_count int, flag boolean, test_function_count string")
    assert [(r[0], r[1]) for r in report.summary(rows).collect()] == [("e/f", 2.0), ("a/b", 1.1), ("c/d", None)]
    sinks.export_csv(rows, str(tmp_path / "o"), ["full_name", "flag", "test_function_count"], ["full_name"])
    back = snapshots.csv_table(spark, str(tmp_path / "o"))
    assert [tuple(r) for r in back.collect()] == [("a/b", "True", 'q"u,\n'), ("c/d", "", ""), ("e/f", "False", "é")]
    sinks.export_csv(rows.where("false"), str(tmp_path / "e"), ["full_name"])
    assert snapshots.csv_or_empty(spark, str(tmp_path / "e"), ["full_name"]).count() == 0 == snapshots.csv_or_empty(spark, str(tmp_path / "missing"), ["z"]).count()
    sinks.write_documents(spark.createDataFrame([("a_b", "x\ny\n\n")], "safe_name string, content string"), str(tmp_path / "d"))
    assert [p.read_text() for p in (tmp_path / "d").glob("safe_name=a_b/*.txt")] == ["x\ny\n\n"]
    assert sorted(tuple(r) for r in sinks.metrics(a=rows, b=rows.where("false")).collect()) == [("a", 3), ("b", 0)]


def test_walk_and_counts(spark, tmp_path):
    root = tmp_path / "a+b.(c)"  # signs that mean something in a pattern
    for name, text in {"t/test_a.py": b"x", ".git/test_b.py": b"y", "venv/c.py": b"z", "bad.py": b"\xff"}.items():
        (root / name).parent.mkdir(exist_ok=True, parents=True)
        (root / name).write_bytes(text)
    got = sorted((r.path, r.content) for r in snapshots.walk(spark, str(root), "a/b").collect())
    assert got == [("bad.py", "\ufffd"), ("t/test_a.py", "x")]
    links = spark.createDataFrame([("a", '<x&page=7>; rel="last"', 1, 200), ("b", None, 2, 200), ("c", None, None, 409)], schemas.COMMIT_LINKS)
    assert [r.n for r in snapshots.link_counts(links, "n").orderBy("full_name").collect()] == [7, 2, 0]


def test_state_and_stream(spark, tmp_path):
    state = State(spark, str(tmp_path / "s"), "full_name string, v int")
    assert state.load().count() == 0
    state.save(spark.createDataFrame([("a", 1), ("b", 1)], "full_name string, v int"))
    assert sorted(tuple(r) for r in state.save(spark.createDataFrame([("b", 2)], "full_name string, v int")).collect()) == [("a", 1), ("b", 2)]
    state.reset()
    assert state.load().count() == 0
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "full_name string, v int")
    assert sorted(tuple(r) for r in last_wins(rows, "full_name", "v").collect()) == [("a", 2), ("b", 1)]
    assert [r[0] for r in remaining(rows, rows.where("v = 2")).collect()] == ["b"] and upserted(rows.where("false"), last_wins(rows, "full_name", "v")).count() == 2
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "1.json").write_text(json.dumps(hit("a/b", "t2", 1)))
    args = spark, str(landing), str(tmp_path / "state"), str(tmp_path / "check")
    incremental.run(*args)
    (landing / "2.json").write_text(json.dumps(hit("a/b", "t1", 0, stargazers_count=7)) + "\n" + json.dumps(hit("c/d", "t1", 0)))
    got = {r.full_name: r for r in incremental.run(*args).load().collect()}
    assert got["a/b"].terms == ["t1", "t2"] and got["a/b"]["item"].stargazers_count == 7 and {*got} == {"a/b", "c/d"}
    seen = spark.createDataFrame([], "full_name string, term string, seen_at timestamp")
    assert incremental.hourly(seen).count() == 0


def test_live_waits():
    from oresieve.sources.live import wait_for

    assert wait_for(403, {"X-RateLimit-Remaining": "0", "X-RateLimit-Reset": "110"}, 0, 100) == 12
    assert wait_for(502, {}, 1, 0) == 10 and wait_for(404, {}, 0, 0) is None


def test_entry_points(spark):
    import __spark_entry__ as entry

    queries, oracles = entry.queries(), entry.oracle_sql()
    assert {*oracles} <= {*queries} and len(queries) >= 30
    assert entry.entry(spark).count() > 0
    assert F.col("x") is not None


def test_source_queries_run_over_all_documents(spark, tmp_path):
    from oresieve.plans.analogues import QUERIES

    texts = ["a 'quoted\" text\\ of\nlines", None, "", "a mock", *(f"text {k}" for k in range(26))]
    rows = [(k, t, ["en", "fr", None][k % 3], "s", 1) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = {name: QUERIES[name](spark, str(tmp_path)).collect() for name in ("py_tests_extract", "py_imports", "llm_classify", "extracted_documents")}
    assert sorted(r.name for r in got["py_tests_extract"]) == sorted([*(f"test_{k}" for k in range(30)), *["test_m"] * 30]) and all(r.parse_ok for r in got["py_tests_extract"])
    assert {r.path: r.imports for r in got["py_imports"]} == {f"tests/test_{k}.py": ["json" if k % 3 else "openai"] for k in range(30)}
    called = {f"test_{k}" for k in range(0, 30, 3)} - {"test_3"}
    assert {r.name for r in got["llm_classify"] if r.is_llm} == called and len(got["llm_classify"]) == 60
    content = {r.full_name: r.content for r in got["extracted_documents"]}
    assert {*content} == {"documents/0", "documents/1", "documents/2"} and sum(c.count("\ndef test_") for c in content.values()) == len(called)
