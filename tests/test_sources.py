"""Clones, folder walks, JSON state, documents' folders, listed commits and progress."""

import json
import subprocess

import pytest

from oresieve.functions import schemas
from oresieve.operators import dependencies, report, state
from oresieve.plans import mining_analogues
from oresieve.sources import clones, sinks, snapshots


def _git(folder, *words):
    subprocess.run(["git", "-C", str(folder), "-c", "user.name=n", "-c", "user.email=e", *words], check=True, capture_output=True)


def test_clones(spark, tmp_path):
    repo = tmp_path / "repo"
    for path, text in {"tests/test_a.py": "x = 'é'\n", "venv/test_b.py": "no", "node_modules/q/test_c.py": "no", "src/a.py": "no", "test_empty.py": ""}.items():
        (repo / path).parent.mkdir(parents=True, exist_ok=True)
        (repo / path).write_text(text)
    (repo / "tests/test_bad.py").write_bytes(b"\xff\n")
    _git(tmp_path, "init", "-q", str(repo))
    _git(repo, "add", "-A")
    _git(repo, "commit", "-qm", "one")
    (tmp_path / "bare").mkdir()
    _git(tmp_path, "init", "-q", str(tmp_path / "bare"))
    _git(tmp_path / "bare", "commit", "-q", "--allow-empty", "-m", "one")
    rows = [("o/a", f"file://{repo}"), ("o/none", f"file://{tmp_path}/missing"), ("o/null", None), ("o/bare", f"file://{tmp_path}/bare"), ("o/opt", "--upload-pack=x")]
    work = tmp_path / "work"
    work.mkdir()
    got = clones.cloned(spark.createDataFrame(rows, "full_name string, clone_url string"), str(work)).collect()
    files = {r.path: r.content for r in got if r.full_name == "o/a"}
    assert files == {"tests/test_a.py": "x = 'é'\n", "test_empty.py": "", "tests/test_bad.py": "�\n"}
    rest = {r.full_name: r for r in got if r.path is None}
    assert {k: r.clone_status for k, r in rest.items()} == {"o/none": "failed", "o/null": "failed", "o/bare": "ok", "o/opt": "failed"}
    assert 0 < len(rest["o/none"].error) <= clones.ERROR_CHARS and rest["o/bare"].error is None
    assert not list(work.iterdir())
    assert "no end" in clones.shallow_clone(f"file://{repo}", str(work / "slow"), 0.0001)
    locked = work / "locked"
    (locked / "sub").mkdir(parents=True)
    (locked / "sub" / "f").write_text("x")
    (locked / "sub" / "f").chmod(0o400)
    clones.remove_tree(str(locked))
    assert not locked.exists()


def test_walk_reads_no_vendored_folder(spark, tmp_path):
    for path in ("a.py", "s p[1]/b.py", ".git/c.py", "x/node_modules/d.py", "x/venvy/e.py"):
        (tmp_path / "r" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / path).write_text(path)
    got = {r.path: r.content for r in snapshots.walk(spark, str(tmp_path / "r"), "o/r").collect()}
    assert got == {p: p for p in ("a.py", "s p[1]/b.py", "x/venvy/e.py")}
    (tmp_path / "v/.git").mkdir(parents=True)
    (tmp_path / "v/.git/x").write_text("x")
    assert snapshots.walk(spark, str(tmp_path / "v"), "o/v").count() == 0


def test_json_state(spark, tmp_path):
    rows = [("a/b", "Applications", "opik", "setup.py", None, None), ("c/d", "Frameworks", "", "", True, True)]
    table = spark.createDataFrame(rows, schemas.DEP_STATE)
    sinks.write_json_state(table, str(tmp_path / "s"))
    assert sorted(map(tuple, snapshots.dependency_state(spark, str(tmp_path / "s")).select(*table.columns).collect())) == rows
    written = json.loads(next((tmp_path / "s").glob("*.txt")).read_text())
    assert written == {"processed": {"a/b": {"category": "Applications", "frameworks": "opik", "dep_files": "setup.py"}, "c/d": {"category": "Frameworks", "frameworks": "", "dep_files": "", "no_deps": True, "deep_checked": True}}}
    assert snapshots.dependency_state(spark, str(tmp_path / "none")).count() == 0
    said = {"completed_search_terms": ["x"], "processed_repos": ["a/b"], "candidates": {"a/b": {"item": {"full_name": "a/b", "stargazers_count": 3}, "frameworks": ["x"]}}, "stats": {"kept": 1}}
    (tmp_path / "p.json").write_text(json.dumps(said, indent=2))
    got = snapshots.search_state(spark, str(tmp_path / "p.json")).first()
    assert got.candidates["a/b"]["item"].stargazers_count == 3 and got.stats.kept == 1 and got.completed_search_terms == ["x"]
    assert snapshots.search_state(spark, str(tmp_path / "none")).first().stats.kept == 0


def test_folders_of_names_that_clash(spark, tmp_path):
    rows = [("a/b_c", "a_b_c", "1"), ("a_b/c", "a_b_c", "2"), ("x/y", "x_y", "3")]
    sinks.write_documents(spark.createDataFrame(rows, "full_name string, safe_name string, content string"), str(tmp_path / "d"))
    folders = sorted(p.name for p in (tmp_path / "d").iterdir() if p.is_dir())
    assert len(folders) == 3 and folders[2] == "safe_name=x_y" and all(f.startswith("safe_name=a_b_c-") for f in folders[:2])


def test_first_listed_commit(spark):
    rows = [("a/b", 1, "2025-01-02"), ("a/b", 0, "2025-01-01"), ("c/d", 0, None), ("c/d", 1, "2025-01-01")]
    table = spark.createDataFrame(rows, "full_name string, pos int, committer_date string")
    assert dict(map(tuple, snapshots.latest_commit_dates(table).collect())) == {"a/b": "2025-01-01", "c/d": None}
    assert dict(map(tuple, snapshots.latest_commit_dates(table.drop("pos")).collect())) == {"a/b": "2025-01-02", "c/d": "2025-01-01"}


def test_categories_keep_the_order_given(spark):
    a = spark.createDataFrame([("o/r", "one", 2), ("o/r", "two", 1)], "full_name string, default_branch string, seq int")
    got = snapshots.default_branches(dependencies.categorised(A=a.repartition(3)).withColumnRenamed("branch", "default_branch")).first()
    assert got.branch == "one"


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "full_name string, n int")
    new = spark.createDataFrame([("b", "x"), ("c", "y")], "full_name string, t string")
    assert sorted(map(str, state.upserted(old, new).collect())) == ["Row(full_name='a', n=1, t=None)", "Row(full_name='b', n=None, t='x')", "Row(full_name='c', n=None, t='y')", "Row(full_name=None, n=3, t=None)"]


def test_progress(spark):
    rows = report.progress(spark.range(1000).repartition(5), "id").collect()
    assert all(r.i == r.id + 1 and r.total == 1000 for r in rows) and len(rows) == 1000
    assert report.progress(spark.range(0), "id").count() == 0


def test_every_mining_query_has_sql():
    assert set(mining_analogues.QUERIES) == set(mining_analogues.ORACLES)


def test_link_flavours_and_strict_sources(spark):
    from pyspark.sql import functions as F

    from oresieve.functions import columns as C
    from oresieve.functions import source_code

    rows = spark.createDataFrame([("a", '<x?per_page=1&page=7>; rel="last"', 3, 200), ("b", '<x?per_page=9>; rel="last"', 3, 200), ("c", None, 3, 200), ("d", None, 3, 451)], schemas.COMMIT_LINKS)
    assert [dict(map(tuple, snapshots.link_counts(rows, "n", page).collect())) for page in (C.last_page, C.last_page_v1)] == [{"a": 7, "b": 3, "c": 3, "d": 0}, {"a": 7, "b": 9, "c": 3, "d": 0}]
    assert rows.select(C.short_error(F.lit(" \n" + "x" * 300))).first()[0] == "x" * 200
    deep = "def test_a():\n    return f()" + ".a" * 3000 + "\n"
    for strict in (False, True):
        got = [*source_code.test_functions("def test_a():\n    f()\n", None, strict)]
        assert got[0][1] == "test_a" and got[0][7] == ["f()"]
    lenient, strict = ([*source_code.test_functions(deep, None, s)] for s in (False, True))
    assert len(lenient) == len(strict) == 1 and (strict[0][-1] is False or strict[0][7] == lenient[0][7])


def test_secrets_come_from_the_environment_or_a_file(tmp_path, monkeypatch):
    from oresieve.sources import live

    (tmp_path / ".env").write_text("# A=0\n\nA=1\nexport B = 'x y' \nC=\"q=r\"\nbad\n")
    assert live.env_file(str(tmp_path / ".env")) == {"A": "1", "B": "x y", "C": "q=r"} and live.env_file(str(tmp_path / "none")) == {}
    monkeypatch.setenv("A", "own")
    monkeypatch.delenv("B", raising=False)
    assert [live.secret(n, str(tmp_path / ".env")) for n in "ABZ"] == ["own", "x y", None] and live.secret("B") is None


def test_csv_round_trip_of_odd_numbers(spark, tmp_path, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    values = [-0.0, 0.0, 0.5, 1e-5, 1e7 + 0.5, 123456789.25, 1e16, 1e23, float("nan"), float("-inf")]
    rows = [(k, f"c{k}", nation, x, "a,b") for k, (nation, x) in enumerate((n, x) for n in (1, 3, 20, None) for x in values)]
    spark.createDataFrame(rows, "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    monkeypatch.setattr(mining_analogues, "_folder", lambda _, name: str(tmp_path / name))
    got = sorted(map(tuple, mining_analogues.QUERIES["csv_round_trip"](spark, str(tmp_path)).collect()))
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW customer AS FROM '{tmp_path}/customer.parquet/*.parquet'")
        assert got == sorted(db.execute(mining_analogues.ORACLES["csv_round_trip"]).fetchall())


def test_exported_floats(spark):
    rows = spark.createDataFrame([(0.1, -0.0), (2.0, None)], "f float, d double")
    assert [tuple(r) for r in sinks.export_text(rows).collect()] == [("0.1", "-0.0"), ("2.0", "")]
