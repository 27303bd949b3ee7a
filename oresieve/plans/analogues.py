"""The engine's operators over the star-schema tables, with DuckDB SQL for each that SQL can express.

Mining inputs play by analogy: repositories are users, customers, orders or documents; search terms are event types; paths are
page urls; file contents are document texts; exclusion lists are other tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import constants as K
from ..functions.source_code import register
from ..operators import analysis, enrich, extraction, report, search, state
from ..sources import snapshots

QUERIES, ORACLES = {}, {}
#: The licence names that documents are tagged by.
LICENCES = {"apache": "Apache", "cc": "CC", "gpl": "GPL", "mit": "MIT"}
GATE, STOP = "tion", "mock|patch|fake"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as search hits: the user is the repository, the event type the term."""
    e = table(spark, sf_dir, "events")
    ts = F.unix_micros(F.col("ts").cast("timestamp"))
    item = F.struct(F.col("user_id").cast("string").alias("full_name"), F.col("event_id").alias("stargazers_count"), F.col("value").alias("value"))
    return e.select(F.col("event_type").alias("term"), F.lit(0).alias("term_seq"), ts.alias("page"), F.col("event_id").alias("pos"), item.alias("item"), F.col("ts").cast("timestamp").alias("at"))


@query("""
SELECT user_id::VARCHAR AS full_name, arg_min(event_id, (epoch_us(ts), event_id))::BIGINT AS first_event,
  string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS terms
FROM events WHERE user_id IS NOT NULL GROUP BY user_id
""")
def dedup_terms(spark, sf_dir):
    found = search.first_wins(_hits(spark, sf_dir), ", ", "terms")
    return found.where("full_name is not null").select("full_name", F.col("item.stargazers_count").alias("first_event"), "terms")


@query("""
SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) <= 300
""")
def search_cap(spark, sf_dir):
    return snapshots.capped(_hits(spark, sf_dir)).select(F.col("term").alias("event_type"), F.col("pos").alias("event_id"))


@query("""
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM customer k WHERE k.c_custkey % 50 <> 0 AND lower(k.c_name) = lower(c.c_name))
""")
def exclude_known(spark, sf_dir):
    rows = table(spark, sf_dir, "customer")
    hits = rows.select("c_custkey", F.struct(F.col("c_name").alias("full_name")).alias("item"))
    known = rows.where("c_custkey % 50 <> 0").select(F.upper("c_name").alias("full_name"))
    return search.excluded(hits, known).select("c_custkey", F.col("item.full_name").alias("c_name"))


@query("""
SELECT user_id, floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000)::INTEGER AS lifetime_days FROM events GROUP BY user_id
""")
def lifetime_days(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("a"), F.max("ts").cast("timestamp").alias("b"))
    return e.select("user_id", C.whole_days(F.col("a"), F.col("b")).alias("lifetime_days"))


def _customers(spark, sf_dir):
    """Customers as repositories: orders are commits, order days the lifetime, clerks of priority the contributors."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.min("o_orderdate").cast("timestamp").alias("a"),
        F.max("o_orderdate").cast("timestamp").alias("b"),
        F.count_distinct("o_orderpriority").alias("contributors"),
        F.count_if(F.col("o_orderstatus") == "F").alias("test_file_count"),
    )
    return o.withColumn("lifetime_days", C.whole_days(F.col("a"), F.col("b")))


CUSTOMERS = """
c AS (
  SELECT o_custkey, count(*) AS total_commits, count(DISTINCT o_orderpriority) AS contributors, count(*) FILTER (o_orderstatus = 'F') AS test_file_count,
    floor((epoch_us(max(o_orderdate)) - epoch_us(min(o_orderdate))) / 86400000000)::INTEGER AS lifetime_days
  FROM orders GROUP BY o_custkey
)"""


@query(f"""
WITH {CUSTOMERS}
SELECT o_custkey, total_commits, round(total_commits / (nullif(lifetime_days, 0) / 30.44::DOUBLE) * 1000)::BIGINT AS thousandths FROM c
""")
def commits_per_month_v1(spark, sf_dir):
    """The unrounded rate in thousandths: Python's rounding of the export, which SQL lacks, is tested on its own."""
    rows = _customers(spark, sf_dir)
    rate = F.col("total_commits") / (F.nullif(F.col("lifetime_days"), F.lit(0)) / F.lit(enrich.DAYS_V1))
    return rows.select("o_custkey", "total_commits", F.round(rate * 1000).cast("long").alias("thousandths"))


@query(f"""
WITH {CUSTOMERS}
SELECT o_custkey, total_commits / greatest(lifetime_days / 30.0::DOUBLE, 1.0::DOUBLE) AS per_month FROM c
""")
def commits_per_month_v2(spark, sf_dir):
    return _customers(spark, sf_dir).select("o_custkey", enrich.commits_per_month_v2(F.col("total_commits"), F.col("lifetime_days")).alias("per_month"))


@query(f"""
WITH {CUSTOMERS}
SELECT CASE WHEN lifetime_days < 30 THEN 'lifetime' WHEN contributors < 2 THEN 'contributors'
    WHEN NOT total_commits / greatest(lifetime_days / 30.0::DOUBLE, 1.0::DOUBLE) > 0.15 THEN 'commit_freq' WHEN test_file_count < 1 THEN 'no_tests' ELSE 'keep' END AS drop_reason,
  count(*) AS n
FROM c GROUP BY 1
""")
def staged_filter(spark, sf_dir):
    return enrich.drop_counts(enrich.reason_v2(_customers(spark, sf_dir), commits_over=0.15))


@query("""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=(\\d+)', 1), '')::BIGINT AS page FROM pages
""")
def link_last_page(spark, sf_dir):
    link = F.regexp_replace("url", "([?&]page=\\d+).*", "$1>; rel=\"last\"")
    return table(spark, sf_dir, "pages").select("page_id", C.last_page(link).alias("page"))


@query("SELECT page_id, url FROM pages WHERE regexp_matches(url, '(^|/)[0-9]+\\.html$')")
def path_filter(spark, sf_dir):
    """Numbered pages play test files: their names are spelt as such ones before the library looks at them."""
    path = F.regexp_replace("url", "(?d)(^|/)([0-9]+)\\.html$", "$1test_$2.py")
    return table(spark, sf_dir, "pages").where(C.is_test_file(path)).select("page_id", "url")


@query("""
SELECT page_id, split_part(rest, '/', 1) AS owner, CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/') + 1) END AS repo, replace(rest, '/', '_') AS safe_name
FROM (SELECT page_id, regexp_replace(url, '^https?://', '') AS rest FROM pages)
""")
def split_owner(spark, sf_dir):
    rest = F.regexp_replace("url", "^https?://", "")
    return table(spark, sf_dir, "pages").select("page_id", C.owner_of(rest).alias("owner"), C.repo_of(rest).alias("repo"), C.safe_name(rest).alias("safe_name"))


@query("""
SELECT 'customer' AS category, c_name AS full_name FROM customer UNION ALL SELECT 'supplier', s_name FROM supplier
""")
def union_category(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.lit("customer").alias("category"), F.col("c_name").alias("full_name"))
    return a.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("category"), F.col("s_name").alias("full_name")))


def _tags(spark, sf_dir):
    found = F.array_compact(F.array(*(F.when(F.col("text").rlike(p), F.lit(n)) for n, p in LICENCES.items())))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))


TAGS = """
p(n, r) AS (VALUES ('apache', 'Apache'), ('cc', 'CC'), ('gpl', 'GPL'), ('mit', 'MIT')),
m AS (SELECT doc_id, n FROM documents, p WHERE regexp_matches(text, r))"""


@query(f"WITH {TAGS} SELECT doc_id, string_agg(n, ',' ORDER BY n) AS tags FROM m GROUP BY doc_id")
def pattern_tags(spark, sf_dir):
    return _tags(spark, sf_dir).where(F.size("found") > 0).select("doc_id", C.sorted_set(F.col("found"), ",").alias("tags"))


@query(f"""
WITH {TAGS} SELECT d.doc_id, CASE WHEN coalesce(length(d.text), 0) = 0 THEN 'no_deps' WHEN m.doc_id IS NOT NULL THEN 'hit' ELSE 'none' END AS verdict
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM m) m ON m.doc_id = d.doc_id
""")
def match_verdict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = F.coalesce(F.exists(F.array(*(F.col("text").rlike(p) for p in LICENCES.values())), lambda x: x), F.lit(False))
    return docs.select("doc_id", F.when(F.coalesce(F.length("text"), F.lit(0)) == 0, "no_deps").when(found, "hit").otherwise("none").alias("verdict"))


@query(f"SELECT doc_id FROM documents WHERE regexp_matches(text, '{GATE}') AND NOT regexp_matches(text, '(?i){STOP}')")
def gate_and_exclude(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").where(text.rlike(GATE) & ~text.rlike(f"(?i){STOP}")).select("doc_id")


@query("""
SELECT doc_id, md5(array_to_string(list_slice(string_split_regex(text, '\\r\\n|\\n|\\r'), 1, 3), chr(10))) AS head FROM documents
""")
def line_slice(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.lines(F.col("text"), 1, 3)).alias("head"))


@query("""
SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45) AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""")
def resume_anti(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem")
    done = [items.where(c).select(F.col("l_orderkey").alias("o_orderkey")) for c in ("l_quantity > 45", "l_returnflag = 'R'")]
    return state.remaining(table(spark, sf_dir, "orders").select("o_orderkey"), *done, key="o_orderkey")


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, max((epoch_us(ts), event_id))[2]::BIGINT AS event_id FROM events GROUP BY user_id")
def state_upsert(spark, sf_dir):
    """The first half of the events as old state, the second as new rows that win."""
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    last = lambda rows: state.last_wins(rows, "user_id", "ts", "event_id")
    cut = F.expr("event_id % 2 = 0")
    both = last(e.where(cut)).unionByName(last(e.where(~cut)))
    return last(both).select("user_id", "event_type", "event_id")


@query("""
SELECT d.doc_id, coalesce(l.quality::VARCHAR, 'main') AS quality FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l ON l.doc_id = d.doc_id
""")
def lookup_default(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").cast("string").alias("quality"))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left")
    return joined.select("doc_id", C.or_default(F.col("quality"), "main").alias("quality"))


@query("""
SELECT conv_id, turn, role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS changed FROM conversations
""")
def change_marker(spark, sf_dir):
    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", (~before.eqNullSafe(F.col("role"))).alias("changed"))


@query("""
WITH h AS (
  SELECT *, CASE WHEN role IS DISTINCT FROM lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN chr(10) || '# --- ' || role || ' ---' || chr(10) || chr(10) ELSE '' END AS heading
  FROM conversations
)
SELECT conv_id::VARCHAR AS full_name, md5(string_agg(heading || text || chr(10) || chr(10), '' ORDER BY turn)) AS body FROM h GROUP BY conv_id
""")
def doc_assembly(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("full_name"), F.col("role").alias("path"), F.col("text").alias("source"), "turn")
    headed = extraction.headed(rows, "full_name", "path", "turn")
    return headed.groupBy("full_name").agg(F.md5(extraction._body("turn")).alias("body"))


@query("""
SELECT source, count(*) AS docs, count(*) FILTER (contains(text, chr(10))) AS multi_line, count(l.doc_id) AS labelled
FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id GROUP BY source
""")
def count_if_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("l_id")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.contains("text", F.lit("\n")).alias("multi"))
    joined = d.join(labels, F.col("doc_id") == F.col("l_id"), "left")
    return joined.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count_if("multi").alias("multi_line"), F.count("l_id").alias("labelled"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_discount >= 0.095)")
def exists_semi(spark, sf_dir):
    some = table(spark, sf_dir, "lineitem").where("l_discount >= 0.095").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(some, "o_orderkey", "left_semi")


@query("""
SELECT p_name AS "AI agent framework", round(p_partkey * 100 / 1000.0::DOUBLE, 1) AS "# Stars (k)", p_size AS "# Contributors", p_brand AS "# Test files", p_type AS "# Test functions" FROM part
""")
def summary_table(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_name").alias("full_name"), (F.col("p_partkey") * 100).cast("string").alias("stars"), F.col("p_size").alias("contributors_count"),
        F.col("p_brand").alias("test_file_count"), F.col("p_type").alias("test_function_count"),
    )
    return report.summary(rows)


@query("SELECT event_id, json_extract_string(props, '$.k')::VARCHAR AS k FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""
SELECT user_id, coalesce(string_agg(event_type, ',' ORDER BY event_type) FILTER (event_type <> 'click'), '') AS topics FROM (SELECT DISTINCT user_id, event_type FROM events) GROUP BY user_id
""")
def topics_join(spark, sf_dir):
    grouped = table(spark, sf_dir, "events").groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") != "click", F.col("event_type"))).alias("t"))
    return grouped.select("user_id", C.joined(F.array_sort("t")).alias("topics"))


@query("""
SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier
""")
def hetero_union(spark, sf_dir):
    a = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return report.merged(a, table(spark, sf_dir, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")))


@query("""
SELECT n_name, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders, coalesce(sum(o_totalprice), 0) > 1000000 AS large
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name
""")
def repository_summary(spark, sf_dir):
    """Left joins so that groups without rows remain, counts of different keys, and a flag; orders are summed before the join."""
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    per = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    j = table(spark, sf_dir, "nation").join(per, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("n_name", zero("c").alias("customers"), zero("n").alias("orders"), (zero("total") > 1_000_000).alias("large"))


@query("""
SELECT l_orderkey, map_keys(m) AS flags, map_values(m) AS lines FROM (
  SELECT l_orderkey, map_from_entries(list((l_returnflag, lines) ORDER BY l_returnflag)) AS m
  FROM (SELECT l_orderkey, l_returnflag, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey)
""")
def match_map(spark, sf_dir):
    """Map aggregation: for each key, which lists belong to which name."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.array_sort(F.collect_list("l_linenumber")).alias("n"))
    entry = F.struct("l_returnflag", F.array_join(F.col("n").cast("array<string>"), ",").alias("lines"))
    m = items.groupBy("l_orderkey").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("m"))
    return m.select("l_orderkey", F.map_keys("m").alias("flags"), F.map_values("m").alias("lines"))


#: The same files in SQL, with what a parser of Python finds in each.
SOURCES = """
f AS (
  SELECT 'documents/' || (doc_id // 10) AS full_name, 'tests/test_' || doc_id || '.py' AS path, doc_id, coalesce(text, '') AS text, CASE lang WHEN 'en' THEN 'openai' WHEN 'de' THEN 'ragas' ELSE 'json' END AS module,
    'def test_' || doc_id || '(client):' || chr(10) || '    said = ' || CAST(to_json({'text': coalesce(text, '')}) AS VARCHAR) || chr(10) || '    assert client.chat.completions.create(said)' AS own
  FROM documents
)"""


def _files(spark, sf_dir):
    """Every document as a Python test file: its text is a literal of a test, its language names the module, ten are a repository."""
    d = table(spark, sf_dir, "documents")
    number = F.col("doc_id").cast("string")
    module = F.when(F.col("lang") == "en", "openai").when(F.col("lang") == "de", "ragas").otherwise("json")
    said = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))
    content = F.concat(
        F.lit("import "), module, F.lit("\n\n\ndef test_"), number, F.lit("(client):\n    said = "), said,
        F.lit("\n    assert client.chat.completions.create(said)\n\n\nclass T:\n    async def test_m(self):\n        mock()\n"),
    )
    name = F.concat(F.lit("documents/"), F.expr("doc_id div 10").cast("string"))
    return d.select(name.alias("full_name"), F.concat(F.lit("tests/test_"), number, F.lit(".py")).alias("path"), content.alias("content"), F.lit(200).alias("status"))


@query(f"""
WITH {SOURCES}
SELECT full_name, path, 0 AS bfs_seq, 'test_' || doc_id AS name, false AS is_async, 4 AS lineno, 6 AS end_lineno, own AS source, [module] AS imports,
  CASE WHEN module <> 'json' THEN ['client.chat.completions.create(said)', 'client.chat.completions.create', 'client.chat.completions', 'client.chat'] ELSE [] END AS call_segments, true AS parse_ok FROM f
UNION ALL SELECT full_name, path, 1, 'test_m', true, 10, 11, '    async def test_m(self):' || chr(10) || '        mock()', [module], CASE WHEN module <> 'json' THEN ['mock()'] ELSE [] END, true FROM f
""")
def py_tests_extract(spark, sf_dir):
    register(spark)
    return analysis.extracted(_files(spark, sf_dir))


@query(f"WITH {SOURCES} SELECT full_name, path, [module] AS imports FROM f")
def py_imports(spark, sf_dir):
    register(spark)
    _files(spark, sf_dir).createOrReplaceTempView("oresieve_files")
    return spark.sql("SELECT full_name, path, py_imports(content) AS imports FROM oresieve_files")


@query(f"""
WITH {SOURCES} SELECT full_name, path, 'test_' || doc_id AS name, module <> 'json' AND NOT regexp_matches(text, '(?i){K.MOCK_PATTERN}') AS is_llm FROM f UNION ALL SELECT full_name, path, 'test_m', false FROM f
""")
def llm_classify(spark, sf_dir):
    register(spark)
    tests = analysis.classified(analysis.extracted(_files(spark, sf_dir)))
    return tests.select("full_name", "path", "name", "is_llm")


@query(f"""
WITH {SOURCES}, l AS (SELECT *, '# --- ' || path || ' ---' AS heading FROM f WHERE module <> 'json' AND NOT regexp_matches(text, '(?i){K.MOCK_PATTERN}')),
n AS (SELECT full_name, count(*) AS files FROM f GROUP BY full_name)
SELECT full_name, replace(full_name, '/', '_') AS safe_name, '# ' || full_name || chr(10) || '# ' || count(*) || ' LLM-backed test functions across ' || any_value(files) || ' test files' || chr(10)
  || '# Source: https://example.org/' || full_name || chr(10) || string_agg(chr(10) || heading || chr(10) || chr(10) || own || chr(10) || chr(10), '' ORDER BY path) AS content
FROM l JOIN n USING (full_name) GROUP BY full_name
""")
def extracted_documents(spark, sf_dir):
    register(spark)
    files = _files(spark, sf_dir)
    tests = analysis.classified(analysis.extracted(files))
    repositories = files.select("full_name").distinct().withColumn("html_url", F.concat(F.lit("https://example.org/"), "full_name"))
    return extraction.application_documents(tests, analysis.repository_counts(repositories, files, tests))
