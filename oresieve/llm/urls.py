"""URL rules, carried to aliases through redirects and canonical links."""

from __future__ import annotations

import re
from html import unescape
from html.entities import html5
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import Scratch, named, sized, small_batches

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Elements that name an address: of the page itself, or the one that others are relative to.
LINK = re.compile(r"(?is)<(link|meta|base)(?=[\s/])((?:[^>\"'=]++|=\s*+\"[^\"]*+\"|=\s*+'[^']*+'|[\"'=])*+)>")
ATTRIBUTE = re.compile(r"(?s)([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
REFERENCE = re.compile(r"&(#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*)[;=]?")
REFRESH = re.compile(r"(?is)[\d.\s]*[;,]?\s*(?:url\s*=\s*)?(?:\"([^\"]*)|'([^']*)|(.*))")
ADDRESS = re.compile(r"(?s)(.*?://[^/?#]*)([^?#]*)(\?[^#]*)?")


class Rule(NamedTuple):
    """Blocks or allows a host with its subdomains, where the url's path starts with `path`."""

    host: str
    path: str
    allow: bool

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(text: str, allow: bool) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(host, slash + path, allow)


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty if there is none or the url is null."""
    return F.translate(F.coalesce(F.regexp_extract(url, "(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ?, # or the end; empty if there is none or the url is null."""
    return F.coalesce(F.regexp_extract(url, "(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key_of(url: Column) -> Column:
    """What makes two urls one page without asking it: host, path and query; null without a host."""
    query = F.regexp_extract(url, "(?s)^[^?#]*(\\?[^#]*)", 1)
    key = F.concat(host_of(url), path_of(url), query)
    return F.when(host_of(url) != "", key)


def rule_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    """(rule_host, rules): for each host that rules name, its rules as (rank, path, name, verdict); the least rank is the longest name."""
    rows = [(r.host, r.path, r.name, "allow" if r.allow else "block") for r in rules]
    table = spark.createDataFrame(rows, "rule_host string, path string, name string, verdict string").where("rule_host <> ''")
    one = F.struct((-F.length("name")).alias("rank"), "name", "verdict", "path")
    return table.groupBy("rule_host").agg(F.collect_set(one).alias("rules"))


def host_rules(hosts: DataFrame, table: DataFrame, scratch: Scratch, host: str = "host") -> DataFrame:
    """(host, rules): for each host that some rule fits, the rules of its own name and of all domains above, longest first.

    Hosts are made different first, on the map side, and looked up by each of their domains, so that neither the number of rules nor that
    of pages is in any expression or list; a list holds the rules that name one of a host's domains.
    """
    different = hosts.select(F.col(host).alias("host")).where("host <> ''").distinct()
    parts = F.split("host", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    found = different.withColumn("rule_host", F.explode(F.array_distinct(above))).join(table, "rule_host")
    return scratch.keep(found.groupBy("host").agg(F.sort_array(F.flatten(F.collect_list("rules"))).alias("rules")), "host-rules")


def ruled(rows: DataFrame, rules: DataFrame, host: str, path: str, rule: str, verdict: str) -> DataFrame:
    """Adds the name and the verdict of the longest rule that fits a host and path, else nulls; of equal length, the first by name."""
    h, r = named("rule_host", rows.columns), named("rules", rows.columns)
    rules = rules.select(F.col("host").alias(h), F.col("rules").alias(r))
    joined = rows.join(sized(rules, rules.count()), rows[host] == rules[h], "left")
    first = F.get(F.filter(F.col(r), lambda x: F.startswith(F.col(path), x["path"])), F.lit(0))
    return joined.select(*(c for c in rows.columns), first["name"].alias(rule), first["verdict"].alias(verdict))


def _decoded(value: str) -> str:
    """An attribute's value. As browsers do, a name without a semicolon is no reference if = or more of a word follows (&copy=1)."""
    return REFERENCE.sub(lambda m: unescape(m[0]) if m[1][0] == "#" or not m[0].endswith("=") and m[0][1:] in html5 else m[0], value)


def resolve(base: str, target: str) -> str | None:
    """The target's address as the page at `base` means it; null if it has no host or is the page itself."""
    target = re.sub("[\t\n\r]", "", target).strip()
    if scheme := re.match("[a-zA-Z][a-zA-Z0-9+.-]*:", target):
        return target if target.startswith("//", scheme.end()) else None
    at = ADDRESS.match(base)
    if at is None or not target or target[0] == "#":
        return None
    if target.startswith("//"):
        return base[: base.index("://") + 1] + target
    if target[0] == "?":
        return at[1] + at[2] + target
    path, rest = re.fullmatch("(?s)([^?#]*)(.*)", target).groups()
    if path[0] != "/":
        path = (at[2].rpartition("/")[0] or "") + "/" + path
    parts: list[str] = []
    steps = path.split("/")[1:]
    for step in steps:
        if step == "..":
            del parts[-1:]
        elif step != ".":
            parts.append(step)
    if steps[-1] in (".", ".."):
        parts.append("")
    return at[1] + "/" + "/".join(parts) + rest


def targets(url: str, html: str) -> list[str]:
    """The addresses that a page's canonical links and refreshes name, resolved against the page's base element or else its url."""
    base, found = None, []
    for m in LINK.finditer(html):
        attributes: dict[str, str] = {}
        for key, a, b, c in ATTRIBUTE.findall(m[2]):
            attributes.setdefault(key.lower(), _decoded(a or b or c))
        kind, href = m[1].lower(), attributes.get("href", "")
        if kind == "base" and base is None and "href" in attributes:
            base = resolve(url, href)
        elif kind == "link" and "canonical" in attributes.get("rel", "").lower().split():
            found.append(href)
        elif kind == "meta" and attributes.get("http-equiv", "").strip().lower() == "refresh":
            content = REFRESH.match(attributes.get("content", "").strip())
            # unquoted, url= is an attribute of its own
            found.append(content[1] or content[2] or content[3] or attributes.get("url", ""))
    return [to for target in found if (to := resolve(base or url, target))]


def page_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(a, b): the keys of a page and of the address that its canonical link or refresh names, relative ones resolved.

    Pages without a url or html, and links to the page itself or without a host, give none; repeated rows give repeated links.
    """
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            pairs = [(own, to) for own, page in zip(*(c.to_pylist() for c in batch.columns), strict=True) for to in targets(own, page)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["from", "to"])

    low = F.lower(F.col(html))
    marked = pages.where(key_of(F.col(url)).isNotNull() & (low.contains("canonical") | low.contains("refresh")))
    found = marked.select(F.col(url).alias("from"), F.col(html).alias("html")).mapInArrow(run, "from string, to string")
    return found.select(key_of(F.col("from")).alias("a"), key_of(F.col("to")).alias("b")).where("a is not null and b is not null and a != b")


def judge(pages: DataFrame, rules: list[Rule], url: str = "url", html: str | None = "html", redirects: DataFrame | None = None) -> DataFrame:
    """Adds host, path, rule and verdict to every page; a column of the input that has such a name is replaced.

    A page's own rule decides first, the longest that fits. Without one, addresses that redirects (a table of urls `src`
    and `dst`) and canonical links join are one class: a class with a blocked member is blocked for its members without a
    rule, unless a member is explicitly allowed, which wins. All others are allowed. Links may name pages outside the table;
    rules hold for these too. Null urls have empty host and path and are allowed. Repeated rows stay, each with its verdict.
    Rules are a table that different hosts are joined with, so that their number is not in the plan; they are broadcast if they are few.
    The classes are found by joins on edges; a page joins its class by its key, which AQE splits if one key is hot.
    """
    scratch = Scratch(pages.sparkSession)
    new = ["host", "path", "rule", "verdict"]
    edges = None
    if html is not None:
        edges = page_links(pages, url, html)
    if redirects is not None:
        more = redirects.select(key_of(F.col("src")).alias("a"), key_of(F.col("dst")).alias("b"))
        edges = more if edges is None else edges.unionByName(more)
    kept = [c for c in pages.columns if c.lower() not in {*new}]
    own, cls = named("own", pages.columns), named("class_verdict", pages.columns)
    u = F.col(url)
    out = pages.withColumn(named("u", pages.columns), u)
    u = F.col(named("u", pages.columns))
    out = out.select(*kept, u, host_of(u).alias("host"), path_of(u).alias("path"))
    rules_of = rule_table(pages.sparkSession, rules)
    out = ruled(out, host_rules(out, rules_of, scratch), "host", "path", "rule", own)
    found = None
    if edges is not None:
        found = scratch.keep(connected_components(edges, scratch), "classes")
    if found is None or found.isEmpty():
        return out.select(*kept, "host", "path", "rule", F.coalesce(own, F.lit("allow")).alias("verdict"))
    as_url = F.concat(F.lit("x://"), F.col("node"))
    members = found.select("node", "component", host_of(as_url).alias("host"), path_of(as_url).alias("path"))
    members = ruled(members, host_rules(members, rules_of, scratch), "host", "path", "name", "said")
    classes = members.groupBy("component").agg(F.max((F.col("said") == "block").cast("int")).alias("b"), F.max((F.col("said") == "allow").cast("int")).alias("w"))
    blocked = classes.where("b = 1 and coalesce(w, 0) = 0").select("component", F.lit("block").alias(cls))
    by_node = scratch.keep(members.join(blocked, "component").select(F.col("node").alias(named("node", pages.columns)), cls), "blocked")
    joined = out.join(by_node, key_of(u) == F.col(named("node", pages.columns)), "left")
    return joined.select(*kept, "host", "path", "rule", F.coalesce(own, cls, F.lit("allow")).alias("verdict"))
