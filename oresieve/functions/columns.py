"""Column expressions shared by the operators; all but py_round and number_text stay inside Catalyst."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from . import constants as K


def is_test_file(path: Column) -> Column:
    """The path names a file test_*.py, in any folder; case matters. The flag d keeps $ from passing a trailing \\r."""
    return path.rlike("(?d)" + K.TEST_FILE)


def is_dep_file(path: Column) -> Column:
    """The path names a Python dependency file, in any folder and case."""
    return path.rlike("(?idu)" + K.DEP_FILE)


def is_vendored(path: Column) -> Column:
    """Some folder of the relative path is one that a walk leaves out."""
    names = "|".join(n.replace(".", "\\.") for n in K.VENDORED)
    return path.rlike(f"(^|/)({names})/")


def names_mock(source: Column) -> Column:
    return source.rlike(f"(?iu){K.MOCK_PATTERN}")


def names_call(segment: Column) -> Column:
    return segment.rlike(f"(?iu){K.CALL_PATTERN}")


def depends_on(content: Column, package: str) -> Column:
    """A dependency file's text names the package; by line, in any case."""
    return content.rlike("(?imdu)" + K.package_pattern(package))


def owner_of(full_name: Column) -> Column:
    return F.split(full_name, "/", 2)[0]


def repo_of(full_name: Column) -> Column:
    """All after the first slash; null without one."""
    return F.try_element_at(F.split(full_name, "/", 2), F.lit(2))


def safe_name(full_name: Column) -> Column:
    return F.replace(full_name, F.lit("/"), F.lit("_"))


def or_default(value: Column, default, empty_too: bool = False) -> Column:
    """A default for null, and for the empty string where that counts as missing."""
    return F.coalesce(F.nullif(value, F.lit("")) if empty_too else value, F.lit(default))


def joined(items: Column, by: str = ",") -> Column:
    """An array as text; empty for a null or empty array."""
    return F.coalesce(F.array_join(items, by), F.lit(""))


def sorted_set(items: Column, by: str) -> Column:
    """Different items in code-point order, as text."""
    return F.array_join(F.array_sort(F.array_distinct(items)), by)


def moment(text: Column) -> Column:
    """An ISO-8601 text as a timestamp, null if it is none; sessions run in UTC."""
    return F.try_to_timestamp(text)


def whole_days(start: Column, end: Column) -> Column:
    """Full periods of 24 hours from start to end, rounded down as well below zero; null if either is."""
    return F.floor((F.unix_micros(end) - F.unix_micros(start)) / F.lit(86_400_000_000)).cast("int")


def last_page(link: Column) -> Column:
    """The page number of a Link header's last page; null without one."""
    return F.nullif(F.regexp_extract(link, "[?&]page=(\\d+)>;\\s*rel=\"last\"", 1), F.lit("")).cast("long")


def last_page_v1(link: Column) -> Column:
    """As last_page(), but of any parameter whose name ends in page, and with one space before rel."""
    return F.nullif(F.regexp_extract(link, "page=(\\d+)>; rel=\"last\"", 1), F.lit("")).cast("long")


def api_url(full_name: Column, *parts) -> Column:
    """An address of the repository API: its name and what of it is asked for (contributors, commits, git/trees/branch)."""
    return F.concat_ws("/", F.lit("https://api.github.com/repos"), full_name, *parts)


def short_error(text: Column, most: int = 200) -> Column:
    """An error's text without white space around it, cut to its first characters."""
    return F.left(F.regexp_replace(text, "^\\s+|\\s+$", ""), F.lit(most))


def raw_url(full_name: Column, branch: Column, path: Column) -> Column:
    return F.concat_ws("/", F.lit("https://raw.githubusercontent.com"), full_name, branch, path)


def search_query(term: Column, stars: int = K.LEAST_STARS, pushed: str = K.PUSHED_AFTER) -> Column:
    return F.format_string(f'"%s" language:{K.LANGUAGE} stars:>{stars} pushed:>{pushed}', term)


def lines(text: Column, first: int, last: int) -> Column:
    """Lines first..last, counted from 1, joined again by newlines."""
    return F.array_join(F.slice(F.split(text, "\r\n|\n|\r"), first, last - first + 1), "\n")


def valid_text(content: Column) -> Column:
    """Bytes as text, what is no UTF-8 as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def flag_text(flag: Column) -> Column:
    """A boolean as True or False, as exports have it."""
    return F.initcap(flag.cast("string"))


@F.pandas_udf(DoubleType())
def _round(values: pd.Series, digits: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(x) else round(x, int(n)) for x, n in zip(values, digits, strict=True)], dtype="float64")


def py_round(value: Column, digits: int = 0) -> Column:
    """Python's round: on the exact binary value, halves to even, which no built-in function does. One Arrow batch at a time."""
    return _round(value.cast("double"), F.lit(digits))


@F.arrow_udf(StringType())
def _number_text(values: pa.Array) -> pa.Array:
    # Arrow's digits are the shortest, as Python's are; its zeros and exponents differ
    size = pc.abs(values)
    plain = pc.and_(pc.greater_equal(size, 1e-3), pc.less(size, 1e7))
    text = values.cast(pa.string())
    text = pc.if_else(pc.match_substring(text, "."), text, pc.binary_join_element_wise(text, ".0", ""))
    rest = pc.fill_null(pc.invert(plain), False)
    return pc.replace_with_mask(text, rest, pa.array([repr(v) for v in values.filter(rest).to_pylist()], pa.string()))


def number_text(value: Column) -> Column:
    """A double as Python writes it: 48.0, -0.0, 12345678.5, 1e-05, nan. Spark has exponents from 1e7 on, and more digits than needed in places. One Arrow batch at a time."""
    return _number_text(value.cast("double"))
