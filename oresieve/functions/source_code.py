"""Python source as tables: a table function for test functions, and one for imports."""

from __future__ import annotations

import ast
import sys

from pyspark.sql import SparkSession
from pyspark.sql.functions import udf, udtf
from pyspark.sql.types import ArrayType, StringType

from . import constants as K

TESTS = (
    "bfs_seq int, name string, is_async boolean, lineno int, end_lineno int, source string, imports array<string>,"
    " call_segments array<string>, parse_ok boolean"
)


def top_modules(tree: ast.AST) -> set[str]:
    """First parts of all modules that are imported anywhere; `from . import x` names none, `from .a import x` counts as a."""
    found = set()
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            found |= {alias.name.partition(".")[0] for alias in node.names}
        elif isinstance(node, ast.ImportFrom) and node.module:
            found.add(node.module.partition(".")[0])
    return found


def parsed(content: str | None) -> ast.Module | None:
    """The syntax tree; None for text that has none, whatever the parser's reason."""
    if not content:
        return None
    try:
        return ast.parse(content)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _segments(function: ast.AST, strict: bool = False) -> list[str]:
    """Calls and attributes under a function as normal text, decorators and defaults included; one that has none is empty, or an error if strict."""
    out = []
    for node in ast.walk(function):
        if isinstance(node, ast.Call | ast.Attribute):
            try:
                out.append(ast.unparse(node))
            except Exception:  # a tree that can't be written
                if strict:
                    raise
                out.append("")
    return out


def test_functions(content: str | None, modules: list[str] | None = None, strict: bool = False):
    """A row for each function test_*, breadth first, at any depth. Text without a tree gives one row with parse_ok false.

    strict: so does a file of which some call can't be written as text, as framework analysis has it; else that call has no text.

    A function's source runs from its def line, without decorators. Segments are written only if the file imports one of
    `modules` (or where none are named), as that is most of the work.
    """
    tree = parsed(content)
    if tree is None:
        if content:
            yield 0, None, None, None, None, None, [], [], False
        return
    imports = sorted(top_modules(tree))
    wanted = modules is None or not {*modules}.isdisjoint(imports)
    rows = content.splitlines()
    found = [n for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef) and n.name.startswith("test_")]
    try:
        segments = [_segments(f, strict) if wanted else [] for f in found]
    except Exception:
        yield 0, None, None, None, None, None, [], [], False
        return
    for seq, (f, said) in enumerate(zip(found, segments, strict=True)):
        source = "\n".join(rows[f.lineno - 1 : f.end_lineno])
        yield seq, f.name, isinstance(f, ast.AsyncFunctionDef), f.lineno, f.end_lineno, source, imports, said, True


@udtf(returnType=TESTS, useArrow=True)
class ExtractTests:
    """extract_tests(content, modules, strict): see test_functions."""

    def eval(self, content: str, modules, strict: bool = False):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 10_000))
        yield from test_functions(content, list(modules) if modules is not None else None, strict)


@udf(ArrayType(StringType()), useArrow=True)
def py_imports(content):
    """The sorted modules that a source imports; null if it has no tree."""
    tree = parsed(content)
    return None if tree is None else sorted(top_modules(tree))


def register(spark: SparkSession) -> None:
    """Makes extract_tests and py_imports known to SQL."""
    spark.udtf.register("extract_tests", ExtractTests)
    spark.udf.register("py_imports", py_imports)


APPLICATION_MODULES = [*K.MODEL_MODULES, *K.EVALUATOR_MODULES]
