"""Python symbols: each file is parsed once, by the standard parser, and gives all that other operators need.

A long source is parsed in runs of whole statements, so that the tree of a run is all that is held at a time."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FUNCTION = "name string, args array<string>, decorators array<string>, return_annotation string, docstring string, start_line int, end_line int, line_count int, is_method boolean, is_async boolean, complexity int"
CLASS = "name string, bases array<string>, methods array<string>, decorators array<string>, docstring string, start_line int, end_line int, line_count int"
IMPORT = "module string, names array<string>, alias string, is_from_import boolean, line int"
VARIABLE = "name string, annotation string, line int, is_constant boolean"


def _struct(ddl: str) -> str:
    parts = [p.strip().split(" ", 1) for p in ddl.split(", ")]
    return "array<struct<" + ",".join(f"{n}:{t}" for n, t in parts) + ">>"


SCHEMA = f"valid boolean, error string, total_lines int, functions {_struct(FUNCTION)}, classes {_struct(CLASS)}, imports {_struct(IMPORT)}, variables {_struct(VARIABLE)}, blocks array<struct<start:int,end:int>>"
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_BRANCHES = (ast.If, ast.For, ast.While, ast.ExceptHandler, ast.With)


def complexity(node: ast.AST, depth: int = 0) -> int:
    """Cognitive complexity of what stands below a node. Branches cost one and their depth, and deepen what they hold;
    so do lambdas and assertions, without deepening, and nested functions; a boolean operator costs one."""
    total, todo = 0, [(child, depth) for child in ast.iter_child_nodes(node)]
    while todo:
        at, level = todo.pop()
        below = level
        if isinstance(at, (*_BRANCHES, *_DEFS)):
            total, below = total + 1 + level, level + 1
        elif isinstance(at, (ast.Assert, ast.Lambda)):
            total += 1 + level
        elif isinstance(at, ast.BoolOp):
            total += 1
        todo += [(child, below) for child in ast.iter_child_nodes(at)]
    return total


def _decorators(node) -> list[str]:
    out = []
    for d in node.decorator_list:
        if isinstance(d, ast.Name):
            out.append(d.id)
        elif isinstance(d, ast.Attribute):
            out.append(ast.dump(d))
        elif isinstance(d, ast.Call) and isinstance(d.func, ast.Name):
            out.append(d.func.id)
    return out


RUN = 1 << 14  # characters of source whose tree is held at a time
#: Where a statement can start that does not belong to the one before.
_START = re.compile(r"\n(?!(?:else|elif|except|finally)\b)(?=[^\s#)\]}])")


def runs(code: str, size: int = RUN) -> Iterator[tuple[int, ast.Module]]:
    """(lines before, tree) of consecutive runs of whole statements. What starts where a statement starts and parses by
    itself is whole; what does not is tried with twice as much, up to all of the rest. The error of a source that has one
    is raised where its run is reached, as the whole source raises it."""
    if "\r" in code:
        code = code.replace("\r\n", "\n").replace("\r", "\n")  # as the parser does
    start = before = 0
    while True:
        reach, tree = size, None
        while tree is None:
            found = _START.search(code, start + reach) if start + reach < len(code) else None
            end = found.end() if found else len(code)
            try:
                tree = ast.parse(code[start:end])
            except (SyntaxError, ValueError, RecursionError, MemoryError):
                if end == len(code):
                    ast.parse("\n" * before + code[start:])  # raises it with the file's lines
                    raise
                reach *= 2
        yield before, tree
        before += code.count("\n", start, end)
        start = end
        if start == len(code):
            return


def _run_symbols(tree: ast.Module, before: int) -> tuple[dict, dict]:
    """Symbols of a run in the parser's breadth-first order, and the depths in the tree of those found by that order."""
    out: dict = {"functions": [], "classes": [], "imports": [], "variables": [], "blocks": []}
    depths: dict = {"functions": [], "classes": [], "imports": []}

    def span(node) -> dict:
        return {"start_line": node.lineno + before, "end_line": node.end_lineno + before, "line_count": node.end_lineno - node.lineno + 1}

    methods = {id(child) for node in ast.walk(tree) if isinstance(node, ast.ClassDef) for child in node.body}
    level, depth = [tree], 0
    while level:
        for node in level:
            if isinstance(node, _DEFS):
                out["functions"].append(
                    {"name": node.name, "args": [a.arg for a in node.args.args], "decorators": _decorators(node), "return_annotation": ast.unparse(node.returns) if node.returns else None, "docstring": ast.get_docstring(node)}
                    | span(node) | {"is_method": id(node) in methods, "is_async": isinstance(node, ast.AsyncFunctionDef), "complexity": complexity(node)}
                )
            elif isinstance(node, ast.ClassDef):
                bases = [ast.unparse(b) for b in node.bases if isinstance(b, (ast.Name, ast.Attribute))]
                out["classes"].append(
                    {"name": node.name, "bases": bases, "methods": [c.name for c in node.body if isinstance(c, _DEFS)], "decorators": [d.id for d in node.decorator_list if isinstance(d, ast.Name)], "docstring": ast.get_docstring(node)} | span(node)
                )
            elif isinstance(node, ast.Import):
                out["imports"] += [{"module": a.name, "names": [a.name], "alias": a.asname, "is_from_import": False, "line": node.lineno + before} for a in node.names]
            elif isinstance(node, ast.ImportFrom):
                out["imports"].append({"module": node.module, "names": [a.name for a in node.names], "alias": None, "is_from_import": True, "line": node.lineno + before})
        for kind, at in depths.items():
            at += [depth] * (len(out[kind]) - len(at))
        level, depth = [child for node in level for child in ast.iter_child_nodes(node)], depth + 1
    for node in tree.body:
        if isinstance(node, ast.Assign):
            out["variables"] += [{"name": t.id, "annotation": None, "line": node.lineno + before, "is_constant": t.id.isupper()} for t in node.targets if isinstance(t, ast.Name)]
        elif isinstance(node, ast.AnnAssign) and isinstance(node.target, ast.Name):
            out["variables"].append({"name": node.target.id, "annotation": ast.unparse(node.annotation), "line": node.lineno + before, "is_constant": node.target.id.isupper()})
        if isinstance(node, (*_DEFS, ast.ClassDef)):
            out["blocks"].append({"start": node.lineno - 1 + before, "end": node.end_lineno + before})
    return out, depths


def _failure(e: Exception) -> str:
    return f"SyntaxError at line {e.lineno}: {e.msg}" if isinstance(e, SyntaxError) else f"{type(e).__name__}: {e}"


_ERRORS = (SyntaxError, ValueError, RecursionError, MemoryError)
_NOTHING: dict = {"functions": [], "classes": [], "imports": [], "variables": [], "blocks": []}


def _lines(code: str) -> int:
    """len(code.splitlines()) without holding the lines."""
    return sum(len(code[a:z].splitlines()) for a, z in _spans(code))


def _spans(code: str, size: int = 1 << 20) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(code):
        end = code.find("\n", at + size) + 1 or len(code)
        yield at, end
        at = end


def parse(code: str | None, size: int = RUN) -> dict:
    """All symbols of a source text, in the parser's breadth-first order."""
    code = code or ""
    out: dict = {"valid": True, "error": None, "total_lines": _lines(code)}
    found = {kind: {} for kind in _NOTHING}  # by depth
    try:
        for before, tree in runs(code, size):
            some, depths = _run_symbols(tree, before)
            for kind, rows in some.items():
                for row, depth in zip(rows, depths.get(kind) or [0] * len(rows)):
                    found[kind].setdefault(depth, []).append(row)
    except _ERRORS as e:
        return out | {kind: [] for kind in _NOTHING} | {"valid": False, "error": _failure(e)}
    return out | {kind: [row for depth in sorted(by) for row in by[depth]] for kind, by in found.items()}


def blocks(code: str | None, size: int = RUN) -> list[tuple[int, int]]:
    """(first line from 0, line after) of the top-level functions and classes; none of a text that does not parse."""
    try:
        return [(node.lineno - 1 + before, node.end_lineno + before) for before, tree in runs(code or "", size) for node in tree.body if isinstance(node, (*_DEFS, ast.ClassDef))]
    except _ERRORS:
        return []


def analyze(files: DataFrame, file: str = "path", language: str = "language", code: str = "code") -> DataFrame:
    """One row per file: the symbols of python files; other languages are not valid and say why."""
    return _analyzed(files, file, language, code, False)


def analyze_parts(files: DataFrame, file: str = "path", language: str = "language", code: str = "code") -> DataFrame:
    """The rows of analyze in parts, for plans that take symbols one by one: a row for each run of a file's statements, with
    `part`, numbered from 0. No row grows with its file; symbols stand in order within a part."""
    return _analyzed(files, file, language, code, True)


def _analyzed(files: DataFrame, file: str, language: str, code: str, apart: bool) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = StructType.fromDDL(f"{file} string, {language} string, {'part int, ' if apart else ''}{SCHEMA}")
    arrow = to_arrow_schema(target)
    number = lambda n: {"part": n} if apart else {}

    def of(row: dict) -> Iterator[pa.RecordBatch]:
        text, own = row[code] or "", {file: row[file], language: row[language]}
        if row[language] != "python":
            yield pa.RecordBatch.from_pylist([own | number(0) | _NOTHING | {"valid": False, "error": f"No parser for language: {row[language]}", "total_lines": _lines(text)}], schema=arrow)
        elif not apart:
            yield pa.RecordBatch.from_pylist([own | parse(text)], schema=arrow)
        else:
            facts, parts = {"valid": True, "error": None, "total_lines": _lines(text)}, []  # held until the last has parsed
            try:
                for n, (before, tree) in enumerate(runs(text)):
                    parts.append(pa.RecordBatch.from_pylist([own | number(n) | facts | _run_symbols(tree, before)[0]], schema=arrow))
            except _ERRORS as e:
                parts = [pa.RecordBatch.from_pylist([own | number(0) | _NOTHING | facts | {"valid": False, "error": _failure(e)}], schema=arrow)]
            yield from parts

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                yield from of({c: batch.column(c)[i].as_py() for c in (file, language, code)})

    return files.select(F.col(file).cast("string").alias(file), F.col(language).cast("string").alias(language), F.col(code).cast("string").alias(code)).mapInArrow(run, target)


def symbols(analyzed: DataFrame, kind: str, file: str = "path") -> DataFrame:
    """One row per symbol of a kind (functions, classes, imports, variables), with its ordinal in the file."""
    return analyzed.select(file, F.posexplode(kind).alias("ordinal", "symbol")).select(file, "ordinal", "symbol.*")


def repository_summary(analyzed: DataFrame) -> DataFrame:
    """Totals over all files with a language, each of one row or in parts."""
    known = analyzed.where("language IS NOT NULL")
    first = F.col("part") == 0 if "part" in analyzed.columns else F.lit(True)
    total = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0)).cast("long").alias(f"total_{c}")
    return known.agg(F.count_if(first).alias("total_files_analyzed"), *[total(c) for c in ("functions", "classes", "imports", "variables")], F.count_if(~F.col("valid")).alias("parse_errors"))


def parse_errors(analyzed: DataFrame, file: str = "path") -> DataFrame:
    """(file, error) of the files with a language that could not be parsed."""
    return analyzed.where("language IS NOT NULL AND NOT valid").select(F.col(file).alias("file"), F.coalesce("error", F.lit("unknown")).alias("error"))


def analyze_file(path: str, language: str) -> dict:
    """The symbols of one file on this machine; not valid, with the reason, if it cannot be read."""
    try:
        with open(path, encoding="utf-8", errors="ignore") as f:
            code = f.read()
    except OSError as e:
        return parse("") | {"valid": False, "error": str(e)}
    return parse(code) if language in SUPPORTED_LANGUAGES else parse("") | {"valid": False, "error": f"No parser for language: {language}"}


def flat_analysis(code: str) -> dict:
    """Validity, error, class and function names and imported modules of one source text."""
    found = parse(code)
    return {
        "valid": found["valid"], "error": found["error"], "classes": [c["name"] for c in found["classes"]],
        "functions": [f["name"] for f in found["functions"]], "imports": [i["module"] for i in found["imports"] if i["module"]],
    }


SUPPORTED_LANGUAGES = ["python"]
