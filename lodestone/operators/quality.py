"""Quality findings: unreachable code, long functions, deep nesting, names, complexity.

Line checks work on each file's lines as an array, in place; checks of Python symbols share one parse of each file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import indent, let, lines, strip
from lodestone.operators.rules import found
from lodestone.operators.security import findings as security_findings
from lodestone.operators.security import is_code, report, unreadable
from lodestone.operators.symbols import analyze_parts

# Words that start a function or method in other languages, and what starts a comment line.
HEADS = ("def ", "function ", "public ", "private ", "protected ", "func ", "static ")
COMMENTS = ("#", "//", "/*", "*")
PART = 256  # lines
SHORTER = "Split the function into parts that do one thing each."


def _lines(code: Column) -> Column:
    """Array of (pos, text, bare, indent) of a text's lines."""
    return F.transform(lines(code), lambda text, i: F.struct(i.alias("pos"), text.alias("text"), strip(text).alias("bare"), indent(text).alias("indent")))


def _exploded(files: DataFrame, file: str, hits: Column) -> DataFrame:
    return files.select(file, F.explode(hits).alias("hit")).select(file, "hit.*")


def _unreachable(code: Column) -> Column:
    rows = F.filter(_lines(code), lambda x: is_code(x["bare"]))
    pairs = lambda all_: F.transform(all_, lambda x, i: F.struct(x.alias("x"), F.get(all_, i + 1).alias("after")))
    hits = lambda p: found(p["x"]["bare"], r"^(return|raise|break|continue)\b") & F.coalesce(p["after"]["indent"] > p["x"]["indent"], F.lit(False))
    return F.transform(F.filter(let(rows, pairs), hits), lambda p: F.struct(
        (p["after"]["pos"] + 1).alias("line"), F.lit("Unreachable Code").alias("type"), F.lit("LOW").alias("severity"), F.lit("This line can never run.").alias("description"),
        F.lit("Remove it, or move it before the line that leaves the block.").alias("fix_suggestion"), F.substring(p["after"]["bare"], 1, 100).alias("evidence"),
    ))


def unreachable(files: DataFrame, file: str, code: str) -> DataFrame:
    """Lines right after a return, raise, break or continue (blank and comment lines aside) that stand deeper."""
    return _exploded(files, file, _unreachable(F.col(code)))


def _deep(code: Column, most: int) -> Column:
    depth = lambda x: F.floor(indent(F.replace(x["text"], F.lit("\t"), F.lit("    "))) / 4).cast("int")
    rows = F.transform(F.filter(_lines(code), lambda x: x["bare"] != ""), lambda x: F.struct(x.alias("x"), depth(x).alias("depth")))
    return F.transform(F.filter(rows, lambda r: r["depth"] > most), lambda r: F.struct(
        (r["x"]["pos"] + 1).alias("line"), F.lit("Deep Nesting").alias("type"), F.lit("LOW").alias("severity"),
        F.concat(F.lit("Nested "), r["depth"].cast("string"), F.lit(f" levels deep, more than {most}.")).alias("description"),
        F.lit("Return early, or move the inner blocks to functions.").alias("fix_suggestion"), F.substring(r["x"]["bare"], 1, 100).alias("evidence"), r["depth"].alias("depth"),
    ))


def deep_nesting(files: DataFrame, file: str, code: str, most: int = 5) -> DataFrame:
    """Non-blank lines indented by more than `most` times four columns, a tab being four."""
    return _exploded(files, file, _deep(F.col(code), most))


def _long_blocks(code: Column, most: int) -> Column:
    """Functions told by the first word of their head. One ends before the next line that is not deeper than its head,
    comments aside, or with the text. Heads inside another function's lines are not functions of their own, so one fold
    over the lines finds all: it holds the function that is open, and the long ones that have ended."""
    head = rf"(?U)^\s*(?:{'|'.join(HEADS)})\s*(\w+)"
    comment = lambda bare: F.exists(F.array(*map(F.lit, COMMENTS)), lambda c: F.startswith(bare, c))
    none, blocks = F.lit(None).cast("struct<pos:int,name:string,indent:int>"), "array<struct<pos:int,name:string,end:int>>"
    state = lambda found, open_: F.struct(found.alias("found"), open_.alias("open"))
    nothing = F.array().cast(blocks)

    def ended(acc: Column, at: Column) -> Column:
        """The found ones when the open function ends before line `at`."""
        block = F.struct(acc["open"]["pos"].alias("pos"), acc["open"]["name"].alias("name"), at.alias("end"))
        return F.when(at - acc["open"]["pos"] > most, F.concat(acc["found"], F.array(block))).otherwise(acc["found"])

    def step(acc: Column, x: Column) -> Column:
        stops = acc["open"].isNotNull() & (x["bare"] != "") & (x["indent"] <= acc["open"]["indent"]) & ~comment(x["bare"])
        opened = F.when(x["text"].rlike(head), F.struct(x["pos"].alias("pos"), F.regexp_extract(x["text"], head, 1).alias("name"), x["indent"].alias("indent")))
        return state(F.when(stops, ended(acc, x["pos"])).otherwise(acc["found"]), F.when(acc["open"].isNotNull() & ~stops, acc["open"]).otherwise(opened))

    def part(acc: Column, rows: Column) -> Column:
        """A part of the lines; a fold copies its state at every step, so the long one is added to once a part only."""
        return let(F.aggregate(rows, state(nothing, acc["open"]), step), lambda own: state(F.concat(acc["found"], own["found"]), own["open"]))

    def whole(rows: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(rows) / PART).cast("int")), lambda i: F.slice(rows, i * PART + 1, F.lit(PART)))
        return F.aggregate(parts, state(nothing, none), part, lambda acc: F.when(acc["open"].isNotNull(), ended(acc, F.size(rows))).otherwise(acc["found"]))

    long_ = F.when(code.isNotNull(), let(_lines(code), whole))
    return F.transform(long_, lambda b: F.struct(
        (b["pos"] + 1).alias("line"), F.lit("Long Function").alias("type"), F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("Function "), b["name"], F.lit(" has about "), (b["end"] - b["pos"]).cast("string"), F.lit(f" lines, more than {most}.")).alias("description"),
        F.lit(SHORTER).alias("fix_suggestion"), F.lit(None).cast("string").alias("evidence"), b["name"].alias("name"), (b["end"] - b["pos"]).alias("length"),
    ))


def long_functions_heuristic(files: DataFrame, file: str, code: str, most: int = 50) -> DataFrame:
    """Long functions of files in other languages than Python."""
    return _exploded(files, file, _long_blocks(F.col(code), most))


def long_functions_python(functions: DataFrame, file: str, most: int = 50) -> DataFrame:
    return functions.where(F.col("line_count") > most).select(file, F.col("start_line").alias("line"), "name", F.col("line_count").alias("length"), F.lit("Long Function").alias("type"), F.lit("MEDIUM").alias("severity"))


def naming(functions: DataFrame, classes: DataFrame, file: str) -> DataFrame:
    """Functions that are not lower snake case (leading underscores aside) and classes that are not camel case."""
    clean = F.regexp_replace("name", "^_+", "")
    bad_f = functions.where((clean != "") & ~clean.rlike("^[a-z][a-z0-9_]*$"))
    bad_c = classes.where(~F.col("name").rlike("^[A-Z][a-zA-Z0-9]*$"))
    row = lambda d, kind: d.select(file, F.col("start_line").alias("line"), "name", F.lit(kind).alias("kind"), F.lit("Naming Convention Violation").alias("type"), F.lit("INFO").alias("severity"))
    return row(bad_f, "function").unionByName(row(bad_c, "class"))


def complex_functions(functions: DataFrame, file: str, most: int = 15) -> DataFrame:
    return functions.where(F.col("complexity") > most).select(file, F.col("start_line").alias("line"), "name", "complexity", F.lit("High Cognitive Complexity").alias("type"), F.lit("MEDIUM").alias("severity"))


def _finding(line: Column, type_: str, severity: str, description: Column, fix: str) -> Column:
    return F.struct(line.alias("line"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), description.alias("description"), F.lit(fix).alias("fix_suggestion"), F.lit(None).cast("string").alias("evidence"))


def _symbol_findings(max_lines: int, max_complexity: int) -> list[tuple[int, Column]]:
    """(check's place, findings) of an analysed file's functions and classes."""
    f, c = F.col("functions"), F.col("classes")
    clean = lambda x: F.regexp_replace(x["name"], "^_+", "")
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return [
        (1, F.transform(F.filter(f, lambda x: x["line_count"] > max_lines), lambda x: _finding(x["start_line"], "Long Function", "MEDIUM", text("Function ", x["name"], " has ", x["line_count"].cast("string"), f" lines, more than {max_lines}."), SHORTER))),
        (3, F.transform(F.filter(f, lambda x: (clean(x) != "") & ~clean(x).rlike("^[a-z][a-z0-9_]*$")), lambda x: _finding(x["start_line"], "Naming Convention Violation", "INFO", text("Function ", x["name"], " is not in snake case."), "Name functions in snake case."))),
        (3, F.transform(F.filter(c, lambda x: ~x["name"].rlike("^[A-Z][a-zA-Z0-9]*$")), lambda x: _finding(x["start_line"], "Naming Convention Violation", "INFO", text("Class ", x["name"], " is not in camel case."), "Name classes in camel case."))),
        (4, F.transform(F.filter(f, lambda x: x["complexity"] > max_complexity), lambda x: _finding(x["start_line"], "High Cognitive Complexity", "MEDIUM", text("Function ", x["name"], " has a complexity of ", x["complexity"].cast("string"), f", more than {max_complexity}."), "Turn conditions into early returns, and parts into functions."))),
    ]


def quality(files: DataFrame, file: str = "path", language: str = "language", code: str = "code", max_lines: int = 50, max_nesting: int = 5, max_complexity: int = 15) -> DataFrame:
    """All quality findings: file, line, check_order, type, severity, category, description, fix_suggestion, evidence.
    Each file is parsed once."""
    parsed = analyze_parts(files, file, language, code)
    other = F.coalesce(F.col(language), F.lit("")) != "python"
    by_line = [(0, _unreachable(F.col(code))), (1, F.when(other, _long_blocks(F.col(code), max_lines))), (2, _deep(F.col(code), max_nesting))]
    columns = ("line", "type", "severity", "description", "fix_suggestion", "evidence")

    def rows(source: DataFrame, parts: list[tuple[int, Column]]) -> DataFrame:
        same = [F.transform(p, lambda x, o=o: F.struct(F.lit(o).alias("check_order"), *[x[c].alias(c) for c in columns])) for o, p in parts]
        each = source.select(F.col(file).cast("string").alias(file), F.explode(F.flatten(F.filter(F.array(*same), lambda x: x.isNotNull()))).alias("hit"))
        return each.select(file, F.col("hit.line").cast("int").alias("line"), "hit.check_order", "hit.type", "hit.severity", F.lit("code_quality").alias("category"), "hit.description", "hit.fix_suggestion", "hit.evidence")

    return rows(files, by_line).unionByName(rows(parsed, _symbol_findings(max_lines, max_complexity)))


def unified(files: DataFrame, file: str = "path", language: str = "language", code: str = "code", **limits) -> DataFrame:
    """Security and quality findings together: file, line, rule, type, severity, category, description, cwe,
    fix_suggestion, evidence, severity_order. For security findings rule is the rule's number and severity_order their
    order in reports; for quality findings both are the check's place. Files with an error are findings too."""
    columns = [file, "line", "rule", "type", "severity", "category", "description", "cwe", "fix_suggestion", "evidence", "severity_order"]
    own = quality(files, file, language, code, **limits).withColumns({"rule": F.col("check_order"), "severity_order": F.col("check_order"), "cwe": F.lit(None).cast("string")})
    both = security_findings(files, file, code).withColumn(file, F.col(file).cast("string")).select(*columns).unionByName(own.select(*columns))
    return both.unionByName(unreadable(files, file).withColumns({"rule": F.lit(-1), "severity_order": F.lit(3)}).select(*columns)) if "error" in files.columns else both


def unified_report(files: DataFrame, file: str = "path", language: str = "language", code: str = "code", **limits) -> DataFrame:
    """One row per file: total_findings, counts by severity, severity_breakdown, category_breakdown, security_findings,
    quality_findings, all_findings and a health_score over all findings. A file with an error has its error, too."""
    out = report(files, unified(files, file, language, code, **limits), file)
    return out.join(files.select(file, "error"), file) if "error" in files.columns else out
