"""Registered queries over the reference's operators, with their SQL equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import paths as P
from lodestone.functions import text as T
from lodestone.functions.lineage import cut
from lodestone.functions.stage_log import StageLog
from lodestone.operators import chunks, declarations, graph, keyword, keyword_scan, quality, retrieval, review, rules, security, symbols
from lodestone.plans import corpora as C
from lodestone.plans.corpora import literal, read
from lodestone.sources import tree
from lodestone.streaming import webhook

FLAGSHIP = "security_health_by_document"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- SQL parts -------------------------------------------------------------------------------------------------------

STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_SPECIAL = {
    "Unsafe Deserialization — PyYAML": r"(regexp_matches({0}, 'yaml\.(load|unsafe_load)\s*\(') AND NOT regexp_matches({0}, 'yaml\.(load|unsafe_load)\s*\(.*Loader\s*=\s*(SafeLoader|yaml\.SafeLoader)'))",
    "Weak Cryptography — Deprecated Algorithm": r"regexp_matches({0}, '(?i)(DES|Blowfish|RC4|RC2)([^\p{{L}}\p{{N}}_]|$)')",
    "Insecure HTTP — Plaintext URL": r"(len(regexp_extract_all({0}, 'http://')) > len(regexp_extract_all({0}, 'http://(localhost|127\.0\.0\.1|0\.0\.0\.0)')))",
}


def rule_sql(rule: rules.Rule, line: str) -> str:
    return _SPECIAL[rule.type].format(line) if rule.type in _SPECIAL else f"regexp_matches({line}, {literal(rule.pattern)})"


_RULES = ", ".join(f"({i}, {literal(r.type)}, {literal(r.severity)}, {literal(r.cwe)}, {rules.SEVERITY_ORDER[r.severity]}, {rules.DEDUCTIONS[r.severity]})" for i, r in enumerate(rules.SECURITY_RULES))
_WHEN = " ".join(f"WHEN {i} THEN {rule_sql(r, 'l.line')}" for i, r in enumerate(rules.SECURITY_RULES))


def findings_sql(source: str) -> str:
    """CTE `findings` from a relation (file, pos, line)."""
    return f"""rules(rule, type, severity, cwe, sev_order, ded) AS (VALUES {_RULES}),
bare AS (SELECT file, pos, line, {STRIP.format('line')} AS bare FROM {source}),
findings AS (
  SELECT l.file, l.pos + 1 AS line, r.rule, r.type, r.severity, r.cwe, r.sev_order, r.ded, substr(l.bare, 1, 120) AS evidence
  FROM bare l, rules r
  WHERE l.bare <> '' AND NOT starts_with(l.bare, '#') AND NOT starts_with(l.bare, '//') AND CASE r.rule {_WHEN} END)"""


DOC_LINES = "doc_lines AS (SELECT doc_id AS file, unnest(range(len(p))) AS pos, unnest(p) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents))"


def values_sql(columns: str, rows) -> str:
    cell = lambda v: "NULL" if v is None else ("TRUE" if v is True else "FALSE" if v is False else literal(v) if isinstance(v, str) else str(v))
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({columns})"


# --- security --------------------------------------------------------------------------------------------------------


def _documents(spark, sf_dir, where=None):
    d = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return d if where is None else d.where(where)


@query(
    f"""WITH {DOC_LINES}, {findings_sql('doc_lines')}
SELECT d.doc_id, CAST(count(f.type) AS BIGINT) AS total_findings, CAST(count(f.type) FILTER (f.severity = 'CRITICAL') AS BIGINT) AS critical,
  CAST(count(f.type) FILTER (f.severity = 'HIGH') AS BIGINT) AS high, CAST(count(f.type) FILTER (f.severity = 'MEDIUM') AS BIGINT) AS medium,
  CAST(count(f.type) FILTER (f.severity = 'LOW') AS BIGINT) AS low, CAST(count(f.type) FILTER (f.severity = 'INFO') AS BIGINT) AS info,
  greatest(0.0::DOUBLE, round(100.0::DOUBLE - CAST(coalesce(sum(f.ded), 0) AS DOUBLE), 1)) AS health_score
FROM documents d LEFT JOIN findings f ON f.file = d.doc_id GROUP BY d.doc_id"""
)
def security_health_by_document(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    return security.health(docs, security.findings(docs, "doc_id", "text"), "doc_id")


@query(f"WITH {C.CODE_LINES}, {findings_sql('code_lines')} SELECT file, CAST(line AS INTEGER) AS line, type, severity, cwe, evidence, CAST(sev_order AS INTEGER) AS severity_order, CAST(rule AS INTEGER) AS rule FROM findings")
def security_findings_lines(spark, sf_dir):
    found = security.findings(C.code_files(spark, sf_dir), "file", "code")
    return found.select("file", "line", "type", "severity", "cwe", "evidence", "severity_order", "rule")


@query(f"WITH {C.CODE_LINES}, {findings_sql('code_lines')} SELECT file, severity, CAST(count(*) AS BIGINT) AS findings FROM findings GROUP BY file, severity")
def security_severity_rollup(spark, sf_dir):
    return security.findings(C.code_files(spark, sf_dir), "file", "code").groupBy("file", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query(
    f"""WITH {C.CODE_LINES}, {findings_sql('code_lines')}, u AS (SELECT count(*) AS n, 'security' AS category FROM findings)
SELECT category, CAST(n AS BIGINT) AS findings FROM u UNION ALL
SELECT 'code_quality', CAST(count(*) AS BIGINT) FROM bare WHERE bare <> '' AND (length(replace(line, chr(9), '    ')) - length(regexp_replace(replace(line, chr(9), '    '), '^\\s+', ''))) // 4 > 5"""
)
def security_category_rollup(spark, sf_dir):
    files = C.code_files(spark, sf_dir)
    both = security.findings(files, "file", "code").select("category").unionByName(quality.deep_nesting(files, "file", "code").select(F.lit("code_quality").alias("category")))
    return both.groupBy("category").agg(F.count(F.lit(1)).alias("findings"))


@query(f"SELECT page_id, url FROM pages WHERE {_SPECIAL['Insecure HTTP — Plaintext URL'].format('url')}")
def insecure_url_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url").where(rules.found(F.col("url"), rules.SECURITY_RULES[23].pattern))


@query(f"WITH {DOC_LINES}, {findings_sql('doc_lines')} SELECT file AS doc_id, CAST(line AS INTEGER) AS line FROM findings WHERE rule = 3")
def hardcoded_token_documents(spark, sf_dir):
    return security.findings(_documents(spark, sf_dir), "doc_id", "text", [3]).select("doc_id", "line")


@query(f"WITH {DOC_LINES}, {findings_sql('doc_lines')} SELECT d.lang, CAST(count(*) AS BIGINT) AS findings, CAST(count(DISTINCT f.file) AS BIGINT) AS documents FROM findings f JOIN documents d ON d.doc_id = f.file WHERE f.rule = 20 GROUP BY d.lang")
def weak_crypto_by_language(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    found = security.findings(docs, "doc_id", "text", [20]).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return found.join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.sum("n").alias("findings"), F.count(F.lit(1)).alias("documents"))


# --- files -----------------------------------------------------------------------------------------------------------

_SUFFIX = r"lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1))"
_LANG = f"CASE WHEN lower(regexp_extract(path, '[^/]*$')) IN ({', '.join(map(literal, P.DOCKER_NAMES))}) THEN 'dockerfile' ELSE CASE {_SUFFIX} {' '.join(f'WHEN {literal(k)} THEN {literal(v)}' for k, v in P.LANGUAGES.items())} END END"
_IGNORED = f"len(list_filter(string_split(path, '/')[1:-2], lambda x: x IN ({', '.join(map(literal, P.IGNORED_DIRS))}) OR starts_with(x, '.'))) > 0"
_BINARY = f"{_SUFFIX} IN ({', '.join(map(literal, P.BINARY_SUFFIXES))})"


@query(f"WITH {C.PATHS} SELECT coalesce({_LANG}, 'unknown') AS language, CAST(count(*) AS BIGINT) AS files FROM paths GROUP BY 1")
def language_histogram(spark, sf_dir):
    return tree.histogram(C.paths(spark, sf_dir).withColumn("language", P.language(F.col("path"))))


@query(f"WITH {C.PATHS} SELECT k, path, {_LANG} AS language FROM paths WHERE {_LANG} IS NOT NULL")
def source_file_filter(spark, sf_dir):
    return tree.source_files(C.paths(spark, sf_dir).select("k", "path", P.language(F.col("path")).alias("language")))


@query(f"WITH {C.PATHS} SELECT k, path FROM paths WHERE NOT ({_IGNORED}) AND NOT ({_BINARY})")
def ignored_and_binary_filter(spark, sf_dir):
    p = F.col("path")
    return C.paths(spark, sf_dir).select("k", "path").where(~P.in_ignored_dir(p) & ~P.is_binary(p))


@query("SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) - CASE WHEN ends_with(text, chr(10)) THEN 1 ELSE 0 END END AS BIGINT) AS line_count, sha256(text) AS sha256, CAST(octet_length(encode(text)) AS INTEGER) AS size_bytes FROM documents")
def file_manifest(spark, sf_dir):
    raw = read(spark, sf_dir, "documents").select("doc_id", F.format_string("d%d.txt", "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content"))
    return tree.with_facts(raw).select("doc_id", "line_count", "sha256", F.octet_length("content").alias("size_bytes"))


@query(f"WITH {C.PATHS} SELECT k, CASE WHEN ends_with(path, '.py') THEN replace(left(path, length(path) - 3), '/', '.') END AS strict, replace(CASE WHEN ends_with(path, '.py') THEN left(path, length(path) - 3) ELSE path END, '/', '.') AS lenient FROM paths")
def module_names(spark, sf_dir):
    return C.paths(spark, sf_dir).select("k", T.module_strict(F.col("path")).alias("strict"), T.module_lenient(F.col("path")).alias("lenient"))


# --- quality ---------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {C.CODE_LINES}, b AS (
  SELECT file, pos, line, {STRIP.format('line')} AS bare, length(line) - length(regexp_replace(line, '^\\s+', '')) AS ind FROM code_lines),
n AS (SELECT *, lead(pos) OVER w AS np, lead(bare) OVER w AS nb, lead(ind) OVER w AS ni FROM b WHERE bare <> '' AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '//') WINDOW w AS (PARTITION BY file ORDER BY pos))
SELECT file, CAST(np + 1 AS INTEGER) AS line, substr(nb, 1, 100) AS evidence FROM n WHERE regexp_matches(bare, '^(return|raise|break|continue)\\b') AND ni > ind"""
)
def unreachable_code(spark, sf_dir):
    return quality.unreachable(C.code_files(spark, sf_dir), "file", "code").select("file", "line", "evidence")


@query(f"WITH {C.CODE_LINES}, d AS (SELECT file, pos + 1 AS line, {STRIP.format('line')} AS bare, CAST((length(line) - length(regexp_replace(line, '^\\s+', ''))) // 4 AS INTEGER) AS depth FROM code_lines) SELECT file, CAST(line AS INTEGER) AS line, depth FROM d WHERE bare <> '' AND depth > 2")
def deep_nesting(spark, sf_dir):
    return quality.deep_nesting(C.code_files(spark, sf_dir), "file", "code", 2).select("file", "line", "depth")


_JS = "function outer(a) {\n  one();\n  function inner() {\n    two();\n  }\n  three();\n}\npublic static void f() {\n  a;\n\n// note\n}\nfunc g() {}\n"


@query(values_sql("file, line, name, length", [("w.js", 1, "outer", 6), ("w.js", 8, "static", 4)]))
def long_functions_heuristic(spark, sf_dir):
    files = spark.createDataFrame([("w.js", _JS)], "file string, code string")
    return quality.long_functions_heuristic(files, "file", "code", 3).select("file", "line", "name", "length")


_IND = "length({0}) - length(regexp_replace({0}, '^\\s+', ''))"
_HEAD = r"^\s*(def |function |public |private |protected |func |static )\s*([\p{L}\p{N}_]+)"
_LONG = f"""x AS (SELECT file, pos, line, {STRIP.format('line')} AS bare, {_IND.format('line')} AS ind FROM code_lines),
solid AS (SELECT * FROM x WHERE bare <> '' AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '//') AND NOT starts_with(bare, '/*') AND NOT starts_with(bare, '*')),
head AS (SELECT h.file, h.pos, regexp_extract(h.line, {literal(_HEAD)}, 2) AS name, coalesce((SELECT min(s.pos) FROM solid s WHERE s.file = h.file AND s.pos > h.pos AND s.ind <= h.ind), (SELECT max(pos) + 1 FROM x l WHERE l.file = h.file)) AS stop
  FROM x h WHERE regexp_matches(h.line, {literal(_HEAD)})),
long AS (SELECT * FROM head h WHERE NOT EXISTS (SELECT 1 FROM head o WHERE o.file = h.file AND o.pos < h.pos AND o.stop > h.pos) AND stop - pos > 3)"""


@query(f"WITH {C.CODE_LINES}, {_LONG} SELECT file, CAST(pos + 1 AS INTEGER) AS line, name, CAST(stop - pos AS INTEGER) AS length FROM long")
def long_functions_files(spark, sf_dir):
    return quality.long_functions_heuristic(C.code_files(spark, sf_dir), "file", "code", 3).select("file", "line", "name", "length")


@query(
    f"""WITH {C.CODE_LINES}, {findings_sql('code_lines')}, {_LONG},
n AS (SELECT file, lead(pos) OVER w AS np, bare, ind, lead(ind) OVER w AS ni FROM x WHERE bare <> '' AND NOT starts_with(bare, '#') AND NOT starts_with(bare, '//') WINDOW w AS (PARTITION BY file ORDER BY pos)),
u AS (SELECT file, severity, 'security' AS category, ded FROM findings UNION ALL SELECT file, 'LOW', 'code_quality', 2 FROM n WHERE regexp_matches(bare, '^(return|raise|break|continue)\\b') AND ni > ind
  UNION ALL SELECT file, 'MEDIUM', 'code_quality', 5 FROM long UNION ALL SELECT file, 'LOW', 'code_quality', 2 FROM x WHERE bare <> '' AND ind // 4 > 2)
SELECT f.file, CAST(count(u.file) AS BIGINT) AS total_findings, CAST(count(u.file) FILTER (severity = 'LOW') AS BIGINT) AS low, CAST(count(u.file) FILTER (severity = 'MEDIUM') AS BIGINT) AS medium,
  CAST(count(u.file) FILTER (category = 'security') AS INTEGER) AS n_security, CAST(count(u.file) FILTER (category = 'code_quality') AS INTEGER) AS n_quality, greatest(0.0::DOUBLE, round(100.0::DOUBLE - CAST(coalesce(sum(ded), 0) AS DOUBLE), 1)) AS health_score
FROM (SELECT DISTINCT file FROM code_lines) f LEFT JOIN u ON u.file = f.file GROUP BY f.file"""
)
def unified_report_files(spark, sf_dir):
    """Both scanners over files of no language that is parsed."""
    r = quality.unified_report(C.code_files(spark, sf_dir).withColumn("language", F.lit("text")), "file", max_lines=3, max_nesting=2)
    return r.select("file", "total_findings", "low", "medium", F.size("security_findings").alias("n_security"), F.size("quality_findings").alias("n_quality"), "health_score")


@query(f"""WITH {C.PYTHON_LINES}
SELECT file, 'function' AS kind, 'f' || k AS name, 'a,b' AS detail, line, line + 3 AS last, 2 AS complexity FROM p WHERE t = 0
UNION ALL SELECT file, 'function', 'm' || k, 'self,x', line + 1, line + 4, 3 FROM p WHERE t = 1 UNION ALL SELECT file, 'function', 'Bad' || k, '', line, line + 1, 0 FROM p WHERE t = 2
UNION ALL SELECT file, 'class', 'C' || k, 'base.Thing', line, line + 4, NULL FROM p WHERE t = 1
UNION ALL SELECT file, 'import', 'mod' || (k % 7), 'mod' || (k % 7), line, NULL, NULL FROM p WHERE t = 3 UNION ALL SELECT file, 'variable', 'LIMIT_' || k, 'true', line + 1, NULL, NULL FROM p WHERE t = 3""")
def python_symbols_files(spark, sf_dir):
    """All symbols of Python files, one of them for every part."""
    parsed, none = symbols.analyze_parts(C.python_files(spark, sf_dir), "file"), F.lit(None).cast("int")
    row = lambda kind, x, detail, line, last, complexity: F.struct(F.lit(kind).alias("kind"), x.alias("name"), detail.alias("detail"), line.alias("line"), last.alias("last"), complexity.alias("complexity"))
    parts = F.concat(
        F.transform("functions", lambda x: row("function", x["name"], F.array_join(x["args"], ","), x["start_line"], x["end_line"], x["complexity"])),
        F.transform("classes", lambda x: row("class", x["name"], F.array_join(x["bases"], ","), x["start_line"], x["end_line"], none)),
        F.transform("imports", lambda x: row("import", x["module"], F.array_join(x["names"], ","), x["line"], none, none)),
        F.transform("variables", lambda x: row("variable", x["name"], x["is_constant"].cast("string"), x["line"], none, none)),
    )
    return parsed.select("file", F.explode(parts).alias("s")).select("file", "s.*")


@query(f"WITH {C.FOREIGN_SYMBOLS} SELECT path, kind, name, detail, line, last FROM found")
def declarations_files(spark, sf_dir):
    """All symbols of files in five languages other than Python, one piece of them for every part."""
    found, none = declarations.declared_parts(C.foreign_files(spark, sf_dir)), F.lit(None).cast("int")
    row = lambda kind, x, detail, line, last: F.struct(F.lit(kind).alias("kind"), x.alias("name"), detail.alias("detail"), line.alias("line"), last.alias("last"))
    parts = F.concat(
        F.transform("functions", lambda x: row("function", x["name"], F.array_join(x["args"], ","), x["start_line"], x["end_line"])),
        F.transform("classes", lambda x: row("class", x["name"], F.concat_ws("|", F.array_join(x["bases"], ","), F.array_join(x["methods"], ",")), x["start_line"], x["end_line"])),
        F.transform("imports", lambda x: row("import", x["module"], x["is_from_import"].cast("string"), x["line"], none)),
        F.transform("variables", lambda x: row("variable", x["name"], x["is_constant"].cast("string"), x["line"], none)),
    )
    return found.select("path", F.explode(parts).alias("s")).select("path", "s.*")


@query(f"""WITH {C.FOREIGN_SYMBOLS}, s AS (SELECT * FROM found UNION ALL SELECT file, kind, name, detail, line, last FROM py),
files AS (SELECT DISTINCT path FROM p UNION ALL SELECT DISTINCT file FROM pl)
SELECT CAST((SELECT count(*) FROM files) AS BIGINT) AS total_files_analyzed, CAST(count(*) FILTER (kind = 'function') AS BIGINT) AS total_functions, CAST(count(*) FILTER (kind = 'class') AS BIGINT) AS total_classes,
  CAST(count(*) FILTER (kind = 'import') AS BIGINT) AS total_imports, CAST(count(*) FILTER (kind = 'variable') AS BIGINT) AS total_variables, CAST(0 AS BIGINT) AS parse_errors FROM s""".replace(", s AS (", f""", {C.PYTHON_LINES.replace("p AS (", "pl AS (", 1)},
py AS (SELECT file, 'function' AS kind, 'f' AS name, '' AS detail, line, line AS last FROM pl WHERE t < 3 UNION ALL SELECT file, 'class', 'C', '', line, line FROM pl WHERE t = 1
  UNION ALL SELECT file, 'import', 'm', '', line, line FROM pl WHERE t = 3 UNION ALL SELECT file, 'variable', 'L', '', line, line FROM pl WHERE t = 3),
s AS (""", 1))
def repository_summary_files(spark, sf_dir):
    """Totals over files of six languages, made of every part twice."""
    python = C.python_files(spark, sf_dir).select(F.col("file").alias("path"), "language", "code")
    return symbols.repository_summary(declarations.analyze_all_parts(python.unionByName(C.foreign_files(spark, sf_dir))))


@query(f"""WITH {C.PYTHON_LINES}
SELECT file, line, 'Long Function' AS type, 'MEDIUM' AS severity FROM p WHERE t = 0 UNION ALL SELECT file, line + 1, 'Long Function', 'MEDIUM' FROM p WHERE t = 1
UNION ALL SELECT file, line, 'Naming Convention Violation', 'INFO' FROM p WHERE t = 2 UNION ALL SELECT file, line + 1, 'High Cognitive Complexity', 'MEDIUM' FROM p WHERE t = 1
UNION ALL SELECT file, line + 3, 'Deep Nesting', 'LOW' FROM p WHERE t = 1 UNION ALL SELECT file, line + 4, 'Deep Nesting', 'LOW' FROM p WHERE t = 1""")
def quality_files(spark, sf_dir):
    return quality.quality(C.python_files(spark, sf_dir), "file", max_lines=3, max_nesting=2, max_complexity=2).select("file", "line", "type", "severity")


def _parsed(spark):
    return symbols.analyze(C.snippets(spark))


_FUNCTIONS = [
    ("pkg/a.py", "Bad_Name", "x", "", None, "Says.", 24, 27, False, False),
    ("pkg/a.py", "size", "self", "property", "int", None, 14, 15, True, False),
    ("pkg/a.py", "load", "self,path", "", None, None, 17, 21, True, True),
    ("pkg/b.py", "run", "a,b", "staticmethod", None, None, 6, 12, False, False),
    ("pkg/b.py", "stop", "", "", None, None, 15, 18, False, False),
    ("pkg/b.py", "inner", "", "", None, None, 16, 17, False, False),
]


@query(values_sql("path, name, args, decorators, return_annotation, docstring, start_line, end_line, is_method, is_async", _FUNCTIONS))
def python_functions(spark, sf_dir):
    f = symbols.symbols(_parsed(spark), "functions")
    return f.select("path", "name", F.array_join("args", ",").alias("args"), F.array_join("decorators", ",").alias("decorators"), "return_annotation", "docstring", "start_line", "end_line", "is_method", "is_async")


@query(values_sql("path, name, bases, methods, docstring, start_line, end_line", [("pkg/a.py", "Base", "object", "size,load", "Doc.", 10, 21), ("pkg/b.py", "_low", "B,pkg.Other", "", None, 21, 22)]))
def python_classes(spark, sf_dir):
    c = symbols.symbols(_parsed(spark), "classes")
    return c.select("path", "name", F.array_join("bases", ",").alias("bases"), F.array_join("methods", ",").alias("methods"), "docstring", "start_line", "end_line")


_IMPORTS = [
    ("pkg/a.py", "os", "os", None, False, 1), ("pkg/a.py", "sys", "sys", "system", False, 1), ("pkg/a.py", "pkg.b", "run,stop", None, True, 2), ("pkg/a.py", None, "x", None, True, 3),
    ("pkg/b.py", "json", "json", None, False, 1), ("pkg/b.py", "pkg.a", "Base", None, True, 2),
]


@query(values_sql("path, module, names, alias, is_from_import, line", _IMPORTS))
def python_imports(spark, sf_dir):
    return symbols.symbols(_parsed(spark), "imports").select("path", "module", F.array_join("names", ",").alias("names"), "alias", "is_from_import", "line")


@query(values_sql("path, name, annotation, line, is_constant", [("pkg/a.py", "LIMIT", None, 5, True), ("pkg/a.py", "name", "str", 6, False), ("pkg/a.py", "a", None, 7, False), ("pkg/a.py", "b", None, 7, False)]))
def python_variables(spark, sf_dir):
    return symbols.symbols(_parsed(spark), "variables").select("path", "name", "annotation", "line", "is_constant")


@query(values_sql("path, name, complexity", [("pkg/a.py", "Bad_Name", 1), ("pkg/a.py", "size", 0), ("pkg/a.py", "load", 4), ("pkg/b.py", "run", 8), ("pkg/b.py", "stop", 1), ("pkg/b.py", "inner", 0)]))
def cognitive_complexity(spark, sf_dir):
    return symbols.symbols(_parsed(spark), "functions").select("path", "name", "complexity")


@query(values_sql("path, line, name, kind", [("pkg/a.py", 24, "Bad_Name", "function"), ("pkg/b.py", 21, "_low", "class")]))
def naming_violations(spark, sf_dir):
    p = _parsed(spark)
    return quality.naming(symbols.symbols(p, "functions"), symbols.symbols(p, "classes"), "path").select("path", "line", "name", "kind")


@query(values_sql("path, line, name, length", [("pkg/a.py", 17, "load", 5), ("pkg/b.py", 6, "run", 7)]))
def long_functions_python(spark, sf_dir):
    return quality.long_functions_python(symbols.symbols(_parsed(spark), "functions"), "path", 4).select("path", "line", "name", "length")


@query(values_sql("total_files_analyzed, total_functions, total_classes, total_imports, total_variables, parse_errors", [(4, 6, 2, 6, 4, 2)]))
def repository_summary(spark, sf_dir):
    return symbols.repository_summary(_parsed(spark))


@query(values_sql("path, line, type, severity, category", [
    ("pkg/a.py", 24, "Naming Convention Violation", "INFO", "code_quality"), ("pkg/b.py", 21, "Naming Convention Violation", "INFO", "code_quality"),
    ("pkg/a.py", 17, "Long Function", "MEDIUM", "code_quality"), ("pkg/b.py", 6, "Long Function", "MEDIUM", "code_quality"),
    ("pkg/b.py", 10, "Deep Nesting", "LOW", "code_quality"), ("pkg/a.py", 19, "Deep Nesting", "LOW", "code_quality"), ("pkg/a.py", 20, "Deep Nesting", "LOW", "code_quality"),
    ("pkg/b.py", 9, "Deep Nesting", "LOW", "code_quality"), ("pkg/b.py", 6, "High Cognitive Complexity", "MEDIUM", "code_quality"),
]))
def unified_scan(spark, sf_dir):
    return quality.unified(C.snippets(spark), max_lines=4, max_nesting=2, max_complexity=5).select("path", "line", "type", "severity", "category")


@query(values_sql("total_dependencies, internal_dependencies, external_dependencies", [(5, 2, 3)]))
def dependency_summary(spark, sf_dir):
    return graph.dependency_summary(graph.dependency_edges(symbols.symbols(_parsed(spark), "imports")))


@query(f"""WITH {C.MORE_LINES}
SELECT path, 'd' || k AS name, 'a' AS args, 'prop,wrap' AS decorators, 'int' AS return_annotation, 'Says ' || k || '.' AS docstring, line + 2 AS start_line, line + 4 AS end_line, FALSE AS is_method, FALSE AS is_async FROM p WHERE t = 0
UNION ALL SELECT path, 'go_' || k, 'self,x', 'staticmethod', NULL, NULL, line + 3, line + 5, TRUE, TRUE FROM p WHERE t = 1
UNION ALL SELECT path, 'inner', '', '', NULL, NULL, line + 4, line + 4, FALSE, FALSE FROM p WHERE t = 1""")
def python_functions_files(spark, sf_dir):
    f = symbols.symbols(symbols.analyze_parts(C.python_more(spark, sf_dir)), "functions")
    return f.select("path", "name", F.array_join("args", ",").alias("args"), F.array_join("decorators", ",").alias("decorators"), "return_annotation", "docstring", "start_line", "end_line", "is_method", "is_async")


@query(f"""WITH {C.MORE_LINES}
SELECT path, 'class' AS kind, 'low_' || k AS name, 'Base,pkg.Other|go_' || k || '|Doc.' AS detail, line FROM p WHERE t = 1
UNION ALL SELECT path, 'import', 'pkg.sub', 'y' || k || ',w|true', line FROM p WHERE t = 2 UNION ALL SELECT path, 'import', 'none', 'q' || k || '|true', line + 1 FROM p WHERE t = 2
UNION ALL SELECT path, 'variable', 'name_' || k, 'str|false', line + 2 FROM p WHERE t = 2""")
def python_classes_files(spark, sf_dir):
    """Classes, imports and variables with their details."""
    text = lambda *parts: F.concat_ws("|", *[F.coalesce(x.cast("string"), F.lit("none")) for x in parts])
    row = lambda kind, name, detail, line: F.struct(F.lit(kind).alias("kind"), F.coalesce(name, F.lit("none")).alias("name"), detail.alias("detail"), line.alias("line"))
    parts = F.concat(
        F.transform("classes", lambda x: row("class", x["name"], text(F.array_join(x["bases"], ","), F.array_join(x["methods"], ","), x["docstring"]), x["start_line"])),
        F.transform("imports", lambda x: row("import", x["module"], text(F.array_join(x["names"], ","), x["is_from_import"]), x["line"])),
        F.transform("variables", lambda x: row("variable", x["name"], text(x["annotation"], x["is_constant"]), x["line"])),
    )
    return symbols.analyze_parts(C.python_more(spark, sf_dir)).select("path", F.explode(parts).alias("s")).select("path", "s.*")


@query(f"WITH {C.MORE_LINES} SELECT path, line, 'low_' || k AS name, 'class' AS kind FROM p WHERE t = 1")
def naming_files(spark, sf_dir):
    found = symbols.analyze_parts(C.python_more(spark, sf_dir))
    return quality.naming(symbols.symbols(found, "functions"), symbols.symbols(found, "classes"), "path").select("path", "line", "name", "kind")


@query(f"""WITH {C.MORE_LINES}, seg(t, place, lines, own) AS (VALUES {', '.join(f"({t}, {place}, {n}, {'TRUE' if own else 'FALSE'})" for t, place, n, own in C.SEGMENTS)}),
s AS (SELECT path, o, k, place, lines, own, coalesce(lag(own) OVER w, TRUE) AS after FROM p JOIN seg USING (t) WINDOW w AS (PARTITION BY path ORDER BY o, k, place)),
g AS (SELECT *, sum(CASE WHEN own OR after THEN 1 ELSE 0 END) OVER (PARTITION BY path ORDER BY o, k, place ROWS UNBOUNDED PRECEDING) AS part FROM s),
parts AS (SELECT path, part, CAST(sum(lines) AS BIGINT) AS lines FROM g GROUP BY path, part),
tiles AS (SELECT path, part, tile, least(4, lines - tile * 4) AS lines FROM (SELECT *, unnest(range((lines - 1) // 4 + 1)) AS tile FROM parts))
SELECT path AS filepath, CAST(row_number() OVER (PARTITION BY path ORDER BY part, tile) - 1 AS INTEGER) AS chunk_index, CAST(lines AS INTEGER) AS n_lines FROM tiles""")
def chunk_python_files(spark, sf_dir):
    """Tiles of at most four lines that keep within definitions or between them."""
    c = chunks.chunk_python(C.python_more(spark, sf_dir), "path", "code", 4)
    return c.select("filepath", "chunk_index", F.size(F.split("content", "\n")).alias("n_lines"))


# --- graphs ----------------------------------------------------------------------------------------------------------

_COUNTS = "c AS (SELECT (SELECT count(DISTINCT n) FROM (SELECT src AS n FROM edges UNION ALL SELECT dst FROM edges)) AS nodes, (SELECT count(*) FROM edges) AS edges)"


def _walk_sql(edges: str) -> str:
    """CTEs of an edge table and of its simple cycles, `loops` (path), each from its smallest node."""
    return f"""{edges}, walk(start, here, path) AS (
  SELECT src, dst, [src] FROM edges WHERE dst >= src
  UNION ALL SELECT w.start, e.dst, list_append(w.path, w.here) FROM walk w JOIN edges e ON e.src = w.here WHERE w.here > w.start AND NOT list_contains(w.path, w.here) AND e.dst >= w.start),
loops AS (SELECT array_to_string(path, '>') AS cycle, len(path) AS length FROM walk WHERE here = start)"""


@query(f"""WITH RECURSIVE {_walk_sql(C.TRANSITIONS)}, {_COUNTS}, k AS (SELECT count(*) AS n, coalesce(string_agg(cycle, ';' ORDER BY cycle), '') AS circular FROM loops)
SELECT CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, CASE WHEN edges = 0 OR nodes <= 1 THEN 0.0::DOUBLE ELSE round(edges::DOUBLE / (nodes * (nodes - 1)), 6) END AS density,
  round(2.0::DOUBLE * edges / nodes, 6) AS average_degree, n = 0 AS is_dag, n > 0 AS has_circular_deps, CAST(n AS INTEGER) AS n_cycles, circular AS circular_dependencies FROM c, k""")
def graph_stats(spark, sf_dir):
    g = graph.stats(C.transitions(spark, sf_dir))
    loops = F.array_join(F.array_sort(F.transform("circular_dependencies", lambda x: F.array_join(x, ">"))), ";")
    return g.select("nodes", "edges", "density", "average_degree", "is_dag", "has_circular_deps", F.size("circular_dependencies").alias("n_cycles"), loops.alias("circular_dependencies"))


_ARCH = """SELECT CAST(nodes AS BIGINT) AS nodes, CAST(edges AS BIGINT) AS edges, cohesion_score, coupling_ratio, architecture_pattern,
  CASE WHEN cohesion_score >= 0.8 AND coupling_ratio <= 5 THEN 'EXCELLENT' WHEN cohesion_score >= 0.5 AND coupling_ratio <= 5 THEN 'GOOD' WHEN coupling_ratio > 5 THEN 'WARN' ELSE 'POOR' END AS verdict
FROM (SELECT nodes, edges, round(edges::DOUBLE / (nodes * (nodes - 1)), 4) AS cohesion_score, round(edges::DOUBLE / nodes, 2) AS coupling_ratio,
  CASE WHEN nodes <= 10 AND edges <= 15 THEN '4-Part Modular Enterprise Layering' WHEN edges::DOUBLE / nodes > 4 THEN 'Highly Connected / Potential Monolith' ELSE 'Modular Layered Architecture' END AS architecture_pattern FROM c)"""


@query(f"WITH {C.TRANSITIONS}, {_COUNTS} {_ARCH}")
def architecture_verdict(spark, sf_dir):
    return graph.architecture(graph.counts(C.transitions(spark, sf_dir))).select("nodes", "edges", "cohesion_score", "coupling_ratio", "architecture_pattern", "verdict")


@query(f"WITH {C.NATION_EDGES} SELECT 'out' AS direction, dst AS neighbor FROM edges WHERE src = 'NATION_4' UNION SELECT 'in', src FROM edges WHERE dst = 'NATION_4'")
def graph_neighbors(spark, sf_dir):
    e = C.nation_edges(spark, sf_dir)
    side = lambda d: graph.neighbors(e, "NATION_4", d).select(F.lit(d).alias("direction"), "neighbor")
    return side("out").unionByName(side("in"))


@query(
    f"""WITH RECURSIVE {C.NATION_EDGES}, walk(node, path, hops) AS (
  SELECT (SELECT min(src) FROM edges), [(SELECT min(src) FROM edges)], 0
  UNION ALL SELECT e.dst, list_append(w.path, e.dst), w.hops + 1 FROM walk w JOIN edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst)),
best AS (SELECT node, path, hops, row_number() OVER (PARTITION BY node ORDER BY hops, path) AS r FROM walk)
SELECT node, CAST(hops AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM best WHERE r = 1"""
)
def graph_shortest_path(spark, sf_dir):
    e = C.nation_edges(spark, sf_dir)
    return graph.shortest_paths(e, e.agg(F.min("src").alias("source"))).select("node", "hops", F.array_join("path", ">").alias("path"))


@query(f"WITH RECURSIVE {_walk_sql(C.NATION_EDGES)} SELECT CAST(length AS INTEGER) AS length, cycle FROM loops")
def graph_cycles(spark, sf_dir):
    return graph.cycles(C.nation_edges(spark, sf_dir)).select("length", F.array_join("cycle", ">").alias("cycle"))


@query(f"WITH RECURSIVE {_walk_sql(C.NATION_EDGES)} SELECT CAST(length AS INTEGER) AS length, cycle FROM loops WHERE length > 1")
def import_cycles(spark, sf_dir):
    """Modules that import each other: a source file for each nation, which imports the nations it leads to."""
    e = C.nation_edges(spark, sf_dir).where("src <> dst")
    files = e.groupBy(F.concat("src", F.lit(".py")).alias("path")).agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import "), "dst"))), "\n").alias("code")).withColumn("language", F.lit("python"))
    return graph.import_cycles(graph.dependency_edges(symbols.symbols(symbols.analyze(files), "imports"))).select("length", F.array_join("cycle", ">").alias("cycle"))


@query(f"""WITH RECURSIVE {C.NATION_EDGES}, reach(a, b) AS (SELECT src, dst FROM edges UNION SELECT r.a, e.dst FROM reach r JOIN edges e ON e.src = r.b)
SELECT r.a AS node, max(r.b) AS component FROM reach r JOIN reach q ON q.a = r.b AND q.b = r.a GROUP BY r.a""")
def graph_components(spark, sf_dir):
    return graph.components(C.nation_edges(spark, sf_dir))


@query(
    f"""WITH RECURSIVE {C.NATION_EDGES}, ends AS (SELECT min(src) AS s, max(src) AS t FROM edges), walk(node, path) AS (
  SELECT s, [s] FROM ends UNION ALL SELECT e.dst, list_append(w.path, e.dst) FROM walk w JOIN edges e ON e.src = w.node WHERE NOT list_contains(w.path, e.dst))
SELECT CAST(len(path) - 1 AS INTEGER) AS hops, array_to_string(path, '>') AS path FROM walk, ends WHERE node = t ORDER BY len(path), path LIMIT 1"""
)
def graph_path_between(spark, sf_dir):
    """From the first node of the nations' graph to its last, from both ends."""
    e = C.nation_edges(spark, sf_dir)
    ends = e.agg(F.min("src").alias("s"), F.max("src").alias("t")).first()
    return graph.shortest_path(e, ends["s"], ends["t"]).select("hops", F.array_join("path", ">").alias("path"))


@query(f"""WITH {C.PATHS}, m AS (SELECT k, replace(CASE WHEN ends_with(path, '.py') THEN left(path, length(path) - 3) ELSE path END, '/', '.') AS module FROM paths),
prefixes AS (SELECT 'src.core.f' || CAST(n_nationkey AS VARCHAR) AS prefix FROM nation UNION ALL SELECT 'docs.f' || CAST(s_suppkey * 3 AS VARCHAR) || '.' FROM supplier UNION ALL SELECT left(n_name, 3) FROM nation)
SELECT CAST(count(*) AS BIGINT) AS total_dependencies, CAST(count(*) FILTER (EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(m.module, p.prefix))) AS BIGINT) AS internal_dependencies,
  CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM prefixes p WHERE starts_with(m.module, p.prefix))) AS BIGINT) AS external_dependencies FROM m""")
def prefix_dependencies(spark, sf_dir):
    """Imports of every part's module, internal if they start with one of many prefixes."""
    modules = C.paths(spark, sf_dir).select(F.lit("main.py").alias("path"), T.module_lenient(F.col("path")).alias("module"), F.array().cast("array<string>").alias("names"), F.lit(1).alias("line"))
    nation = read(spark, sf_dir, "nation")
    prefixes = nation.select(F.concat(F.lit("src.core.f"), F.col("n_nationkey").cast("string")).alias("prefix")).unionByName(nation.select(F.left("n_name", F.lit(3)).alias("prefix")))
    prefixes = prefixes.unionByName(read(spark, sf_dir, "supplier").select(F.concat(F.lit("docs.f"), (F.col("s_suppkey") * 3).cast("string"), F.lit(".")).alias("prefix")))
    return graph.dependency_summary(graph.dependency_edges(modules, prefix=prefixes))


# --- chunks and retrieval --------------------------------------------------------------------------------------------

_UUID = """CASE WHEN TRUE THEN substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INTEGER) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) END"""


@query(
    f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents), t AS (SELECT doc_id, unnest(range((len(a) - 1) // 5 + 1)) AS tile, a FROM p),
c AS (SELECT doc_id, tile, array_to_string(a[tile * 5 + 1 : tile * 5 + 5], chr(10)) AS content FROM t),
n AS (SELECT 'd' || doc_id || '.txt' AS filepath, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY tile) - 1 AS INTEGER) AS chunk_index, content FROM c WHERE {STRIP.format('content')} <> ''),
x AS (SELECT *, sha1(from_hex('6ba7b8109dad11d180b400c04fd430c8') || encode(filepath || '_' || chunk_index)) AS h FROM n)
SELECT {_UUID} AS id, filepath, chunk_index, sha256(content) AS content_sha FROM x"""
)
def chunk_lines(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.format_string("d%d.txt", "doc_id").alias("file"), "text")
    return chunks.chunk_lines(d, "file", "text", 5).select("id", "filepath", "chunk_index", F.sha2("content", 256).alias("content_sha"))


@query(values_sql("filepath, chunk_index, first_line, n_lines", [
    ("pkg/b.py", 0, "import json", 5), ("pkg/b.py", 1, "def run(a, b=1):", 7), ("pkg/b.py", 2, "def stop():", 4), ("pkg/b.py", 3, "class _low(B, pkg.Other):", 2),
]))
def chunk_python_ast(spark, sf_dir):
    c = chunks.chunk_python(C.snippets(spark).where("path = 'pkg/b.py'"), "path", "code")
    return c.select("filepath", "chunk_index", F.substring_index("content", "\n", 1).alias("first_line"), F.size(F.split("content", "\n")).alias("n_lines"))


@query()
def mock_embedding(spark, sf_dir):
    d = read(spark, sf_dir, "benchmark").select("item_id", "text")
    return chunks.embed(d, "text").select("item_id", F.size("embedding").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x), 4).alias("total"))


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / (sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[]))) * sqrt(list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])))), 6)"
_VEC = f"vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM embeddings a, embeddings b))"


def _vec(spark, sf_dir, k, asked=None):
    """The k nearest vectors of every vector, or of those asked for."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    q = (e if asked is None else e.join(asked, "vec_id", "left_semi")).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))
    return retrieval.vector_topk(e, q, k, "vec_id")


@query(f"WITH {_VEC} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM vec WHERE rank <= 5")
def vector_topk(spark, sf_dir):
    return _vec(spark, sf_dir, 5)


_BM25 = r"""tok AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS w FROM documents),
size AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM tok), tf AS (SELECT id, len(w) AS dl, unnest(w) AS term FROM tok), tfs AS (SELECT id, dl, term, count(*) AS tf FROM tf GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tfs GROUP BY term),
q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY ALL),
bm AS (SELECT q.query_id, t.id, round(sum(q.qtf * ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1) * (tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)))), 6) AS score
  FROM q JOIN tfs t USING (term) JOIN df USING (term), size GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM bm WHERE score > 0)"""


def _items(spark, sf_dir):
    """Every benchmark item as a query."""
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _index(spark, sf_dir, items):
    """The inverted index of all documents for the words of these queries."""
    return keyword.build(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", keyword.asked_terms(items))


@query(f"WITH {_BM25} SELECT query_id, id, score, CAST(rank AS INTEGER) AS rank FROM bmr WHERE rank <= 5")
def bm25_topk(spark, sf_dir):
    items = _items(spark, sf_dir)
    return keyword.search(_index(spark, sf_dir, items), items, 5)


@query(f"WITH {_BM25} SELECT query_id, CAST(count(*) AS BIGINT) AS hits, max(score) AS best FROM bmr GROUP BY query_id")
def bm25_scores(spark, sf_dir):
    scored = retrieval.bm25(read(spark, sf_dir, "documents").select("doc_id", "text"), _items(spark, sf_dir), "doc_id", "text")
    return scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.max("score").alias("best"))


_FUSED = f"""{_VEC}, {_BM25},
f AS (SELECT coalesce(v.query_id, b.query_id) AS query_id, coalesce(v.id, b.id) AS id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0), 9) AS raw,
  'hybrid_' || concat_ws('+', CASE WHEN v.id IS NOT NULL THEN 'vector' END, CASE WHEN b.id IS NOT NULL THEN 'bm25' END) AS retrieval_method
  FROM (SELECT * FROM vec WHERE rank <= 15 AND query_id IN (SELECT item_id FROM benchmark)) v FULL OUTER JOIN bmr b ON v.query_id = b.query_id AND v.id = b.id),
fs AS (SELECT query_id, id, round(least(raw / (2.0::DOUBLE / 61), 1.0::DOUBLE), 4) AS score, retrieval_method FROM f),
fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fs)"""


@query(f"WITH {_FUSED} SELECT query_id, id, score, retrieval_method, CAST(rank AS INTEGER) AS rank FROM fr WHERE rank <= 5")
def hybrid_rrf(spark, sf_dir):
    return _fused(spark, sf_dir)


def _fused(spark, sf_dir):
    """Every benchmark item as a query; its vector, where there is one, is the one of the same id."""
    items = _items(spark, sf_dir)
    near = cut(_vec(spark, sf_dir, 15, items.select(F.col("query_id").alias("vec_id"))))
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    return retrieval.fuse(near, keyword_scan.ranks_of(documents, items, near, retrieval.keyword_depth(5), "doc_id", "text"), 5)


@query(
    f"""WITH {_FUSED}, top AS (SELECT * FROM fr WHERE rank <= 5), g(src, dst) AS (SELECT 's' || k, 's' || ((k * 3 + 1) % 20) FROM (SELECT unnest(range(20)) AS k)),
m AS (SELECT doc_id AS id, replace(source, 'src', 's') AS module FROM documents),
near AS (SELECT DISTINCT src AS module, dst AS near, 0 AS side FROM g UNION SELECT dst, src, 1 FROM g),
x AS (SELECT t.query_id, t.rank AS parent, t.score, n.side, n.near, m2.id FROM top t JOIN m ON m.id = t.id JOIN near n ON n.module = m.module JOIN m m2 ON m2.module = n.near
  WHERE NOT EXISTS (SELECT 1 FROM top o WHERE o.query_id = t.query_id AND o.id = m2.id)),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY parent, side, near) AS nth FROM x),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY parent, side, near, id) AS place FROM o WHERE nth = 1)
SELECT query_id, id, score, retrieval_method, CAST(rank AS INTEGER) AS rank FROM top
UNION ALL SELECT query_id, id, round(score * 0.8::DOUBLE, 4), 'graph_expansion', CAST(place + 5 AS INTEGER) FROM a WHERE place <= 2"""
)
def hybrid_graph_expansion(spark, sf_dir):
    files = read(spark, sf_dir, "documents").select("doc_id", F.replace("source", F.lit("src"), F.lit("s")).alias("filepath"))
    k = F.col("id")
    edges = spark.range(20).select(F.concat(F.lit("s"), k.cast("string")).alias("src"), F.concat(F.lit("s"), ((k * 3 + 1) % 20).cast("string")).alias("dst"))
    return retrieval.expand(_fused(spark, sf_dir), files, edges, 5, "doc_id")


# Names that the queries over whole tables had beside those that asked a part of them.
for _name in ("vector_topk", "bm25_topk", "bm25_scores", "hybrid_rrf", "hybrid_graph_expansion"):
    QUERIES[f"{_name}_all"], ORACLES[f"{_name}_all"] = QUERIES[_name], ORACLES[_name]


@query(f"""WITH {_BM25}, t AS (SELECT query_id, min(score) AS kth FROM bmr WHERE rank <= 5 GROUP BY query_id)
SELECT CAST((SELECT count(*) FROM bm) AS BIGINT) AS pairs, TRUE AS under_half, CAST(count(*) AS BIGINT) AS hits, round(sum(kth), 3) AS floors FROM t""")
def bm25_work(spark, sf_dir):
    """How much of all pairs of a query and a document with one of its words the search for the best looks at."""
    items = _items(spark, sf_dir)
    index, log = _index(spark, sf_dir, items), StageLog(spark)
    found = cut(keyword.search(index, items, 5, log))
    pairs = keyword.asked_terms(items).join(index.postings, "term").select("query_id", "id").distinct().agg(F.count(F.lit(1)).alias("pairs"))
    kth = found.groupBy("query_id").agg(F.min("score").alias("kth")).agg(F.count(F.lit(1)).alias("hits"), F.round(F.sum("kth"), 3).alias("floors"))
    return pairs.join(F.broadcast(kth), F.lit(True)).select("pairs", (F.lit(log.values()["pairs"]["rows"]) * 2 < F.col("pairs")).alias("under_half"), "hits", "floors")  # one row each


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0")
def vector_upsert(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return chunks.upsert(e, e.where("id % 3 = 0").withColumn("label", F.col("label") + 100))


# --- reviews ---------------------------------------------------------------------------------------------------------

_PERF_WHEN = " ".join(f"WHEN regexp_matches(line, {literal(p)}) THEN {literal(n)}" for n, p in rules.PERFORMANCE_RULES)
_META = "(bare = '' OR starts_with(bare, '---') OR starts_with(bare, '+++') OR starts_with(bare, '@@') OR starts_with(bare, '#'))"
_LINES = f"l AS (SELECT pr_id, unnest(range(len(a))) AS pos, unnest(a) AS line FROM (SELECT pr_id, string_split(diff, chr(10)) AS a FROM diffs)), lb AS (SELECT *, {STRIP.format('line')} AS bare FROM l)"
_PERF = f"""perf AS (SELECT pr_id, count(CASE WHEN NOT {_META} THEN CASE {_PERF_WHEN} END END) AS issue_count,
  count(*) FILTER (regexp_matches(line, '\\b(for|while)\\b')) AS loops, coalesce(bool_or(regexp_matches(line, '\\bfor\\b.*\\bfor\\b')), FALSE) AS nested, coalesce(bool_or(contains(line, 'read()')), FALSE) AS reads FROM lb GROUP BY pr_id)"""
_TIME = "CASE WHEN loops > 3 OR nested THEN 'O(N²)' WHEN loops > 1 THEN 'O(N log N)' ELSE 'O(N)' END"


@query(f"WITH {C.DIFFS}, {_LINES}, {_PERF} SELECT pr_id, CAST(issue_count AS INTEGER) AS issue_count, {_TIME} AS time_complexity, CASE WHEN reads THEN 'REVIEW' ELSE 'OPTIMAL' END AS memory_usage, CASE WHEN issue_count > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM perf")
def perf_agent(spark, sf_dir):
    p = C.diffs(spark, sf_dir).select("pr_id", review.performance(F.col("diff")).alias("p"))
    return p.select("pr_id", "p.issue_count", "p.time_complexity", "p.memory_usage", "p.verdict")


@query(f"WITH {C.DIFFS}, {_LINES}, i AS (SELECT pr_id, pos, CASE WHEN NOT {_META} THEN CASE {_PERF_WHEN} END END AS issue, bare FROM lb) SELECT pr_id, CAST(pos + 1 AS INTEGER) AS line, issue, substr(bare, 1, 120) AS evidence FROM i WHERE issue IS NOT NULL")
def perf_issues(spark, sf_dir):
    p = C.diffs(spark, sf_dir).select("pr_id", F.explode(review.performance(F.col("diff"))["issues"]).alias("i"))
    return p.select("pr_id", "i.line", "i.issue", "i.evidence")


@query(f"WITH diffs AS (SELECT conv_id * 1000 + turn AS pr_id, text AS diff FROM conversations), {_LINES}, {_PERF} SELECT {_TIME} AS time_complexity, CAST(count(*) AS BIGINT) AS turns FROM perf GROUP BY 1")
def loop_complexity(spark, sf_dir):
    p = read(spark, sf_dir, "conversations").select(review.performance(F.col("text"))["time_complexity"].alias("time_complexity"))
    return p.groupBy("time_complexity").agg(F.count(F.lit(1)).alias("turns"))


_DEFS = f"""defs AS (SELECT pr_id, pos, CASE
  WHEN regexp_matches(line, {literal(review.PYTHON_DEF)}) THEN regexp_extract(line, {literal(review.PYTHON_DEF)}, 2)
  WHEN regexp_matches(line, {literal(review.JS_FUNCTION)}) THEN regexp_extract(line, {literal(review.JS_FUNCTION)}, 1)
  WHEN regexp_matches(line, {literal(review.JS_ARROW)}) THEN regexp_extract(line, {literal(review.JS_ARROW)}, 1) END AS name FROM lb WHERE NOT {_META} AND NOT starts_with(bare, '//')),
firsts AS (SELECT pr_id, name, min(pos) AS pos FROM defs WHERE name IS NOT NULL AND NOT starts_with(name, '__') GROUP BY pr_id, name)"""


@query(f"WITH {C.DIFFS}, {_LINES}, {_DEFS} SELECT pr_id, name FROM firsts")
def testing_agent_defs(spark, sf_dir):
    t = C.diffs(spark, sf_dir).select("pr_id", F.explode(review.testing(F.col("diff"))["functions_found"]).alias("f"))
    return t.select("pr_id", "f.name")


@query(values_sql("pr_id, functions, params, stubs, first_line", [(1, "load|kept", "path,limit|a,int]", 2, "import pytest"), (2, "", "", 0, "# The diff defines no functions.")]))
def testing_stub_render(spark, sf_dir):
    d = spark.createDataFrame([(1, "+def load(path: str, limit=10):\n def kept(self, a: Dict[str, int]):\n-def gone(x):"), (2, "")], "pr_id int, diff string")
    t = d.select("pr_id", review.testing(F.col("diff")).alias("t"))
    join = lambda f: F.array_join(F.transform("t.functions_found", f), "|")
    return t.select("pr_id", join(lambda x: x["name"]).alias("functions"), join(lambda x: F.array_join(x["params"], ",")).alias("params"), F.col("t.stub_count").alias("stubs"), F.substring_index("t.generated_tests", "\n", 1).alias("first_line"))


# Parameters as a plain split at commas gives them, of the lines that define something.
_PARAMS = {"+def load(path: str, limit=10):": "path, limit", " def kept(self, a, b: Dict[str, int]):": "a, b, int]", "+async def fetch(url):": "url"}


@query(
    f"""WITH {C.DIFFS}, {_LINES}, {_DEFS}, known(line, params) AS (VALUES {', '.join(f"({literal(k)}, {literal(v)})" for k, v in _PARAMS.items())}),
stubs AS (SELECT f.pr_id, f.pos, 'def test_' || f.name || '():' || chr(10) || CASE WHEN params IS NULL THEN '' ELSE '    # for example: ' || f.name || '(' || params || ')' || chr(10) END || '    # arrange, call, compare' || chr(10) || '    assert True' || chr(10) AS stub
  FROM firsts f JOIN lb ON lb.pr_id = f.pr_id AND lb.pos = f.pos LEFT JOIN known ON known.line = lb.line)
SELECT d.pr_id, CAST(count(stub) AS INTEGER) AS stub_count, CASE WHEN count(stub) = 0 THEN '# The diff defines no functions.' || chr(10) || '# Test changed logic by hand.' || chr(10)
  ELSE 'import pytest' || chr(10) || chr(10) || chr(10) || string_agg(stub, chr(10) || chr(10) ORDER BY pos) END AS generated_tests FROM diffs d LEFT JOIN stubs s ON s.pr_id = d.pr_id GROUP BY d.pr_id"""
)
def testing_stubs(spark, sf_dir):
    """The whole text of the stubs of every diff."""
    return C.diffs(spark, sf_dir).select("pr_id", review.testing(F.col("diff")).alias("t")).select("pr_id", "t.stub_count", "t.generated_tests")


@query(
    f"""WITH {C.DIFFS}, {_LINES}, {_PERF}, {_DEFS}, src AS (SELECT pr_id AS file, pos, line FROM l), {findings_sql('src')},
s AS (SELECT file AS pr_id, count(*) AS n, max(4 - sev_order) AS worst FROM findings GROUP BY file), t AS (SELECT pr_id, count(*) AS stubs FROM firsts GROUP BY pr_id),
r AS (SELECT p.pr_id, coalesce(s.n, 0) AS finding_count, coalesce(worst, 0) AS worst, greatest(CASE WHEN coalesce(worst, 0) <= 1 THEN 1 ELSE worst END, 2, CASE WHEN issue_count > 0 THEN 1 ELSE 0 END) AS risk, coalesce(stubs, 0) AS stubs
  FROM perf p LEFT JOIN s USING (pr_id) LEFT JOIN t USING (pr_id))
SELECT pr_id, CAST(finding_count AS INTEGER) AS finding_count, CAST(stubs AS INTEGER) AS stub_count, (['LOW', 'MEDIUM', 'HIGH', 'CRITICAL'])[risk] AS risk_score,
  CASE WHEN worst >= 3 THEN 'BLOCKED' ELSE 'CHANGES_REQUESTED' END AS overall_status FROM r"""
)
def review_verdicts(spark, sf_dir):
    r = review.review(C.diffs(spark, sf_dir))
    return r.select("pr_id", F.col("security.finding_count").alias("finding_count"), F.col("testing.stub_count").alias("stub_count"), "risk_score", "overall_status")


_METRICS = " UNION ALL ".join(
    f"SELECT {literal(stage)} AS stage, {literal(metric)} AS metric, CAST(coalesce({value}, 0) AS BIGINT) AS value FROM v"
    for stage, metric, value in [
        *[(stage, "rows", "count(*)") for stage in ("diffs", "security", "architecture", "performance", "testing", "reviews")],
        ("diffs", "characters", "sum(characters)"), ("security", "findings", "sum(finding_count)"), ("performance", "issues", "sum(issue_count)"), ("testing", "stubs", "sum(stubs)"),
        ("security", "status=PASS", "count(*) FILTER (worst < 3)"), ("security", "status=FAIL", "count(*) FILTER (worst >= 3)"),
        *[("security", f"risk_score={r}", f"count(*) FILTER (greatest(worst, 1) = {i})") for i, r in enumerate(review.RISKS, 1)],
        *[("architecture", f"verdict={x}", "count(*)" if x == "POOR" else "0 * count(*)") for x in ("EXCELLENT", "GOOD", "WARN", "POOR")],
        *[("performance", f"time_complexity={x}", f"count(*) FILTER (complexity = {literal(x)})") for x in ("O(N)", "O(N log N)", "O(N²)")],
        *[("reviews", f"risk_score={r}", f"count(*) FILTER (risk = {i})") for i, r in enumerate(review.RISKS, 1)],
        ("reviews", "overall_status=APPROVED", "count(*) FILTER (risk = 1)"), ("reviews", "overall_status=CHANGES_REQUESTED", "count(*) FILTER (worst < 3 AND risk > 1)"), ("reviews", "overall_status=BLOCKED", "count(*) FILTER (worst >= 3)"),
    ]
)


@query(
    f"""WITH {C.DIFFS}, {_LINES}, {_PERF}, {_DEFS}, src AS (SELECT pr_id AS file, pos, line FROM l), {findings_sql('src')},
s AS (SELECT file AS pr_id, count(*) AS n, max(4 - sev_order) AS worst FROM findings GROUP BY file), t AS (SELECT pr_id, count(*) AS stubs FROM firsts GROUP BY pr_id),
v AS (SELECT length(diff) AS characters, coalesce(s.n, 0) AS finding_count, coalesce(worst, 0) AS worst, issue_count, {_TIME} AS complexity, coalesce(stubs, 0) AS stubs, greatest(coalesce(worst, 0), 2) AS risk
  FROM perf p JOIN diffs USING (pr_id) LEFT JOIN s USING (pr_id) LEFT JOIN t USING (pr_id))
{_METRICS}"""
)
def review_stage_log(spark, sf_dir):
    """What the log of a review counts while the reviews are computed."""
    log = StageLog(spark)
    review.review(C.diffs(spark, sf_dir), log=log).write.format("noop").mode("overwrite").save()
    return log.rows().select("stage", "metric", "value")


# --- events ----------------------------------------------------------------------------------------------------------


@query("""WITH e AS (SELECT event_id, event_type, CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 4 WHEN 0 THEN 'opened' WHEN 1 THEN 'synchronize' WHEN 2 THEN 'closed' ELSE 'reopened' END AS action FROM events)
SELECT action, CAST(count(*) AS BIGINT) AS wanted FROM e WHERE event_type = (SELECT min(event_type) FROM events) AND action IN ('opened', 'synchronize', 'reopened') GROUP BY action""")
def webhook_filter(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("int") % 4
    events = read(spark, sf_dir, "events").select("event_type", F.get(F.array(*map(F.lit, ("opened", "synchronize", "closed", "reopened"))), k).alias("action"))
    kind = F.when(F.col("event_type") == F.lit(events.agg(F.min("event_type")).first()[0]), "pull_request").otherwise("other")
    return events.where(webhook.wanted(kind, F.col("action"), F.lit("url"))).groupBy("action").agg(F.count(F.lit(1)).alias("wanted"))


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS window_start, event_type, CAST(count(*) AS BIGINT) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark, sf_dir):
    w = webhook.tumbling(read(spark, sf_dir, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "events", F.round("total", 4).alias("total"))
