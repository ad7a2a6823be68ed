"""Reviews of diffs: one row per diff in, one row out. The lines stay in arrays, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.stage_log import StageLog, tally
from lodestone.functions.text import choice, let, lines, split_lines, strip
from lodestone.operators import graph
from lodestone.operators.rules import ISSUES, PERFORMANCE_RULES, SUGGESTIONS, folded, found, rank
from lodestone.operators.security import hits, is_code

# How definitions look in a diff, as name pattern and its group.
PYTHON_DEF = r"^\+?\s*(async\s+)?def\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\(([^)]*)\)"
JS_FUNCTION = r"^\+?\s*(?:export\s+)?(?:async\s+)?function\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*\("
JS_ARROW = r"^\+?\s*(?:const|let|var)\s+([a-zA-Z_][a-zA-Z0-9_]*)\s*=\s*(?:async\s+)?\("
META = ("---", "+++", "@@", "#")


def _starts(c: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(c, F.lit(p))
    return out


RECOMMENDATIONS = {"PASS": "Nothing grave was found. Keep secrets out of the source.", "FAIL": "Grave findings: mend them before merging, as each one suggests."}


def security(diff: Column) -> Column:
    """Struct: findings (line, rule, type, severity, description, fix_suggestion, evidence), finding_count, status,
    risk_score, recommendation."""

    def of_line(text: Column, i: Column) -> Column:
        made = lambda bare: F.when(
            is_code(bare),
            F.transform(let(folded(text), lambda fold: hits(text, fold)), lambda h: F.struct((i + 1).alias("line"), *[h[c].alias(c) for c in ("rule", "type", "severity", "description", "cwe", "fix_suggestion")], F.substring(bare, 1, 120).alias("evidence"))),
        )
        return let(strip(text), made)

    def judged(findings: Column) -> Column:
        worst = F.coalesce(F.array_max(F.transform(findings, lambda f: rank(f["severity"]))), F.lit(0))
        return let(worst, lambda w: F.struct(
            findings.alias("findings"), F.size(findings).alias("finding_count"), F.when(w >= 3, "FAIL").otherwise("PASS").alias("status"),
            F.get(F.array(*map(F.lit, ("LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"))), w).alias("risk_score"),
            F.when(w >= 3, RECOMMENDATIONS["FAIL"]).otherwise(RECOMMENDATIONS["PASS"]).alias("recommendation"),
        ))

    return let(F.flatten(F.filter(F.transform(lines(diff), of_line), lambda x: x.isNotNull())), judged)


def performance(diff: Column) -> Column:
    """Struct: issues (line, issue, description, suggestion, evidence), issue_count, suggestions, time_complexity,
    memory_usage, verdict."""

    def issue(text: Column, bare: Column) -> Column:
        name = F.lit(None).cast("string")
        for label, pattern in reversed(PERFORMANCE_RULES):
            name = F.when(found(text, pattern), label).otherwise(name)
        return F.when((bare != "") & ~_starts(bare, META), name)

    def of_line(text: Column, i: Column) -> Column:
        return let(strip(text), lambda bare: let(issue(text, bare), lambda name: F.struct(
            (i + 1).alias("line"), name.alias("issue"), choice(ISSUES, name).alias("description"), choice(SUGGESTIONS, name).alias("suggestion"), F.substring(bare, 1, 120).alias("evidence"),
        )))

    def judged(rows: Column, issues: Column) -> Column:
        loops = F.size(F.filter(rows, lambda t: found(t, r"\b(for|while)\b")))
        nested = F.exists(rows, lambda t: found(t, r"\bfor\b.*\bfor\b"))
        return let(loops, lambda n: F.struct(
            issues.alias("issues"), F.size(issues).alias("issue_count"),
            F.array_sort(F.array_distinct(F.transform(issues, lambda x: x["suggestion"]))).alias("suggestions"),
            F.when((n > 3) | nested, "O(N²)").when(n > 1, "O(N log N)").otherwise("O(N)").alias("time_complexity"),
            F.when(F.exists(rows, lambda t: F.contains(t, F.lit("read()"))), "REVIEW").otherwise("OPTIMAL").alias("memory_usage"),
            F.when(F.size(issues) > 0, "WARN").otherwise("PASS").alias("verdict"),
        ))

    return let(split_lines(diff), lambda rows: let(F.filter(F.transform(rows, of_line), lambda x: x["issue"].isNotNull()), lambda issues: judged(rows, issues)))


def _params(raw: Column) -> Column:
    names = F.transform(F.split(raw, ","), lambda p: strip(F.split_part(F.split_part(p, F.lit(":"), F.lit(1)), F.lit("="), F.lit(1))))
    return F.filter(names, lambda n: (n != "self") & n.rlike("^[a-zA-Z_]"))


def testing(diff: Column) -> Column:
    """Struct: functions_found (name, params; the first definition of a name), stub_count, generated_tests."""

    def definition(text: Column) -> Column:
        py = f"(?U){PYTHON_DEF}"
        return (
            F.when((strip(text) == "") | _starts(strip(text), (*META, "//")), None)
            .when(text.rlike(py), F.struct(F.regexp_extract(text, py, 2).alias("name"), _params(F.regexp_extract(text, py, 3)).alias("params")))
            .when(text.rlike(f"(?U){JS_FUNCTION}"), F.struct(F.regexp_extract(text, f"(?U){JS_FUNCTION}", 1).alias("name"), F.array().cast("array<string>").alias("params")))
            .when(text.rlike(f"(?U){JS_ARROW}"), F.struct(F.regexp_extract(text, f"(?U){JS_ARROW}", 1).alias("name"), F.array().cast("array<string>").alias("params")))
        )

    def firsts(all_: Column) -> Column:
        return F.transform(F.array_distinct(F.transform(all_, lambda d: d["name"])), lambda n: F.get(F.filter(all_, lambda d: d["name"] == n), F.lit(0)))

    all_ = F.filter(F.transform(split_lines(diff), definition), lambda d: d.isNotNull() & ~F.startswith(d["name"], F.lit("__")))
    return let(let(all_, firsts), lambda f: F.struct(f.alias("functions_found"), F.size(f).alias("stub_count"), render_tests(f).alias("generated_tests")))


def render_tests(functions: Column) -> Column:
    """A module of test stubs for functions (name, params)."""

    def stub(f: Column) -> Column:
        call = F.array_join(f["params"], ", ")
        sample = F.when(call != "", F.concat(F.lit("    # for example: "), f["name"], F.lit("("), call, F.lit(")\n"))).otherwise("")
        return F.concat(F.lit("def test_"), f["name"], F.lit("():\n"), sample, F.lit("    # arrange, call, compare\n    assert True\n"))

    body = F.array_join(F.transform(functions, stub), "\n\n")
    return F.when(F.size(functions) > 0, F.concat(F.lit("import pytest\n\n\n"), body)).otherwise(F.lit("# The diff defines no functions.\n# Test changed logic by hand.\n"))


def overall(security_: Column, verdict: Column, performance_: Column) -> tuple[Column, Column]:
    """(risk_score, overall_status) of a diff."""
    arch = F.coalesce(choice({"EXCELLENT": 0, "GOOD": 0, "WARN": 1, "POOR": 2}, verdict), F.lit(0))
    perf = F.when(performance_["verdict"] == "WARN", 1).otherwise(0)
    worst = F.greatest(rank(security_["risk_score"]), arch, perf)
    risk = F.get(F.array(*map(F.lit, ("LOW", "LOW", "MEDIUM", "HIGH", "CRITICAL"))), worst)
    status = F.when((security_["status"] == "FAIL") & risk.isin("CRITICAL", "HIGH"), "BLOCKED").when(risk != "LOW", "CHANGES_REQUESTED").otherwise("APPROVED")
    return risk, status


RISKS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")


def logged(log: StageLog, rows: DataFrame) -> DataFrame:
    """A review's rows, whose stages a log counts as they pass: diffs and lengths, findings and verdicts of each agent."""
    of = lambda c, values: tally(F.col(c), list(values), c.split(".")[-1])
    stages = {
        "diffs": {"characters": F.sum(F.length(F.col("diff_text")))},
        "security": {"findings": F.sum("security.finding_count")} | of("security.status", ("PASS", "FAIL")) | of("security.risk_score", RISKS),
        "architecture": of("architecture.verdict", ("EXCELLENT", "GOOD", "WARN", "POOR")),
        "performance": {"issues": F.sum("performance.issue_count")} | of("performance.time_complexity", ("O(N)", "O(N log N)", "O(N²)")),
        "testing": {"stubs": F.sum("testing.stub_count")},
        "reviews": of("overall_status", ("APPROVED", "CHANGES_REQUESTED", "BLOCKED")) | of("risk_score", RISKS),
    }
    for name, metrics in stages.items():
        rows = log.stage(name, rows, **metrics)
    return rows


def review(diffs: DataFrame, diff: str = "diff", edges: DataFrame | None = None, log: StageLog | None = None) -> DataFrame:
    """Adds to each diff: security, architecture, performance, testing, risk_score, overall_status, checklist,
    pr_summary, status. A null diff is an empty one. Without a graph the architecture is that of an empty one. A log
    counts the stages while the result is computed, without another pass over it."""
    spark = diffs.sparkSession
    counted = graph.counts(edges) if edges is not None else spark.range(1).select(F.lit(0).cast("long").alias("nodes"), F.lit(0).cast("long").alias("edges"))
    arch = graph.architecture(counted).select(F.struct("nodes", "edges", "architecture_pattern", "cohesion_score", "coupling_ratio", "coupling_issue_detected", "verdict").alias("architecture"))
    text = F.coalesce(F.col(diff), F.lit(""))
    rows = diffs.join(F.broadcast(arch), F.lit(True)).withColumns({"security": security(text), "performance": performance(text), "testing": testing(text)})  # arch is one row
    risk, status = overall(F.col("security"), F.col("architecture.verdict"), F.col("performance"))
    rows = rows.withColumns({"risk_score": risk, "overall_status": status, "status": F.lit("completed")})
    passed = lambda ok: F.when(ok, "pass").otherwise("check")
    checklist = F.array(
        F.format_string("[%s] security: %s, %d finding(s)", passed(F.col("security.status") == "PASS"), F.col("security.status"), F.col("security.finding_count")),
        F.format_string("[%s] architecture: %s", passed(F.col("architecture.verdict").isin("EXCELLENT", "GOOD")), F.col("architecture.verdict")),
        F.format_string("[%s] performance: %s, %s", passed(F.col("performance.verdict") == "PASS"), F.col("performance.time_complexity"), F.col("performance.verdict")),
        F.format_string("[note] testing: %d stub(s)", F.col("testing.stub_count")),
    )
    summary = F.format_string("%s, risk %s: %d security finding(s), %s, %d test stub(s)", "overall_status", "risk_score", F.col("security.finding_count"), F.col("performance.time_complexity"), F.col("testing.stub_count"))
    rows = rows.withColumns({"checklist": checklist, "pr_summary": summary})
    return rows if log is None else logged(log, rows.withColumn("diff_text", text)).drop("diff_text")
