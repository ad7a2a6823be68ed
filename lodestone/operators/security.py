"""Security findings by line, and their roll-ups."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import choice, let, lines, strip
from lodestone.operators.rules import DEDUCTIONS, SECURITY_RULES, SEVERITY_ORDER, breaks, folded


def hits(line: Column, fold: Column, only: Collection[int] | None = None) -> Column:
    """The rules that a line (also given folded) breaks, of all or `only` those of these numbers, as an array of structs
    in rule order. All patterns are tried in one pass, without a join with the rules."""
    return F.array_compact(
        F.array(
            *[
                F.when(
                    breaks(r, line, fold),
                    F.struct(
                        F.lit(i).alias("rule"), F.lit(r.type).alias("type"), F.lit(r.severity).alias("severity"), F.lit("security").alias("category"),
                        F.lit(r.says).alias("description"), F.lit(r.cwe).alias("cwe"), F.lit(r.fix).cast("string").alias("fix_suggestion"),
                    ),
                )
                for i, r in enumerate(SECURITY_RULES)
                if only is None or i in only
            ]
        )
    )


def is_code(stripped: Column) -> Column:
    """Neither blank nor a comment."""
    return (stripped != "") & ~F.startswith(stripped, F.lit("#")) & ~F.startswith(stripped, F.lit("//"))


def findings(files: DataFrame, file: str, code: str, only: Collection[int] | None = None) -> DataFrame:
    """One row per (line, rule): the file column, line, rule, type, severity, category, description, cwe, fix_suggestion,
    evidence, severity_order. Their order in a report is severity_order, line, rule. `only` names the rules to try."""
    rows = files.select(file, F.posexplode(lines(F.col(code))).alias("pos", "text"))
    # outer: an inner explode would make the optimizer test each line's hits in a filter of its own, and compute them twice
    broken = rows.select(file, "pos", "text", F.explode_outer(let(folded(F.col("text")), lambda fold: hits(F.col("text"), fold, only))).alias("hit")).where("hit IS NOT NULL")
    return (
        broken.withColumn("bare", strip(F.col("text"))).where(is_code(F.col("bare")))
        .select(file, (F.col("pos") + 1).alias("line"), "hit.*", F.substring("bare", 1, 120).alias("evidence"))
        .withColumn("severity_order", F.coalesce(choice(SEVERITY_ORDER, F.col("severity")), F.lit(5)))
    )


def unreadable(files: DataFrame, file: str, error: str = "error") -> DataFrame:
    """One low finding at line 0 for each file that could not be read."""
    return files.where(F.col(error).isNotNull()).select(
        file, F.lit(0).alias("line"), F.lit("FileReadError").alias("type"), F.lit("LOW").alias("severity"), F.lit("security").alias("category"), F.lit("The file could not be read.").alias("description"),
        F.lit(None).cast("string").alias("cwe"), F.lit(None).cast("string").alias("fix_suggestion"), F.col(error).alias("evidence"),
    )


def deduction(severity: Column) -> Column:
    return F.coalesce(choice(DEDUCTIONS, severity), F.lit(1))


def health(files: DataFrame, found: DataFrame, file: str) -> DataFrame:
    """One row per file: total_findings, one count per severity, health_score (100 less the deductions, at least 0)."""
    per = found.groupBy(file).agg(
        F.count(F.lit(1)).alias("total_findings"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in SEVERITY_ORDER],
        F.sum(deduction(F.col("severity"))).alias("deducted"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return files.select(file).join(per, file, "left").select(
        file, zero("total_findings"), *[zero(s.lower()) for s in SEVERITY_ORDER],
        F.greatest(F.lit(0.0), F.round(F.lit(100.0) - F.coalesce("deducted", F.lit(0)), 1)).alias("health_score"),
    )


def report(files: DataFrame, found: DataFrame, file: str) -> DataFrame:
    """One row per file with the whole report on `found`, security findings, quality findings or both: counts, breakdown
    maps, the findings of each category and all of them in order, and the health score over all."""
    item = F.struct(*[c for c in ("place", "severity_order", "line", "rule", "type", "severity", "category", "description", "cwe", "fix_suggestion", "evidence")])
    placed = found.withColumn("place", F.when(F.col("category") == "security", 0).otherwise(1))
    parts = placed.groupBy(file).agg(F.array_sort(F.collect_list(item)).alias("all_findings"))
    counts = lambda c: F.map_from_entries(F.transform(F.array_distinct(F.transform("all_findings", lambda x: x[c])), lambda k: F.struct(k, F.size(F.filter("all_findings", lambda x: x[c] == k)))))
    of = lambda place: F.filter("all_findings", lambda x: x["place"] == place)
    maps = parts.select(file, "all_findings", counts("severity").alias("severity_breakdown"), counts("category").alias("category_breakdown"), of(0).alias("security_findings"), of(1).alias("quality_findings"))
    whole = health(files, found, file).join(maps, file, "left")
    empty = {c: F.coalesce(c, F.array().cast(maps.schema[c].dataType)) for c in ("all_findings", "security_findings", "quality_findings")}
    none = F.from_json(F.lit("{}"), "map<string,int>")
    return whole.withColumns(empty | {c: F.coalesce(c, none) for c in ("severity_breakdown", "category_breakdown")})
