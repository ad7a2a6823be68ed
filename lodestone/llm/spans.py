"""Spans in texts as native columns: matches with code-point positions, digests, masking."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<kind:int,start:int,end:int,text:string>>"


def let(value: Column, body) -> Column:
    """body(value), with the value computed once however often the body names it (also from inside its lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(sizes: Column) -> Column:
    """Sums of all before each entry of an int array, in blocks of about the root of its length, so that no array is
    copied more often than that."""
    none = F.array().cast("array<int>")

    def inside(part: Column, at: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(at.cast("int").alias("at"), none.alias("out")),
            lambda acc, x: F.struct((acc["at"] + x).cast("int").alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
        )["out"]

    def whole(all_: Column) -> Column:
        block = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_)))).cast("int")
        blocks = let(block, lambda n: F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / n).cast("int")), lambda i: F.slice(all_, i * n + 1, n)))
        return F.aggregate(
            blocks,
            F.struct(F.lit(0).cast("int").alias("at"), F.array().cast("array<array<int>>").alias("out")),
            lambda acc, part: F.struct(
                F.aggregate(part, acc["at"], lambda a, x: (a + x).cast("int")).alias("at"),
                F.concat(acc["out"], F.array(inside(part, acc["at"]))).alias("out"),
            ),
        )["out"]

    return let(sizes, lambda all_: F.when(F.size(all_) > 0, F.flatten(whole(all_))).otherwise(none))


def starts_of(gaps: Column, lengths: Column) -> Column:
    """Code-point starts of matches of these lengths, from the lengths of the text before each one."""
    before = running(F.zip_with(gaps, lengths, lambda g, n: (g + n).cast("int")))
    return F.zip_with(before, gaps, lambda at, g: (at + g).cast("int"))


def spans_of(kind: int, pieces: Column, matches: Column) -> Column:
    """SPAN array of all matches (regexp_extract_all), with the pieces of text between them (split with limit -1)."""
    gaps = F.transform(F.slice(pieces, 1, F.size(matches)), lambda x: F.length(x))
    made = F.zip_with(
        matches,
        starts_of(gaps, F.transform(matches, lambda x: F.length(x))),
        lambda m, s: F.struct(F.lit(kind).alias("kind"), s.alias("start"), (s + F.length(m)).cast("int").alias("end"), m.alias("text")),
    )
    return F.when(F.size(matches) > 0, made).otherwise(F.array().cast(SPAN))


def shown(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in kinds])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def by_start(spans: Column) -> Column:
    """Ordered by start, then kind."""
    order = F.transform(spans, lambda x: F.struct(x["start"], x["kind"], x["end"], x["text"]))
    return F.transform(F.array_sort(order), lambda x: F.struct(x["kind"], x["start"], x["end"], x["text"]))


def masked(text: Column, spans: Column, label) -> Column:
    """The text with each span replaced by label(span). Of a span that begins inside the one before it, only what
    reaches beyond that is replaced."""

    def cut(ordered: Column) -> Column:
        parts = F.transform(
            ordered,
            lambda x, i: let(
                F.coalesce(F.get(ordered, i - 1)["end"], F.lit(0)),
                lambda was: F.concat(F.substring(text, was + 1, F.greatest(F.lit(0), x["start"] - was)), F.when(x["end"] > was, label(x)).otherwise(F.lit(""))),
            ),
        )
        rest = F.substring(text, F.element_at(ordered, -1)["end"] + 1, F.lit(2**31 - 1))
        return F.concat(F.array_join(parts, ""), rest)

    return F.when(F.size(spans) > 0, let(F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))), cut)).otherwise(text)


def upper_tail(z: Column) -> Column:
    """P(Z >= z) of the standard normal for z >= 0 (Abramowitz and Stegun 26.2.17, fixed values)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) * 0.3989422804014327 * poly


def p_above(z: Column) -> Column:
    return F.when(z >= 0, upper_tail(F.abs(z))).otherwise(1 - upper_tail(F.abs(z)))
