"""Secret scans: fixed patterns, and a battery of randomness tests for other tokens. Native columns only.

A token's encoding is inferred from its characters. Three tests see whether it is uniform noise in that alphabet:
chi-squared (through its equal, the count of coinciding character pairs), runs about the alphabet's middle, and lag-one
serial correlation. A token is a finding if none of them speaks against noise, and if its coincidences are too few for
ordinary text: that p-value goes through Benjamini-Hochberg over all tokens of the corpus of like length, so short
tokens, which cannot show much, need a corpus in which such findings are common enough."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import settle
from lodestone.llm.spans import SPAN, by_start, let, masked, p_above, shown, spans_of, upper_tail

KINDS = ["assign", "access", "hex", "random"]
# The base patterns. Letters of a keyword are matched in either case, ASCII only.
ASSIGN = r"(?=[PpSsTtAa])(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
# Alphabets by encoding, in the order in which they are inferred.
ALPHABETS = {
    "^(?:[0-9a-f]+|[0-9A-F]+)$": "0123456789abcdef",
    "^[A-Z2-7]+$": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "^[0-9a-z]+$": "0123456789abcdefghijklmnopqrstuvwxyz",
    "^[0-9A-Za-z]+$": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}
LENGTHS = [20, 24, 32, 48, 96]  # lower ends of the length classes
RATE, REJECT, ORDINARY, STEP, TOP = 0.05, 0.001, 0.066, 0.1, 400


def _battery(token: Column) -> Column:
    """(p_noise, bin) of a token: the least p-value of the three tests of noise, corrected for three, and
    -log10(p-value of ordinary text) in steps of STEP."""
    size, alphabet = F.lit(0), F.lit("")
    for pattern, letters in reversed(ALPHABETS.items()):
        fits = token.rlike(pattern) if pattern else F.lit(True)
        size, alphabet = F.when(fits, len(letters)).otherwise(size), F.when(fits, F.lit(letters)).otherwise(alphabet)
    facts = F.struct(size.cast("double").alias("a"), alphabet.alias("letters"), F.length(token).cast("double").alias("n"), F.translate(token, "-_", "+/").alias("plain"))
    return let(facts, lambda k: let(_sums(k, F.when(k["a"] == 16, F.lower(k["plain"])).otherwise(k["plain"])), lambda f: _verdict(k["a"], k["n"], f)))


def _sums(k: Column, plain: Column) -> Column:
    """Coinciding pairs, and the sums that the other two tests need, of the places of a token's characters."""
    zero = F.lit(0.0)
    chars = F.split(plain, "")
    shared = F.aggregate(
        F.transform(F.array_distinct(chars), lambda c: k["n"] - F.length(F.replace(plain, c, F.lit("")))),
        zero,
        lambda acc, m: acc + m * (m - 1) / 2,
    )
    fold = F.aggregate(
        F.transform(chars, lambda c: F.instr(k["letters"], c).cast("double")),
        F.struct(F.lit(-1.0).alias("was"), zero.alias("runs"), zero.alias("high"), zero.alias("s"), zero.alias("ss"), zero.alias("lag")),
        lambda acc, x: F.struct(
            x.alias("was"),
            (acc["runs"] + F.when((acc["was"] < 0) | ((acc["was"] > k["a"] / 2) != (x > k["a"] / 2)), 1.0).otherwise(0.0)).alias("runs"),
            (acc["high"] + F.when(x > k["a"] / 2, 1.0).otherwise(0.0)).alias("high"),
            (acc["s"] + x).alias("s"),
            (acc["ss"] + x * x).alias("ss"),
            (acc["lag"] + F.when(acc["was"] < 0, 0.0).otherwise(acc["was"] * x)).alias("lag"),
        ),
    )
    return F.struct(shared.alias("shared"), fold.alias("fold"))


def _verdict(a: Column, n: Column, sums: Column) -> Column:
    f, shared, pairs = sums["fold"], sums["shared"], n * (n - 1) / 2
    z_chi = (shared - pairs / a) / F.sqrt(pairs / a * (1 - 1 / a))
    high, low = f["high"], n - f["high"]
    mean = 2 * high * low / n + 1
    spread = (mean - 1) * (mean - 2) / (n - 1)
    z_runs = F.when(spread > 0, F.abs(f["runs"] - mean) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(F.lit(9.0))
    variance = f["ss"] / n - (f["s"] / n) * (f["s"] / n)
    corr = (f["lag"] / (n - 1) - (f["s"] / n) * (f["s"] / n)) / F.greatest(variance, F.lit(1e-9))
    z_corr = F.when(variance > 0, F.abs(corr + 1 / n) * F.sqrt(n)).otherwise(F.lit(9.0))
    p_noise = F.least(F.lit(1.0), 3 * F.least(p_above(z_chi), 2 * upper_tail(F.abs(z_runs)), 2 * upper_tail(F.abs(z_corr))))
    usual = F.greatest(F.lit(ORDINARY), 2 / a)
    z_text = (pairs * usual - shared) / F.sqrt(pairs * usual * (1 - usual))
    bins = F.floor(-F.log10(F.greatest(p_above(z_text), F.lit(1e-40))) / STEP)
    return F.struct(p_noise.alias("p_noise"), F.least(bins, F.lit(TOP)).cast("int").alias("bin"))


def _judged(documents: DataFrame, *kept: Column) -> DataFrame:
    """`kept` columns of each row, with base (spans of the fixed patterns) and tokens (span and battery results)."""
    names = [f"kept_{i}" for i in range(len(kept))]
    rows = documents.select(*[c.alias(n) for c, n in zip(kept, names)], F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    none, blank = F.array().cast(SPAN), F.array().cast("array<string>")

    def matches(pattern: str) -> Column:
        return F.regexp_extract_all("t", F.lit(pattern), F.lit(0))

    found = rows.select(
        *names, "t",
        F.when(F.contains("t", F.lit(":")) | F.contains("t", F.lit("=")), matches(ASSIGN)).otherwise(blank).alias("m_assign"),
        F.when(F.contains("t", F.lit("AKIA")), matches(ACCESS)).otherwise(blank).alias("m_access"),
        matches(HEX).alias("m_hex"),
        matches(TOKEN).alias("m_token"),
    )

    def spans(kind: int, name: str, pattern: str) -> Column:
        return F.when(F.size(name) > 0, spans_of(kind, F.split("t", pattern, -1), F.col(name))).otherwise(none)

    base = F.concat(
        F.filter(spans(0, "m_assign", ASSIGN), lambda x: F.length(F.regexp_extract(x["text"], ASSIGN, 1)) >= 6),
        spans(1, "m_access", ACCESS),
        spans(2, "m_hex", HEX),
    )
    mixed = lambda x: x.rlike("[0-9]") & x.rlike("[A-Za-z]")
    tokens = F.when(F.exists("m_token", mixed), F.filter(spans(3, "m_token", TOKEN), lambda x: mixed(x["text"]))).otherwise(none)
    held = found.select(*names, by_start(base).alias("base"), tokens.alias("tokens"))
    return held.select(*names, "base", F.transform("tokens", lambda x: F.struct(x.alias("span"), _battery(x["text"]).alias("test"))).alias("tokens"))


def _limits(judged: DataFrame, rate: float) -> list[int]:
    """The least bin of a finding for each length class."""
    size = F.col("token.span.end") - F.col("token.span.start")
    counts = judged.select(F.explode("tokens").alias("token")).groupBy(_by_length(size, range(len(LENGTHS))).alias("length_class"), F.col("token.test.bin").alias("bin")).count()
    cuts = _thresholds(counts, rate)
    return [cuts.get(i, TOP + 1) for i in range(len(LENGTHS))]


def _added(limits: list[int]) -> Column:
    good = F.filter(
        "tokens",
        lambda x: (x["test"]["bin"] >= _by_length(x["span"]["end"] - x["span"]["start"], limits))
        & (x["test"]["p_noise"] >= REJECT)
        & ~F.exists("base", lambda b: (b["start"] < x["span"]["end"]) & (x["span"]["start"] < b["end"])),
    )
    return F.transform(good, lambda x: x["span"])


def scan(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """One row per row of `documents` (doc_id, text): doc_id, base and added (arrays of kind, start, end, text).

    kind counts KINDS; positions are code points, end exclusive. base holds the fixed patterns' findings, added the
    tokens that the battery finds and that no base span touches. Null and empty texts have none; repeated rows are
    scanned as often as they come; an empty table gives no rows; other columns are not read. Tokens are judged
    against all tokens of all rows; what reaches the driver is one threshold for each of five length classes."""
    judged = settle(_judged(documents, F.col("doc_id").cast("long")), "secrets")
    return judged.select(F.col("kept_0").alias("doc_id"), "base", _added(_limits(judged, rate)).alias("added"))


def redact(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of `documents`, with all their columns, and each finding in text replaced by [SECRET]."""
    judged = settle(_judged(documents).select("tokens").where(F.size("tokens") > 0), "secrets-tokens")
    whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
    spans = _judged(documents, whole).select("kept_0", F.concat("base", _added(_limits(judged, rate))).alias("spans"))
    text = masked(F.col("kept_0.text"), F.col("spans"), lambda _: F.lit("[SECRET]"))
    return spans.select(*[text.alias("text") if c == "text" else F.col("kept_0").getField(c).alias(c) for c in documents.columns])


def _by_length(size: Column, values) -> Column:
    """The value of the length class that a token's size falls in."""
    out = F.lit(values[0])
    for low, value in zip(LENGTHS[1:], list(values)[1:]):
        out = F.when(size >= low, F.lit(value)).otherwise(out)
    return out


def _thresholds(counts: DataFrame, rate: float) -> dict[int, int]:
    """Benjamini-Hochberg by length class over the histogram of p-values (at most 5 x 401 rows): the least bin from
    which on expected false findings stay under `rate` of all."""
    from pyspark.sql import Window

    by_class = Window.partitionBy("length_class")
    above = by_class.orderBy(F.col("bin").desc())
    expected = F.col("all") * F.pow(F.lit(10.0), -F.col("bin") * STEP)
    kept = (
        counts.withColumn("all", F.sum("count").over(by_class))
        .withColumn("found", F.sum("count").over(above))
        .where((F.col("bin") > 0) & (expected <= rate * F.col("found")))
        .groupBy("length_class").agg(F.min("bin").alias("bin"))
    )
    return {r["length_class"]: r["bin"] for r in kept.collect()}


def secret_spans(documents: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random for every row; see scan."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    return scan(documents).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"),
        shown(by_start(F.concat("base", "added")), KINDS).alias("spans"), F.size("added").cast("long").alias("n_random"),
    )
