"""Personal data: fixed patterns, and information-theoretic sanitisation of the terms that reveal them. Native only.

A term reveals an entity if who sees it knows nearly all that there is to know about the entity's presence: from the
counts of rows that hold the term, the entity, or both, over whole rows and the whole corpus, comes the probability of
the entity given the term, P = (both + a * p) / (holders + a), smoothed towards the entity's own share of rows, p, as if
`a` more rows held the term. Of the entity's information, -log2 p bits, the term leaves -log2 P hidden. Terms that
disclose at least SHARE of it and leave at most GENERALISE bits are generalised, those that leave at most REMOVE bits are
removed, wherever they stand. One row is no estimate of what comes with what: a term must share EVIDENCE rows with the
entity. With a = 1 that makes a term of two rows with the entity, or of four of which three have it, one to generalise,
and one of six rows that all have it one to remove. Words of single rows are left out before any pairs are made.

An entity that only shares its rows with others is counted with them, by the sum of hashes of its rows, so a long list
of addresses makes no more pairs with terms than one address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import settle
from lodestone.llm.spans import SPAN, let, masked, shown, spans_of

KINDS = ["email", "ip", "card", "phone", "term"]
# The base patterns, written so that no match is tried twice from within a run of its characters.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
IP_FITS = rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"
WORD = r"[\p{L}\p{N}]{2,}"
SMOOTH, SHARE, GENERALISE, REMOVE, EVIDENCE = 1.0, 0.5, 1.0, 0.25, 2
SHELVES = 256  # a row's revealing terms are looked up in at most so many parts, by their hashes


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    total = F.aggregate(
        F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int") * (1 + i % 2), lambda x: F.when(x > 9, x - 9).otherwise(x))),
        F.lit(0),
        lambda acc, x: (acc + x).cast("int"),
    )
    return total % 10 == 0


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _ordered(spans: Column) -> Column:
    """By kind, then start."""
    return F.array_sort(F.transform(spans, lambda x: F.struct(x["kind"], x["start"], x["end"], x["text"])))


def _words(text: Column) -> Column:
    """The distinct words of a text, in lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lower))


def _key(text: Column) -> list[Column]:
    """128 bits that stand for a text: what is found depends on it alone."""
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit("text"), text).alias("k2")]


def _rows(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))


def scan(documents: DataFrame) -> DataFrame:
    """Settled rows (row, doc_id, k1, k2, base, t, terms): the fixed patterns' spans of each row, and its text and words if
    it has any."""
    none = F.array().cast(SPAN)
    blank = F.array().cast("array<string>")
    sources = [("email", EMAIL, F.contains("t", F.lit("@"))), ("ip", IP, F.contains("t", F.lit("."))), ("card", CARD, F.lit(True)), ("phone", PHONE, F.contains("t", F.lit("+")))]
    found = _rows(documents).select("doc_id", "t", *[F.when(may, F.regexp_extract_all("t", F.lit(p), F.lit(0))).otherwise(blank).alias(f"m_{k}") for k, p, may in sources])
    cut = found.select("doc_id", "t", *[c for k, p, _ in sources for c in (F.col(f"m_{k}"), F.when(F.size(f"m_{k}") > 0, F.split("t", p, -1)).otherwise(blank).alias(f"p_{k}"))])
    fits = {
        "email": lambda x: F.lit(True),
        "ip": lambda x: x["text"].rlike(IP_FITS),
        "card": lambda x: luhn(_digits(x["text"])),
        "phone": lambda x: F.length(_digits(x["text"])).between(8, 15),
    }
    spans = cut.select("doc_id", "t", *[F.when(F.size(f"m_{k}") > 0, F.filter(spans_of(i, F.col(f"p_{k}"), F.col(f"m_{k}")), fits[k])).otherwise(none).alias(f"s_{k}") for i, (k, _, _) in enumerate(sources)])
    found = let(_ordered(F.concat(*[F.col(f"s_{k}") for k, _, _ in sources])), lambda base: F.struct(base.alias("base"), F.when(F.size(base) > 0, F.col("t")).alias("t"), F.when(F.size(base) > 0, _words(F.col("t"))).alias("terms")))
    return settle(spans.select(F.monotonically_increasing_id().alias("row"), "doc_id", *_key(F.col("t")), F.inline(F.array(found))), "pii")


def term_counts(documents: DataFrame) -> DataFrame:
    """(word, holders): in how many rows of the corpus each word occurs."""
    return _rows(documents).select(F.explode(_words(F.col("t"))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("holders"))


def entity_groups(scanned: DataFrame) -> DataFrame:
    """(row, groups): for each row with entities the distinct (owners, rows) of these, rows being a sum of hashes of the
    rows that hold an entity, and owners their number."""
    names = F.array(*map(F.lit, KINDS))
    each = scanned.where(F.size("base") > 0).select("row", F.explode(F.array_distinct(F.transform("base", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["text"])))).alias("who"))
    owners = each.groupBy(F.col("who").alias("of")).agg(F.count(F.lit(1)).alias("owners"), F.sum(F.xxhash64("row").cast("decimal(20,0)")).alias("rows"))
    return each.join(owners, F.col("who") == F.col("of")).groupBy("row").agg(F.collect_set(F.struct("owners", "rows")).alias("groups"))


def disclosure(both: Column, owners: Column, holders: Column, n: int) -> tuple[Column, Column]:
    """(share, hidden): of an entity's information the share that a term discloses, and the bits that it leaves."""
    prior = owners / F.lit(float(n))
    given = F.least(F.lit(1.0), (both + SMOOTH * prior) / (holders + SMOOTH))
    return 1 - F.log2(given) / F.log2(prior), -F.log2(given)


def revealing(scanned: DataFrame, counts: DataFrame) -> DataFrame:
    """(term, share, hidden, holders): the terms that reveal an entity, by the one that they reveal most of."""
    n = scanned.count()
    groups = entity_groups(scanned)
    words = scanned.where(F.size("base") > 0).select("row", F.explode("terms").alias("term"))
    words = words.join(counts.where(F.col("holders") >= EVIDENCE), F.col("term") == F.col("word")).select("row", "term", "holders")
    together = (
        words.groupBy("row").agg(F.collect_list(F.struct("term", "holders")).alias("terms")).join(groups.withColumnRenamed("row", "of"), F.col("row") == F.col("of"))
        .select(F.explode("groups").alias("g"), "terms").select("g.owners", "g.rows", F.inline("terms"))
        .groupBy("owners", "rows", "term", "holders").agg(F.count(F.lit(1)).alias("both"))
    )
    share, hidden = disclosure(F.col("both"), F.col("owners"), F.col("holders"), n)
    return (
        together.where((F.col("owners") < n) & (F.col("both") >= EVIDENCE))
        .select("term", "holders", share.alias("share"), hidden.alias("hidden")).where((F.col("share") >= SHARE) & (F.col("hidden") <= GENERALISE))
        .groupBy("term").agg(F.max("share").alias("share"), F.min("hidden").alias("hidden"), F.max("holders").alias("holders"))
    )


def _term_spans(text: Column, strong: Column) -> Column:
    """SPAN array of the words of a text that are among `strong` ones. These lie on shelves by their hashes, so a long text
    with many of them takes time in proportion to its words."""
    shelf = lambda word, n: F.pmod(F.xxhash64(word), n).cast("int")
    n = F.least(F.lit(SHELVES), F.ceil(F.size(strong) / 8)).cast("long")
    every = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda m: spans_of(4, F.split(text, WORD, -1), m))

    def among(count: Column) -> Column:
        shelves = F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: F.filter(strong, lambda w: shelf(w, count) == i))
        return let(shelves, lambda held: F.filter(every, lambda x: let(F.lower(x["text"]), lambda w: F.array_contains(F.get(held, shelf(w, count)), w))))

    return let(n, among)


def _found(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and (o1, o2, added, gone) of the texts with revealing terms: their spans and those to remove.

    A term all of whose rows have entities is found in the scanned rows. Only the others, words most but not all of whose
    rows hold an entity, are looked for in all rows."""
    scanned = scan(documents)
    strong = settle(revealing(scanned, settle(term_counts(documents), "pii-words")), "pii-terms")
    ours = scanned.where(F.size("base") > 0)
    inside = ours.select(F.explode("terms").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("inside"))
    loose = settle(strong.join(inside, F.col("term") == F.col("word")).where("inside < holders").select("term", "hidden"), "pii-loose")
    lists = [F.collect_set("term").alias("strong"), F.collect_set(F.when(F.col("hidden") <= REMOVE, F.col("term"))).alias("lost")]
    texts = ours.dropDuplicates(["k1", "k2"])
    mine = texts.select(F.col("k1").alias("h1"), F.col("k2").alias("h2"), F.explode("terms").alias("word")).join(strong, F.col("word") == F.col("term")).groupBy("h1", "h2").agg(*lists)
    same = (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2"))
    words = _rows(documents).select(*_key(F.col("t")), F.explode(_words(F.col("t"))).alias("word"))
    others = words.join(loose, F.col("word") == F.col("term")).groupBy(F.col("k1").alias("h1"), F.col("k2").alias("h2")).agg(*lists)
    others = settle(others.join(texts.select("k1", "k2"), same, "left_anti"), "pii-others")
    read = texts.select("t", "k1", "k2").join(mine, same).unionByName(_rows(documents).select("t", *_key(F.col("t"))).join(others, same))
    spans = read.select(F.col("k1").alias("o1"), F.col("k2").alias("o2"), "lost", _term_spans(F.col("t"), F.col("strong")).alias("added"))
    gone = F.transform(F.filter("added", lambda x: F.array_contains("lost", F.lower(x["text"]))), lambda x: x["start"])
    return scanned, settle(spans.select("o1", "o2", "added", gone.alias("gone")).dropDuplicates(["o1", "o2"]), "pii-spans")


def _free(found: DataFrame) -> DataFrame:
    """Adds to rows with base the spans in `added` that touch none of them."""
    none = F.array().cast(SPAN)
    return found.withColumn("added", _ordered(F.filter(F.coalesce("added", none), lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))))


def pii_spans(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms for every row of `documents` (doc_id, text).

    Positions are code points, end exclusive; base spans are the fixed patterns', and spans adds the revealing terms
    that touch none of them. Null and empty texts have none; a null doc_id stays null; repeated rows each count and
    each come back; an empty table gives no rows; other columns are not read."""
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    scanned, terms = _found(documents)
    rows = _free(scanned.join(terms, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left").select("doc_id", "base", "added"))
    return rows.select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])],
        F.sha2(shown(F.col("base"), KINDS), 256).alias("base_sha256"),
        shown(_ordered(F.concat("base", "added")), KINDS).alias("spans"), F.size("added").cast("long").alias("n_terms"),
    )


def sanitise(documents: DataFrame) -> DataFrame:
    """doc_id and text of every row with entities replaced by their kind, revealing terms generalised to [TERM] or, where
    they tell nearly everything, removed. Findings are joined to texts by the text itself, so rows may come in any order.
    Null texts stay null."""
    scanned, terms = _found(documents)
    base = scanned.where(F.size("base") > 0).groupBy(F.col("k1").alias("b1"), F.col("k2").alias("b2")).agg(F.any_value("base").alias("base"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *_key(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    rows = texts.join(terms, (F.col("k1") == F.col("o1")) & (F.col("k2") == F.col("o2")), "left").join(base, (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2")), "left")
    rows = _free(rows.withColumn("base", F.coalesce("base", F.array().cast(SPAN))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    label = lambda x: F.when((x["kind"] == 4) & F.coalesce(F.array_contains("gone", x["start"]), F.lit(False)), F.lit("")).otherwise(F.get(names, x["kind"]))
    return rows.select("doc_id", masked(F.col("text"), F.concat("base", "added"), label).alias("text"))
