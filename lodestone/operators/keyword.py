"""Keyword search by an inverted index in order of impact: exact best hits without scoring every document with a common word.

A posting's impact is all that its term adds to a document's BM25 score for one mention in a query. Documents of about one
length form a class; a term's bound in a class is its highest impact there. The heads of the lists give each query some
documents whose exact scores set a floor that the k-th hit cannot lie under. Of a query's terms, rarest first, the first
that a document has leads it: with all later terms at their bounds it must reach the floor, so only postings with that
much impact are taken, few of common terms. A document that then reaches the floor with its other terms at the most that
they can be is completed by the rest of its postings, looked up by term and document."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lineage import cut
from lodestone.functions.stage_log import StageLog
from lodestone.functions.text import tokens

K1, B, PLACES = 1.5, 0.75, 6
CLASSES = 4  # of lengths, for each doubling
SLACK = 2e-6  # scores so close to the floor may be rounded over it


@dataclass(frozen=True)
class Index:
    """postings (term, id, class, impact), unique in term and id; terms (term, class, most, df), the highest impact of each
    term in each class and its documents in all."""

    postings: DataFrame
    terms: DataFrame

    def write(self, folder: str) -> None:
        """Lists stand together, highest impacts first, so a search for some terms skips the files and row groups of others."""
        self.postings.repartitionByRange("term", F.col("impact").desc()).sortWithinPartitions("term", F.col("impact").desc(), "id").write.parquet(f"{folder}/postings")
        self.terms.sort("term").write.parquet(f"{folder}/terms")

    @classmethod
    def read(cls, spark, folder: str) -> Index:
        return cls(spark.read.parquet(f"{folder}/postings"), spark.read.parquet(f"{folder}/terms"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term, qtf) of queries (query_id, query_text)."""
    return queries.where("query_id IS NOT NULL").select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))


def build(chunks: DataFrame, id_col: str = "id", content: str = "content", only: DataFrame | None = None) -> Index:
    """The index of all terms, or of those in `only` (term): counts and lengths are those of all chunks either way."""
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(content)).alias("words"))
    size = words.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(1.0)).alias("avgdl"))  # one row
    length = F.size("words")
    rows = words.select("id", length.alias("dl"), F.floor(F.log2(length) * CLASSES).cast("int").alias("class"), F.explode("words").alias("term"))
    if only is not None:
        rows = rows.join(only.select("term").distinct(), "term", "left_semi")
    tf = rows.groupBy("term", "id", "class", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    postings = cut(tf.join(df, "term").join(F.broadcast(size), F.lit(True)).select("term", "id", "class", (idf * weight).alias("impact")))
    each = postings.groupBy("term", "class").agg(F.max("impact").alias("most"), F.count(F.lit(1)).alias("n"))
    return Index(postings, cut(each.withColumn("df", F.sum("n").over(Window.partitionBy("term"))).drop("n")))


def exact(index: Index, pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, id, score) of stated pairs (query_id, id): their postings alone are read, by term and document."""
    wanted = pairs.select("query_id", "id").join(asked, "query_id")
    return wanted.join(index.postings, ["term", "id"]).groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("score"))


def floors(index: Index, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, floor): a score that k documents reach. The documents at the heads of the query's lists are scored, so
    that many at most for each of its terms; a query with fewer than k of them has no floor, which is 0."""
    order = Window.partitionBy("term").orderBy(F.col("impact").desc(), "id")
    heads = index.postings.join(asked.select("term").distinct(), "term", "left_semi").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)
    pairs = asked.select("query_id", "term").join(heads.select("term", "id"), "term").select("query_id", "id").distinct()
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    nth = exact(index, pairs, asked).withColumn("nth", F.row_number().over(best)).where(F.col("nth") == k)
    return asked.select("query_id").distinct().join(nth.select("query_id", "score"), "query_id", "left").select("query_id", F.coalesce("score", F.lit(0.0)).alias("floor"))


def above(index: Index, asked: DataFrame, floor: DataFrame, log: StageLog | None = None) -> DataFrame:
    """(query_id, id, score) of every document that reaches the query's floor (query_id, floor) and has a score over 0,
    rounded to PLACES. The log counts the pairs that were looked at and those that were completed."""
    here = Window.partitionBy("query_id", "class")
    bounds = asked.join(index.terms, "term").join(floor, "query_id").withColumn("bound", F.col("qtf") * F.col("most"))
    later = F.sum("bound").over(here) - F.sum("bound").over(here.orderBy("df", "term").rowsBetween(Window.unboundedPreceding, 0))
    bounds = bounds.withColumn("least", (F.col("floor") - 2 * SLACK - later) / F.col("qtf"))
    # what a term can add to a document of which no posting of it was taken
    bounds = bounds.withColumn("cap", F.col("qtf") * F.greatest(F.lit(0.0), F.least("most", "least")))
    bounds = cut(bounds.withColumn("caps", F.sum("cap").over(here)).select("query_id", "term", "class", "qtf", "floor", "most", "least", "cap", "caps"))
    taken = bounds.where("least <= most").join(index.postings, ["term", "class"]).where(F.col("impact") >= F.col("least"))
    seen = taken.groupBy("query_id", "id", "class").agg(F.sum(F.col("qtf") * F.col("impact")).alias("part"), F.sum("cap").alias("met"), F.first("caps").alias("caps"), F.first("floor").alias("floor"))
    if log is not None:
        seen = log.stage("pairs", seen)
    able = F.col("part") + F.col("caps") - F.col("met") >= F.col("floor") - SLACK
    kept = seen.where(able).select("query_id", "id", "class", "part", "floor")
    if log is not None:
        kept = log.stage("completed", kept)
    kept = cut(kept)
    wanted = kept.join(bounds.where("cap > 0").select("query_id", "class", "term", "qtf", "least"), ["query_id", "class"]).select("query_id", "id", "term", "qtf", "least")
    more = wanted.join(index.postings.select("term", "id", "impact"), ["term", "id"]).where(F.col("impact") < F.col("least"))
    more = more.groupBy("query_id", "id").agg(F.sum(F.col("qtf") * F.col("impact")).alias("more"))
    total = F.col("part") + F.coalesce("more", F.lit(0.0))
    whole = kept.join(more, ["query_id", "id"], "left").where(total >= F.col("floor") - SLACK)
    return whole.select("query_id", "id", F.round(total, PLACES).alias("score")).where("score > 0")


def search(index: Index, queries: DataFrame, k: int, log: StageLog | None = None) -> DataFrame:
    """(query_id, id, score, rank) of each query's k best documents, ties by id: what scoring all documents would give."""
    asked = cut(asked_terms(queries))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return above(index, asked, cut(floors(index, asked, k)), log).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranks_with(index: Index, queries: DataFrame, also: DataFrame, k: int, log: StageLog | None = None) -> DataFrame:
    """The k best of each query, and the documents named by `also` (query_id, id) that have a score, with their ranks
    among all documents. Those are counted, each scored document against the few that are asked for, instead of sorting
    all scored documents of a query in one task."""
    asked = cut(asked_terms(queries))
    named = cut(also.select("query_id", "id").distinct())
    lowest = exact(index, named, asked).groupBy("query_id").agg(F.min("score").alias("low"))
    floor = floors(index, asked, k).join(lowest, "query_id", "left").select("query_id", F.least("floor", F.coalesce("low", "floor")).alias("floor"))
    scored = cut(above(index, asked, cut(floor), log))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    top = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    few = scored.join(named, ["query_id", "id"], "left_semi").groupBy("query_id").agg(F.collect_list(F.struct("id", "score")).alias("few"))  # as many as `also` names
    against = scored.join(few, "query_id").select("query_id", "id", "score", F.explode("few").alias("one"))
    ahead = (F.col("score") > F.col("one.score")) | ((F.col("score") == F.col("one.score")) & (F.col("id") < F.col("one.id")))
    placed = against.groupBy("query_id", F.col("one.id").alias("id"), F.col("one.score").alias("score")).agg((F.count_if(ahead) + 1).cast("int").alias("rank"))
    return top.unionByName(placed.join(top.select("query_id", "id"), ["query_id", "id"], "left_anti"))
