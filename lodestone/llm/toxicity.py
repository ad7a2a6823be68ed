"""Toxicity by class-conditional Kneser-Ney models over the characters of words.

Two models of order 5, one of toxic and one of ordinary labelled texts, differ in their upper orders and share the
counts they back off to from order 2 down, so an expression that neither class has seen scores alike in both. These
shared counts come from the words of all documents, labelled or not, each word counted once. Where a character never
follows its context in either class, both classes give it the same shared chance, which cancels: so the shared counts
of the pairs that labelled texts hold are all that scores depend on, however many others the corpus has. A word
scores the difference of its log-likelihoods; a text is judged by that difference per character, per root of its
characters, and at its strongest words, weighed by a logistic regression on labelled texts the models did not see."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import forget, settle, sliced

ORDER, SHARED, DISCOUNT = 5, 2, 0.75
MAX_LABELLED = 12_000  # labelled rows that models and weights are fitted on, at most: those of the smallest hashes
KEPT_WORDS, KEPT_CHARACTERS, KEPT_GRAMS, AT_ONCE = 200_000, 8_000_000, 250_000, 50_000
TOP = (1, 3)

_letters = re.compile(r"[^\W\d_]+")


def words_of(token: str) -> list[str]:
    return _letters.findall(token.lower())


def grams_of(word: str):
    padded = "^" * (ORDER - 1) + word + "$"
    return (padded[i : i + ORDER] for i in range(len(word) + 1))


class Shared:
    """Counts that both classes back off to: of character pairs {pair: words}, of their contexts {first: (words, pairs)},
    of last characters {last: pairs}, and of all (pairs, last characters)."""

    def __init__(self, pairs: dict[str, int], contexts: dict[str, tuple[int, int]], lasts: dict[str, int], whole: tuple[int, int]) -> None:
        self.pairs, self.contexts, self.lasts, self.whole = pairs, contexts, lasts, whole

    def table(self, n: int) -> tuple[dict, dict, dict]:
        """Counts, totals and numbers of followers of order n (1 or 2)."""
        if n == SHARED:
            return self.pairs, {c: x for c, (x, _) in self.contexts.items()}, {c: x for c, (_, x) in self.contexts.items()}
        return self.lasts, {"": self.whole[0]}, {"": self.whole[1]}


class KneserNey:
    """Both classes' models, from counts of padded grams {gram: (ordinary, toxic)} and the shared counts."""

    def __init__(self, counts: dict[str, tuple[int, int]], shared: Shared) -> None:
        #: per class and order n: count of each n-gram (raw at the top, distinct characters before it below; shared ones
        #: up to SHARED), total and number of distinct followers of each context
        self.tables: list[dict[int, tuple[dict, dict, dict]]] = []
        for c in (0, 1):
            top = {g: n[c] for g, n in counts.items() if n[c]}
            self.tables.append({n: shared.table(n) for n in range(1, SHARED + 1)})
            for n in range(ORDER, SHARED, -1):
                grams = top if n == ORDER else Counter(longer[1:] for longer in {g[ORDER - 1 - n :] for g in top})
                totals, followers = defaultdict(int), defaultdict(int)
                for g, k in grams.items():
                    totals[g[:-1]] += k
                    followers[g[:-1]] += 1
                self.tables[c][n] = (dict(grams), dict(totals), dict(followers))
        self.letters = len({g[-1] for g in counts}) + 1
        self.kept: dict[str, float] = {}

    def chance(self, c: int, gram: str) -> float:
        """P(last character | the ones before) under class c."""
        p = 1.0 / self.letters
        for n in range(1, ORDER + 1):
            counts, totals, followers = self.tables[c][n]
            part = gram[ORDER - n :]
            total = totals.get(part[:-1])
            if total:
                p = (max(counts.get(part, 0) - DISCOUNT, 0.0) + DISCOUNT * followers[part[:-1]] * p) / total
        return p

    def word(self, word: str) -> float:
        """log P(word | toxic) - log P(word | ordinary)."""
        total, kept = 0.0, self.kept
        for g in grams_of(word):
            score = kept.get(g)
            if score is None:
                if len(kept) >= KEPT_GRAMS:
                    kept.clear()
                score = kept[g] = math.log(self.chance(1, g) / self.chance(0, g))
            total += score
        return total


class Tokens(dict):
    """Places of white-space tokens in a table of their word scores' sum, characters and highest word score."""

    def __init__(self, model: KneserNey) -> None:
        super().__init__()
        self.model, self.rows, self.characters = model, np.zeros((KEPT_WORDS, 3)), 0

    def __missing__(self, token: str) -> int:
        words = words_of(token)
        scores = [self.model.word(w) for w in words]
        place = self[token] = len(self)
        self.rows[place] = sum(scores), sum(map(len, words)) + len(words), max(scores, default=0.0)
        self.characters += len(token)
        return place

    def of(self, tokens: list[str]) -> np.ndarray:
        """The table's rows for at most AT_ONCE tokens; starts anew when full, so memory is bounded."""
        if len(self) + len(tokens) > KEPT_WORDS or self.characters > KEPT_CHARACTERS:
            self.clear()
            self.characters = 0
        return self.rows[np.fromiter(map(self.__getitem__, tokens), np.int64, len(tokens))]


class Scorer:
    """A fitted model: features of texts, and their score."""

    def __init__(self, counts: dict[str, tuple[int, int]], shared: Shared | None, weights: np.ndarray | None, prior: float) -> None:
        self.counts, self.shared, self.weights, self.prior = counts, shared, weights, prior
        self.tokens: Tokens | None = None

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "shared": self.shared, "weights": self.weights, "prior": self.prior, "tokens": None}

    def features(self, text: str | None) -> list[float]:
        tokens = text.split() if text else []
        if not tokens:
            return [0.0] * (2 + len(TOP))
        if self.tokens is None:
            self.tokens = Tokens(KneserNey(self.counts, self.shared))
            self.counts, self.shared = {}, None  # a worker's copy; the tables have what it needs
        total, chars, best = 0.0, 0.0, np.zeros(0)
        for at in range(0, len(tokens), AT_ONCE):
            rows = self.tokens.of(tokens[at : at + AT_ONCE])
            sums = rows.sum(axis=0)
            total, chars, tops = total + float(sums[0]), chars + float(sums[1]), np.concatenate([best, rows[:, 2]])
            best = np.partition(tops, -TOP[-1])[-TOP[-1] :] if len(tops) > TOP[-1] else tops
        best, chars = np.sort(best)[::-1], max(1.0, chars)
        return [total / chars, total / math.sqrt(chars), *[float(best[:k].sum()) / k for k in TOP]]

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.prior
        z = float(self.weights[0] + np.dot(self.weights[1:], self.features(text)))
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Ridge logistic regression by Newton steps; weights for unscaled features, the constant first."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([np.ones((len(x), 1)), (x - mean) / spread])
    w, penalty = np.zeros(a.shape[1]), ridge * len(x) * np.r_[0, np.ones(x.shape[1])] / 100
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty + 1e-6), a.T @ (y - p) - penalty * w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return np.r_[w[0] - (w[1:] * mean / spread).sum(), w[1:] / spread]


def _counter():
    import pyarrow as pa

    def run(batches):
        tokens = (Counter(), Counter())
        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                tokens[toxic].update((text or "").split())
        for c in (0, 1):
            grams: Counter[str] = Counter()
            for token, n in tokens[c].items():
                for word in words_of(token):
                    for g in grams_of(word):
                        grams[g] += n
            keys = list(grams)
            for at in range(0, len(keys), 50_000):
                part = keys[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"gram": pa.array(part, pa.string()), "toxic": pa.array([c] * len(part), pa.int32()), "n": pa.array([grams[k] for k in part], pa.int64())})

    return run


def _batches(scorer, features: bool):
    import pyarrow as pa

    def run(batches):
        s = scorer.value
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            if features:
                yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([s.features(t) for t in texts], pa.list_(pa.float64()))], names=["toxic", "x"])
            else:
                yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in batch.schema.names if c != "text"], pa.array([s.score(t) for t in texts], pa.float64())], names=[*[c for c in batch.schema.names if c != "text"], "score"])

    return run


def shared_counts(documents: DataFrame, wanted: set[str]) -> Shared:
    """The shared counts of the `wanted` character pairs, from all distinct words of all documents, with their starts and
    ends. What reaches the driver is bounded by `wanted`; the totals that go with it are those of all pairs."""
    words = documents.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col("text").cast("string")), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).distinct()
    padded = F.concat(F.lit("^"), "word", F.lit("$"))
    each = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") + 1), lambda i: F.substring(padded, i, F.lit(2)))).alias("pair"))
    pairs = settle(each.groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "toxicity-pairs")
    first, last = F.substring("pair", 1, 1).alias("first"), F.substring("pair", 2, 1).alias("last")
    spark = documents.sparkSession

    def some(rows: DataFrame, column: str, values: set[str]) -> list:
        return rows.join(F.broadcast(spark.createDataFrame([(x,) for x in sorted(values)], f"{column} string")), column).collect() if values else []

    contexts = some(pairs.groupBy(first).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("followers")), "first", {p[0] for p in wanted})
    lasts = some(pairs.groupBy(last).agg(F.count(F.lit(1)).alias("n")), "last", {p[1] for p in wanted})
    whole = pairs.agg(F.count(F.lit(1)), F.countDistinct(last)).first()
    own = some(pairs, "pair", wanted)
    forget(pairs)
    return Shared({r["pair"]: r["n"] for r in own}, {r["first"]: (r["n"], r["followers"]) for r in contexts}, {r["last"]: r["n"] for r in lasts}, tuple(whole))


def fit(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Scorer:
    """Fits the models on at most `most` labelled rows whose crc32(doc_id as text) mod 5 is not 0.

    What reaches the driver is bounded by `most`: the labels, the grams of these rows' texts with the shared counts of
    their pairs, and the features. Seven in ten rows (by hash) go to the models, the rest to the weights."""
    spark, key = documents.sparkSession, F.col("doc_id").cast("long")
    asked = (
        labels.select(key.alias("id"), F.col("toxic").cast("int").alias("toxic"))
        .where("id IS NOT NULL AND toxic IN (0, 1)")
        .where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("id").agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("id"), "id").limit(most)
    ).collect()
    prior = sum(r["toxic"] for r in asked) / max(1, len(asked))
    if not 0 < prior < 1:
        return Scorer({}, None, None, prior)
    chosen = F.broadcast(spark.createDataFrame(asked, "id long, toxic int"))  # at most `most` rows
    rows = documents.select(key.alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", "toxic")
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(10))
    counts = (
        rows.where(part < 7).select("text", "toxic").repartition(8).mapInArrow(_counter(), "gram string, toxic int, n long")
        .groupBy("gram").agg(F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("b"))
    ).toArrow()
    grams = dict(zip(counts.column("gram").to_pylist(), zip(counts.column("a").to_pylist(), counts.column("b").to_pylist())))
    scorer = Scorer(grams, shared_counts(documents, {g[-2:] for g in grams}), None, prior)
    held = spark.sparkContext.broadcast(scorer)
    seen = rows.where(part >= 7).select("toxic", "text").mapInArrow(_batches(held, True), "toxic int, x array<double>").collect()
    y = np.array([r["toxic"] for r in seen], float)
    if len(y) and 0 < y.mean() < 1:
        scorer.weights = logistic(np.array([r["x"] for r in seen]), y)
    return scorer


def score_documents(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of `documents` (doc_id, text), by a model fitted on `labels`
    (doc_id, toxic).

    Only the text makes a score. Null and empty texts score as a text of no evidence; a null doc_id stays null and is
    not held out; repeated rows come back as often; a document labelled twice counts as toxic if either label is; an
    empty table gives no rows. Without labels of both classes every score is the share of toxic labels (0 if none).
    Other columns are not read."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, most))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return rows.mapInArrow(_batches(held, False), "doc_id long, score double").select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """The rows of `documents` that score under 0.5, with all their columns."""
    held = documents.sparkSession.sparkContext.broadcast(fit(documents, labels, most))

    def run(batches):
        import pyarrow as pa

        for batch in sliced(batches):
            scores = [held.value.score(t) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([x < 0.5 for x in scores], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
