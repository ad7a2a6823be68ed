"""Mixing sources to target weights by soft membership.

A classifier fitted on labelled rows gives every document a posterior over domains. Each document then gets a rate
(expected copies) such that the expected token totals of the domains meet targets: least squares in the totals, with
a pull towards rate 1 that chooses among rates of like totals: PULL, so small that reachable targets are met to a
millionth, or MIX_PULL where targets are out of reach and only the pull keeps few documents from being repeated endlessly.

Rates are fitted by projected gradient steps in two metrics: rates at their bound that the gradient pushes against it
step by the plain gradient, all others by the gradient preconditioned with the k x k moments of their memberships; both
are projected on the bound, and a step is halved until the squares fall enough. A step is told by 2k + 1 numbers, so the
state of the fit is the list of its steps: every pass replays them from rate 1, next to the data, and sends back one row
of totals. Nothing of the size of the corpus is kept between passes but the table of memberships."""

from __future__ import annotations

import logging
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.shared import settle, sliced

BUCKETS, MAX_LABELLED, KEPT_TOKENS = 1 << 16, 12_000, 200_000
PULL, MIX_PULL, CLOSE, NEAR, MISSED, PASSES = 1e-6, 1e-3, 1e-6, 1e-6, 1e-3, 200


class Domains:
    """Hashed multinomial models by domain, and a softmax over their mean log-likelihoods."""

    def __init__(self, names: list[str], table: np.ndarray, weights: np.ndarray) -> None:
        self.names, self.table, self.weights = names, table, weights
        self.kept: dict[str, int] = {}

    def __getstate__(self) -> dict:
        return {"names": self.names, "table": self.table, "weights": self.weights, "kept": {}}

    def features(self, text: str | None) -> tuple[int, np.ndarray]:
        tokens, kept = (text or "").split(), self.kept
        if not tokens:
            return 0, np.zeros(len(self.names))
        if len(kept) > KEPT_TOKENS:
            kept.clear()
        ids = []
        for t in tokens:
            i = kept.get(t)
            if i is None:
                i = bucket(t)
                if len(t) <= 48:
                    kept[t] = i
            ids.append(i)
        mean = self.table[:, ids].mean(axis=1)
        return len(tokens), mean - mean.mean()

    def membership(self, text: str | None) -> tuple[int, np.ndarray]:
        n, x = self.features(text)
        return n, softmax(self.weights[:, 0] + self.weights[:, 1:] @ x)


def bucket(token: str) -> int:
    return zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) % BUCKETS


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit_softmax(x: np.ndarray, y: np.ndarray, k: int) -> np.ndarray:
    """Ridge multinomial regression by accelerated gradient steps; weights for unscaled features, constants first."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    a, hot = np.hstack([np.ones((len(x), 1)), (x - mean) / spread]), np.eye(k)[y]
    w = v = np.zeros((k, a.shape[1]))
    rate = 1 / (0.5 * np.linalg.norm(a, 2) ** 2 / len(a) + 1e-3)
    for i in range(600):
        new = v - rate * ((softmax(a @ v.T) - hot).T @ a / len(a) + 1e-3 * v)
        v, w = new + i / (i + 3) * (new - w), new
    return np.hstack([(w[:, :1] - (w[:, 1:] * mean / spread).sum(axis=1, keepdims=True)), w[:, 1:] / spread])


def label_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) of labelled documents: domain q<quality>t<toxic>."""
    return labels.select("doc_id", F.format_string("q%dt%d", F.col("quality").cast("int"), F.col("toxic").cast("int")).alias("domain")).where("quality IS NOT NULL AND toxic IS NOT NULL")


def _count(names: list[str]):
    import pyarrow as pa

    def run(batches):
        counts = np.zeros((len(names), BUCKETS))
        for batch in batches:
            for text, domain in zip(batch.column("text").to_pylist(), batch.column("domain").to_pylist()):
                ids = [bucket(t) for t in (text or "").split()]
                np.add.at(counts[names.index(domain)], ids, 1)
        k, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(b, pa.int64()), pa.array(counts[k, b], pa.float64())], names=["k", "b", "n"])

    return run


def _featured(model, names: list[str]):
    import pyarrow as pa

    def run(batches):
        m = model.value
        for batch in batches:
            x = [m.features(t)[1].tolist() for t in batch.column("text").to_pylist()]
            y = [names.index(d) for d in batch.column("domain").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(x, pa.list_(pa.float64()))], names=["y", "x"])

    return run


def fit_domains(documents: DataFrame, labelled: DataFrame, most: int = MAX_LABELLED) -> Domains:
    """Fits on at most `most` labelled rows (doc_id, domain), those of the smallest hashes: six in ten for the models,
    the rest for the softmax. The driver gets `most` rows of labels and features and domains x BUCKETS counts."""
    spark = documents.sparkSession
    asked = (
        labelled.select(F.col("doc_id").cast("long").alias("id"), F.col("domain").cast("string").alias("domain")).where("id IS NOT NULL AND domain IS NOT NULL")
        .groupBy("id").agg(F.min("domain").alias("domain")).orderBy(F.xxhash64("id"), "id").limit(most)
    ).collect()
    names = sorted({r["domain"] for r in asked})
    if len(names) < 2:
        return Domains(names or ["all"], np.zeros((1, BUCKETS)), np.zeros((1, 2)))
    chosen = F.broadcast(spark.createDataFrame(asked, "id long, domain string"))  # at most `most` rows
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(chosen, F.col("doc_id") == F.col("id")).select("doc_id", "text", "domain")
    part = F.pmod(F.xxhash64(F.lit("mix"), "doc_id"), F.lit(10))
    found = rows.where(part < 6).select("text", "domain").repartition(8).mapInArrow(_count(names), "k long, b long, n double").groupBy("k", "b").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(names), BUCKETS))
    counts[found.column("k").to_numpy(), found.column("b").to_numpy()] = found.column("n").to_numpy()
    shared = (counts.sum(axis=0) + 1) / (counts.sum() + BUCKETS)
    smooth = 200.0
    table = np.log((counts + smooth * shared) / (counts.sum(axis=1, keepdims=True) + smooth))
    prior = np.zeros((len(names), len(names) + 1))
    model = Domains(names, table, prior)
    seen = rows.where(part >= 6).select("text", "domain").mapInArrow(_featured(spark.sparkContext.broadcast(model), names), "y int, x array<double>").collect()
    if seen:
        model.weights = fit_softmax(np.array([r["x"] for r in seen]), np.array([r["y"] for r in seen]), len(names))
    return model


def _members(model):
    import pyarrow as pa

    def run(batches):
        m = model.value
        for batch in sliced(batches):
            found = [m.membership(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in found], pa.int64()), pa.array([p.tolist() for _, p in found], pa.list_(pa.float64()))], names=["doc_id", "n_tokens", "membership"])

    return run


def rates_of(member: np.ndarray, steps: np.ndarray, least: float, pull: float = PULL) -> np.ndarray:
    """The rates after projected gradient steps from rate 1. A step is its length, the totals' slope y and the
    preconditioned slope w: along it, a rate at its bound that the gradient pushes against it goes towards
    1 - p.y / pull, any other towards 1 - p.w."""
    k = member.shape[1]
    r = np.full(len(member), max(1.0, least))
    for step in np.reshape(steps, (-1, 2 * k + 1)):
        part, y, w = step[0], step[1 : k + 1], step[k + 1 :]
        plain = member @ y / pull
        goal = 1 - np.where(bound(r, plain, least), plain, member @ w)
        r = np.maximum(least, r + part * (goal - r))
    return r


def bound(r: np.ndarray, plain: np.ndarray, least: float) -> np.ndarray:
    """Which rates stand at (or within NEAR of) their bound while the gradient, plain + r - 1 in units of the pull, pushes on."""
    return (r <= least + NEAR) & (plain + r > 1)


def _matrix(batch, k: int) -> np.ndarray:
    return batch.column("membership").values.to_numpy(zero_copy_only=False).reshape(-1, k) if batch.num_rows else np.zeros((0, k))


def _totals(k: int, steps: np.ndarray, least: float, pull: float):
    """Totals by domain at the rates that `steps` lead to, the pull's part of the squares, and the tokens."""

    def of(p, n):
        r = rates_of(p, steps, least, pull)
        return np.concatenate([(n * r) @ p, [pull / 2 * (n @ (r - 1) ** 2), n.sum()]])

    return of


def _moments(k: int, steps: np.ndarray, y: np.ndarray, least: float, pull: float):
    """Of the rates that are off their bounds: second moments of memberships, and memberships times the gradient in units
    of the pull; last, the longest that any rate would move by a plain gradient step."""

    def of(p, n):
        r = rates_of(p, steps, least, pull)
        plain = p @ y / pull
        slope, free = plain + r - 1, n * ~bound(r, plain, least)
        moved = np.abs(np.maximum(least, r - pull * slope) - r)[n > 0].max(initial=0)
        return np.concatenate([((p * free[:, None]).T @ p).ravel(), (free * slope) @ p, [moved]])

    return of


def _gather(members: DataFrame, k: int, size: int, of) -> tuple[np.ndarray, np.ndarray]:
    """Sums and maxima over all rows of the `size` numbers that `of` makes of a batch."""
    import pyarrow as pa

    def run(batches):
        total, most = np.zeros(size), np.zeros(size)
        for batch in batches:
            part = of(_matrix(batch, k), batch.column("n_tokens").to_numpy().astype(float))
            total, most = total + part, np.maximum(most, part)
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total, pa.float64()), pa.array(most, pa.float64())], names=["at", "total", "most"])

    rows = members.mapInArrow(run, "at int, total double, most double").groupBy("at").agg(F.sum("total").alias("total"), F.max("most").alias("most")).collect()
    out = np.zeros((2, size))
    for r in rows:
        out[:, r["at"]] = r["total"], r["most"]
    return out[0], out[1]


def fit_rates(members: DataFrame, k: int, weights: np.ndarray | None = None, temper: float = 0.85, least: float = 0.0, grow: bool = False, pull: float = PULL) -> tuple[np.ndarray, np.ndarray]:
    """The projected gradient steps whose rates fit the targets best, and the gaps in token shares that are left.

    Targets are `weights` times the corpus' tokens; without weights, the domains' present shares to the power
    `temper`. With `grow`, the total is raised until no domain has to shrink. The fit ends when a plain gradient step
    would move no rate by CLOSE or more, at the latest at its optimum; RuntimeError where PASSES passes do not get there."""
    steps = np.zeros((0, 2 * k + 1))
    found, _ = _gather(members, k, k + 2, _totals(k, steps, least, pull))
    total = found[-1]
    if total <= 0:
        return steps, np.zeros(k)
    share = found[:k] / found[:k].sum()
    target = share**temper if weights is None else np.asarray(weights, float)
    target = target / target.sum()
    if grow:
        target = target * max(1.0, (share[target > 0] / target[target > 0]).max())
    soft = np.maximum(share, 1e-6)  # a gap weighs by the inverse of its domain's share
    squares = lambda f: ((f[:k] / total - target) ** 2 / soft).sum() / 2 + f[k] / total
    passes = 1
    while True:
        y = (found[:k] / total - target) / soft
        sums, most = _gather(members, k, k * k + k + 1, _moments(k, steps, y, least, pull))
        passes += 1
        if most[-1] < CLOSE:
            break
        moments, slope = sums[: k * k].reshape(k, k) / total, sums[k * k : -1] / total
        w = y / pull - np.linalg.solve(np.diag(soft) * pull + moments, slope)
        part, before = 1.0, squares(found)
        while True:
            if passes >= PASSES:
                raise RuntimeError(f"mixing rates not fitted in {PASSES} passes: a gradient step moves a rate by {most[-1]:.2g}")
            tried = np.vstack([steps, np.concatenate([[part], y, w])])
            there, _ = _gather(members, k, k + 2, _totals(k, tried, least, pull))
            passes += 1
            if squares(there) < before * (1 - 1e-4 * part):
                break
            part /= 2
            if part < 2.0**-20:  # the squares fall no further in double precision
                tried, there = steps, found
                break
        if tried is steps:
            break
        steps, found = tried, there
    gaps = found[:k] / total - target
    if np.abs(gaps).max() > MISSED:
        logging.getLogger(__name__).warning("mixing: targets are out of reach by up to %.4f of the tokens; gaps by domain %s", np.abs(gaps).max(), np.round(gaps, 4).tolist())
    return steps, gaps


def _rated(k: int, steps: np.ndarray, least: float, pull: float = PULL):
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            r = rates_of(_matrix(batch, k), steps, least, pull)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r, pa.float64())], names=[*batch.schema.names, "rate"])

    return run


def mixing_rates(documents: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens (by white space), membership (over the labelled domains in order of their names) and rate of
    every row of `documents` (doc_id, text), for target weights by domain.

    Null and empty texts have no tokens and the domains' prior; a null doc_id stays null; repeated rows each count;
    fewer than two labelled domains make one domain of all; an empty table gives no rows. Domains without a weight
    get none. Other columns are not read."""
    model = fit_domains(documents, labelled)
    held, k = documents.sparkSession.sparkContext.broadcast(model), len(model.names)
    members = settle(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_members(held), "doc_id long, n_tokens long, membership array<double>"), "mixing")
    target = None if weights is None or not any(weights.get(n, 0) for n in model.names) else np.array([weights.get(n, 0.0) for n in model.names])
    steps, _ = fit_rates(members, k, target)
    return members.mapInArrow(_rated(k, steps, 0.0), "doc_id long, n_tokens long, membership array<double>, rate double")


def mix(documents: DataFrame, labelled: DataFrame, temper: float = 0.85) -> DataFrame:
    """The rows of `documents`, each as often as its rate says: the whole part, and one more for the share of rows
    (by a hash of id and text) that the fraction says. Rates are at least 1, so no document is lost: scarce domains
    are repeated until the domains' expected tokens meet their tempered shares. All columns are kept."""
    model = fit_domains(documents, labelled)
    held, k = documents.sparkSession.sparkContext.broadcast(model), len(model.names)
    members = settle(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_members(held), "doc_id long, n_tokens long, membership array<double>").select("n_tokens", "membership"), "mix")
    steps, _ = fit_rates(members, k, None, temper, 1.0, True, MIX_PULL)

    def run(batches):
        import pyarrow as pa

        m = held.value
        for batch in sliced(batches):
            p = np.array([m.membership(t)[1] for t in batch.column("text").to_pylist()]).reshape(-1, k)
            r = rates_of(p, steps, 1.0, MIX_PULL)
            chance = np.array([zlib.crc32(f"{i}:{t}".encode("utf-8", "surrogatepass")) / 2**32 for i, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())])
            copies = np.floor(r).astype(np.int64) + (chance < r - np.floor(r))
            for at in range(0, batch.num_rows, 256):
                yield batch.take(pa.array(np.repeat(np.arange(at, min(at + 256, batch.num_rows)), copies[at : at + 256])))

    return documents.mapInArrow(run, documents.schema)
