"""Gaussian mixtures of every group of a table at once (CL6, CL7).

The parameters of a mixture follow from sums: per component the mass of its
rows, the sum of the rows and the sum of their products. So a mixture is kept
as these sums. A step of expectation maximisation is one pass over the feature
blocks and one aggregate keyed by (group, k, start, component), for all groups,
numbers of components and starts that still rise; a task sends one row of sums
per component, never rows of data. Features should be scaled, as covariances
are differences of sums.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage, spread
from . import citywise as cw
from .pooled import product_rows, sums_width

#: Added to the variances of every component, and the least of its variances along any direction.
RIDGE = 1e-6
#: A run has settled when its mean log-likelihood per row changes by less than this.
SETTLED = 1e-3
MOST_STEPS = 100
#: Steps of k-means that a run takes from its first centres before the mixture starts.
WARM_STEPS = 10
#: A component with less mass than this has no rows left; it takes no further part.
LEAST_MASS = 1e-8
LOW_CONFIDENCE = 0.60
#: Log of the probability of a component without mass; finite, as products with an infinity may give no number.
NO_CHANCE = -1e300
#: Mixtures are copied to all tasks while their sums take at most so many bytes; beyond, blocks and mixtures meet by group and salt.
COPIED_BYTES = 64 << 20
SALTS = 32
#: Rows of a block that meet all components at once, and the groups after which a task sends what it holds.
CHUNK_ROWS = 512
HELD_GROUPS = 256


def parameters(sums: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, means, covariances) of the components of one mixture; a component without mass has weight 0."""
    mass = sums[:, 0]
    live = mass > LEAST_MASS
    scale = np.where(live, mass, 1.0)[:, None]
    means = np.where(live[:, None], sums[:, 1:1 + d] / scale, 0.0)
    i, j = np.triu_indices(d)
    covariances = np.zeros((len(sums), d, d))
    covariances[:, i, j] = covariances[:, j, i] = sums[:, 1 + d:] / scale - means[:, i] * means[:, j]
    return np.where(live, mass, 0.0) / mass[live].sum(), means, covariances


def coefficients(sums: np.ndarray, d: int) -> np.ndarray:
    """Per component the numbers that, times ``product_rows``, give the log of weight times density.

    That log is a polynomial of degree two in the features, so all components
    of all runs take one matrix product. A component without mass has next to
    nothing everywhere.
    """
    weights, means, covariances = parameters(sums, d)
    live = weights > 0
    spread, axes = np.linalg.eigh(covariances + RIDGE * np.eye(d))
    spread = np.maximum(spread, RIDGE)
    inverse = (axes / spread[:, None, :]) @ axes.transpose(0, 2, 1)
    linear = (inverse @ means[:, :, None])[:, :, 0]
    constant = np.log(np.where(live, weights, 1.0)) - 0.5 * (d * np.log(2 * np.pi) + np.log(spread).sum(axis=1) + (linear * means).sum(axis=1))
    i, j = np.triu_indices(d)
    out = np.column_stack([constant, linear, np.where(i == j, -0.5, -1.0) * inverse[:, i, j]])
    out[~live] = 0.0
    out[~live, 0] = NO_CHANCE
    return out


def shares_of(joint: np.ndarray) -> np.ndarray:
    """Log-likelihood of each row of ``joint`` (components x ... x rows), which becomes the rows' probabilities in place."""
    top = joint.max(axis=0)
    joint -= top
    np.exp(joint, out=joint)
    total = joint.sum(axis=0)
    joint /= total
    return top + np.log(total)


def memberships(x: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each row, its probability for each component)."""
    joint = coefficients(sums, x.shape[1]) @ product_rows(x).T
    ll = shares_of(joint)
    return ll, joint.T


def copied(runs: DataFrame, d: int) -> bool:
    """Whether the sums of ``runs`` are small enough to be copied to all tasks. Measured once: they do not grow from step to step."""
    return (runs.agg(F.sum(F.col("k").cast("long") * 8 * sums_width(d)).alias("n")).first().n or 0) <= COPIED_BYTES


def with_mixtures(blocks: DataFrame, runs: DataFrame, column: str, copy: bool) -> DataFrame:
    """Blocks with all runs of their group as ``runs``, which are copied to all tasks or met by group and salt."""
    before = F.col("log_likelihood") if "log_likelihood" in runs.columns else F.lit(None).cast("double")
    held = runs.groupBy("group").agg(F.collect_list(F.struct("k", "start", column, before.alias("before"))).alias("runs"))
    if copy:
        return blocks.join(F.broadcast(held), "group")
    salted = held.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return blocks.withColumn("_salt", F.pmod(F.xxhash64("keys"), F.lit(SALTS)).cast("int")).join(salted, ["group", "_salt"]).drop("_salt")


def merged_sums(parts: DataFrame, d: int) -> DataFrame:
    """(group, k, start, sums, log_likelihood, before): the sums of all tasks of every run, its components in order.

    One shuffle by run serves both aggregates; a task has merged its rows already.
    """
    per_component = parts.repartition("group", "k", "start").groupBy("group", "k", "start", "component").agg(
        F.array(*[F.sum(F.col("sums")[i]) for i in range(sums_width(d))]).alias("sums"), F.sum("ll").alias("ll"), F.first("before").alias("before"))
    return per_component.groupBy("group", "k", "start").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("component", "sums"))), lambda s: s["sums"]).alias("sums"),
        F.sum("ll").alias("log_likelihood"), F.first("before").alias("before"))


class _Runs:
    """The runs of one group and what a task has added up for them; a row of ``sums`` per component, runs of equal k side by side."""

    def __init__(self, models: list[dict], column: str, d: int):
        self.d, by_k = d, {}
        for m in models:
            by_k.setdefault(m["k"], []).append(m)
        self.parts, arrays, at = [], [], 0  # (k, its runs, first row); rows are in order of component, then run
        for k, own in by_k.items():
            arrays.append(np.array([m[column] for m in own], dtype=np.float64).transpose(1, 0, 2).reshape(k * len(own), -1))
            self.parts.append((k, own, at))
            at += k * len(own)
        self.given = np.concatenate(arrays)
        self.sums = np.zeros((at, sums_width(d)))
        self.ll = [np.zeros(len(own)) for _, own, _ in self.parts]

    def rows(self, group: str) -> list[tuple]:
        out = []
        for (k, own, at), ll in zip(self.parts, self.ll, strict=True):
            sums = self.sums[at:at + k * len(own)].reshape(k, len(own), -1)
            out += [(group, k, m["start"], c, sums[c, r].tolist(), float(ll[r]) if c == 0 else 0.0, m["before"]) for r, m in enumerate(own) for c in range(k)]
        return out


class _Soft(_Runs):
    """Runs whose rows belong to all components of a mixture, each by its probability."""

    def __init__(self, models, column, d):
        super().__init__(models, column, d)
        self.factors = np.concatenate([self._of_runs(*part) for part in self.parts])

    def _of_runs(self, k, own, at):
        """Weights are shares of a run's mass, so every run has its own."""
        given = self.given[at:at + k * len(own)].reshape(k, len(own), -1)
        return np.stack([coefficients(given[:, r], self.d) for r in range(len(own))], axis=1).reshape(k * len(own), -1)

    def add(self, x):
        products = product_rows(x)
        joint = self.factors @ products.T
        for (k, own, at), ll in zip(self.parts, self.ll, strict=True):
            ll += shares_of(joint[at:at + k * len(own)].reshape(k, len(own), len(x))).sum(axis=1)
        self.sums += joint @ products


class _Hard(_Runs):
    """Runs whose rows belong to the nearest centre, the first on a tie."""

    def add(self, x):
        products, squares = product_rows(x), (x ** 2).sum(axis=1)
        distance = squares - 2.0 * self.given @ x.T + (self.given ** 2).sum(axis=1)[:, None]
        shares = np.zeros((len(self.given), len(x)))
        for k, own, at in self.parts:
            label = distance[at:at + k * len(own)].reshape(k, len(own), len(x)).argmin(axis=0)
            shares[at:at + k * len(own)] = (label == np.arange(k)[:, None, None]).reshape(k * len(own), len(x))
        self.sums += shares @ products


def _summing(d: int, column: str, kind: type[_Runs]):
    """A pass over blocks that adds up the rows of each component of each run: their mass, sums and sums of products."""
    names = ["group", "k", "start", "component", "sums", "ll", "before"]
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64()]

    def sent(held):
        out = [row for group, runs in held.items() for row in runs.rows(group)]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    def run(batches):
        held: dict[str, _Runs] = {}
        for batch in batches:
            groups, data, models = [batch.column(batch.schema.get_field_index(c)) for c in ("group", "x", "runs")]
            for row, group in enumerate(groups.to_pylist()):
                if group not in held:
                    if len(held) >= HELD_GROUPS:
                        yield sent(held)
                        held = {}
                    held[group] = kind(models[row].as_py(), column, d)
                x = np.frombuffer(data[row].as_py(), dtype=np.float64).reshape(-1, d)
                for i in range(0, len(x), CHUNK_ROWS):
                    held[group].add(x[i:i + CHUNK_ROWS])
        if held:
            yield sent(held)

    return run


_PARTS = "group string, k int, start int, component int, sums array<double>, ll double, before double"


def first_mixtures(blocks: DataFrame, runs: DataFrame, d: int, copy: bool = False) -> DataFrame:
    """The mixture whose components are the rows nearest to the centres of each k-means run."""
    parts = with_mixtures(blocks, runs, "centres", copy).mapInArrow(_summing(d, "centres", _Hard), _PARTS)
    return merged_sums(parts, d).drop("log_likelihood", "before")


def em_step(blocks: DataFrame, runs: DataFrame, d: int, copy: bool = False) -> DataFrame:
    """Every run after one step; ``log_likelihood`` is that of the mixture before it, ``before`` the one that ``runs`` came with."""
    return merged_sums(with_mixtures(blocks, runs, "sums", copy).mapInArrow(_summing(d, "sums", _Soft), _PARTS), d)


def fit_runs(blocks: DataFrame, runs: DataFrame, d: int, copy: bool = False, most_steps: int = MOST_STEPS, settled: float = SETTLED) -> DataFrame:
    """(group, k, start, sums, log_likelihood): all runs after their last step. Settled runs drop out of the passes."""
    state = cut_lineage(runs.select("group", "k", "start", "sums", F.lit(None).cast("double").alias("log_likelihood"), F.lit(False).alias("done")))
    for _ in range(most_steps):
        active = state.filter(~F.col("done"))
        if active.isEmpty():
            break
        rows = F.aggregate("sums", F.lit(0.0), lambda s, c: s + c[0])
        after = em_step(blocks, active, d, copy).withColumn(
            "done", F.coalesce(F.abs(F.col("log_likelihood") - F.col("before")) < settled * rows, F.lit(False))).drop("before")
        state = cut_lineage(state.filter("done").unionByName(after))
    return state.drop("done")


def fit(df: DataFrame, features: Sequence[str], key: str, ks: Sequence[int], starts: int, by: str = "city", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(blocks, best runs): the mixture of largest log-likelihood of every (group, k), the first start on a tie.

    Runs start from k-means++ draws and WARM_STEPS steps of k-means. Rows must
    have no nulls in ``features`` or ``by``; an empty table has no runs.
    Repeated rows count as often as they occur.
    """
    d = len(features)
    df = spread(df.select(key, by, *features))
    blocks = cw.feature_blocks(df, features, key, by)
    cores = df.sparkSession.sparkContext.defaultParallelism
    if blocks.rdd.getNumPartitions() < cores:  # few, large steps of a small table would leave cores idle
        blocks = cut_lineage(blocks.repartition(cores))
    centres = cut_lineage(cw.starting_centres(df, features, key, ks, starts, by, seed))
    if blocks.isEmpty():
        none = centres.select("group", "k", "start", F.col("centres").alias("sums"), F.lit(None).cast("double").alias("log_likelihood"))
        return blocks, none
    warm = cw.kmeans_runs(blocks, centres, WARM_STEPS)
    copy = copied(warm, d)
    runs = fit_runs(blocks, first_mixtures(blocks, warm, d, copy), d, copy)
    order = Window.partitionBy("group", "k").orderBy(F.desc("log_likelihood"), "start")
    best = runs.withColumn("_at", F.row_number().over(order)).filter(F.col("_at") == 1).drop("_at")
    return blocks, cut_lineage(best)


def scored_rows(blocks: DataFrame, runs: DataFrame, d: int) -> DataFrame:
    """(group, k, key, component, probability): every row by every run, its likeliest component (the first on a tie)."""
    names = ["group", "k", "key", "component", "probability"]

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "keys", "x", "runs")]
            for group, keys, data, models in zip(*columns, strict=True):
                x = np.frombuffer(data, dtype=np.float64).reshape(-1, d)
                for m in models:
                    _, shares = memberships(x, np.array(m["sums"], dtype=np.float64))
                    yield pa.RecordBatch.from_arrays([pa.array([group] * len(keys)), pa.array([m["k"]] * len(keys), pa.int32()), pa.array(keys, pa.int64()),
                                                      pa.array(shares.argmax(axis=1).astype(np.int32)), pa.array(shares.max(axis=1))], names=names)

    return with_mixtures(blocks, runs, "sums", copied(runs, d)).mapInArrow(
        run, "group string, k int, key bigint, component int, probability double")


def mixture_facts(blocks: DataFrame, runs: DataFrame, d: int, copy: bool = False) -> DataFrame:
    """(group, k, start, rows, log_likelihood, probability, low, clusters, facts) of every run; rows stay in their blocks.

    probability and low add up the rows' largest memberships and count those
    below LOW_CONFIDENCE. ``facts`` are, per component, the number of rows it
    is the likeliest for, the sums of their features and of their squared lengths.
    """
    totals = ["rows", "ll", "probability", "low"]

    def run(batches):
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("group", "x", "runs")]
            out = []
            for group, data, models in zip(*columns, strict=True):
                x = np.frombuffer(data, dtype=np.float64).reshape(-1, d)
                added = np.column_stack([np.ones(len(x)), x, (x ** 2).sum(axis=1)])
                for m in models:
                    ll, shares = memberships(x, np.array(m["sums"], dtype=np.float64))
                    label, most = shares.argmax(axis=1), shares.max(axis=1)
                    facts = (label == np.arange(m["k"])[:, None]).astype(np.float64) @ added
                    out += [(group, m["k"], m["start"], c, facts[c].tolist(), *((len(x), ll.sum(), most.sum(), (most < LOW_CONFIDENCE).sum()) if c == 0 else (0,) * 4))
                            for c in range(m["k"])]
            if out:
                columns = zip(zip(*out, strict=True), [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), *[pa.float64()] * 4], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in columns], names=["group", "k", "start", "component", "facts", *totals])

    parts = with_mixtures(blocks, runs, "sums", copy).mapInArrow(run, "group string, k int, start int, component int, facts array<double>, " + ", ".join(
        f"{c} double" for c in totals))
    one = parts.groupBy("group", "k", "start", "component").agg(F.array(*[F.sum(F.col("facts")[i]) for i in range(d + 2)]).alias("facts"),
                                                                *[F.sum(c).alias(c) for c in totals])
    return one.groupBy("group", "k", "start").agg(
        F.sum("rows").cast("long").alias("rows"), F.sum("ll").alias("log_likelihood"), F.sum("probability").alias("probability"), F.sum("low").alias("low"),
        F.sum((F.col("facts")[0] > 0).cast("long")).alias("clusters"),
        F.transform(F.array_sort(F.collect_list(F.struct("component", "facts"))), lambda s: s["facts"]).alias("facts"))


def mixture_sweep(df: DataFrame, features: Sequence[str], key: str, ks: Sequence[int] = range(2, 9), starts: int = 5, by: str = "city") -> DataFrame:
    """CL6: per group and k, the best of ``starts`` mixtures: log-likelihood, AIC, BIC, mean largest membership, share below 0.60, silhouette.

    The silhouette is squared Euclidean and over all rows; null if all rows
    fall into one component.
    """
    d = len(features)
    blocks, best = fit(df, features, key, ks, starts, by)
    copy = copied(best, d)
    facts = cut_lineage(mixture_facts(blocks, best, d, copy))
    labels = lambda x, run: memberships(x, np.array(run["sums"], dtype=np.float64))[1].argmax(axis=1)
    known = best.select("group", "k", "start", "sums").join(facts.select("group", "k", "start", "facts"), ["group", "k", "start"])
    scores = cw.silhouette_sums(blocks, known, d, copy, labels, "sums")
    free = F.col("k") * sums_width(d) - 1  # per component a weight, a mean and a covariance; the weights sum to 1
    return facts.join(scores, ["group", "k", "start"]).withColumn("parameters", free.cast("long")).select(
        F.col("group").alias(by), "k", "rows", "parameters", "log_likelihood",
        (2 * F.col("parameters") - 2 * F.col("log_likelihood")).alias("aic"),
        (F.col("parameters") * F.log(F.col("rows").cast("double")) - 2 * F.col("log_likelihood")).alias("bic"),
        (F.col("probability") / F.col("rows")).alias("mean_max_probability"), (F.col("low") / F.col("rows")).alias("low_confidence_share"),
        F.when(F.col("clusters") > 1, F.col("v") / F.col("rows")).alias("silhouette"))


def mixture_segments(df: DataFrame, features: Sequence[str], key: str, k: int = 4, starts: int = 10, by: str = "city",
                     out: str = "cluster_id") -> DataFrame:
    """CL7: (key, component, membership_probability, low_confidence) of every row by its group's own best mixture."""
    blocks, best = fit(df, features, key, [k], starts, by)
    return scored_rows(blocks, best, len(features)).select(
        F.col("key").alias(key), F.col("component").alias(out), F.col("probability").alias("membership_probability"),
        (F.col("probability") < LOW_CONFIDENCE).alias("low_confidence"))


def mixture_moments(df: DataFrame, features: Sequence[str], key: str, k: int = 4, starts: int = 10, by: str = "city") -> DataFrame:
    """CL7: (group, feature_a, feature_b, rows, covariance) that the group's best mixture implies.

    A step of expectation maximisation leaves the mass, mean and covariance of
    the whole mixture equal to those of the data, whatever the starts.
    """
    _, best = fit(df, features, key, [k], starts, by)
    d = len(features)
    whole = best.select("group", F.aggregate("sums", F.array_repeat(F.lit(0.0), sums_width(d)), lambda s, c: F.zip_with(s, c, lambda a, b: a + b)).alias("s"))
    at, cells = 1 + d, []
    for i in range(d):
        for j in range(i, d):
            s = F.col("s")
            cells.append(F.struct(F.lit(features[i]).alias("feature_a"), F.lit(features[j]).alias("feature_b"),
                                  (s[at] / s[0] - s[1 + i] / s[0] * s[1 + j] / s[0]).alias("covariance")))
            at += 1
    return whole.select(F.col("group").alias(by), F.round(F.col("s")[0]).cast("long").alias("rows"), F.explode(F.array(*cells)).alias("c")).select(
        by, "c.feature_a", "c.feature_b", "rows", "c.covariance")
