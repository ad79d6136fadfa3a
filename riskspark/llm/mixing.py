"""Soft-membership mixing: posteriors over domains, then document rates that meet token targets.

A naive Bayes classifier over hashed words learns from a labelled table and gives every document a
posterior over the domains. Rates r >= 0 are then fitted by projected-gradient least squares so that the
expected tokens per domain, sum of r * tokens * posterior, meet target shares of the corpus tokens.
All documents start at rate 1. Gradient steps add up in one number per domain, m, and the rates are the
projection of 1 + m . posterior on r >= 0 (projected gradient in its lazy form); a pull of rates towards 1,
lowered in stages to 1e-7, makes the optimum unique and keeps m finite where targets cannot be met. A step is
scaled by the domains' second moments over documents at positive rates, and its length is the best of a few.

Only DataFrame functions are used. Documents with the same posterior (rounded to 3 decimals) always
have the same rate, so steps run on token totals per distinct posterior; each step returns a handful of
sums. Rates are a fixed expression of the posterior, so no per-document state is carried along.

Learned from a sample: at most ``sample_docs`` labelled documents of each domain, chosen by a hash of
the id. Everything else covers all documents.

Defined results: NULL text is empty; a document without words has the prior as posterior and 0 tokens;
rows that share an id are one document; a NULL id is one document. Labels that are NULL or not among the
targets are ignored; contradicting labels take the smallest domain name. Without labels the posterior
is uniform. Targets that cannot be met are met as closely as least squares allows (up to
the pull), with large rates for the few documents nearest to them. A text of any length is one row of words. An empty table gives
an empty result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import SPACES, ascii_lower, saved, whole

BUCKETS = 1 << 16
SMOOTHING = 0.1
TEMPER = 0.5
PULLS = (1e-1, 1e-3, 1e-5, 1e-7)
STEPS = 15
LENGTHS = (0.0, 1.0, 1 / 2, 1 / 4, 1 / 8, 1 / 32, 1 / 128)
TOLERANCE = 1e-6


def _words(docs: DataFrame, doc_id: str, text: str, *keep: str) -> DataFrame:
    """One row per word with its bucket (NULL where a text has no word at all)."""
    pattern = "[" + "".join(f"\\x{b:02X}" for b in SPACES) + "]+"
    word = F.explode(F.split(ascii_lower(whole(text)), pattern)).alias("_mx_word")
    bucket = F.when(F.col("_mx_word") != "", F.pmod(F.xxhash64("_mx_word"), F.lit(BUCKETS)))
    return docs.select(F.col(doc_id).alias("doc_id"), *keep, word).select("doc_id", *keep, bucket.alias("bucket"))


def train(
    docs: DataFrame, labels: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", sample_docs: int = 8000
) -> tuple[DataFrame, list[float]]:
    """Word weights (bucket, w0, w1, ... one per domain; every bucket once) and log priors.

    ``labels``: doc_id, domain.
    """
    marked = labels.filter(F.col("domain").isin(domains) & F.col("doc_id").isNotNull())
    marked = marked.groupBy(F.col("doc_id").alias("_mx_id")).agg(F.min("domain").alias("_mx_domain"))
    counts = {r["_mx_domain"]: r["count"] for r in marked.groupBy("_mx_domain").count().collect()}
    total = sum(counts.values()) + len(domains)
    priors = [float(np.log((counts.get(d, 0) + 1) / total)) for d in domains]
    order = F.xxhash64("_mx_id", F.lit("mix"))
    parts = [marked.filter(F.col("_mx_domain") == d).orderBy(order, "_mx_id").limit(sample_docs) for d in domains]
    sample = reduce(DataFrame.unionByName, parts)
    chosen = docs.select(F.col(doc_id).alias("_mx_id"), F.col(text).alias("_mx_text")).join(F.broadcast(sample), "_mx_id")
    words = _words(chosen, "_mx_id", "_mx_text", "_mx_domain").filter("bucket IS NOT NULL")
    counted = [F.count(F.when(F.col("_mx_domain") == d, True)).alias(f"c{i}") for i, d in enumerate(domains)]
    table = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    table = saved(table.join(words.groupBy("bucket").agg(*counted), "bucket", "left").fillna(0), "mix-words")
    sums = table.agg(*[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(domains))]).first()
    weights = [
        F.log((F.col(f"c{i}") + SMOOTHING) / (sums[i] + SMOOTHING * BUCKETS)).alias(f"w{i}") for i in range(len(domains))
    ]
    return table.select("bucket", *weights), priors


def posteriors(
    docs: DataFrame, weights: DataFrame, priors: list[float], doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, p0, p1, ...: one row per document id; the p are multiples of 0.001 that sum to 1."""
    n = len(priors)
    scored = _words(docs, doc_id, text).join(F.broadcast(weights), "bucket", "left")
    sums = [F.coalesce(F.sum(f"w{i}"), F.lit(0.0)).alias(f"s{i}") for i in range(n)]
    scored = scored.groupBy("doc_id").agg(F.count("bucket").alias("n_tokens"), *sums)
    score = [F.lit(priors[i]) + TEMPER * F.col(f"s{i}") for i in range(n)]
    top = F.greatest(*score) if n > 1 else score[0]
    shares = [F.exp(s - top) for s in score]
    total = reduce(lambda a, b: a + b, shares)
    thousandths = [F.round(1000 * s / total).cast("int") for s in shares[:-1]]
    rest = F.greatest(F.lit(0), 1000 - reduce(lambda a, b: a + b, thousandths)) if n > 1 else F.lit(1000)
    whole_parts = scored.select("doc_id", "n_tokens", *[t.alias(f"t{i}") for i, t in enumerate([*thousandths, rest])])
    all_parts = reduce(lambda a, b: a + b, [F.col(f"t{i}") for i in range(n)])
    return whole_parts.select("doc_id", "n_tokens", *[(F.col(f"t{i}") / all_parts).alias(f"p{i}") for i in range(n)])


def rate_of(moved: np.ndarray) -> Column:
    """Rate after gradient steps that add up to ``moved``, projected on r >= 0."""
    move = reduce(lambda a, b: a + b, [F.lit(float(m)) * F.col(f"p{i}") for i, m in enumerate(moved)])
    return F.greatest(F.lit(0.0), F.lit(1.0) + move)


def fit_rates(members: DataFrame, targets: list[float]) -> np.ndarray:
    """Sum of the gradient steps, for ``rate_of``; ``members`` as from ``posteriors``."""
    n = len(targets)
    share = np.array(targets, float) / sum(targets)
    names = [f"p{i}" for i in range(n)]
    groups = saved(members.groupBy(*names).agg(F.sum("n_tokens").cast("double").alias("tokens")), "mix-posteriors")
    corpus = groups.agg(F.sum("tokens")).first()[0]
    if not corpus:
        return np.zeros(n)
    pairs = [(i, j) for i in range(n) for j in range(i, n)]

    def state(moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the rates miss of the targets, and second moments over groups at positive rates."""
        rated = groups.select("tokens", *names, rate_of(moved).alias("rate"))
        row = rated.agg(
            *[F.sum(F.col("rate") * F.col("tokens") * F.col(p)) for p in names],
            *[F.sum(F.when(F.col("rate") > 0, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)) for i, j in pairs],
        ).first()
        moments = np.zeros((n, n))
        for (i, j), value in zip(pairs, row[n:], strict=True):
            moments[i, j] = moments[j, i] = value / corpus
        return np.array(row[:n]) / corpus - share, moments

    def heights(trials: list[np.ndarray], pull: float) -> np.ndarray:
        """The convex function whose gradient is gap + pull * moved, at every trial."""
        row = groups.agg(*[F.sum(F.col("tokens") * rate_of(t) * rate_of(t)) for t in trials]).first()
        return np.array([pull / 2 * t @ t + r / corpus / 2 - share @ t for t, r in zip(trials, row, strict=True)])

    moved = np.zeros(n)
    for pull in PULLS:
        for _ in range(STEPS):
            gap, moments = state(moved)
            if np.abs(gap).max() <= TOLERANCE:
                return moved
            gradient = gap + pull * moved
            if np.abs(gradient).max() <= 1e-3 * np.abs(gap).max():
                break
            step = np.linalg.solve(moments + pull * np.eye(n), gradient)
            trials = [moved - length * step for length in LENGTHS]
            best = int(np.argmin(heights(trials, pull)))
            if not LENGTHS[best]:
                break
            moved = trials[best]
    return moved


def mix(
    docs: DataFrame, labels: DataFrame, targets: dict[str, float], doc_id: str = "doc_id", text: str = "text", sample_docs: int = 8000
) -> DataFrame:
    """doc_id, n_tokens, p_<domain> for each target, rate, copies.

    ``copies`` rounds the rate up or down by a hash of the id, so that its expectation is the rate.
    """
    domains = list(targets)
    weights, priors = train(docs, labels, domains, doc_id, text, sample_docs)
    members = saved(posteriors(docs, weights, priors, doc_id, text), "mix-members")
    rate = rate_of(fit_rates(members, list(targets.values())))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / float(1 << 30)
    return members.select(
        "doc_id",
        "n_tokens",
        *[F.col(f"p{i}").alias(f"p_{d}") for i, d in enumerate(domains)],
        rate.alias("rate"),
    ).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def quality_domains(labels: DataFrame) -> DataFrame:
    """doc_id, domain from a table of quality and toxic marks: toxic before low before clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain"))
