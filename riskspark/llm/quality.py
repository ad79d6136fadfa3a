"""Compression classifier: dictionaries of good and bad text, calibrated size difference.

A zstandard dictionary is trained on labelled good text and another on labelled bad text. A text is
compressed piece by piece with each; ``x = (size_bad - size_good) / (size_bad + size_good)`` is positive
when the good dictionary fits better. A logistic curve fitted on other labelled rows turns x into a
probability of label 1.

What is learned from a sample: ``sample_docs`` labelled documents of each class, chosen by a hash of
the id; half of them supply ``dictionary_pieces`` pieces for the dictionaries, the other half the
calibration. Class weights come from all labels. Scoring covers every whole text.

Defined results: NULL text is empty; an empty text has x = 0 and the score of the curve there; labels
that are NULL or neither 0 nor 1 are ignored, contradicting labels of one id count as 0; without two
classes every score is the share of label 1 (0.5 without labels). Scores depend on the text alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskspark.llm.common import saved, whole

PIECE_BYTES = 2048
DICTIONARY_BYTES = 64 << 10
LEVEL = 3


@dataclass(frozen=True)
class Model:
    good: bytes | None
    bad: bytes | None
    slope: float
    intercept: float


def _train(pieces: list[bytes]) -> bytes | None:
    """Dictionary of the pieces; too few for the trainer: the pieces themselves."""
    if not pieces:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[-DICTIONARY_BYTES:]


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    dictionary = zstandard.ZstdCompressionDict(content)
    dictionary.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=dictionary, write_checksum=False, write_dict_id=False)


def margin(text: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Normalised difference of compressed sizes over all pieces of the whole text."""
    sizes = [0, 0]
    for start in range(0, len(text), PIECE_BYTES):
        piece = text[start : start + PIECE_BYTES]
        sizes[0] += len(good.compress(piece))
        sizes[1] += len(bad.compress(piece))
    total = sizes[0] + sizes[1]
    return (sizes[1] - sizes[0]) / total if total else 0.0


def margins(docs: DataFrame, model: Model, text: str = "text", name: str = "margin") -> DataFrame:
    """``docs`` with the margin of each row's whole text as column ``name``."""

    @F.pandas_udf("double")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        good, bad = _compressor(model.good), _compressor(model.bad)
        for batch in batches:
            yield pd.Series([margin(body, good, bad) for body in batch], dtype="float64")

    return docs.withColumn(name, measure(whole(text).cast("binary")))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Weighted one-variable logistic fit by damped Newton steps with a small ridge."""
    scale = float(np.std(x)) or 1.0
    design = np.stack([x / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (weight * (y - p)) - 1e-3 * weight.sum() * np.array([beta[0], 0.0]) / 10
        curve = (design * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ design
        step = np.linalg.solve(curve + 1e-6 * weight.sum() * np.eye(2), gradient)
        beta += step * min(1.0, 3.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def fit(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    sample_docs: int = 4000,
    dictionary_pieces: int = 3000,
) -> Model:
    """Learn from the rows of ``labels``; leave held-out rows out before calling."""
    marked = (
        labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).alias("_qc_id"))
        .agg(F.min(label).cast("int").alias("_qc_label"))
    )
    counts = {r["_qc_label"]: r["count"] for r in marked.groupBy("_qc_label").count().collect()}
    if not counts.get(0) or not counts.get(1):
        share = counts.get(1, 0) / sum(counts.values()) if counts else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return Model(None, None, 0.0, math.log(share / (1 - share)))
    order = F.xxhash64("_qc_id", F.lit("sample"))
    sample = None
    for value in (0, 1):
        part = marked.filter(F.col("_qc_label") == value).orderBy(order, "_qc_id").limit(sample_docs)
        sample = part if sample is None else sample.unionByName(part)
    texts = saved(
        docs.select(F.col(doc_id).alias("_qc_id"), whole(text).alias("_qc_text")).join(F.broadcast(sample), "_qc_id"),
        "quality-sample",
    ).withColumn("_qc_half", F.pmod(F.xxhash64("_qc_id", F.lit("half")), F.lit(2)))
    body = F.col("_qc_text").cast("binary")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.octet_length("_qc_text")), F.lit(PIECE_BYTES))
    pieces = texts.filter("_qc_half = 0").select("_qc_label", "_qc_id", body.alias("_qc_body"), F.explode(starts).alias("_qc_at"))
    pieces = pieces.select(
        "_qc_label",
        F.xxhash64("_qc_id", "_qc_at").alias("_qc_order"),
        F.substring("_qc_body", F.col("_qc_at"), F.lit(PIECE_BYTES)).alias("_qc_piece"),
    )
    found = {}
    for value in (0, 1):
        rows = pieces.filter(F.col("_qc_label") == value).orderBy("_qc_order", "_qc_piece").limit(dictionary_pieces)
        found[value] = _train([bytes(r["_qc_piece"]) for r in rows.select("_qc_piece").collect() if r["_qc_piece"]])
    share = math.log(counts[1] / counts[0])
    if found[0] is None or found[1] is None:
        return Model(None, None, 0.0, share)
    raw = Model(found[1], found[0], 0.0, 0.0)
    rows = margins(texts.filter("_qc_half = 1").select("_qc_label", "_qc_text"), raw, "_qc_text").select("_qc_label", "margin")
    pairs = np.array([(r["margin"], r["_qc_label"]) for r in rows.collect()], dtype=float).reshape(-1, 2)
    y = pairs[:, 1]
    if not (0 < y.sum() < len(y)):
        return Model(found[1], found[0], 40.0, share)
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum())) * len(y) / sum(counts.values())
    slope, intercept = _logistic(pairs[:, 0], y, weight)
    return Model(found[1], found[0], slope, intercept)


def score(docs: DataFrame, model: Model, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the calibrated probability of label 1 as column ``name`` (replaced if present)."""
    if model.good is None:
        return docs.withColumn(name, F.lit(1 / (1 + math.exp(-model.intercept))))
    measured = margins(docs.drop(name), model, text, "_qc_margin")
    value = 1 / (1 + F.exp(-(F.lit(model.slope) * F.col("_qc_margin") + F.lit(model.intercept))))
    return measured.withColumn(name, value).drop("_qc_margin")
