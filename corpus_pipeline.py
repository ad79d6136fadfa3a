"""A training-data pipeline over the documents table: filter, deduplicate, decontaminate, mix.

Every stage works on all rows that its predecessor kept, written as Parquet and read again. NULL texts
count as empty; columns besides doc_id and text are carried along untouched, but for mix_tokens, mix_rate
and mix_copies, which the last stage sets. Rows that share an id stay or go by their own text, except that a near
copy or a contaminated text takes all rows of its id along; of tied copies the largest id (exact) or the smallest
(near) stays. An empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskspark.llm import decontaminate, exact_dedup, mixing, near_dup, quality
from riskspark.llm.common import bounded, saved, table

TARGETS = {"clean": 0.95, "low": 0.03, "toxic": 0.02}
MIXED = ("mix_tokens", "mix_rate", "mix_copies")
# SQL has neither the compression classifier nor the later stages' methods: tested by brute force
ORACLE_SQL = None


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents whose id is not among ``ids`` (column doc_id); rows without an id stay."""
    dropped = saved(ids.select(F.col("doc_id").alias("_cp_id")).distinct(), "dropped-ids")
    return docs.join(bounded(dropped), F.col("doc_id") == F.col("_cp_id"), "left_anti")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores at 0.5 or more."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model, name="_cp_score").filter("_cp_score >= 0.5").select(docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five-word shingles, 0.8) the smallest doc_id."""
    groups = near_dup.near_groups(docs, size=5, percent=80)
    return _without(docs, groups.filter("NOT kept"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window like a benchmark item (five-word shingles, 0.8)."""
    return _without(docs, decontaminate.find(docs, table(spark, sf_dir, "benchmark")))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with mix_tokens, mix_rate and mix_copies; those with no copy are left out.

    What is joined to the texts is a written table of a few numbers per id, broadcast where its counted size
    allows; beyond that the texts are shuffled once.
    """
    labels = mixing.quality_domains(table(spark, sf_dir, "labels"))
    mixed = mixing.mix(docs, labels, TARGETS).filter("copies > 0")
    mixed = mixed.select(
        F.col("doc_id").alias("_cp_id"),
        *[F.col(c).alias(f"_cp_{c}") for c in ("n_tokens", "rate", "copies")],
    )
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in MIXED]
    joined = docs.join(bounded(saved(mixed, "mixed")), F.col("doc_id").eqNullSafe(F.col("_cp_id")))
    own = [F.col(f"_cp_{c}").alias(name) for c, name in zip(("n_tokens", "rate", "copies"), MIXED, strict=True)]
    return joined.select(*kept, *own)


STAGES = [
    ("quality", keep_quality),
    ("exact", drop_exact_copies),
    ("near", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_to_targets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last stage's rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
